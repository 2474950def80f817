"""Which family suits a table: evidence from the data, points by rule, advice."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lacuna.functions import exprs
from lacuna.functions.checks import check_choice
from lacuna.operators import auto, diagnostics
from lacuna.plans.patterns import profile

# Families in their order of preference, thresholds and points.
ORDER = ("linear", "ridge", "lasso", "bayes", "neighbors", "support", "process", "mixed")
DROP_RATE = 0.60
HIGH_MISSING = 0.30
PROCESS_ROWS = 1000
PROBE_ROWS = 2000
PROBE_MARGIN = 0.01
TAILS = 7.0
SCALE_RATIO = 1000.0
#: Vetoes and points: family, condition on the evidence row, points, reason.
VETOES = (
    ("mixed", "n_groups IS NULL", "no groups are named"),
    ("process", f"n > {PROCESS_ROWS}", "exact inference costs the cube of the rows"),
)
WIDE = "(p >= n_complete OR p > 0.5 * n)"
SKILL = "has_skill"
RULES = (
    ("mixed", "icc >= 0.05", 4.0, "rows cluster within groups"),
    ("linear", "icc >= 0.05", -1.5, "ignores the groups"),
    ("ridge", "icc >= 0.05", -1.5, "ignores the groups"),
    ("lasso", "icc >= 0.05", -1.5, "ignores the groups"),
    ("mixed", "icc < 0.05", -1.0, "the groups hardly differ"),
    ("ridge", WIDE, 2.5, "many features for the rows"),
    ("lasso", WIDE, 2.5, "many features for the rows"),
    ("linear", WIDE, -2.5, "unstable without a penalty"),
    ("bayes", WIDE, -2.0, "too many covariances"),
    ("ridge", f"NOT {WIDE} AND p >= 15", 1.0, "a good many features"),
    ("lasso", f"NOT {WIDE} AND p >= 15", 0.5, "some features may not matter"),
    ("neighbors", f"{SKILL} AND ratio > 1.15", 2.5, "neighbours beat a line"),
    ("support", f"{SKILL} AND ratio > 1.15", 2.5, "neighbours beat a line"),
    ("process", f"{SKILL} AND ratio > 1.15", 2.0, "neighbours beat a line"),
    ("bayes", f"{SKILL} AND ratio > 1.15", 0.5, "neighbours beat a line"),
    ("linear", f"{SKILL} AND ratio > 1.15", -2.0, "neighbours beat a line"),
    ("ridge", f"{SKILL} AND ratio > 1.15", -2.0, "neighbours beat a line"),
    ("lasso", f"{SKILL} AND ratio > 1.15", -2.0, "neighbours beat a line"),
    ("linear", f"{SKILL} AND ratio < 0.9", 2.0, "a line beats neighbours"),
    ("ridge", f"{SKILL} AND ratio < 0.9", 1.5, "a line beats neighbours"),
    ("lasso", f"{SKILL} AND ratio < 0.9", 1.0, "a line beats neighbours"),
    ("bayes", f"{SKILL} AND ratio < 0.9", 1.0, "a line beats neighbours"),
    ("neighbors", f"{SKILL} AND ratio < 0.9", -1.5, "a line beats neighbours"),
    ("support", f"{SKILL} AND ratio < 0.9", -1.5, "a line beats neighbours"),
    ("linear", f"{SKILL} AND ratio BETWEEN 0.9 AND 1.15", 0.5, "a line and neighbours do alike"),
    ("ridge", f"{SKILL} AND ratio BETWEEN 0.9 AND 1.15", 0.5, "a line and neighbours do alike"),
    ("bayes", f"{SKILL} AND ratio BETWEEN 0.9 AND 1.15", 0.5, "a line and neighbours do alike"),
    ("bayes", f"cell_rate >= {HIGH_MISSING}", 2.0, "many cells are missing"),
    ("neighbors", f"cell_rate >= {HIGH_MISSING}", -1.0, "distances suffer from missing cells"),
    ("bayes", f"cell_rate >= 0.10 AND cell_rate < {HIGH_MISSING}", 1.0, "a good many cells are missing"),
    ("bayes", "task = 'classification'", 1.0, "carries uncertain features into the probabilities"),
    ("neighbors", "heavy_tailed", 1.0, "heavy tails"),
    ("support", "heavy_tailed", 1.0, "heavy tails"),
    ("bayes", "heavy_tailed", -1.0, "heavy tails"),
)


def structure(df: DataFrame, features: list[str], label: str, group: str | None = None) -> DataFrame:
    """One row of what a few aggregations tell: sizes, missing rates, patterns, tails, scales and groups."""
    some = F.greatest(*[F.col(c).isNull().cast("int") for c in features], F.lit(0))
    cells = sum((F.col(c).isNull().cast("int") for c in features), F.lit(0))
    kept = sum(((F.count(c) / F.count("*") >= 1 - DROP_RATE).cast("int") for c in features), F.lit(0))
    sds = F.array(*[F.stddev_samp(c) for c in features])
    steep = F.greatest(*[F.abs(F.kurtosis(c)) for c in features], F.lit(0.0))
    live = F.filter(sds, lambda s: s > 0)
    t = df.agg(
        F.count("*").alias("n"), F.lit(len(features)).alias("p_all"), kept.alias("p"), F.count(F.when((some == 0) & F.col(label).isNotNull(), 1)).alias("n_complete"),
        (F.sum(cells) / (F.count("*") * len(features))).alias("cell_rate"), F.avg(some.cast("double")).alias("row_rate"), F.avg(F.col(label).isNull().cast("double")).alias("y_rate"),
        F.count_distinct(exprs.mask(features)).alias("n_patterns"), (steep > TAILS).alias("heavy_tailed"),
        F.coalesce(F.array_max(live) / F.array_min(live) > SCALE_RATIO, F.lit(False)).alias("scale_imbalance"),
        (F.count_distinct(group) if group else F.lit(None).cast("long")).alias("n_groups"),
    )
    if group and dict(df.dtypes)[label] != "string":
        found = diagnostics.icc(df, label, group).first()
        return t.withColumn("icc", F.lit(found["icc"] if found["groups"] >= 2 and found["n"] > found["groups"] else None).cast("double"))
    return t.withColumn("icc", F.lit(None).cast("double"))


def _folds(n: int, k: int) -> np.ndarray:
    return np.random.default_rng(0).permutation(n) % k


def probe(df: DataFrame, features: list[str], label: str, task: str, key: str, most: int = PROBE_ROWS) -> dict | None:
    """Cross-validated scores of a line and of neighbours on a mean-filled, bounded sample; None if there is nothing to compare.

    The sample is the rows whose hashed key is smallest.
    """
    seen = df.filter(F.col(label).isNotNull())
    rows = seen.select(*features, F.col(label).alias("_y")).orderBy(F.xxhash64(F.lit("probe"), key), key).limit(most).collect()
    if len(rows) < 40:
        return None
    x = np.array([[np.nan if r[c] is None else float(r[c]) for c in features] for r in rows])
    means = np.array([np.nanmean(c) if not np.isnan(c).all() else 0.0 for c in x.T])
    x = np.where(np.isnan(x), means, x)
    x = x[:, x.std(0) > 0]
    if not x.shape[1]:
        return None
    raw = [r["_y"] for r in rows]
    classes = sorted(set(raw))
    if task == "classification" and len(classes) < 2:
        return None
    y = np.array([classes.index(v) for v in raw]) if task == "classification" else np.array(raw, float)
    k, near = min(5, max(2, len(rows) // 20)), min(15, max(3, len(rows) // 20))
    fold = _folds(len(rows), k)
    line, local = [], []
    for f in range(k):
        tr, te = fold != f, fold == f
        sd = x[tr].std(0)
        z = (x - x[tr].mean(0)) / np.where(sd > 0, sd, 1)
        design = np.column_stack([np.ones(len(z)), z])
        ridge = np.diag([0.0] + [1.0] * z.shape[1])
        d = np.square(z[te][:, None, :] - z[tr][None]).sum(2)
        at = np.argsort(d, axis=1, kind="stable")[:, :near]
        if task == "classification":
            onehot = np.eye(len(classes))[y]
            b = np.zeros((design.shape[1], len(classes)))
            for c in range(len(classes)):  # one logistic regression per class by Newton steps
                for _ in range(15):
                    p = 1 / (1 + np.exp(-np.clip(design[tr] @ b[:, c], -30, 30)))
                    h = (design[tr] * (p * (1 - p))[:, None]).T @ design[tr] + ridge + 1e-9 * np.eye(len(ridge))
                    b[:, c] += np.linalg.solve(h, design[tr].T @ (onehot[tr, c] - p) - ridge @ b[:, c])
            line.append(np.mean((design[te] @ b).argmax(1) == y[te]))
            local.append(np.mean(onehot[tr][at].sum(1).argmax(1) == y[te]))
        else:
            b = np.linalg.solve(design[tr].T @ design[tr] + ridge, design[tr].T @ y[tr])
            total = np.square(y[te] - y[te].mean()).sum()
            line.append(1 - np.square(y[te] - design[te] @ b).sum() / total if total else np.nan)
            local.append(1 - np.square(y[te] - y[tr][at].mean(1)).sum() / total if total else np.nan)
    a, b = float(np.mean(line)), float(np.mean(local))
    if not (np.isfinite(a) and np.isfinite(b)):
        return None
    floor = 1 / len(classes) if task == "classification" else 0.0
    return {"linear_score": a, "neighbor_score": b, "ratio": max(0.0, b - floor) / max(1e-6, a - floor), "has_skill": max(a, b) - floor > PROBE_MARGIN}


def evidence(df: DataFrame, features: list[str], label: str, key: str, group: str | None = None, task: str = "auto") -> DataFrame:
    """One row: the structure, the task, the mechanism tests and the linearity probe."""
    check_choice(task, ("auto", "regression", "classification"), "task", "recommender")
    if task == "auto":
        task = auto.task_of(df, label, "recommended")
    t = structure(df, features, label, group)
    little = diagnostics.little_test(df, features).first()["p_value"] < 0.05 if df.filter(exprs.mask(features).contains("1")).limit(1).count() else False
    rates = profile(df, features)
    part = [c for c in features if 0.02 < 1 - rates[c]["n"] / max(rates[c]["rows"], 1) <= DROP_RATE]
    explained = {r["feature"] for r in diagnostics.mar_plausibility(df, features).collect() if r["p_value"] < 0.05} if part and len(features) > 1 else set()
    found = probe(df, features, label, task, key) or {}
    more = {
        "task": F.lit(task), "not_mcar": F.lit(little), "mnar_suspected": F.lit(bool(little and set(part) - explained)),
        "linear_score": F.lit(found.get("linear_score")).cast("double"), "neighbor_score": F.lit(found.get("neighbor_score")).cast("double"),
        "ratio": F.lit(found.get("ratio")).cast("double"), "has_skill": F.lit(found.get("has_skill")).cast("boolean"),
    }
    return t.withColumns(more)


def scored(row: DataFrame) -> DataFrame:
    """(family, points, rank, vetoed, reasons): the rules applied to one row of evidence; vetoed families rank last."""
    cells = [F.struct(F.lit(f).alias("family"), F.when(F.expr(c), F.lit(float(v))).otherwise(0.0).alias("points"), F.when(F.expr(c), F.lit(why)).alias("reason"), F.lit(False).alias("veto")) for f, c, v, why in RULES]
    cells += [F.struct(F.lit(f).alias("family"), F.lit(0.0).alias("points"), F.when(F.expr(c), F.lit(why)).alias("reason"), F.coalesce(F.expr(c), F.lit(False)).alias("veto")) for f, c, why in VETOES]
    cells += [F.struct(F.lit(f).alias("family"), F.lit(0.0).alias("points"), F.lit(None).cast("string").alias("reason"), F.lit(False).alias("veto")) for f in ORDER]
    t = row.select(F.explode(F.array(*cells)).alias("c")).select("c.*").groupBy("family").agg(F.sum("points").alias("points"), F.max("veto").alias("vetoed"), F.array_sort(F.collect_set("reason")).alias("reasons"))
    place = F.array_position(F.array(*[F.lit(f) for f in ORDER]), F.col("family"))
    return t.withColumn("rank", F.row_number().over(W.orderBy("vetoed", F.desc("points"), place)))  # one row per family


def advice(row: DataFrame, rates: dict[str, float]) -> DataFrame:
    """(kind, item, wanted, why): preparation, follow-ups and notes for one row of evidence and the columns' missing rates."""
    drops = [F.struct(F.lit("drop").alias("kind"), F.lit(c).alias("item"), F.lit(r > DROP_RATE).alias("wanted"), F.lit(f"{r:.0%} missing").alias("why")) for c, r in rates.items()]

    def note(kind: str, item: str, when: str, why: str):
        return F.struct(F.lit(kind).alias("kind"), F.lit(item).alias("item"), F.coalesce(F.expr(when), F.lit(False)).alias("wanted"), F.lit(why).alias("why"))

    rest = [
        note("prepare", "copula", "heavy_tailed", "features with heavy tails"), note("prepare", "standardise", "scale_imbalance", "features of very unlike scales"),
        note("follow-up", "explainer", "false", "shows what each feature, and observing it, is worth"),
        note("follow-up", "sensitivity", "mnar_suspected OR y_rate > 0", "shows how far outcomes missing not at random could move the result"),
        note("note", "patterns", "n_patterns > greatest(30, n / 20)", "many missingness patterns make the fit slow"),
        note("note", "complete rows", "n_complete < p + 2", "too few complete rows to drop the others"),
        note("note", "incomplete rows", "n_complete >= p + 2 AND row_rate > 0.5", "dropping rows would lose most of the data"),
        note("note", "missing outcomes", "y_rate > 0", "rows without outcome still inform the features' moments"),
    ]
    return row.select(F.explode(F.array(*drops, *rest)).alias("c")).select("c.*")


@dataclass
class Recommendation:
    """The evidence, the ranking and the advice for one table."""

    evidence: DataFrame
    ranking: DataFrame
    advice: DataFrame
    task: str
    features: list[str] = field(default_factory=list)

    @property
    def family(self) -> str:
        return self.ranking.orderBy("rank").first()["family"]

    def summary(self, top: int = 4) -> DataFrame:
        """(rank, family, points, reasons) of the best families."""
        return self.ranking.filter(F.col("rank") <= top).filter(~F.col("vetoed")).select("rank", "family", "points", F.concat_ws("; ", "reasons").alias("reasons"))

    def estimator(self, family: str | None = None, **parameters) -> auto.Estimator:
        """The recommended family, or another one, ready to fit."""
        family = family or self.family
        if family == "linear" and self.task == "classification":
            family = "logistic"
        return auto.Estimator(family, self.task, **parameters)


def recommend(df: DataFrame, features: list[str], label: str, key: str, group: str | None = None, task: str = "auto") -> Recommendation:
    row = evidence(df, features, label, key, group, task)
    row = df.sparkSession.createDataFrame([row.first()], row.schema)  # one row, computed once
    prof = profile(df, features)
    rates = {c: 1 - prof[c]["n"] / max(prof[c]["rows"], 1) for c in features}
    return Recommendation(row, scored(row), advice(row, rates), row.first()["task"], [c for c in features if rates[c] <= DROP_RATE])
