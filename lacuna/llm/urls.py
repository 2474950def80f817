"""URL filters: rules first, then gradient-boosted trees on lexical features.

A rule names a host suffix and a path prefix; the longest rule that fits
decides.  What no rule fits is judged by boosted trees over lexical features of
the url, fitted on labelled urls: a table of them, or the urls that the rules
decide (``label_by_rules``).  Both labels weigh the same in the fit, however
unequal their numbers, so that a score of one half says that the evidence of the
url is as good for either.  Everything is column expressions and the ML
library's own trees: no Python runs on the executors.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lacuna.llm.shared import ascii_lower, materialise

#: At most about so many labelled urls are fitted, and so many suffixes or path tokens of a kind get statistics of their own.
FIT_ROWS = 20_000
SUFFIXES = 64
#: The rate of a suffix or token counts as if it had been seen so often besides, half the time with either label.
SMOOTHING = 10


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return ascii_lower(F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: dict[str, str]) -> Column:
    """The longest of ``rules`` ({"host/path": "allow" or "block"}) that fits, else null.

    The rules are a bounded parameter and become one CASE expression.
    """
    case = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r), r)):
        name, _, prefix = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith("/" + prefix)
        case = F.when(fits, F.lit(rule)).otherwise(case)
    return case


def verdict_of(rule: Column, rules: dict[str, str]) -> Column:
    case = F.lit(None).cast("string")
    for name, verdict in sorted(rules.items()):
        case = F.when(rule == name, F.lit(verdict)).otherwise(case)
    return case


def suffix_of(host: Column) -> Column:
    """The last label of the host."""
    return F.element_at(F.split(host, r"\."), -1)


def segment_of(path: Column, n: int) -> Column:
    """The n-th segment of a path (from 1), A-Z lower-cased; empty if there are fewer."""
    return ascii_lower(F.regexp_extract(path, r"^/+" + r"[^/]+/+" * (n - 1) + r"([^/]+)", 1))


def kinds(host: Column, path: Column) -> dict[str, Column]:
    """What rates are kept of: the last label and the last two of the host, the first path segment, and how the second begins."""
    return {
        "suffix_rate": suffix_of(host),
        "domain_rate": F.substring_index(host, ".", -2),
        "segment_rate": segment_of(path, 1),
        "start_rate": F.substring(segment_of(path, 2), 1, 1),
    }


FEATURES = (
    "length", "host_length", "depth", "labels", "digit_ratio", "host_digit_ratio", "hyphens",
    "host_entropy", "longest_label", "parameters", "has_fragment", "other_ratio",
    "suffix_rate", "domain_rate", "segment_rate", "start_rate",
)


def _entropy(text: Column) -> Column:
    """Shannon entropy in bits of the characters of a short text."""
    n = F.length(text)
    share = lambda c: (n - F.length(F.replace(text, c, F.lit("")))) / n
    bits = F.aggregate(F.array_distinct(F.split(text, "")), F.lit(0.0), lambda s, c: s - F.when(c == "", 0.0).otherwise(share(c) * F.log2(share(c))))
    return F.when(n > 0, bits).otherwise(0.0)


def lexical(df: DataFrame, rates: dict[str, dict[str, float]]) -> DataFrame:
    """Adds the lexical features of ``_url``, ``_host`` and ``_path`` as double columns ``_f_*``; values without a rate count as one half."""
    url, host, path = F.col("_url"), F.col("_host"), F.col("_path")
    n = F.greatest(F.length(url), F.lit(1))
    count = lambda text, pattern: F.regexp_count(text, F.lit(pattern))

    def rate(kind: str) -> Column:
        known = rates.get(kind)
        if not known:
            return F.lit(0.5)
        found = F.create_map(*[F.lit(x) for pair in known.items() for x in pair])
        return F.coalesce(F.try_element_at(found, kinds(host, path)[kind]), F.lit(0.5))

    values = {
        "length": F.length(url),
        "host_length": F.length(host),
        "depth": count(path, "/+[^/]"),
        "labels": count(host, r"[^.]+"),
        "digit_ratio": count(url, "[0-9]") / n,
        "host_digit_ratio": count(host, "[0-9]") / F.greatest(F.length(host), F.lit(1)),
        "hyphens": count(host, "-"),
        "host_entropy": _entropy(host),
        "longest_label": F.coalesce(F.array_max(F.transform(F.split(host, r"\."), F.length)), F.lit(0)),
        "parameters": count(url, r"[?&][^&=#]+="),
        "has_fragment": F.contains(url, F.lit("#")).cast("int"),
        "other_ratio": count(url, r"[^A-Za-z0-9/:.?=&#_-]") / n,
        **{kind: rate(kind) for kind in kinds(host, path)},
    }
    return df.withColumns({f"_f_{k}": F.coalesce(values[k].cast("double"), F.lit(0.0)) for k in FEATURES})


class UrlModel:
    """Boosted trees with the rates that their features need; ``prior`` is the answer where there are no trees."""

    def __init__(self, trees: GBTClassificationModel | None, rates: dict[str, dict[str, float]], prior: float):
        self.trees, self.rates, self.prior = trees, rates, prior

    def score(self, df: DataFrame) -> DataFrame:
        """Adds ``_score``, the probability of block if both labels were equally frequent, to rows with _url, _host and _path."""
        df = lexical(df, self.rates)
        features = [f"_f_{k}" for k in FEATURES]
        if self.trees is None:
            return df.withColumn("_score", F.lit(self.prior)).drop(*features)
        df = VectorAssembler(inputCols=features, outputCol="_v").transform(df)
        df = self.trees.transform(df)
        return df.withColumn("_score", vector_to_array("_p")[1]).drop("_v", "_raw", "_p", "_pred", *features)


def _parts(df: DataFrame, url: str) -> DataFrame:
    u = F.col(url)
    return df.withColumns({"_url": F.coalesce(u, F.lit("")), "_host": host_of(u), "_path": path_of(u)})


def label_by_rules(urls: DataFrame, rules: dict[str, str], url: str = "url") -> DataFrame:
    """Labelled urls (url, label): those that a rule decides; label 1 is block."""
    verdict = verdict_of(rule_of(host_of(F.col(url)), path_of(F.col(url)), rules), rules)
    return urls.select(F.col(url).alias("url"), (verdict == "block").cast("double").alias("label")).filter("label IS NOT NULL")


def fit(labelled: DataFrame, max_rows: int = FIT_ROWS, trees: int = 12, depth: int = 3) -> UrlModel:
    """Fits the trees on at most about ``max_rows`` labelled urls (url, label 0/1).

    Where there are more, the urls of each label whose hash falls below a
    threshold are kept, so that each label fills at most half of the bound; equal
    rows become one row with their number as weight, so a url that holds any
    share of the rows adds one.  The weights of either label sum to the same.
    Of the values of each of ``kinds`` in that sample the ``SUFFIXES`` most
    frequent get a smoothed block rate of their own.  Null urls and labels teach
    nothing; with one label alone the model answers that label's share.
    """
    rows = labelled.filter(F.col("url").isNotNull() & F.col("label").isNotNull()).select("url", F.col("label").cast("double").alias("label"))
    counts = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    total = sum(counts.values())
    prior = (counts.get(1.0, 0) + 1) / (total + 2)
    if not counts.get(1.0) or not counts.get(0.0):
        return UrlModel(None, {}, prior)
    space = 1 << 30
    slot = F.pmod(F.xxhash64("url"), F.lit(space))
    limit = F.when(F.col("label") == 1.0, F.lit(int(space * min(1.0, max_rows / 2 / counts[1.0])))).otherwise(F.lit(int(space * min(1.0, max_rows / 2 / counts[0.0]))))
    distinct = rows.filter(slot < limit).groupBy("url", "label").agg(F.count("*").cast("double").alias("_n"))
    sums = {r["label"]: r["n"] for r in distinct.groupBy("label").agg(F.sum("_n").alias("n")).collect()}
    even = F.when(F.col("label") == 1.0, F.lit(0.5 / sums.get(1.0, 1.0))).otherwise(F.lit(0.5 / sums.get(0.0, 1.0)))
    weighted = distinct.withColumn("_n", F.col("_n") * even * sum(sums.values()))
    sample = materialise(_parts(weighted, "url").repartition(1).sortWithinPartitions("_url", "label"))
    rates = {}
    for kind, value in kinds(F.col("_host"), F.col("_path")).items():
        t = sample.groupBy(value.alias("s")).agg(F.sum("_n").alias("n"), F.sum(F.col("_n") * F.col("label")).alias("b"))
        rates[kind] = {r["s"]: (r["b"] + SMOOTHING / 2) / (r["n"] + SMOOTHING) for r in t.orderBy(F.desc("n"), "s").limit(SUFFIXES).collect()}
    featured = VectorAssembler(inputCols=[f"_f_{k}" for k in FEATURES], outputCol="_v").transform(lexical(sample, rates))
    learner = GBTClassifier(featuresCol="_v", labelCol="label", weightCol="_n", predictionCol="_pred", maxIter=trees, maxDepth=depth, stepSize=0.3, seed=7)
    learner.setProbabilityCol("_p").setRawPredictionCol("_raw")
    return UrlModel(learner.fit(featured.select("_v", "label", "_n")), rates, prior)


RESULTS = ("host", "path", "rule", "score", "verdict")


def judge(df: DataFrame, rules: dict[str, str], model: UrlModel, url: str = "url", threshold: float = 0.5) -> DataFrame:
    """``df`` with host, path, rule, score and verdict.

    Columns of ``df`` with these names give way to the results; any other name
    is free.  Null urls and urls without ``://`` have empty host and path, fit no
    rule and are judged by the trees on their text alone.  Equal urls get equal
    verdicts; very long urls are read as wholes; an empty table gives an empty result.
    """
    own = [c for c in df.columns if c.lower() not in RESULTS]
    row = F.struct(*[F.col(f"`{c}`") for c in own]) if own else F.lit(None)
    out = model.score(_parts(df.select(row.alias("_row"), F.col(url).alias("_given")), "_given"))
    out = out.withColumn("_rule", rule_of(F.col("_host"), F.col("_path"), rules))
    trees = F.when(F.col("_score") >= threshold, F.lit("block")).otherwise(F.lit("allow"))
    verdict = F.coalesce(verdict_of(F.col("_rule"), rules), trees)
    kept = [F.col("_row").getField(c).alias(c) for c in own]
    return out.select(*kept, F.col("_host").alias("host"), F.col("_path").alias("path"), F.col("_rule").alias("rule"), F.col("_score").alias("score"), verdict.alias("verdict"))
