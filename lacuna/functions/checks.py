"""Refusals: what an input table, a parameter or a chosen option must be like.

Every estimator goes through ``validate`` and ``check_parameters``; the data are
looked at in one aggregation.
"""

from __future__ import annotations

import functools
import math
import numbers
import warnings
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NUMERIC = ("tinyint", "smallint", "int", "bigint", "float", "double", "decimal", "boolean")


class EmptyFeatureError(ValueError):
    """A feature without any observed value."""


class NotFittedError(ValueError):
    """A prediction was asked for before the fit."""


def _number(value) -> bool:
    return isinstance(value, numbers.Real) and not isinstance(value, bool)


def check_penalty(value, name: str = "alpha", owner: str = "estimator") -> float:
    """A finite number that is not negative."""
    if not _number(value) or not math.isfinite(value) or value < 0:
        raise ValueError(f"{owner}: {name} must be a finite number >= 0, got {value!r}")
    return float(value)


def check_positive_int(value, name: str, owner: str = "estimator", minimum: int = 1) -> int:
    """A whole number of at least ``minimum``."""
    if not _number(value) or not math.isfinite(value) or value != int(value) or value < minimum:
        raise ValueError(f"{owner}: {name} must be a whole number >= {minimum}, got {value!r}")
    return int(value)


def check_positive_float(value, name: str, owner: str = "estimator") -> float:
    """A finite number above 0."""
    if not _number(value) or not math.isfinite(value) or value <= 0:
        raise ValueError(f"{owner}: {name} must be a finite number > 0, got {value!r}")
    return float(value)


def check_tolerance(value, name: str = "tol", owner: str = "estimator") -> float:
    return check_positive_float(value, name, owner)


def check_choice(value, options, name: str, owner: str = "estimator"):
    """One of the documented options; a difference in case alone is pointed out."""
    if value in options:
        return value
    near = [o for o in options if isinstance(o, str) and isinstance(value, str) and o.lower() == value.lower()]
    hint = f"; did you mean {near[0]!r}?" if near else ""
    raise ValueError(f"{owner}: {name} must be one of {', '.join(map(repr, options))}, got {value!r}{hint}")


def check_copula(value, owner: str = "estimator"):
    if not (value is True or value is False or value == "auto"):
        raise ValueError(f"{owner}: copula must be True, False or 'auto', got {value!r}")
    return value


#: parameter -> its check, applied wherever an estimator has the parameter.
COMMON: dict[str, Callable] = {
    "alpha": check_penalty, "l1": check_penalty, "l2": check_penalty, "ridge": check_penalty, "smoothing": check_penalty,
    "tol": check_tolerance, "c": check_positive_float, "epsilon": check_penalty,
    "k": check_positive_int, "members": check_positive_int, "steps": check_positive_int, "imputations": check_positive_int, "folds": check_positive_int,
}


def public_name(parameters: dict, *candidates: str) -> str:
    """The first candidate that is a parameter, for messages in the caller's words."""
    return next((c for c in candidates if c in parameters), candidates[0])


def check_parameters(parameters: dict, owner: str = "estimator") -> None:
    """Applies the check of every common parameter that is present."""
    for name, value in parameters.items():
        if name == "copula":
            check_copula(value, owner)
        elif name in COMMON and value is not None:
            if COMMON[name] is check_positive_int:
                check_positive_int(value, name, owner)
            else:
                COMMON[name](value, name, owner)


def check_features(columns: list[str], features: list[str], fitted: list[str] | None = None, owner: str = "estimator") -> None:
    """The features must be in the table, and be those of the fit in any order."""
    if fitted is not None and len(features) != len(fitted):
        raise ValueError(f"{owner}: {len(features)} features, but the fit had {len(fitted)}")
    if fitted is not None and set(features) != set(fitted):
        unknown, lacking = sorted(set(features) - set(fitted)), sorted(set(fitted) - set(features))
        raise ValueError(f"{owner}: features differ from the fit's; unexpected: {', '.join(unknown) or '-'}, missing: {', '.join(lacking) or '-'}")
    missing = [c for c in features if c not in columns]
    if missing:
        raise ValueError(f"{owner}: features not in the table: {', '.join(missing)}")


def input_profile(df: DataFrame, features: list[str], label: str | None = None) -> DataFrame:
    """One row per column: rows, observed, infinite and fractional values, distinct values up to a bound."""
    kinds = dict(df.dtypes)
    parts = []
    for c in [*features, *([label] if label else [])]:
        number = kinds[c].startswith(NUMERIC)
        x = F.col(c).cast("double") if number else F.lit(None).cast("double")
        seen = F.col(c).isNotNull() & ~F.isnan(x) if kinds[c] in ("float", "double") else F.col(c).isNotNull()
        parts.append(F.struct(
            F.lit(c).alias("column"), F.count("*").alias("rows"), F.count(F.when(seen, 1)).alias("observed"),
            F.count(F.when(F.abs(x) == float("inf"), 1)).alias("infinite"), F.count(F.when(seen & (x != F.floor(x)), 1)).alias("fractional"),
            F.approx_count_distinct(F.when(seen, F.col(c))).alias("distinct"),
        ))
    return df.agg(F.array(*parts).alias("p")).select(F.explode("p").alias("c")).select("c.*")


def rules(profile: DataFrame, label: str | None = None, classifier: bool = False, min_rows: int = 2) -> DataFrame:
    """(column, rule) of every rule that an input profile breaks."""
    broken = F.array(
        F.when(F.col("rows") < min_rows, "too few rows"),
        F.when((F.col("rows") > 0) & (F.col("observed") == 0) & (F.col("column") != F.lit(label or "")), "empty feature"),
        F.when((F.col("rows") > 0) & (F.col("observed") == 0) & (F.col("column") == F.lit(label or "")), "empty label"),
        F.when(F.col("infinite") > 0, "infinite values"),
        F.when(F.lit(classifier) & (F.col("column") == F.lit(label or "")) & (F.col("fractional") > 0), "continuous label"),
    )
    return profile.select("column", F.explode(F.filter(broken, lambda r: r.isNotNull())).alias("rule"))


def validate(df: DataFrame, features: list[str], label: str | None = None, classifier: bool = False, min_rows: int = 2, owner: str = "estimator") -> None:
    """Refuses what no estimator can take; missing cells are fine, infinite ones are not."""
    if not features:
        raise ValueError(f"{owner}: at least one feature is required")
    if len(set(features)) < len(features) or label in features:
        raise ValueError(f"{owner}: a column is named twice among the features and the label")
    check_features(df.columns, [*features, *([label] if label else [])], owner=owner)
    kinds = dict(df.dtypes)
    odd = [c for c in features if not kinds[c].startswith(NUMERIC)]
    if odd:
        raise TypeError(f"{owner}: features must be plain numeric columns, not {', '.join(f'{c} ({kinds[c]})' for c in odd)}")
    found = [(r["column"], r["rule"]) for r in rules(input_profile(df, features, label), label, classifier, min_rows).collect()]
    empty = [c for c, rule in found if rule == "empty feature"]
    if any(rule == "too few rows" for _, rule in found):
        raise ValueError(f"{owner}: at least {min_rows} rows are required")
    if empty:
        raise EmptyFeatureError(f"{owner}: no observed value in {', '.join(empty)}")
    for c, rule in found:
        if rule == "empty label":
            raise ValueError(f"{owner}: {c} has no observed outcome")
        if rule == "infinite values":
            raise ValueError(f"{owner}: {c} contains infinite values")
        if rule == "continuous label":
            raise ValueError(f"{owner}: {c} looks continuous, but a classifier needs classes")


def copula_configured(estimator) -> bool:
    """Whether an estimator, or one nested in it, is set to use a copula."""
    parameters = getattr(estimator, "parameters", {})
    if parameters.get("copula") in (True, "auto"):
        return True
    return any(copula_configured(v) for v in [getattr(estimator, "inner", None), *parameters.values()] if hasattr(v, "parameters"))


def only_for(task: str):
    """A method that exists only on estimators resolved to ``task``."""

    def wrap(f):
        @functools.wraps(f)
        def run(self, *args, **kwargs):
            if getattr(self, "task", None) != task:
                raise AttributeError(f"{f.__name__} is only available for {task}, this estimator is for {getattr(self, 'task', None)}")
            return f(self, *args, **kwargs)

        return run

    return wrap


def deprecated(replacement: str | None = None, removed_in: str | None = None, extra: str = ""):
    """Marks a function that warns when it is called."""

    def wrap(f):
        text = f"{f.__name__} is deprecated" + (f", use {replacement}" if replacement else "") + (f"; it goes in {removed_in}" if removed_in else "") + (f". {extra}" if extra else "")

        @functools.wraps(f)
        def run(*args, **kwargs):
            warnings.warn(text, FutureWarning, stacklevel=2)
            return f(*args, **kwargs)

        return run

    return wrap


def deprecate_parameter(name: str, replacement: str | None = None, removed_in: str | None = None):
    """Marks a keyword that warns only when it is passed; its value goes to the replacement."""

    def wrap(f):
        @functools.wraps(f)
        def run(*args, **kwargs):
            if name in kwargs:
                warnings.warn(f"parameter {name} of {f.__name__} is deprecated" + (f", use {replacement}" if replacement else "") + (f"; it goes in {removed_in}" if removed_in else ""), FutureWarning, stacklevel=2)
                value = kwargs.pop(name)
                if replacement:
                    kwargs.setdefault(replacement, value)
            return f(*args, **kwargs)

        return run

    return wrap
