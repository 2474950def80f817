"""Missingness patterns over a stream: counts and exact sums are additive, so windows aggregate them.

The state of ``windowed_moments`` is one row of sums per window and pattern; late
rows add to their window until the watermark passes it.  ``refitted`` hands the
moments of all windows so far to a function at every trigger: a model is fitted
from state, never from rows.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from lacuna.functions.exprs import mask
from lacuna.plans import patterns
from lacuna.plans.patterns import Digits, Parts, Patterns

#: Bits of the high and low part of a summand: room for 2^30 rows of a window and pattern whose products reach 10,000
#: on the scale of the ends; beyond that the sums fail rather than wrap.
HIGH_BITS, LOW_BITS = 16, 30


def windowed_patterns(stream: DataFrame, columns: list[str], time: str = "ts", window: str = "1 day", late: str = "1 hour") -> DataFrame:
    """(start, pattern, n): pattern counts per time window; works on a stream (with watermark) and on a table."""
    rows = stream.withWatermark(time, late) if stream.isStreaming else stream
    counted = rows.groupBy(F.window(time, window).alias("w"), mask(columns).alias("pattern")).agg(F.count("*").alias("n"))
    return counted.select(F.col("w.start").alias("start"), "pattern", "n")


def windowed_moments(stream: DataFrame, columns: list[str], ends: dict[str, tuple[float, float]], time: str = "ts", window: str = "1 day", late: str = "1 hour") -> DataFrame:
    """(start, mask, n, exact sums): the sufficient statistics of each time window and pattern, for a stream as for a table.

    ``ends`` gives the least and greatest value of each column, as a stream has
    no profile; values beyond them by up to a factor of 100 still add exactly.
    At most ``patterns.NARROW`` columns.
    """
    if len(columns) > patterns.NARROW:
        raise ValueError(f"windows hold the moments of at most {patterns.NARROW} columns")
    rows = stream.withWatermark(time, late) if stream.isStreaming else stream
    rows = rows.withColumn("start", F.window(time, window)["start"])
    mid, half = _middle(columns, ends)
    return patterns._narrow_sums(rows, columns, ("start",), mid, half, _digits())


def _middle(columns: list[str], ends: dict[str, tuple[float, float]]) -> tuple[np.ndarray, np.ndarray]:
    lo, hi = (np.array([float(ends[c][k]) for c in columns]) for k in (0, 1))
    if not (lo < hi).all():
        raise ValueError("ends must be a least and a greater value for every column")
    return (lo + hi) / 2, (hi - lo) / 2


def _digits() -> Digits:
    return Digits((HIGH_BITS, LOW_BITS), (HIGH_BITS, LOW_BITS))


def moments_of(rows: DataFrame, columns: list[str], ends: dict[str, tuple[float, float]]) -> dict[object, Patterns]:
    """The pattern blocks of each window from rows of ``windowed_moments``, at center 0 and scale 1 of the moved values' middle and half range."""
    mid, half = _middle(columns, ends)
    parts = Parts(np.zeros(len(columns)), np.ones(len(columns)), _digits())
    out: dict[object, Patterns] = {}
    for (group, pattern), sums in patterns._collected(rows, columns, ("start",), False).items():
        out.setdefault(group[0], Patterns(columns, mid, half, {})).blocks[pattern] = parts.standard(pattern, *sums)
    return out


def refitted(stream: DataFrame, columns: list[str], ends: dict[str, tuple[float, float]], fit: Callable[[Patterns, int], None], **windows) -> DataStreamWriter:
    """A stream that calls ``fit(all windows' moments, batch)`` after every trigger that changes them; start it to run.

    A trigger sends the windows that changed; the driver holds a block per window and pattern.
    """
    known: dict[object, Patterns] = {}

    def step(batch: DataFrame, number: int) -> None:
        changed = moments_of(batch, columns, ends)
        if not changed:  # a trigger that only moves the watermark
            return
        for start, p in changed.items():  # a changed window comes with the patterns that changed
            known[start] = Patterns(p.columns, p.center, p.scale, {**(known[start].blocks if start in known else {}), **p.blocks})
        total = None
        for _, p in sorted(known.items(), key=lambda x: str(x[0])):
            total = p if total is None else total.merge(p)
        fit(total, number)

    return windowed_moments(stream, columns, ends, **windows).writeStream.outputMode("update").foreachBatch(step)
