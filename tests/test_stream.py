"""Moments held by a stream equal those of the table, late rows included, and models are fitted from them."""

import numpy as np
from pyspark.sql import functions as F

from lacuna.plans import gaussian
from lacuna.streaming import pattern_stream as ps

ENDS = {"a": (-4.0, 4.0), "b": (-4.0, 4.0)}


def test_stream_equals_table_and_refits(spark, tmp_path):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 2))
    x[:, 1] += x[:, 0]
    x[rng.random(x.shape) < 0.2] = np.nan
    rows = [(i, *(None if np.isnan(v) else float(v) for v in r)) for i, r in enumerate(x)]
    t = spark.createDataFrame(rows, "i long, a double, b double").select(F.timestamp_seconds(F.col("i") * 3600 + 1_700_000_000).alias("ts"), "a", "b", "i")
    for part in range(3):  # every window gets rows in several files
        t.filter(F.col("i") % 3 == part).drop("i").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(t.drop("i").schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    seen = []
    q = ps.refitted(stream, ["a", "b"], ENDS, lambda p, n: seen.append((p.n, gaussian.em(p, 50))), late="30 days").option("checkpointLocation", str(tmp_path / "state")).start()
    q.processAllAvailable()
    q.stop()
    assert [n for n, _ in seen] == [100, 200, 300]
    total = None
    for p in ps.moments_of(ps.windowed_moments(t, ["a", "b"], ENDS), ["a", "b"], ENDS).values():
        total = p if total is None else total.merge(p)
    want = gaussian.em(total, 50)
    assert total.n == 300 and np.allclose(seen[-1][1].mu, want.mu, atol=1e-12) and np.allclose(seen[-1][1].sigma, want.sigma, atol=1e-12)
