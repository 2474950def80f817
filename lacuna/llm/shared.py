"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import atexit
import ctypes
import gc
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are maximal runs of anything but ASCII white space.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()

_written: list[tuple[SparkSession, str]] = []
_tables: dict[str, tuple[SparkSession, str]] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    It is the session's ``spark.checkpoint.dir``; only where that is unset on a
    single machine, as in tests, a temporary folder becomes the checkpoint
    folder.  A cluster without the setting is refused: each executor would write
    to a disk of its own.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        own = spark.sparkContext._jsc.sc().getCheckpointDir()
        path = own.get() if own.isDefined() else None
    if not path and not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not path:
        path = "file://" + tempfile.mkdtemp(prefix="lacuna-shared-")
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


def materialise(df: DataFrame) -> DataFrame:
    """Writes ``df`` as Parquet into the shared folder and reads it back.

    Cuts the lineage with files that outlive any executor; the table is removed
    by ``release`` or when the driver ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/lacuna-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, key: str, buckets: int) -> tuple[str, DataFrame]:
    """Writes ``df`` into the shared folder as a table in buckets of ``key``: (name for ``discard``, table).

    Tables with the same key and number of buckets join on it without a shuffle.
    """
    spark = df.sparkSession
    name = f"lacuna_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/{name}"
    _tables[name] = spark, path
    df.write.bucketBy(buckets, key).option("path", path).saveAsTable(name)
    return name, spark.table(name)


def discard(name: str) -> None:
    """Removes a table of ``bucketed`` and its files."""
    spark, path = _tables.pop(name)
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    _remove(spark, path)


def _remove(spark: SparkSession, path: str) -> None:
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jvm_path, True)


def release() -> None:
    """Removes every table that ``materialise`` and ``bucketed`` wrote; results not yet read are lost."""
    while _written or _tables:
        try:
            if _tables:
                discard(next(iter(_tables)))
            else:
                _remove(*_written.pop())
        except Exception:  # the session has ended; its folder goes with the cluster's
            return


atexit.register(release)


def sweep(spark: SparkSession) -> None:
    """Lets Spark remove the shuffle files of steps whose results are written; otherwise they stay until the driver happens to collect its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


#: Rows and bytes of an Arrow batch, where the session does not say otherwise.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000", "spark.sql.execution.arrow.maxBytesPerBatch": str(16 << 20)}
_batched: set[str] = set()


def small_batches(spark: SparkSession) -> None:
    """Bounds the Arrow batches of a session once, so that long texts do not pile up in a Python worker."""
    if spark.sparkContext.applicationId not in _batched:
        _batched.add(spark.sparkContext.applicationId)
        given = dict(spark.sparkContext.getConf().getAll())
        for key, value in BATCH.items():
            if key not in given:
                spark.conf.set(key, value)


@contextmanager
def batches_of(spark: SparkSession, size: int) -> Iterator[None]:
    """Arrow batches end after ``size`` bytes for what runs within, unless the session was given a bound of its own."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    own = key in dict(spark.sparkContext.getConf().getAll())
    try:
        if not own:
            spark.conf.set(key, str(size))
        yield
    finally:
        if not own:
            spark.conf.set(key, before)


def tidied(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """``run``, which gives the memory it freed back to the system at the end of its partition.

    Python workers are used again by later stages; what one keeps, the next lacks.
    """

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL("libc.so.6").malloc_trim(0)
        except (OSError, AttributeError):  # another C library; nothing to give back
            return

    return wrapped


def ascii_lower(col: Column) -> Column:
    """Lower-cases A-Z alone, whatever the locale."""
    return F.translate(col, UPPER, LOWER)


def word_count(col: Column) -> Column:
    """Number of words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(col, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
