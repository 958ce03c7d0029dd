"""Session and storage helpers shared by all operators.

Intermediate tables that an iterative or multi-pass operator needs are written
as Parquet below the folder that the cluster names in ``spark.checkpoint.dir``.
Such a table cuts lineage, survives the loss of any executor and can be read by
every executor and by the driver.
"""

from __future__ import annotations

import contextlib
import gc
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN_DIRS: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; a temporary one only where that is unset and the master is local."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN_DIRS:
        _OWN_DIRS[app] = tempfile.mkdtemp(prefix="skeinmill-")
        spark.sparkContext.setCheckpointDir(_OWN_DIRS[app])
    return _OWN_DIRS[app]


def hadoop_path(spark: SparkSession, path: str):
    """A path and its file system, as the cluster sees them."""
    jvm = spark.sparkContext._jvm
    found = jvm.org.apache.hadoop.fs.Path(path)
    return found, found.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def settle(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to a fresh table in the shared folder and return it reread; lineage ends there."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/skeinmill/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    written, fs = hadoop_path(spark, path)
    fs.deleteOnExit(written)
    out = spark.read.schema(df.schema).parquet(path)
    out._settled_path = path
    return out


def discard(df: DataFrame) -> None:
    """Delete the table behind a frame that ``settle`` returned, once nothing reads it any more."""
    path = getattr(df, "_settled_path", None)
    if path:
        written, fs = hadoop_path(df.sparkSession, path)
        fs.delete(written, True)


def forget_shuffles(spark: SparkSession) -> None:
    """Have the shuffle files deleted that no frame needs any more: Spark does so as the driver's objects for them are collected, by itself
    only every half hour or as memory runs out."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


_ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


@contextlib.contextmanager
def arrow_batch_rows(spark: SparkSession, rows: int) -> Iterator[None]:
    """Hold Arrow batches to ``rows`` rows while wide binary rows are processed."""
    before = spark.conf.get(_ARROW_ROWS, None)
    spark.conf.set(_ARROW_ROWS, str(rows))
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_ARROW_ROWS)
        else:
            spark.conf.set(_ARROW_ROWS, before)


@contextlib.contextmanager
def text_batches(spark: SparkSession, rows: int = 500) -> Iterator[None]:
    """Keep Arrow batches of whole texts small, unless the session sets a size itself: the default of 10,000 rows holds
    tens of MB on both sides of every task. What runs in Python has to be written (``settle``) inside."""
    if spark.conf.get(_ARROW_ROWS, None) is None:
        with arrow_batch_rows(spark, rows):
            yield
    else:
        yield


def keep_text_batches(spark: SparkSession, rows: int = 500) -> None:
    """``text_batches`` for good, for a job whose frames are written by its caller."""
    if spark.conf.get(_ARROW_ROWS, None) is None:
        spark.conf.set(_ARROW_ROWS, str(rows))


def bounded_sample(df: DataFrame, key: str, rows: int, total: int) -> DataFrame:
    """The ``rows`` rows of ``df`` (which has ``total``) with the smallest hashes of ``key``.

    A threshold on the hash, set so that half as many rows again are expected to
    pass, goes first, so no task sends more than its share of the sample. Where a
    few keys hold most rows the hash is that of whole rows. Either way the sample
    depends on the rows alone, not on their order or place.
    """
    whole = F.xxhash64(*df.columns)
    if total <= 2 * rows:
        return df.orderBy(F.xxhash64(key), key, whole).limit(rows)
    for h in (F.xxhash64(key), whole):
        passing = df.where(F.shiftrightunsigned(h, 11) / float(1 << 53) < 1.5 * rows / total)
        if rows // 2 <= passing.count() <= 4 * rows:
            return passing.orderBy(h, key, whole).limit(rows)
    return df.orderBy(whole).limit(rows)  # a few rows, repeated


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
