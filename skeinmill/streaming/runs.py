"""Streams over tables that grow by whole files, run until all that has arrived is done."""

from __future__ import annotations

import contextlib
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession

from skeinmill.runtime import shared_dir

_STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


@contextlib.contextmanager
def keyed_state(spark: SparkSession) -> Iterator[None]:
    """Keyed state in RocksDB, beside the heap and with changes alone in the checkpoint, while a query with
    ``transformWithStateInPandas`` starts."""
    before = {k: spark.conf.get(k, None) for k in _STATE}
    for k, v in _STATE.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def fresh_folder(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/skeinmill/{label}-{uuid.uuid4().hex}"


def arrive(rows: DataFrame, folder: str) -> None:
    """Puts rows among the files that a stream of ``folder`` reads next."""
    rows.write.mode("append").option("compression", "zstd").parquet(folder)


def arrived(spark: SparkSession, folder: str, schema, files_a_batch: int | None = None) -> DataFrame:
    """The stream of a folder's files."""
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", files_a_batch) if files_a_batch else reader).parquet(folder)


def run_to_table(stream: DataFrame, out: str, checkpoint: str, mode: str = "append") -> None:
    """Works off everything that has arrived, adds its rows to the table ``out`` exactly once, and stops."""
    with keyed_state(stream.sparkSession):
        query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
        query.awaitTermination()


def run_batches(stream: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> None:
    """As ``run_to_table`` for a function of (batch, batch id), which has to bear a repeat of its last batch."""
    with keyed_state(stream.sparkSession):
        query = stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
        query.awaitTermination()
