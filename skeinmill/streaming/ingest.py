"""Incremental ingest: sources arrive in batches, and each goes on from the stage that it has reached.

    raw -> markdown -> chunk -> vectorized

Every batch plans by the log of the batches before it: a source whose content is
known (same etag, or same size where one lacks it) goes on after its best stage,
one that is done is left out, any other starts anew. Each stage writes a table of
its own for the batch, then its log entries; a batch that is run again after a
failure finds its finished stages and goes on behind them, so no stage is done
twice and none is lost. What a stage fails to give stays logged at the stage
before and is tried again when the source next arrives. Texts are read from the
batch, plans hold none, and of a finished batch only the Markdown that gave no
chunks is kept besides its points and log.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skeinmill.operators.answers import payload
from skeinmill.operators.ingest import STAGE_RANK, best_record
from skeinmill.runtime import hadoop_path, table
from skeinmill.sources.points import PointTable
from skeinmill.streaming.runs import arrive, arrived, fresh_folder, run_batches

SOURCE = "key string, collection string, etag string, size long, text string"
_LOG = "key string, etag string, stage string, pos long"
_MARKDOWN, _CHUNKS = "key string, collection string, etag string, markdown string", "key string, collection string, etag string, chunks array<string>"
POINT = "collection string, id string, doc_uuid string, chunk_index int, content string, token_count int, tenant_id string, is_deleted boolean"


def known_etag(etag, size):
    """What identifies a content: the etag without quotes and case, or the size where there is none."""
    bare = F.lower(F.btrim(F.coalesce(etag, F.lit("")), F.lit('"')))
    return F.when(bare != "", bare).otherwise(F.concat(F.lit("size:"), F.coalesce(size.cast("string"), F.lit("?"))))


class Ingest:
    """``convert`` makes Markdown of a source's text, ``chunk`` an array of chunks of Markdown (columns to columns; null is a failure).

    ``before`` is called with each stage's name and the batch id before its work, which tests use to fail there.
    """

    def __init__(self, spark: SparkSession, root: str, points: PointTable, convert: Callable, chunk: Callable, before: Callable[[str, int], None] | None = None):
        self.spark, self.root, self.points = spark, root.rstrip("/"), points
        self.convert, self.chunk, self.before = convert, chunk, before or (lambda stage, batch: None)

    def _has(self, name: str) -> bool:
        path, fs = hadoop_path(self.spark, f"{self.root}/{name}")
        return fs.exists(path)

    def _read(self, name: str, schema: str) -> DataFrame:
        """A stage's table with the batch that wrote each row."""
        schema = f"{schema}, batch long"
        return self.spark.read.schema(schema).parquet(f"{self.root}/{name}") if self._has(name) else self.spark.createDataFrame([], schema)

    def _once(self, name: str, batch: int, rows: Callable[[], DataFrame]) -> None:
        """Writes a stage's table of this batch unless it is whole already."""
        if not self._has(f"{name}/batch={batch}/_SUCCESS"):
            rows().write.mode("overwrite").option("compression", "zstd").parquet(f"{self.root}/{name}/batch={batch}")

    def _log(self, stage: str, batch: int, rows: Callable[[], DataFrame]) -> None:
        pos = F.lit(batch * 10 + STAGE_RANK[stage]).cast("long")
        self._once(f"log-{stage}", batch, lambda: rows().select("key", "etag", F.lit(stage).alias("stage"), pos.alias("pos")))

    def log(self, before: int | None = None) -> DataFrame:
        parts = [self._read(f"log-{stage}", _LOG) for stage in STAGE_RANK]
        whole = reduce(DataFrame.unionByName, parts)
        return (whole.where(F.col("batch") < before) if before is not None else whole).drop("batch")

    def records(self) -> DataFrame:
        """The best record of every source: key, etag, stage."""
        return best_record(self.log()).drop("pos")

    def _own(self, batch: DataFrame, *rest: str) -> DataFrame:
        """The batch's sources, each once: key, etag, collection and ``rest``, of its largest row."""
        own = batch.withColumn("etag", known_etag(F.col("etag"), F.col("size"))).where("key IS NOT NULL")
        return own.groupBy("key").agg(F.max(F.struct("etag", "collection", *rest)).alias("r")).select("key", "r.*")

    def _plan(self, batch: DataFrame, n: int) -> DataFrame:
        """The batch's sources with the stage that they go on from; only the log entries of their keys are read together."""
        own = self._own(batch)
        past = best_record(self.log(n).join(own.select("key"), "key", "left_semi")).select("key", F.col("etag").alias("old"), F.col("stage").alias("reached"))
        reached = F.when(F.col("old") == F.col("etag"), F.col("reached")).otherwise("raw")
        return own.join(past, "key", "left").withColumn("reached", F.coalesce(reached, F.lit("raw"))).select("key", "collection", "etag", "reached")

    def _earlier(self, name: str, schema: str, plan: DataFrame, reached: str, n: int) -> DataFrame:
        """What earlier batches made of the sources that go on from ``reached``, in whole tables or those of finished batches."""
        wanted = plan.where(F.col("reached") == reached).select("key", "etag")
        past = self._read(name, schema).unionByName(self._read(f"{name}-open", schema))
        past = past.where(F.col("batch") < n).join(wanted, ["key", "etag"], "left_semi")
        return past.groupBy("key").agg(F.max_by(F.struct(*[c for c in past.columns if c != "key"]), "batch").alias("r")).select("key", "r.*").drop("batch")

    def _finish(self, n: int) -> None:
        """Removes a finished batch's tables that no later batch reads."""
        for name in ("plan", "markdown", "chunks"):
            path, fs = hadoop_path(self.spark, f"{self.root}/{name}/batch={n}")
            fs.delete(path, True)

    def process(self, batch: DataFrame, n: int) -> None:
        if self._has(f"log-vectorized/batch={n}/_SUCCESS"):  # the log's last table
            return self._finish(n)
        self._once("plan", n, lambda: self._plan(batch, n))
        plan = self.spark.read.parquet(f"{self.root}/plan/batch={n}")
        made = lambda name, schema: self.spark.read.schema(schema).parquet(f"{self.root}/{name}/batch={n}")

        self.before("markdown", n)
        fresh = lambda: self._own(batch, "text").join(plan.where("reached = 'raw'").select("key"), "key", "left_semi")
        self._once("markdown", n, lambda: fresh().withColumn("markdown", self.convert(F.col("text"))).select("key", "collection", "etag", "markdown"))
        done = made("markdown", _MARKDOWN)
        self._log("raw", n, lambda: done.where("markdown IS NULL"))
        self._log("markdown", n, lambda: done.where("markdown IS NOT NULL"))

        self.before("chunk", n)
        ready = done.where("markdown IS NOT NULL").unionByName(self._earlier("markdown", _MARKDOWN, plan, "markdown", n))
        self._once("chunks", n, lambda: ready.withColumn("chunks", self.chunk(F.col("markdown"))).select("key", "collection", "etag", "chunks"))
        cut = made("chunks", _CHUNKS).where("chunks IS NOT NULL")
        self._log("chunk", n, lambda: cut)

        self.before("vectorized", n)
        ready = cut.unionByName(self._earlier("chunks", _CHUNKS, plan, "chunk", n))
        rows = ready.select("collection", F.col("key").alias("doc_uuid"), F.posexplode("chunks").alias("chunk_index", "text"))
        self.points.commit(n + 1, payload(rows, carried=("collection",)))
        self._once("markdown-open", n, lambda: done.where("markdown IS NOT NULL").join(cut.select("key"), "key", "left_anti").select("key", "collection", "etag", "markdown"))
        self._log("vectorized", n, lambda: ready)
        self._finish(n)

    def run(self, sources: DataFrame, checkpoint: str) -> None:
        """Works off all batches of the stream ``sources`` (``SOURCE``) that have arrived."""
        run_batches(sources, self.process, checkpoint)


# Query -------------------------------------------------------------------------
def trimmed(text):
    """Markdown of plain text: without blank ends; blank text is a failure."""
    return F.nullif(F.btrim(text, F.lit(" \t\r\n")), F.lit(""))


def lines(markdown):
    return F.filter(F.split(markdown, "\n"), lambda x: F.btrim(x) != "")


def document_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select(
        F.concat(F.lit("doc/"), "doc_id").alias("key"), F.coalesce("source", F.lit("none")).alias("collection"), F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("etag"),
        F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("size"), "text", "doc_id",
    )


def ingest_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two thirds of the documents arrive, then all, every fifth with another line at its end."""
    docs = document_sources(spark, sf_dir)
    root, source, checkpoint = (fresh_folder(spark, f"ingest-{x}") for x in ("root", "in", "checkpoint"))
    points = PointTable(spark, f"{root}/points", spark.createDataFrame([], POINT).schema)
    job = Ingest(spark, root, points, trimmed, lines)
    arrive(docs.where("doc_id % 3 <> 2").drop("doc_id"), source)
    job.run(arrived(spark, source, SOURCE), checkpoint)
    more = F.when(F.col("doc_id") % 5 == 0, F.concat(F.col("text"), F.lit("\nlater line"))).otherwise(F.col("text"))
    again = docs.withColumn("text", more).withColumn("etag", F.md5(F.coalesce("text", F.lit("")).cast("binary")))
    arrive(again.drop("doc_id"), source)
    job.run(arrived(spark, source, SOURCE), checkpoint)
    whole = points.read().groupBy(F.col("doc_uuid").alias("key")).agg(F.count("*").alias("n_points"), F.md5(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk_index", "content"))), lambda x: x["content"]), "\n").cast("binary")).alias("content_md5"))
    written = reduce(DataFrame.unionByName, [job._read(f"log-{s}", _LOG) for s in STAGE_RANK]).groupBy("key").agg(F.count_if(F.col("stage") == "vectorized").alias("runs"))
    return job.records().join(written, "key").join(whole, "key", "left").select("key", "etag", "stage", "runs", "n_points", "content_md5")


_INGEST = r"""WITH d AS (SELECT 'doc/' || doc_id AS key, doc_id, text, CASE WHEN doc_id % 5 = 0 THEN text || chr(10) || 'later line' ELSE text END AS last FROM documents),
    l AS (SELECT *, md5(coalesce(text, '')) AS e1, md5(coalesce(last, '')) AS e2, trim(coalesce(text, ''), ' ' || chr(9) || chr(13) || chr(10)) AS m1, trim(coalesce(last, ''), ' ' || chr(9) || chr(13) || chr(10)) AS m2 FROM d),
    c AS (SELECT *, list_filter(string_split(m2, chr(10)), lambda x: trim(x) <> '') AS cs FROM l)
    SELECT key, e2 AS etag, CASE WHEN m2 = '' THEN 'raw' ELSE 'vectorized' END AS stage,
      (CASE WHEN doc_id % 3 <> 2 AND m1 <> '' THEN 1 ELSE 0 END + CASE WHEN m2 <> '' AND (doc_id % 3 = 2 OR e1 <> e2 OR m1 = '') THEN 1 ELSE 0 END)::BIGINT AS runs,
      CASE WHEN m2 <> '' THEN len(cs) END::BIGINT AS n_points, CASE WHEN m2 <> '' THEN md5(array_to_string(cs, chr(10))) END AS content_md5 FROM c"""
QUERIES = {"ingest_stream": (ingest_stream, _INGEST)}
