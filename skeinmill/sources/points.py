"""A keyed table that changes, on plain Parquet: versions of upserts and deletions over a compacted base.

    base/collection=c/            rows of the last compaction, ids unique
    puts/version=n/collection=c/  points written in version n
    marks/version=n/              documents deleted in version n (hard: gone, else marked)
    commits/version=n             empty; a version counts once this is there
    compacted/version=n           all versions up to n are in the base

Writers name their version (a stream its batch id), so a repeated write replaces
its own half-done files and a finished one is left alone. A read merges: of a
point's rows the one of the highest version, without what a later deletion took.
Only the versions since the compaction are grouped; base rows meet their keys in
an anti join, so a read of a large base with few changes does not shuffle it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skeinmill.runtime import discard, hadoop_path, settle, table
from skeinmill.streaming.runs import fresh_folder

KEYS = ["collection", "id"]
_MARKS = "collection string, doc_uuid string, hard boolean"


class PointTable:
    """Points with the columns of ``schema``, which holds collection, id and doc_uuid (strings) and is_deleted (boolean)."""

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType):
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema
        rest = [f for f in schema if f.name != "collection"]
        self._stored = T.StructType([*rest, T.StructField("put_version", T.LongType()), T.StructField("collection", T.StringType())])

    # Files -----------------------------------------------------------------
    def _fs(self, name: str):
        return hadoop_path(self.spark, f"{self.path}/{name}")

    def _numbers(self, name: str) -> list[int]:
        path, fs = self._fs(name)
        return sorted(int(s.getPath().getName().split("=")[1]) for s in fs.listStatus(path)) if fs.exists(path) else []

    def _touch(self, name: str) -> None:
        path, fs = self._fs(name)
        fs.create(path, True).close()

    def _remove(self, name: str) -> None:
        path, fs = self._fs(name)
        fs.delete(path, True)

    def _rows(self, name: str, schema: T.StructType | str) -> DataFrame:
        path, fs = self._fs(name)
        return self.spark.read.schema(schema).parquet(f"{self.path}/{name}") if fs.exists(path) else self.spark.createDataFrame([], schema)

    # Versions --------------------------------------------------------------
    def versions(self) -> list[int]:
        """Committed versions that a read can name: the compacted one and those after it."""
        base = self._base_version()
        return ([base] if base is not None else []) + [v for v in self._numbers("commits") if base is None or v > base]

    def _base_version(self) -> int | None:
        return max(self._numbers("compacted"), default=None)

    def commit(self, version: int, puts: DataFrame | None = None, marks: DataFrame | None = None) -> None:
        """Upserts ``puts`` and deletes the documents in ``marks`` (collection, doc_uuid, hard) as one version.

        Deletions of a version come before its upserts, so a document is replaced by
        a hard mark and its new points together. Of equal keys in ``puts`` the
        largest row stays. A version that is committed or compacted already is left alone.
        """
        base = self._base_version()
        if version in self._numbers("commits") or (base is not None and version <= base):
            return
        if puts is not None:
            own = puts.select([F.col(f"`{f.name}`").cast(f.dataType) for f in self.schema])
            row = F.struct(*[F.col(f"`{c}`") for c in own.columns])
            first = own.withColumn("row", row).groupBy(*KEYS).agg(F.max("row").alias("row")).select("row.*").withColumn("put_version", F.lit(version).cast("long"))
            first.select(self._stored.names).write.mode("overwrite").option("compression", "zstd").partitionBy("collection").parquet(f"{self.path}/puts/version={version}")
        if marks is not None:
            marks.select("collection", "doc_uuid", F.coalesce("hard", F.lit(False)).alias("hard")).write.mode("overwrite").parquet(f"{self.path}/marks/version={version}")
        self._touch(f"commits/version={version}")

    def _merged(self, upto: int | None, collections: list[str] | None) -> DataFrame:
        """The table's rows with put_version; partitions of other collections and versions are not read."""
        base = self._base_version()
        if upto is not None and base is not None and upto < base:
            raise ValueError(f"versions before {base} are compacted")
        seen = [v for v in self._numbers("commits") if upto is None or v <= upto]
        of = F.col("collection").isin(collections) if collections is not None else F.lit(True)
        numbered = T.StructType([*self._stored, T.StructField("version", T.LongType())])
        puts = self._rows("puts", numbered).where(F.col("version").isin(seen) & of).select(self._stored.names)
        row = F.struct(*self._stored.names)
        fresh = puts.groupBy(*KEYS).agg(F.max_by(row, "put_version").alias("row")).select("row.*")
        rows = self._rows("base", self._stored).where(of).select(self._stored.names)
        live = rows.join(puts.select(KEYS).distinct(), KEYS, "left_anti").select(self._stored.names).unionByName(fresh)
        marks = self._rows("marks", f"{_MARKS}, version long").where(F.col("version").isin(seen) & of)
        last = marks.groupBy("collection", "doc_uuid").agg(F.max(F.when(F.col("hard"), F.col("version"))).alias("gone"), F.max("version").alias("marked"))
        joined = live.join(last, ["collection", "doc_uuid"], "left").where(F.col("gone").isNull() | (F.col("gone") <= F.col("put_version")))
        marked = F.coalesce(F.col("marked") > F.col("put_version"), F.lit(False)) | F.coalesce("is_deleted", F.lit(False))
        return joined.withColumn("is_deleted", marked).select(self._stored.names)

    def read(self, as_of: int | None = None, collections: list[str] | None = None) -> DataFrame:
        """All points, those of marked documents with is_deleted, as they were after version ``as_of``."""
        return self._merged(as_of, collections).select(self.schema.names)

    def compact(self) -> None:
        """Rewrites the collections that changed, each as a whole, and drops the versions behind them.

        A run that ends halfway leaves the base old or new by collection and all
        versions in place, which reads the same; the next run finishes it.
        """
        seen = self._numbers("commits")
        if not seen:
            return
        numbered = T.StructType([*self._stored, T.StructField("version", T.LongType())])
        changed = self._rows("puts", numbered).where(F.col("version").isin(seen)).select("collection")
        changed = changed.unionByName(self._rows("marks", f"{_MARKS}, version long").where(F.col("version").isin(seen)).select("collection"))
        names = [r.collection for r in changed.distinct().collect()]  # a row a collection
        if names:
            merged = settle(self._merged(max(seen), names), "points-compacted")
            merged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("collection").parquet(f"{self.path}/base")
            kept = {r.collection for r in merged.select("collection").distinct().collect()}
            for name in names:
                if name not in kept:
                    self._remove(f"base/collection={name}")
            discard(merged)
        self._touch(f"compacted/version={max(seen)}")
        for v in seen:
            for part in ("commits", "puts", "marks"):
                self._remove(f"{part}/version={v}")


# Query -------------------------------------------------------------------------
def _points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A chunk a document, seven documents to a source and remainder."""
    docs = table(spark, sf_dir, "documents")
    return docs.select(
        F.coalesce("source", F.lit("none")).alias("collection"), F.concat(F.lit("p"), "doc_id").alias("id"), F.concat(F.lit("u"), F.col("doc_id") % 50).alias("doc_uuid"),
        F.col("doc_id").alias("chunk_index"), F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("content"), F.lit(False).alias("is_deleted"), "lang",
    )


def point_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, half of them rewritten, some marked, some gone, one replaced by fewer points; a compaction between; every version as it reads."""
    points = _points(spark, sf_dir)
    own = points.drop("lang")
    t = PointTable(spark, fresh_folder(spark, "points"), own.schema)
    doomed = lambda rest, hard: own.where(F.col("chunk_index") % 50 == rest).select("collection", "doc_uuid", F.lit(hard).alias("hard")).distinct()
    t.commit(1, own)
    t.commit(2, own.where("chunk_index % 2 = 0").withColumn("content", F.lit("second")))
    t.commit(3, marks=doomed(3, False))
    early = [settle(t.read(v).withColumn("version", F.lit(v)), "points-read") for v in (1, 2, 3)]
    t.compact()
    t.commit(4, own.where("chunk_index % 100 = 3").withColumn("content", F.lit("back")), doomed(4, True))
    t.commit(5, own.where("chunk_index % 100 = 7").withColumn("content", F.lit("short")), doomed(7, True))
    found = t.read(4).withColumn("version", F.lit(4)).unionByName(t.read().withColumn("version", F.lit(5)))
    for e in early:
        found = found.unionByName(e)
    return found.select("version", "collection", "id", "content", "is_deleted")


_VERSIONS = """WITH p AS (SELECT coalesce(source, 'none') AS collection, 'p' || doc_id AS id, doc_id AS i, md5(coalesce(text, '')) AS one FROM documents),
    v AS (SELECT *, CASE WHEN i % 2 = 0 THEN 'second' ELSE one END AS two FROM p)
    SELECT 1 AS version, collection, id, one AS content, false AS is_deleted FROM v
    UNION ALL SELECT 2, collection, id, two, false FROM v
    UNION ALL SELECT 3, collection, id, two, i % 50 = 3 FROM v
    UNION ALL SELECT 4, collection, id, CASE WHEN i % 100 = 3 THEN 'back' ELSE two END, i % 50 = 3 AND i % 100 <> 3 FROM v WHERE i % 50 <> 4
    UNION ALL SELECT 5, collection, id, CASE WHEN i % 100 = 3 THEN 'back' WHEN i % 100 = 7 THEN 'short' ELSE two END, i % 50 = 3 AND i % 100 <> 3 FROM v WHERE i % 50 <> 4 AND (i % 50 <> 7 OR i % 100 = 7)"""
QUERIES = {"point_versions": (point_versions, _VERSIONS)}
