"""Stored files and logs: listing, pruning, line and chunk loaders, JSON-line logs, attachment candidates, time ranges."""

from __future__ import annotations

import datetime as dt
import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from skeinmill.functions.text import stripped

# Kinds of files that are taken in, where linked documents are, characters that no file name may hold.
SUPPORTED = ("pdf", "docx", "pptx", "ppt", "xlsx", "xls", "png", "jpg", "jpeg", "tif", "tiff", "bmp", "webp", "json", "md", "markdown", "txt")
OWN_PREFIXES = ("markdown/", "chunks/", "logs/")
LINKED = {"docx": ("docx", "docx"), "docs": ("doc", "docx"), "sheets": ("sheet", "xlsx"), "base": ("bitable", "xlsx"), "bitable": ("bitable", "xlsx"), "wiki": ("wiki", "docx")}
KEYS = {"file_key": "file", "fileKey": "file", "image_key": "image", "imageKey": "image"}
ILLEGAL = r'[<>:"/\\|?*\x00-\x1f]'
URL = re.compile(r"https?://[^\s\"'<>\]\)，。；、]+")


def list_files(spark: SparkSession, path: str) -> DataFrame:
    """path, modificationTime and length of all files below ``path``; contents are not read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "modificationTime", "length")


def read_files(spark: SparkSession, path: str, extensions: tuple[str, ...] = SUPPORTED) -> DataFrame:
    """key and content of the files of these kinds below ``path``, for ``convert_files``."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{" + ",".join(extensions) + "}").load(path)
    return files.select(F.col("path").alias("key"), "content")


def is_source_key(key: Column, own_prefixes: tuple[str, ...] = OWN_PREFIXES, extensions: tuple[str, ...] | None = SUPPORTED) -> Column:
    """Not empty, no folder, not below this engine's own prefixes and, unless ``extensions`` is None, of a known kind."""
    wanted = (F.coalesce(key, F.lit("")) != "") & ~key.endswith("/")
    for prefix in own_prefixes:
        wanted = wanted & ~key.startswith(prefix)
    if extensions is not None:
        wanted = wanted & F.lower(F.regexp_extract(key, r"[^/.][^/]*\.([^./]+)$", 1)).isin(*extensions)
    return F.coalesce(wanted, F.lit(False))


class FileStore:
    """Bytes by path in any store that Hadoop's file systems reach."""

    def __init__(self, spark: SparkSession):
        self._jvm, self._conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()

    def _at(self, path: str):
        place = self._jvm.org.apache.hadoop.fs.Path(path)
        return place, place.getFileSystem(self._conf)

    def put(self, path: str, content: bytes) -> None:
        place, fs = self._at(path)
        out = fs.create(place, True)
        try:
            out.write(content)
        finally:
            out.close()

    def get(self, path: str) -> bytes:
        place, fs = self._at(path)
        stream = fs.open(place)
        try:
            return bytes(stream.readAllBytes())
        finally:
            stream.close()

    def stat(self, path: str) -> dict | None:
        place, fs = self._at(path)
        if not fs.exists(place):
            return None
        found = fs.getFileStatus(place)
        return {"path": path, "length": found.getLen(), "modified_ms": found.getModificationTime()}

    def delete(self, paths: list[str], at_once: int = 1000) -> int:
        """Number of the files that were there; they go in runs of at most ``at_once``."""
        gone = 0
        for start in range(0, len(paths), at_once):
            for path in paths[start : start + at_once]:
                place, fs = self._at(path)
                gone += bool(fs.exists(place) and fs.delete(place, True))
        return gone


def upload_keys(files: DataFrame, root: str, prefix: str) -> DataFrame:
    """``files`` (path) with the key that each has below ``prefix``: its place under ``root``."""
    inner = F.regexp_replace("path", "^(?:file:)?/*" + re.escape(root.strip("/")) + "/+", "")
    return files.withColumn("key", F.concat_ws("/", F.lit(prefix.strip("/")), inner))


def safe_filename(name: Column, longest: int = 180) -> Column:
    """Illegal characters as ``_``, blanks and dots off the ends, at most ``longest`` characters; never empty."""
    clean = F.substring(F.btrim(F.regexp_replace(name, ILLEGAL, "_"), F.lit(" .")), 1, longest)
    return F.coalesce(F.nullif(clean, F.lit("")), F.lit("download"))


def path_part(name: Column) -> Column:
    bare = F.btrim(F.btrim(F.coalesce(name, F.lit("")), F.lit(" \t\r\n")), F.lit("/\\"))
    return F.coalesce(F.nullif(F.regexp_replace(bare, r'[<>:"\\|?*\x00]', "_"), F.lit("")), F.lit("unknown"))


def append_jsonl(rows: DataFrame, path: str) -> None:
    """Rows as JSON lines in further files below ``path``."""
    rows.write.mode("append").json(path)


def stream_jsonl(rows: DataFrame, path: str, checkpoint: str):
    """A stream's rows, once each, as JSON lines below ``path``."""
    return rows.writeStream.format("json").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").start()


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of JSON lines; blank lines and those that are no JSON of the schema are left out."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def numbered_lines(spark: SparkSession, path: str, names: str = "*") -> DataFrame:
    """file, line_no (from 1) and line of the files below ``path`` whose names match; large files are read by many tasks.

    A line's number is its rank in its byte range and the lines of the file's
    ranges before; a task sorts one range at most, and only counts go further.
    """
    read = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", names).text(path)
    lines = read.select("_metadata.file_path", "_metadata.file_name", F.col("_metadata.file_block_start").alias("start"), "value", F.monotonically_increasing_id().alias("at"))
    place = ["file_path", "start"]
    ranked = lines.withColumn("n", F.row_number().over(W.partitionBy(*place).orderBy("at")))
    ranges = lines.groupBy(*place).agg(F.count("*").alias("many"))
    before = F.sum("many").over(W.partitionBy("file_path").orderBy("start").rowsBetween(W.unboundedPreceding, -1))  # a row a range
    starts = ranges.withColumn("before", F.coalesce(before, F.lit(0))).drop("many")
    return ranked.join(starts, place).select(F.col("file_name").alias("file"), (F.col("before") + F.col("n")).alias("line_no"), F.col("value").alias("line"))


def load_line_documents(spark: SparkSession, path: str) -> DataFrame:
    """doc_id and text of JSON lines (``.jsonl``) and of whole ``.txt`` files below ``path``.

    Lines count without the white space at their ends. Of equal ones, by MD5, the
    first by file and line counts, and a text file that equals a line or an
    earlier text file, white space included, is left out. A line without ``id`` is
    named after its place; one whose id is null, empty, zero or false, one that is
    no JSON object, and a blank one are left out.
    """
    digest = lambda c: F.md5(c.cast("binary"))
    lines = numbered_lines(spark, path, "*.jsonl").withColumn("line", stripped(F.col("line"))).where("line <> ''")
    lines = lines.select(digest(F.col("line")).alias("h"), F.lit(0).alias("kind"), "file", F.col("line_no").cast("long").alias("line_no"), "line")
    whole = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.txt").text(path, wholetext=True)
    text = F.regexp_replace("value", "\r\n?", "\n")
    whole = whole.select(digest(text).alias("h"), F.lit(1).alias("kind"), F.col("_metadata.file_name").alias("file"), F.lit(0).cast("long").alias("line_no"), text.alias("line"))
    first = lines.unionByName(whole).groupBy("h").agg(F.min(F.struct("kind", "file", "line_no", "line")).alias("x")).select("x.*")
    row = first.withColumn("v", F.when(F.col("kind") == 0, F.try_parse_json("line")))
    held = F.try_variant_get("v", "$.id", "string")
    given = F.expr("try_variant_get(v, '$.id', 'variant')")
    falsy = F.schema_of_variant(given).isin("VOID", "BOOLEAN") & (F.coalesce(held, F.lit("false")) == "false") | (held == "") | (F.schema_of_variant(given).rlike("^(BIGINT|DECIMAL|DOUBLE)") & (held.try_cast("double") == 0))
    name = F.when(given.isNull(), F.concat(F.col("file"), F.lit("_line"), F.col("line_no").cast("string"))).when(~F.coalesce(falsy, F.lit(False)), held)
    own = F.when(F.col("kind") == 1, F.col("file")).when(F.schema_of_variant("v").startswith("OBJECT"), name)
    said = F.when(F.col("kind") == 1, stripped(F.col("line"))).otherwise(F.coalesce(F.try_variant_get("v", "$.text", "string"), F.lit("")))
    return row.select(own.alias("doc_id"), said.alias("text")).where("doc_id IS NOT NULL")


def load_test_set(spark: SparkSession, path: str) -> DataFrame:
    """question, ground_truth, expected_sources of a JSON-line test set; a line without question or truth is an error that
    names it, and so is an empty set."""
    lines = numbered_lines(spark, path).where(F.trim("line") != "")
    rows = lines.select("file", "line_no", F.from_json("line", "question string, ground_truth string, expected_sources array<string>").alias("r")).select("file", "line_no", "r.*")
    blank = lambda c: F.trim(F.coalesce(c, F.lit(""))) == ""
    bad = rows.where(blank("question") | blank("ground_truth")).orderBy("file", "line_no").limit(1).collect()
    if bad:
        raise ValueError(f"{bad[0].file}, line {bad[0].line_no}: question and ground_truth are required")
    if rows.isEmpty():
        raise ValueError("the test set is empty")
    return rows.select("question", "ground_truth", F.coalesce("expected_sources", F.array().cast("array<string>")).alias("expected_sources"))


def load_chunk_files(spark: SparkSession, path: str) -> DataFrame:
    """doc_uuid, chunk_index, text and title of all chunk files (one JSON object with ``chunks``) below ``path``."""
    schema = "doc_uuid string, chunks array<struct<index:int,text:string,title:string>>"
    files = spark.read.schema(schema).option("multiLine", "true").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json").json(path)
    return files.select("doc_uuid", F.explode("chunks").alias("c")).select("doc_uuid", F.col("c.index").alias("chunk_index"), "c.text", "c.title")


def create_points_table(spark: SparkSession, name: str) -> None:
    """The table of points, parted by collection."""
    spark.sql(f"""CREATE TABLE IF NOT EXISTS {name} (id STRING, doc_uuid STRING, chunk_index INT, content STRING, title STRING, breadcrumb STRING, filename STRING,
        doc_type STRING, tenant_id STRING, tags ARRAY<STRING>, is_deleted BOOLEAN, embedding ARRAY<FLOAT>, collection STRING) USING parquet PARTITIONED BY (collection)""")  # fmt: skip


def merged_index(indexes: list[DataFrame]) -> DataFrame:
    """One record a key from logs (key, pos, record columns) of rising rank: the last record of the last log that has the key."""
    whole = None
    for rank, log in enumerate(indexes):
        own = log.withColumn("log", F.lit(rank))
        whole = own if whole is None else whole.unionByName(own)
    rest = [c for c in whole.columns if c not in ("key", "pos", "log")]
    return whole.where("key IS NOT NULL").groupBy("key").agg(F.max_by(F.struct(*rest), F.struct("log", "pos")).alias("r")).select("key", "r.*")


def last_record(log: DataFrame) -> DataFrame:
    return merged_index([log])


def _members(value: object) -> Iterator[tuple[str, object]]:
    for k, v in value.items() if isinstance(value, dict) else []:
        yield k, v
    for v in value.values() if isinstance(value, dict) else value if isinstance(value, list) else []:
        yield from _members(v)


def _texts(value: object) -> Iterator[str]:
    if isinstance(value, str):
        yield value
    for v in value.values() if isinstance(value, dict) else value if isinstance(value, list) else []:
        yield from _texts(v)


def _candidates(message: str, kind: str, content: str | None) -> Iterator[tuple[str, str, str, str]]:
    """(kind, key, file name, extension) of every attachment key and linked document in a message."""
    try:
        value = json.loads(content or "null")
    except ValueError:
        value = content
    hint = {}
    if isinstance(value, dict):
        name = value.get("file_name") or value.get("fileName") or value.get("name")
        hint = {value.get("file_key") or value.get("fileKey"): name} if isinstance(name, str) else {}
    for name, key in _members(value):
        if name in KEYS and isinstance(key, str):
            file = re.sub(ILLEGAL, "_", hint.get(key) or f"{message}_{KEYS[name]}_{key}{'.jpg' if KEYS[name] == 'image' else ''}").strip(" .")[:180] or "download"
            yield KEYS[name], key, file, file.rsplit(".", 1)[-1].lower() if "." in file else ""
    for url in (u for t in _texts(value) for u in URL.findall(t)):
        parts = [p for p in re.sub(r"[?#].*$", "", url.split("://", 1)[1]).split("/")[1:] if p]
        at = next((i for i, p in enumerate(parts[:-1]) if p in LINKED), None)
        if at is not None:
            kind, ext = LINKED[parts[at]]
            yield f"linked {kind}", parts[at + 1], f"{message}_{kind}_{parts[at + 1]}", ext


def attachment_candidates(messages: DataFrame) -> DataFrame:
    """message_id, kind, key, filename, supported of what messages (pos, message_id, msg_type, content) attach or link to.

    An attachment counts once a message, key and kind; a linked document once a
    kind and key over all messages, the first by ``pos``.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [
                (pos, m, *c) for pos, m, k, body in zip(frame["pos"], frame["message_id"], frame["msg_type"], frame["content"], strict=True) for c in _candidates(m or "", k or "", body)
            ]
            yield pd.DataFrame(rows, columns=["pos", "message_id", "kind", "key", "filename", "ext"])

    found = messages.select("pos", "message_id", "msg_type", "content").mapInPandas(run, "pos long, message_id string, kind string, key string, filename string, ext string")
    scope = F.when(F.col("kind").startswith("linked"), "").otherwise(F.col("message_id"))
    first = found.groupBy(scope.alias("scope"), "kind", "key").agg(F.min(F.struct("pos", "message_id", "filename", "ext")).alias("x")).select("kind", "key", "x.*")
    return first.select("message_id", "kind", "key", "filename", F.col("ext").isin(*SUPPORTED).alias("supported"))


def resolve_time_range(days: int | None = None, start: str | None = None, end: str | None = None, now: int | None = None) -> tuple[int | None, int | None]:
    """Epoch seconds of either the last ``days`` or a start and end: dates (whole days), date-times or seconds."""
    if days is not None and (start or end):
        raise ValueError("days cannot be used together with a start or an end")
    if days is not None:
        if days < 0:
            raise ValueError("days must not be negative")
        now = int(dt.datetime.now().timestamp()) if now is None else now
        return now - days * 86_400, now

    def parse(value: str | None, last: bool) -> int | None:
        value = (value or "").strip()
        if not value or value.isdigit():
            return int(value) if value else None
        found = dt.datetime.fromisoformat(value)
        if re.fullmatch(r"\d{4}-\d{2}-\d{2}", value) and last:
            found = dt.datetime.combine(found.date(), dt.time.max)
        return int(found.timestamp())

    low, high = parse(start, False), parse(end, True)
    if low is not None and high is not None and low > high:
        raise ValueError("the start must not be after the end")
    return low, high


def messages_between(messages: DataFrame, low: int | None, high: int | None, newest_first: bool = True) -> DataFrame:
    """Messages (t in epoch seconds) of a time range, newest first."""
    rows = messages if low is None else messages.where(F.col("t") >= low)
    rows = rows if high is None else rows.where(F.col("t") <= high)
    return rows.orderBy(F.desc("t") if newest_first else F.asc("t"))
