"""Ingestion: routing and keys, resume plan, document types, chunkers, chunk dedup, point ids, web pages, evaluation."""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Callable, Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skeinmill.functions.text import let
from skeinmill.runtime import table

# Collections, document-type patterns, pipeline stages by rank.
COLLECTIONS = ("knowledgebase", "rules", "dictionary", "cases", "exceptions", "company", "templates", "temporary")
STAGE_RANK = {"raw": 0, "markdown": 1, "chunk": 2, "vectorized": 3}
SOP_CODE = r"(?i)SOP[-\s]*(?:IN|OUT|VAS|SYS)[-\s]*\d{3}"
SOP_STEP = r"步骤\s*│|标准动作\s*│|异常处理\s*│"
SOP_WORD = r"(?i)SOP要点|标准作业程序|业务流|SOP框架总结"
NAMESPACE = "6ba7b8119dad11d180b400c04fd430c8"


def route_collection(key: Column, fallback: str = "knowledgebase") -> Column:
    """The folder after raw/ if it is a known collection."""
    parts = F.split(key, "/")
    name = F.try_element_at(parts, F.lit(2))
    return F.when((F.try_element_at(parts, F.lit(1)) == "raw") & (F.size(parts) > 2) & name.isin(*COLLECTIONS), name).otherwise(fallback)


def derived_key(key: Column, prefix: str, suffix: str) -> Column:
    return F.concat(F.lit(prefix), F.regexp_replace(F.regexp_replace(key, r"^raw/", ""), r"\.[^./]*$", ""), F.lit(suffix))


def point_id(name: Column, namespace: str = NAMESPACE) -> Column:
    """Version 5 UUID of a name, from SHA-1 bits."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace)), F.encode(name, "UTF-8")))
    variant = F.substring(F.lit("89ab"), F.pmod(F.conv(F.substring(h, 17, 1), 16, 10).cast("int"), F.lit(4)) + 1, F.lit(1))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))


def document_type(text: Column, ext: Column) -> Column:
    """Extension first, then slides, tables, operating procedures, numbered documents; else general."""
    slides, rules = F.regexp_count(text, F.lit(r"(?m)^## Slide \d+")), F.regexp_count(text, F.lit(r"\n---\n"))
    lines = F.filter(F.split(text, "\n"), lambda x: F.trim(x) != "")
    dense = F.size(F.filter(lines, lambda x: x.rlike(r"^\|.*\|.*\|$"))) / F.greatest(F.lit(1), F.size(lines))
    separators = F.regexp_count(text, F.lit(r"(?m)^\|[\s\-:]+\|[\s\-:]+\|"))
    sop = 3 * F.regexp_count(text, F.lit(SOP_CODE)) + 2 * F.regexp_count(text, F.lit(SOP_STEP)) + 2 * F.regexp_count(text, F.lit(SOP_WORD)) + F.regexp_count(text, F.lit(r"(?s)```\w*\n.*?```"))
    titles = F.regexp_count(text, F.lit(r"(?m)^[一二三四五六七八九十]+[、.．]")) + F.regexp_count(text, F.lit(r"(?m)^\d+\.\d+\s"))
    return (
        F.when(ext.isin("ppt", "pptx"), "ppt").when(ext.isin("xls", "xlsx", "csv"), "excel").when((slides >= 2) & (rules >= slides - 1), "ppt")
        .when((dense > 0.4) & (separators >= 1), "excel").when(sop >= 4, "sop_report").when(titles >= 2, "structured_biz").otherwise("general")
    )


# Chunkers: a registry of text -> list of chunks, run by one Arrow-batched operator.
def paragraph_chunks(text: str, size: int = 512) -> list[str]:
    """Greedy packs of paragraphs; only paragraph lengths count, an oversize one stays whole."""
    out, held, used = [], [], 0
    for p in (p for p in text.split("\n\n") if p.strip()):
        if held and used + len(p) > size:
            out.append("\n\n".join(held))
            held, used = [], 0
        held.append(p)
        used += len(p)
    return out + (["\n\n".join(held)] if held else [])


def recursive_chunks(text: str, size: int = 512, overlap: int = 128, separators: tuple[str, ...] = ("\n\n", "\n", "。", ".", " ", "")) -> list[str]:
    """Split by the first separator that helps, merge greedily, recurse; overlap only where characters are cut."""
    if len(text) <= size:
        return [text] if text.strip() else []
    sep = next((s for s in separators if s == "" or s in text), "")
    if sep == "":
        step = max(1, size - overlap)
        return [text[i : i + size] for i in range(0, len(text), step) if text[i : i + size].strip()]
    rest = separators[separators.index(sep) + 1 :]
    out, held = [], ""
    for piece in text.split(sep):
        joined = held + sep + piece if held else piece
        if len(joined) <= size:
            held = joined
            continue
        if held.strip():
            out.append(held)
        held = ""
        if len(piece) > size:
            out += recursive_chunks(piece, size, overlap, rest)
        else:
            held = piece
    return out + ([held] if held.strip() else [])


def line_buffer_chunks(text: str, least: int = 200, most: int = 800, keep: int = 5) -> list[str]:
    """Lines gather until a heading ends a long enough buffer or it is too long; the last lines carry over."""
    out, held, fresh = [], [], False
    for line in text.split("\n"):
        held.append(line)
        fresh = True
        n = sum(map(len, held)) + len(held) - 1
        if (line.startswith("#") and n >= least) or n >= most:
            out.append("\n".join(held))
            held, fresh = held[-keep:] if len(held) > keep else held, False
    return out + (["\n".join(held)] if fresh and "".join(held).strip() else [])


def heading_sections(text: str) -> list[tuple[int, str, str, str]]:
    """(level, title, breadcrumb, body) of each heading's own text; text before the first heading has level 0."""
    out, stack, level, title, body = [], [], 0, "", []
    for line in [*text.split("\n"), "# "]:
        m = re.match(r"(#{1,6})\s+(.*)$", line) if line != "# " else re.match(r"(#)( )$", line)
        if not m:
            body.append(line)
            continue
        if title or "".join(body).strip():
            out.append((level, title, " > ".join(t for _, t in stack), "\n".join(body).strip()))
        level, title, body = len(m[1]), m[2].strip(), []
        stack = [x for x in stack if x[0] < level] + [(level, title)]
    return out


def markdown_chunks(text: str, size: int = 512) -> list[str]:
    """One chunk a section, its heading in front; large ones are split recursively."""
    out = []
    for _, title, _, body in heading_sections(text):
        if body:
            whole = f"{title}\n{body}" if title else body
            out += [whole] if len(whole) <= size else recursive_chunks(whole, size)
    return out


CHUNKERS: dict[str, Callable[[str], list[str]]] = {"text": paragraph_chunks, "recursive": recursive_chunks, "semantic": line_buffer_chunks, "markdown_structure": markdown_chunks}


def chunk_documents(docs: DataFrame, strategy: str = "recursive") -> DataFrame:
    """doc_id, chunk_index, text, token_count (characters) of every document; null texts have none."""
    if strategy not in CHUNKERS:
        raise ValueError(f"unknown chunker: {strategy}")
    cut = CHUNKERS[strategy]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(d, i, c, len(c)) for d, t in zip(frame["doc_id"], frame["text"], strict=True) for i, c in enumerate(cut(t or ""))]
            yield pd.DataFrame(rows, columns=["doc_id", "chunk_index", "text", "token_count"])

    return docs.select("doc_id", "text").mapInPandas(run, "doc_id long, chunk_index int, text string, token_count int")


def normalize_chunk(text: Column) -> Column:
    bare = F.regexp_replace(text, r"\\([\\`*_{}\[\]()#+\-.!|>~])", "$1")
    return F.btrim(F.regexp_replace(bare, r"[ \t\r\n]+", " "), F.lit(" "))


def dedup_chunks(chunks: DataFrame) -> DataFrame:
    """First of equal normalised chunks in a document, renumbered without gaps."""
    own = chunks.withColumn("hash", F.sha2(normalize_chunk(F.col("text")).cast("binary"), 256))
    first = own.withColumn("n", F.row_number().over(W.partitionBy("doc_id", "hash").orderBy("chunk_index"))).where("n = 1")
    return first.withColumn("chunk_index", F.row_number().over(W.partitionBy("doc_id").orderBy("chunk_index")) - 1).drop("n")


def best_record(log: DataFrame) -> DataFrame:
    """Current record of each key: the last etag's epoch, and in it the highest stage, later ones on ties."""
    own = W.partitionBy("key").orderBy("pos")
    changed = F.when(F.lag("etag").over(own).eqNullSafe(F.col("etag")), 0).otherwise(1)
    epochs = log.withColumn("c", changed).withColumn("epoch", F.sum("c").over(own))
    rank = F.create_map(*[x for k, v in STAGE_RANK.items() for x in (F.lit(k), F.lit(v))])[F.col("stage")]
    return epochs.groupBy("key").agg(F.max_by(F.struct("etag", "stage", "pos"), F.struct("epoch", F.coalesce(rank, F.lit(-1)).alias("r"), "pos")).alias("m")).select("key", "m.*")


def _visible_text(page: str | None) -> tuple[str, str]:
    class Reader(HTMLParser):
        def __init__(self):
            super().__init__(convert_charrefs=True)
            self.skip, self.title, self.parts, self.in_title = 0, [], [], False

        def handle_starttag(self, tag, attrs):
            self.skip += tag in ("script", "style", "noscript")
            self.in_title |= tag == "title"
            self.parts.append("\n")

        def handle_endtag(self, tag):
            self.skip -= tag in ("script", "style", "noscript") and self.skip > 0
            self.in_title &= tag != "title"
            self.parts.append("\n")

        def handle_data(self, data):
            if self.in_title:
                self.title.append(data)
            elif not self.skip:
                self.parts.append(data)

    r = Reader()
    r.feed(page or "")
    lines = (x.strip() for x in "".join(r.parts).split("\n"))
    return "".join(r.title).strip(), "\n".join(x for x in lines if x)


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, title and visible text, one line a block."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            both = [_visible_text(h) for h in frame["html"]]
            yield pd.DataFrame({"page_id": frame["page_id"], "title": [t for t, _ in both], "text": [x for _, x in both]})

    return pages.select("page_id", "html").mapInPandas(run, "page_id long, title string, text string")


# IPv4 ranges (first address, bits) and IPv6 prefixes inside 2000::/3 that are not global, by the address registries.
PRIVATE_V4 = (
    ("0.0.0.0", 8), ("10.0.0.0", 8), ("100.64.0.0", 10), ("127.0.0.0", 8), ("169.254.0.0", 16), ("172.16.0.0", 12), ("192.0.0.0", 24), ("192.0.2.0", 24),
    ("192.88.99.0", 24), ("192.168.0.0", 16), ("198.18.0.0", 15), ("198.51.100.0", 24), ("203.0.113.0", 24), ("224.0.0.0", 4), ("240.0.0.0", 4),
)
PRIVATE_V6 = r"^(2001:0?[01]?[0-9a-f]?[0-9a-f]?:|2001::|2001:0?db8:|2002:|3fff:0?[0-9a-f]{1,3}:)"


def _v4_number(host: Column) -> Column:
    """The address that a host of one to four decimal, octal or hexadecimal parts stands for; null if it is none."""
    parts = F.split(host, r"\.")
    number = lambda x: F.when(x.rlike("^0x[0-9a-f]{0,8}$"), F.conv(F.concat(F.lit("0"), F.substring(x, 3, 8)), 16, 10)).when(x.rlike("^0[0-7]{0,11}$"), F.conv(x, 8, 10)).when(x.rlike("^[1-9][0-9]{0,9}$"), x).cast("long")

    def value(n: Column) -> Column:
        size = F.size(n)
        last, head = F.element_at(n, -1), F.slice(n, 1, size - 1)
        fits = F.forall(head, lambda x: x < 256) & (last < F.pow(F.lit(256), 5 - size)) & F.forall(n, lambda x: x.isNotNull())
        whole = F.aggregate(F.transform(head, lambda x, i: x * F.pow(F.lit(256), 3 - i).cast("long")), F.lit(0).cast("long"), lambda a, x: a + x)
        return F.when((size <= 4) & fits, whole + last)

    return let(F.transform(parts, number), value)


def _is_global_v4(number: Column) -> Column:
    """Whether a number is the address of a host in the public network; false for null."""
    outside = F.lit(True)
    for first, bits in PRIVATE_V4:
        low = sum(int(x) << 8 * (3 - i) for i, x in enumerate(first.split(".")))
        outside = outside & ~number.between(low, low + (1 << (32 - bits)) - 1)
    return F.coalesce(outside, F.lit(False))


def is_public_url(url: Column) -> Column:
    """http or https in any case, a host without credentials, and if the host is an address, one of the public network.

    Addresses count in every form that a resolver takes: parts in decimal, octal
    or hexadecimal, fewer than four of them, IPv6 and IPv4 mapped into it. A host
    whose last part is a number but which is no address is refused, and so are
    ``localhost`` and names below it. Names are not resolved. Null is not public.
    """
    authority = F.regexp_extract(F.trim(url), r"^(?i:https?)://([^/?#\\]*)", 1)
    host = F.lower(F.regexp_replace(authority, r":[0-9]*$", ""))
    name = F.regexp_replace(host, r"\.$", "")
    inner = F.regexp_extract(host, r"^\[([0-9a-f:.]+)\]$", 1)
    mapped = F.regexp_extract(inner, r"^(?:::|(?:0{1,4}:){5})ffff:([0-9a-f:.]+)$", 1)
    pair = F.split(mapped, ":")
    mapped_number = F.when(mapped.contains("."), _v4_number(mapped)).when((F.size(pair) == 2) & mapped.rlike("^[0-9a-f]{1,4}:[0-9a-f]{1,4}$"), F.conv(F.get(pair, F.lit(0)), 16, 10).cast("long") * 65536 + F.conv(F.get(pair, F.lit(1)), 16, 10).cast("long"))
    groups = r"^(?!.*::.*::)(?!.*:::)(?:[0-9a-f]{1,4}:){1,7}(?::|[0-9a-f]{1,4}|(?::[0-9a-f]{1,4}){1,6})$"
    v6 = F.when(mapped != "", _is_global_v4(mapped_number)).otherwise(inner.rlike(groups) & inner.rlike("^[23][0-9a-f]{3}:") & ~inner.rlike(PRIVATE_V6))
    numeric = F.regexp_extract(name, r"([^.]*)$", 1).rlike(r"^(0x[0-9a-f]*|[0-9]+)$")
    named = (name != "") & name.rlike(r"^[^\s@\[\]:]+$") & ~name.rlike(r"^(.*\.)?localhost$")
    ok = F.when(host.startswith("["), v6).when(numeric, _is_global_v4(_v4_number(name))).otherwise(named)
    return F.coalesce(ok & (authority != "") & ~authority.contains("@"), F.lit(False))


@F.pandas_udf(T.StringType())
def unescape(text: pd.Series) -> pd.Series:
    """HTML-unescape to a fixpoint, three times at most."""

    def once(t):
        for _ in range(3):
            if t is None or (u := html.unescape(t)) == t:
                return t
            t = u
        return t

    return text.map(once)


def table_text(text: Column) -> Column:
    """Pipe-table rows as ``field：value`` records joined by spaces; the first row is the header, separators go."""
    cells = lambda line: F.transform(F.split(F.regexp_replace(F.trim(line), r"^\||\|$", ""), r"\|"), lambda c: F.trim(c))
    rows = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"^\s*\|") & ~x.rlike(r"^\s*\|[\s\-:|]+$"))
    head = cells(F.element_at(rows, 1))
    record = lambda r: F.array_join(F.transform(F.filter(F.arrays_zip(head.alias("k"), cells(r).alias("v")), lambda x: x["v"] != ""), lambda x: F.concat(x["k"], F.lit("："), x["v"])), " ")
    return F.when(F.size(rows) >= 2, F.array_join(F.transform(F.slice(rows, 2, F.greatest(F.lit(1), F.size(rows))), record), "\n"))


# Queries ---------------------------------------------------------------------
def route(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages stand for stored objects: raw/<first path part>/<page>.html."""
    pages = table(spark, sf_dir, "pages")
    folder = F.when(F.col("page_id") % 3 == 0, "rules").when(F.col("page_id") % 3 == 1, F.regexp_extract("url", r"://[^/]*/([^/?#]*)", 1)).otherwise("cases")
    key = F.concat(F.lit("raw/"), folder, F.lit("/p"), F.col("page_id"), F.lit(".html"))
    return pages.select(key.alias("key")).select("key", route_collection(F.col("key")).alias("collection"), derived_key(F.col("key"), "markdown/", ".md").alias("markdown_key"), derived_key(F.col("key"), "chunks/", ".json").alias("chunk_key"))


def payload_point_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", point_id(F.concat(F.md5(F.col("text").cast("binary")), F.lit("_0"))).alias("id"))


def doc_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), "text", F.lit("").alias("ext"))
    own = spark.createDataFrame([("p", "## Slide 1\n\n---\n\n## Slide 2", ""), ("x", "| a | b |\n|---|---|\n| 1 | 2 |", "md"), ("s", "SOP-IN-001 and SOP OUT 002", ""), ("b", "一、x\n二、y", ""), ("e", "any", "xlsx")], "doc_id string, text string, ext string")
    return docs.unionByName(own).select("doc_id", document_type(F.col("text"), F.col("ext")).alias("doc_type"))


def _chunks(strategy):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return chunk_documents(table(spark, sf_dir, "documents"), strategy)

    return run


def _line_chunks(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("chunk_index", "text"))


def dedup_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_chunks(_line_chunks(spark, sf_dir)).select("doc_id", F.col("chunk_index").cast("long").alias("chunk_index"), "hash")


def line_hash_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _line_chunks(spark, sf_dir).groupBy(F.md5(F.col("text").cast("binary")).alias("line_md5")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n"))


def resume_action(stage: Column, etag: Column, now: Column) -> Column:
    """What a source of content ``now`` needs, whose best record is of ``stage`` and ``etag``: skip, vectorize, chunk or full."""
    changed = etag.isNotNull() & (etag != now)
    return F.when(changed, "full").when(stage == "vectorized", "skip").when(stage == "chunk", "vectorize").when(stage == "markdown", "chunk").otherwise("full")


def ingest_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events")
    return ev.groupBy("user_id").agg(F.count("*").alias("total"), *[F.count_if(F.col("event_type") == k).alias(k) for k in ("error", "view", "signup")])


def web_page_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(table(spark, sf_dir, "pages"))


def url_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = spark.createDataFrame([("http://10.0.0.1/",), ("ftp://x/",), ("http://u:p@x.com/",), ("https://172.20.1.1/",), (None,)], "url string")
    return table(spark, sf_dir, "pages").select("url").unionByName(own).groupBy(is_public_url(F.col("url")).alias("ok")).agg(F.count("*").alias("n"))


def eval_source_hit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A labelled document's source is found in one of the sources (either contains the other); the mean leaves unlabelled ones out."""
    docs = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "left")
    expected = F.when(F.col("quality").isNotNull(), F.array("source", F.lit("src1")))
    recalled = F.array(F.concat(F.lit("kb/"), "source"))
    hit = F.size(F.filter(expected, lambda e: F.exists(recalled, lambda r: r.contains(e) | e.contains(r)))) / F.size(expected)
    return docs.groupBy("lang").agg(F.round(F.avg(F.when(expected.isNotNull(), hit)), 6).alias("hit_rate"), F.count("*").alias("n"))


def text_sufficiency(spark: SparkSession, sf_dir: str) -> DataFrame:
    units = F.regexp_count("text", F.lit(r"[一-鿿]")) + F.regexp_count("text", F.lit(r"[A-Za-z]+")) + F.regexp_count("text", F.lit(r"[0-9]+"))
    return table(spark, sf_dir, "documents").select("doc_id", units.cast("long").alias("units"), (units >= 50).alias("enough"))


def table_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    md = F.concat(F.lit("| name | brand | size |\n|---|---|---|\n| "), "p_name", F.lit(" |  | "), "p_size", F.lit(" |"))
    return part.select("p_partkey", table_text(md).alias("records"))


def chunk_size_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _line_chunks(spark, sf_dir).where("trim(text) <> ''")
    return lines.groupBy("doc_id").agg(F.count("*").alias("chunks"), F.max(F.length("text")).cast("long").alias("longest"), F.round(F.avg(F.length("text")), 6).alias("mean"))


_L = "l AS (SELECT doc_id, generate_subscripts(x, 1) - 1 AS i, unnest(x) AS text FROM (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents))"
_NORM = r"trim(regexp_replace(regexp_replace(text, '\\([\\`*_{}\[\]()#+\-.!|>~])', '\1', 'g'), '[ \t\r\n]+', ' ', 'g'), ' ')"
_COLL = ", ".join(f"'{c}'" for c in COLLECTIONS)
QUERIES = {
    "route_collection": (route, f"""WITH k AS (SELECT 'raw/' || CASE page_id % 3 WHEN 0 THEN 'rules' WHEN 1 THEN regexp_extract(url, '://[^/]*/([^/?#]*)', 1) ELSE 'cases' END || '/p' || page_id || '.html' AS key FROM pages)
        SELECT key, CASE WHEN split_part(key, '/', 2) IN ({_COLL}) THEN split_part(key, '/', 2) ELSE 'knowledgebase' END AS collection,
        'markdown/' || regexp_replace(substr(key, 5), '\\.[^./]*$', '') || '.md' AS markdown_key, 'chunks/' || regexp_replace(substr(key, 5), '\\.[^./]*$', '') || '.json' AS chunk_key FROM k"""),
    "payload_point_id": (payload_point_id, f"""WITH h AS (SELECT doc_id, sha1(from_hex('{NAMESPACE}') || encode(md5(text) || '_0')) AS h FROM documents)
        SELECT doc_id, h[1:8] || '-' || h[9:12] || '-5' || h[14:16] || '-' || substr('89ab', ((strpos('0123456789abcdef', h[17]) - 1) % 4 + 1)::BIGINT, 1) || h[18:20] || '-' || h[21:32] AS id FROM h"""),
    "doc_type_classify": (doc_types, rf"""WITH d AS (SELECT doc_id::VARCHAR AS doc_id, text, '' AS ext FROM documents UNION ALL SELECT * FROM (VALUES ('p', '## Slide 1' || repeat(chr(10), 2) || '---' || repeat(chr(10), 2) || '## Slide 2', ''),
        ('x', '| a | b |' || chr(10) || '|---|---|' || chr(10) || '| 1 | 2 |', 'md'), ('s', 'SOP-IN-001 and SOP OUT 002', ''), ('b', '一、x' || chr(10) || '二、y', ''), ('e', 'any', 'xlsx')) v),
        k AS (SELECT *, list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '') AS lines, len(regexp_extract_all(text, '(?m)^## Slide \d+')) AS slides, len(string_split(text, chr(10) || '---' || chr(10))) - 1 AS rules,
          len(regexp_extract_all(text, '(?m)^\|[\s\-:]+\|[\s\-:]+\|')) AS seps, 3 * len(regexp_extract_all(text, '{SOP_CODE}')) + 2 * len(regexp_extract_all(text, '{SOP_STEP}')) + 2 * len(regexp_extract_all(text, '{SOP_WORD}'))
          + len(regexp_extract_all(text, '(?s)```\w*\n.*?```')) AS sop, len(regexp_extract_all(text, '(?m)^[一二三四五六七八九十]+[、.．]')) + len(regexp_extract_all(text, '(?m)^\d+\.\d+\s')) AS titles FROM d)
        SELECT doc_id, CASE WHEN ext IN ('ppt', 'pptx') THEN 'ppt' WHEN ext IN ('xls', 'xlsx', 'csv') THEN 'excel' WHEN slides >= 2 AND rules >= slides - 1 THEN 'ppt'
          WHEN len(list_filter(lines, lambda x: regexp_matches(x, '^\|.*\|.*\|$'))) / greatest(1, len(lines)) > 0.4 AND seps >= 1 THEN 'excel' WHEN sop >= 4 THEN 'sop_report' WHEN titles >= 2 THEN 'structured_biz' ELSE 'general' END AS doc_type FROM k"""),
    "chunk_paragraph": (_chunks("text"), """WITH RECURSIVE p AS (SELECT doc_id, list_filter(string_split(text, chr(10) || chr(10)), lambda x: trim(x, ' ' || chr(9) || chr(10) || chr(13)) <> '') AS ps FROM documents),
        r AS (SELECT doc_id, ps, 1 AS i, 0 AS c, length(ps[1]) AS used FROM p WHERE len(ps) > 0
          UNION ALL SELECT doc_id, ps, i + 1, CASE WHEN used + length(ps[i + 1]) > 512 THEN c + 1 ELSE c END, CASE WHEN used + length(ps[i + 1]) > 512 THEN length(ps[i + 1]) ELSE used + length(ps[i + 1]) END FROM r WHERE i < len(ps))
        SELECT doc_id, c::INT AS chunk_index, string_agg(ps[i], chr(10) || chr(10) ORDER BY i) AS text, length(string_agg(ps[i], chr(10) || chr(10) ORDER BY i))::INT AS token_count FROM r GROUP BY doc_id, c"""),
    "chunk_recursive": (_chunks("recursive"), None),
    "chunk_semantic": (_chunks("semantic"), None),
    "chunk_markdown": (_chunks("markdown_structure"), None),
    "chunk_size_stats": (chunk_size_stats, f"WITH {_L} SELECT doc_id, count(*) AS chunks, max(length(text)) AS longest, round(avg(length(text)), 6) AS mean FROM l WHERE trim(text) <> '' GROUP BY 1"),
    "dedup_exact": (dedup_exact, f"WITH {_L}, h AS (SELECT doc_id, i, sha256({_NORM}) AS hash FROM l), f AS (SELECT * FROM h QUALIFY row_number() OVER (PARTITION BY doc_id, hash ORDER BY i) = 1) SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS chunk_index, hash FROM f"),
    "line_hash_dedupe": (line_hash_dedupe, f"WITH {_L} SELECT md5(text) AS line_md5, min(doc_id) AS doc_id, count(*) AS n FROM l GROUP BY 1"),
    "ingest_stats": (ingest_stats, "SELECT user_id, count(*) AS total, count_if(event_type = 'error')::BIGINT AS error, count_if(event_type = 'view')::BIGINT AS view, count_if(event_type = 'signup')::BIGINT AS signup FROM events GROUP BY 1"),
    "web_page_extract": (web_page_extract, None),
    "url_guard": (url_guard, r"""WITH u AS (SELECT url FROM pages UNION ALL SELECT unnest(['http://10.0.0.1/', 'ftp://x/', 'http://u:p@x.com/', 'https://172.20.1.1/', NULL])), h AS (SELECT regexp_extract(url, '^https?://([^/?#]*)', 1) AS h FROM u)
        SELECT coalesce(h <> '' AND NOT contains(h, '@') AND NOT regexp_matches(h, '^(localhost|127\.|10\.|192\.168\.|169\.254\.|172\.(1[6-9]|2[0-9]|3[01])\.|0\.|\[)'), false) AS ok, count(*) AS n FROM h GROUP BY 1"""),
    "eval_source_hit": (eval_source_hit, """SELECT lang, round(avg(CASE WHEN quality IS NOT NULL THEN ((contains('kb/' || source, source))::INT + (contains('kb/' || source, 'src1'))::INT) / 2.0 END), 6) AS hit_rate, count(*) AS n
        FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1"""),
    "text_sufficiency": (text_sufficiency, "WITH c AS (SELECT doc_id, len(regexp_extract_all(text, '[一-鿿]')) + len(regexp_extract_all(text, '[A-Za-z]+')) + len(regexp_extract_all(text, '[0-9]+')) AS units FROM documents) SELECT doc_id, units, units >= 50 AS enough FROM c"),
    "table_to_field_value": (table_records, "SELECT p_partkey, 'name：' || trim(p_name) || ' size：' || p_size AS records FROM part"),
}
