"""From hits to answers, and the point table behind them: upsert, deletion, siblings, source labels, refusal, streaming output."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from skeinmill.functions import text as fn
from skeinmill.functions import toc
from skeinmill.operators.ingest import point_id
from skeinmill.runtime import table

MARGIN, MAX_SIBLINGS, MAX_SOURCES = 0.02, 10, 3
GOOD_SCORE = 0.68


# Points ----------------------------------------------------------------------
def payload(chunks: DataFrame, tenant: str = "", carried: tuple[str, ...] = ()) -> DataFrame:
    """Points of chunks (doc_uuid, chunk_index, text, and optional title, breadcrumb array, level): ids from names, breadcrumb as a path; with the columns ``carried``."""
    has = lambda c, d: F.col(c) if c in chunks.columns else d
    crumbs = F.filter(has("breadcrumb", F.array().cast("array<string>")), lambda p: F.coalesce(p, F.lit("")) != "")
    last = F.try_element_at(crumbs, F.lit(-1))
    return chunks.select(
        point_id(F.concat_ws("_", "doc_uuid", "chunk_index")).alias("id"), "doc_uuid", "chunk_index", F.coalesce("text", F.lit("")).alias("content"),
        F.length(F.coalesce("text", F.lit(""))).alias("token_count"),
        F.when(F.size(crumbs) > 0, F.coalesce(F.nullif(has("title", F.lit(None).cast("string")), F.lit("")), last)).otherwise("").alias("title"),
        F.array_join(crumbs, " > ").alias("breadcrumb"), F.coalesce(has("level", F.lit(0)), F.lit(0)).cast("int").alias("level"),
        F.lit(tenant).alias("tenant_id"), F.lit(False).alias("is_deleted"), *carried,
    )


def upsert(points: DataFrame, incoming: DataFrame, key: str = "id", order: str | None = None) -> DataFrame:
    """Points with those of ``incoming`` in place of equal keys; ids of a document that shrank stay, as in a keyed store.

    Of incoming rows with one key the last by ``order`` counts, the largest row on ties and without an order.
    """
    row = F.struct(*incoming.columns)
    last = incoming.groupBy(key).agg(F.max(F.struct(*([F.col(order).alias("o")] if order else []), row.alias("r"))).alias("m")).select("m.r.*")
    return points.join(incoming.select(key).distinct(), key, "left_anti").unionByName(last.select(incoming.columns), allowMissingColumns=True)


def soft_delete(points: DataFrame, doomed: DataFrame, key: str = "doc_uuid") -> DataFrame:
    mark = doomed.select(key).distinct().withColumn("gone", F.lit(True))
    return points.join(mark, key, "left").withColumn("is_deleted", F.coalesce("gone", "is_deleted", F.lit(False))).drop("gone").select(points.columns)


def hard_delete(points: DataFrame, doomed: DataFrame, key: str = "doc_uuid") -> DataFrame:
    return points.join(doomed.select(key).distinct(), key, "left_anti")


def expand_siblings(hits: DataFrame, points: DataFrame, margin: float = MARGIN, most: int = MAX_SIBLINGS) -> DataFrame:
    """Hits (query_id, doc_uuid, chunk_index, breadcrumb, score) with the siblings of each query's best ones.

    A hit within ``margin`` of its query's best brings in, once for each parent
    path, up to ``most`` chunks of its document whose path starts with the
    parent, out of the first three times as many by index; they score 0. The
    cap is the feature. Hits are a bounded set, so the join goes by document.
    """
    crumb = F.btrim(F.coalesce("breadcrumb", F.lit("")))
    best = F.max("score").over(W.partitionBy("query_id"))
    near = hits.withColumn("best", best).where((F.col("score") >= F.col("best") - margin) & crumb.contains(" > "))
    parents = near.select("query_id", "doc_uuid", F.regexp_replace(crumb, r"(?s)^(.*) > .*$", "$1").alias("parent")).distinct()
    own = points.select("doc_uuid", "chunk_index", F.col("breadcrumb").alias("path"))
    found = parents.join(own, "doc_uuid").where(F.startswith(F.coalesce("path", F.lit("")), F.col("parent")))
    group = W.partitionBy("query_id", "doc_uuid", "parent").orderBy("chunk_index")
    first = found.withColumn("n", F.row_number().over(group)).where(F.col("n") <= 3 * most).drop("n")
    fresh = first.join(hits.select("query_id", "doc_uuid", "chunk_index"), ["query_id", "doc_uuid", "chunk_index"], "left_anti")
    added = fresh.withColumn("n", F.row_number().over(group)).where(F.col("n") <= most)
    extra = added.groupBy("query_id", "doc_uuid", "chunk_index").agg(F.first("path").alias("breadcrumb")).withColumn("score", F.lit(0.0))
    return hits.select(extra.columns).unionByName(extra)


# Answers ---------------------------------------------------------------------
def source_labels(hits: DataFrame, most: int = MAX_SOURCES) -> DataFrame:
    """query_id, n, label: the first distinct ``document › leaf section`` labels of a query's hits in rank order."""
    leaf = fn.leaf_section(F.col("breadcrumb"))
    name = F.coalesce(F.nullif("filename", F.lit("")), F.nullif("doc_uuid", F.lit("")), F.lit("未知来源"))
    labelled = hits.withColumn("label", F.when(leaf != "", F.concat(name, F.lit(" › "), leaf)).otherwise(name))
    first = labelled.groupBy("query_id", "label").agg(F.min("rank").alias("rank"))
    return first.withColumn("n", F.row_number().over(W.partitionBy("query_id").orderBy("rank", "label"))).where(F.col("n") <= most).select("query_id", "n", "label")


def answer_stage(searched: Column, n_hits: Column, top: Column, answer: Column) -> Column:
    """direct (no search), refuse (no hits, or blank or marked with no good hit) or answer."""
    blank = (fn.stripped(F.coalesce(answer, F.lit(""))) == "") | F.coalesce(answer, F.lit("")).contains("[NO_ANSWER]")
    good = F.coalesce(top, F.lit(0.0)) >= GOOD_SCORE
    return F.when(~searched, "direct").when((n_hits == 0) | (blank & ~good), "refuse").otherwise("answer")


def throttle(deltas: DataFrame, min_chars: int, min_seconds: float) -> DataFrame:
    """(stream, seq, t, chars, force) rows with ``flush``: forced, first, or enough new characters and seconds since the last flush.

    A forced row flushes too. Streams are folded in order as they pass by; the state is two numbers.
    """

    def fold(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        stream, at, length = None, None, 0
        for frame in frames:
            flushed = []
            for s, t, n, force in zip(frame["stream"], frame["t"], frame["chars"], frame["force"], strict=True):
                if s != stream:
                    stream, at, length = s, None, 0
                flush = bool(force) or at is None or (n - length >= max(1, min_chars) and t - at >= min_seconds)
                if flush:
                    at, length = t, n
                flushed.append(flush)
            yield frame.assign(flush=flushed)

    own = deltas.select("stream", "seq", "t", "chars", "force").repartition("stream").sortWithinPartitions("stream", "seq")
    return own.mapInPandas(fold, "stream long, seq long, t double, chars long, force boolean, flush boolean")


# Queries ---------------------------------------------------------------------
def _points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as chunks of their source, with a path of language and length class."""
    path = F.concat(F.coalesce("lang", F.lit("")), F.lit(" > c"), F.col("doc_id") % 7, F.lit(" > d"), F.col("doc_id") % 3)
    return table(spark, sf_dir, "documents").select(F.col("source").alias("doc_uuid"), F.col("doc_id").alias("chunk_index"), path.alias("breadcrumb"))


def sibling_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = _points(spark, sf_dir)
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), (F.col("item_id") + 1).alias("chunk_index"))
    hits = asked.join(points, "chunk_index")
    return expand_siblings(hits.withColumn("score", F.lit(0.7)), points).select("query_id", "doc_uuid", "chunk_index", "score")


def upsert_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Old points, half of them written anew with another text, one document's marked deleted and one's gone."""
    docs = table(spark, sf_dir, "documents")
    chunk = docs.select(F.concat(F.lit("u"), F.col("doc_id") % 50).alias("doc_uuid"), F.col("doc_id").alias("chunk_index"), F.col("source").alias("text"))
    old, new = payload(chunk), payload(chunk.where("chunk_index % 2 = 0").withColumn("text", F.lit("new")))
    ids = lambda d: spark.createDataFrame([(d,)], "doc_uuid string")
    return hard_delete(soft_delete(upsert(old, new), ids("u3")), ids("u4")).select("doc_uuid", "chunk_index", "content", "is_deleted")


def q_source_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = _points(spark, sf_dir).select((F.col("chunk_index") % 20).alias("query_id"), F.col("chunk_index").alias("rank"), "doc_uuid", F.lit(None).cast("string").alias("filename"), "breadcrumb")
    return source_labels(hits)


def q_answer_stage(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events")
    stage = answer_stage(F.col("event_type") != "signup", F.col("user_id") % 5, F.col("value"), F.when(F.col("event_id") % 3 == 0, " ").otherwise("x"))
    return ev.groupBy(stage.alias("stage")).agg(F.count("*").alias("n"))


def streaming_prefixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    whole = table(spark, sf_dir, "conversations").select("conv_id", "turn", fn.prefixes(F.col("text"), 40).alias("p"))
    return whole.select("conv_id", "turn", F.size("p").cast("long").alias("n"), F.md5(F.array_join("p", "|").cast("binary")).alias("prefixes_md5"))


def sse_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each turn as a stream of three events, one of them broken, and one after the end."""
    event = lambda c: F.concat(F.lit("data: "), F.to_json(F.struct(F.array(F.struct(F.struct(c.alias("content")).alias("delta"))).alias("choices"))))
    stream = F.concat_ws("\n", event(F.col("text")), F.lit(""), F.lit("data: {broken"), F.lit(": note"), event(F.lit("!")), F.lit("data: [DONE]"), event(F.lit("late")))
    turns = table(spark, sf_dir, "conversations")
    return turns.select("conv_id", "turn", F.md5(fn.sse_text(stream).cast("binary")).alias("text_md5"))


def truncate_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.concat(F.lit("@bot <at id=1>x</at> @_k1 "), "text")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.md5(fn.truncate(fn.strip_mentions(said, F.array(F.lit("@_k1"))), 60).cast("binary")).alias("text_md5"))


TOC_DOCS = [
    ("list", "# T\n## Contents\n- a\n\n<!-- page: 2 -->\n- b\n1. c\n\nbody\n- x"), ("short", "## 目录\n- a\n- b\nbody"), ("twice", "# Agenda\n# Index\n* a\n* b\n* c\n# Outline\n+ a\n+ b\n+ c"),
    ("dots", "intro\nOne .... 1\n\nTwo ..... 2\nThree ……… 13\n\n\nFour .... 4\nend"), ("two", "One .... 1\nTwo .... 2\ntext"), ("bar", "| a .... 1\n# b .... 2\nc .... 3"), ("empty", ""),
]


def clean_toc(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = spark.createDataFrame(TOC_DOCS, "doc_id string, text string")
    docs = own.unionByName(table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), "text"))
    cut = docs.select("doc_id", toc.remove_toc(F.col("text")).alias("c"))
    return cut.select("doc_id", F.md5(F.col("c.text").cast("binary")).alias("text_md5"), F.coalesce(F.size("c.toc"), F.lit(0)).cast("long").alias("n_removed"))


_TD = ", ".join("('{}', '{}')".format(d, t.replace("\n", "' || chr(10) || '")) for d, t in TOC_DOCS)
_P = "(lang || ' > c' || doc_id % 7 || ' > d' || doc_id % 3)"
_RE = {k: getattr(toc, k).replace("(?iU)", "(?i)").replace("(?U)", "") for k in ("TOC_HEADING", "LIST_ITEM", "PAGE_MARK", "LEADER")}
QUERIES = {
    "sibling_expand": (sibling_expand, f"""WITH p AS (SELECT source AS doc_uuid, doc_id AS chunk_index, {_P} AS path, lang || ' > c' || doc_id % 7 AS parent FROM documents),
        h AS (SELECT item_id AS query_id, p.* FROM benchmark JOIN p ON chunk_index = item_id + 1),
        f AS (SELECT query_id, p.doc_uuid, p.chunk_index FROM h JOIN p USING (doc_uuid) WHERE starts_with(p.path, h.parent) QUALIFY row_number() OVER (PARTITION BY query_id, p.doc_uuid ORDER BY p.chunk_index) <= 30),
        e AS (SELECT * FROM f ANTI JOIN h USING (query_id, doc_uuid, chunk_index) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY chunk_index) <= 10)
        SELECT query_id, doc_uuid, chunk_index, 0.7::DOUBLE AS score FROM h UNION ALL SELECT query_id, doc_uuid, chunk_index, 0.0::DOUBLE FROM e"""),
    "upsert_points": (upsert_points, """SELECT 'u' || doc_id % 50 AS doc_uuid, doc_id AS chunk_index, CASE WHEN doc_id % 2 = 0 THEN 'new' ELSE coalesce(source, '') END AS content, doc_id % 50 = 3 AS is_deleted
        FROM documents WHERE doc_id % 50 <> 4"""),
    "source_labels": (q_source_labels, """WITH l AS (SELECT doc_id % 20 AS query_id, source || ' › d' || doc_id % 3 AS label, min(doc_id) AS r FROM documents GROUP BY 1, 2)
        SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY r, label) AS n, label FROM l QUALIFY n <= 3"""),
    "answer_stage": (q_answer_stage, """SELECT CASE WHEN event_type = 'signup' THEN 'direct' WHEN user_id % 5 = 0 OR (event_id % 3 = 0 AND coalesce(value, 0) < 0.68) THEN 'refuse' ELSE 'answer' END AS stage, count(*) AS n FROM events GROUP BY 1"""),
    "streaming_prefixes": (streaming_prefixes, """WITH c AS (SELECT conv_id, turn, text, greatest(1, (length(text) + 39) // 40) AS n FROM conversations)
        SELECT conv_id, turn, n, md5(array_to_string(list_transform(range(1, n + 1), lambda i: CASE WHEN i = n THEN text ELSE substr(text, 1, i * 40) END), '|')) AS prefixes_md5 FROM c"""),
    "sse_parse": (sse_parse, "SELECT conv_id, turn, md5(text || '!') AS text_md5 FROM conversations"),
    "mention_truncate": (truncate_strip, r"""WITH t AS (SELECT conv_id, turn, regexp_replace(regexp_replace(replace('@bot <at id=1>x</at> @_k1 ' || text, '@_k1', ''), '<at[^>]*>.*?</at>', '', 'g'), '^\s*@\S+\s*', '') AS s FROM conversations),
        u AS (SELECT conv_id, turn, regexp_replace(s, '^\s+|\s+$', '', 'g') AS s FROM t)
        SELECT conv_id, turn, md5(CASE WHEN length(s) <= 60 THEN s ELSE substr(s, 1, 60) || chr(10) || '...[已截断]' END) AS text_md5 FROM u"""),
    "clean_toc": (clean_toc, rf"""WITH d AS (SELECT * FROM (VALUES {_TD}) v(doc_id, text) UNION ALL SELECT doc_id::VARCHAR, text FROM documents),
        l AS (SELECT doc_id, generate_subscripts(x, 1) AS pos, unnest(x) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS x FROM d)),
        k AS (SELECT *, CASE WHEN regexp_matches(line, '{_RE["TOC_HEADING"]}') THEN 'H' WHEN trim(line) = '' THEN 'B' WHEN regexp_matches(line, '{_RE["PAGE_MARK"]}') THEN 'M' WHEN regexp_matches(line, '{_RE["LIST_ITEM"]}') THEN 'I' ELSE 'X' END AS k FROM l),
        g AS (SELECT *, sum((k IN ('H', 'X'))::INT) OVER (PARTITION BY doc_id ORDER BY pos) AS g FROM k),
        a AS (SELECT *, max((k = 'H')::INT) OVER w = 1 AND sum((k = 'I')::INT) OVER w >= 3 AND k <> 'M' AS gone FROM g WINDOW w AS (PARTITION BY doc_id, g)),
        m AS (SELECT doc_id, pos, line, CASE WHEN trim(line) = '' THEN 'B' WHEN NOT regexp_matches(trim(line), '^[#|]') AND length(trim(line)) <= 200 AND regexp_matches(trim(line), '{_RE["LEADER"]}') THEN 'L' ELSE 'X' END AS k FROM a WHERE NOT gone),
        i AS (SELECT *, k = 'L' OR (k = 'B' AND lag(k) OVER w = 'L' AND lead(k) OVER w = 'L') AS inside FROM m WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
        n AS (SELECT *, sum((NOT inside)::INT) OVER (PARTITION BY doc_id ORDER BY pos) AS g FROM (SELECT doc_id, pos, line, k, coalesce(inside, false) AS inside FROM i)),
        r AS (SELECT *, inside AND sum((k = 'L')::INT) OVER (PARTITION BY doc_id, g) >= 3 AS gone FROM n),
        t AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY pos) AS text FROM r WHERE NOT gone GROUP BY 1),
        c AS (SELECT doc_id, count(*) AS n FROM (SELECT doc_id, line FROM a WHERE gone UNION ALL SELECT doc_id, line FROM r WHERE gone) WHERE trim(line) <> '' GROUP BY 1)
        SELECT d.doc_id, md5(CASE WHEN d.text IS NOT NULL THEN coalesce(t.text, '') END) AS text_md5, coalesce(c.n, 0) AS n_removed FROM d LEFT JOIN t USING (doc_id) LEFT JOIN c USING (doc_id)"""),
}
