"""Queries of chunk routes, chunk dedup and cleaning over documents put together from the tables, with SQL that derives
what is due from the same rows by itself."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skeinmill.functions import toc
from skeinmill.operators.chunkdedup import dedup_document_chunks
from skeinmill.operators.cleaning import (
    _NOISE,
    _T,
    CLOSING_LINE,
    DECORATION,
    EMPTY_BLOCK,
    HEADING,
    PAGE_MARK,
    PAGE_NUMBER,
    CleanOptions,
    _sql_any,
    clean_for_pipeline,
    clean_markdown,
    finalize_for_kb,
    repeated_headers,
    with_nfc,
    without_headers,
)
from skeinmill.operators.structure import SEPARATORS, chunk_structure
from skeinmill.runtime import table

LARGE = 1 << 24  # characters; no piece of the documents that are not cut by size is longer
SIZE, OVERLAP = 512, 128
_OUT = ("doc_id", "chunk_index", "text_md5", "kind", "title", "level", "breadcrumb", "page", "slide", "sheet", "row_index", "part_index")


def _joined(rows: DataFrame, key: str, order: str, part, joint: str, kind: str) -> DataFrame:
    """One document a key: the parts of its rows in order."""
    parts = F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), part.alias("p")))), lambda x: x["p"])
    return rows.groupBy(F.col(key).cast("string").alias("doc_id")).agg(F.array_join(parts, joint).alias("text")).withColumn("doc_type", F.lit(kind))


def _chunks(docs: DataFrame, size: int = LARGE) -> DataFrame:
    return chunk_structure(docs, size, OVERLAP).withColumn("text_md5", F.md5(F.col("text").cast("binary"))).select(*_OUT)


def _plain(text):
    """A turn's text on one line, without the marks that the routes look for."""
    return F.btrim(F.regexp_replace(text, r"[^A-Za-zÀ-ÿ ]+", " "))


_SQL_PLAIN = "trim(regexp_replace(text, '[^A-Za-zÀ-ÿ ]+', ' ', 'g'), ' ')"


_BLANKS = "' \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0                　'"  # what str.strip removes


def _sql_parts(pieces: str) -> str:
    """CTEs that cut the texts ``t`` of ``pieces`` (doc, piece, t and facts) to ``SIZE``: ``parts`` has doc, piece, n (number of the part) and t.

    At each separator, from coarse to fine, what is too long is split, and neighbours are joined again as long as they fit.
    """
    out = f"c0 AS (SELECT doc, piece, []::INT[] AS path, t FROM {pieces})"
    for k, mark in enumerate(SEPARATORS, 1):
        joint = "'" + mark.replace("\n", "' || chr(10) || '") + "'"
        units = f"list_transform(list_filter(list_transform(string_split(t, {joint}), lambda x: trim(x, {_BLANKS})), lambda x: x <> ''), lambda x: [x])"
        fits = f"len(a) > 0 AND length(a[-1]) + length({joint}) + length(x[1]) <= {SIZE}"
        cut = f"list_reduce({units}, lambda a, x: CASE WHEN {fits} THEN a[:-2] || [a[-1] || {joint} || x[1]] ELSE a || x END, []::VARCHAR[])"
        if not mark:
            cut = f"list_transform(range(0, length(t), {SIZE - OVERLAP}), lambda a: substr(t, a + 1, {SIZE}))"
        whole = f"SELECT doc, piece, path, CASE WHEN length(t) > {SIZE} THEN {cut} ELSE [t] END AS l FROM c{k - 1}"
        out += f",\n    c{k} AS (SELECT doc, piece, list_append(path, j::INT) AS path, t FROM (SELECT doc, piece, path, unnest(l) AS t, generate_subscripts(l, 1) AS j FROM ({whole})))"
    return out + f""",
    parts AS (SELECT doc, piece, n, trim(t, {_BLANKS}) AS t FROM (SELECT *, (row_number() OVER (PARTITION BY doc, piece ORDER BY path) - 1)::INT AS n FROM c{len(SEPARATORS)}) WHERE trim(t, {_BLANKS}) <> '')"""


def chunk_slides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A deck a conversation, a slide a turn with its whole text, long ones in parts. The SQL knows that no turn has a heading or a page mark of its own."""
    said = table(spark, sf_dir, "conversations")
    slide = F.concat(F.lit("## Slide "), F.col("turn") + 1, F.lit("\n\n"), F.coalesce("text", F.lit("")))
    return _chunks(_joined(said, "conv_id", "turn", slide, "\n\n---\n\n", "ppt"), SIZE)


_SLIDES = f"""WITH s AS (SELECT conv_id AS doc, turn AS piece, trim('## Slide ' || (turn + 1) || chr(10) || chr(10) || coalesce(text, '') || CASE WHEN lead(turn) OVER (PARTITION BY conv_id ORDER BY turn) IS NULL THEN '' ELSE chr(10) || chr(10) || '---' END, {_BLANKS}) AS t FROM conversations),
    {_sql_parts("s")}
    SELECT doc::VARCHAR AS doc_id, (row_number() OVER (PARTITION BY doc ORDER BY piece, n) - 1)::INT AS chunk_index, md5(parts.t) AS text_md5, 'slide' AS kind, 'Slide ' || (piece + 1) AS title, NULL::INT AS level, NULL::VARCHAR AS breadcrumb,
      NULL::INT AS page, (piece + 1)::INT AS slide, NULL::VARCHAR AS sheet, NULL::INT AS row_index, CASE WHEN length(s.t) > {SIZE} THEN n END AS part_index FROM parts JOIN s USING (doc, piece)"""


def chunk_sheets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A workbook a size, a sheet a brand in it, a record a part."""
    part = table(spark, sf_dir, "part")
    record = F.concat(F.lit("name："), "p_name", F.lit(" key："), "p_partkey")
    sheets = part.groupBy("p_size", "p_brand").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", record.alias("r")))), lambda x: x["r"]), "\n").alias("rows"))
    return _chunks(_joined(sheets, "p_size", "p_brand", F.concat(F.lit("## Sheet: "), "p_brand", F.lit("\n\n"), "rows"), "\n\n", "excel"))


_SHEETS = """SELECT p_size::VARCHAR AS doc_id, (row_number() OVER (PARTITION BY p_size ORDER BY p_brand, p_partkey) - 1)::INT AS chunk_index, md5('name：' || p_name || ' key：' || p_partkey) AS text_md5, 'table_record' AS kind, '' AS title,
    NULL::INT AS level, NULL::VARCHAR AS breadcrumb, NULL::INT AS page, NULL::INT AS slide, p_brand AS sheet, (row_number() OVER (PARTITION BY p_size, p_brand ORDER BY p_partkey) - 1)::INT AS row_index, NULL::INT AS part_index FROM part"""


def chunk_image(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each whole document as the text of an image, long ones in parts."""
    docs = table(spark, sf_dir, "documents")
    return _chunks(docs.select("doc_id", F.lit("image").alias("doc_type"), F.concat(F.lit(" \n"), F.col("text")).alias("text")), SIZE)


_IMAGE = f"""WITH s AS (SELECT doc_id AS doc, 0 AS piece, trim(text, {_BLANKS}) AS t FROM documents),
    {_sql_parts("s")}
    SELECT doc::VARCHAR AS doc_id, (row_number() OVER (PARTITION BY doc ORDER BY n) - 1)::INT AS chunk_index, md5(parts.t) AS text_md5, 'ocr' AS kind, '' AS title, NULL::INT AS level, NULL::VARCHAR AS breadcrumb,
      1 AS page, NULL::INT AS slide, NULL::VARCHAR AS sheet, NULL::INT AS row_index, CASE WHEN length(s.t) > {SIZE} THEN n END AS part_index FROM parts JOIN s USING (doc, piece)"""


def chunk_word(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document a region: its nations, and below each one a line and a table of its suppliers."""
    nation, supplier = table(spark, sf_dir, "nation"), table(spark, sf_dir, "supplier")
    row = F.concat(F.lit("| "), "s_suppkey", F.lit(" | "), "s_name", F.lit(" |"))
    rows = supplier.groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("s_suppkey", row.alias("r")))), lambda x: x["r"]), "\n").alias("rows"))
    body = F.concat(F.lit("# "), "n_name", F.lit("\nabout "), F.lower("n_name"), F.lit("\n\n## Suppliers\n"), F.coalesce(F.concat(F.lit("| key | name |\n|---|---|\n"), "rows"), F.lit("none")))
    return _chunks(_joined(nation.join(rows, "n_nationkey", "left"), "n_regionkey", "n_nationkey", body, "\n", "word"))


_WORD = """WITH p AS (SELECT n_regionkey AS d, n_nationkey AS k, 0 AS o, 0 AS s, '# ' || n_name || chr(10) || 'about ' || lower(n_name) AS t, n_name AS title, 1 AS level, n_name AS crumb, NULL::INT AS r FROM nation
      UNION ALL SELECT n_regionkey, n_nationkey, 1, 0, '## Suppliers', 'Suppliers', 2, n_name || ' > Suppliers', NULL FROM nation WHERE n_nationkey IN (SELECT s_nationkey FROM supplier)
      UNION ALL SELECT n_regionkey, n_nationkey, 1, 0, '## Suppliers' || chr(10) || 'none', 'Suppliers', 2, n_name || ' > Suppliers', NULL FROM nation WHERE n_nationkey NOT IN (SELECT s_nationkey FROM supplier)
      UNION ALL SELECT n_regionkey, n_nationkey, 2, s_suppkey, 'key：' || s_suppkey || ' name：' || s_name, 'Suppliers', 2, n_name || ' > Suppliers', (row_number() OVER (PARTITION BY n_nationkey ORDER BY s_suppkey) - 1)::INT FROM nation JOIN supplier ON s_nationkey = n_nationkey)
    SELECT d::VARCHAR AS doc_id, (row_number() OVER (PARTITION BY d ORDER BY k, o, s) - 1)::INT AS chunk_index, md5(t) AS text_md5, CASE WHEN o = 2 THEN 'table_row' ELSE 'section' END AS kind, title, level, crumb AS breadcrumb,
      NULL::INT AS page, NULL::INT AS slide, NULL::VARCHAR AS sheet, r AS row_index, NULL::INT AS part_index FROM p"""


def _headed(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    """A chapter a turn, a page mark in every third, and before every fourth turn a heading that is only a chapter's number."""
    said = table(spark, sf_dir, "conversations")
    turn = F.col("turn")
    part = F.concat(F.when(turn % 4 == 3, "## Page 9\n\n").otherwise(""), F.lit("# Turn "), turn, F.lit("\n"), F.when(turn % 3 == 0, F.concat(F.lit("<!-- page: "), turn, F.lit(" -->\n"))).otherwise(""), F.lit("said: "), _plain(F.col("text")))
    return _chunks(_joined(said, "conv_id", "turn", part, "\n\n", kind))


def chunk_pdf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _headed(spark, sf_dir, "pdf")


def chunk_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _headed(spark, sf_dir, "structured_biz")


_HEADED = f"""SELECT conv_id::VARCHAR AS doc_id, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1)::INT AS chunk_index,
    md5(trim(CASE WHEN turn % 4 = 3 THEN '## Page 9' || chr(10) || chr(10) ELSE '' END || '# Turn ' || turn || chr(10) || CASE WHEN turn % 3 = 0 THEN '<!-- page: ' || turn || ' -->' || chr(10) ELSE '' END || 'said: ' || {_SQL_PLAIN}, ' ')) AS text_md5, 'section' AS kind, 'Turn ' || turn AS title,
    NULL::INT AS level, NULL::VARCHAR AS breadcrumb, CASE WHEN turn % 3 = 0 THEN turn::INT END AS page, NULL::INT AS slide, NULL::VARCHAR AS sheet, NULL::INT AS row_index, NULL::INT AS part_index FROM conversations"""


def chunk_dedup_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long turns as chunks, then all again with other white space, and every second once more with a word at its end."""
    said = table(spark, sf_dir, "conversations").withColumn("p", _plain(F.col("text"))).where("length(p) >= 200")
    chunk = lambda at, text: F.struct(at.cast("int").alias("at"), text.alias("text"), F.concat(F.lit("T"), "turn").alias("title"))
    turn = F.col("turn")
    copies = F.array_compact(F.array(chunk(turn, F.col("p")), chunk(turn + 1000, F.concat(F.lit(" \n"), F.regexp_replace("p", " ", "\n"))), F.when(turn % 2 == 0, chunk(turn + 2000, F.concat("p", F.lit(" indeed"))))))
    listed = said.select("conv_id", F.explode(copies).alias("c")).groupBy("conv_id").agg(F.array_sort(F.collect_list("c")).alias("c"))
    docs = listed.select(F.col("conv_id").alias("doc_id"), F.transform("c", lambda x: F.struct(x["text"].alias("text"), x["title"].alias("title"))).alias("chunks"))
    return dedup_document_chunks(docs).select("doc_id", "chunk_index", F.col("title"), F.md5(F.col("text").cast("binary")).alias("text_md5"))


_DEDUPED = f"""WITH p AS (SELECT conv_id, turn, {_SQL_PLAIN} AS p FROM conversations), l AS (SELECT * FROM p WHERE length(p) >= 200),
    k AS (SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN 2000 ELSE 0 END + turn AS place, CASE WHEN turn % 2 = 0 THEN p || ' indeed' ELSE p END AS p FROM l)
    SELECT conv_id::VARCHAR AS doc_id, (row_number() OVER (PARTITION BY conv_id ORDER BY place) - 1)::INT AS chunk_index, 'T' || turn AS title, md5(p) AS text_md5 FROM k"""


# Cleaning ------------------------------------------------------------------------
def _paged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document a conversation: a page a turn, with a line that all pages have and one that every second has."""
    turn = F.col("turn")
    page = F.concat(F.lit("<!-- page: "), turn, F.lit(" -->\nAcme memo "), F.col("conv_id") % 4, F.lit("\n"), F.when(turn % 2 == 0, "even foot\n").otherwise(""), F.col("text"))
    return _joined(table(spark, sf_dir, "conversations"), "conv_id", "turn", page, "\n", "").drop("doc_type")


_SQL_PAGED = """d AS (SELECT conv_id::VARCHAR AS doc_id, string_agg('<!-- page: ' || turn || ' -->' || chr(10) || 'Acme memo ' || conv_id % 4 || chr(10) || CASE WHEN turn % 2 = 0 THEN 'even foot' || chr(10) ELSE '' END || text, chr(10) ORDER BY turn) AS text FROM conversations GROUP BY 1)"""


def clean_header_footer(spark: SparkSession, sf_dir: str) -> DataFrame:
    hit = with_nfc(_paged(spark, sf_dir), "text", "composed").withColumn("hit", repeated_headers(F.col("composed")))
    return hit.select("doc_id", F.md5(without_headers(F.col("text"), F.col("composed"), F.col("hit")).cast("binary")).alias("text_md5"), F.array_join("hit", "|").alias("removed"))


_HEADERS = f"""WITH {_SQL_PAGED}, l AS (SELECT doc_id, generate_subscripts(x, 1) AS pos, unnest(x) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS x FROM d)),
    p AS (SELECT *, sum(m) OVER (PARTITION BY doc_id ORDER BY pos) AS page, sum(m) OVER (PARTITION BY doc_id) AS marks FROM (SELECT *, regexp_matches(line, '{PAGE_MARK}')::INT AS m FROM l)),
    h AS (SELECT doc_id, {_T} AS line FROM p WHERE marks >= 3 AND {_T} <> '' AND length({_T}) <= 30 AND m = 0 AND NOT regexp_matches({_T}, '{HEADING}') AND NOT regexp_matches({_T}, '{DECORATION}')
      GROUP BY ALL HAVING count(DISTINCT page) >= greatest(2, round_even(0.5 * (max(marks) + 1), 0)))
    SELECT doc_id, md5(string_agg(line, chr(10) ORDER BY pos)) AS text_md5, coalesce((SELECT string_agg(line, '|' ORDER BY line) FROM h WHERE h.doc_id = l.doc_id), '') AS removed
    FROM l WHERE NOT EXISTS (SELECT 1 FROM h WHERE h.doc_id = l.doc_id AND h.line = {_T.replace("line", "l.line")}) GROUP BY doc_id"""


def _cleaned(docs: DataFrame, options: CleanOptions) -> DataFrame:
    done = clean_markdown(docs, options)
    return done.select("doc_id", F.md5(F.col("text").cast("binary")).alias("text_md5"))


def clean_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rules over all documents. The SQL has those that find anything there: no document has page marks or paragraphs."""
    return _cleaned(table(spark, sf_dir, "documents").select("doc_id", "text"), CleanOptions())


def clean_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Some rules switched off: line rules alone, with a noise limit of its own."""
    off = CleanOptions(headers_footers=False, toc=False, closing=False, duplicates=False, boilerplate=False, noise_least_cjk=8)
    docs = table(spark, sf_dir, "documents").unionByName(table(spark, sf_dir, "documents").select((-1 - F.col("doc_id")).alias("doc_id"), F.concat_ws("\n", F.lit("4 / 9"), F.lit("---"), F.regexp_replace("text", " ", "\n"), F.lit("Q & A"), F.lit("##")).alias("text"), "lang", "source", "n_chars"))
    return _cleaned(docs.select("doc_id", "text"), off)


_CLOSE = "trim(line, ' ' || chr(9) || chr(13) || '*_~`')"
_NUMBER = f"({_T} <> '' AND NOT starts_with({_T}, '#') AND {_sql_any(_T, PAGE_NUMBER)})"
_REST = f"NOT ({_NOISE}) AND NOT regexp_matches(line, '{DECORATION}') AND NOT {_sql_any('line', EMPTY_BLOCK)}"
_COLLAPSED = r"trim(regexp_replace(coalesce(string_agg(line, chr(10) ORDER BY pos), ''), '\n{3,}', chr(10) || chr(10), 'g'), ' ' || chr(9) || chr(13) || chr(10))"
_RE = {k: getattr(toc, k).replace("(?iU)", "(?i)").replace("(?U)", "") for k in ("TOC_HEADING", "LIST_ITEM", "PAGE_MARK", "LEADER")}
_LINES = "generate_subscripts(x, 1) AS pos, unnest(x) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS x FROM"
_CLEANED = f"""WITH l AS (SELECT doc_id, {_LINES} documents)), n0 AS (SELECT * FROM l WHERE NOT {_NUMBER}),
    k AS (SELECT *, CASE WHEN regexp_matches(line, '{_RE["TOC_HEADING"]}') THEN 'H' WHEN trim(line) = '' THEN 'B' WHEN regexp_matches(line, '{_RE["PAGE_MARK"]}') THEN 'M' WHEN regexp_matches(line, '{_RE["LIST_ITEM"]}') THEN 'I' ELSE 'X' END AS k FROM n0),
    g AS (SELECT *, sum((k IN ('H', 'X'))::INT) OVER (PARTITION BY doc_id ORDER BY pos) AS g FROM k),
    a AS (SELECT *, max((k = 'H')::INT) OVER w = 1 AND sum((k = 'I')::INT) OVER w >= 3 AND k <> 'M' AS gone FROM g WINDOW w AS (PARTITION BY doc_id, g)),
    m AS (SELECT doc_id, pos, line, CASE WHEN trim(line) = '' THEN 'B' WHEN NOT regexp_matches(trim(line), '^[#|]') AND length(trim(line)) <= 200 AND regexp_matches(trim(line), '{_RE["LEADER"]}') THEN 'L' ELSE 'X' END AS k FROM a WHERE NOT gone),
    i AS (SELECT *, k = 'L' OR (k = 'B' AND lag(k) OVER w = 'L' AND lead(k) OVER w = 'L') AS inside FROM m WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
    n AS (SELECT *, sum((NOT inside)::INT) OVER (PARTITION BY doc_id ORDER BY pos) AS g FROM (SELECT doc_id, pos, line, k, coalesce(inside, false) AS inside FROM i)),
    r AS (SELECT *, inside AND sum((k = 'L')::INT) OVER (PARTITION BY doc_id, g) >= 3 AS gone FROM n),
    t AS (SELECT doc_id, {_COLLAPSED} AS text FROM r WHERE NOT gone AND NOT ({_CLOSE} <> '' AND length({_CLOSE}) <= 30 AND regexp_matches({_CLOSE}, '{CLOSING_LINE}')) AND {_REST} GROUP BY 1)
    SELECT d.doc_id, md5(CASE WHEN trim(d.text, ' ' || chr(9) || chr(13) || chr(10)) = '' THEN d.text ELSE coalesce(t.text, '') END) AS text_md5 FROM documents d LEFT JOIN t USING (doc_id)"""
_SOME = f"""WITH d AS (SELECT doc_id, text FROM documents UNION ALL SELECT -1 - doc_id, concat_ws(chr(10), '4 / 9', '---', replace(text, ' ', chr(10)), 'Q & A', '##') FROM documents), l AS (SELECT doc_id, {_LINES} d)),
    t AS (SELECT doc_id, {_COLLAPSED} AS text FROM l WHERE NOT {_NUMBER} AND {_REST} GROUP BY 1)
    SELECT d.doc_id, md5(CASE WHEN trim(d.text, ' ' || chr(9) || chr(13) || chr(10)) = '' THEN d.text ELSE coalesce(t.text, '') END) AS text_md5 FROM d LEFT JOIN t USING (doc_id)"""


def _untidy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with line ends of other systems, accents apart, invisible characters, blank runs and orphan bullets."""
    text = F.regexp_replace(F.regexp_replace(F.regexp_replace("text", "é", "é"), "\n", "\r\n"), r"\. ", ". \t​\n\n\n\n - \n")
    return table(spark, sf_dir, "documents").select("doc_id", text.alias("text"))


_SQL_UNTIDY = "SELECT doc_id, replace(replace(replace(text, 'é', 'e' || chr(769)), chr(10), chr(13) || chr(10)), '. ', '. ' || chr(9) || chr(8203) || chr(10) || chr(10) || chr(10) || chr(10) || ' - ' || chr(10)) AS text FROM documents"


def finalize_kb(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _untidy(spark, sf_dir).select("doc_id", F.md5(finalize_for_kb(F.col("text"), html=False).cast("binary")).alias("text_md5"))


def pipeline_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _untidy(spark, sf_dir).select("doc_id", F.md5(clean_for_pipeline(F.col("text")).cast("binary")).alias("text_md5"))


def _finalized(text: str) -> str:
    """SQL of finalisation for texts without tables."""
    ends = rf"replace(replace(replace({text}, chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(8203), '')"
    return rf"trim(regexp_replace(nfc_normalize(regexp_replace({ends}, '[ \t]+(\n|$)', '\1', 'g')), '\n{{3,}}', chr(10) || chr(10), 'g'), ' ' || chr(9) || chr(10))"


_FINAL = f"SELECT doc_id, md5({_finalized('text')}) AS text_md5 FROM ({_SQL_UNTIDY})"
_PIPED = rf"""WITH u AS ({_SQL_UNTIDY}), s AS (SELECT doc_id, regexp_replace(replace(regexp_replace(regexp_replace(text, '[ \t]+', ' ', 'g'), '\n{{4,}}', chr(10) || chr(10) || chr(10), 'g'), chr(8203), ''), '[ \t\r]{{2,}}', ' ', 'g') AS text FROM u),
    l AS (SELECT doc_id, {_LINES} s)), j AS (SELECT doc_id, trim(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT regexp_matches(line, '^\s*[-*]\s*$')), ''), ' ' || chr(9) || chr(10) || chr(13)) AS text FROM l GROUP BY 1)
    SELECT doc_id, md5({_finalized('text')}) AS text_md5 FROM j"""
QUERIES = {
    "chunk_slides": (chunk_slides, _SLIDES),
    "chunk_sheets": (chunk_sheets, _SHEETS),
    "chunk_image": (chunk_image, _IMAGE),
    "chunk_word": (chunk_word, _WORD),
    "chunk_pdf": (chunk_pdf, _HEADED),
    "chunk_headers": (chunk_headers, _HEADED),
    "chunk_dedup_pipeline": (chunk_dedup_pipeline, _DEDUPED),
    "clean_header_footer": (clean_header_footer, _HEADERS),
    "clean_documents": (clean_documents, _CLEANED),
    "clean_pipeline": (clean_pipeline, _SOME),
    "finalize_for_kb": (finalize_kb, _FINAL),
    "clean_for_pipeline": (pipeline_clean, _PIPED),
}
