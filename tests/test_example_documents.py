"""Worked examples of the structure-aware chunkers, chunk dedup and cleaning: freshly written documents and what is due."""

import duckdb
import pytest
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skeinmill.operators.chunkdedup import Chunk, dedup_document_chunks
from skeinmill.operators.cleaning import HEADING, DECORATION, PAGE_MARK, _T, clean_for_pipeline, clean_markdown, finalize_for_kb, repeated_headers, with_nfc, without_headers
from skeinmill.operators.structure import chunk_structure, structure_chunks, values_sql
from skeinmill.plans import documents_on_tables as plans

_LONG = "一二三四五六七八九十" * 6
CHUNKED: dict[str, tuple[list[tuple[str, str, str]], list[tuple]]] = {
    "chunk_slides": (
        [
            ("visual", "ppt", "# Deck\n\n<!-- page: 1 -->\n## Intro\nhello\n\n<!-- page: 2 -->\n## Plan\nsteps"),
            ("textual", "ppt", "## Slide 1\n\nalpha\n\n---\n\n## Slide 2\n\nbeta"),
            ("big", "ppt", "## Slide 3\n" + "word " * 12),
            ("none", "ppt", "no heading\n---\nat all"),
        ],
        [
            ("visual", 0, "# Deck\n\n<!-- page: 1 -->", "page", "", None, None, 1, None, None, None, None), ("visual", 1, "## Intro\nhello\n\n<!-- page: 2 -->", "page", "Intro", None, None, 2, None, None, None, None),
            ("visual", 2, "## Plan\nsteps", "page", "Plan", None, None, None, None, None, None, None),
            ("textual", 0, "## Slide 1\n\nalpha\n\n---", "slide", "Slide 1", None, None, None, 1, None, None, None), ("textual", 1, "## Slide 2\n\nbeta", "slide", "Slide 2", None, None, None, 2, None, None, None),
            ("big", 0, "## Slide 3", "slide", "Slide 3", None, None, None, 3, None, None, 0), ("big", 1, "word word word word word word word word", "slide", "Slide 3", None, None, None, 3, None, None, 1),
            ("big", 2, "word word word word", "slide", "Slide 3", None, None, None, 3, None, None, 2),
            ("none", 0, "no heading\n---\nat all", "slide", "", None, None, None, None, None, None, None),
        ],
    ),
    "chunk_sheets": (
        [
            ("records", "excel", "## Sheet: A\n\nk：1 v：2\n\nk：3\n\n---\n\n## Sheet: B\n# note\n| a |  | a |\n|---|---|---|\n| 1 | 2 | 3 | 4 |\n|  |  | 5 |"),
            ("bare", "sheet", "one\n\ntwo"),
        ],
        [
            ("records", 0, "k：1 v：2", "table_record", "", None, None, None, None, "A", 0, None), ("records", 1, "k：3", "table_record", "", None, None, None, None, "A", 1, None),
            ("records", 2, "---", "table_record", "", None, None, None, None, "A", 2, None), ("records", 3, "a：1 字段：2 a_2：3", "table_row", "", None, None, None, None, "B", 0, None),
            ("records", 4, "a_2：5", "table_row", "", None, None, None, None, "B", 1, None), ("bare", 0, "one", "table_record", "", None, None, None, None, "", 0, None), ("bare", 1, "two", "table_record", "", None, None, None, None, "", 1, None),
        ],
    ),
    "chunk_image": (
        [("small", "image", "  seen text "), ("large", "image", _LONG)],
        [("small", 0, "seen text", "ocr", "", None, None, 1, None, None, None, None), ("large", 0, _LONG[:40], "ocr", "", None, None, 1, None, None, None, 0), ("large", 1, _LONG[30:], "ocr", "", None, None, 1, None, None, None, 1), ("large", 2, "", "", "", None, None, None, None, None, None, None)][:3],
    ),
    "chunk_word": (
        [("tree", "word", "intro\n\n# A\n\n## B\nplain\nname: x\n| h | i |\n|---|---|\n| 1 |  |\n| 2 | 3 |\n\nafter\n## C\n| lone |\n```\n# code\n```\nTitle\n=====\nend")],
        [
            ("tree", 0, "intro", "section", "intro", 0, "", None, None, None, None, None), ("tree", 1, "## B\nplain", "section", "B", 2, "A > B", None, None, None, None, None),
            ("tree", 2, "name: x", "table_record", "B", 2, "A > B", None, None, None, 0, None), ("tree", 3, "h：1", "table_row", "B", 2, "A > B", None, None, None, 1, None),
            ("tree", 4, "h：2 i：3", "table_row", "B", 2, "A > B", None, None, None, 2, None), ("tree", 5, "after", "section", "B", 2, "A > B", None, None, None, None, None),
            ("tree", 6, "## C", "section", "C", 2, "A > C", None, None, None, None, None), ("tree", 7, "| lone |", "section", "C", 2, "A > C", None, None, None, None, None),
            ("tree", 8, "```\n# code\n```", "section", "C", 2, "A > C", None, None, None, None, None), ("tree", 9, "Title\nend", "section", "Title", 1, "Title", None, None, None, None, None),
        ],
    ),
    "chunk_pdf": (
        [("headed", "pdf", "## Page 1\n\n# One\ntext\n\n## 第2章\n"), ("plain", "pdf", "First one. Second one! Third is a longer sentence. Last?"), ("marks", "pdf", "## Page 7\n")],
        [
            ("headed", 0, "## Page 1\n\n# One\ntext\n\n## 第2章", "section", "One", None, None, None, None, None, None, None), ("plain", 0, "First one. Second one!", "text", "", None, None, None, None, None, None, None),
            ("plain", 1, "Third is a longer sentence. Last?", "text", "", None, None, None, None, None, None, None), ("marks", 0, "## Page 7", "section", "Page 7", None, None, None, None, None, None, None),
        ],
    ),
    "chunk_headers": (
        [("biz", "structured_biz", "lead\n# T\n<!-- page: 4 -->\nbody\n#### deep\nmore"), ("sop", "sop_report", "only text"), ("long", "general", "# H\n" + "aaaa bbbb。" * 8), ("blank", "general", " \n")],
        [
            ("biz", 0, "lead", "section", "", None, None, None, None, None, None, None), ("biz", 1, "# T\n<!-- page: 4 -->\nbody\n#### deep\nmore", "section", "T", None, None, 4, None, None, None, None),
            ("sop", 0, "only text", "section", "", None, None, None, None, None, None, None),
            ("long", 0, "# H", "section", "H", None, None, None, None, None, None, 0), ("long", 1, "。".join(["aaaa bbbb"] * 4), "section", "H", None, None, None, None, None, None, 1), ("long", 2, "。".join(["aaaa bbbb"] * 4), "section", "H", None, None, None, None, None, None, 2),
        ],
    ),
}
_OUT = ("doc_id", "chunk_index", "text", "kind", "title", "level", "breadcrumb", "page", "slide", "sheet", "row_index", "part_index")


def _query(name: str):
    def run(spark, sf_dir: str) -> DataFrame:
        docs = spark.createDataFrame(CHUNKED[name][0], "doc_id string, doc_type string, text string")
        return chunk_structure(docs, 40, 10).select(*_OUT)

    return run


EXAMPLES = {name: (_query(name), values_sql(_OUT, rows)) for name, (_, rows) in CHUNKED.items()}


_NEAR = "this passage of the manual is long enough to be compared with the other passage word by word for all of its length"
DEDUPED: list[tuple[str, list[Chunk], list[int]]] = [
    ("exact", [("alpha  beta \\* gamma and more words than thirty", ""), ("other text that is longer than thirty characters", ""), (" alpha beta * gamma and more words than thirty ", "")], [0, 1]),
    ("heading", [("## Setup", ""), ("## Setup\nhow the thing is set up, at length", "Setup")], [1]),
    ("prefix", [("### Setup", ""), ("## Setup of more\nhow the thing is set up, at length", "Other")], [1]),
    ("titled", [("short one", "Same"), ("a quite different and longer text that says no such thing", "Same")], [1]),
    ("contained", [("said before", ""), ("what was said before is said again, and then some", "")], [1]),
    ("earlier", [("what was said before is said again, and then some", ""), ("said before", "")], [0, 1]),
    ("twins", [("# Only", ""), ("# Only", "")], [0]),
    ("twintitles", [("# Only", "Only"), ("# Only", "Only")], []),
    ("near", [("T\n" + _NEAR, "T"), ("T\n" + _NEAR + " indeed", "T"), ("T\n" + _NEAR + " too", "U")], [1, 2]),
    ("blank", [(" \n", ""), ("", "T")], []),
]


def chunk_dedup_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.createDataFrame([(d, [{"text": t, "title": n} for t, n in c]) for d, c, _ in DEDUPED], "doc_id string, chunks array<struct<text:string,title:string>>")
    return dedup_document_chunks(docs).select("doc_id", "chunk_index", "from_index")


EXAMPLES |= {
    "chunk_dedup_pipeline": (chunk_dedup_pipeline, values_sql(("doc_id", "chunk_index", "from_index"), [(d, n, i) for d, _, kept in DEDUPED for n, i in enumerate(kept)])),
}


HEADER_DOCS = [
    ("hf3", "Report\n<!-- page: 1 -->\nAcme Confidential Memo\nalpha\n<!-- page: 2 -->\nAcme Confidential Memo\nbeta\n<!-- page: 3 -->\nAcme Confidential Memo\ngamma"),
    ("hf2", "Report\n<!-- page: 1 -->\nSame line\nalpha\n<!-- page: 2 -->\nSame line\nbeta"),
    ("hf4", "## Page 1\nfoot\nx\n## Page 2\nfoot\ny\n## Page 3\nz\nonce"),
]


def clean_header_footer(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.createDataFrame(HEADER_DOCS, "doc_id string, text string")
    hit = with_nfc(docs, "text", "composed").withColumn("hit", repeated_headers(F.col("composed")))
    return hit.select("doc_id", without_headers(F.col("text"), F.col("composed"), F.col("hit")).alias("text"), F.array_join("hit", "|").alias("removed"))


_PARAGRAPH = "a paragraph of more than twenty characters"
_LINES9 = "这是一个足够长的中文行啊"
#: Documents for rules that the driver's tables have no lines for: (id, text, cleaned text, rules that fired).
CLEAN_DOCS: list[tuple[str | None, str | None, str | None, str]] = [
    ("null", None, None, ""), (None, "kept without an id", "kept without an id", ""), ("twice", "one text", "one text", ""), ("twice", "another text", "another text", ""), ("blank", " \n ", " \n ", ""),
    ("hf", HEADER_DOCS[0][1], "Report\n<!-- page: 1 -->\nalpha\n<!-- page: 2 -->\nbeta\n<!-- page: 3 -->\ngamma", "headers_footers"),
    ("nfc", "x1\n## Page 1\ncafe\u0301\na\n## Page 2\ncaf\u00e9 \nb\n## Page 3\n\u3000caf\u00e9\nc", "x1\n## Page 1\na\n## Page 2\nb\n## Page 3\nc", "headers_footers"),
    ("hash", "x1\n## Page 1\n#tag\n# Head\n## Page 2\n#tag\n# Head\n## Page 3\n#tag\n# Head", "x1\n## Page 1\n# Head\n## Page 2\n# Head\n## Page 3\n# Head", "headers_footers"),
    ("pn", "a1\n\u3000第 3 页\u3000\n4 / 9\n## Page 1\n共 12 项内容要点说明", "a1\n## Page 1\n共 12 项内容要点说明", "page_number"),
    ("close", "a1\n**Thanks!**\n## 谢谢\nQ & A\nthanks for a long and winding evening", "a1\nthanks for a long and winding evening", "closing"),
    ("noise", "a1\n内部资料请注意\n内部资料请注意保\n标题：内容", "a1\n内部资料请注意保\n标题：内容", "short_noise"),
    ("deco", "a1\n---\n═══\n░░\ntext ---", "a1\ntext ---", "decoration"), ("empty", "a1\n##\n- \n3.\n+ -\nb1", "a1\nb1", "empty_block"),
    ("dup", f"{_PARAGRAPH}\n\nshort one here\n\n {_PARAGRAPH}\n\nshort one here\n\n{_PARAGRAPH.replace(' ', '  ')}", f"{_PARAGRAPH}\n\nshort one here\n\nshort one here", "duplicate"),
    ("dupnfc", "re\u0301sume\u0301 of more than twenty\n\nr\u00e9sum\u00e9 of more than twenty", "re\u0301sume\u0301 of more than twenty", "duplicate"),
    ("guarded", "## A heading that is long enough\n\nb1\n\n## A heading that is long enough\n\nb2", "## A heading that is long enough\n\nb1\n\n## A heading that is long enough\n\nb2", ""),
    ("toc", "# T\n\n## Contents\n- a1\n- b1\n- c1\nbody", "# T\n\nbody", "toc"),
    ("legal", "a1\n\nb1\n\nCopyright 2020 somebody", "a1\n\nb1", "boilerplate"), ("far", "Copyright 2020 x1\n\na1\n\nb1\n\nc1\n\nd1\n\ne1", "Copyright 2020 x1\n\na1\n\nb1\n\nc1\n\nd1\n\ne1", ""),
]
FIRED = ("headers_footers", "page_number", "toc", "closing", "short_noise", "decoration", "empty_block", "duplicate", "boilerplate")


def clean_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents of every rule; the tables' own are cleaned by ``clean_documents``."""
    docs = spark.createDataFrame([d[:2] for d in CLEAN_DOCS], "doc_id string, text string")
    fired = F.concat_ws(" ", *[F.when(F.col(f"removed_{name}").isNotNull(), name) for name in FIRED])
    return clean_markdown(docs).select("doc_id", "text", fired.alias("fired"))


FINAL_TEXTS = [
    ("crlf", "a \r\nb\rc\u200b\n\n\n\nd\t", "a\nb\nc\n\nd"), ("nfc", "e\u0301", "\u00e9"), ("blank", " \n", ""), ("null", None, ""),
    ("table", "x\n| k | v |\n|---|:-:|\n| 1 | 2 |\n| 3 |\ny", "x\nk：1 v：2\nk：3\ny"), ("head", "x\n| k |\n|---|\ny", "x\ny"), ("bars", "| a | b |\n| c | d |", "| a | b |\n| c | d |"),
    ("html", "<h1>A title of a page</h1><p>text <b>bold</b></p><ul><li>one</li></ul>", "# A title of a page\n\ntext **bold**\n\n- one"),
    ("tag", "a<br>b", "a<br>b"),
]


def finalize_kb(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.createDataFrame([d[:2] for d in FINAL_TEXTS], "doc_id string, text string")
    return docs.select("doc_id", finalize_for_kb(F.col("text")).alias("text"))


PIPELINE_TEXTS = [("spaces", "a \t b\n\n\n\n\nc", "a b\n\nc"), ("bullet", "a\n - \n*\nb", "a\nb"), ("null", None, ""), ("zero", "\ufeffa\u2060b", "ab")]


def pipeline_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.createDataFrame([d[:2] for d in PIPELINE_TEXTS], "doc_id string, text string")
    return docs.select("doc_id", clean_for_pipeline(F.col("text")).alias("text"))


_HV = ", ".join("('{}', '{}')".format(d, t.replace("\n", "' || chr(10) || '")) for d, t in HEADER_DOCS)

EXAMPLES |= {
    "clean_header_footer": (clean_header_footer, f"""WITH d(doc_id, text) AS (VALUES {_HV}), l AS (SELECT doc_id, generate_subscripts(x, 1) AS pos, unnest(x) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS x FROM d)),
        p AS (SELECT *, sum(m) OVER (PARTITION BY doc_id ORDER BY pos) AS page, sum(m) OVER (PARTITION BY doc_id) AS marks FROM (SELECT *, regexp_matches(line, '{PAGE_MARK}')::INT AS m FROM l)),
        h AS (SELECT doc_id, {_T} AS line FROM p WHERE marks >= 3 AND {_T} <> '' AND length({_T}) <= 30 AND m = 0 AND NOT regexp_matches({_T}, '{HEADING}') AND NOT regexp_matches({_T}, '{DECORATION}')
          GROUP BY ALL HAVING count(DISTINCT page) >= greatest(2, round_even(0.5 * (max(marks) + 1), 0)))
        SELECT doc_id, string_agg(line, chr(10) ORDER BY pos) AS text, coalesce((SELECT string_agg(line, '|' ORDER BY line) FROM h WHERE h.doc_id = l.doc_id), '') AS removed
        FROM l WHERE NOT EXISTS (SELECT 1 FROM h WHERE h.doc_id = l.doc_id AND h.line = trim(l.line, ' ' || chr(9) || chr(13))) GROUP BY doc_id"""),
    "clean_pipeline": (clean_pipeline, values_sql(("doc_id", "text", "fired"), [(d, t, f) for d, _, t, f in CLEAN_DOCS])),
    "finalize_for_kb": (finalize_kb, values_sql(("doc_id", "text"), [(d, t) for d, _, t in FINAL_TEXTS])),
    "clean_for_pipeline": (pipeline_clean, values_sql(("doc_id", "text"), [(d, t) for d, _, t in PIPELINE_TEXTS])),
}


@pytest.mark.parametrize("name", sorted(EXAMPLES))
def test_example(spark, name):
    query, sql = EXAMPLES[name]
    df = query(spark, "")
    found = duckdb.connect().execute(sql)
    names = [d[0] for d in found.description]
    assert sorted(names) == sorted(df.columns)
    assert sorted(repr([r[c] for c in names]) for r in df.collect()) == sorted(repr(list(r)) for r in found.fetchall())


ODD_TEXTS = ["Costs: 12.50 (net)!", "", None, "\u3000 \n", "一二。三", "a. " * 400, "x" * 1300, ("word; " * 100 + "\n") * 3 + "y" * 600 + " end. 7", "p\n\n" + "q" * 513 + "\n\nr", "s" * 384 + " " * 500 + "t"]


@pytest.mark.parametrize("name", ["chunk_slides", "chunk_image"])
def test_whole_texts_are_cut_by_size(spark, tmp_path, name):
    turns = [(i // 4, i % 4, "user", t) for i, t in enumerate(ODD_TEXTS)]
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    spark.createDataFrame(list(enumerate(ODD_TEXTS)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    query, sql = plans.QUERIES[name]
    con = duckdb.connect()
    for table in ("conversations", "documents"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{tmp_path}/{table}.parquet/*.parquet'")
    got = query(spark, str(tmp_path))
    rows = sorted(map(repr, map(tuple, got.collect())))
    cur = con.execute(sql)
    assert [d[0] for d in cur.description] == got.columns
    assert rows == sorted(map(repr, cur.fetchall()))
    assert got.where("part_index > 0").count() > 5
    if name == "chunk_image":
        whole = [p.text for t in ODD_TEXTS for p in structure_chunks(t or "", "image")]
        md5s = sorted(r[0] for r in con.execute("SELECT md5(unnest($1))", [whole]).fetchall())
        assert sorted(r.text_md5 for r in got.collect()) == md5s and any("12.50" in t for t in whole)
