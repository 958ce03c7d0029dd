"""Markdown cleaning rules as column expressions over lines, and the pipeline that applies them in order.

Each rule is a predicate on a line; ``drop_lines`` filters the lines of a text
with it, in one pass inside the JVM. Rules that look across lines (headers and
footers, duplicate paragraphs) sort small keys inside the row. Every row is
cleaned by itself, so nothing is shuffled and null or repeated ids need no rule.
Only the composed form of characters (NFC), which the rules compare lines by,
comes from Python, in Arrow batches.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from skeinmill.functions.toc import remove_toc
from skeinmill.operators.tables import tables_to_records
from skeinmill.runtime import table

#: White space of Unicode, which ends of lines are stripped of; fixed values.
WHITE = " \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"

# The line patterns of the cleaning rules.
PAGE_NUMBER = (
    r"^\s*\d{1,4}\s*$",
    r"^\s*(第\s*)?\d{1,4}\s*(/\s*\d{1,4})?\s*页?\s*(共\s*\d{1,4}\s*页)?\s*$",
    r"(?i)^\s*Page\s*\d{1,4}(\s*of\s*\d{1,4})?\s*$",
    r"(?i)^\s*p\.?\s*\d{1,4}\s*$",
    r"(?i)^\s*pp\.?\s*\d{1,4}\s*[-–—]\s*\d{1,4}\s*$",
    r"^\s*[-–—·]\s*\d{1,4}\s*[-–—·]\s*$",
)
DECORATION = r"^\s*(?:[-*_=]{3,}|[═━─—…·–│┃]{3,}|[─-▟]{2,})\s*$"
EMPTY_BLOCK = (r"^\s*#{1,6}\s*$", r"^\s*[-*+]\s*$", r"^\s*[-*+](\s*[-*+])+\s*$", r"^\s*\d+\s*[\.\)、]\s*$")
PAGE_MARK = r"(?i)^\s*(?:<!--\s*page\s*:\s*\d+\s*-->|##\s+Page\s+\d+)\s*$"
HEADING = r"^\s*#{1,6}\s+\S"
STRUCTURE = r"^\s*(#{1,6}\s+|[-*+]\s+|\d+\s*[\.\)、]\s+|>\s*|\|)"
CLOSING_TAIL = r"[\s您们的大家各位我们你观看聆听倾听阅读关注支持配合参与理解指导鼓励陪伴时间耐心莅临出席.,!?！。，、；：]*"
CLOSING = (
    r"thank\s*(?:you|s)?[\s.,!?！。，]*",
    r"many\s+thanks[\s.,!?！。，]*",
    r"thanks\s+for\s+(?:your\s+)?(?:attention|listening|watching|time)[\s.,!?！。，]*",
    r"(?:the\s+)?end[\s.,!?！。，]*",
    r"fin[\s.,!?！。，]*",
    r"q\s*&\s*a[\s.,!?！。，]*",
    r"questions?\s*\??[\s.,!?！。，]*",
    r"谢\s*谢" + CLOSING_TAIL,
    r"感\s*谢" + CLOSING_TAIL,
    r"致\s*谢" + CLOSING_TAIL,
    r"完\s*[毕结]?[\s.,!?！。，]*",
)
CLOSING_LINE = r"(?i)^\s*#{0,6}\s*(?:" + "|".join(CLOSING) + r")\s*$"
BOILERPLATE = (
    r"本文档?仅(供|限)",
    r"未经.{0,8}(允许|授权|许可|同意).{0,8}(不得|禁止|严禁)",
    r"版权所有",
    r"保留所有权利",
    r"免责声明",
    r"保密(协议|条款|声明)",
    r"商业秘密",
    r"知识产权(归|所有)",
    r"(?i)Copyright\s*(©|\(c\))?",
    r"(?i)All\s+Rights\s+Reserved",
    r"(?i)\bConfidential\b",
    r"(?i)\bDisclaimer\b",
    r"(?i)\bProprietary\b",
)


def _strip(line: Column, more: str = "") -> Column:
    return F.btrim(line, F.lit(WHITE + more))


def _any(line: Column, patterns) -> Column:
    found = F.lit(False)
    for p in patterns:
        found = found | line.rlike("(?U)" + p)
    return found


def is_page_mark(line: Column) -> Column:
    return _any(line, (PAGE_MARK,))


def is_heading(line: Column) -> Column:
    return _any(line, (HEADING,))


def is_page_number(line: Column) -> Column:
    s = _strip(line)
    return (s != "") & ~s.startswith("#") & _any(s, PAGE_NUMBER)


def is_decoration(line: Column) -> Column:
    return _any(line, (DECORATION,))


def is_empty_block(line: Column) -> Column:
    return _any(line, EMPTY_BLOCK)


def is_closing(line: Column) -> Column:
    s = _strip(line, "*_~`")
    return (s != "") & (F.length(s) <= 30) & _any(s, (CLOSING_LINE,))


def is_short_noise(line: Column, least: int = 8) -> Column:
    cjk = F.regexp_count(line, F.lit(r"[一-鿿]"))
    return ~is_page_mark(line) & ~_any(line, (STRUCTURE,)) & ~line.rlike(r"[:：A-Za-z0-9]") & (cjk > 0) & (cjk < least)


def is_boilerplate(paragraph: Column) -> Column:
    return (_strip(paragraph) != "") & (F.length(paragraph) <= 300) & _any(paragraph, BOILERPLATE)


RULES = {"page_number": is_page_number, "closing": is_closing, "short_noise": is_short_noise, "decoration": is_decoration, "empty_block": is_empty_block}


def drop_lines(text: Column, rule) -> tuple[Column, Column]:
    """The text without the lines that ``rule`` hits, and their number (null when none was hit)."""
    lines = F.split(text, "\n", -1)
    kept = F.filter(lines, lambda x: ~rule(x))
    removed = F.size(lines) - F.size(kept)
    return F.array_join(kept, "\n"), F.when(removed > 0, removed)


def collapse(text: Column) -> Column:
    return _strip(F.regexp_replace(text, r"\n{3,}", "\n\n"))


def finalize_whitespace(text: Column) -> Column:
    """CRLF to LF, zero-width characters out, line ends trimmed, blank runs collapsed, text trimmed."""
    t = F.regexp_replace(F.regexp_replace(text, r"\r\n?", "\n"), "[​‌‍﻿]", "")
    return collapse(F.regexp_replace(t, r"(?m)[ \t]+$", ""))


def composed(text: str | None) -> str | None:
    return text if text is None or text.isascii() else unicodedata.normalize("NFC", text)


def with_nfc(docs: DataFrame, text_col: str, out: str) -> DataFrame:
    """All rows and columns of ``docs`` with ``text_col`` in NFC as the last one, null for null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text_col)).to_pylist()
            yield batch.append_column(out, pa.array([composed(t) for t in texts], pa.string()))

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField(out, StringType())]))


def _let(value: Column, body) -> Column:
    """``body`` of a value that is worked out once a row."""
    return F.transform(F.array(value), body)[0]


#: Whole lines that are page marks, to split a text at; the flags keep to ``\\n`` as the only end of a line.
_MARK_LINES = r"(?iUdm)^[^\S\n]*(?:<!--[^\S\n]*page[^\S\n]*:[^\S\n]*\d+[^\S\n]*-->|##[^\S\n]+Page[^\S\n]+\d+)[^\S\n]*$"


def repeated_headers(composed: Column, threshold: float = 0.5, longest: int = 30, least_marks: int = 3) -> Column:
    """Short lines (stripped, of a text in NFC) that stand on at least max(2, half) of its pages (marks + 1), sorted.

    A page counts a line once. The sorted lines of all pages hold a line that
    often if the one ``cutoff - 1`` places on is the same.
    """
    fits = lambda x: (x != "") & (F.length(x) <= longest) & ~is_heading(x) & ~is_decoration(x)
    short = lambda page: F.array_distinct(F.filter(F.transform(F.split(page, "\n", -1), lambda x: _strip(x)), fits))

    def often(pages: Column) -> Column:
        cutoff = F.greatest(F.lit(2), F.bround(threshold * F.size(pages))).cast("int")
        every = lambda s: F.array_distinct(F.filter(s["lines"], lambda x, i: F.get(s["lines"], i + s["cutoff"] - 1) == x))
        return _let(F.struct(F.array_sort(F.flatten(F.transform(pages, short))).alias("lines"), cutoff.alias("cutoff")), every)

    none = F.array().cast("array<string>")
    return _let(F.split(composed, _MARK_LINES, -1), lambda pages: F.when(F.size(pages) > least_marks, often(pages)).otherwise(none))


def without_headers(text: Column, composed: Column, headers: Column) -> Column:
    """The lines of ``text`` whose composed, stripped form is none of ``headers``."""
    sides = F.struct(F.split(text, "\n", -1).alias("own"), F.split(composed, "\n", -1).alias("composed"), headers.alias("gone"))
    kept = lambda s: F.filter(s["own"], lambda x, i: ~F.array_contains(s["gone"], _strip(F.get(s["composed"], i))))
    return F.when(F.size(headers) > 0, F.array_join(_let(sides, kept), "\n")).otherwise(text)


def is_protected(paragraph: Column) -> Column:
    """Blank, all page marks or all headings."""
    lines = F.filter(F.split(paragraph, "\n", -1), lambda x: _strip(x) != "")
    return _let(lines, lambda own: F.forall(own, is_page_mark) | F.forall(own, is_heading))


def unique_paragraphs(text: Column, composed: Column, least_chars: int = 20, least_times: int = 2, separator: str = "\n\n") -> Column:
    """struct(text, removed): the first of equal paragraphs stays, others of at least ``least_chars`` characters go.

    Paragraphs are compared by their lines in NFC, stripped, white space folded
    and blank ones left out. Protected paragraphs stay and never stand for
    others, though they count among the ``least_times``. Sorted by key and place,
    a paragraph is a repeat if its predecessor has its key.
    """
    folded = lambda line: F.regexp_replace(_strip(line), r"(?U)\s+", " ")
    key = lambda p: F.array_join(F.filter(F.transform(F.split(p, "\n", -1), folded), lambda x: x != ""), "\n")
    sides = F.struct(F.split(text, separator, -1).alias("own"), F.split(composed, separator, -1).alias("composed"))
    keyed = _let(sides, lambda s: F.transform(s["own"], lambda p, i: F.struct(key(F.get(s["composed"], i)).alias("k"), is_protected(p).alias("g"), i.alias("i"), p.alias("p"))))

    def parted(rows: Column) -> Column:
        able = F.array_sort(F.filter(rows, lambda x: F.length(x["k"]) >= least_chars))
        rest = F.filter(rows, lambda x: F.length(x["k"]) < least_chars)

        def first(able: Column) -> Column:
            same = lambda x, j: F.coalesce((F.get(able, j)["k"] == x["k"]) & ~F.get(able, j)["g"], F.lit(False))
            enough = lambda x: F.size(F.filter(able, lambda y: y["k"] == x["k"])) >= least_times if least_times > 2 else F.lit(True)
            return F.filter(able, lambda x, n: x["g"] | ~same(x, n - 1) | ~enough(x))

        return F.array_sort(F.transform(F.concat(_let(able, first), rest), lambda x: F.struct(x["i"].alias("i"), x["p"].alias("p"))))

    kept = _let(F.struct(keyed.alias("rows"), text.alias("text")), lambda s: F.struct(parted(s["rows"]).alias("rows"), F.size(s["rows"]).alias("n"), s["text"].alias("text")))
    joined = lambda s: F.array_join(F.transform(s["rows"], lambda x: x["p"]), separator)
    squeezed = lambda t: F.regexp_replace(t, r"\n{3,}", "\n\n") if separator == "\n\n" else t
    gone = lambda s: s["n"] - F.size(s["rows"])
    return _let(kept, lambda s: F.struct(F.when(gone(s) > 0, squeezed(joined(s))).otherwise(s["text"]).alias("text"), gone(s).alias("removed")))


def remove_boilerplate_tail(text: Column, tail: int = 5) -> Column:
    return boilerplate_tail(text, tail)["text"]


def boilerplate_tail(text: Column, tail: int = 5) -> Column:
    """struct(text, removed) without legal paragraphs among the last ``tail`` of two or more."""

    def cut(s: Column) -> Column:
        parts = s["parts"]
        kept = F.filter(parts, lambda p, i: ~((i >= F.size(parts) - tail) & is_boilerplate(p)))
        return F.struct(kept.alias("kept"), F.when(F.size(parts) > 1, F.size(parts) - F.size(kept)).otherwise(0).alias("removed"), s["text"].alias("text"))

    done = lambda s: F.struct(F.when(s["removed"] > 0, F.concat(F.rtrim(F.array_join(s["kept"], "\n\n"), F.lit(WHITE)), F.lit("\n"))).otherwise(s["text"]).alias("text"), s["removed"].alias("removed"))
    return _let(_let(F.struct(F.split(text, "\n\n", -1).alias("parts"), text.alias("text")), cut), done)


@dataclass(frozen=True)
class CleanOptions:
    """Toggles and thresholds of the cleaning pipeline."""

    headers_footers: bool = True
    page_numbers: bool = True
    toc: bool = True
    closing: bool = True
    short_noise: bool = True
    decoration: bool = True
    empty_blocks: bool = True
    duplicates: bool = True
    boilerplate: bool = True
    keep_toc: bool = True
    header_threshold: float = 0.5
    header_longest: int = 30
    toc_least: int = 3
    noise_least_cjk: int = 8
    duplicate_least_chars: int = 20
    duplicate_least_times: int = 2
    tail_paragraphs: int = 5


def clean_markdown(docs: DataFrame, options: CleanOptions = CleanOptions(), text_col: str = "text") -> DataFrame:
    """All rules in their fixed order on ``text_col``, row by row. Every row and column stays; what fired is in
    removed_* columns and toc, null otherwise, which an input should not have. A null or blank text stays as it is."""
    o, count = options, lambda n: F.when(n > 0, n)
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col(f"`{text_col}`").alias("_whole"))
    df = own.withColumn("_text", F.when(_strip(F.col("_whole")) != "", F.col("_whole")))
    if o.headers_footers:
        df = with_nfc(df, "_text", "_nfc").withColumn("_hit", repeated_headers(F.col("_nfc"), o.header_threshold, o.header_longest))
        df = df.withColumn("removed_headers_footers", F.when(F.size("_hit") > 0, F.col("_hit"))).withColumn("_text", without_headers(F.col("_text"), F.col("_nfc"), F.col("_hit"))).drop("_nfc", "_hit")

    def lines(df: DataFrame, name: str, rule) -> DataFrame:
        kept, removed = drop_lines(F.col("_text"), rule)
        return df.withColumn(f"removed_{name}", removed).withColumn("_text", kept)

    if o.page_numbers:
        df = lines(df, "page_number", is_page_number)
    if o.toc:
        df = df.withColumn("_cut", remove_toc(F.col("_text"), o.toc_least)).withColumn("_text", F.col("_cut.text")).withColumn("removed_toc", count(F.size("_cut.toc")))
        df = (df.withColumn("toc", F.when(F.size("_cut.toc") > 0, F.col("_cut.toc"))) if o.keep_toc else df).drop("_cut")
    if o.closing:
        df = lines(df, "closing", is_closing)
    if o.short_noise:
        df = lines(df, "short_noise", lambda x: is_short_noise(x, o.noise_least_cjk))
    if o.decoration:
        df = lines(df, "decoration", is_decoration)
    if o.empty_blocks:
        df = lines(df, "empty_block", is_empty_block).withColumn("_text", F.regexp_replace("_text", r"\n{3,}", "\n\n"))
    if o.duplicates:
        df = with_nfc(df, "_text", "_nfc").withColumn("_cut", unique_paragraphs(F.col("_text"), F.col("_nfc"), o.duplicate_least_chars, o.duplicate_least_times))
        df = df.withColumn("removed_duplicate", count(F.col("_cut.removed"))).withColumn("_text", F.col("_cut.text")).drop("_nfc", "_cut")
    if o.boilerplate:
        df = df.withColumn("_cut", boilerplate_tail(F.col("_text"), o.tail_paragraphs)).withColumn("removed_boilerplate", count(F.col("_cut.removed"))).withColumn("_text", F.col("_cut.text")).drop("_cut")
    clean = F.coalesce(collapse(F.col("_text")), F.col("_whole"))
    rest = [c for c in df.columns if c not in ("_row", "_whole", "_text")]
    return df.select(*[clean.alias(c) if c == text_col else F.col(f"_row.`{c}`").alias(c) for c in docs.columns], *rest)


# Finalisation, text by text: fixed patterns of zero-width characters, tags and pipeline noise.
ZERO_WIDTH = "[\u200b-\u200f\u202a-\u202e\u2060-\u206f\ufeff]"
HTML_TAG = r"</?[a-zA-Z][\w:-]*(?:\s[^>]*)?>"
PIPELINE_NOISE = ((r"[ \t]+", " "), (r"\n{4,}", "\n\n\n"), ("[\u200b-\u200f\u202a-\u202e\u2060-\u2064\ufeff]", ""), (r"[^\S\n]{2,}", " "))
ORPHAN_BULLET = r"^\s*[-*]\s*$"


def finalized(text: str | None, html_to_markdown=None) -> str:
    """Line ends, zero-width characters, NFC and blank runs settled; HTML (with a converter) and pipe tables as text.

    What a converter makes counts only if it is at least 20 characters and a quarter of the text.
    """
    if not (text or "").strip():
        return ""
    own = re.sub(ZERO_WIDTH, "", text.replace("\r\n", "\n").replace("\r", "\n"))
    own = re.sub(r"\n{3,}", "\n\n", "\n".join(unicodedata.normalize("NFC", x.rstrip()) for x in own.split("\n"))).strip()
    if html_to_markdown and re.search(HTML_TAG, own):
        made = html_to_markdown(own).strip()
        own = made if len(made) >= max(20, len(own) // 4) else own
    return re.sub(r"\n{3,}", "\n\n", tables_to_records(own)).strip()


def cleaned_for_pipeline(text: str | None) -> str:
    """Blank runs, invisible characters and orphan bullets out, then finalised without HTML."""
    own = text or ""
    for pattern, by in PIPELINE_NOISE:
        own = re.sub(pattern, by, own)
    return finalized("\n".join(x for x in own.split("\n") if not re.match(ORPHAN_BULLET, x)).strip())


def text_udf(f):
    """A column function of a text function, in Arrow batches."""
    return F.pandas_udf(lambda s: s.map(f), StringType())


def finalize_for_kb(text: Column, html: bool = True) -> Column:
    from skeinmill.sources.readers import html_to_markdown

    run = html_to_markdown if html else None
    return text_udf(lambda t: finalized(t, run))(text)


def clean_for_pipeline(text: Column) -> Column:
    return text_udf(cleaned_for_pipeline)(text)


#: Freshly written lines for rules whose inputs the driver's tables lack.
LINES = [
    "第 3 页", "4 / 9", "Page 2 of 7", "- 5 -", "p. 8", "## Page 1", "共 12 项内容", "12345", "pp. 3-9", "Thanks!", "**Thanks!**", "## 谢谢", "Q & A", "谢谢大家的聆听",
    "感谢各位同事在过去一年里对这个项目的辛勤付出与坚持", "The end.", "Fin", "completely finished", "内部资料请注意", "内部资料请注意保管", "标题：内容", "- 列表项", "---", "═══", "░░", "text ---",
    "##", "- ", "3.", "+ -", "3. item", "版权所有 2024", "Copyright (c) 2020", "plain text", "", "* * *", "·····", "页码 7", "　第 3 页　", "　 - 7 -",
]


def _values() -> str:
    return ", ".join(f"({i}, '{x}')" for i, x in enumerate(LINES))


def _rule_query(rule):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        lines = spark.createDataFrame(list(enumerate(LINES)), "pos long, line string")
        own = table(spark, sf_dir, "documents").select(F.explode(F.split("text", "\n", -1)).alias("line"))
        whole = lines.select("line").unionByName(own)
        return whole.where(rule(F.col("line"))).groupBy("line").agg(F.count("*").alias("n"))

    return run


def _sql_any(col: str, patterns) -> str:
    return "(" + " OR ".join(f"regexp_matches({col}, '{p}')" for p in patterns) + ")"


_ALL = f"l AS (SELECT line FROM (VALUES {_values()}) v(pos, line) UNION ALL SELECT unnest(string_split(text, chr(10))) AS line FROM documents)"
_T = "trim(line, ' ' || chr(9) || chr(13) || chr(12288) || chr(160))"


def _rule_sql(where: str) -> str:
    return f"WITH {_ALL} SELECT line, count(*) AS n FROM l WHERE {where} GROUP BY 1"


def clean_duplicate_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = with_nfc(table(spark, sf_dir, "documents").select("doc_id", "text"), "text", "composed")
    return docs.select("doc_id", F.md5(unique_paragraphs(F.col("text"), F.col("composed"), 20, 2, "\n")["text"].cast("binary")).alias("text_md5"))


def finalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(finalize_whitespace(F.col("text")).cast("binary")).alias("text_md5"))


def boilerplate_line_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    hit = F.filter(F.split("text", "\n", -1), is_boilerplate)
    return docs.select("doc_id", F.size(hit).cast("long").alias("n")).where("n > 0")


_NOISE = ((r"[ \t]+", " "), (r"\n{4,}", "\n\n\n"), ("[\u200b-\u200f\u202a-\u202e\u2060-\u2064\ufeff]", ""), (r"[^\S\n]{2,}", " "))
ORPHAN_BULLET = r"^\s*[-*]\s*$"


def finalized(text: str | None, html_to_markdown=None) -> str:
    """Line ends, zero-width characters, NFC and blank runs settled; HTML (with a converter) and pipe tables as text.

    What a converter makes counts only if it is at least 20 characters and a quarter of the text.
    """
    if not (text or "").strip():
        return ""
    own = re.sub(ZERO_WIDTH, "", text.replace("\r\n", "\n").replace("\r", "\n"))
    own = re.sub(r"\n{3,}", "\n\n", "\n".join(unicodedata.normalize("NFC", x.rstrip()) for x in own.split("\n"))).strip()
    if html_to_markdown and re.search(HTML_TAG, own):
        made = html_to_markdown(own).strip()
        own = made if len(made) >= max(20, len(own) // 4) else own
    return re.sub(r"\n{3,}", "\n\n", tables_to_records(own)).strip()


def cleaned_for_pipeline(text: str | None) -> str:
    """Blank runs, invisible characters and orphan bullets out, then finalised without HTML."""
    own = text or ""
    for pattern, by in PIPELINE_NOISE:
        own = re.sub(pattern, by, own)
    return finalized("\n".join(x for x in own.split("\n") if not re.match(ORPHAN_BULLET, x)).strip())


def text_udf(f):
    """A column function of a text function, in Arrow batches."""
    return F.pandas_udf(lambda s: s.map(f), StringType())


def finalize_for_kb(text: Column, html: bool = True) -> Column:
    from skeinmill.sources.readers import html_to_markdown

    run = html_to_markdown if html else None
    return text_udf(lambda t: finalized(t, run))(text)


def clean_for_pipeline(text: Column) -> Column:
    return text_udf(cleaned_for_pipeline)(text)


#: Freshly written lines for rules whose inputs the driver's tables lack.
LINES = [
    "第 3 页", "4 / 9", "Page 2 of 7", "- 5 -", "p. 8", "## Page 1", "共 12 项内容", "12345", "pp. 3-9", "Thanks!", "**Thanks!**", "## 谢谢", "Q & A", "谢谢大家的聆听",
    "感谢各位同事在过去一年里对这个项目的辛勤付出与坚持", "The end.", "Fin", "completely finished", "内部资料请注意", "内部资料请注意保管", "标题：内容", "- 列表项", "---", "═══", "░░", "text ---",
    "##", "- ", "3.", "+ -", "3. item", "版权所有 2024", "Copyright (c) 2020", "plain text", "", "* * *", "·····", "页码 7", "　第 3 页　", "　 - 7 -",
]


def _values() -> str:
    return ", ".join(f"({i}, '{x}')" for i, x in enumerate(LINES))


def _rule_query(rule):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        lines = spark.createDataFrame(list(enumerate(LINES)), "pos long, line string")
        own = table(spark, sf_dir, "documents").select(F.explode(F.split("text", "\n", -1)).alias("line"))
        whole = lines.select("line").unionByName(own)
        return whole.where(rule(F.col("line"))).groupBy("line").agg(F.count("*").alias("n"))

    return run


def _sql_any(col: str, patterns) -> str:
    return "(" + " OR ".join(f"regexp_matches({col}, '{p}')" for p in patterns) + ")"


_ALL = f"l AS (SELECT line FROM (VALUES {_values()}) v(pos, line) UNION ALL SELECT unnest(string_split(text, chr(10))) AS line FROM documents)"
_T = "trim(line, ' ' || chr(9) || chr(13) || chr(12288) || chr(160))"


def _rule_sql(where: str) -> str:
    return f"WITH {_ALL} SELECT line, count(*) AS n FROM l WHERE {where} GROUP BY 1"


def clean_duplicate_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = with_nfc(table(spark, sf_dir, "documents").select("doc_id", "text"), "text", "composed")
    return docs.select("doc_id", F.md5(unique_paragraphs(F.col("text"), F.col("composed"), 20, 2, "\n")["text"].cast("binary")).alias("text_md5"))


def finalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(finalize_whitespace(F.col("text")).cast("binary")).alias("text_md5"))


def boilerplate_line_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    hit = F.filter(F.split("text", "\n", -1), is_boilerplate)
    return docs.select("doc_id", F.size(hit).cast("long").alias("n")).where("n > 0")


def clean_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean_markdown(table(spark, sf_dir, "documents").select("doc_id", "text"))


_NOISE = rf"NOT regexp_matches(line, '{PAGE_MARK}') AND NOT regexp_matches(line, '{STRUCTURE}') AND NOT regexp_matches(line, '[:：A-Za-z0-9]') AND len(regexp_extract_all(line, '[一-鿿]')) BETWEEN 1 AND 7"
QUERIES = {
    "clean_page_numbers": (_rule_query(is_page_number), _rule_sql(f"{_T} <> '' AND NOT starts_with({_T}, '#') AND {_sql_any(_T, PAGE_NUMBER)}")),
    "clean_decoration": (_rule_query(is_decoration), _rule_sql(f"regexp_matches(line, '{DECORATION}')")),
    "clean_empty_blocks": (_rule_query(is_empty_block), _rule_sql(_sql_any("line", EMPTY_BLOCK))),
    "clean_closing": (_rule_query(is_closing), _rule_sql(f"trim(line, ' ' || chr(9) || chr(13) || '*_~`') <> '' AND length(trim(line, ' ' || chr(9) || chr(13) || '*_~`')) <= 30 AND regexp_matches(trim(line, ' ' || chr(9) || chr(13) || '*_~`'), '{CLOSING_LINE}')")),
    "clean_short_noise": (_rule_query(is_short_noise), _rule_sql(_NOISE)),
    "clean_boilerplate": (_rule_query(is_boilerplate), _rule_sql(f"trim(line, ' ' || chr(9) || chr(13)) <> '' AND length(line) <= 300 AND {_sql_any('line', BOILERPLATE)}")),
    "boilerplate_line_counts": (boilerplate_line_counts, f"SELECT doc_id, count(*) AS n FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) WHERE {_T} <> '' AND length(line) <= 300 AND {_sql_any('line', BOILERPLATE)} GROUP BY 1"),
    "clean_duplicate_lines": (clean_duplicate_lines, r"""WITH l AS (SELECT doc_id, generate_subscripts(x, 1) AS pos, unnest(x) AS part FROM (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents)),
        k AS (SELECT *, trim(regexp_replace(part, '[ \t\r\n]+', ' ', 'g'), ' ') AS key FROM l), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, key ORDER BY pos) AS n FROM k)
        SELECT doc_id, md5(string_agg(part, chr(10) ORDER BY pos)) AS text_md5 FROM r WHERE n = 1 OR length(key) < 20 GROUP BY 1"""),
    "finalize_whitespace": (finalize, r"SELECT doc_id, md5(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '\r\n?', chr(10), 'g'), '[​‌‍﻿]', '', 'g'), '[ \t]+(\n|$)', '\1', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), ' ' || chr(9) || chr(13) || chr(10))) AS text_md5 FROM documents"),
}
