"""Tables of contents out of Markdown: every line becomes one letter, and patterns over the letters find the blocks.

One pass inside the JVM, no line is ever a row of its own.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The line patterns of tables of contents.
TOC_HEADING = r"(?iU)^\s*#{1,6}\s+(?:目\s*录|目\s*次|大\s*纲|提\s*纲|议\s*程|Table\s+of\s+Contents?|Contents?|Outline|Agenda|Index)\s*$"
LIST_ITEM = r"(?U)^\s*(?:[-*+]|\d+\s*[\.\)、])\s+\S"
PAGE_MARK = r"(?iU)^\s*(?:<!--\s*page\s*:\s*\d+\s*-->|##\s+Page\s+\d+)\s*$"
LEADER = r"(?U)^.{1,120}?[\.·…—–─━―\s]{0,4}[\.·…—–─━―]{3,}[\.·…—–─━―\s]{0,4}\d{1,4}$"
BLANK = r"(?U)^\s*$"


def is_leader(line: Column) -> Column:
    bare = F.regexp_replace(line, r"(?U)^\s+|\s+$", "")
    return ~bare.startswith("#") & ~bare.startswith("|") & (F.length(bare) <= 200) & bare.rlike(LEADER)


def _let(value: Column, body) -> Column:
    """``body`` of a value that is worked out once a row."""
    return F.transform(F.array(value), body)[0]


def _kept(lines: Column, letter, block: str) -> Column:
    """struct(lines, letters): the letters are ``d`` where the block pattern crosses a line out."""
    letters = F.split(F.regexp_replace(F.array_join(F.transform(lines, letter), ""), block, "$1d"), "")
    return F.struct(lines.alias("lines"), letters.alias("letters"))


def _parted(marked: Column) -> Column:
    """struct(kept, gone): the lines that stay, and those that go, blanks aside."""
    kept = lambda m: F.filter(m["lines"], lambda x, i: m["letters"][i] != "d")
    gone = lambda m: F.filter(m["lines"], lambda x, i: (m["letters"][i] == "d") & ~x.rlike(BLANK))
    return _let(marked, lambda m: F.struct(kept(m).alias("kept"), gone(m).alias("gone")))


def list_toc(lines: Column, least: int = 3) -> Column:
    """A contents heading, then items with blanks and page marks between, ``least`` items at least: all go but the marks."""
    kind = lambda x: F.when(x.rlike(TOC_HEADING), "H").when(x.rlike(BLANK), "B").when(x.rlike(PAGE_MARK), "M").when(x.rlike(LIST_ITEM), "I").otherwise("X")
    return _parted(_kept(lines, kind, rf"(?!^)\G(M*)[BI]|H(?=(?:[BM]*I){{{least}}})"))


def leader_toc(lines: Column, least: int = 3) -> Column:
    """A run of ``least`` or more lines of dot leaders; one blank line between two of them belongs to the run."""
    kind = lambda x: F.when(x.rlike(BLANK), "B").when(is_leader(x), "L").otherwise("X")
    return _parted(_kept(lines, kind, rf"(?!^)\G()(?:B(?=L)|L)|L(?=(?:B?L){{{least - 1}}})"))


def remove_toc(text: Column, least: int = 3) -> Column:
    """struct(text, toc): the text without tables of contents, and the lines that went (lists first); null for null."""

    def both(lists: Column) -> Column:
        joined = lambda led: F.struct(F.array_join(led["kept"], "\n").alias("text"), F.concat(lists["gone"], led["gone"]).alias("toc"))
        return _let(leader_toc(lists["kept"], least), joined)

    return F.when(text.isNotNull(), _let(_let(F.split(text, "\n", -1), lambda x: list_toc(x, least)), both))
