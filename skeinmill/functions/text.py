"""Scalar text functions of the assistant, as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

_EDGES = r"(?U)^\s+|\s+$"
CUT_MARK = "\n...[已截断]"  # fixed value



def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once, also where it is used inside a lambda."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, _EDGES, "")


def truncate(text: Column, limit: int) -> Column:
    """Stripped, cut after ``limit`` characters with a mark; null is empty."""
    bare = stripped(F.coalesce(text, F.lit("")))
    return F.when(F.length(bare) <= limit, bare).otherwise(F.concat(F.substring(bare, 1, limit), F.lit(CUT_MARK)))


def strip_mentions(text: Column, names: Column) -> Column:
    """Without the mentions' keys and @names, <at> elements and one leading @word."""
    plain = F.aggregate(names, text, lambda t, m: F.when(F.coalesce(m, F.lit("")) == "", t).otherwise(F.replace(t, m, F.lit(""))))
    return stripped(F.regexp_replace(F.regexp_replace(plain, r"<at[^>]*>.*?</at>", ""), r"(?U)^\s*@\S+\s*", ""))


def leaf_section(breadcrumb: Column) -> Column:
    """Last part of a breadcrumb of two parts or more, else empty."""
    parts = F.filter(F.transform(F.split(F.coalesce(breadcrumb, F.lit("")), ">"), stripped), lambda p: p != "")
    return F.when(F.size(parts) >= 2, F.element_at(parts, -1)).otherwise("")


def prefixes(text: Column, step: int) -> Column:
    """Growing prefixes every ``step`` characters, the whole text last."""
    step = max(1, step)
    n = F.length(text)
    cuts = F.when(n > step, F.sequence(F.lit(step), n - 1, F.lit(step))).otherwise(F.array().cast("array<int>"))
    return F.concat(F.transform(cuts, lambda i: F.substr(text, F.lit(1), i)), F.array(text))


def sse_text(stream: Column) -> Column:
    """Text of a server-sent event stream: ``data:`` lines up to ``[DONE]``; lines without a usable delta give nothing."""
    data = F.transform(
        F.filter(F.transform(F.split(stream, "\n", -1), stripped), lambda x: x.startswith("data:")), lambda x: stripped(F.substr(x, F.lit(6)))
    )
    end = F.array_position(data, "[DONE]")
    live = F.when(end > 0, F.slice(data, F.lit(1), end.cast("int") - 1)).otherwise(data)
    return F.array_join(F.transform(live, lambda x: F.get_json_object(x, "$.choices[0].delta.content")), "")
