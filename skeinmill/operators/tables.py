"""Tables as text: pipe rows in, one ``field：value`` line a record out."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from itertools import groupby, zip_longest

UNNAMED = "字段"  # fixed value: the name of a column without a header


def _cell(value: object) -> str:
    return "" if value is None else re.sub(r"[\r\n\t]+", " ", str(value)).strip()


def field_names(header: Iterable[object]) -> list[str]:
    """Header cells as distinct names: blank ones get a stand-in, repeats a number from 2 on."""
    times: dict[str, int] = {}
    names = []
    for name in (_cell(h) or UNNAMED for h in header):
        times[name] = times.get(name, 0) + 1
        names.append(name if times[name] == 1 else f"{name}_{times[name]}")
    return names


def record_lines(header: Iterable[object], rows: Iterable[Iterable[object]]) -> Iterator[str]:
    """A line for each row with any value; short rows are padded, cells beyond the header and empty values are left out."""
    names = field_names(header)
    for row in rows:
        merged: dict[str, str] = {}
        for name, value in zip_longest(names, list(row)[: len(names)]):
            merged[name] = _cell(value)
        line = " ".join(f"{k}：{v}" for k, v in merged.items() if v)
        if line:
            yield line


def is_pipe_row(line: str) -> bool:
    return re.match(r"^\s*\|.*\|\s*$", line) is not None


def pipe_cells(line: str) -> list[str]:
    """Cells of ``| a | b |`` without the outer bars."""
    return [c.strip() for c in line.strip().removeprefix("|").removesuffix("|").split("|")]


def is_separator(line: str) -> bool:
    return is_pipe_row(line) and all(re.match(r"^:?-+:?$", c) for c in pipe_cells(line.strip()))


def tables_to_records(text: str) -> str:
    """Runs of two or more pipe rows with a separator row become record lines; a header alone goes, other rows stay."""
    if "|" not in text:
        return text
    out: list[str] = []
    for is_row, run in groupby(text.split("\n"), is_pipe_row):
        rows = list(run)
        if not is_row or len(rows) < 2 or not any(map(is_separator, rows)):
            out += rows
            continue
        cells = [pipe_cells(r) for r in rows if not is_separator(r)]
        lines = list(record_lines(cells[0], cells[1:])) if cells else []
        out += lines or ([] if len(cells) == 1 else rows)
    return "\n".join(out)
