"""Word shingles of UTF-8 texts as 64-bit hashes, computed on whole Arrow batches.

Words are maximal runs of bytes other than space and 0x09-0x0D, so no text has
to be decoded; A-Z are lower-cased. A word's hash is a polynomial over its bytes
modulo 2**64, taken from one prefix sum over the batch; a shingle's hash mixes
the hashes of its words. Batches are cut into runs of about ``CHUNK_BYTES`` so
that memory stays bounded whatever the batch holds; one text is never cut.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 19
_P = 0x9E3779B97F4A7C15 | 1
_P_INV = pow(_P, -1, 1 << 64)
_U = np.uint64
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers whose output bits all depend on all input bits."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def _powers(base: int, n: int) -> np.ndarray:
    out = np.empty(n, dtype=np.uint64)
    out[:1] = 1
    filled = 1
    while filled < n:
        step = min(filled, n - filled)
        out[filled : filled + step] = out[:step] * _U(pow(base, filled, 1 << 64))
        filled += step
    return out


_CACHE: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << max(19, n.bit_length())
    if size not in _CACHE:
        if size > 1 << 19:
            return _powers(_P, size), _powers(_P_INV, size)
        _CACHE[size] = _powers(_P, size), _powers(_P_INV, size)
    return _CACHE[size]


def text_runs(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of rows as (first row, end row, bytes, offsets of each row in them); null texts are empty."""
    column = column.fill_null("") if column.null_count else column
    large = pa.types.is_large_string(column.type)
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64 if large else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2], dtype=np.uint8) if column.buffers()[2] is not None else np.empty(0, np.uint8)
    first = 0
    while first < len(column):
        end = int(np.searchsorted(offsets, offsets[first] + CHUNK_BYTES, side="right")) - 1
        end = min(max(end, first + 1), len(column))
        yield first, end, data[offsets[first] : offsets[end]], offsets[first : end + 1] - offsets[first]
        first = end


def word_spans(data: np.ndarray, offsets: np.ndarray, apart: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All words in order: the bytes with A-Z lower-cased, starts, ends and hashes. ``apart`` marks the bytes between words."""
    n = len(data)
    if n == 0:
        return data, np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64)
    low = _LOWER[data]
    solid = ~apart[low]
    edge = np.ones(n, dtype=bool)
    edge[1:] = ~solid[:-1]
    edge[offsets[:-1][offsets[:-1] < n]] = True
    starts = np.flatnonzero(solid & edge)
    stop = np.ones(n, dtype=bool)
    stop[:-1] = ~solid[1:]
    inner = offsets[1:-1]
    stop[inner[inner > 0] - 1] = True
    ends = np.flatnonzero(solid & stop) + 1
    power, inverse = _power_tables(n)
    prefix = np.empty(n + 1, np.uint64)
    prefix[0] = 0
    np.cumsum((low.astype(np.uint64) + _U(1)) * power[:n], out=prefix[1:])
    return low, starts, ends, mix64((prefix[ends] - prefix[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in order, and how many words each row has."""
    _, starts, _, hashes = word_spans(data, offsets)
    return hashes, np.diff(np.searchsorted(starts, offsets))


def shingle_sets(column: pa.Array, width: int) -> Iterator[tuple[int, list[np.ndarray]]]:
    """(first row, sorted distinct shingle hashes of each row) for runs of rows.

    A text of fewer than ``width`` words has its whole word sequence as its one
    shingle; a text without words, or null, has none.
    """
    for first, end, data, offsets in text_runs(column):
        words, counts = word_hashes(data, offsets)
        salted = [words * _U((2 * i + 3) * 0x9E3779B97F4A7C15 & (2**64 - 1) | 1) for i in range(width)]
        m = len(words) - width + 1
        if m > 0:
            full = salted[0][:m].copy()
            for i in range(1, width):
                full ^= mix64(salted[i][i : i + m])
            full = mix64(full)
        row_at = np.concatenate([[0], np.cumsum(counts)])
        sets = []
        for r in range(end - first):
            k = int(counts[r])
            at = int(row_at[r])
            if k >= width:
                sets.append(np.unique(full[at : at + k - width + 1]))
            elif k:
                short = np.full(1, k, dtype=np.uint64)
                for i in range(k):
                    short ^= mix64(salted[i][at + i : at + i + 1])
                sets.append(mix64(short))
            else:
                sets.append(np.empty(0, np.uint64))
        yield first, sets
