"""Sets of hashed token pairs of whole Arrow batches of texts.

Tokens are runs of letters and digits of the lower-cased text, as ``[\\p{L}\\p{N}]+``
finds them. What is a letter or digit and how it is lower-cased is looked up a code
point at a time, so that no row is a Python string. A token's hash is a
polynomial over its code points modulo 2**64, taken from one prefix sum over a run
of texts of about ``CHUNK_BYTES``; one text is never cut.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 1 << 19
_U = np.uint64
_P = 0x9E3779B97F4A7C15
_P_INV = pow(_P, -1, 1 << 64)
_FIRST, _SECOND, _ALONE = (_U(x) for x in (0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB))


@functools.cache
def _classes() -> tuple[np.ndarray, np.ndarray]:
    """By code point: what it is lower-cased to, and whether that is a letter or digit."""
    code = np.delete(np.arange(0x110000, dtype=np.uint32), np.s_[0xD800:0xE000])
    size = 1 + (code > 0x7F).astype(np.int32) + (code > 0x7FF) + (code > 0xFFFF)
    data = code.tobytes().decode("utf-32-le").encode()
    chars = pa.Array.from_buffers(pa.string(), len(code), [None, pa.py_buffer(np.concatenate([[0], np.cumsum(size)]).astype(np.int32)), pa.py_buffer(data)])
    lower = np.arange(0x110000, dtype=np.uint32)
    solid = np.zeros(0x110000, dtype=bool)
    lower[code] = np.frombuffer(pc.utf8_lower(chars).buffers()[2].to_pybytes().decode().encode("utf-32-le"), np.uint32)
    solid[code] = pc.match_substring_regex(chars, r"[\p{L}\p{N}]").to_numpy(zero_copy_only=False)
    return lower, solid[lower]


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers whose output bits all depend on all input bits."""
    x = x ^ (x >> _U(30))
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


@functools.lru_cache(1)
def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    return _powers(_P, n), _powers(_P_INV, n)


def _is_token(word: str) -> bool:
    code = np.frombuffer(word.encode("utf-32-le"), np.uint32)
    lower, solid = _classes()
    return len(code) > 0 and bool((lower[code] == code).all() and solid[code].all())


def token_hashes(data: bytes, offsets: np.ndarray, at_least: int = 2) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens of ``at_least`` characters in order, and the first of each row of UTF-8 ``data`` (with an end)."""
    lower, solid = _classes()
    code = lower[np.frombuffer(data.decode().encode("utf-32-le"), np.uint32)]
    n = len(code)
    if n == len(data):
        rows = offsets
    else:
        rows = np.concatenate([[0], np.cumsum((np.frombuffer(data, np.uint8) & 0xC0) != 0x80)])[offsets]
    if not n:
        return np.empty(0, np.uint64), np.zeros(len(offsets), np.int64)
    inside = solid[code]
    start, stop = inside.copy(), inside.copy()
    cut = np.zeros(n + 1, dtype=bool)
    cut[rows] = True
    start[1:] &= ~inside[:-1] | cut[1:-1]
    stop[:-1] &= ~inside[1:] | cut[1:-1]
    starts, ends = np.flatnonzero(start), np.flatnonzero(stop) + 1
    long = ends - starts >= at_least
    starts, ends = starts[long], ends[long]
    power, inverse = _tables(CHUNK_BYTES) if n <= CHUNK_BYTES else (_powers(_P, n), _powers(_P_INV, n))
    prefix = np.zeros(n + 1, np.uint64)
    np.cumsum((code.astype(np.uint64) + _U(1)) * power[:n], out=prefix[1:])
    hashes = mix64((prefix[ends] - prefix[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))
    return hashes, np.searchsorted(starts, rows)


def _runs(column: pa.Array) -> Iterator[tuple[int, int, bytes, np.ndarray]]:
    """Runs of rows as (first row, end row, bytes, offsets of each row in them); null texts are empty."""
    column = column.fill_null("") if column.null_count else column
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    offsets = np.frombuffer(column.buffers()[1], kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = memoryview(column.buffers()[2] or b"")
    first = 0
    while first < len(column):
        end = int(np.searchsorted(offsets, offsets[first] + CHUNK_BYTES, side="right")) - 1
        end = min(max(end, first + 1), len(column))
        yield first, end, bytes(data[offsets[first] : offsets[end]]), offsets[first : end + 1] - offsets[first]
        first = end


def pair_sets(column: pa.Array, stopwords: tuple[str, ...] = ()) -> Iterator[tuple[int, list[np.ndarray]]]:
    """(first row, sorted distinct hashes of the token pairs of each row) for runs of rows.

    Tokens of one character and stopwords (as tokens are: in lower case) do not count. A
    text of one token has that token for a pair; one without tokens, or null, has none.
    """
    out = [token_hashes(w.encode(), np.array([0, len(w.encode())])) for w in stopwords if _is_token(w)]
    out = np.concatenate([x for x, _ in out]) if out else np.empty(0, np.uint64)
    for first, end, data, offsets in _runs(column):
        words, at = token_hashes(data, offsets)
        if len(out):
            stay = ~np.isin(words, out)
            words, at = words[stay], np.concatenate([[0], np.cumsum(stay)])[at]
        pairs = mix64((words[:-1] * _FIRST) ^ mix64(words[1:] * _SECOND))
        sets = []
        for i, j in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
            if j - i > 1:
                x = np.sort(pairs[i : j - 1])
                sets.append(x[np.concatenate([[True], x[1:] != x[:-1]])])
            else:
                sets.append(mix64(words[i:j] * _ALONE))
        yield first, sets
