"""Hierarchical multi-length packing of tokenised documents.

Each document's tokens (its ids, then id 0) are cut into whole windows of the
longest tier; the rest is routed to the shortest tier that holds it. A tier's
window takes the longest waiting rest, its gap is filled by the longest rests
that still fit from its own and the shorter tiers, and a gap that none fits is
closed by cutting the next one. So windows of every tier are exactly full, a
partition leaves at most its last few tokens in windows of smaller powers of
two, and a document is cut only where a window ends.

Step groups hold ``step_tokens`` tokens each, which keeps the work of each
training step the same: windows of one size are numbered over all partitions and
dealt to groups in that order, and what each size leaves over is merged, larger
windows first, so that only the very last group of a run can be short.

Packing is local to a partition and reads each document once, without a
shuffle. The rests that wait are bounded by ``pool`` documents. With
``max_wait`` a rest that has waited while so many further ones came opens the
next window, whatever its length, so sequences follow the order of the
documents to within that many.
"""

from __future__ import annotations

import bisect
import functools
import json
import re
import zlib
from collections import Counter, deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from skeinmill.runtime import settle, table, text_batches

_PART_BITS = 36

#: How byte-level BPE cuts a text into pre-tokens, and what its ``\s`` is; fixed values of the public vocabulary and of Unicode.
PRETOKEN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"

#: White space of so many characters is a pre-token cut by hand: the pattern engine would need as much stack.
LONG_RUN = 50_000
_RUN = re.compile(f"[{SPACE}]{{{LONG_RUN},}}")


def _byte_of() -> dict[str, int]:
    """The byte that each character of the vocabulary's strings stands for."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


def _is_plain_byte_bpe(spec: dict) -> bool:
    """Whether the file cuts by ``PRETOKEN`` alone and merges by the order of its ids."""
    model, cut, own = spec["model"], spec["pre_tokenizer"] or {}, {x["content"] for x in spec["added_tokens"]}
    odd = any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
    flags = any(x[k] for x in spec["added_tokens"] for k in ("single_word", "lstrip", "rstrip", "normalized"))
    if spec["normalizer"] or model["type"] != "BPE" or odd or flags or cut.get("type") != "ByteLevel" or cut.get("add_prefix_space") or not cut.get("use_regex", True):
        return False
    by_id = [t for t, _ in sorted(model["vocab"].items(), key=lambda x: x[1]) if t not in own]
    merged = ["".join(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]]
    return by_id[len(by_id) - len(merged) :] == merged and len(by_id) - len(merged) == 256


class Encoder:
    """Ids of texts, as ``Tokenizer.from_file(path).encode(text, add_special_tokens=False)`` gives them.

    A byte-level BPE file of the plain kind is handed to the faster engine of
    tiktoken, which cuts and merges alike (the tests compare both). Special
    tokens' strings cut a text first. White space of ``LONG_RUN`` characters or
    more, for which the engine's pattern runs out of stack, is cut out here: all
    of the run is one pre-token, but for its last character if a text goes on
    behind it, and is merged without the pattern. Any other file is left to the
    tokenizers library, text by text.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self._tokenizer = self._engine = None
        if not _is_plain_byte_bpe(spec):
            from tokenizers import Tokenizer

            self._tokenizer = Tokenizer.from_file(path)
            return
        import tiktoken

        self._special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        byte_of = _byte_of()
        ranks = {bytes(byte_of[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in self._special}
        self._engine = tiktoken.Encoding("byte_bpe", pat_str=PRETOKEN, mergeable_ranks=ranks, special_tokens={})
        self._cut = re.compile("(" + "|".join(map(re.escape, sorted(self._special, key=len, reverse=True))) + ")")

    def __call__(self, text: str) -> np.ndarray:
        if self._tokenizer is not None:
            return np.array(self._tokenizer.encode(text, add_special_tokens=False).ids, dtype=np.uint32)
        if not any(s in text for s in self._special):
            return self._plain(text)
        parts = [np.array([self._special[x]], np.uint32) if i % 2 else self._plain(x) for i, x in enumerate(self._cut.split(text))]
        return np.concatenate(parts)

    def ordinary(self, text: str) -> np.ndarray:
        """Ids of a text in which the special tokens' strings are text like any other."""
        if self._tokenizer is None:
            return self._plain(text)
        self._tokenizer.encode_special_tokens = True
        try:
            return self(text)
        finally:
            self._tokenizer.encode_special_tokens = False

    def _plain(self, text: str) -> np.ndarray:
        run = _RUN.search(text) if len(text) >= LONG_RUN else None
        if run is None:
            return self._engine.encode_to_numpy(text, disallowed_special=())
        parts, at = [], 0
        while run is not None:
            end = run.end() - (run.end() < len(text))
            parts.append(self._engine.encode_to_numpy(text[at : run.start()], disallowed_special=()))
            parts.append(np.array(self._engine._encode_single_piece(text[run.start() : end]), dtype=np.uint32))
            at, run = end, _RUN.search(text, end + 1)
        return np.concatenate([*parts, self._engine.encode_to_numpy(text[at:], disallowed_special=())])


@functools.lru_cache(maxsize=1)
def encoder(path: str) -> Encoder:
    """One encoder for all tasks of a worker process."""
    return Encoder(path)


def _packer(tokenizer_path: str, tiers: tuple[int, ...], eod: int, pool: int, emit_ids: bool, max_wait: int | None = None):
    longest = tiers[0]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode = encoder(tokenizer_path)
        base = TaskContext.get().partitionId() << _PART_BITS
        count = 0
        windows: Counter[int] = Counter()  # of each size
        # tier -> waiting rests as (length, arrival, doc, start, ids, doc_tokens), by length
        waiting: dict[int, list[tuple]] = {t: [] for t in tiers}
        held, arrival = 0, 0
        came: deque[int] = deque()  # arrivals, oldest first; those of ``lengths`` still wait
        lengths: dict[int, int] = {}
        rows: list[tuple] = []

        def emit(pieces: list[tuple], tier: int) -> None:
            nonlocal count
            offset, size = 0, sum(len(ids) for _, _, ids, _ in pieces)
            for doc, start, ids, total in pieces:
                rows.append((doc, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), total, base + count, offset, tier, size, windows[size], ids))
                offset += len(ids)
            windows[size] += 1
            count += 1

        def tier_of(n: int) -> int:
            return next(t for t in reversed(tiers) if n <= t)

        def wait(doc, start, ids, total, since: int | None = None) -> None:
            nonlocal held, arrival
            if since is None or max_wait is None:
                since, arrival = arrival, arrival + 1
                if max_wait is not None:
                    came.append(since)
            bisect.insort(waiting[tier_of(len(ids))], (len(ids), since, doc, start, ids, total), key=lambda x: x[:2])
            lengths[since] = len(ids)
            held += 1

        def take(tier: int, at: int) -> tuple:
            nonlocal held
            held -= 1
            rest = waiting[tier].pop(at)
            del lengths[rest[1]]
            return rest

        def pop(limit: int) -> tuple | None:
            """The longest waiting rest of at most ``limit`` tokens."""
            for t in tiers:
                if waiting[t] and waiting[t][0][0] <= limit:
                    at = bisect.bisect_right(waiting[t], limit, key=lambda x: x[0]) - 1
                    return take(t, at)[2:]
            return None

        def cut(gap: int) -> tuple | None:
            """The first ``gap`` tokens of the shortest waiting rest that is longer; what remains waits on."""
            for t in reversed(tiers):
                if waiting[t] and waiting[t][-1][0] > gap:
                    at = bisect.bisect_right(waiting[t], gap, key=lambda x: x[0])
                    since, doc, start, ids, total = take(t, at)[1:]
                    wait(doc, start + gap, ids[gap:], total, since)
                    return doc, start, ids[:gap], total
            return None

        def fill(tier: int, first: tuple | None = None) -> None:
            """One full window of ``tier``, or all that waits if that is less."""
            pieces, gap = ([first], tier - len(first[2])) if first else ([], tier)
            while gap:
                piece = pop(gap) or cut(gap)
                if piece is None:
                    break
                pieces.append(piece)
                gap -= len(piece[2])
            emit(pieces, tier)

        def tokens_waiting() -> int:
            return sum(x[0] for t in tiers for x in waiting[t])

        def overdue() -> None:
            """Windows that open with the rests that have waited for more than ``max_wait`` others, oldest first."""
            while came and came[0] < arrival - max_wait:
                since = came[0]
                if since in lengths:
                    n = lengths[since]
                    tier = tier_of(n)
                    if tokens_waiting() < tier:
                        break
                    at = bisect.bisect_left(waiting[tier], (n, since), key=lambda x: x[:2])
                    fill(tier, take(tier, at)[2:])
                came.popleft()

        def drain(to: int) -> None:
            while held > to:
                tier = next((t for t in tiers if waiting[t]), None)
                if sum(x[0] for t in tiers if t <= tier for x in waiting[t]) < tier:
                    break
                fill(tier)

        def flush() -> None:
            drain(0)
            left = tokens_waiting()
            while left:
                size = min(1 << (left.bit_length() - 1), longest)
                pieces, gap = [], size
                while gap:
                    piece = pop(gap) or cut(gap)
                    pieces.append(piece)
                    gap -= len(piece[2])
                emit(pieces, tier_of(size))
                left -= size

        def batch_of() -> pa.RecordBatch:
            *cols, ids = zip(*rows, strict=True)
            rows.clear()
            arrays = [pa.array(c, pa.int64()) for c in cols]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "tier", "size", "nth"]
            if emit_ids:
                ends = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
                arrays.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids).astype(np.int32))))
                names.append("ids")
            return pa.RecordBatch.from_arrays(arrays, names=names)

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = np.append(encode(text.as_py() or ""), np.uint32(eod))
                whole = len(ids) // longest * longest
                for start in range(0, whole, longest):
                    emit([(doc, start, ids[start : start + longest], len(ids))], longest)
                if whole < len(ids):
                    wait(doc, whole, ids[whole:], len(ids))
                if max_wait is not None:
                    overdue()
                if held > pool:
                    drain(pool // 2)
                if len(rows) >= 1024:
                    yield batch_of()
        flush()
        if rows:
            yield batch_of()

    return pack


def with_step_groups(pieces: DataFrame, step_tokens: int) -> DataFrame:
    """``pieces`` with step_group, from the sizes of their windows and the windows' numbers in their partitions.

    The driver sees one row a size; sizes are powers of two.
    """
    part = F.shiftright("sequence_id", _PART_BITS)
    counts = pieces.groupBy(part.alias("part"), "size").agg((F.max("nth") + 1).alias("n"))
    totals = {r["size"]: r["n"] for r in counts.groupBy("size").agg(F.sum("n").alias("n")).orderBy(F.desc("size")).collect()}
    whole, spare, groups, left = {}, {}, 0, 0
    for size, n in totals.items():
        whole[size], spare[size] = groups, left
        groups += n // (step_tokens // size)
        left += n % (step_tokens // size) * size
    value = lambda found: F.create_map(*[F.lit(x) for pair in found.items() for x in pair])[F.col("size")] if found else F.lit(0)
    before = W.partitionBy("size").orderBy("part").rowsBetween(W.unboundedPreceding, -1)  # a row a partition
    starts = settle(counts.select("part", "size", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before")), "packing-starts")  # known to be small, so the pieces need not move
    window, a_group = F.col("before") + F.col("nth"), F.expr(f"{step_tokens} div size")
    in_whole = F.expr("div(n_all, a_group)") * F.col("a_group")
    numbered = pieces.withColumn("part", part).join(starts, ["part", "size"]).select("*", window.alias("window"), a_group.alias("a_group"), value(totals).alias("n_all"))
    group = F.when(F.col("window") < in_whole, value(whole) + F.expr("div(window, a_group)")).otherwise(
        groups + F.floor((value(spare) + (F.col("window") - in_whole) * F.col("size")) / step_tokens)
    )
    return numbered.select(*[c for c in pieces.columns if c not in ("size", "nth")], group.cast("long").alias("step_group"))


def pack_documents(
    docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", tiers: tuple[int, ...] = (1024, 512, 256), eod: int = 0, step_tokens: int = 65_536, pool: int = 4096, emit_ids: bool = True, max_wait: int | None = None
) -> DataFrame:
    """Pieces of documents in windows: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, tier,
    with ``emit_ids`` the piece's ids, and step_group.

    ``tiers`` are powers of two, longest first, and ``step_tokens`` is a power of
    two of at least the longest. Every token lies in exactly one piece; the
    pieces of a sequence are gapless from offset 0. A sequence is as long as its
    tier or, at a partition's end, a smaller power of two, so none needs padding.
    Every step group but the last holds exactly ``step_tokens`` tokens; groups of
    one size come first. Null and empty texts are documents of the one token
    ``eod``; null and repeated ids are kept as they are, each row a document of
    its own. Texts of any length and runs of white space of any length are
    packed whole. An empty table gives an empty result; other columns are
    ignored. ``sequence_id`` is unique to a run's partitioning.
    """
    if list(tiers) != sorted(set(tiers), reverse=True) or any(t & (t - 1) for t in tiers):
        raise ValueError("tiers must be falling powers of two")
    if step_tokens & (step_tokens - 1) or step_tokens < tiers[0]:
        raise ValueError("step_tokens must be a power of two, at least the longest tier")
    fields = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, tier long, size long, nth long"
    pack = _packer(tokenizer_path, tuple(tiers), eod, pool, emit_ids, max_wait)
    own = docs.selectExpr(f"cast(`{id_col}` as long) as doc_id", f"cast(`{text_col}` as string) as text")
    return with_step_groups(settle(own.mapInArrow(pack, fields + (", ids array<int>" if emit_ids else "")), "packing-pieces"), step_tokens)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    with text_batches(spark):
        return pack_documents(table(spark, sf_dir, "documents"), default_tokenizer(), emit_ids=False)


ORACLE = None
