"""Phrase collocations from frequent hashes, level by level, and one exact pass.

1. Every task counts the hashes of its words; they are shuffled by hash and
   summed. Of those that reach ``min_count`` one bit goes on, at the hash's place in
   a table of fixed size, so no frequent word is lost.
2. The same for pairs of words, both of whose words may be frequent.
3. The same for phrases of 3 to ``longest`` words, all of whose pairs may be frequent.
4. Only what passes these tables is counted by language and phrase, in each task
   first and then over all, so false survivors go.
5. Scores and subsumption are joins over the frequent phrases.

The sums are exact whatever the size of the corpus: it makes more rows to shuffle,
of 8 bytes of hash and a count, never more phrases that pass without being frequent,
but for those that share a bit with a frequent one. Memory is bounded: ``HASHES``
hashes in a task, three tables of 16 MB. A task reads at least ``TASK_BYTES``
of text if that leaves every core one, so that its own sums go before the shuffle.
Phrases are told apart by 64-bit hashes inside a task and by their text after it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from skeinmill.llm.shingles import mix64, text_runs, word_spans
from skeinmill.runtime import settle, table, text_batches

#: Bits of a table of frequent hashes, as a power of two; bits of a block of it.
CELL_BITS, BLOCK = 27, 1 << 16

#: Bytes of text that a task reads at least.
TASK_BYTES = 1 << 26

#: Phrases that a task holds before it hands its counts on.
HELD = 500_000

#: Hashes that a task holds before it sums them and hands them on, and the rows of a batch of sums.
HASHES, SUMS = 1 << 22, 1 << 16

_U = np.uint64
_SEED = [_U(0x9E3779B97F4A7C15), _U(0xC2B2AE3D27D4EB4F)]
#: What ends a piece, and what parts the words of a piece; fixed by the task.
_ENDS, _BLANK = b".,;:!?\x0a\x0b\x0c\x0d", b"\x20\x09"
_PIECE, _APART = np.zeros(256, dtype=bool), np.zeros(256, dtype=bool)
_PIECE[list(_ENDS)] = True
_APART[list(_ENDS + _BLANK)] = True


class _Words:
    """The words of a run of rows: lower-cased bytes, starts, ends, hashes that hold the language, rows, and ``piece``, equal for words of one piece."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, language: np.ndarray):
        self.low, self.starts, self.ends, plain = word_spans(data, offsets, _APART)
        self.row = np.searchsorted(offsets, self.starts, side="right") - 1
        self.hashes = mix64(plain ^ language[self.row])
        ended = np.concatenate([[0], np.cumsum(_PIECE[self.low])]) if len(self.low) else np.zeros(1, np.int64)
        self.piece = ended[self.starts] + self.row

    def only(self, keep: np.ndarray) -> None:
        """Drops the other words; pieces end where one was."""
        self.piece = (self.piece + np.cumsum(~keep))[keep]
        self.starts, self.ends, self.hashes, self.row = self.starts[keep], self.ends[keep], self.hashes[keep], self.row[keep]

    def only_pairs(self, passed: np.ndarray, bits: int) -> None:
        """Drops what is in no pair that passes; pieces end where a pair does not."""
        _, at, h = next(self.phrases(2))
        at = at[_reached(h, passed, bits)]
        first = np.ones(len(self.hashes), dtype=bool)
        first[at + 1] = False
        self.piece = np.cumsum(first)
        keep = ~first
        keep[at] = True
        self.only(keep)

    def phrases(self, longest: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(number of words, index of the first word, hash) of all phrases of 2 to ``longest`` words."""
        h, at = self.hashes, np.arange(len(self.hashes))
        for n in range(2, longest + 1):
            at = at[at + n <= len(self.hashes)]
            inside = self.piece[at] == self.piece[at + n - 1]
            at = at[inside]
            h = mix64(h[: len(inside)][inside] * _SEED[1] + self.hashes[at + n - 1] + _U(n))
            yield n, at, h
            if n < longest:
                h = _spread(h, at, len(self.hashes))
                at = np.arange(len(self.hashes))


def _spread(h: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    out = np.zeros(size, np.uint64)
    out[at] = h
    return out


def _reached(h: np.ndarray, passed: np.ndarray, bits: int) -> np.ndarray:
    """Whether a hash's bit is set."""
    cell = (h >> _U(64 - bits)).astype(np.int64)
    return (passed[cell >> 3] >> (cell & 7).astype(np.uint8)) & 1 == 1


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[_Words, list[str]]]:
    """The words of all rows (lang, text) and the language of each of their rows."""
    for batch in batches:
        names = batch.column("lang").to_pylist()
        salt = {x: int.from_bytes(hashlib.blake2b(x.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little") for x in set(names)}
        for first, end, data, offsets in text_runs(batch.column("text")):
            part = names[first:end]
            yield _Words(data, offsets, np.array([salt[x] for x in part], dtype=np.uint64)), part


def _tally(frequent: list[Broadcast], bits: int, longest: int):
    """(h, f): hashes of words; with the words' table of pairs of frequent words; with the pairs' too of longer phrases of frequent pairs. Summed ``HASHES`` at a time."""

    def summed(held: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        h = np.concatenate(held)
        h.sort()
        first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
        h, counts = h[first].view(np.int64), np.diff(first, append=len(h))
        for i in range(0, len(h), SUMS):
            yield pa.record_batch([pa.array(h[i : i + SUMS]), pa.array(counts[i : i + SUMS])], names=["h", "f"])

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        passed = [np.frombuffer(x.value, np.uint8) for x in frequent]
        held, n = [], 0
        for w, _ in _runs(batches):
            if passed:
                w.only(_reached(w.hashes, passed[0], bits))
            if len(passed) > 1:
                w.only_pairs(passed[1], bits)
            found = [h for size, _, h in w.phrases((2, longest)[len(passed) - 1]) if size > len(passed)] if passed else [w.hashes]
            held += found
            n += sum(len(h) for h in found)
            if n >= HASHES:
                yield from summed(held)
                held, n = [], 0
        if n:
            yield from summed(held)

    return tally


def _bit_blocks(bits: int):
    """(block, bits) of a table with the bits of the hashes ``h`` set."""

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks: dict[int, np.ndarray] = {}
        for batch in batches:
            cell = (batch.column("h").to_numpy().view(np.uint64) >> _U(64 - bits)).astype(np.int64)
            for block in np.unique(cell // BLOCK).tolist():
                blocks.setdefault(block, np.zeros(BLOCK, dtype=bool))[cell[cell // BLOCK == block] % BLOCK] = True
        for block, marks in blocks.items():
            yield pa.record_batch([pa.array([block], pa.int32()), pa.array([np.packbits(marks, bitorder="little").tobytes()], pa.binary())], names=["block", "bits"])

    return fold


def _frequent(rows: DataFrame, frequent: list[Broadcast], bits: int, min_count: int, longest: int) -> Broadcast:
    """The table of the next level: a bit for each hash that reaches ``min_count`` over all rows."""
    counted = rows.mapInArrow(_tally(frequent, bits, longest), "h long, f long").repartition("h")  # summed in the task already
    often = counted.groupBy("h").agg(F.sum("f").alias("f")).where(F.col("f") >= min_count).select("h")
    often = often.repartition(F.shiftrightunsigned("h", 64 - bits + BLOCK.bit_length() - 1))
    passed = np.zeros(max(1 << bits, BLOCK) // 8, np.uint8)
    for r in often.mapInArrow(_bit_blocks(bits), "block int, bits binary").collect():  # a bit a cell, 16 MB
        passed[r.block * BLOCK // 8 : (r.block + 1) * BLOCK // 8] |= np.frombuffer(r.bits, np.uint8)
    return rows.sparkSession.sparkContext.broadcast(passed.tobytes())


class _Held:
    """Exact counts of phrases by hash, with the language and text of each."""

    def __init__(self):
        self.keys, self.counts, self.texts = np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, object)

    def add(self, keys: np.ndarray, counts: np.ndarray, text_of) -> None:
        at = np.searchsorted(self.keys, keys)
        known = np.zeros(len(keys), dtype=bool)
        inside = at < len(self.keys)
        known[inside] = self.keys[at[inside]] == keys[inside]
        self.counts[at[known]] += counts[known]
        fresh = np.flatnonzero(~known)
        if len(fresh):
            texts = np.empty(len(fresh), object)
            texts[:] = [text_of(i) for i in fresh]
            self.keys = np.insert(self.keys, at[fresh], keys[fresh])
            self.counts = np.insert(self.counts, at[fresh], counts[fresh])
            self.texts = np.insert(self.texts, at[fresh], texts)

    def batch(self) -> pa.RecordBatch:
        columns = [pa.array([t[0] for t in self.texts], pa.string()), pa.array([t[1] for t in self.texts], pa.string()), pa.array([t[2] for t in self.texts], pa.int32()), pa.array(self.counts)]
        return pa.record_batch(columns, names=["lang", "phrase", "size", "f"])


def _exact(frequent: list[Broadcast], bits: int, longest: int):
    """(lang, phrase, size, f) of what passes the tables, summed in the task; a row without phrase has a language's words."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        passed = [np.frombuffer(x.value, np.uint8) for x in frequent]
        held, total = _Held(), {}
        for w, languages in _runs(batches):
            for row, n in enumerate(np.bincount(w.row, minlength=len(languages)).tolist()):
                total[languages[row]] = total.get(languages[row], 0) + n
            w.only(_reached(w.hashes, passed[0], bits))
            add(held, w, languages, [(1, np.arange(len(w.hashes)), w.hashes)])
            if longest > 1:
                w.only_pairs(passed[1], bits)
                add(held, w, languages, ((n, at[good], h[good]) for n, at, h in w.phrases(longest) for good in [_reached(h, passed[min(n, 3) - 1], bits)]))
            if len(held.keys) >= HELD:
                yield held.batch()
                held = _Held()
        if len(held.keys):
            yield held.batch()
        if total:
            yield pa.record_batch([pa.array(list(total)), pa.array([None] * len(total), pa.string()), pa.array([0] * len(total), pa.int32()), pa.array(list(total.values()), pa.int64())], names=["lang", "phrase", "size", "f"])

    def add(held: _Held, w: _Words, languages: list[str], found: Iterable[tuple[int, np.ndarray, np.ndarray]]) -> None:
        for n, at, h in found:
            keys, first, counts = np.unique(h, return_index=True, return_counts=True)
            head = at[first]

            def text_of(i: int, n=n, head=head) -> tuple[str, str, int]:
                spans = zip(w.starts[head[i] : head[i] + n].tolist(), w.ends[head[i] : head[i] + n].tolist(), strict=True)
                return languages[w.row[head[i]]], b" ".join(w.low[a:b].tobytes() for a, b in spans).decode("utf-8", "surrogatepass"), n

            held.add(keys, counts, text_of)

    return count


def frequent_phrases(docs: DataFrame, min_count: int = 100, longest: int = 5, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Exact counts (lang, phrase, size, f) of all phrases of 1 to ``longest`` words with f >= ``min_count``, and a row
    without phrase (size 0) for every language with the number of its words. A null language is ``und``, a null text empty."""
    if min_count < 1 or longest < 1:
        raise ValueError("min_count and longest have to be at least 1")
    rows = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    rows = rows.coalesce(max(docs.sparkSession.sparkContext.defaultParallelism, size // TASK_BYTES))
    bits, frequent = CELL_BITS, []
    with text_batches(docs.sparkSession):
        for _ in range(min(longest, 3)):
            frequent.append(_frequent(rows, list(frequent), bits, min_count, longest))
        counted = rows.mapInArrow(_exact(frequent, bits, longest), "lang string, phrase string, size int, f long")
        summed = counted.groupBy("lang", "phrase", "size").agg(F.sum("f").alias("f"))
        found = settle(summed.where((F.col("size") == 0) | (F.col("f") >= min_count)), "collocation-phrases")
    for x in frequent:
        x.destroy()
    return found


def collocations(
    docs: DataFrame, min_count: int = 100, longest: int = 5, subsume_percent: int = 100, top: int = 2000, text_col: str = "text", lang_col: str = "lang"
) -> DataFrame:
    """Each language's ``top`` phrases of 2 to ``longest`` words: lang, rank, phrase, a, l, r, n, score.

    a, l, r are the counts of the phrase and of both parts at its weakest cut,
    n the words of the language, score floor(1000 * a * n / (l * r)). A phrase
    inside a longer candidate goes if 100 times the longer one's count reaches
    ``subsume_percent`` times its own. Texts are lower-cased in A-Z, cut into
    pieces and words; phrases stay within pieces. Null texts are empty, a null
    language is ``und``; repeated rows count as often as they occur; an empty
    table gives no phrase. Ties go to the larger count, then to the smaller phrase.
    """
    known = frequent_phrases(docs, min_count, longest, text_col, lang_col)
    words = known.where("size = 0").select("lang", F.col("f").alias("n"))
    f = known.where("size > 0")
    candidates = f.where("size > 1").select("lang", "phrase", "size", F.col("f").alias("a"), F.split("phrase", " ").alias("w"))
    join = lambda c: F.array_join(c, " ")
    cuts = candidates.select("lang", "phrase", "size", "a", "w", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "size", "a", "k", join(F.slice("w", F.lit(1), F.col("k"))).alias("head"), join(F.slice("w", F.col("k") + 1, F.col("size"))).alias("tail"))
    left, right = f.select("lang", F.col("phrase").alias("head"), F.col("f").alias("l")), f.select("lang", F.col("phrase").alias("tail"), F.col("f").alias("r"))
    cuts = cuts.join(left, ["lang", "head"]).join(right, ["lang", "tail"]).join(words, "lang")
    wide = lambda c: F.col(c).cast("decimal(18,0)")
    over, under = (F.lit(1000).cast("decimal(4,0)") * wide("a")).cast("decimal(20,0)") * wide("n"), wide("l") * wide("r")
    cuts = cuts.withColumn("over", over.cast("decimal(38,0)")).withColumn("under", under.cast("decimal(38,0)"))
    weakest = cuts.groupBy("lang", "phrase", "size", "a", "n").agg(F.min(F.struct(F.expr("over div under").alias("score"), "k", "l", "r")).alias("cut"))

    inner = candidates.where("size > 2").select("lang", "a", "w", "size", F.explode(F.sequence(F.lit(2), F.col("size") - 1)).alias("n"))
    inner = inner.select("lang", "a", "w", "n", F.explode(F.sequence(F.lit(1), F.col("size") - F.col("n") + 1)).alias("s"))
    inner = inner.select("lang", join(F.slice("w", F.col("s"), F.col("n"))).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    left_over = weakest.join(inner, ["lang", "phrase"], "left").where(f"longer IS NULL OR 100 * longer < {int(subsume_percent)} * a")
    order = W.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    return left_over.select("lang", "phrase", "a", "cut.*", "n").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score"
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
piece AS (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) AS p FROM d),
run AS (SELECT lang, regexp_extract_all(p, '[^\x20\x09]+') AS w FROM piece),
total AS (SELECT lang, sum(len(w)) AS n FROM run GROUP BY lang),
place AS (SELECT lang, w, size, unnest(range(1, len(w) - size + 2)) AS s FROM run, range(1, 6) AS x(size) WHERE len(w) >= size),
f AS (SELECT lang, size, array_to_string(w[s:s + size - 1], ' ') AS phrase, count(*) AS f FROM place GROUP BY ALL HAVING count(*) >= 100),
candidate AS (SELECT lang, size, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE size > 1),
cut AS (SELECT c.lang, c.phrase, c.a, k, p.f AS l, q.f AS r, CAST(n AS BIGINT) AS n,
        CAST((CAST(1000 AS HUGEINT) * a * n) // (CAST(p.f AS HUGEINT) * q.f) AS BIGINT) AS score
    FROM (SELECT *, unnest(range(1, size)) AS k FROM candidate) c JOIN total USING (lang)
    JOIN f p ON p.lang = c.lang AND p.phrase = array_to_string(w[1:k], ' ') JOIN f q ON q.lang = c.lang AND q.phrase = array_to_string(w[k + 1:], ' ')),
weakest AS (SELECT * FROM cut QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
part AS (SELECT lang, a, w, size, unnest(range(2, size)) AS m FROM candidate),
part_at AS (SELECT lang, a, w, m, unnest(range(1, size - m + 2)) AS s FROM part),
longer AS (SELECT lang, array_to_string(w[s:s + m - 1], ' ') AS phrase, max(a) AS most FROM part_at GROUP BY ALL)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM weakest LEFT JOIN longer USING (lang, phrase) WHERE most IS NULL OR 100 * most < 100 * a QUALIFY rank <= 2000
"""
