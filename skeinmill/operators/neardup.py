"""Near-duplicate groups of documents by token pairs, and what a greedy pass keeps: an exact set join by rare prefixes.

Equal sets of word pairs are one class and only its smallest id goes on. Classes
that share enough rare elements are candidates; groups compare each class with a few
candidates first and go on only between different components, so next to no pair inside a
group is compared. A text is known by its class, so an id with several texts is compared
with each of them. Up to the comparison only rare elements are handed on; sets are
made again for those texts alone that are compared.
"""

from __future__ import annotations

import hashlib
import math
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from skeinmill.operators.graph import connected_components, greedy_dropped
from skeinmill.operators.pairsets import pair_sets
from skeinmill.runtime import discard, forget_shuffles, settle, table, text_batches

BLOCK = 32
CELL_BITS = 22
SLICES = 64
COMMON = 3
BROADCAST_ROWS = 1 << 20
_SKETCH = pa.schema([("doc_id", pa.int64()), ("d1", pa.int64()), ("d2", pa.int64()), ("n", pa.int32()), ("slice", pa.int32()), ("cells", pa.binary())])


def _least_equal(threshold: float, draws: int, risk: float = 1e-9) -> int:
    """The number of equal minima that two sets with this similarity fall short of with at most the probability ``risk``."""
    below, k = 0.0, 0
    while k < draws:
        below += math.comb(draws, k) * threshold**k * (1 - threshold) ** (draws - k)
        if below > risk:
            break
        k += 1
    return k


def _jaccard(a: Column, b: Column) -> Column:
    common = F.size(F.array_intersect(a, b))
    return common / (F.size(a) + F.size(b) - common)


def _block_links(apart: DataFrame, feats: DataFrame, threshold: float) -> DataFrame:
    """(a, b, score) of linked members of different components in one bucket, block against block."""
    block = F.pmod(F.xxhash64("doc_id", "d1"), F.ceil(F.col("members") / BLOCK)).cast("int")
    packed = apart.select("band", "key", block.alias("block"), "doc_id", "d1", "component").join(feats.select("doc_id", "d1", "f"), ["doc_id", "d1"])
    packed = settle(packed.groupBy("band", "key", "block").agg(F.collect_list(F.struct("doc_id", "component", "f")).alias("m")), "neardup-blocks")
    left, right = (packed.select("band", "key", F.col("block").alias(f"k{s}"), F.col("m").alias(f"m{s}")) for s in "ab")
    both = left.join(right, ["band", "key"]).where("ka <= kb")
    hits = F.flatten(
        F.transform(
            "ma",
            lambda x: F.transform(
                F.filter("mb", lambda y: (y["component"] != x["component"]) & (_jaccard(x["f"], y["f"]) >= threshold)),
                lambda y: F.struct(F.greatest(x["doc_id"], y["doc_id"]).alias("a"), F.least(x["doc_id"], y["doc_id"]).alias("b"), _jaccard(x["f"], y["f"]).alias("score")),
            ),
        )
    )
    return both.select(F.explode(hits).alias("h")).select("h.*").distinct()


def similar_links(docs: DataFrame, threshold: float = 0.6, stopwords: tuple[str, ...] = ()) -> DataFrame:
    """(a, b, score), a > b: links that connect all documents whose sets of token pairs have at least this Jaccard similarity.

    Tokens of one character are left out, and a text of one token has that token
    for a pair. Members of a class of equal sets link with its smallest id (score 1). Each
    round compares a class with its next candidates of other components, more of them each time, until none is left.
    Texts without tokens, null texts and null ids link with nothing; an
    empty table gives an empty result.
    """
    members, classes, left, sets = _candidates(docs, threshold, stopwords, "prefix")
    links, at_once = None, 1
    while links is None or not left.isEmpty():
        if at_once == 1:
            now = left.groupBy("a").agg(F.min("b").alias("b"))
        else:
            now = left.withColumn("i", F.row_number().over(W.partitionBy("a").orderBy("b"))).where(F.col("i") <= at_once).select("a", "b")
        now = settle(now, "neardup-compared")
        with text_batches(docs.sparkSession):
            found = settle(_compared(now, sets, threshold), "neardup-stars")
        links = found if links is None else links.unionByName(found)
        merged = settle(connected_components(links, "a", "b"), "neardup-merged")
        end = lambda s: merged.select(F.col("node").alias(s), F.col("component").alias(f"c{s}"))
        apart = left.join(now, ["a", "b"], "left_anti").join(end("a"), "a", "left").join(end("b"), "b", "left")
        rest = settle(apart.where(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select("a", "b"), "neardup-left")
        for done in (left, now, merged):
            discard(done)
        left, at_once = rest, at_once * 16
    ends = lambda s: classes.select(F.col("k").alias(s), F.col("rep").alias(f"r{s}"))
    between = links.join(ends("a"), "a").join(ends("b"), "b").where("ra <> rb").select(F.col("ra").alias("a"), F.col("rb").alias("b"), F.round("score", 3).alias("score"))
    copies = members.where("doc_id <> rep").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"), F.lit(1.0).alias("score"))
    return copies.unionByName(between)


def _sketches(stopwords: tuple[str, ...]):
    """Of each text with tokens: its id, two digests of its set and the set's size; then, a task, how often elements fall in each of ``2**CELL_BITS`` cells, in slices."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, waiting, size = np.zeros(1 << CELL_BITS, np.uint32), [], 0

        def add() -> None:
            if waiting:
                np.add(counts, np.bincount((np.concatenate(waiting) >> np.uint64(64 - CELL_BITS)).astype(np.int64), minlength=1 << CELL_BITS), out=counts, casting="unsafe")

        for batch in batches:
            rows = {name: [] for name in ("doc_id", "d1", "d2", "n")}
            ids = batch.column(0).to_pylist()
            for first, sets in pair_sets(batch.column(1), stopwords):
                for i, f in enumerate(sets, first):
                    if len(f) and ids[i] is not None:
                        d1, d2 = _digests(f)
                        for name, value in zip(rows, (ids[i], d1, d2, len(f)), strict=True):
                            rows[name].append(value)
                        waiting.append(f)
                        size += len(f)
                if size > 1 << 20:
                    add()
                    waiting, size = [], 0
            yield pa.RecordBatch.from_pydict(rows | {"slice": [None] * len(rows["n"]), "cells": [None] * len(rows["n"])}, _SKETCH)
        add()
        if counts.any():
            for i, cells in enumerate(np.split(counts, SLICES)):
                yield pa.RecordBatch.from_pydict({name: [None] for name in _SKETCH.names} | {"slice": [i], "cells": [zlib.compress(cells.tobytes(), 1)]}, _SKETCH)

    return run


def _digests(f: np.ndarray) -> tuple[int, int]:
    return struct.unpack("<qq", hashlib.blake2b(f.tobytes(), digest_size=16).digest())


def _sum_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for i, cells in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            total[i] = np.frombuffer(zlib.decompress(cells), np.uint32) + total.get(i, np.uint32(0))
    for i, cells in total.items():
        yield pa.RecordBatch.from_pydict({"slice": [i], "cells": [zlib.compress(cells.tobytes(), 1)]}, pa.schema([("slice", pa.int32()), ("cells", pa.binary())]))


def _prefixes(cells, threshold: float, stopwords: tuple[str, ...], column: str):
    """Of each text with tokens its rarest elements, by their cells: as many as hold ``COMMON`` elements in common with any similar set, if it has so many.

    Elements alone in their cell join with nothing; ``skip`` is their number.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often = cells.value
        for batch in batches:
            rows = {name: [] for name in ("doc_id", "d1", "d2", "n", "skip", column)}
            ids = batch.column(0).to_pylist()
            for first, sets in pair_sets(batch.column(1), stopwords):
                for i, f in enumerate(sets, first):
                    if len(f) and ids[i] is not None:
                        count = often[(f >> np.uint64(64 - CELL_BITS)).astype(np.int64)]
                        room = min(len(f), len(f) - _least(threshold, len(f)) + COMMON)
                        order = np.argsort(count, kind="stable")[:room]
                        skip = int(np.searchsorted(count[order], 1, side="right"))
                        for name, value in zip(rows, (ids[i], *_digests(f), len(f), skip, f[order[skip:]].tobytes()), strict=True):
                            rows[name].append(value)
            yield pa.RecordBatch.from_pydict(rows, pa.schema([("doc_id", pa.int64()), ("d1", pa.int64()), ("d2", pa.int64()), ("n", pa.int32()), ("skip", pa.int32()), (column, pa.binary())]))

    return run


def _least(threshold: float, n):
    """How many elements a set of ``n`` has in common at least with a similar one."""
    return np.ceil(threshold * n - 1e-9).astype(np.int64)


def _elements(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(x, k, n, at): a row an element of a prefix, by half of its bits, with its place in the whole order of the set.

    Elements that are alike in that half only add to the meetings of sets, which are compared as a whole later.
    """
    for batch in batches:
        k, n, skip, f = batch.columns
        size = pc.binary_length(f).to_numpy() // 8
        rows = np.repeat(np.arange(batch.num_rows), size)
        at = np.arange(len(rows)) - np.repeat(np.cumsum(size) - size, size) + skip.to_numpy()[rows]
        x = np.frombuffer(b"".join(f.to_pylist()), np.int64) >> 32
        yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(k.to_numpy()[rows]), pa.array(n.to_numpy()[rows]), pa.array(at.astype(np.int32))], names=["x", "k", "n", "at"])


def _meetings(threshold: float):
    """(a, b, need), a > b, for each element that two prefixes share, from rows sorted by element and class, if sizes and places leave room for the similarity.

    Similar sets meet so at least ``need`` times: that holds for the first ``COMMON`` elements that they share.
    """
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("need", pa.int32())])

    def meet(x: np.ndarray, k: np.ndarray, n: np.ndarray, at: np.ndarray) -> Iterator[pa.RecordBatch]:
        n = n.astype(np.int64)
        start = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]])) if len(x) else np.empty(0, np.int64)
        place = np.arange(len(x)) - np.repeat(start, np.diff(np.append(start, len(x))))
        late, step, ready, size = np.flatnonzero(place), 1, [], 0
        while len(late):
            i, j = late, late - step
            small, large = np.minimum(n[i], n[j]), np.maximum(n[i], n[j])
            least = _least(threshold, large)
            common = np.maximum(least, _least(threshold / (1 + threshold), n[i] + n[j]))
            fits = (k[i] != k[j]) & (large * threshold <= small + 1e-9) & (COMMON + np.minimum(n[i] - at[i], n[j] - at[j]) - 1 >= common)
            i, j, least = i[fits], j[fits], least[fits]
            ready.append((k[i], k[j], np.minimum(least, COMMON).astype(np.int32)))
            size += len(i)
            step += 1
            late = late[place[late] >= step]
            if size > 1 << 17 or not len(late):
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*ready, strict=True)], schema=schema)
                ready, size = [], 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            if batch.num_rows:
                held.append([c.to_numpy() for c in batch.columns])
                size += batch.num_rows
            if size > 1 << 18:
                rows = [np.concatenate(c) for c in zip(*held, strict=True)]
                whole = int(np.searchsorted(rows[0], rows[0][-1]))  # the last element may go on
                yield from meet(*(c[:whole] for c in rows))
                held = [[c[whole:] for c in rows]]
                size = 0
        if held:
            yield from meet(*(np.concatenate(c) for c in zip(*held, strict=True)))

    return run


def _scores(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = ([np.frombuffer(f, np.uint64) for f in batch.column(c).to_pylist()] for c in ("fa", "fb"))
            common = np.array([len(np.intersect1d(x, y, assume_unique=True)) for x, y in zip(a, b, strict=True)], np.float64)
            score = common / (np.array([len(x) + len(y) for x, y in zip(a, b, strict=True)], np.float64) - common)
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(score)], names=["a", "b", "score"]).filter(pa.array(score >= threshold))

    return run


def _compared(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """(a, b, score) of those of ``pairs`` whose sets are similar."""
    side = lambda s: sets.select(F.col("k").alias(s), F.col("f").alias(f"f{s}"))
    return pairs.select("a", "b").join(side("a"), "a").join(side("b"), "b").select("a", "b", "fa", "fb").mapInArrow(_scores(threshold), "a long, b long, score double")


def _candidates(docs: DataFrame, threshold: float, stopwords: tuple[str, ...], column: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Stored tables: every text with tokens and its class (doc_id, rep, k), the classes of equal sets (k, rep), in the order of
    their smallest ids, all pairs (a, b), a > b, of classes that may be similar, and the sets (k, f) of classes in such pairs.

    An exact join by prefixes: in any one order of all elements, the first ones of a set, all but a share ``threshold``
    of it and ``COMMON`` more, hold the first ``COMMON`` elements in common with any similar set. Elements are ordered
    by how many fall in their cell, so prefixes are rare elements and few other sets share so many. The order of
    elements bears on time alone. Only prefixes are shuffled; sets are made again for texts in pairs.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    with text_batches(spark):
        sketches = settle(docs.mapInArrow(_sketches(stopwords), "doc_id long, d1 long, d2 long, n int, slice int, cells binary"), "neardup-sketches")
        texts = sketches.where("slice IS NULL").select("doc_id", "d1", "d2")
        classes = settle(texts.groupBy("d1", "d2").agg(F.min("doc_id").alias("rep")).orderBy("rep").withColumn("k", F.monotonically_increasing_id()), "neardup-classes")
        members = settle(texts.join(classes, ["d1", "d2"]).select("doc_id", "rep", "k"), "neardup-members")
        often = np.zeros(1 << CELL_BITS, np.uint32)
        for r in sketches.where("slice IS NOT NULL").select("slice", "cells").repartition("slice").mapInArrow(_sum_cells, "slice int, cells binary").toLocalIterator():
            often[r.slice * len(often) // SLICES : (r.slice + 1) * len(often) // SLICES] = np.frombuffer(zlib.decompress(r.cells), np.uint32)
        discard(sketches)
        cells = spark.sparkContext.broadcast(often)
        known = classes.withColumnRenamed("rep", "doc_id")
        prefixes = docs.mapInArrow(_prefixes(cells, threshold, stopwords, column), f"doc_id long, d1 long, d2 long, n int, skip int, {column} binary")
        prefixes = settle(prefixes.join(known, ["doc_id", "d1", "d2"]).dropDuplicates(["doc_id", "d1", "d2"]).select("k", "n", "skip", column), "neardup-prefixes")
        cells.destroy()
        forget_shuffles(spark)
    elements = prefixes.select("k", "n", "skip", column).mapInArrow(_elements, "x long, k long, n int, at int").repartition("x").sortWithinPartitions("x", "k")
    met = elements.mapInArrow(_meetings(threshold), "a long, b long, need int")
    pairs = settle(met.groupBy("a", "b", "need").agg(F.count("*").alias("times")).where("times >= need").select("a", "b"), "neardup-candidates")
    discard(prefixes)
    forget_shuffles(spark)
    with text_batches(spark):
        nodes = settle(pairs.select(F.col("a").alias("k")).unionByName(pairs.select(F.col("b").alias("k"))).distinct().join(classes, "k"), "neardup-nodes")
        near = F.broadcast if nodes.count() <= BROADCAST_ROWS else lambda df: df  # so that texts are not shuffled
        again = docs.join(near(nodes.select(F.col("rep").alias("doc_id")).distinct()), "doc_id", "left_semi").mapInArrow(_sets(stopwords), "doc_id long, d1 long, d2 long, f binary")
        sets = again.join(near(nodes.withColumnRenamed("rep", "doc_id")), ["doc_id", "d1", "d2"]).select("k", "f").dropDuplicates(["k"])
        return members, classes.select("k", "rep"), pairs, settle(sets, "neardup-sets")


def _sets(stopwords: tuple[str, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_pylist()
            rows = [(ids[i], *_digests(f), f.tobytes()) for first, sets in pair_sets(batch.column(1), stopwords) for i, f in enumerate(sets, first) if len(f)]
            yield pa.RecordBatch.from_pylist([dict(zip(("doc_id", "d1", "d2", "f"), r, strict=True)) for r in rows], pa.schema([("doc_id", pa.int64()), ("d1", pa.int64()), ("d2", pa.int64()), ("f", pa.binary())]))

    return run


def similar_classes(docs: DataFrame, threshold: float = 0.6, stopwords: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """Every document with the smallest id of its class of equal sets (doc_id, rep), and all links (a, b), a > b, between
    classes whose sets have at least this Jaccard similarity. Ids are expected once."""
    members, classes, pairs, sets = _candidates(docs, threshold, stopwords, "f")
    ends = lambda s: classes.select(F.col("k").alias(s), F.col("rep").alias(f"r{s}"))
    links = _compared(pairs, sets, threshold).join(ends("a"), "a").join(ends("b"), "b")
    return members.select("doc_id", "rep"), links.select(F.col("ra").alias("a"), F.col("rb").alias("b"))


def greedy_keep(docs: DataFrame, threshold: float = 0.6, stopwords: tuple[str, ...] = ()) -> DataFrame:
    """doc_id of the documents that stay if they are gone through by id and one goes whenever a kept one is similar.

    Of a class of equal sets only the smallest can stay: what drops it drops all.
    Sets are compared with those of kept texts alone, as the rounds find them.
    Documents without tokens are like nothing and stay; rows without an id are left out.
    Ids are expected once.
    """
    members, classes, pairs, sets = _candidates(docs, threshold, stopwords, "f")

    def similar(links: DataFrame) -> DataFrame:
        return _compared(links.select(F.col("u").alias("a"), F.col("v").alias("b")), sets, threshold).select(F.col("a").alias("u"), F.col("b").alias("v"))

    with text_batches(docs.sparkSession):
        dropped = greedy_dropped(pairs, "a", "b", similar).select(F.col("node").alias("k")).join(classes, "k").select(F.col("rep").alias("doc_id"))
    copies = members.where("doc_id <> rep").select("doc_id")
    return docs.where("doc_id IS NOT NULL").select("doc_id").distinct().join(dropped.unionByName(copies), "doc_id", "left_anti")


def write_survivors(docs: DataFrame, kept: DataFrame, path: str) -> None:
    """The rows of ``docs`` whose doc_id is among ``kept``, one of equal rows, as JSON lines below ``path``."""
    docs.join(kept.select("doc_id").distinct(), "doc_id", "left_semi").dropDuplicates().write.mode("overwrite").json(path)


def neardup_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    return greedy_keep(table(spark, sf_dir, "documents").select("doc_id", "text"))


def neardup_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return connected_components(similar_links(table(spark, sf_dir, "documents")), "a", "b")


_TOKENS = r"list_filter(regexp_extract_all(lower(text), '[\p{L}\p{N}]+'), lambda x: length(x) > 1)"
_LINKS = f"""tok AS (SELECT doc_id, {_TOKENS} AS t FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
    fs AS (SELECT doc_id, list_distinct(CASE WHEN len(t) > 1 THEN list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1]) ELSE t END) AS f FROM tok WHERE len(t) > 0),
    pr AS (SELECT doc_id, len(f) AS n, unnest(f) AS x FROM fs),
    co AS (SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS c FROM pr a JOIN pr b ON a.x = b.x AND a.doc_id > b.doc_id AND a.n * 0.6 <= b.n AND b.n * 0.6 <= a.n GROUP BY 1, 2),
    ln AS MATERIALIZED (SELECT a, b FROM co WHERE c >= 0.6 * (na + nb - c))"""
QUERIES = {
    "neardup_groups": (neardup_groups, f"""WITH RECURSIVE {_LINKS}, e AS MATERIALIZED (SELECT a, b FROM ln UNION SELECT b, a FROM ln), r AS (SELECT DISTINCT a AS node, a AS x FROM e UNION SELECT r.node, e.b FROM r JOIN e ON e.a = r.x)
        SELECT node, min(x) AS component FROM r GROUP BY 1"""),
    "neardup_kept": (neardup_kept, f"""WITH RECURSIVE {_LINKS}, od AS MATERIALIZED (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS i, coalesce(nb, []) AS nb FROM documents LEFT JOIN (SELECT a AS doc_id, list(b) AS nb FROM ln GROUP BY 1) USING (doc_id) WHERE doc_id IS NOT NULL),
        g AS (SELECT 0::BIGINT AS i, []::BIGINT[] AS kept UNION ALL SELECT o.i, CASE WHEN list_has_any(o.nb, g.kept) THEN g.kept ELSE list_append(g.kept, o.doc_id) END FROM g JOIN od o ON o.i = g.i + 1)
        SELECT unnest(kept) AS doc_id FROM (SELECT kept FROM g ORDER BY i DESC LIMIT 1)"""),
}
