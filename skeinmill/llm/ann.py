"""Approximate nearest neighbours by a hierarchical k-means tree with best-bin-first search.

The tree is fitted on a bounded sample; every row is then indexed by descent to
one leaf. A search walks the tree best bin first: a priority queue ordered by
the query's inner product with node centres yields leaves, nearest first. How
many leaves to visit is calibrated: for a bounded set of queries the true
neighbours over all rows are found by brute force, and visits widen until the
leaves visited hold the target share of them.

Vectors of each length are searched among themselves. The ``MOST_TREES`` commonest
lengths with more rows than a leaf is meant to hold have a tree; a shorter list
is one leaf, searched whole. A tree's depth follows from its rows.

The first ``FIRST_LEAVES`` visits give each query a floor, its k-th best score
so far, and the further ones only report what reaches it.

A leaf's rows are dealt to parts of bounded size, and the queries that visit the
leaf go to each of its parts. Both come as blocks that are compared by matrix
products, so a leaf with a third of all rows is many parts on many tasks. Scores are recomputed from the original
vectors in double precision, row by row, so equal vectors tie exactly.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from skeinmill.llm.embedding_join import BLOCK_BYTES, by_length, clean_vectors, matrix_of
from skeinmill.runtime import arrow_batch_rows, bounded_sample, discard, settle, table

FIRST_LEAVES = 4
MOST_TREES = 8
MOST_DEPTH = 4
_NODE_BITS = 32


class KMeansTree:
    """Nodes in breadth-first order: centres, children (first, count); a node without children is a leaf."""

    def __init__(self, sample: np.ndarray, branching: int = 8, depth: int = 2, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.centres, self.first, self.count = [sample.mean(axis=0)], [0], [0]
        level = [(0, sample)]
        for _ in range(depth):
            following = []
            for node, rows in level:
                parts = _kmeans(rows, branching, rng)
                if len(parts) > 1:
                    self.first[node], self.count[node] = len(self.centres), len(parts)
                    for centre, own in parts:
                        following.append((len(self.centres), own))
                        self.centres.append(centre)
                        self.first.append(0)
                        self.count.append(0)
            level = following
        self.centres = np.array(self.centres)
        self.leaves = [i for i, c in enumerate(self.count) if not c]

    def assign(self, m: np.ndarray) -> np.ndarray:
        """The leaf of each row, by descent to the nearest child."""
        node = np.zeros(len(m), dtype=np.int64)
        half = 0.5 * (self.centres**2).sum(axis=1)
        while True:
            moved = False
            for parent in np.unique(node):
                if n := self.count[parent]:
                    rows, first = np.flatnonzero(node == parent), self.first[parent]
                    node[rows] = first + np.argmax(m[rows] @ self.centres[first : first + n].T - half[first : first + n], axis=1)
                    moved = True
            if not moved:
                return node

    def visits(self, queries: np.ndarray, leaves: int, leaf_rows: dict[int, int], rows: int) -> list[list[int]]:
        """Per query the first ``leaves`` leaves, best bin first, and further ones until they hold ``rows`` rows."""
        out = []
        for near in queries @ self.centres.T:
            heap, order, held = [(-near[0], 0)], [], 0
            while heap and (len(order) < leaves or held < rows):
                _, node = heapq.heappop(heap)
                if self.count[node]:
                    for child in range(self.first[node], self.first[node] + self.count[node]):
                        heapq.heappush(heap, (-near[child], child))
                elif leaf_rows.get(node, 0):
                    order.append(node)
                    held += leaf_rows[node]
            out.append(order)
        return out


def _kmeans(rows: np.ndarray, k: int, rng: np.random.Generator) -> list[tuple[np.ndarray, np.ndarray]]:
    k = min(k, len(rows) // 2)
    if k < 2:
        return []
    centres = rows[rng.choice(len(rows), k, replace=False)]
    for _ in range(12):
        own = np.argmax(rows @ centres.T - 0.5 * (centres**2).sum(axis=1), axis=1)
        centres = np.array([rows[own == i].mean(axis=0) if (own == i).any() else centres[i] for i in range(k)])
    own = np.argmax(rows @ centres.T - 0.5 * (centres**2).sum(axis=1), axis=1)
    return [(centres[i], rows[own == i]) for i in range(k) if (own == i).any()]


class Forest:
    """A tree for each of some vector lengths; every other length is one leaf. Leaves are numbered over all lengths."""

    def __init__(self, trees: dict[int, KMeansTree]):
        self.trees = trees
        self.leaves = dict.fromkeys(trees, 1)  # to visit, of each tree

    def assign(self, m: np.ndarray) -> np.ndarray:
        d = m.shape[1]
        return (d << _NODE_BITS) + (self.trees[d].assign(m) if d in self.trees else np.zeros(len(m), np.int64))

    def visits(self, m: np.ndarray, leaf_rows: dict[int, int], rows: int, every: bool = False) -> list[list[int]]:
        """Per query its length's leaves in the order of visits."""
        d = m.shape[1]
        base = d << _NODE_BITS
        if d not in self.trees:
            return [[base] if leaf_rows.get(base, 0) else []] * len(m)
        own = {leaf - base: n for leaf, n in leaf_rows.items() if leaf >> _NODE_BITS == d}
        found = self.trees[d].visits(m, len(own) if every else self.leaves[d], own, rows)
        return [[base + leaf for leaf in order] for order in found]


def _indexer(forest: Forest):
    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, at in by_length(batch.column(1)):
                own = batch.take(pa.array(at))
                m = matrix_of(own.column(1))
                yield pa.RecordBatch.from_arrays([own.column(0), pa.array(forest.assign(m)), pa.array([r.tobytes() for r in m], pa.binary())], names=["vec_id", "leaf", "raw"])

    return index


def _matrices(raws: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, matrix) of the vectors of each length."""
    sizes = np.array([len(r) for r in raws])
    for n in np.unique(sizes):
        at = np.flatnonzero(sizes == n)
        yield at, np.frombuffer(b"".join(raws[i] for i in at)).reshape(len(at), -1)


def _visitor(forest: Forest, leaf_rows: dict[int, int], rows: int, turns: slice):
    """Rows (vec_id, leaf, raw, floor) for the visits whose turns are in ``turns``."""

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, raw, floors = (batch.column(c).to_pylist() for c in range(3))
            for at, m in _matrices(raw):
                for start in range(0, len(at), 256):
                    part = at[start : start + 256]
                    order = forest.visits(m[start : start + 256], leaf_rows, rows)
                    flat = [(ids[i], leaf, raw[i], floors[i]) for i, o in zip(part, order, strict=True) for leaf in o[turns]]
                    if flat:
                        kinds = (pa.int64(), pa.int64(), pa.binary(), pa.float64())
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*flat, strict=True), kinds, strict=True)], names=["vec_id", "leaf", "raw", "floor"])

    return visit


def _blocker(block_rows: int):
    """Packs rows (vec_id, leaf, part, raw, floor) that come sorted by leaf and part into blocks of one part."""

    def block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list[int] = []
        raw: list[bytes] = []
        floors: list[float] = []
        place = None

        def done() -> pa.RecordBatch:
            packed = (np.array(ids, np.int64).tobytes(), b"".join(raw), np.array(floors, np.float64).tobytes())
            return pa.RecordBatch.from_arrays([*(pa.array([x], pa.int64()) for x in place), *(pa.array([x], pa.binary()) for x in packed)], names=["leaf", "part", "ids", "raw", "floors"])

        for batch in batches:
            for i, leaf, part, r, f in zip(*(batch.column(c).to_pylist() for c in range(5)), strict=True):
                if ids and (place != (leaf, part) or len(ids) >= min(block_rows, max(16, BLOCK_BYTES // len(raw[0])))):
                    yield done()
                    ids, raw, floors = [], [], []
                place = leaf, part
                ids.append(i)
                raw.append(r)
                floors.append(f)
        if ids:
            yield done()

    return block


def _blocks(rows: DataFrame, salts: int, block_rows: int) -> DataFrame:
    """Blocks of one part of a leaf each; a part's rows go to ``salts`` partitions."""
    salt = F.pmod(F.xxhash64("vec_id"), F.lit(salts))
    spread = rows.withColumn("salt", salt).repartition("leaf", "part", "salt").sortWithinPartitions("leaf", "part", "salt")
    return spread.select("vec_id", "leaf", "part", "raw", "floor").mapInArrow(_blocker(block_rows), "leaf long, part long, ids binary, raw binary, floors binary")


def nearest_in(q: np.ndarray, q_ids: np.ndarray, m: np.ndarray, ids: np.ndarray, k: int, floors: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query index, row index, score) of each query's k best rows of at least its floor, without its own id, ties to the smaller id."""
    fast = q @ m.T
    fast[q_ids[:, None] == ids] = -np.inf
    qs, rows, scores = [], [], []
    size = np.abs(fast[np.isfinite(fast)]).max(initial=0.0)
    for i in range(len(q)):
        have = np.isfinite(fast[i])
        if not have.any():
            continue
        edge = np.partition(fast[i], -k)[-k] if len(ids) > k else -np.inf
        if floors is not None:
            edge = max(edge, floors[i])
        near = np.flatnonzero(have & (fast[i] >= edge - 1e-12 * size))
        if not len(near):
            continue
        exact = (m[near] * q[i]).sum(axis=1)
        best = np.lexsort((ids[near], -exact))[:k]
        qs.append(np.full(len(best), i))
        rows.append(near[best])
        scores.append(exact[best])
    if not qs:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
    return np.concatenate(qs), np.concatenate(rows), np.concatenate(scores)


class _Best:
    """The k best (query, id, score) seen by a task, cut back whenever the list has grown."""

    def __init__(self, k: int):
        self.k, self.parts, self.held = k, [], 0

    def add(self, q: np.ndarray, i: np.ndarray, s: np.ndarray) -> None:
        self.parts.append((q, i, s))
        self.held += len(q)
        if self.held > 1_000_000:
            self.cut()

    def cut(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if not self.parts:
            return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
        q, i, s = (np.concatenate(c) for c in zip(*self.parts, strict=True))
        order = np.lexsort((i, -s, q))
        q, i, s = q[order], i[order], s[order]
        start = np.flatnonzero(np.r_[True, q[1:] != q[:-1]])
        rank = np.arange(len(q)) - np.repeat(start, np.diff(np.r_[start, len(q)]))
        keep = rank < self.k
        self.parts, self.held = [(q[keep], i[keep], s[keep])], int(keep.sum())
        return self.parts[0]

    def batches(self) -> Iterator[pa.RecordBatch]:
        q, i, s = self.cut()
        for at in range(0, len(q), 50_000):
            yield pa.RecordBatch.from_arrays([pa.array(c[at : at + 50_000]) for c in (q, i, s)], names=["query_id", "vec_id", "score"])


def _searcher(k: int):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = _Best(k)
        for batch in batches:
            for n in range(batch.num_rows):
                kinds = (np.int64, np.float64, np.int64, np.float64, np.float64)
                ids, raw, q_ids, q_raw, floors = (np.frombuffer(batch.column(c)[n].as_buffer(), t) for c, t in enumerate(kinds))
                qi, ri, s = nearest_in(q_raw.reshape(len(q_ids), -1), q_ids, raw.reshape(len(ids), -1), ids, k, floors)
                best.add(q_ids[qi], ids[ri], s)
        yield from best.batches()

    return search


def _brute(queries: dict[int, tuple[np.ndarray, np.ndarray]], k: int):
    """Each partition's k best rows of a bounded set of queries (ids and vectors by length), with their leaves."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, leaf_of = _Best(k), {}
        for batch in batches:
            for start in range(0, batch.num_rows, 4096):
                part = batch.slice(start, 4096)
                ids, leaf = np.asarray(part.column(0)), np.asarray(part.column(1))
                for at, m in _matrices(part.column(2).to_pylist()):
                    if m.shape[1] not in queries:
                        continue
                    q_ids, q = queries[m.shape[1]]
                    qi, ri, s = nearest_in(q, q_ids, m, ids[at], k)
                    best.add(q_ids[qi], ids[at][ri], s)
                    leaf_of.update(zip(ids[at][ri].tolist(), leaf[at][ri].tolist(), strict=True))
            kept = set(best.cut()[1].tolist())
            leaf_of = {i: v for i, v in leaf_of.items() if i in kept}
        for b in best.batches():
            yield b.append_column("leaf", pa.array([leaf_of[i] for i in b.column(1).to_pylist()], pa.int64()))

    return scan


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search_nearest(
    vectors: DataFrame,
    queries: DataFrame,
    k: int = 20,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    target_recall: float = 0.96,
    sample_rows: int = 20_000,
    calibration_queries: int = 128,
    branching: int = 8,
    leaf_rows: int = 1024,
    block_rows: int = 1024,
) -> DataFrame:
    """The k rows of ``vectors`` with the largest inner product for each row of ``queries``, as found:
    query_id, rank (from 1), vec_id, score; ties to the smaller id, never the query's own id.

    A tree is fitted on the ``sample_rows`` rows of its length with the smallest
    id hashes, as deep as leaves of ``leaf_rows`` rows need but at most
    ``MOST_DEPTH`` levels; beyond branching ** MOST_DEPTH * leaf_rows rows leaves
    grow, in more parts. All rows are indexed. A vector's neighbours are those of
    its own length. Vectors that are null, zero or hold null or non-finite
    components take no part, as queries either. Of rows with one id and one
    vector one counts; an id with several vectors is a candidate with each, and
    as a query its smallest in array order counts. Fewer candidates than k are
    all returned. Empty tables give an empty result; other columns are ignored.
    """
    spark = vectors.sparkSession
    valid = clean_vectors(vectors, id_col, vec_col)
    common = valid.groupBy(F.size("vec").alias("d")).agg(F.count("*").alias("n")).where(F.col("n") > leaf_rows).orderBy(F.desc("n"), "d").limit(MOST_TREES).collect()
    trees = {}
    for r in common:
        depth = max(1, min(MOST_DEPTH, math.ceil(math.log(r.n / leaf_rows, branching))))
        sample = bounded_sample(valid.where(F.size("vec") == r.d), "vec_id", sample_rows, r.n).select("vec").toArrow()
        trees[r.d] = KMeansTree(matrix_of(sample.column(0).combine_chunks()), branching, depth)
    forest = Forest(trees)
    index = settle(valid.dropDuplicates(["vec_id", "vec"]).mapInArrow(_indexer(forest), "vec_id long, leaf long, raw binary"), "ann-index")
    sizes = settle(index.groupBy("leaf").agg(F.count("*").alias("n")), "ann-leaves")
    held = {r["leaf"]: r["n"] for r in sizes.collect()}  # a row a leaf
    asked = clean_vectors(queries, id_col, vec_col).groupBy("vec_id").agg(F.min("vec").alias("vec"))
    asked = settle(asked.mapInArrow(_indexer(forest), "vec_id long, leaf long, raw binary"), "ann-queries")

    trial = {}
    for d in trees:
        own = asked.where(F.shiftright("leaf", _NODE_BITS) == d)
        picked = bounded_sample(own, "vec_id", calibration_queries, own.count()).collect()
        if picked:
            trial[d] = np.array([r.vec_id for r in picked], np.int64), np.frombuffer(b"".join(bytes(r.raw) for r in picked)).reshape(len(picked), -1)
    if trial:
        truth = _ranked(index.mapInArrow(_brute(trial, k), "query_id long, vec_id long, score double, leaf long"), k).select("query_id", "leaf").collect()
        for d, (ids, q) in trial.items():
            order = {int(i): {leaf: n for n, leaf in enumerate(o)} for i, o in zip(ids, forest.visits(q, held, 0, every=True), strict=True)}
            depths = np.sort([order[r.query_id][r.leaf] + 1 for r in truth if r.query_id in order and r.leaf >> _NODE_BITS == d])
            if len(depths):
                forest.leaves[d] = int(depths[min(len(depths) - 1, int(np.ceil(target_recall * len(depths))) - 1)])

    none = F.lit(float("-inf"))
    parts = F.broadcast(sizes.select("leaf", F.ceil(F.col("n") / (4 * block_rows)).alias("parts")))  # MOST_TREES * branching ** MOST_DEPTH rows and one a length
    part = F.pmod(F.xxhash64(F.lit(3), "vec_id"), F.col("parts"))
    own = settle(_blocks(index.join(parts, "leaf").withColumn("part", part).withColumn("floor", none), 1, block_rows).drop("floors"), "ann-leaf-blocks")
    discard(index)

    def searched(asking: DataFrame, turns: slice) -> DataFrame:
        """What the visits of these turns find at or above each query's floor."""
        visits = asking.select("vec_id", "raw", "floor").mapInArrow(_visitor(forest, held, k + 1, turns), "vec_id long, leaf long, raw binary, floor double")
        each = visits.join(parts, "leaf").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
        blocks = settle(_blocks(each, 4, block_rows // 2), "ann-query-blocks").select("leaf", "part", F.col("ids").alias("q_ids"), F.col("raw").alias("q_raw"), "floors")
        with arrow_batch_rows(spark, 4):
            joined = own.join(blocks, ["leaf", "part"]).select("ids", "raw", "q_ids", "q_raw", "floors")
            return settle(joined.mapInArrow(_searcher(k), "query_id long, vec_id long, score double"), "ann-found")

    first = searched(asked.withColumn("floor", none), slice(0, FIRST_LEAVES))
    floors = _ranked(first.distinct(), k).where(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), F.col("score").alias("floor"))
    rest = searched(asked.join(floors, "vec_id", "left").withColumn("floor", F.coalesce("floor", none)), slice(FIRST_LEAVES, None))
    return _ranked(first.unionByName(rest).distinct(), k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return search_nearest(vectors, vectors.where(F.col("vec_id") % 20 == 0), 20)


ORACLE = None
