"""Epsilon grid order join: near-duplicate embeddings by cosine, every pair within reach tested.

Unit vectors with cosine >= t lie within eps = sqrt(2 - 2t). Vectors are put in
the lexicographic order of grid cells of width eps on their leading principal
dimensions; that sequence is cut into blocks. The join recurses over sequence
intervals: a pair of intervals whose bounding boxes (over all rotated
dimensions) are farther apart than eps is skipped with everything below it, and
surviving pairs of blocks are compared by one matrix product in double
precision. Neighbouring blocks make a tile, and a task loads two tiles for all
surviving pairs between them, so a block travels once a tile and not once a pair. A comparison gives, per vector, a count of its links and one edge to
the smallest vector of its component inside the pair, so a dense group costs
arithmetic but never a row per pair.

The rotation only orders and bounds; it is orthonormal, so its quality affects
speed and never the result. Vectors of different lengths never link: the length
comes first in the order, ends a block and is part of every interval's key. The
``AXES_LENGTHS`` commonest lengths are rotated, others stay as they are. Interval
pairs live in tables, level by level, and the driver only holds a d x d moment
matrix for each rotated length.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skeinmill.llm.blocks import local_components
from skeinmill.operators.graph import connected_components
from skeinmill.runtime import arrow_batch_rows, discard, settle, table

_SEQ_BITS = 20
AXES_LENGTHS = 4
BLOCK_BYTES = 1 << 20
#: Partitions of about four blocks whose blocks make a tile.
TILE_PARTS = 2


def clean_vectors(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """vec_id and vec (array<double>) of rows whose vector is non-null, not zero and finite throughout."""
    vec = F.col(vec_col).cast("array<double>")
    finite = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return (
        vectors.select(F.col(id_col).cast("long").alias("vec_id"), vec.alias("vec"))
        .where(F.col("vec_id").isNotNull() & F.col("vec").isNotNull() & finite & F.exists("vec", lambda x: x != 0.0))
    )


def matrix_of(column: pa.Array) -> np.ndarray:
    """Rows of a list column, all of one length, as a double matrix."""
    return np.asarray(column.flatten(), dtype=np.float64).reshape(len(column), -1)


def _scaled(m: np.ndarray) -> np.ndarray:
    """Each row divided by a power of two (exact), so that squares neither overflow nor vanish."""
    return np.ldexp(m, -np.frexp(np.abs(m).max(axis=1))[1][:, None])


def _unit(m: np.ndarray) -> np.ndarray:
    m = _scaled(m)
    return m / np.sqrt((m * m).sum(axis=1))[:, None]


def _principal_axes(classes: DataFrame, dim: int) -> np.ndarray:
    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, s, ss = 0.0, np.zeros(dim), np.zeros((dim, dim))
        for batch in batches:
            u = _unit(matrix_of(batch.column(0)))
            n, s, ss = n + len(u), s + u.sum(axis=0), ss + u.T @ u
        yield pa.RecordBatch.from_arrays([pa.array([np.concatenate([[n], s, ss.ravel()]).tobytes()], pa.binary())], names=["m"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 + dim + dim * dim)
        for batch in batches:
            for m in batch.column(0):
                total += np.frombuffer(m.as_py())
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["m"])

    parts = classes.select("vec").mapInArrow(moments, "m binary").repartition(8).mapInArrow(add, "m binary").collect()
    total = sum(np.frombuffer(r.m) for r in parts)
    n, s, ss = total[0], total[1 : 1 + dim], total[1 + dim :].reshape(dim, dim)
    if n == 0:
        return np.eye(dim)
    cov = ss / n - np.outer(s / n, s / n)
    return np.linalg.eigh((cov + cov.T) / 2)[1][:, ::-1].copy()


def by_length(column: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    """(length, row numbers) for the rows of a list column, shortest first."""
    sizes = np.diff(np.asarray(column.offsets))
    for d in np.unique(sizes):
        yield int(d), np.flatnonzero(sizes == d)


def _rotated(m: np.ndarray, axes: np.ndarray | None) -> np.ndarray:
    return _unit(m) if axes is None else _unit(m) @ axes


def _placer(axes: dict[int, np.ndarray], eps: float, grid_dims: int):
    names = [f"c{i}" for i in range(grid_dims)]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for d, at in by_length(batch.column(3)):
                own = batch.take(pa.array(at))
                m = matrix_of(own.column(3))
                cells = np.zeros((len(m), grid_dims), np.int32)
                width = min(d, grid_dims)
                cells[:, :width] = np.floor(_rotated(m, axes[d][:, :width] if d in axes else None)[:, :width] / eps)
                rows = np.ascontiguousarray(m).view(f"V{8 * d}").ravel()
                yield pa.RecordBatch.from_arrays(
                    [own.column(0), own.column(1), own.column(2), pa.array([r.tobytes() for r in rows], pa.binary()), pa.array(np.full(len(m), d, np.int32)), *(pa.array(cells[:, i]) for i in range(grid_dims))],
                    names=["class_id", "k1", "mult", "raw", "d", *names],
                )

    return place, ", ".join(["d int", *(f"{n} int" for n in names)])


def _packer(axes: dict[int, np.ndarray], block_rows: int):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        ids, keys, mult, raw, seq, dim = [], [], [], [], 0, None

        def block() -> pa.RecordBatch:
            m = np.frombuffer(b"".join(raw)).reshape(-1, dim)
            z = _rotated(m, axes.get(dim))
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([(part << _SEQ_BITS) + seq]), pa.array([dim], pa.int32()), *(pa.array([np.array(x, np.int64).tobytes()]) for x in (ids, keys, mult)),
                    pa.array([m.tobytes()]), pa.array([z.min(axis=0).tolist()]), pa.array([z.max(axis=0).tolist()]),
                ],
                names=["block", "d", "ids", "keys", "mult", "raw", "lo", "hi"],
            )

        for batch in batches:
            for i, key, k, r, d in zip(*(batch.column(c).to_pylist() for c in range(5)), strict=True):
                if ids and (d != dim or len(ids) >= min(block_rows, max(16, BLOCK_BYTES // (8 * d)))):
                    yield block()
                    ids, keys, mult, raw, seq = [], [], [], [], seq + 1
                dim = d
                ids.append(i)
                keys.append(key)
                mult.append(k)
                raw.append(r)
        if ids:
            yield block()

    return pack


def _shifts(last_part: int, last_seq: int) -> list[int]:
    """Bits of a block's number below each level's intervals, from the top: eight intervals make one of the level above."""
    levels = lambda n: range(3 * math.ceil(n.bit_length() / 3) - 3, -1, -3)
    parts = [_SEQ_BITS + s for s in levels(last_part)]
    return parts + list(levels(last_seq)) if last_seq else [*parts[:-1], 0]


def _block_pairs(meta: DataFrame, eps: float) -> DataFrame:
    """Pairs (a <= b) of blocks of one length that may hold linked vectors, found by recursion over intervals of eight."""
    ends = meta.agg(F.max(F.shiftright("block", _SEQ_BITS)).alias("part"), F.max(F.col("block").bitwiseAND((1 << _SEQ_BITS) - 1)).alias("seq")).collect()[0]
    shifts = _shifts(ends["part"] or 0, ends["seq"] or 0)
    bound = (eps + 1e-9) ** 2
    gap = lambda lo1, hi1, lo2, hi2: F.aggregate(
        F.transform(
            F.arrays_zip(lo1.alias("p"), hi1.alias("q"), lo2.alias("r"), hi2.alias("s")),
            lambda x: F.pow(F.greatest(x["r"] - x["q"], x["p"] - x["s"], F.lit(0.0)), 2),
        ),
        F.lit(0.0),
        lambda acc, x: acc + x,
    )
    pairs, above = None, None
    for shift in shifts:
        node = F.shiftright("block", shift).alias("node")
        dims = meta.select(node, "d", F.posexplode(F.arrays_zip("lo", "hi")).alias("k", "box"))
        boxes = dims.groupBy("d", "node", "k").agg(F.min("box.lo").alias("lo"), F.max("box.hi").alias("hi")).groupBy("d", "node").agg(
            F.sort_array(F.collect_list(F.struct("k", "lo", "hi"))).alias("box")
        ).select("d", "node", F.col("box.lo").alias("lo"), F.col("box.hi").alias("hi"))
        parent = F.lit(0).cast("long") if above is None else F.shiftright("node", above - shift)
        boxes = boxes.select("d", "node", "lo", "hi", parent.alias("up"))
        left = boxes.select("d", F.col("node").alias("a"), F.col("lo").alias("lo_a"), F.col("hi").alias("hi_a"), F.col("up").alias("up_a"))
        right = boxes.select("d", F.col("node").alias("b"), F.col("lo").alias("lo_b"), F.col("hi").alias("hi_b"), F.col("up").alias("up_b"))
        if pairs is None:
            joined = left.withColumn("up_b", F.col("up_a")).join(right, ["d", "up_b"])
        else:
            joined = pairs.join(left, ["d", "up_a"]).join(right, ["d", "up_b"])
        near = gap(F.col("lo_a"), F.col("hi_a"), F.col("lo_b"), F.col("hi_b")) <= bound
        pairs = joined.where((F.col("a") <= F.col("b")) & near).select("d", F.col("a").alias("up_a"), F.col("b").alias("up_b"))
        above = shift
    return pairs.select(F.col("up_a").alias("a"), F.col("up_b").alias("b"))


def _matcher(threshold: float):
    """Compares the pairs in ``todo`` of the blocks that come sorted by (low, high, block)."""

    def load(batch: pa.RecordBatch, i: int):
        dim = batch.column(3)[i].as_py()
        ids, keys, mult, raw = (np.frombuffer(batch.column(4 + k)[i].as_buffer(), t) for k, t in enumerate((np.int64, np.int64, np.int64, np.float64)))
        m = _scaled(raw.reshape(-1, dim))
        return ids, keys, mult, m, np.sqrt((m * m).sum(axis=1))

    def links(one, two, same: bool) -> pa.RecordBatch | None:
        (ids_a, keys_a, mult_a, a, norm_a), (ids_b, keys_b, mult_b, b, norm_b) = one, two
        link = (a @ b.T) / (norm_a[:, None] * norm_b) >= threshold
        if same:
            np.fill_diagonal(link, False)
        if not link.any():
            return None
        ids, keys = (ids_a, keys_a) if same else (np.concatenate([ids_a, ids_b]), np.concatenate([keys_a, keys_b]))
        counts = link @ mult_b if same else np.concatenate([link @ mult_b, mult_a @ link])
        up_a, up_b = local_components(link, same)
        label = up_a if same else np.concatenate([up_a, up_b])
        smallest = np.full(len(ids), np.iinfo(np.int64).max)
        np.minimum.at(smallest, label, ids)
        hit = counts > 0
        return pa.RecordBatch.from_arrays([pa.array(x[hit]) for x in (ids, keys, counts, smallest[label])], names=["class_id", "k1", "links", "peer"])

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, held, peers, wanted = None, {}, {}, set()
        for batch in batches:
            for i in range(batch.num_rows):
                here = batch.column(0)[i].as_py(), batch.column(1)[i].as_py()
                if here != place:
                    place, held, peers = here, {}, {}
                    for pair in batch.column(8)[i].as_py():
                        peers.setdefault(pair["b"], []).append(pair["a"])
                    wanted = {a for some in peers.values() for a in some}
                block = batch.column(2)[i].as_py()
                own = load(batch, i)
                if block in wanted:
                    held[block] = own
                for a in peers.get(block, ()):
                    found = links(held[a], own, a == block)
                    if found is not None:
                        yield found

    return match


def _tiled(blocks: DataFrame, pairs: DataFrame) -> DataFrame:
    """The blocks that the pairs of two tiles name, once for those tiles, with the pairs."""
    tile = lambda c: F.floor(F.shiftright(c, _SEQ_BITS) / TILE_PARTS)
    work = pairs.groupBy(tile("a").alias("low"), tile("b").alias("high")).agg(F.collect_list(F.struct("a", "b")).alias("todo"))
    asked = work.select("low", "high", "todo", F.explode(F.array_distinct(F.array("low", "high"))).alias("tile"))
    named = F.exists("todo", lambda p: (p["a"] == F.col("block")) | (p["b"] == F.col("block")))
    rows = blocks.withColumn("tile", tile("block")).join(asked, "tile").where(named)
    return rows.select("low", "high", "block", "d", "ids", "keys", "mult", "raw", "todo").repartition("low", "high").sortWithinPartitions("low", "high", "block")


def epsilon_grid_join(
    vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", threshold: float = 0.9, block_rows: int = 2048, grid_dims: int = 4
) -> DataFrame:
    """Link vectors whose cosine (double precision) is at least ``threshold`` (0 < threshold <= 1).

    Returns one row per input row: vec_id, n_links (other ids linked directly),
    component_id (smallest id reachable), kept (vec_id = component_id).

    Vectors that are null, zero, or hold null or non-finite components link with
    nothing, and vectors of different lengths never link with one another. Equal
    vectors are one class with a count and link with each other; a repeated row
    counts once. An id with several vectors joins whatever any of them links
    with; its n_links is that of its best linked vector, and whoever links with
    two of its vectors counts both. A null id gives a
    row with component null that is not kept. An empty table gives an empty
    result; other columns are ignored.
    """
    spark = vectors.sparkSession
    everyone = vectors.select(F.col(id_col).cast("long").alias("vec_id"))
    valid = clean_vectors(vectors, id_col, vec_col)
    size = valid.groupBy(F.size("vec").alias("d")).agg(F.count("*").alias("n"))
    common = size.orderBy(F.desc("n"), F.desc("d")).limit(AXES_LENGTHS).collect()
    if not common:
        return everyone.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.col("vec_id").isNotNull().alias("kept"))
    total = size.agg(F.sum("n").alias("rows"), F.sum(F.col("n") * F.col("d") * 8).alias("bytes")).collect()[0]
    keyed = valid.select("vec_id", "vec", F.xxhash64(F.lit(7), "vec").alias("k1"), F.xxhash64(F.lit(11), "vec").alias("k2"))
    classes = settle(
        keyed.groupBy("k1", "k2", "vec_id").agg(F.first("vec").alias("vec")).groupBy("k1", "k2").agg(F.min("vec_id").alias("class_id"), F.count("*").alias("mult"), F.first("vec").alias("vec")),
        "ego-classes",
    )
    axes = {r.d: _principal_axes(classes.where(F.size("vec") == r.d), r.d) for r in common}
    eps = math.sqrt(max(0.0, 2 - 2 * threshold)) + 1e-7
    parts = max(1, math.ceil(total["rows"] / (4 * block_rows)), math.ceil(total["bytes"] / (4 * BLOCK_BYTES)))
    place, cell_schema = _placer(axes, eps, grid_dims)
    order = ["d", *(f"c{i}" for i in range(grid_dims)), "class_id"]
    placed = classes.select("class_id", "k1", "mult", "vec").mapInArrow(place, f"class_id long, k1 long, mult long, raw binary, {cell_schema}")
    blocks = settle(
        placed.repartitionByRange(parts, *order).sortWithinPartitions(*order).select("class_id", "k1", "mult", "raw", "d").mapInArrow(
            _packer(axes, block_rows), "block long, d int, ids binary, keys binary, mult binary, raw binary, lo array<double>, hi array<double>"
        ),
        "ego-blocks",
    )
    pairs = settle(_block_pairs(blocks.select("block", "d", "lo", "hi"), eps), "ego-pairs")
    with arrow_batch_rows(spark, 4):
        found = settle(_tiled(blocks.drop("lo", "hi"), pairs).mapInArrow(_matcher(threshold), "class_id long, k1 long, links long, peer long"), "ego-links")
    discard(blocks)
    discard(pairs)
    links = found.groupBy("class_id", "k1").agg(F.sum("links").alias("links"))
    components = connected_components(found.where("class_id <> peer"), "class_id", "peer")
    per_class = (
        classes.select("k1", "k2", "class_id", "mult")
        .join(links, ["class_id", "k1"], "left")
        .join(components, F.col("class_id") == F.col("node"), "left")
        .select("k1", "k2", (F.coalesce("links", F.lit(0)) + F.col("mult") - 1).alias("links"), F.coalesce("component", "class_id").alias("class_component"))
    )
    per_id = keyed.select("vec_id", "k1", "k2").distinct().join(per_class, ["k1", "k2"]).groupBy("vec_id").agg(F.max("links").alias("links"), F.min("class_component").alias("comp"))
    component = F.coalesce("comp", "vec_id")
    return everyone.join(per_id, "vec_id", "left").select(
        "vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("vec_id"), F.lit(False)).alias("kept")
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return epsilon_grid_join(table(spark, sf_dir, "embeddings"), threshold=0.9)


ORACLE = """
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), n AS (SELECT vec_id, e, sqrt(list_dot_product(e, e)) AS norm FROM v),
edge AS (
  SELECT a.vec_id AS x, b.vec_id AS y FROM n a JOIN n b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_dot_product(a.e, b.e) / (a.norm * b.norm) >= 0.9
), reach AS (
  SELECT vec_id AS src, vec_id AS dst FROM embeddings
  UNION SELECT r.src, e.y FROM reach r JOIN edge e ON r.dst = e.x
), comp AS (SELECT src, min(dst) AS c FROM reach GROUP BY 1), cnt AS (SELECT x, count(*) AS k FROM edge GROUP BY 1)
SELECT e.vec_id, coalesce(cnt.k, 0)::BIGINT AS n_links, comp.c AS component_id, comp.c = e.vec_id AS kept
FROM embeddings e JOIN comp ON comp.src = e.vec_id LEFT JOIN cnt ON cnt.x = e.vec_id
"""
