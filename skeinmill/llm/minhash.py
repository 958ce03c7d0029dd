"""MinHash near-duplicates by circulant permutations, banding and exact verification.

Two permutations of the 32-bit universe do for the whole signature. The first
scatters the shingles; the second, shifted circularly by (k + 1) * ``_STRIDE``
places, gives coordinate k (an odd stride, so all shifts differ). Coordinates are cut into bands; texts that agree on a band fall
into one bucket, and every candidate link is confirmed on the full shingle sets.

With the default 60 bands of 6 coordinates a pair at the default threshold of
0.8 shares no bucket with probability (1 - 0.8**6)**60, about 1e-8; at 0.85, 40
bands give less than 1e-8.

How large groups stay cheap:

* Texts with equal shingle sets are one class (grouped by a digest of the set)
  and only its smallest id goes on.
* Buckets are never listed whole. First every bucket picks one centre (a
  grouped minimum) and each member is compared with it; confirmed links merge
  components. Only components are returned, so members that share one need no
  more comparing, and a bucket that holds one component is done.
* What is left in small buckets (at most ``SMALL``) goes as distinct pairs. What
  is left in larger ones is packed in blocks of shingle hashes, blocks are
  gathered in tiles of ``TILE_BYTES``, and a task that compares two tiles reads
  each of them once: intersections of all their shingle sets come from matrix
  products, and only edges that connect components come back. No pair of
  different components is skipped and no row is made per pair.

A text is known by its id and the first half of its digest, so an id with several
texts has each of them sketched, compared and linked; components are over ids.
Tables that nothing reads any more are deleted as the steps go on.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from skeinmill.llm.blocks import spanning_edges
from skeinmill.llm.shingles import mix64, shingle_sets
from skeinmill.operators.graph import connected_components
from skeinmill.runtime import arrow_batch_rows, discard, settle, table, text_batches

SMALL = 16
BLOCK_ROWS = 256
BLOCK_BYTES = 4 << 20
TILE_BYTES = 16 << 20
_STRIDE = 0x9E3779B1
_M = np.uint32


def _scatter(x: np.ndarray) -> np.ndarray:
    """First permutation: of the 32-bit index that a shingle hash folds to."""
    x = (x >> np.uint64(32)).astype(np.uint32)
    x = (x ^ (x >> _M(16))) * _M(0x7FEB352D)
    return x ^ (x >> _M(15))


def circulant_signatures(sets: list[np.ndarray], coordinates: int) -> np.ndarray:
    """Signatures (one row per set, none may be empty). Coordinate k is the minimum over the
    set of the second permutation shifted circularly by (k + 1) * ``_STRIDE`` places."""
    out = np.empty((coordinates, len(sets)), dtype=np.uint32)
    first = 0
    while first < len(sets):
        end, total = first, 0
        while end < len(sets) and (end == first or total + len(sets[end]) <= 1 << 15):
            total += len(sets[end])
            end += 1
        flat = _scatter(np.concatenate(sets[first:end]))
        starts = np.concatenate([[0], np.cumsum([len(s) for s in sets[first : end - 1]])]).astype(np.int64)
        x, y = np.empty_like(flat), np.empty_like(flat)
        for k in range(coordinates):
            np.add(flat, _M((k + 1) * _STRIDE & 0xFFFFFFFF), out=x)
            np.right_shift(x, _M(16), out=y)
            np.bitwise_xor(x, y, out=x)
            np.multiply(x, _M(0x21F0AAAD), out=x)
            np.right_shift(x, _M(15), out=y)
            np.bitwise_xor(x, y, out=x)
            np.multiply(x, _M(0x735A2D97), out=x)
            out[k, first:end] = np.minimum.reduceat(x, starts)
        first = end
    return out.T


def _digest(shingles: np.ndarray) -> tuple[int, int]:
    a = int(mix64(shingles).sum(dtype=np.uint64)) if len(shingles) else 0
    b = int(mix64(shingles ^ np.uint64(0xA5A5A5A55A5A5A5A)).sum(dtype=np.uint64)) if len(shingles) else 0
    return a - (1 << 63), b - (1 << 63)


def _sketcher(width: int, bands: int, rows: int):
    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        salts = mix64(np.arange(1, rows + 1, dtype=np.uint64))
        for batch in batches:
            for first, sets in shingle_sets(batch.column(1), width):
                n = len(sets)
                sizes = np.array([len(s) for s in sets], dtype=np.int64)
                keys = np.zeros((n, bands), dtype=np.int64)
                full = np.flatnonzero(sizes)
                if len(full):
                    sig = circulant_signatures([sets[i] for i in full], bands * rows).reshape(len(full), bands, rows).astype(np.uint64)
                    keys[full] = mix64((mix64(sig + np.uint64(1)) * salts).sum(axis=2, dtype=np.uint64)).view(np.int64)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, (n + 1) * bands, bands, dtype=np.int32)), pa.array(keys.ravel()))
                digests = [_digest(s) for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, n), pa.array(sizes), pa.array([d[0] for d in digests], pa.int64()), pa.array([d[1] for d in digests], pa.int64()), lists],
                    names=["doc_id", "n_shingles", "d1", "d2", "bands"],
                )

    return sketch


def _digester(width: int):
    """Rows (doc_id, text) as (doc_id, t, text), t the first half of the set's digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            t = pa.array([_digest(s)[0] for _, sets in shingle_sets(batch.column(1), width) for s in sets], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), t, batch.column(1)], names=["doc_id", "t", "text"])

    return run


def _verifier(width: int, percent: int):
    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.zeros(batch.num_rows, dtype=bool)
            left = (s for _, run in shingle_sets(batch.column(2), width) for s in run)
            right = (s for _, run in shingle_sets(batch.column(3), width) for s in run)
            for i, (a, b) in enumerate(zip(left, right, strict=True)):
                if len(a) and len(b):
                    small, big = (a, b) if len(a) <= len(b) else (b, a)
                    if 100 * len(small) < percent * len(big):
                        continue
                    at = np.searchsorted(big, small)
                    at[at == len(big)] = 0
                    common = int((big[at] == small).sum())
                    keep[i] = 100 * common >= percent * (len(a) + len(b) - common)
            yield batch.select([0, 1]).filter(pa.array(keep))

    return verify


def _confirmed(pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """Of the candidate pairs of texts ((a, ta), (b, tb)) the ids of those that link, judged on the full sets of both."""
    side = lambda s: texts.select(F.col("doc_id").alias(s), F.col("t").alias(f"t{s}"), F.col("text").alias(f"text_{s}"))
    both = pairs.join(side("a"), ["a", "ta"]).join(side("b"), ["b", "tb"])
    return both.select("a", "b", "text_a", "text_b").mapInArrow(_verifier(width, percent), "a long, b long")


def _hasher(width: int):
    """Rows (doc_id, t, text) as (doc_id, t, shingles): the sorted distinct hashes as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, sets in shingle_sets(batch.column(2), width):
                packed = pa.array([s.tobytes() for s in sets], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(sets)), batch.column(1).slice(first, len(sets)), packed], names=["doc_id", "t", "shingles"])

    return run


def _packer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (band, key, block, doc_id, component, shingles) that come sorted, packed in runs of one block and about ``BLOCK_BYTES``."""
    place, ids, parts, sets, size, seq = None, [], [], [], 0, 0

    def done() -> pa.RecordBatch:
        arrays = [pa.array([place[0]], pa.int32()), pa.array([place[1]], pa.int64()), pa.array([(place[2] << 20) + seq], pa.int64()), pa.array([size], pa.int64())]
        lists = [pa.array([ids], pa.list_(pa.int64())), pa.array([parts], pa.list_(pa.int64())), pa.array([sets], pa.list_(pa.binary()))]
        return pa.RecordBatch.from_arrays(arrays + lists, names=["band", "key", "block", "bytes", "ids", "components", "sets"])

    for batch in batches:
        for band, key, block, doc, component, own in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if ids and (place != (band, key, block) or size > BLOCK_BYTES):
                yield done()
                seq = seq + 1 if place == (band, key, block) else 0
                ids, parts, sets, size = [], [], [], 0
            place = (band, key, block)
            ids.append(doc)
            parts.append(component)
            sets.append(own)
            size += len(own)
    if ids:
        yield done()


def common_counts(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """|A & B| of all pairs of sets, by products of incidence matrices over runs of the shingles that both sides hold."""
    at_l, at_r = np.concatenate(left), np.concatenate(right)
    row_l, row_r = (np.repeat(np.arange(len(s)), [len(x) for x in s]) for s in (left, right))
    shared = np.intersect1d(at_l, at_r)
    out = np.zeros((len(left), len(right)), np.float32)
    if not len(shared):
        return out
    cols = []
    for at, row in ((at_l, row_l), (at_r, row_r)):
        col = np.minimum(np.searchsorted(shared, at), len(shared) - 1)
        hit = shared[col] == at
        order = np.argsort(col[hit], kind="stable")
        cols.append((col[hit][order], row[hit][order]))
    for start in range(0, len(shared), 4096):
        end, sides = start + 4096, []
        for (col, row), n in zip(cols, (len(left), len(right)), strict=True):
            a, b = np.searchsorted(col, [start, end])
            m = np.zeros((n, min(end, len(shared)) - start), np.float32)
            m[row[a:b], col[a:b] - start] = 1
            sides.append(m)
        out += sides[0] @ sides[1].T
    return out


def _tile_matcher(percent: int):
    """Compares the blocks of two tiles of a bucket, whose rows come sorted by (band, key, low, high, tile)."""

    def links(one, two, same: bool) -> pa.RecordBatch | None:
        (ids_a, part_a, a), (ids_b, part_b, b) = one, two
        apart = part_a[:, None] != part_b
        if not apart.any():
            return None
        n, m = np.array([len(s) for s in a]), np.array([len(s) for s in b])
        common = common_counts(a, b).astype(np.int64)
        link = apart & (100 * common >= percent * (n[:, None] + m - common))
        if not link.any():
            return None
        x, y = spanning_edges(link, same, ids_a, ids_b)
        return pa.RecordBatch.from_arrays([pa.array(x), pa.array(y)], names=["a", "b"])

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, held = None, []
        for batch in batches:
            for i in range(batch.num_rows):
                *here, tile = (batch.column(c)[i].as_py() for c in range(5))
                if here != place:
                    place, held = here, []
                ids, parts = (np.asarray(batch.column(c)[i].values) for c in (5, 6))
                own = ids, parts, [np.frombuffer(x.as_buffer(), np.uint64) for x in batch.column(7)[i].values]
                if tile == here[3] and tile == here[2]:
                    held.append(own)
                    found = [links(other, own, other is own) for other in held]
                elif tile == here[2]:
                    held.append(own)
                    continue
                else:
                    found = [links(other, own, False) for other in held]
                yield from (x for x in found if x is not None)

    return match


def _block_links(crowd: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """Links (a, b) between members of different components in one bucket, tile against tile."""
    spark = crowd.sparkSession
    wanted = texts.join(crowd.select("doc_id", "t").distinct(), ["doc_id", "t"], "left_semi")
    sets = settle(wanted.select("doc_id", "t", "text").mapInArrow(_hasher(width), "doc_id long, t long, shingles binary"), "minhash-sets")
    block = F.pmod(F.xxhash64("doc_id", "t"), F.ceil(F.col("members") / BLOCK_ROWS)).alias("block")
    rows = crowd.select("band", "key", block, "doc_id", "t", "component").join(sets, ["doc_id", "t"]).select("band", "key", "block", "doc_id", "component", "shingles")
    packed = settle(
        rows.repartition("band", "key", "block").sortWithinPartitions("band", "key", "block").mapInArrow(
            _packer, "band int, key long, block long, bytes long, ids array<long>, components array<long>, sets array<binary>"
        ),
        "minhash-blocks",
    )
    discard(sets)
    bucket = W.partitionBy("band", "key")  # a row a block
    before = F.coalesce(F.sum("bytes").over(bucket.orderBy("block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    tiles = packed.select("band", "key", "block", F.floor(before / TILE_BYTES).alias("tile"))
    tiles = tiles.withColumn("last", F.max("tile").over(bucket)).select("band", "key", "block", "tile", F.explode(F.sequence(F.lit(0).cast("long"), "last")).alias("other"))
    pairs = packed.join(tiles, ["band", "key", "block"]).select("band", "key", F.least("tile", "other").alias("low"), F.greatest("tile", "other").alias("high"), "tile", "ids", "components", "sets")
    place = ["band", "key", "low", "high"]
    with arrow_batch_rows(spark, 4):
        out = settle(pairs.repartition(*place).sortWithinPartitions(*place, "tile").mapInArrow(_tile_matcher(percent), "a long, b long").distinct(), "minhash-block-links")
    discard(packed)
    return out


def minhash_near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    width: int = 5,
    percent: int = 80,
    bands: int = 60,
    rows: int = 6,
) -> DataFrame:
    """Components of texts whose shingle sets have 100 * |A & B| >= percent * |A | B|.

    Returns one row per input row: doc_id, n_shingles, component_id (smallest id
    reachable), kept (doc_id = component_id). Defaults are five words and 0.8;
    for another threshold choose ``bands`` and ``rows`` so that
    (1 - threshold**rows)**bands is negligible.

    Null, empty and wordless texts have no shingles and link with nothing; a row
    whose id is null has component null and is not kept. Repeated rows with one
    id get equal rows back, and the id's component joins whatever any of its
    texts links with. Texts of any length are taken whole. An empty table gives
    an empty result. Other columns are ignored, whatever their names.
    """
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    sketch = settle(source.mapInArrow(_sketcher(width, bands, rows), "doc_id long, n_shingles long, d1 long, d2 long, bands array<long>"), "minhash-sketch")
    everyone = settle(sketch.select("doc_id", "n_shingles"), "minhash-ids")
    real = sketch.where((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull())
    classes = settle(real.groupBy("d1", "d2", "n_shingles").agg(F.min("doc_id").alias("rep")), "minhash-classes")  # so that the join can split a class with many copies
    member = real.select("doc_id", "d1", "d2", "n_shingles").join(classes, ["d1", "d2", "n_shingles"]).select("doc_id", "rep", "d1", "d2")
    member = settle(member, "minhash-members")
    leaders = member.where(F.col("doc_id") == F.col("rep")).select("doc_id", "d1", "d2").distinct()
    slots = real.join(leaders, ["doc_id", "d1", "d2"], "left_semi").select("doc_id", F.col("d1").alias("t"), F.col("n_shingles").cast("int").alias("n"), F.posexplode("bands").alias("band", "key"))
    crowded = slots.groupBy("band", "key").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi").select("band", "key")
    active = settle(slots.join(crowded, ["band", "key"]).select("band", "key", "doc_id", "t", "n").distinct(), "minhash-buckets")
    named = source.where("doc_id IS NOT NULL")
    texts = named.join(active.select("doc_id").distinct(), "doc_id", "left_semi").mapInArrow(_digester(width), "doc_id long, t long, text string")
    texts = settle(texts.join(active.select("doc_id", "t").distinct(), ["doc_id", "t"], "left_semi").dropDuplicates(["doc_id", "t"]), "minhash-texts")
    discard(sketch)
    discard(classes)

    links = member.where(F.col("doc_id") != F.col("rep")).select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    sizes_fit = lambda n, m: (100 * F.least(n, m).cast("long")) >= (percent * F.greatest(n, m).cast("long"))
    centre = active.groupBy("band", "key").agg(F.min(F.struct("doc_id", "t", "n")).alias("c")).select("band", "key", F.col("c.doc_id").alias("b"), F.col("c.t").alias("tb"), F.col("c.n").alias("m"))
    stars = active.join(centre, ["band", "key"]).where((F.col("doc_id") != F.col("b")) & sizes_fit("n", "m")).select(F.col("doc_id").alias("a"), F.col("t").alias("ta"), "b", "tb").distinct()
    starred = settle(_confirmed(stars, texts, width, percent), "minhash-links")
    merged = settle(connected_components(starred, "a", "b"), "minhash-components")

    labelled = active.join(merged, active["doc_id"] == merged["node"], "left").select("band", "key", "doc_id", "t", "n", F.coalesce("component", "doc_id").alias("component"))
    labelled = settle(labelled, "minhash-labelled")
    discard(active)
    still_open = labelled.groupBy("band", "key").agg(F.count("*").alias("members"), F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("band", "key", "members")
    still = settle(labelled.join(still_open, ["band", "key"]), "minhash-open")
    discard(labelled)
    discard(merged)
    small = still.where(F.col("members") <= SMALL)
    other = small.select("band", "key", F.col("doc_id").alias("b"), F.col("t").alias("tb"), F.col("n").alias("m"), F.col("component").alias("component_b"))
    pairs = (
        small.join(other, ["band", "key"])
        .where((F.col("doc_id") > F.col("b")) & (F.col("component") != F.col("component_b")) & sizes_fit("n", "m"))
        .select(F.col("doc_id").alias("a"), F.col("t").alias("ta"), "b", "tb")
        .distinct()
    )
    found = starred.unionByName(_confirmed(pairs, texts, width, percent))
    blocks = _block_links(still.where(F.col("members") > SMALL), texts, width, percent)
    every = settle(links.unionByName(found).unionByName(blocks), "minhash-all-links")
    for spent in (member, texts, still, starred, blocks):
        discard(spent)
    components = connected_components(every, "a", "b")
    discard(every)
    out = everyone.join(components, F.col("doc_id") == F.col("node"), "left")
    component = F.coalesce("component", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), (F.coalesce(component == F.col("doc_id"), F.lit(False))).alias("kept"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    with text_batches(spark):
        return minhash_near_duplicates(table(spark, sf_dir, "documents"), width=3, percent=85, bands=40)


ORACLE = r"""
WITH RECURSIVE toks AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda t: t <> '') AS w
  FROM documents
), sh AS (
  SELECT doc_id, unnest(list_distinct(CASE WHEN len(w) = 0 THEN []
      WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
      ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END)) AS s
  FROM toks
), sizes AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY 1),
sets AS (
  SELECT doc_id, md5(string_agg(s, chr(10) ORDER BY s)) AS digest FROM sh GROUP BY 1
), reps AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY digest) AS rep FROM sets),
lead AS (SELECT s.doc_id, s.s, n.n FROM sh s JOIN reps r USING (doc_id) JOIN sizes n USING (doc_id) WHERE r.rep = r.doc_id),
common AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k, any_value(a.n) AS nx, any_value(b.n) AS ny
  FROM lead a JOIN lead b ON a.s = b.s AND a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n) GROUP BY 1, 2
), edge AS (
  SELECT x, y FROM common WHERE 100 * k >= 85 * (nx + ny - k)
  UNION SELECT y, x FROM common WHERE 100 * k >= 85 * (nx + ny - k)
  UNION SELECT doc_id, rep FROM reps WHERE doc_id <> rep
  UNION SELECT rep, doc_id FROM reps WHERE doc_id <> rep
), reach AS (
  SELECT doc_id AS src, doc_id AS dst FROM documents
  UNION SELECT r.src, e.y FROM reach r JOIN edge e ON r.dst = e.x
)
SELECT d.doc_id, coalesce(z.n, 0)::BIGINT AS n_shingles, c.component_id, c.component_id = d.doc_id AS kept
FROM documents d LEFT JOIN sizes z USING (doc_id)
JOIN (SELECT src AS doc_id, min(dst) AS component_id FROM reach GROUP BY 1) c USING (doc_id)
"""
