"""Mixing sources to target weights by Pfair scheduling, in DataFrame expressions only.

Each source's documents, in a hashed order, are cut into blocks of
``block_chars`` characters. With integer shares w summing to a period H, block i
of a source (from 0) is released at floor(i * H / w) and due at
ceil((i + 1) * H / w); every slot takes the released block with the earliest
deadline. On one processor that meets every deadline, so after any number of
slots each source is less than one block away from its weight. The shares are
the target weights in lowest terms, not rounded to a period. The schedule
repeats after H slots: it is worked out once for one period, or as far into it
as the blocks at hand reach, and a block's slot follows from its number.

``rounded`` shares are those the registered query's SQL states: a slot for
every source first, the rest by weight, in a period of given length. There the
bound holds against these shares, not against the target weights.

A source that runs out leaves its slots empty: the others go on in proportion.
Nothing is dropped or repeated.

A block's number needs a running sum over its source. Sources are split by a
hash prefix into buckets whose sums are added up first, so that one source with
a third of all rows is spread over ``16 ** bucket_digits`` windows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from skeinmill.runtime import settle, table


def _source_key(source: Column) -> Column:
    return F.coalesce(F.concat(F.lit("="), source.cast("string")), F.lit(""))


def pfair_plan(
    supply: DataFrame, weights: dict[str, int] | None, default_weight: int = 1, period: int = 1024, rounded: bool = False, block_chars: int | None = None
) -> DataFrame:
    """The schedule of one period: source_key, share, period, turn (from 0), slot; H rows.

    ``supply`` has source_key and size. Without ``weights`` a source's target is
    the whole square root of its size (flattening large sources); with them,
    sources not named get ``default_weight``. Shares are the targets over their
    greatest common divisor and the period is their sum. With ``block_chars``
    only the turns of blocks that the sizes hold are there. With ``rounded`` the
    period is ``period`` or 16 slots a source, whichever is more, and every
    source has one slot before the rest is dealt out by weight. The number of
    sources is taken to be bounded, as a mixture's is.
    """
    if weights is None:
        target = F.greatest(F.lit(1), F.floor(F.sqrt(F.col("size"))).cast("long"))
    elif weights:
        named = F.create_map(*[x for k, v in weights.items() for x in (F.lit(f"={k}"), F.lit(int(v)).cast("long"))])
        target = F.greatest(F.lit(1), F.coalesce(named[F.col("source_key")], F.lit(int(default_weight)).cast("long")))
    else:
        target = F.lit(1).cast("long")
    rows = supply.select(F.struct("source_key", target.alias("t"), F.col("size").cast("long").alias("size")).alias("s")).agg(F.sort_array(F.collect_list("s")).alias("s")).where(F.size("s") > 0)
    if rounded:
        rows = rows.select("s", F.size("s").cast("long").alias("n"), F.aggregate("s", F.lit(0).cast("long"), lambda a, x: a + x["t"]).alias("total"))
        rows = rows.select("*", F.greatest(F.lit(period).cast("long"), 16 * F.col("n")).alias("H"))
        part = F.expr("transform(s, (x, i) -> struct(x.t * (H - n) % total AS rest, -i AS back, i AS i, 1 + x.t * (H - n) div total AS share))")
        rows = rows.select("s", "H", F.sort_array(part, asc=False).alias("p"))
        rows = rows.select("s", "H", F.expr("H - aggregate(p, 0L, (a, x) -> a + x.share)").alias("left"), "p")
        rows = rows.select("s", "H", F.expr("transform(array_sort(transform(p, (x, k) -> struct(x.i AS i, x.share + if(k < left, 1, 0) AS w))), x -> x.w)").alias("w"))
    else:
        euclid = "aggregate(sequence(1, 92), struct(g AS a, x.t AS b), (e, k) -> if(e.b = 0, e, struct(e.b AS a, e.a % e.b AS b)), e -> e.a)"
        rows = rows.select("s", F.expr(f"aggregate(s, 0L, (g, x) -> {euclid})").alias("g")).select("s", F.expr("transform(s, x -> x.t div g)").alias("w"))
        rows = rows.select("s", F.expr("aggregate(w, 0L, (a, x) -> a + x)").alias("H"), "w")
    blocks = f"least(x.size div {int(block_chars)} + 1, w[i])" if block_chars else "w[i]"
    rows = rows.select("*", F.expr(f"transform(s, (x, i) -> {blocks})").alias("b"))
    rows = rows.select("*", F.expr("array_max(transform(b, (x, i) -> (x * H + w[i] - 1) div w[i]))").alias("Z"))  # every block wanted is due by then
    rows = settle(rows, "mix-shares")  # else the optimizer would work the shares out anew for every slot
    pick = """array_min(transform(st.c, (c, i) -> if(c < w[i] AND c * H div w[i] <= t,
        struct(((c + 1) * H + w[i] - 1) div w[i] AS due, i AS i), null))).i"""
    some = f"""aggregate(sequence(k * 1024, least(Z, (k + 1) * 1024) - 1), struct(o.c AS c, cast(array() AS array<int>) AS got),
            (st, t) -> transform(array({pick}), k -> struct(transform(st.c, (c, i) -> if(i = k, c + 1, c)) AS c, array_append(st.got, k) AS got))[0])"""
    rows = rows.select(
        "s", "H", "w", "b",
        F.expr(f"""aggregate(sequence(0L, (Z - 1) div 1024), struct(transform(w, x -> 0L) AS c, cast(array() AS array<array<int>>) AS got),
            (o, k) -> transform(array({some}), q -> struct(q.c AS c, array_append(o.got, q.got) AS got))[0],
            o -> flatten(o.got))""").alias("got"),
    )
    slots = rows.select("s", "w", "H", "b", F.posexplode("got").alias("slot", "i"))
    slots = slots.select(
        "i", "slot", F.expr("s[i].source_key").alias("source_key"), F.expr("w[i]").alias("share"), F.col("H").alias("period"), F.expr("b[i]").alias("wanted")
    )
    turn = F.row_number().over(W.partitionBy("i").orderBy("slot")) - 1
    slots = slots.withColumn("turn", turn.cast("long")).where("turn < wanted")
    return slots.select("source_key", "share", "period", "turn", F.col("slot").cast("long").alias("slot"))


def mix_sources(
    docs: DataFrame,
    weights: dict[str, int] | None = None,
    default_weight: int = 1,
    block_chars: int = 65_536,
    period: int = 1024,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    size_col: str | None = None,
    bucket_digits: int = 3,
    rounded: bool = False,
) -> DataFrame:
    """Every row of ``docs`` once, as ``row`` (a struct of all its columns), with source_key, share, period, block,
    slot and start (characters of its source before it; ``size_col`` gives lengths that are known). Reading by slot, then start, is the mixture.

    A document belongs to the block in which it starts; one longer than a block
    takes up the turns of the blocks it covers. Null sources are one source of
    their own; null texts have no length; rows with equal ids and lengths tie and
    follow one another in any order. An empty table gives an empty result.
    ``period`` counts for ``rounded`` shares only.
    """
    own = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
        F.col(id_col).alias("id"),
        _source_key(F.col(source_col)).alias("source_key"),
        F.coalesce(F.col(size_col) if size_col else F.length(text_col), F.lit(0)).cast("long").alias("size"),
    ).withColumn("h", F.coalesce(F.md5(F.col("id").cast("string").cast("binary")), F.lit("")))
    # rows without an id come first, by length: each length is a bucket, in the same order
    own = own.withColumn("bucket", F.when(F.col("id").isNull(), F.concat(F.lit(" "), F.lpad(F.col("size").cast("string"), 19, "0"))).otherwise(F.substring("h", 1, bucket_digits)))
    sums = settle(own.groupBy("source_key", "bucket").agg(F.sum("size").alias("size")), "mix-sums")
    before = F.coalesce(F.sum("size").over(W.partitionBy("source_key").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offsets = sums.select("source_key", "bucket", before.alias("before"))
    plan = settle(pfair_plan(sums.groupBy("source_key").agg(F.sum("size").alias("size")), weights, default_weight, period, rounded, block_chars), "mix-plan")
    inside = F.coalesce(F.sum("size").over(W.partitionBy("source_key", "bucket").orderBy("h", "id", "size").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    placed = (
        own.withColumn("inside", inside)
        .join(offsets, ["source_key", "bucket"])
        .withColumn("start", F.col("before") + F.col("inside"))
        .withColumn("block", F.expr(f"start div {int(block_chars)}"))
        .join(F.broadcast(plan.select("source_key", "share", "period").distinct()), "source_key")
        .withColumn("turn", F.col("block") % F.col("share"))
        .join(F.broadcast(plan.select("source_key", "turn", F.col("slot").alias("in_period"))), ["source_key", "turn"])  # at most a row a block
    )
    slot = F.expr("block div share * period + in_period")
    return placed.select("row", "source_key", "share", "period", "block", slot.alias("slot"), "start")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", F.coalesce(F.length("text"), F.lit(0)).alias("chars"))
    mixed = mix_sources(docs, size_col="chars", rounded=True)  # the shares of its SQL
    return mixed.select(F.col("row.doc_id").alias("doc_id"), F.col("row.source").alias("source"), "share", "period", "block", "slot", "start")


ORACLE = """
WITH RECURSIVE d AS (
  SELECT doc_id, source, coalesce('=' || source, '') AS k, coalesce(length(text), 0)::BIGINT AS size, coalesce(md5(doc_id::VARCHAR), '') AS h FROM documents
), st AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY k ORDER BY substr(h, 1, 3), h, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM d),
sup AS (SELECT k, greatest(1, floor(sqrt(sum(size)))::BIGINT) AS t FROM d GROUP BY 1),
tot AS (SELECT count(*)::BIGINT AS n, sum(t)::BIGINT AS total, greatest(1024, 16 * count(*))::BIGINT AS H FROM sup),
sh AS (SELECT k, row_number() OVER (ORDER BY k) AS i, 1 + t * (H - n) // total AS base, row_number() OVER (ORDER BY t * (H - n) % total DESC, k) AS r, H FROM sup, tot),
w AS (SELECT k, i, base + CASE WHEN r <= H - (SELECT sum(base) FROM sh) THEN 1 ELSE 0 END AS w, H FROM sh),
ws AS (SELECT list(w::BIGINT ORDER BY i) AS w, any_value(H)::BIGINT AS H FROM w),
edf AS (
  SELECT 0::BIGINT AS t, list_transform(w, lambda x: 0::BIGINT) AS c, 0::BIGINT AS pick, w, H FROM ws
  UNION ALL
  SELECT t + 1, list_transform(c, lambda x, j: CASE WHEN j = p THEN x + 1 ELSE x END), p, w, H
  FROM (SELECT *, list_min(list_filter(list_transform(c, lambda x, j: CASE WHEN x < w[j] AND x * H // w[j] <= t THEN (((x + 1) * H + w[j] - 1) // w[j]) * 1000000 + j END), lambda y: y IS NOT NULL)) % 1000000 AS p FROM edf WHERE t < H)
), pat AS (SELECT pick AS i, t - 1 AS slot, row_number() OVER (PARTITION BY pick ORDER BY t) - 1 AS turn FROM edf WHERE t > 0)
SELECT st.doc_id, st.source, w.w AS share, w.H AS period, st.start // 65536 AS block, (st.start // 65536) // w.w * w.H + pat.slot AS slot, st.start
FROM st JOIN w USING (k) JOIN pat ON pat.i = w.i AND pat.turn = (st.start // 65536) % w.w
"""
