"""Connected components over an edge table, without gathering anything on the driver."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skeinmill.runtime import discard, settle


def _is_star_forest(edges: DataFrame) -> bool:
    ends = edges.select(F.col("u").alias("n"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(
        edges.select(F.col("v").alias("n"), F.lit(0).alias("up"), F.lit(1).alias("down"))
    )
    per_node = ends.groupBy("n").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    bad = (F.col("up") > 1) | ((F.col("up") > 0) & (F.col("down") > 0))
    return per_node.where(bad).isEmpty()


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """Label every node that an edge touches with the smallest node id it can reach.

    Alternates large-star and small-star steps until each node points at one
    root. Every step is a grouped minimum (combined before the shuffle) and an
    equi-join that AQE can split, so a hub with a third of all edges is spread
    over tasks. Each round is written to the shared folder.

    Null endpoints and self loops are ignored; repeated edges count once; an
    empty table gives an empty result. Returns ``node, component`` (long).
    """
    a, b = F.col(src).cast("long"), F.col(dst).cast("long")
    current = settle(
        edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where((a != b) & a.isNotNull() & b.isNotNull()).distinct(),
        "components",
    )
    while not _is_star_forest(current):
        both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = settle(both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m")), "components-low")  # as a table, so that the join can split a hub
        large = both.join(low, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(least, "u")
            .where(F.col("v") != F.col("m"))
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(least.select("u", F.col("m").alias("v")))
            .distinct()
        )
        following = settle(small, "components")
        discard(current)
        discard(low)
        current = following
    roots = current.select("v").distinct()
    return current.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        roots.select(F.col("v").alias("node"), F.col("v").alias("component"))
    )


def greedy_dropped(links: DataFrame, src: str = "src", dst: str = "dst", holds: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """``node``: what a pass over the nodes in rising order drops, that keeps a node unless a kept one is linked with it.

    A node without an undecided smaller neighbour is kept, and its neighbours go;
    links of those that are decided are left out, so links shrink from round to
    round, all over the table at once. There are as many rounds as the longest
    chain of decisions. Where ``links`` only may hold, ``holds`` is given those (u, v) whose
    ``v`` is kept, and all that are left once they are no more, and returns those that do. Null ends and self loops are ignored, repeated links count
    once. Nodes that no link touches are kept.
    """
    a, b = F.col(src), F.col(dst)
    open_links = settle(links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where((a != b) & a.isNotNull() & b.isNotNull()).distinct(), "greedy-links")
    dropped = open_links.select(F.col("u").alias("node")).limit(0)
    given = 0
    while not open_links.isEmpty():
        if given and open_links.count() <= given:
            true_links, given, holds = settle(holds(open_links).select("u", "v"), "greedy-links"), 0, None
            discard(open_links)
            open_links = true_links
            continue
        first = open_links.select("v").distinct().join(open_links.select(F.col("u").alias("v")), "v", "left_anti")
        first = settle(first, "greedy-first") if holds else first
        beside = open_links.join(first, "v", "left_semi").select("u", "v")
        given = max(given, beside.count()) if holds else 0
        gone = settle((holds(beside) if holds else beside).select(F.col("u").alias("node")).distinct(), "greedy-gone")
        dropped = dropped.unionByName(gone)
        rest = open_links.join(gone.select(F.col("node").alias("u")), "u", "left_anti").join(gone.select(F.col("node").alias("v")), "v", "left_anti")
        rest = rest.join(first, "v", "left_anti") if holds else rest
        following = settle(rest.select("u", "v"), "greedy-links")
        discard(open_links)
        if holds:
            discard(first)
        open_links = following
    return dropped
