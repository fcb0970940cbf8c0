"""Connected components by alternating large-star and small-star rounds (Kiveris et al., 2014)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearsay.runtime import cut, forget, large

Side = Callable[[DataFrame], DataFrame]


def _nearest(edges: DataFrame) -> DataFrame:
    """For edges (u, v): the least neighbour of each u, combined before the shuffle."""
    return edges.groupBy("u").agg(F.min("v").alias("m"))


def _large_star(edges: DataFrame, side: Side) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = side(_nearest(both).select("u", F.least("m", "u").alias("m")))
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()


def _small_star(edges: DataFrame, side: Side) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = side(_nearest(down))
    moved = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()


def connected_components(edges: DataFrame, most_rounds: int = 50, broadcast: bool = True) -> DataFrame:
    """Edges (u, v) of one orderable type to rows (node, component): the least node that is reachable.

    Nodes that are in no edge don't appear; loops and repeated edges don't matter. Each round is written to the shared
    folder, so lost executors never replay earlier rounds. The rounds needed grow with the logarithm of the longest
    path; running out of ``most_rounds`` raises instead of giving a partial answer. Without ``broadcast``, nothing that is as
    long as the edges goes through the driver, in the rounds or where the result is joined.
    """
    side: Side = (lambda df: df) if broadcast else large
    given = cut(edges.select("u", "v").distinct())
    now = given.filter("u <> v")
    seen = None
    for _ in range(most_rounds):
        now, before = cut(_small_star(_large_star(now, side), side)), now
        forget(before)
        sign = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if sign == seen:
            break
        seen = sign
    else:
        raise RuntimeError(f"components have not settled in {most_rounds} rounds")
    # a component is its least node, so of a node that has a loop besides, or is a root, the least is right
    loops = given.filter("u = v").select(F.col("u").alias("node"), F.col("u").alias("component"))
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component"))
    out = now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots).unionByName(loops)
    return side(out.groupBy("node").agg(F.min("component").alias("component")))
