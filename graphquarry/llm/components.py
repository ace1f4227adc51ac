"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stash


def _same(a: DataFrame) -> tuple:
    h = F.xxhash64("u", "v")
    row = a.agg(F.count("*"), F.coalesce(F.bit_xor(h), F.lit(0)), F.coalesce(F.sum(F.shiftright(h, 20)), F.lit(0))).first()
    return tuple(row)


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    out = both.join(low, "u").filter(F.col("v") > F.col("u"))
    return out.select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    low = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(low, "u").filter(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(low.select("u", F.col("m").alias("v"))).distinct()


def connected_components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of ``links(u, v)`` but the roots; root: the smallest node reachable.

    Each round is two aggregations by minimum with map-side combine and two equi-joins, and is
    written to the shared folder. A hub's links are never gathered in one task: the joins are
    plain, so adaptive execution can split them. The number of rounds grows with the logarithm of
    the longest path. Self links, nulls and repeated links are ignored; no links: no rows.
    """
    edges = links.filter(F.col("u") != F.col("v")).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    edges = stash(edges, "links")
    seen = _same(edges)
    for _ in range(max_rounds):
        if seen[0] == 0:
            break
        edges = stash(_small_star(_large_star(edges)), "stars")
        now = _same(edges)
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"no fixed point after {max_rounds} rounds")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
