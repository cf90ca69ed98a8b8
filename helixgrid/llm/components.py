"""Connected components of a table of links by alternating stars.

Each round joins every vertex to the smallest neighbour it knows (first for
its larger neighbours, then for its smaller ones); the links become stars
around the smallest vertex of each component. The tables stay distributed,
every round is cut by a staged table, and the only thing the driver sees is a
checksum of the links, to know when they stop changing. A round's table is deleted
when the next one is written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, staged


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """edges (a, b): one star step. The minimum is an aggregate, so a hot vertex is combined before the shuffle."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    near = both.join(least, "a")
    if large:
        out = near.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = near.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
    return out.where("a <> b").distinct()


def connected_components(links: DataFrame, rounds: int = 100) -> DataFrame:
    """links (a, b) of bigint ids -> (id, component) for every id in a link; component is the smallest id reachable."""
    edges = staged(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "links")
    before = None
    for _ in range(rounds):
        past, edges = edges, staged(_star(_star(edges, True), False), "stars")
        dropped(past)
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return edges.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("component")).union(edges.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())
