"""Connected components of an edge frame, and groups by them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioforge.runtime import cut

#: Edges of one node from which the node is a hub, if they are also that share of all edges: so that there are few hubs.
HUB, HUB_SHARE = 1_000_000, 0.0001


def _beside(edges: DataFrame, low: DataFrame, total: int) -> DataFrame:
    """edges (a, b) with low of a. low has a, low, n (edges of a); the rows of hubs, at most 1 / HUB_SHARE, are broadcast, so that their edges stay where they are."""
    least = max(HUB, HUB_SHARE * total)
    if total <= least:
        return edges.join(low.select("a", "low"), "a")
    hubs = low.filter(F.col("n") > least).select("a", "low")
    rest = edges.join(F.broadcast(hubs.select("a")), "a", "left_anti").join(low.filter(F.col("n") <= least).select("a", "low"), "a")
    return edges.join(F.broadcast(hubs), "a").unionByName(rest)


def components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 60) -> DataFrame:
    """node, root: the smallest node of each node's component; isolated nodes do not occur.

    Alternating large-star and small-star steps: every round is two aggregations of at most the edges' size, rows
    of one node are only aggregated and a hub's are joined where they are (it never gathers its neighbours in one task),
    and labels reach the root in about log(diameter) rounds. Rounds end when no edge changes; each is written to the
    shared folder. Null ends are dropped, loops and repeated edges are harmless, an empty frame gives an empty one.
    Labels that do not settle within the rounds are an error.
    """
    links = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).filter("a is not null and b is not null and a <> b")
    links = cut(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    state = lambda df: df.select(F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")).first()
    before = state(links)
    for _ in range(rounds):
        total = before.n
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low"), F.count("*").alias("n"))
        large = _beside(both.filter("b > a"), low, 2 * total).select(F.col("b").alias("a"), F.col("low").alias("b"))
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct()
        least = down.groupBy("a").agg(F.min("b").alias("low"), F.count("*").alias("n"))
        joined = _beside(down, least, 2 * total)
        small = joined.select(F.col("b").alias("a"), F.col("low").alias("b")).filter("a <> b").unionByName(joined.select("a", F.col("low").alias("b"))).distinct()
        new = cut(small)
        left = state(new)
        links, settled, before = new, left == before, left
        if settled:
            break
    else:
        raise RuntimeError(f"labels still change after {rounds} rounds")
    stars = links.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return stars.unionByName(stars.select(F.col("root").alias("node"), "root").distinct())
