"""Connected components by alternating large-star and small-star steps on an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granum.llm.common import maybe_broadcast, saved, stored

#: A node with more neighbours is a hub: its minimum is broadcast to its edges, which stay where they are.
HUB = 200
BROADCAST_HUBS = 1_000_000


def with_least(edges: DataFrame, least: DataFrame, hubs: bool) -> DataFrame:
    """edges (u, v) with m from `least` (u, m, n): the least of u and its neighbours, and how many u has. `hubs` tells whether some have over HUB.

    The edges of hubs, of which there are at most edges / HUB, aren't dealt by u, so that no task gets a whole star;
    those of other nodes come at most HUB to a key.
    """
    if not hubs:
        return edges.join(least.select("u", "m"), "u")
    stars = maybe_broadcast(least.where(F.col("n") > HUB).select("u", F.col("m").alias("hub")), BROADCAST_HUBS)
    marked = edges.join(stars, "u", "left")
    others = marked.where("hub is null").select("u", "v").join(least.where(F.col("n") <= HUB).select("u", "m"), "u")
    return marked.where("hub is not null").select("u", "v", F.col("hub").alias("m")).union(others.select("u", "v", "m"))


def minima(edges: DataFrame) -> DataFrame:
    """u, m (the least of u and its neighbours v), n (neighbours), below (those under u), h (a hash of the edges to these); combined before the shuffle."""
    under = F.col("u") > F.col("v")
    sums = edges.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"), F.count_if(under).alias("below"), F.bit_xor(F.when(under, F.xxhash64("u", "v"))).alias("h"))
    return sums.withColumn("m", F.least("u", "m"))


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """Per node of `edges` (a, b: long) the smallest node reachable: node, component.

    Each round points the neighbours of every node to the least one around it. The rounds end when the edge table
    no longer changes; their number grows as the logarithm of the longest path. Every round is a table in the shared
    folder, deleted when the next is there. Loops and repeated edges are ignored, null ends too; an empty table gives an
    empty result. Nodes without an edge don't occur.
    """
    e, drop = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    before = None
    for _ in range(most_rounds):
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least, drop_least = stored(minima(both))
        *now, most, most_below = least.agg(F.sum("n"), F.bit_xor("h"), F.max("n"), F.max("below")).first()
        if now == before or not most:
            drop_least()
            break
        before, made = now, [drop, drop_least]
        large = with_least(both, least, most > HUB).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        hubs = most_below > HUB  # only then may a node have more neighbours in `large`
        if hubs:
            large, drop_large = stored(large)
            under, drop_under = stored(minima(large))
            made += [drop_large, drop_under]
        else:
            under = minima(large)
        small = with_least(large, under, hubs)
        e, drop = stored(small.select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x")).select("x.*").where("u > v").distinct())
        for former in made:
            former()
    else:
        raise RuntimeError("components did not settle")
    found = saved(e)
    drop()
    return found.select(F.col("u").alias("node"), F.col("v").alias("component")).union(found.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()
