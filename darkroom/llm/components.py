"""Connected components of an edge table, by alternating large-star and small-star steps.

Each step gives every edge the smallest neighbour of one of its ends, found by a grouping that combines before it shuffles. A node with
many edges would meet its edges in one task of the join that follows; such hubs, of which there are at most MOST_HUBS whatever the input,
are broadcast instead. Labels halve their distance to the smallest node of the component, so the number of steps grows with the
logarithm of its width. Each round is written to the shared folder, which cuts lineage. Only counts reach the driver.

Defined cases: no edges give no rows; edges of a node to itself and repeated edges don't matter; null ends are left out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from darkroom.llm.common import dropped, stored

#: Nodes with more edges than twice the edges divided by this are hubs; nodes of 200 edges or fewer never are.
MOST_HUBS = 4000
#: Edges up to which Spark may broadcast the nodes' smallest neighbours, of some 64 bytes each.
MOST_BROADCAST = 1 << 18


def _with_least(edges: DataFrame, u: str, v: str, count: int) -> DataFrame:
    """(u, v, m): edges with the smallest v among those of their u. count: the number of edges, or more."""
    keyed = edges.select(F.xxhash64(u).alias("k"), u, v)
    least = keyed.groupBy("k", u).agg(F.min(v).alias("m"), F.count("*").alias("n"))
    many = F.col("n") > max(200, 2 * count // MOST_HUBS)
    told = keyed.join(F.broadcast(least.where(many).select(u, F.col("m").alias("told"))), u, "left")
    # hubs' edges have theirs, and are dealt by their other ends
    told = told.withColumn("k", F.when(F.col("told").isNull(), F.col("k")).otherwise(F.xxhash64(v)))
    rest = least.where(~many).select("k", u, "m")
    # Spark goes by the size of the edges' files, which are far smaller than their rows: beyond a known number of these nothing is broadcast
    rest = rest.hint("merge") if count > MOST_BROADCAST else rest
    return told.join(rest, ["k", u], "left").select(u, v, F.coalesce("told", "m").alias("m"))


def components(edges: DataFrame, a: str, b: str, most_rounds: int = 60) -> DataFrame:
    """(node, component) of every node but the smallest of its component; component: that smallest node."""
    now = stored(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct(), "edges")
    if now.isEmpty():
        return now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    state, count = None, now.count()
    for _ in range(most_rounds):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # large star: neighbours above a node are linked to the smallest of its neighbourhood
        large = _with_least(both, "u", "v", 2 * count).where("v > u").select(F.col("v").alias("u"), F.least("m", "u").alias("v")).where("u <> v")
        # small star: a node and its neighbours below it are linked to the smallest of them
        low = _with_least(large, "u", "v", 2 * count)
        small = low.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.where("v = m").select("u", F.col("m").alias("v")))
        before, now = now, stored(small.where("u <> v").distinct(), "edges")
        dropped(before)
        found = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if found == state:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component"))
        state, count = found, found[0]
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")
