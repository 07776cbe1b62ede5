"""Connected components by alternating large-star and small-star steps, without collecting links.

A node of very many links never meets them in one task: its least neighbour is
found by a partial aggregation, and goes back to the links by broadcast.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.sizes import BROADCAST_ROWS
from millrace.session import cut

#: Links from which a node is a hub. There are at most two hubs for as many links, few enough to broadcast.
HUB_LINKS = 10_000


def _with_least(pairs: DataFrame, least: DataFrame) -> DataFrame:
    """pairs with the least neighbour of u; shuffled by u only where nodes are too many to broadcast, and then without the hubs."""
    if least.count() <= BROADCAST_ROWS:
        return pairs.join(F.broadcast(least.select("u", "m")), "u")
    hubs = F.broadcast(least.filter(F.col("n") > HUB_LINKS).select("u", "m"))
    rest = pairs.join(hubs.select("u"), "u", "left_anti").join(least.select("u", "m"), "u")
    return pairs.join(hubs, "u").unionByName(rest)


def _min_pointed(links: DataFrame, larger_only: bool) -> DataFrame:
    """One star step over links (u, v) with u > v.

    Large star: every neighbour greater than u points to the least of u and its
    neighbours. Small star: u and its lesser neighbours point to the least.
    """
    if larger_only:
        both = links.select("u", "v").unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        both = links.select("u", "v")
    least = cut(both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).withColumn("m", F.least("m", "u")))
    joined = _with_least(both, least)
    if larger_only:
        return joined.filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u > v").distinct()
    out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return out.filter("u > v").distinct()


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, label) for every node that has an edge to another; label is the least node of its component."""
    links = cut(
        edges.filter(F.col(a) != F.col(b))
        .select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .distinct()
    )
    sign = None
    while True:
        links = cut(_min_pointed(_min_pointed(links, True), False))
        now = links.agg(F.count("u"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == sign:
            break
        sign = now
    nodes = links.select(F.col("u").alias("node"), F.col("v").alias("label"))
    return nodes.unionByName(links.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())
