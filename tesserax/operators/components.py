"""Connected components of a graph of numbered nodes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserax.sources.scratch import materialise

#: A node of more edges is a hub, or of over one in HUBS of all edges: so there are 2 * HUBS hubs at most, which are broadcast.
HUB, HUBS = 1000, 100_000


def components(edges: DataFrame, rounds: int = 40) -> DataFrame:
    """(node, root): for every node of edges (a, b), the smallest node reachable, by alternating star contraction.

    Large star: each node's larger neighbours move to its smallest; small star: its smaller ones do. Nodes' minima are
    partial aggregates; those of hubs are broadcast to the hubs' edges, so that these stay where they are.
    """
    edges = materialise(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    before, n = None, edges.count()
    for _ in range(rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = materialise(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("n")), "least")
        hubs = least.filter(F.col("n") > max(HUB, n // HUBS)).select("u", "m")
        larger = both.filter("v > u")
        if hubs.isEmpty():
            found = larger.join(least.select("u", "m"), "u")
        else:
            split = larger.join(F.broadcast(hubs), "u", "left")
            found = split.filter("m is null").drop("m").join(least.select("u", "m"), "u").unionByName(split.filter("m is not null"))
        large = found.select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = materialise(least.select("u", F.col("m").alias("v")).unionByName(moved).distinct(), "edges")
        now = edges.agg(F.count("*"), F.sum(F.col("u").cast("decimal(38,0)")), F.sum(F.col("v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before, n = now, now[0]
    else:
        raise RuntimeError(f"components are not stable after {rounds} rounds")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
