"""Connected components by alternating star contraction, in joins and aggregations only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from capturelake.llm.text import released, stored


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of ``edges`` (u long, v long); the component is its smallest node.

    Each round links a node's larger neighbours to its smallest one, then its smaller ones; both keep connectivity and end
    in stars around the smallest nodes. A node's links are reduced by partial aggregation, and lineage is cut
    every round. An empty table has no nodes.
    """
    edges = stored(edges.filter("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        larger = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = larger.groupBy("u").agg(F.min("v").alias("m"))
        joined = larger.join(least, "u")
        smaller = joined.filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        done, edges = edges, stored(smaller.unionByName(least.select("u", F.col("m").alias("v"))).filter("u != v").distinct(), "edges")
        released(done)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.countDistinct("u")).first()
        if now == before and now[0] == now[2]:
            break
        before = now
    nodes = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return nodes.unionByName(roots)
