"""Connected components of edges that are spread over a cluster."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphloom.sources.shared import written


def components(edges: DataFrame) -> DataFrame:
    """node and root, the smallest node that it is joined with, of all nodes of edges (a, b) that are joined with a smaller one.

    Stars are folded, large ones and small ones in turn, until nothing changes: each round at least halves the depth of what is left,
    and no node's neighbours are held in one place. Nodes are of any type that has an order; loops, doubles and edges with a null
    join nothing; without edges there are no rows."""
    last = None
    pairs = edges.where("a is not null and b is not null and a <> b").select("a", "b")
    while True:
        both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        down = large.where("a <> b")
        least = down.groupBy("a").agg(F.min("b").alias("m"))
        moved = down.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        pairs = written(least.withColumnRenamed("m", "b").unionByName(moved).distinct(), "stars")
        now = tuple(pairs.agg(F.count("*"), F.sum(F.xxhash64("a", "b") % (1 << 40))).first())
        if now == last:
            return pairs.select(F.col("a").alias("node"), F.col("b").alias("root"))
        last = now
