"""Connected components of a pair table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import drop, saved


def components(pairs: DataFrame) -> DataFrame:
    """(node, root) of all nodes of pairs (a, b) that are not the least of their component, the root being that least.

    Each round is two windowed passes over the edges, written to the shared
    folder; the rounds end when the edges no longer change.  Pairs may repeat,
    and nulls and loops are dropped; an empty table gives an empty one.
    """
    a, b = pairs.columns[:2]
    edges = saved(pairs.select(F.greatest(a, b).alias("node"), F.least(a, b).alias("root")).where(F.col("node") > F.col("root")).distinct(), "edges")
    last = None
    while True:
        mark = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("node", "root").cast("decimal(38,0)"))).first()
        if mark == last:
            return edges
        last = mark
        both = edges.union(edges.select(F.col("root").alias("node"), F.col("node").alias("root")))
        least = F.least("node", F.min("root").over(Window.partitionBy("node")))
        large = both.select("node", "root", least.alias("m")).where(F.col("root") > F.col("node")).select(F.col("root").alias("node"), F.col("m").alias("root")).distinct()
        least = F.min("root").over(Window.partitionBy("node"))
        seen = large.select("node", "root", least.alias("m"))
        small = seen.select("node", F.col("m").alias("root")).union(seen.where("root > m").select(F.col("root").alias("node"), F.col("m").alias("root")))
        old, edges = edges, saved(small.distinct(), "edges")
        drop(old)
