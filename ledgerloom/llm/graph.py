"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import materialize


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of edges (u, v); root: the smallest node of its component.

    Each round sends, from every node, its larger neighbours (large star) and then its smaller ones
    (small star) to the smallest it knows. Nodes of any degree are handled by a partial minimum and a
    join that can be split; nothing is gathered by node or on the driver but a count and a checksum.
    """
    now = materialize(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u != v").distinct(), "edges")
    seen = None
    while True:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        small = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(small, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = materialize(moved.union(small.select("u", F.col("m").alias("v"))).distinct(), "edges")
        mark = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == seen:  # every round but the last brings nodes nearer to their smallest
            break
        seen = mark
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select("v", F.col("v").alias("root")).distinct())
