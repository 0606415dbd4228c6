"""Connected components of an edge table, by alternating star operations (Kiveris et al. 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperlode.llm.common import stored


def _stars(edges: DataFrame, larger: bool) -> DataFrame:
    """Join the neighbours of every node to the smallest of them: all larger neighbours, or the smaller ones and
    the node itself."""
    if larger:
        around = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        around = edges
    least = around.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    # stored, so that the join exchanges both sides and a node with very many neighbours can be split
    least = stored(least, "star-minima")
    if larger:
        moved = around.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        moved = around.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        moved = moved.unionByName(least.select("u", F.col("m").alias("v")))
    return moved.filter("u > v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node that has an edge to another; `root` is the smallest node it is connected with.

    `edges` has integer columns u and v in any direction; loops and repeats do no harm. Only counts and
    checksums reach the driver.
    """
    now = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u > v").distinct()
    now, seen = stored(now, "edges"), None
    while True:
        now = stored(_stars(stored(_stars(now, True), "large-star"), False), "small-star")
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % 1_000_003)).first()
        if state == seen:
            break
        seen = state
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )
