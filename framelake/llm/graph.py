"""Connected components by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, stored


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """One step: every node sends its larger (large star) or smaller (small star) neighbours to the least node it knows."""
    if large:
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        both = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    joined = both.join(least, "u")
    if large:
        out = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return out.where("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """From edges (u, v): (node, root) for every node of an edge; root is the component's least node.

    A node of many edges is summed with partial aggregation before its least
    neighbour travels back along an equi-join, which AQE splits where it is
    skewed. The edges of each step are written to the shared folder; the driver
    sees only their number and a sum of their hashes, to know when they settle.
    """
    now = stored(edges.select("u", "v").where("u <> v").distinct(), "edges")
    state = None
    while True:
        after = stored(_stars(_stars(now, True), False), "edges")
        mark = tuple(after.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        dropped(now)
        now = after
        if mark == state:
            break
        state = mark
    roots = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
