"""Connected components of an edge table, by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldshift.llm.tables import stage


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Link neighbours of each node to the smallest of them and itself.

    Large star moves the greater neighbours; small star moves the node and its lesser neighbours.
    """
    if large:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        both = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    moved = both.join(least, "u")
    if large:
        out = moved.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = moved.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            least.select("u", F.col("m").alias("v"))
        )
    return out.where("u != v").distinct()


def _signature(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """(u, root) for every node of an edge, root being the smallest node it can reach.

    ``edges`` has long columns u and v, in any direction and repeated at will; loops are ignored.
    Every round is written to the shared folder, which cuts lineage; only a
    count and a checksum come to the driver. Rounds grow with the logarithm of
    the number of nodes.
    """
    now = stage(edges.select("u", "v").where("u != v").distinct(), "edges")
    before = None
    while (mark := _signature(now)) != before:
        before = mark
        now = stage(_star(_star(now, large=True), large=False), "edges")
    roots = now.select(F.col("v").alias("u")).distinct().select("u", F.col("u").alias("root"))
    return now.select("u", F.col("v").alias("root")).unionByName(roots)
