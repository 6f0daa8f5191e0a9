"""Seeded draws that do not depend on partitioning, and group-wise ranking.

A draw is the md5 of the row's key and a seed, so a sample is the same on any
cluster layout.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldshift.session import stage

# Hex digits of a draw that a threshold is found on: 65,536 bins a group.
BIN_DIGITS = 4


def draw(seed: int | str, *cols: Column) -> Column:
    return F.md5(F.concat_ws("|", *[c.cast("string") for c in cols], F.lit(str(seed))))


def uniform(key: Column) -> Column:
    """First eight hex digits of a draw as a number in [0, 1)."""
    return F.conv(F.substring(key, 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def first_k(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, rank: str | None = None) -> DataFrame:
    """First k rows of each group, for small k: Spark cuts each group to k rows inside the map tasks."""
    out = rank or "_rank"
    df = df.withColumn(out, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    df = df.where(F.col(out) <= k)
    return df if rank else df.drop(out)


def lowest_draws(df: DataFrame, keys: Sequence[str], drawn: Column, tie: str, k: int) -> DataFrame:
    """The k rows of each group with the smallest draws, ties by the row key ``tie``, for any k.

    A first scan counts rows by the leading digits of their draws, added up
    before the shuffle; the bin in which a group reaches k rows is its threshold.
    A second scan keeps rows up to it, so only k rows and what shares the last
    bin are sorted, never the group. A group with fewer rows is kept whole.
    """
    ready = df.withColumn("_d", drawn).withColumn("_b", F.substring("_d", 1, BIN_DIGITS))
    names = {c: f"_k{i}" for i, c in enumerate(keys)}
    counts = ready.groupBy(*[F.col(c).alias(n) for c, n in names.items()], "_b").agg(F.count(F.lit(1)).alias("_n"))
    below = Window.partitionBy(*names.values()).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    reached = counts.withColumn("_below", F.coalesce(F.sum("_n").over(below), F.lit(0))).where(F.col("_below") < k)
    ends = stage(reached.groupBy(*names.values()).agg(F.max("_b").alias("_end")), "draw-threshold")  # a row per group
    same = F.lit(True)
    for c, n in names.items():
        same = same & F.col(c).eqNullSafe(F.col(n))
    near = ready.join(ends, same).where(F.col("_b") <= F.col("_end")).select(*df.columns, "_d")
    return first_k(near, keys, [F.col("_d"), F.col(tie)], k).drop("_d")


def numbered(
    df: DataFrame,
    keys: Sequence[str],
    bucket: Sequence[Column],
    order: Sequence[Column],
    out: str,
) -> DataFrame:
    """1-based row number per group without one task per group.

    ``bucket`` must be monotone with ``order`` and bound its own size. Rows are
    numbered inside (group, bucket) and shifted by the group's earlier buckets.
    """
    names = [f"_b{i}" for i in range(len(bucket))]
    for name, col in zip(names, bucket):
        df = df.withColumn(name, col)
    at = [*keys, *names]
    earlier = Window.partitionBy(*keys).orderBy(*names).rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        df.groupBy(*at)
        .agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_off", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
        .drop("_n")
    )
    local = Window.partitionBy(*at).orderBy(*order)
    return (
        df.withColumn(out, F.row_number().over(local))
        .join(offsets, at)
        .withColumn(out, F.col(out) + F.col("_off"))
        .drop("_off", *names)
    )


def ranked(df: DataFrame, order: Sequence[str], out: str) -> DataFrame:
    """1-based place of each row in the whole table's order, without one task for it.

    The table is range-partitioned and written; rows are numbered inside their
    partition and shifted by the counts of the partitions before it.
    """
    placed = df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id())
    placed = stage(placed, "ranked")
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    offsets = offsets.select("_part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_off"))
    local = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return placed.withColumn(out, local).join(offsets, "_part").withColumn(out, F.col(out) + F.col("_off")).drop("_part", "_off")
