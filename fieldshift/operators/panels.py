"""Weekly panels: weighted counts, shares and win rates per period."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldshift.functions.periods import iso_period
from fieldshift.functions.vectors import as_double, l2, mean_vector
from fieldshift.session import stage


def base_frame(rosters: DataFrame) -> DataFrame:
    """Tidy rows: period, unit, outcome, weight, source and the species list."""
    return rosters.where(F.col("ts").isNotNull()).select(
        "roster_id",
        iso_period(F.col("ts")).alias("period"),
        F.unix_timestamp("ts").alias("ts"),
        "unit",
        "won",
        F.col("weight").cast("double").alias("weight"),
        "source",
        F.transform("members", lambda m: m["species"]).alias("elements"),
    )


def win_rate(weight: Column | None = None, won: Column | None = None) -> Column:
    """Aggregate: weighted win rate over labelled rows, NULL without weight."""
    weight = F.col("weight") if weight is None else weight
    won = F.col("won") if won is None else won
    labelled = F.sum(F.when(won.isNotNull(), weight))
    return F.when(labelled > 0, F.sum(F.when(won.isNotNull(), won.cast("double") * weight)) / labelled)


def period_totals(frame: DataFrame) -> DataFrame:
    return frame.groupBy("period").agg(F.sum("weight").alias("period_weight"))


def attach_period_weight(frame: DataFrame) -> DataFrame:
    """Every row with its period's total weight.

    A period may hold a third of all rows, so the total is pre-aggregated and
    joined rather than computed in a window over the rows.
    """
    return frame.join(stage(period_totals(frame), "period-total"), "period")


def unit_panel(frame: DataFrame, unit: str = "unit") -> DataFrame:
    """Per (period, unit): rows, weight, share within the period, win rate."""
    panel = (
        frame.where(F.col("period").isNotNull() & F.col(unit).isNotNull())
        .groupBy("period", F.col(unit).alias("unit"))
        .agg(F.count(F.lit(1)).alias("n"), F.sum("weight").alias("weight"), win_rate().alias("win_rate"))
    )
    share = F.col("weight") / F.sum("weight").over(Window.partitionBy("period"))
    return panel.withColumn("share", share)


def element_panel(frame: DataFrame, elements: str = "elements") -> DataFrame:
    """Per (period, element): each row counts once per element it holds.

    The denominator is the weight of the unexploded rows, so usage sums to
    more than one.
    """
    panel = (
        frame.select("period", "weight", "won", F.explode(F.array_distinct(elements)).alias("element"))
        .where(F.col("element").isNotNull())
        .groupBy("period", "element")
        .agg(F.count(F.lit(1)).alias("n"), F.sum("weight").alias("weight"), win_rate().alias("win_rate"))
    )
    joined = panel.join(period_totals(frame), "period")
    return joined.withColumn("usage", F.col("weight") / F.col("period_weight")).drop("period_weight")


def period_entropy(panel: DataFrame, share: str = "share") -> DataFrame:
    """Shannon entropy in bits of each period's positive shares.

    With S the sum of positive shares, H = log2 S - sum(p log2 p) / S, one pass.
    """
    p = F.when(F.col(share) > 0, F.col(share))
    return panel.groupBy("period").agg(
        (F.log2(F.sum(p)) - F.sum(p * F.log2(p)) / F.sum(p)).alias("entropy_bits"),
        F.count(F.lit(1)).alias("n_units"),
    )


def _centroids(frame: DataFrame, keys: Sequence[str]) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy("period")
    return (
        frame.groupBy(*keys, "period")
        .agg(mean_vector(F.col("embedding")).alias("centroid"))
        .withColumn("prev_period", F.lag("period").over(order))
        .withColumn("prev_centroid", F.lag("centroid").over(order))
        .where(F.col("prev_period").isNotNull())
    )


def centroid_drift(frame: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Distance between the mean vectors of consecutive periods."""
    return _centroids(frame, keys).select(
        *keys, "period", "prev_period", l2(F.col("centroid"), F.col("prev_centroid")).alias("centroid_drift")
    )


def period_novelty(frame: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Mean distance of a period's rows to the previous period's centroid."""
    previous = stage(_centroids(frame, keys).drop("centroid"), "centroids")
    return (
        frame.join(previous, [*keys, "period"])
        .groupBy(*keys, "period", "prev_period")
        .agg(F.avg(l2(as_double(F.col("embedding")), F.col("prev_centroid"))).alias("novelty"))
    )


def heavy_units(panel: DataFrame, threshold: float = 200.0) -> DataFrame:
    """Panel rows of units whose total weight reaches the threshold."""
    total = F.sum("weight").over(Window.partitionBy("unit"))
    return panel.withColumn("_t", total).where(F.col("_t") >= threshold).drop("_t")


def top_units(panel: DataFrame, k: int = 8) -> DataFrame:
    """Trajectories of the k heaviest units over every period of the panel."""
    top = (
        panel.groupBy("unit")
        .agg(F.sum("weight").alias("_t"))
        .orderBy(F.col("_t").desc(), F.col("unit"))
        .limit(k)
        .agg(F.sort_array(F.collect_list("unit")))
        .scalar()
    )
    grid = panel.select("period").distinct().select("period", F.explode(top).alias("unit"))
    return grid.join(panel.select("period", "unit", "share"), ["period", "unit"], "left")


# --- lags and tests on panels: one row per (period, unit) ---


def panel_lags(panel: DataFrame, value: str = "share", unit: str = "unit") -> DataFrame:
    """value, its lag, the change, the change's lag and the lagged win rate.

    Lags step over rows, not over the calendar.
    """
    by = Window.partitionBy(unit).orderBy("period")
    return (
        panel.select(unit, "period", F.col(value).alias("value"), "win_rate")
        .withColumn("value_lag1", F.lag("value").over(by))
        .withColumn("winrate_lag1", F.lag("win_rate").over(by))
        .withColumn("delta", F.col("value") - F.col("value_lag1"))
        .withColumn("delta_lag1", F.lag("delta").over(by))
        .drop("win_rate")
    )


def within_demean(frame: DataFrame, columns: Sequence[str], group: str = "unit") -> DataFrame:
    """Subtract the group mean. Means are pre-aggregated, then joined back."""
    means = frame.groupBy(group).agg(*[F.avg(c).alias(f"_m_{c}") for c in columns])
    joined = frame.join(means, group)
    for c in columns:
        joined = joined.withColumn(c, F.col(c) - F.col(f"_m_{c}"))
    return joined.drop(*[f"_m_{c}" for c in columns])


def persistence_baseline(panel: DataFrame, value: str = "share", unit: str = "unit") -> DataFrame:
    """Mean absolute error of "next = current" and of "next = unit mean"."""
    lagged = panel_lags(panel, value, unit).dropna(subset=["value", "value_lag1"])
    mean = F.avg("value").over(Window.partitionBy(unit))
    return lagged.withColumn("_mean", mean).agg(
        F.avg(F.abs(F.col("value") - F.col("value_lag1"))).alias("persistence_mae"),
        F.avg(F.abs(F.col("value") - F.col("_mean"))).alias("climatology_mae"),
        F.count(F.lit(1)).alias("n_transitions"),
    )
