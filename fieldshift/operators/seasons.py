"""Seasons and periods: windows, calendars, slices, balance."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldshift.functions.draws import draw, first_k, lowest_draws
from fieldshift.functions.text import mentions_any
from fieldshift.session import stage

# Events whose name mentions one of these are not the main format.
OFF_FORMAT = ("UU", "CUSTOM", "SVI", "BSS", "2v2", "Little Cup", "Metronome", "Gen 8", "Gen8", "LGPE")


def exclude_keywords(events: DataFrame, keywords: Sequence[str] | Column, name: str = "name") -> DataFrame:
    return events.where(~F.coalesce(mentions_any(F.col(name), keywords), F.lit(False)))


def season_keywords(tokens: DataFrame, off_format: Sequence[str] = OFF_FORMAT) -> DataFrame:
    """Per season the keywords to exclude: off-format plus other seasons' tokens.

    ``tokens`` holds (season, tokens array); the seasons are a short list.
    """
    everything = tokens.agg(F.array_distinct(F.flatten(F.collect_list("tokens")))).scalar()
    off = F.array(*[F.lit(k) for k in off_format]).cast("array<string>")
    return tokens.select("season", F.concat(off, F.array_except(everything, F.col("tokens"))).alias("exclude"))


def season_windows(rows: DataFrame, windows: DataFrame, ts: str = "ts", name: str | None = None) -> DataFrame:
    """Attach the season whose closed window [start_ts, end_ts] holds the row.

    The windows are spread over the months they touch, which turns the range
    join into an equi join on the month. With ``name`` the windows' ``exclude``
    keywords drop rows whose name mentions one of them.
    """
    months = windows.withColumn(
        "_month",
        F.explode(
            F.sequence(F.trunc(F.col("start_ts"), "MM"), F.trunc(F.col("end_ts"), "MM"), F.expr("interval 1 month"))
        ),
    )
    joined = rows.withColumn("_month", F.trunc(F.col(ts), "MM")).join(months, "_month")
    joined = joined.where(F.col(ts).between(F.col("start_ts"), F.col("end_ts")))
    if name is not None:
        joined = joined.where(~mentions_any(F.col(name), F.col("exclude"))).drop("exclude")
    return joined.drop("_month", "start_ts", "end_ts")


def calendar(rows: DataFrame, keys: Sequence[str] = ("season",), period: str = "period") -> DataFrame:
    """Distinct periods with a dense 0-based index, per season or global."""
    order = Window.partitionBy(*keys).orderBy(period)
    return rows.select(*keys, period).distinct().withColumn("period_ix", (F.row_number().over(order) - 1).cast("int"))


def with_period_index(rows: DataFrame, keys: Sequence[str] = ("season",), period: str = "period") -> DataFrame:
    """Index every row. The calendar is staged, so the join knows its true size."""
    return rows.join(stage(calendar(rows, keys, period), "calendar"), [*keys, period])


def slice_before(rows: DataFrame, horizon: int) -> DataFrame:
    return rows.where(F.col("period_ix") < horizon)


def season_view(rows: DataFrame, season) -> DataFrame:
    return rows.where(F.col("season") == season)


def subset_seasons(rows: DataFrame, keep: Sequence) -> DataFrame:
    """Keep the listed seasons and number them 0.. in the order given."""
    listed = F.array(*[F.lit(s) for s in keep])
    return rows.where(F.col("season").isin(list(keep))).withColumn(
        "season_id", (F.array_position(listed, F.col("season")) - 1).cast("int")
    )


def min_period(rows: DataFrame, label: str, keys: Sequence[str] = ("season",)) -> DataFrame:
    """Drop periods before a label and index the rest from zero."""
    return with_period_index(rows.where(F.col("period") >= label), keys)


def recent_slice(
    rows: DataFrame, n_periods: int, per_period: int, seed: int = 0, key: str = "row_id", keys: Sequence[str] = ("season",)
) -> DataFrame:
    """Last n periods of each season, at most k seeded rows in each, reindexed.

    ``rows`` carries period_ix. k = 0 keeps every row.
    """
    ends = stage(rows.groupBy(*keys).agg(F.max("period_ix").alias("_last")), "season-end")
    first = F.greatest(F.col("_last") - (n_periods - 1), F.lit(0))
    recent = (
        rows.join(ends, list(keys))
        .where(F.col("period_ix") >= first)
        .withColumn("period_ix", F.col("period_ix") - first)
        .drop("_last")
    )
    if not per_period:
        return recent
    return lowest_draws(recent, [*keys, "period_ix"], draw(seed, F.col(key)), key, per_period)


def balanced_sample(rows: DataFrame, per_season: int = 3500, seed: int = 7, key: str = "row_id") -> DataFrame:
    """At most k seeded rows per season."""
    return lowest_draws(rows, ["season"], draw(seed, F.col(key)), key, per_season)


def balance_seasons(rows: DataFrame, mode: str = "equal") -> DataFrame:
    """Scale weights so that seasons contribute comparably.

    equal: mean total over own total; sqrt: the same on square roots; none: 1.
    """
    totals = rows.groupBy("season").agg(F.sum("weight").alias("_t"))
    over = Window.partitionBy()
    factor = {
        "none": F.lit(1.0),
        "equal": F.avg("_t").over(over) / F.col("_t"),
        "sqrt": F.sqrt("_t") * (F.avg("_t").over(over) / F.avg(F.sqrt("_t")).over(over)) / F.col("_t"),
    }[mode]
    factors = stage(totals.select("season", factor.alias("_f")), "season-factor")
    return rows.join(factors, "season").withColumn("weight", F.col("weight") * F.col("_f")).drop("_f")


def largest_events(events: DataFrame, n: int, keys: Sequence[str] = ("season",)) -> DataFrame:
    """n largest events by players per season; 0 keeps all."""
    if not n:
        return events
    order = [F.col("players").desc(), F.col("id")]
    if keys:
        return first_k(events, keys, order, n)
    return events.orderBy(*order).limit(n)


def not_yet_stored(events: DataFrame, stored: DataFrame, key: str = "id") -> DataFrame:
    """Events without stored output."""
    return events.join(stored.select(key), key, "left_anti")
