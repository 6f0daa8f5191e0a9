"""Streams drained to tables, compared with their batch counterparts."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldshift.catalog import roles
from fieldshift.catalog.registry import query, rounded
from fieldshift.session import fresh_path
from fieldshift.streaming import weekly


def _landing(df, name, files=None):
    """Write rows as the files of an arriving table and open them as a stream; with ``files``, that many by period, a batch each."""
    path = fresh_path(df.sparkSession, name)
    reader = df.sparkSession.readStream.schema(df.schema)
    if files:
        df, reader = df.repartitionByRange(files, "period", F.xxhash64(*df.columns)), reader.option("maxFilesPerTrigger", 1)
    df.write.parquet(path)
    return reader.parquet(path)


@query(
    "stream_period_counts",
    """WITH e AS (SELECT strftime(ts, '%G-W%V') AS period, event_type AS unit, value, date_trunc('week', ts) + INTERVAL 7 DAY AS closes FROM events)
    SELECT period, unit, count(*) AS n, round(sum(value), 6) + 0.0 AS weight FROM e
    WHERE closes <= (SELECT max(ts) FROM events) - INTERVAL 2 DAY GROUP BY period, unit""",
)
def stream_period_counts(spark, sf):
    events = roles.table(spark, sf, "events").select(
        F.col("ts").cast("timestamp").alias("ts"),
        F.col("event_type").alias("unit"),
        F.col("value").alias("weight"),
        F.lit(None).cast("boolean").alias("won"),
    )
    counts = weekly.stream_period_counts(_landing(events, "landing-events"))
    path, log = fresh_path(spark, "weekly-counts"), fresh_path(spark, "weekly-counts-log")
    weekly.start_append(counts, path, log).awaitTermination()
    table = spark.read.schema(counts.schema).parquet(path)
    return rounded(table.select("period", "unit", "n", "weight"), "weight")


@query(
    "stream_forecast_refresh",
    """SELECT season, period_ix, anchor, rnd(p_hat) AS p_hat FROM glide WHERE lam = 0.3
    AND season IN (SELECT season FROM feats GROUP BY season HAVING count(*) >= 20)""",
    "glide feats",
)
def stream_forecast_refresh(spark, sf):
    frozen = roles.space(spark, sf)
    rows = roles.features(spark, sf, frozen).select("season", "period", "anchor", "weight")
    stream = _landing(rows, "landing-features", files=4)
    state, log = fresh_path(spark, "forecast-state"), fresh_path(spark, "forecast-log")
    weekly.start_forecast_refresh(stream, state, log, frozen.size, min_rows=20).awaitTermination()
    out = weekly.current_forecast(spark, state).select("season", "period_ix", "anchor", "p_hat")
    return rounded(out, "p_hat")


@query("stream_dedupe", "SELECT DISTINCT user_id, event_type FROM events")
def stream_dedupe(spark, sf):
    events = roles.table(spark, sf, "events").select(
        F.col("ts").cast("timestamp").alias("ts"),
        "user_id",
        "event_type",
        F.sha2(F.concat_ws("|", F.col("user_id").cast("string"), "event_type"), 256).alias("roster_hash"),
    )
    first = weekly.stream_dedupe(_landing(events, "landing-dedupe"), delay="60 days").select("user_id", "event_type")
    path, log = fresh_path(spark, "first-seen"), fresh_path(spark, "first-seen-log")
    weekly.start_append(first, path, log).awaitTermination()
    return spark.read.schema(first.schema).parquet(path)
