"""Time expressions: ISO-week labels, ISO-8601 instants."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def iso_period(ts: Column) -> Column:
    """Timestamp to ``YYYY-Www`` using the ISO week-numbering year."""
    year = F.extract(F.lit("YEAROFWEEK"), ts)
    week = F.extract(F.lit("WEEK"), ts)
    return F.format_string("%d-W%02d", year, week)


def iso_period_of_epoch(seconds: Column) -> Column:
    return iso_period(F.timestamp_seconds(seconds))


def epoch_of_iso(text: Column) -> Column:
    """ISO-8601 text with ``Z``, an offset or neither to epoch seconds (UTC)."""
    return F.unix_timestamp(F.to_timestamp(text))


def periods_ago(period_ix: Column, query_ix: Column | int, step: float = 1.0) -> Column:
    """Signed offset from the queried period; zero or negative for the past."""
    query = query_ix if isinstance(query_ix, Column) else F.lit(query_ix)
    return (period_ix - query).cast("double") * F.lit(float(step))
