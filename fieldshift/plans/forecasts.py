"""From rosters with anchors to next-period shift tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldshift.operators.dists import family_of_anchor, family_shares, unit_shift, weekly_anchor_matrix
from fieldshift.operators.forecast import GLIDE_LAMBDA, fc_glide
from fieldshift.session import stage


def last_origin(forecasts: DataFrame) -> DataFrame:
    """Rows of each season's final origin: the forecast of the period to come."""
    end = F.max("period_ix").over(Window.partitionBy("season"))
    return forecasts.withColumn("_end", end).where(F.col("period_ix") == F.col("_end")).drop("_end")


def next_distribution(features: DataFrame, anchors: int, lam: float = GLIDE_LAMBDA) -> DataFrame:
    """(season, anchor, p, p_hat): last distribution and its glide forecast."""
    forecasts = fc_glide(weekly_anchor_matrix(features, anchors), [lam])
    return last_origin(forecasts).select("season", "anchor", "p", "p_hat")


def forecast_shift(
    features: DataFrame, mapping: DataFrame, anchors: int, lam: float = GLIDE_LAMBDA, labels: DataFrame | None = None
) -> DataFrame:
    """Per season the unit shift table of the coming period.

    One shuffle of pre-aggregated (season, period, anchor) sums; everything
    after it works on periods x anchors rows.
    """
    return unit_shift(next_distribution(features, anchors, lam), mapping, labels, keys=["season"])


@dataclass(frozen=True)
class FieldState:
    """What a refresh prepares and rating reuses."""

    dist: DataFrame
    unit_shares: DataFrame
    family_shares: DataFrame


def field_state(
    features: DataFrame, mapping: DataFrame, anchors: int, season: str, lam: float = GLIDE_LAMBDA
) -> FieldState:
    """Current and predicted shares of units and families in one season.

    ``features`` carry a family column besides the anchor.
    """
    rows = features.where(F.col("season") == season)
    # both share tables read the same anchors-sized forecast
    dist = stage(next_distribution(rows, anchors, lam), "next-distribution")
    shares = stage(unit_shift(dist, mapping), "unit-shares")
    return FieldState(dist, shares, stage(family_shares(dist, family_of_anchor(rows)), "family-shares"))
