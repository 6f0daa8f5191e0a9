"""Rating batches of rosters against the current and the coming field."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldshift.functions.vectors import dot, double_array
from fieldshift.operators.pairing import Field, FieldTable, PairModel, expected_winrate, field_rates, share_weights, weighted_rates
from fieldshift.plans.forecasts import FieldState

UNIT_MIN_SHARE = 0.005


def rate_batch(
    rosters: DataFrame,
    unit_samples: DataFrame,
    family_samples: DataFrame,
    state: FieldState,
    model: PairModel,
    unit_min_share: float = UNIT_MIN_SHARE,
) -> DataFrame:
    """Four aggregates per roster: by unit and by family, current and predicted.

    A field that fits is loaded with its shares and the rosters are scored in
    one pass per field without a shuffle; a larger one is met block by block.
    """
    units, families = Field.load(unit_samples, "unit"), Field.load(family_samples, "family")
    # the floor is on the current share, whichever share weighs
    unit_shares = state.unit_shares.where(F.col("current_share") >= unit_min_share)
    both = {"current": "current_share", "predicted": "predicted_share"}
    if isinstance(units, Field) and isinstance(families, Field):
        vec = F.col("embedding")
        rated = rosters.select("roster_id", field_rates(vec, units, model).alias("_u"), field_rates(vec, families, model).alias("_f"))
        averages = [
            dot(F.col(rates), double_array(share_weights(shares, field, kind, column))).alias(f"{name}_by_{kind}")
            for rates, shares, kind, field in (("_u", unit_shares, "unit", units), ("_f", state.family_shares, "family", families))
            for name, column in both.items()
        ]
        return rated.select("roster_id", *averages)
    by_unit = weighted_rates(rosters, units, unit_shares, {f"{n}_by_unit": c for n, c in both.items()}, model, "unit")
    by_family = weighted_rates(rosters, families, state.family_shares, {f"{n}_by_family": c for n, c in both.items()}, model, "family")
    return by_unit.join(by_family, "roster_id")


def rate_details(
    rosters: DataFrame,
    unit_samples: DataFrame,
    family_samples: DataFrame,
    state: FieldState,
    model: PairModel,
    unit_min_share: float = UNIT_MIN_SHARE,
) -> DataFrame:
    """(roster_id, kind, name, rate): win rate against every family and every unit of a share worth naming."""
    units, families = Field.load(unit_samples, "unit"), Field.load(family_samples, "family")
    shown = state.unit_shares.where(F.col("current_share") >= unit_min_share).select(F.col("unit").cast("string").alias("name"))

    def rows(kind: str, field: Field | FieldTable) -> DataFrame:
        if isinstance(field, FieldTable):
            met = expected_winrate(rosters, field, model, "name").withColumn("name", F.col("name").cast("string"))
            return met.select("roster_id", F.lit(kind).alias("kind"), "name", F.col("win_rate").alias("rate"))
        names = F.array(*[F.lit(str(u)) for u in field.keys])
        rates = F.arrays_zip(names.alias("name"), field_rates(F.col("embedding"), field, model).alias("rate"))
        zipped = rosters.select("roster_id", F.explode(rates).alias("_r"))
        return zipped.select("roster_id", F.lit(kind).alias("kind"), F.col("_r.name").alias("name"), F.col("_r.rate").alias("rate"))

    return rows("unit", units).join(shown, "name", "left_semi").unionByName(rows("family", families))
