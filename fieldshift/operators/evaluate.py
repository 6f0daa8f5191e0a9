"""Honest scoring of forecasters: every origin, leave one season out."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldshift.functions.simplex import kl_bits
from fieldshift.operators.dists import unit_shift
from fieldshift.operators.forecast import (
    CANDIDATE,
    GLIDE_LAMBDAS,
    LEVEL_Q,
    MIX_PARAMS,
    VOL_PARAMS,
    Forecasters,
    fc_combination,
    fc_custom,
    fc_glide,
    fc_local_level,
    fc_persistence,
    fc_stoch_vol,
)

POINT = ("season", "period_ix")
CAND = list(CANDIDATE)
# A forecast made from one period equals the last observation up to rounding;
# a difference this small is a tie, not a win.
TIE = 1e-9


def forecast_points(P: DataFrame) -> DataFrame:
    """Origins that have a following period, with that period's actual mass."""
    ahead = Window.partitionBy("season", "anchor").orderBy("period_ix")
    return P.withColumn("actual", F.lead("p").over(ahead)).where(F.col("actual").isNotNull())


def all_candidates(
    P: DataFrame,
    ref: int,
    level_q: Sequence[float] = LEVEL_Q,
    vol: Sequence[tuple[float, float]] = VOL_PARAMS,
    lambdas: Sequence[float] = GLIDE_LAMBDAS,
    mix: Sequence[tuple[float, float]] = MIX_PARAMS,
    custom: Forecasters | None = None,
) -> DataFrame:
    """Persistence, the four families over their grids and the user's forecasters, each in one pass.

    What comes out is scored, selected, raced and back-tested alike, whoever made it.
    """
    base = fc_local_level(P, ref, list(dict.fromkeys(q for q, _ in mix)))
    frames = [
        fc_persistence(P),
        fc_local_level(P, ref, level_q),
        fc_stoch_vol(P, ref, vol),
        fc_glide(P, lambdas),
        fc_combination(base, list(dict.fromkeys(w for _, w in mix))),
        *([fc_custom(P, custom)] if custom else []),
    ]
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame)
    return out


def score_candidates(forecasts: DataFrame) -> DataFrame:
    """KL in bits per (candidate, origin): actual next distribution against the forecast.

    The next actual sits in the same frame, one row later per anchor.
    """
    ahead = Window.partitionBy("season", *CAND, "anchor").orderBy("period_ix")
    return (
        forecasts.withColumn("actual", F.lead("p").over(ahead))
        .where(F.col("actual").isNotNull())
        .groupBy(*CAND, *POINT)
        .agg(kl_bits(F.col("actual"), F.col("p_hat")).alias("kl"))
    )


def loro_select(scores: DataFrame) -> DataFrame:
    """Per (family, season): the candidate best on the other seasons, and its KL there.

    The other seasons' mean is the total less the own season's part, so there
    is no loop over folds.
    """
    per = scores.groupBy(*CAND, "season").agg(F.sum("kl").alias("_s"), F.count(F.lit(1)).alias("_n"))
    whole = Window.partitionBy(*CAND)
    rest = per.withColumn("_others", F.sum("_n").over(whole) - F.col("_n")).withColumn(
        "train_kl", (F.sum("_s").over(whole) - F.col("_s")) / F.nullif(F.col("_others"), F.lit(0))
    )
    return rest.where(F.col("train_kl").isNotNull()).groupBy("family", "season").agg(
        F.min_by(F.struct("cand_ix", "label"), F.struct("train_kl", "cand_ix")).alias("_b"),
        F.min("train_kl").alias("train_kl"),
    ).select("family", "season", "_b.cand_ix", "_b.label", "train_kl")


def honest_scores(scores: DataFrame) -> DataFrame:
    """Per point the KL of the candidate selected without that point's season."""
    chosen = loro_select(scores).select("family", "season", "cand_ix", "label")
    return scores.join(chosen.drop("label"), ["family", "season", "cand_ix"])


def horse_race(scores: DataFrame) -> DataFrame:
    """Per family: honest mean KL, percentage of points beating persistence, usual choice."""
    families = scores.where(F.col("family") != "persistence")
    bar = scores.where(F.col("family") == "persistence").select(*POINT, F.col("kl").alias("bar"))
    raced = (
        honest_scores(families)
        .join(bar, list(POINT))
        .groupBy("family")
        .agg(
            F.avg("kl").alias("mean_kl"),
            (100.0 * F.avg(F.when(F.col("kl") < F.col("bar") - TIE, 1.0).otherwise(0.0))).alias("beats_pct"),
        )
    )
    usual = (
        loro_select(families)
        .groupBy("family", "label")
        .agg(F.count(F.lit(1)).alias("_n"))
        .groupBy("family")
        .agg(F.min_by("label", F.struct((-F.col("_n")).alias("o"), "label")).alias("selected"))
    )
    base = bar.agg(F.avg("bar").alias("mean_kl")).select(
        F.lit("persistence").alias("family"), "mean_kl", F.lit(0.0).alias("beats_pct"), F.lit("-").alias("selected")
    )
    return raced.join(usual, "family").unionByName(base).orderBy("mean_kl", "family")


def best_candidate(scores: DataFrame) -> DataFrame:
    """The winning family's candidate with the lowest mean KL over all points.

    Empty when persistence wins the race: there is then nothing to forecast with.
    """
    winner = horse_race(scores).orderBy("mean_kl", "family").limit(1).select("family")
    means = scores.where(F.col("family") != "persistence").groupBy(*CAND).agg(F.avg("kl").alias("_m"))
    return means.join(winner, "family").orderBy("_m", "cand_ix").limit(1).select(*CAND)


def best_next_forecast(
    forecasts: DataFrame, scores: DataFrame, latest_season: str, mapping: DataFrame, labels: DataFrame | None = None
) -> DataFrame:
    """Shift table of the latest season by the best candidate."""
    best = best_candidate(scores).first()
    # the one chosen candidate becomes a literal filter, which prunes the other families' plans
    chosen = F.lit(False) if best is None else (F.col("family") == best["family"]) & (F.col("cand_ix") == best["cand_ix"])
    last = forecasts.where((F.col("season") == latest_season) & chosen)
    end = F.max("period_ix").over(Window.partitionBy("season"))
    picked = last.withColumn("_end", end).where(F.col("period_ix") == F.col("_end"))
    return unit_shift(picked, mapping, labels)


def _against_persistence(scores: DataFrame, model: str) -> DataFrame:
    bar = scores.where(F.col("family") == "persistence").select(*POINT, F.col("kl").alias("kl_persistence"))
    mine = scores.where(F.col("label") == model).select(*POINT, F.col("kl").alias("kl_model"))
    return mine.join(bar, list(POINT)).withColumn(
        "model_beats_persistence", F.col("kl_model") < F.col("kl_persistence") - TIE
    )


def backtest_rolling(scores: DataFrame, sizes: DataFrame, model: str, holdout: int = 2) -> DataFrame:
    """The last ``holdout`` forecast periods of each season.

    ``scores`` are per origin; the held-out period is the next one. ``sizes``
    is (season, period_ix, n).
    """
    table = _against_persistence(scores, model).withColumn("period_ix", F.col("period_ix") + 1)
    latest = Window.partitionBy("season").orderBy(F.col("period_ix").desc())
    recent = table.withColumn("_r", F.row_number().over(latest)).where(F.col("_r") <= holdout).drop("_r")
    return recent.join(sizes, list(POINT))


def backtest_season_out(scores: DataFrame, sizes: DataFrame, model: str) -> DataFrame:
    """Each season's final period, forecast from its earlier ones; n counts the whole season."""
    table = _against_persistence(scores, model)
    final = Window.partitionBy("season").orderBy(F.col("period_ix").desc())
    last = table.withColumn("_r", F.row_number().over(final)).where(F.col("_r") == 1).drop("_r", "period_ix")
    return last.join(sizes.groupBy("season").agg(F.sum("n").alias("n")), "season")


def largest_seasons(sizes: DataFrame, n: int) -> DataFrame:
    """The n seasons with most rows (0 = all)."""
    totals = sizes.groupBy("season").agg(F.sum("n").alias("_n"))
    return (totals.orderBy(F.col("_n").desc(), "season").limit(n) if n else totals).select("season")


def parameter_sweep(scores: DataFrame, sizes: DataFrame, n_folds: int = 5) -> DataFrame:
    """Every candidate on the final period of the n largest seasons, best margin first."""
    kept = scores.join(largest_seasons(sizes, n_folds), "season")
    end = F.max("period_ix").over(Window.partitionBy("season"))
    final = kept.withColumn("_end", end).where(F.col("period_ix") == F.col("_end")).drop("_end")
    bar = final.where(F.col("family") == "persistence").select("season", F.col("kl").alias("kl_persistence"))
    runs = final.where(F.col("family") != "persistence").join(bar, "season")
    return sweep_summary(runs.withColumnRenamed("kl", "kl_model"), CAND)


def sweep_summary(runs: DataFrame, config: Sequence[str]) -> DataFrame:
    """Per configuration: mean KLs, mean margin, folds won and folds, best margin first."""
    margin = F.col("kl_model") - F.col("kl_persistence")
    return (
        runs.groupBy(*config)
        .agg(
            F.avg("kl_model").alias("mean_kl_model"),
            F.avg("kl_persistence").alias("mean_kl_persist"),
            F.avg(margin).alias("mean_margin"),
            F.count_if(margin < -TIE).alias("beats"),
            F.count(F.lit(1)).alias("folds"),
        )
        .orderBy("mean_margin", *config)
    )
