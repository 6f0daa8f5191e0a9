"""Next-period forecasts of a weekly distribution, at every origin at once.

Input is the long frame (season, period_ix, anchor, p) on a fixed anchor
domain. Output keeps those rows and adds ``p_hat``, the forecast made at that
origin for the following period, and the candidate's (family, cand_ix, label).
A season has periods x anchors rows whatever the number of rosters, so the
windows below stay small.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldshift.functions.draws import draw, lowest_draws

# The candidate grid.
LEVEL_Q = (0.05, 0.1, 0.2, 0.5, 1.0, 2.0, 5.0)
VOL_PARAMS = tuple((q, g) for q in (0.1, 0.5, 1.0, 2.0) for g in (0.5, 0.8))
GLIDE_LAMBDAS = (0.0, 0.1, 0.2, 0.3, 0.5, 0.8)
MIX_PARAMS = tuple((q, w) for q in (0.2, 0.5, 1.0) for w in (0.25, 0.5, 0.75))
GLIDE_LAMBDA = 0.3
# (decay, smoothing) of discounted sums in the parameter sweep.
DISCOUNTS = tuple((d, s) for d in (0.3, 0.7, 1.5) for s in (0.5, 1.0, 5.0))

CANDIDATE = ("family", "cand_ix", "label")
_CELL = ("season", "period_ix")


def _text(x: float) -> str:
    return f"{x:g}"


def _candidates(family: str, params: Sequence[tuple], names: Sequence[str], label: Callable) -> Column:
    rows = [
        F.struct(
            F.lit(family).alias("family"),
            F.lit(i).alias("cand_ix"),
            F.lit(label(*p)).alias("label"),
            *[F.lit(float(v)).alias(n) for n, v in zip(names, p)],
        )
        for i, p in enumerate(params)
    ]
    return F.explode(F.array(*rows))


def _with_candidates(df: DataFrame, column: Column, names: Sequence[str]) -> DataFrame:
    df = df.withColumn("_c", column)
    fields = [*CANDIDATE, *names]
    return df.select(*[c for c in df.columns if c != "_c"], *[F.col(f"_c.{f}").alias(f) for f in fields])


def _cell() -> Window:
    return Window.partitionBy(*_CELL, *CANDIDATE)


def _result(df: DataFrame, extra: Sequence[str] = ()) -> DataFrame:
    return df.select("season", "period_ix", "anchor", "p", *CANDIDATE, "p_hat", *extra)


def fc_persistence(P: DataFrame) -> DataFrame:
    """The last observed distribution."""
    return _result(
        P.withColumn("p_hat", F.col("p"))
        .withColumn("family", F.lit("persistence"))
        .withColumn("cand_ix", F.lit(0))
        .withColumn("label", F.lit("persistence"))
    )


def running_mean(P: DataFrame) -> DataFrame:
    """Expanding mean of every anchor up to the origin."""
    upto = Window.partitionBy("season", "anchor").orderBy("period_ix").rowsBetween(Window.unboundedPreceding, 0)
    return P.withColumn("mean_p", F.avg("p").over(upto))


def fc_glide(P: DataFrame, lambdas: Sequence[float] = (GLIDE_LAMBDA,)) -> DataFrame:
    """Blend of the last distribution and the season's running mean, renormalised."""
    column = _candidates("glide", [(v,) for v in lambdas], ["lam"], lambda v: f"glide({_text(v)})")
    df = _with_candidates(running_mean(P), column, ["lam"])
    df = df.withColumn("_b", (1 - F.col("lam")) * F.col("p") + F.col("lam") * F.col("mean_p"))
    return _result(df.withColumn("p_hat", F.col("_b") / F.sum("_b").over(_cell())))


def _filtered(P: DataFrame, ref: int, family: str, params: Sequence[tuple], label: Callable, levels: Callable) -> DataFrame:
    """Forecasts of every candidate by a filter over log ratios to the ``ref`` anchor.

    ``levels(y, *params)`` maps the periods-by-anchors matrix to the level after
    each period; a softmax takes it back to shares. One matrix per season, whose size
    is that of the calendar times the codebook, and one pass over its periods.
    """
    labels = [label(*p) for p in params]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        wide = pdf.pivot(index="period_ix", columns="anchor", values="p").sort_index()
        shares = wide.to_numpy(dtype=float)
        logs = np.log(shares)
        y = logs - logs[:, [wide.columns.get_loc(ref)]]
        periods, anchors = shares.shape
        parts = []
        for i, p in enumerate(params):
            state = levels(y, *p)
            weight = np.exp(state - state.max(axis=1, keepdims=True))
            parts.append(
                pd.DataFrame(
                    {
                        "season": pdf["season"].iloc[0],
                        "period_ix": np.repeat(wide.index.to_numpy(), anchors),
                        "anchor": np.tile(wide.columns.to_numpy(), periods),
                        "p": shares.ravel(),
                        "family": family,
                        "cand_ix": i,
                        "label": labels[i],
                        "p_hat": (weight / weight.sum(axis=1, keepdims=True)).ravel(),
                    }
                )
            )
        return pd.concat(parts)

    kind = P.schema["season"].dataType.simpleString()
    schema = f"season {kind}, period_ix int, anchor int, p double, family string, cand_ix int, label string, p_hat double"
    return _result(P.select("season", "period_ix", "anchor", "p").groupBy("season").applyInPandas(run, schema))


def _steady_levels(y: np.ndarray, q: float) -> np.ndarray:
    """Observation noise 1, state noise q: the gains depend on the step alone."""
    out = y.copy()
    doubt = 1.0
    for t in range(1, len(y)):
        doubt = 1.0 - 1.0 / (1.0 + doubt + q)  # the gain, which is also the doubt left after the step
        out[t] = doubt * y[t] + (1.0 - doubt) * out[t - 1]
    return out


def _churn_levels(y: np.ndarray, q: float, memory: float) -> np.ndarray:
    """State noise q times a running churn, the mean squared surprise of all anchors but the reference."""
    out = y.copy()
    doubt = churn = 1.0
    for t in range(1, len(y)):
        doubt = 1.0 - 1.0 / (1.0 + doubt + q * churn)
        surprise = y[t] - out[t - 1]
        out[t] = out[t - 1] + doubt * surprise
        churn += (1.0 - memory) * (float(surprise @ surprise) / (y.shape[1] - 1) - churn)
    return out


def fc_local_level(P: DataFrame, ref: int, qs: Sequence[float] = (1.0,)) -> DataFrame:
    """Local level per anchor in log-ratio space."""
    name = lambda q: f"local_level({_text(q)})"
    return _filtered(P, ref, "local_level", [(q,) for q in qs], name, _steady_levels)


def fc_stoch_vol(P: DataFrame, ref: int, params: Sequence[tuple[float, float]] = ((1.0, 0.5),)) -> DataFrame:
    """Local level whose state noise follows the churn shared by all anchors."""
    name = lambda q, g: f"stoch_vol({_text(q)},{_text(g)})"
    return _filtered(P, ref, "shared_churn", list(params), name, _churn_levels)


def fc_combination(base: DataFrame, weights: Sequence[float] = (0.5,)) -> DataFrame:
    """Mix of the last distribution and any base forecast, renormalised."""
    n = len(weights)
    mixes = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(float(w)).alias("w"), F.lit(_text(w)).alias("t")) for i, w in enumerate(weights)])
    df = base.withColumn("_m", F.explode(mixes))
    df = df.select(
        "season",
        "period_ix",
        "anchor",
        "p",
        F.lit("combination").alias("family"),
        (F.col("cand_ix") * n + F.col("_m.i")).alias("cand_ix"),
        F.concat(F.lit("combo("), F.col("_m.t"), F.lit(","), F.col("label"), F.lit(")")).alias("label"),
        ((1 - F.col("_m.w")) * F.col("p") + F.col("_m.w") * F.col("p_hat")).alias("_b"),
    )
    return _result(df.withColumn("p_hat", F.col("_b") / F.sum("_b").over(_cell())))


def fc_decayed_persistence(
    rows: DataFrame, size: int, decay: float = 1.0, smoothing: float = 1.0, query_ix: Column | None = None, keys: Sequence[str] = ("season",)
) -> DataFrame:
    """Recency-weighted anchor mass: exp(decay * weeks ago), smoothed, with its log.

    Rows are (season, period_ix, anchor); the query is one past the season's
    last period unless ``query_ix`` says otherwise. Counts are summed per
    (season, period, anchor) first, so weights apply to a small frame.
    """
    from fieldshift.operators.dists import histogram_arrays

    counts = rows.groupBy(*keys, "period_ix", "anchor").agg(F.count(F.lit(1)).alias("_n"))
    if query_ix is None:
        query_ix = F.max("period_ix").over(Window.partitionBy(*keys)) + 1
    counts = counts.withColumn("_q", query_ix)
    recency = F.exp(F.lit(float(decay)) * (F.col("period_ix") - F.col("_q")).cast("double")) * F.col("_n")
    arrays = histogram_arrays(counts, size, keys, smoothing, recency)
    flat = arrays.select(*keys, F.posexplode("dist").alias("anchor", "p"))
    return flat.withColumn("log_p", F.log("p"))


def fc_discounted(P: DataFrame, counts: DataFrame, params: Sequence[tuple[float, float]] = DISCOUNTS) -> DataFrame:
    """Decayed persistence of every (decay, smoothing) pair at every origin.

    ``counts`` is (season, period, anchor, weight). One scan over a season's
    periods carries the exponentially discounted sums of all decays, m <- (m + w)
    exp(-decay); smoothing is added where a forecast is read off.
    """
    masses = counts.groupBy("season", "period", "anchor").agg(F.sum("weight").alias("w"))
    ready = P.join(masses, ["season", "period", "anchor"], "left").withColumn("w", F.coalesce("w", F.lit(0.0)))
    decays = sorted({d for d, _ in params})
    labels = [f"discounted({_text(d)},{_text(s)})" for d, s in params]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        wide = pdf.pivot(index="period_ix", columns="anchor", values=["p", "w"]).sort_index()
        shares, weights = wide["p"].to_numpy(dtype=float), wide["w"].to_numpy(dtype=float)
        periods, anchors = shares.shape
        fade = np.exp(-np.array(decays))[:, None]
        carried, states = np.zeros((len(decays), anchors)), np.empty((len(decays), periods, anchors))
        for t in range(periods):
            carried = (carried + weights[t]) * fade
            states[:, t] = carried
        parts = []
        for i, (decay, smoothing) in enumerate(params):
            mass = states[decays.index(decay)] + smoothing
            parts.append(
                pd.DataFrame(
                    {
                        "season": pdf["season"].iloc[0],
                        "period_ix": np.repeat(wide.index.to_numpy(), anchors),
                        "anchor": np.tile(wide["p"].columns.to_numpy(), periods),
                        "p": shares.ravel(),
                        "family": "discounted",
                        "cand_ix": i,
                        "label": labels[i],
                        "p_hat": (mass / mass.sum(axis=1, keepdims=True)).ravel(),
                    }
                )
            )
        return pd.concat(parts)

    kind = P.schema["season"].dataType.simpleString()
    schema = f"season {kind}, period_ix int, anchor int, p double, family string, cand_ix int, label string, p_hat double"
    return _result(ready.select("season", "period_ix", "anchor", "p", "w").groupBy("season").applyInPandas(run, schema))


# --- forecasters of the user ---


@dataclass(frozen=True)
class Forecaster:
    """A family of candidates: ``fn(history[W, K], *params) -> next[K]`` for every tuple of ``params``."""

    family: str
    fn: Callable[..., np.ndarray]
    params: tuple[tuple, ...] = ((),)
    min_history: int = 1

    def label(self, params: tuple) -> str:
        return f"{self.family}({','.join(_text(x) for x in params)})" if params else self.family


class Forecasters:
    """Registry of a user's forecasters, to be raced beside the built-in ones (``evaluate.all_candidates``)."""

    BUILT_IN = frozenset(("persistence", "local_level", "shared_churn", "glide", "combination", "discounted"))

    def __init__(self) -> None:
        self._held: dict[str, Forecaster] = {}

    def add(self, family: str, fn: Callable[..., np.ndarray], params: Sequence[tuple] = ((),), min_history: int = 1) -> Forecasters:
        if family in self._held or family in self.BUILT_IN:
            raise ValueError(f"the family {family} is taken")
        self._held[family] = Forecaster(family, fn, tuple(tuple(p) for p in params), min_history)
        return self

    def __iter__(self):
        return iter(self._held.values())

    def __len__(self) -> int:
        return len(self._held)


def fc_custom(P: DataFrame, forecasters: Iterable[Forecaster]) -> DataFrame:
    """Forecasts of every candidate of these forecasters at every origin with enough history, one pass over a season for all.

    A season is a periods-by-anchors matrix, bounded by the calendar and the
    codebook, so one group is small however many rosters stand behind it. A
    forecast of another length than the anchors raises.
    """
    held = tuple(forecasters)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        wide = pdf.pivot(index="period_ix", columns="anchor", values="p").sort_index()
        history = wide.to_numpy(dtype=float).copy()
        history.flags.writeable = False  # fn sees views, not copies
        parts = [pdf.head(0).assign(family="", cand_ix=0, label="", p_hat=0.0)]
        for one in held:
            for cand_ix, params in enumerate(one.params):
                for i in range(one.min_history - 1, len(history)):
                    guess = np.asarray(one.fn(history[: i + 1], *params), dtype=float)
                    if guess.shape != (history.shape[1],):
                        raise ValueError(f"{one.family} forecast {guess.shape} for {history.shape[1]} anchors")
                    parts.append(
                        pd.DataFrame(
                            {
                                "season": pdf["season"].iloc[0],
                                "period_ix": wide.index[i],
                                "anchor": wide.columns.to_numpy(),
                                "p": history[i],
                                "family": one.family,
                                "cand_ix": cand_ix,
                                "label": one.label(params),
                                "p_hat": guess,
                            }
                        )
                    )
        return pd.concat(parts)

    kind = P.schema["season"].dataType.simpleString()
    schema = f"season {kind}, period_ix int, anchor int, p double, family string, cand_ix int, label string, p_hat double"
    return _result(P.select("season", "period_ix", "anchor", "p").groupBy("season").applyInPandas(run, schema))


def custom_forecaster(
    P: DataFrame, fn: Callable[[np.ndarray], np.ndarray], label: str = "custom", family: str = "custom", min_history: int = 1
) -> DataFrame:
    """``fn(history[W, K]) -> next[K]`` at every origin of every season."""
    return fc_custom(P, [Forecaster(family, fn, ((),), min_history)]).withColumn("label", F.lit(label))


def ensemble_uncertainty(
    recent: DataFrame,
    mapping: DataFrame,
    size: int,
    replicates: int = 5,
    per_period: int = 200,
    decay: float = 1.0,
    smoothing: float = 1.0,
    seed: int = 0,
    key: str = "row_id",
) -> DataFrame:
    """Mean and spread of unit shares over seeded resamples of the recent rows.

    ``recent`` is (row_id, season, period_ix, anchor). Every replicate draws at
    most ``per_period`` rows per period and forecasts by decayed persistence.
    """
    from fieldshift.operators.dists import unit_distribution

    copies = recent.withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))))
    drawn = lowest_draws(copies, ["season", "replicate", "period_ix"], draw(seed, F.col(key), F.col("replicate")), key, per_period)
    dist = fc_decayed_persistence(drawn, size, decay, smoothing, keys=("season", "replicate"))
    shares = unit_distribution(dist, mapping, ("season", "replicate"))
    return shares.groupBy("season", "unit").agg(
        F.avg("share").alias("predicted"), F.stddev_pop("share").alias("uncertainty")
    )
