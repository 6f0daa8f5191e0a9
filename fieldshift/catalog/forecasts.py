"""Forecasters, their evaluation and the choice among them."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from fieldshift.catalog import roles
from fieldshift.catalog.registry import query, rounded
from fieldshift.catalog.sqlbook import MEDIANS
from fieldshift.operators import evaluate, forecast
from fieldshift.operators.dists import weekly_anchor_matrix
from fieldshift.operators.seasons import recent_slice, with_period_index
from fieldshift.session import stage


def _p_and_ref(spark, sf, with_counts=False):
    """Weekly matrix (staged: the forecasters read it several times) and the log-ratio reference."""
    frozen = roles.space(spark, sf)
    counts = stage(
        roles.features(spark, sf, frozen)
        .groupBy("season", "period", "anchor")
        .agg(F.sum("weight").alias("weight"), F.count(F.lit(1)).alias("rows")),
        "anchor-counts",
    )
    P = stage(weekly_anchor_matrix(counts, frozen.size), "weekly-p")
    # the most common anchor by rows, from the counts
    ref = (
        counts.groupBy("anchor").agg(F.sum("rows").alias("n")).orderBy(F.col("n").desc(), "anchor").first()["anchor"]
    )
    sizes = counts.groupBy("season", "period").agg(F.sum("rows").alias("n"))
    sizes = sizes.join(P.select("season", "period", "period_ix").distinct(), ["season", "period"])
    out = frozen, P, ref, sizes.select("season", "period_ix", "n")
    return (*out, counts) if with_counts else out


def _P(spark, sf):
    return roles.weekly_p(spark, sf, roles.space(spark, sf))


def _out(df):
    return rounded(df.select("season", "period_ix", "anchor", "label", "p_hat"), "p_hat")


@query("fc_persistence", "SELECT season, period_ix, anchor, 'persistence' AS label, rnd(p) AS p_hat FROM pm", "pm")
def fc_persistence(spark, sf):
    return _out(forecast.fc_persistence(_P(spark, sf)))


@query(
    "running_mean",
    """SELECT season, period_ix, anchor, rnd(m) AS mean_p FROM (SELECT season, period_ix, anchor, avg(p) OVER (
    PARTITION BY season, anchor ORDER BY period_ix ROWS UNBOUNDED PRECEDING) AS m FROM pm) q""",
    "pm",
)
def running_mean(spark, sf):
    out = forecast.running_mean(_P(spark, sf)).select("season", "period_ix", "anchor", "mean_p")
    return rounded(out, "mean_p")


@query(
    "fc_glide",
    "SELECT season, period_ix, anchor, 'glide(' || CASE lam WHEN 0.0 THEN '0' ELSE CAST(lam AS VARCHAR) END || ')' AS label, rnd(p_hat) AS p_hat FROM glide",
    "glide",
)
def fc_glide(spark, sf):
    return _out(forecast.fc_glide(_P(spark, sf), forecast.GLIDE_LAMBDAS))


LABEL_Q = "CASE WHEN q >= 1 THEN CAST(CAST(q AS INTEGER) AS VARCHAR) ELSE CAST(q AS VARCHAR) END"


@query(
    "fc_local_level",
    f"SELECT season, period_ix, anchor, 'local_level(' || {LABEL_Q} || ')' AS label, rnd(p_hat) AS p_hat FROM level",
    "level",
)
def fc_local_level(spark, sf):
    _, P, ref, _ = _p_and_ref(spark, sf)
    return _out(forecast.fc_local_level(P, ref, forecast.LEVEL_Q))


@query(
    "fc_stoch_vol",
    f"SELECT season, period_ix, anchor, 'stoch_vol(' || {LABEL_Q} || ',' || CAST(g AS VARCHAR) || ')' AS label, rnd(p_hat) AS p_hat FROM vol",
    "vol",
)
def fc_stoch_vol(spark, sf):
    _, P, ref, _ = _p_and_ref(spark, sf)
    return _out(forecast.fc_stoch_vol(P, ref, forecast.VOL_PARAMS))


@query(
    "fc_combination",
    """SELECT season, period_ix, anchor, cand_ix, rnd(p_hat) AS p_hat FROM cands WHERE family = 'combination'""",
    "cands",
)
def fc_combination(spark, sf):
    _, P, ref, _ = _p_and_ref(spark, sf)
    out = forecast.fc_combination(forecast.fc_local_level(P, ref, (0.2, 0.5, 1.0)), (0.25, 0.5, 0.75))
    return rounded(out.select("season", "period_ix", "anchor", "cand_ix", "p_hat"), "p_hat")


@query(
    "fc_decayed_persistence",
    """WITH x AS (SELECT season, period_ix, anchor, max(period_ix) OVER (PARTITION BY season) + 1 AS q FROM feats JOIN cal USING (season, period)),
    w AS (SELECT season, anchor, sum(exp(0.7::DOUBLE * (period_ix - q))) AS w FROM x GROUP BY season, anchor),
    h AS (SELECT season, anchor, (coalesce(w, 0) + 1) / sum(coalesce(w, 0) + 1) OVER (PARTITION BY season) AS p
    FROM (SELECT DISTINCT season FROM cal) s CROSS JOIN dom LEFT JOIN w USING (season, anchor)), l AS (SELECT *, ln(p) AS lp FROM h)
    SELECT season, anchor, rnd(p) AS p, rnd(lp) AS log_p FROM l""",
    "feats cal dom",
)
def fc_decayed_persistence(spark, sf):
    frozen = roles.space(spark, sf)
    rows = with_period_index(roles.features(spark, sf, frozen).select("season", "period", "anchor"))
    return rounded(forecast.fc_decayed_persistence(rows, frozen.size, decay=0.7), "p", "log_p")


@query(
    "forecast_points",
    """SELECT a.season, a.period_ix, a.anchor, rnd(a.p) AS p, rnd(b.p) AS actual FROM pm a JOIN pm b
    ON b.season = a.season AND b.anchor = a.anchor AND b.period_ix = a.period_ix + 1""",
    "pm",
)
def forecast_points(spark, sf):
    out = evaluate.forecast_points(_P(spark, sf)).select("season", "period_ix", "anchor", "p", "actual")
    return rounded(out, "p", "actual")


def _scores(spark, sf):
    frozen, P, ref, sizes = _p_and_ref(spark, sf)
    forecasts = evaluate.all_candidates(P, ref)
    return frozen, forecasts, stage(evaluate.score_candidates(forecasts), "scores"), sizes


LABELS = """lb AS (SELECT 'persistence' AS family, 0 AS cand_ix, 'persistence' AS label
    UNION ALL SELECT 'glide', i - 1, 'glide(' || x || ')' FROM (SELECT generate_subscripts(a, 1) AS i, unnest(a) AS x FROM (SELECT ['0', '0.1', '0.2', '0.3', '0.5', '0.8'] AS a))
    UNION ALL SELECT 'local_level', i - 1, 'local_level(' || x || ')' FROM (SELECT generate_subscripts(a, 1) AS i, unnest(a) AS x FROM (SELECT ['0.05', '0.1', '0.2', '0.5', '1', '2', '5'] AS a))
    UNION ALL SELECT 'shared_churn', (i - 1) * 2 + j - 1, 'stoch_vol(' || x || ',' || ['0.5', '0.8'][j] || ')' FROM (SELECT generate_subscripts(a, 1) AS i, unnest(a) AS x
      FROM (SELECT ['0.1', '0.5', '1', '2'] AS a)), range(1, 3) t(j)
    UNION ALL SELECT 'combination', (i - 1) * 3 + j - 1, 'combo(' || ['0.25', '0.5', '0.75'][j] || ',local_level(' || x || '))' FROM (SELECT generate_subscripts(a, 1) AS i, unnest(a) AS x
      FROM (SELECT ['0.2', '0.5', '1'] AS a)), range(1, 4) t(j))"""


@query(
    "score_candidates",
    "WITH " + LABELS + " SELECT family, cand_ix, label, season, period_ix, rnd(kl) AS kl FROM scores JOIN lb USING (family, cand_ix)",
    "scores",
)
def score_candidates(spark, sf):
    _, P, ref, _ = _p_and_ref(spark, sf)
    scores = evaluate.score_candidates(evaluate.all_candidates(P, ref))
    return rounded(scores, "kl")


@query(
    "loro_select",
    "WITH " + LABELS + " SELECT family, season, cand_ix, label, rnd(train_kl) AS train_kl FROM chosen JOIN lb USING (family, cand_ix)",
    "chosen",
)
def loro_select(spark, sf):
    _, _, scores, _ = _scores(spark, sf)
    return rounded(evaluate.loro_select(scores), "train_kl")


@query(
    "horse_race",
    "WITH "
    + LABELS
    + """, n AS (SELECT family, label, count(*) AS n FROM chosen JOIN lb USING (family, cand_ix) WHERE family <> 'persistence' GROUP BY ALL),
    u AS (SELECT family, arg_min(label, (-n, label)) AS selected FROM n GROUP BY family)
    SELECT family, rnd(mean_kl) AS mean_kl, rnd(beats_pct) AS beats_pct, coalesce(selected, '-') AS selected FROM race LEFT JOIN u USING (family)""",
    "race chosen",
)
def horse_race(spark, sf):
    _, _, scores, _ = _scores(spark, sf)
    return rounded(evaluate.horse_race(scores), "mean_kl", "beats_pct")


@query(
    "best_next_forecast",
    """WITH win AS (SELECT family FROM race ORDER BY mean_kl, family LIMIT 1), b AS (SELECT family, cand_ix FROM scores JOIN win USING (family)
    WHERE family <> 'persistence' GROUP BY ALL ORDER BY avg(kl), cand_ix LIMIT 1),
    f AS (SELECT c.anchor, c.p, c.p_hat FROM cands c JOIN b USING (family, cand_ix) WHERE c.season = (SELECT arg_max(season, period) FROM pm)
    AND c.period_ix = (SELECT max(period_ix) FROM pm WHERE season = (SELECT arg_max(season, period) FROM pm))),
    s AS (SELECT unit, sum(p) / sum(sum(p)) OVER () AS c, sum(p_hat) / sum(sum(p_hat)) OVER () AS n FROM f JOIN mp USING (anchor) GROUP BY unit),
    t AS (SELECT *, n - c AS d FROM s)
    SELECT unit, rnd(c) AS current_share, rnd(n) AS predicted_share, rnd(d) AS delta FROM t""",
    "race scores cands mp pm",
)
def best_next_forecast(spark, sf):
    frozen, forecasts, scores, _ = _scores(spark, sf)
    latest = roles.latest_season(roles.seasoned(spark, sf))
    out = evaluate.best_next_forecast(forecasts, scores, latest, frozen.mapping()).drop("pct_change")
    return rounded(out, "current_share", "predicted_share", "delta")


AGAINST = """WITH z AS (SELECT f.season, f.period_ix, f.kl AS km, b.kl AS kb FROM scores f JOIN scores b ON b.family = 'persistence'
    AND b.season = f.season AND b.period_ix = f.period_ix WHERE f.family = 'glide' AND f.cand_ix = 3)"""


@query(
    "backtest_rolling",
    AGAINST
    + """, r AS (SELECT *, row_number() OVER (PARTITION BY season ORDER BY period_ix DESC) AS r FROM z),
    n AS (SELECT season, period_ix, count(*) AS n FROM feats JOIN cal USING (season, period) GROUP BY ALL)
    SELECT r.season, CAST(r.period_ix + 1 AS INTEGER) AS period_ix, rnd(km) AS kl_model, rnd(kb) AS kl_persistence,
    km < kb - 1e-9 AS model_beats_persistence, n FROM r JOIN n ON n.season = r.season AND n.period_ix = r.period_ix + 1 WHERE r <= 2""",
    "scores feats cal",
)
def backtest_rolling(spark, sf):
    _, _, scores, sizes = _scores(spark, sf)
    return rounded(evaluate.backtest_rolling(scores, sizes, "glide(0.3)"), "kl_model", "kl_persistence")


@query(
    "backtest_season_out",
    AGAINST
    + """, r AS (SELECT *, row_number() OVER (PARTITION BY season ORDER BY period_ix DESC) AS r FROM z),
    n AS (SELECT season, count(*) AS n FROM feats GROUP BY ALL)
    SELECT season, rnd(km) AS kl_model, rnd(kb) AS kl_persistence, km < kb - 1e-9 AS model_beats_persistence, n
    FROM r JOIN n USING (season) WHERE r = 1""",
    "scores feats",
)
def backtest_season_out(spark, sf):
    _, _, scores, sizes = _scores(spark, sf)
    return rounded(evaluate.backtest_season_out(scores, sizes, "glide(0.3)"), "kl_model", "kl_persistence")


# --- a user's forecaster beside the built-in ones ---


def _recent_median(history, window):
    middle = np.median(history[-window:], axis=0)
    return middle / middle.sum()


def _scores_with_median(spark, sf):
    _, P, ref, sizes = _p_and_ref(spark, sf)
    custom = forecast.Forecasters().add("median", _recent_median, [(w,) for w in MEDIANS])
    return stage(evaluate.score_candidates(evaluate.all_candidates(P, ref, custom=custom)), "scores"), sizes


@query(
    "horse_race_custom",
    "WITH "
    + LABELS
    + """, lc AS (SELECT * FROM lb UNION ALL SELECT 'median', i - 1, 'median(' || x || ')' FROM (SELECT generate_subscripts(a, 1) AS i, unnest(a) AS x FROM (SELECT ['2', '3', '5'] AS a))),
    n AS (SELECT family, label, count(*) AS n FROM chosen_m JOIN lc USING (family, cand_ix) WHERE family <> 'persistence' GROUP BY ALL),
    u AS (SELECT family, arg_min(label, (-n, label)) AS selected FROM n GROUP BY family)
    SELECT family, rnd(mean_kl) AS mean_kl, rnd(beats_pct) AS beats_pct, coalesce(selected, '-') AS selected FROM race_m LEFT JOIN u USING (family)""",
    "race_m chosen_m",
)
def horse_race_custom(spark, sf):
    scores, _ = _scores_with_median(spark, sf)
    return rounded(evaluate.horse_race(scores), "mean_kl", "beats_pct")


AGAINST_MEDIAN = AGAINST.replace("scores", "scores_m").replace("'glide' AND f.cand_ix = 3", "'median' AND f.cand_ix = 1")


@query(
    "backtest_rolling_custom",
    AGAINST_MEDIAN
    + """, r AS (SELECT *, row_number() OVER (PARTITION BY season ORDER BY period_ix DESC) AS r FROM z),
    n AS (SELECT season, period_ix, count(*) AS n FROM feats JOIN cal USING (season, period) GROUP BY ALL)
    SELECT r.season, CAST(r.period_ix + 1 AS INTEGER) AS period_ix, rnd(km) AS kl_model, rnd(kb) AS kl_persistence,
    km < kb - 1e-9 AS model_beats_persistence, n FROM r JOIN n ON n.season = r.season AND n.period_ix = r.period_ix + 1 WHERE r <= 2""",
    "scores_m feats cal",
)
def backtest_rolling_custom(spark, sf):
    scores, sizes = _scores_with_median(spark, sf)
    return rounded(evaluate.backtest_rolling(scores, sizes, "median(3)"), "kl_model", "kl_persistence")


@query(
    "backtest_season_out_custom",
    AGAINST_MEDIAN
    + """, r AS (SELECT *, row_number() OVER (PARTITION BY season ORDER BY period_ix DESC) AS r FROM z),
    n AS (SELECT season, count(*) AS n FROM feats GROUP BY ALL)
    SELECT season, rnd(km) AS kl_model, rnd(kb) AS kl_persistence, km < kb - 1e-9 AS model_beats_persistence, n
    FROM r JOIN n USING (season) WHERE r = 1""",
    "scores_m feats",
)
def backtest_season_out_custom(spark, sf):
    scores, sizes = _scores_with_median(spark, sf)
    return rounded(evaluate.backtest_season_out(scores, sizes, "median(3)"), "kl_model", "kl_persistence")


SWEEP = """WITH big AS (SELECT season FROM feats GROUP BY season ORDER BY count(*) DESC, season LIMIT 5),
    f AS (SELECT s.* FROM scores s JOIN big USING (season) JOIN (SELECT season, max(period_ix) AS period_ix FROM scores GROUP BY season) e
    USING (season, period_ix)),
    r AS (SELECT f.family, f.cand_ix, f.kl AS km, b.kl AS kb FROM f JOIN f b ON b.family = 'persistence' AND b.season = f.season
    WHERE f.family <> 'persistence'),
    t AS (SELECT family, cand_ix, avg(km) AS a, avg(kb) AS b, avg(km - kb) AS c, count(*) FILTER (WHERE km - kb < -1e-9) AS beats,
    count(*) AS folds FROM r GROUP BY ALL)"""


@query(
    "parameter_sweep",
    SWEEP.replace("scores", "scores_d")
    + """ SELECT family, cand_ix, rnd(a) AS mean_kl_model, rnd(b) AS mean_kl_persist, rnd(c) AS mean_margin, beats, folds FROM t""",
    "scores_d feats",
)
def parameter_sweep(spark, sf):
    """The forecaster grids of the race, and decay and smoothing of discounted sums."""
    _, P, ref, sizes, counts = _p_and_ref(spark, sf, True)
    forecasts = evaluate.all_candidates(P, ref).unionByName(forecast.fc_discounted(P, counts))
    scores = stage(evaluate.score_candidates(forecasts), "scores")
    out = evaluate.parameter_sweep(scores, sizes, 5).drop("label")
    return rounded(out, "mean_kl_model", "mean_kl_persist", "mean_margin")


@query(
    "sweep_summary",
    """WITH r AS (SELECT f.family, f.kl AS km, b.kl AS kb FROM scores f JOIN scores b ON b.family = 'persistence' AND b.season = f.season
    AND b.period_ix = f.period_ix WHERE f.family <> 'persistence'), t AS (SELECT family, avg(km) AS a, avg(kb) AS b, avg(km - kb) AS c,
    count(*) FILTER (WHERE km - kb < -1e-9) AS beats, count(*) AS folds FROM r GROUP BY family)
    SELECT family, rnd(a) AS mean_kl_model, rnd(b) AS mean_kl_persist, rnd(c) AS mean_margin, beats, folds FROM t""",
    "scores",
)
def sweep_summary(spark, sf):
    _, _, scores, _ = _scores(spark, sf)
    bar = scores.where(F.col("family") == "persistence").select("season", "period_ix", F.col("kl").alias("kl_persistence"))
    runs = scores.where(F.col("family") != "persistence").withColumnRenamed("kl", "kl_model").join(bar, ["season", "period_ix"])
    out = evaluate.sweep_summary(runs, ["family"])
    return rounded(out, "mean_kl_model", "mean_kl_persist", "mean_margin")


@query(
    "ensemble_uncertainty",
    """WITH x AS (SELECT roster_id, season, anchor, period_ix - greatest(max(period_ix) OVER (PARTITION BY season) - 3, 0) AS pix
    FROM feats JOIN cal USING (season, period)),
    k AS (SELECT *, row_number() OVER (PARTITION BY season, r, pix ORDER BY md5(roster_id || '|' || r || '|0'), roster_id) AS o
    FROM (SELECT * FROM x WHERE pix >= 0) y CROSS JOIN (SELECT unnest(range(5)) AS r) z),
    d AS (SELECT season, r, anchor, pix, max(pix) OVER (PARTITION BY season, r) + 1 AS q FROM k WHERE o <= 15),
    w AS (SELECT season, r, anchor, sum(exp(pix - q)) AS w FROM d GROUP BY ALL),
    h AS (SELECT season, r, anchor, (coalesce(w, 0) + 1) / sum(coalesce(w, 0) + 1) OVER (PARTITION BY season, r) AS p
    FROM (SELECT DISTINCT season, r FROM w) s CROSS JOIN dom LEFT JOIN w USING (season, r, anchor)),
    u AS (SELECT season, r, unit, sum(p) / sum(sum(p)) OVER (PARTITION BY season, r) AS share FROM h JOIN mp USING (anchor) GROUP BY season, r, unit),
    t AS (SELECT season, unit, avg(share) AS a, stddev_pop(share) AS s FROM u GROUP BY ALL)
    SELECT season, unit, rnd(a) AS predicted, rnd(s) AS uncertainty FROM t""",
    "feats cal dom mp",
)
def ensemble_uncertainty(spark, sf):
    frozen = roles.space(spark, sf)
    rows = with_period_index(
        roles.features(spark, sf, frozen).select(F.col("roster_id").alias("row_id"), "season", "period", "anchor")
    )
    recent = recent_slice(rows, 4, 0)
    out = forecast.ensemble_uncertainty(recent, frozen.mapping(), frozen.size, replicates=5, per_period=15)
    return rounded(out, "predicted", "uncertainty")


@query(
    "custom_forecaster",
    """SELECT season, period_ix, anchor, rnd(x) AS p_hat FROM (SELECT *, m / sum(m) OVER (PARTITION BY season, period_ix) AS x FROM (
    SELECT season, period_ix, anchor, median(p) OVER (PARTITION BY season, anchor ORDER BY period_ix
    ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS m FROM pm) q) r""",
    "pm",
)
def custom_forecaster(spark, sf):
    def recent_median(history):
        middle = np.median(history[-3:], axis=0)
        return middle / middle.sum()

    out = forecast.custom_forecaster(_P(spark, sf), recent_median, "median")
    return rounded(out.select("season", "period_ix", "anchor", "p_hat"), "p_hat")
