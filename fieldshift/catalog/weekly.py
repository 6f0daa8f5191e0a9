"""Panels, lags, regressions and calendars."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldshift.catalog import roles
from fieldshift.catalog.registry import query, r6, rounded
from fieldshift.operators import panels, seasons, stats
from fieldshift.operators.extract import full_rosters
from fieldshift.sources.tables import read_panel, write_panel
from fieldshift.session import fresh_path


def _frame(spark, sf):
    return roles.with_period(roles.roster(spark, sf))


def _panel(spark, sf):
    return panels.unit_panel(_frame(spark, sf))


@query(
    "iso_week_label",
    "SELECT roster_id, strftime(ts, '%G-W%V') AS period, CAST(epoch(ts) AS BIGINT) AS ts FROM roster",
    "roster",
)
def iso_week_label(spark, sf):
    from fieldshift.functions.periods import iso_period_of_epoch

    epochs = roles.roster(spark, sf).select("roster_id", F.unix_timestamp("ts").alias("ts"))
    return epochs.select("roster_id", iso_period_of_epoch(F.col("ts")).alias("period"), "ts")


@query(
    "base_frame",
    """SELECT roster_id, period, CAST(epoch(ts) AS BIGINT) AS ts, unit, won, weight, source, elements FROM roster JOIN (
    SELECT roster_id, string_agg(species, ',' ORDER BY slot) AS elements FROM member GROUP BY roster_id) m USING (roster_id)""",
    "roster member",
)
def base_frame(spark, sf):
    frame = panels.base_frame(roles.roster_with_members(spark, sf))
    return frame.withColumn("elements", F.array_join("elements", ","))


@query("full_rosters", "SELECT roster_id, n_members FROM sized WHERE n_members = 6", "sized")
def full(spark, sf):
    kept = full_rosters(roles.member_lists(spark, sf))
    return kept.select("roster_id", F.size("members").cast("long").alias("n_members"))


@query(
    "unit_panel",
    "SELECT period, unit, n, rnd(weight) AS weight, rnd(share) AS share, rnd(win_rate) AS win_rate FROM panel",
    "panel",
)
def unit_panel(spark, sf):
    return rounded(_panel(spark, sf), "weight", "share", "win_rate")


@query(
    "element_panel",
    """SELECT period, element, n, rnd(weight) AS weight, rnd(usage) AS usage, rnd(win_rate) AS win_rate FROM (
    SELECT period, element, count(*) AS n, sum(weight) AS weight, sum(weight) / any_value(t) AS usage,
    sum(CASE WHEN won THEN weight WHEN NOT won THEN 0 END) / nullif(sum(CASE WHEN won IS NOT NULL THEN weight END), 0) AS win_rate
    FROM (SELECT DISTINCT roster_id, species AS element FROM member) m JOIN roster USING (roster_id)
    JOIN (SELECT period, sum(weight) AS t FROM roster WHERE roster_id IN (SELECT roster_id FROM member) GROUP BY period) p
    USING (period) GROUP BY period, element) q""",
    "roster member",
)
def element_panel(spark, sf):
    frame = panels.base_frame(roles.roster_with_members(spark, sf))
    return rounded(panels.element_panel(frame), "weight", "usage", "win_rate")


@query(
    "weighted_win_rate",
    """SELECT source, unit, rnd(w) AS win_rate FROM (SELECT source, unit,
    sum(CASE WHEN won THEN weight WHEN NOT won THEN 0 END) / nullif(sum(CASE WHEN won IS NOT NULL THEN weight END), 0) AS w
    FROM roster GROUP BY ALL) q""",
    "roster",
)
def weighted_win_rate(spark, sf):
    return roles.roster(spark, sf).groupBy("source", "unit").agg(r6(panels.win_rate()).alias("win_rate"))


@query(
    "period_entropy",
    """SELECT period, rnd(h) AS entropy_bits, n_units FROM (SELECT period, -sum(share * log2(share)) AS h, count(*) AS n_units
    FROM panel GROUP BY period) q""",
    "panel",
)
def period_entropy(spark, sf):
    return rounded(panels.period_entropy(_panel(spark, sf)), "entropy_bits")


CENTROIDS = """WITH c AS (SELECT period, i, avg(z) AS m FROM roster JOIN sv USING (vec_id) GROUP BY period, i),
    o AS (SELECT period, lag(period) OVER (ORDER BY period) AS prev_period FROM (SELECT DISTINCT period FROM roster) q)"""


@query(
    "centroid_drift",
    CENTROIDS
    + """ SELECT period, prev_period, rnd(d) AS centroid_drift FROM (SELECT o.period, o.prev_period,
    sqrt(sum((a.m - b.m) ** 2)) AS d FROM o JOIN c a ON a.period = o.period JOIN c b ON b.period = o.prev_period AND a.i = b.i
    GROUP BY ALL) q""",
    "roster sv",
)
def centroid_drift(spark, sf):
    frame = roles.with_period(roles.roster_vectors(spark, sf, roles.space(spark, sf)))
    return rounded(panels.centroid_drift(frame), "centroid_drift")


@query(
    "period_novelty",
    CENTROIDS
    + """ SELECT period, prev_period, rnd(v) AS novelty FROM (SELECT period, prev_period, avg(d) AS v FROM (
    SELECT r.roster_id, r.period, o.prev_period, sqrt(sum((s.z - c.m) ** 2)) AS d FROM roster r JOIN o ON o.period = r.period
    JOIN sv s ON s.vec_id = r.vec_id JOIN c ON c.period = o.prev_period AND c.i = s.i GROUP BY ALL) q GROUP BY ALL) z""",
    "roster sv",
)
def period_novelty(spark, sf):
    frame = roles.with_period(roles.roster_vectors(spark, sf, roles.space(spark, sf)))
    return rounded(panels.period_novelty(frame), "novelty")


@query(
    "attach_period_weight",
    "SELECT roster_id, period, weight, rnd(t) AS period_weight FROM (SELECT *, sum(weight) OVER (PARTITION BY period) AS t FROM roster) q",
    "roster",
)
def attach_period_weight(spark, sf):
    out = panels.attach_period_weight(_frame(spark, sf))
    return rounded(out.select("roster_id", "period", "weight", "period_weight"), "period_weight")


@query(
    "cluster_weight_filter",
    """SELECT period, unit, rnd(weight) AS weight FROM panel
    WHERE unit IN (SELECT unit FROM panel GROUP BY unit HAVING sum(weight) >= 3000)""",
    "panel",
)
def cluster_weight_filter(spark, sf):
    return rounded(panels.heavy_units(_panel(spark, sf), 3000.0).select("period", "unit", "weight"), "weight")


@query(
    "top_units",
    """SELECT p.period, t.unit, rnd(share) AS share FROM (SELECT DISTINCT period FROM panel) p
    CROSS JOIN (SELECT unit FROM panel GROUP BY unit ORDER BY sum(weight) DESC, unit LIMIT 3) t
    LEFT JOIN panel x ON x.period = p.period AND x.unit = t.unit""",
    "panel",
)
def top_units(spark, sf):
    return rounded(panels.top_units(_panel(spark, sf), 3), "share")


@query(
    "panel_roundtrip",
    "SELECT period, unit, n, rnd(weight) AS weight, rnd(share) AS share, rnd(win_rate) AS win_rate FROM panel",
    "panel",
)
def panel_roundtrip(spark, sf):
    path = fresh_path(spark, "panel")
    write_panel(_panel(spark, sf).select("period", "unit", "n", "weight", "share", "win_rate"), path)
    return rounded(read_panel(spark, path), "weight", "share", "win_rate")


@query(
    "panel_lags",
    """SELECT unit, period, rnd(value) AS value, rnd(value_lag1) AS value_lag1, rnd(winrate_lag1) AS winrate_lag1,
    rnd(delta) AS delta, rnd(delta_lag1) AS delta_lag1 FROM lagged""",
    "lagged",
)
def panel_lags(spark, sf):
    return rounded(panels.panel_lags(_panel(spark, sf)), "value", "value_lag1", "winrate_lag1", "delta", "delta_lag1")


@query(
    "within_demean",
    """SELECT unit, period, rnd(d) AS delta FROM (SELECT unit, period, delta - avg(delta) OVER (PARTITION BY unit) AS d
    FROM lagged WHERE delta_lag1 IS NOT NULL) q""",
    "lagged",
)
def within_demean(spark, sf):
    rows = panels.panel_lags(_panel(spark, sf)).dropna(subset=["delta_lag1"]).select("unit", "period", "delta")
    return rounded(panels.within_demean(rows, ["delta"]), "delta")


MOMENTUM = """WITH d AS (SELECT delta - avg(delta) OVER (PARTITION BY unit) AS y,
    delta_lag1 - avg(delta_lag1) OVER (PARTITION BY unit) AS x FROM lagged WHERE delta IS NOT NULL AND delta_lag1 IS NOT NULL),
    f AS (SELECT regr_slope(y, x) AS b, regr_intercept(y, x) AS a, regr_r2(y, x) AS r2, count(*) AS n, regr_sxx(y, x) AS sxx,
    avg(x) AS mx, (regr_syy(y, x) - regr_sxy(y, x) ** 2 / regr_sxx(y, x)) / (count(*) - 2) AS s2 FROM d)"""


@query(
    "ols",
    """WITH d AS (SELECT value AS y, value_lag1 AS x FROM lagged WHERE value_lag1 IS NOT NULL),
    f AS (SELECT regr_slope(y, x) AS b, regr_intercept(y, x) AS a, regr_r2(y, x) AS r2, count(*) AS n, regr_sxx(y, x) AS sxx,
    avg(x) AS mx, (regr_syy(y, x) - regr_sxy(y, x) ** 2 / regr_sxx(y, x)) / (count(*) - 2) AS s2 FROM d),
    t AS (SELECT 'intercept' AS term, a AS coef, sqrt(s2 * (1.0 / n + mx ** 2 / sxx)) AS se, r2, n FROM f
    UNION ALL SELECT 'value_lag1', b, sqrt(s2 / sxx), r2, n FROM f), u AS (SELECT *, coef / se AS ts FROM t)
    , area AS (SELECT term, sum(CASE WHEN i IN (0, 4000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END
      * pow(cos(low + i * (pi() / 2 - low) / 4000), n - 3)) * (pi() / 2 - low) / 12000
      * exp(lgamma((n - 1) / 2.0) - lgamma((n - 2) / 2.0)) / sqrt(pi()) * 2 AS pv
      FROM (SELECT term, n, atan(abs(ts) / sqrt(n - 2)) AS low FROM u), range(4001) t(i) GROUP BY term, n, low)
    SELECT term, rnd(coef) AS coef, rnd(se) AS se, rnd(ts) AS t_stat, rnd(pv) AS p_value, rnd(r2) AS r2, n FROM u JOIN area USING (term)""",
    "lagged",
)
def ols(spark, sf):
    rows = panels.panel_lags(_panel(spark, sf)).dropna(subset=["value", "value_lag1"])
    out = stats.ols(rows, "value", ["value_lag1"], p_values=True)
    return rounded(out, "coef", "se", "t_stat", "p_value", "r2")


@query(
    "momentum_test",
    MOMENTUM
    + """ SELECT term, rnd(coef) AS coef, rnd(se) AS se, rnd(r2) AS r2, n FROM (
    SELECT 'delta_lag1' AS term, b AS coef, sqrt(s2 / sxx) AS se, r2, n FROM f) q""",
    "lagged",
)
def momentum_test(spark, sf):
    out = stats.momentum_test(_panel(spark, sf)).where(F.col("term") == "delta_lag1")
    return rounded(out.drop("p_value", "t_stat"), "coef", "se", "r2")


@query(
    "winners_lead_test",
    """WITH d AS (SELECT value AS y, winrate_lag1 AS x1, value_lag1 AS x2 FROM lagged
    WHERE value IS NOT NULL AND winrate_lag1 IS NOT NULL AND value_lag1 IS NOT NULL),
    s AS (SELECT count(*) AS n, avg(y) AS my, avg(x1) AS m1, avg(x2) AS m2, var_pop(y) * count(*) AS syy,
    var_pop(x1) * count(*) AS s11, var_pop(x2) * count(*) AS s22, covar_pop(x1, x2) * count(*) AS s12,
    covar_pop(x1, y) * count(*) AS s1y, covar_pop(x2, y) * count(*) AS s2y FROM d),
    b AS (SELECT *, s11 * s22 - s12 ** 2 AS det, (s22 * s1y - s12 * s2y) / (s11 * s22 - s12 ** 2) AS b1,
    (s11 * s2y - s12 * s1y) / (s11 * s22 - s12 ** 2) AS b2 FROM s),
    r AS (SELECT *, syy - b1 * s1y - b2 * s2y AS rss FROM b),
    v AS (SELECT *, rss / (n - 3) AS s2 FROM r),
    t AS (SELECT 'winrate_lag1' AS term, b1 AS coef, sqrt(s2 * s22 / det) AS se, 1 - rss / syy AS r2, n FROM v
    UNION ALL SELECT 'value_lag1', b2, sqrt(s2 * s11 / det), 1 - rss / syy, n FROM v
    UNION ALL SELECT 'intercept', my - b1 * m1 - b2 * m2,
    sqrt(s2 * (1.0 / n + (m1 * m1 * s22 - 2 * m1 * m2 * s12 + m2 * m2 * s11) / det)), 1 - rss / syy, n FROM v),
    u AS (SELECT *, coef / se AS ts FROM t)
    SELECT term, rnd(coef) AS coef, rnd(se) AS se, rnd(ts) AS t_stat, rnd(r2) AS r2, n FROM u""",
    "lagged",
)
def winners_lead_test(spark, sf):
    out = stats.winners_lead_test(_panel(spark, sf)).drop("p_value")
    return rounded(out, "coef", "se", "t_stat", "r2")


@query(
    "persistence_baseline",
    """SELECT rnd(a) AS persistence_mae, rnd(b) AS climatology_mae, n_transitions FROM (
    SELECT avg(abs(value - value_lag1)) AS a, avg(abs(value - m)) AS b, count(*) AS n_transitions FROM (
    SELECT value, value_lag1, avg(value) OVER (PARTITION BY unit) AS m FROM lagged WHERE value_lag1 IS NOT NULL) q) z""",
    "lagged",
)
def persistence_baseline(spark, sf):
    return rounded(panels.persistence_baseline(_panel(spark, sf)), "persistence_mae", "climatology_mae")


# --- seasons, calendars, slices ---


@query("season_windows", "SELECT roster_id, season, period FROM seasoned", "seasoned")
def season_windows(spark, sf):
    return roles.seasoned(spark, sf).select("roster_id", "season", "period")


@query(
    "period_index",
    """SELECT roster_id, season, period, CAST(dense_rank() OVER (PARTITION BY season ORDER BY period) - 1 AS BIGINT) AS period_ix
    FROM seasoned""",
    "seasoned",
)
def period_index(spark, sf):
    out = seasons.with_period_index(roles.seasoned(spark, sf).select("roster_id", "season", "period"))
    return out.withColumn("period_ix", F.col("period_ix").cast("long"))


INDEXED = """WITH x AS (SELECT *, CAST(dense_rank() OVER (PARTITION BY season ORDER BY period) - 1 AS BIGINT) AS period_ix FROM seasoned)"""


def _indexed(spark, sf):
    rows = roles.seasoned(spark, sf).select("roster_id", "season", "period", "weight")
    return seasons.with_period_index(rows).withColumn("period_ix", F.col("period_ix").cast("long"))


@query(
    "recent_slice",
    INDEXED
    + """, m AS (SELECT season, greatest(max(period_ix) - 3, 0) AS f FROM x GROUP BY season),
    k AS (SELECT x.roster_id, x.season, x.period, x.period_ix - f AS period_ix, row_number() OVER (PARTITION BY x.season, x.period_ix
    ORDER BY md5(x.roster_id || '|0'), x.roster_id) AS r FROM x JOIN m USING (season) WHERE x.period_ix >= f)
    SELECT roster_id, season, period, period_ix FROM k WHERE r <= 20""",
    "seasoned",
)
def recent_slice(spark, sf):
    rows = _indexed(spark, sf).drop("weight")
    out = seasons.recent_slice(rows, 4, 20, 0, key="roster_id")
    return out.select("roster_id", "season", "period", F.col("period_ix").cast("long").alias("period_ix"))


@query(
    "min_period",
    """SELECT roster_id, season, period, CAST(dense_rank() OVER (PARTITION BY season ORDER BY period) - 1 AS BIGINT) AS period_ix
    FROM seasoned WHERE period >= '1998-W10'""",
    "seasoned",
)
def min_period(spark, sf):
    out = seasons.min_period(roles.seasoned(spark, sf).select("roster_id", "season", "period"), "1998-W10")
    return out.withColumn("period_ix", F.col("period_ix").cast("long"))


@query("slice_before", INDEXED + " SELECT roster_id, season, period_ix FROM x WHERE period_ix < 10", "seasoned")
def slice_before(spark, sf):
    return seasons.slice_before(_indexed(spark, sf), 10).select("roster_id", "season", "period_ix")


@query("season_view", "SELECT roster_id, season, period FROM seasoned WHERE season = 'y1997'", "seasoned")
def season_view(spark, sf):
    return seasons.season_view(roles.seasoned(spark, sf), "y1997").select("roster_id", "season", "period")


@query(
    "subset_seasons",
    """SELECT roster_id, season, CAST(list_position(['y1999', 'y1996', 'y2000'], season) - 1 AS BIGINT) AS season_id FROM seasoned
    WHERE season IN ('y1999', 'y1996', 'y2000')""",
    "seasoned",
)
def subset_seasons(spark, sf):
    out = seasons.subset_seasons(roles.seasoned(spark, sf), ["y1999", "y1996", "y2000"])
    return out.select("roster_id", "season", F.col("season_id").cast("long").alias("season_id"))


@query(
    "weeks_ago",
    INDEXED + " SELECT roster_id, season, CAST(period_ix - max(period_ix) OVER (PARTITION BY season) - 1 AS DOUBLE) AS weeks_ago FROM x",
    "seasoned",
)
def weeks_ago(spark, sf):
    from fieldshift.functions.periods import periods_ago
    from fieldshift.session import stage

    rows = stage(_indexed(spark, sf), "indexed")
    ends = rows.groupBy("season").agg((F.max("period_ix") + 1).alias("query_ix"))
    joined = rows.join(stage(ends, "season-end"), "season")
    return joined.select("roster_id", "season", periods_ago(F.col("period_ix"), F.col("query_ix")).alias("weeks_ago"))


@query(
    "balanced_sample",
    """SELECT roster_id, season FROM (SELECT roster_id, season, row_number() OVER (PARTITION BY season
    ORDER BY md5(roster_id || '|7'), roster_id) AS r FROM seasoned) q WHERE r <= 1500""",
    "seasoned",
)
def balanced_sample(spark, sf):
    rows = roles.seasoned(spark, sf).select("roster_id", "season")
    return seasons.balanced_sample(rows, 1500, key="roster_id")


BALANCE = "WITH t AS (SELECT season, sum(weight) AS t FROM seasoned GROUP BY season)"


@query(
    "balance_seasons",
    BALANCE
    + """, w AS (SELECT roster_id, season, weight * (SELECT avg(t) FROM t) / t AS e,
    weight * sqrt(t) * ((SELECT avg(t) FROM t) / (SELECT avg(sqrt(t)) FROM t)) / t AS q, weight FROM seasoned JOIN t USING (season))
    SELECT roster_id, season, rnd(e) AS w_equal, rnd(q) AS w_sqrt, rnd(weight) AS w_none FROM w""",
    "seasoned",
)
def balance_seasons(spark, sf):
    rows = roles.seasoned(spark, sf).select("roster_id", "season", "weight")
    out = None
    for mode in ("equal", "sqrt", "none"):
        part = seasons.balance_seasons(rows, mode).withColumnRenamed("weight", f"w_{mode}")
        out = part if out is None else out.join(part, ["roster_id", "season"])
    return rounded(out, "w_equal", "w_sqrt", "w_none")
