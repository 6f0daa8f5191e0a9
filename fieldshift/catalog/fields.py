"""Distributions over anchors, units and families."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from fieldshift.catalog import roles
from fieldshift.catalog.registry import query, rounded
from fieldshift.functions.simplex import alr, inv_alr
from fieldshift.operators import contexts, dists
from fieldshift.operators.codebook import label_reps
from fieldshift.plans.forecasts import field_state, forecast_shift, next_distribution
from fieldshift.session import stage


@query(
    "anchor_histogram",
    """SELECT anchor, rnd(p) AS p FROM (SELECT anchor, (coalesce(w, 0) + 1) / sum(coalesce(w, 0) + 1) OVER () AS p FROM dom
    LEFT JOIN (SELECT anchor, sum(weight) AS w FROM feats GROUP BY anchor) q USING (anchor)) z""",
    "feats dom",
)
def anchor_histogram(spark, sf):
    frozen = roles.space(spark, sf)
    return rounded(dists.anchor_histogram(roles.features(spark, sf, frozen), frozen.size), "p")


@query("weekly_anchor_matrix", "SELECT season, period, period_ix, anchor, rnd(p) AS p FROM pm", "pm")
def weekly_anchor_matrix(spark, sf):
    return rounded(roles.weekly_p(spark, sf, roles.space(spark, sf)), "p")


@query(
    "anchor_distribution",
    """SELECT label, anchor, rnd(p) AS p FROM (SELECT label, anchor, (coalesce(w, 0) + 1) / sum(coalesce(w, 0) + 1)
    OVER (PARTITION BY label) AS p FROM (SELECT DISTINCT label FROM embeddings) l CROSS JOIN dom LEFT JOIN (
    SELECT label, anchor, count(*)::DOUBLE AS w FROM embeddings JOIN asg USING (vec_id) GROUP BY ALL) q USING (label, anchor)) z""",
    "asg dom",
)
def anchor_distribution(spark, sf):
    frozen = roles.space(spark, sf)
    rows = frozen.vectors.withColumn("weight", F.lit(1.0))
    return rounded(dists.anchor_distribution(rows, frozen.anchors, ("label",)), "p")


@query("most_common_anchor", "SELECT anchor, count(*) AS n FROM feats GROUP BY anchor ORDER BY n DESC, anchor LIMIT 1", "feats")
def most_common_anchor(spark, sf):
    return dists.most_common_anchor(roles.features(spark, sf, roles.space(spark, sf)))


@query(
    "anchor_to_unit_distribution",
    """SELECT season, period, unit, rnd(share) AS share FROM (SELECT season, period, unit,
    sum(p) / sum(sum(p)) OVER (PARTITION BY season, period) AS share FROM pm JOIN mp USING (anchor) GROUP BY season, period, unit) q""",
    "pm mp",
)
def anchor_to_unit_distribution(spark, sf):
    frozen = roles.space(spark, sf)
    out = dists.unit_distribution(roles.weekly_p(spark, sf, frozen), frozen.mapping(), ("season", "period"))
    return rounded(out, "share")


@query(
    "shift_table",
    """WITH s AS (SELECT season, unit, sum(p) / sum(sum(p)) OVER (PARTITION BY season) AS share FROM pm JOIN mp USING (anchor)
    GROUP BY season, unit), o AS (SELECT season, lead(season) OVER (ORDER BY season) AS following FROM (SELECT DISTINCT season FROM s) q),
    a AS (SELECT s.* FROM s JOIN o USING (season) WHERE following IS NOT NULL),
    b AS (SELECT o.season, unit, share FROM s JOIN o ON s.season = o.following),
    j AS (SELECT season, unit, coalesce(a.share, 0) AS c, coalesce(b.share, 0) AS n FROM a FULL JOIN b USING (season, unit)),
    k AS (SELECT season, unit, c, n, n - c AS d, CASE WHEN c >= 0.01 THEN (n - c) / c END AS g FROM j)
    SELECT season, unit, rnd(c) AS current_share, rnd(n) AS predicted_share, rnd(d) AS delta, rnd(g) AS pct_change FROM k""",
    "pm mp",
)
def shift_table(spark, sf):
    frozen = roles.space(spark, sf)
    shares = dists.unit_distribution(roles.weekly_p(spark, sf, frozen), frozen.mapping(), ("season",))
    shares = stage(shares, "season-shares")
    # every season against the one that follows
    order = Window.orderBy("season")
    seasons = shares.select("season").distinct().withColumn("following", F.lead("season").over(order))
    seasons = seasons.where(F.col("following").isNotNull())
    following = seasons.join(shares.withColumnRenamed("season", "following"), "following").drop("following")
    out = dists.shift_table(shares.join(seasons.select("season"), "season"), following, ["season"])
    return rounded(out, "current_share", "predicted_share", "delta", "pct_change")


@query(
    "forecast_shift",
    """SELECT season, unit, rnd(current_share) AS current_share, rnd(predicted_share) AS predicted_share, rnd(delta) AS delta,
    rnd(pct_change) AS pct_change FROM shift""",
    "shift",
)
def forecast_shift_query(spark, sf):
    frozen = roles.space(spark, sf)
    out = forecast_shift(roles.features(spark, sf, frozen), frozen.mapping(), frozen.size)
    return rounded(out, "current_share", "predicted_share", "delta", "pct_change")


REPS = """WITH d AS (SELECT mp.unit, f.roster_id, v.d FROM feats f JOIN mp USING (anchor) JOIN vd v ON v.vec_id = f.vec_id
    AND v.kind = 'unit' AND v.id = mp.unit), l AS (SELECT unit, 'r' || arg_min(roster_id, (round(d, 9), roster_id)) AS rep
    FROM d GROUP BY unit)"""


def _labels(spark, sf, frozen, rows):
    from fieldshift.operators.codebook import representatives_current

    reps = representatives_current(rows, frozen.mapping(), frozen.units, "roster_id")
    return reps.select("unit", F.concat(F.lit("r"), F.col("representative_id").cast("string")).alias("representative"))


@query(
    "label_reps",
    REPS + " SELECT anchor, mp.unit, coalesce(rep, '') AS representative FROM mp LEFT JOIN l ON l.unit = mp.unit",
    "feats mp vd",
)
def label_reps_query(spark, sf):
    frozen = roles.space(spark, sf)
    labels = _labels(spark, sf, frozen, roles.features(spark, sf, frozen, vectors=True))
    return label_reps(frozen.mapping(), labels)


@query(
    "risers_fallers",
    """WITH x AS (SELECT *, row_number() OVER (PARTITION BY season ORDER BY delta DESC, unit) AS up,
    row_number() OVER (PARTITION BY season ORDER BY delta, unit) AS down FROM shift WHERE current_share >= 0.01)
    SELECT season, side, unit, rnd(delta) AS delta FROM (SELECT season, 'rising' AS side, unit, delta FROM x WHERE up <= 3 UNION ALL
    SELECT season, 'falling', unit, delta FROM x WHERE down <= 3) q""",
    "shift",
)
def risers_fallers(spark, sf):
    frozen = roles.space(spark, sf)
    shift = forecast_shift(roles.features(spark, sf, frozen), frozen.mapping(), frozen.size)
    out = dists.risers_fallers(shift, keys=["season"])
    return rounded(out.select("season", "side", "unit", "delta"), "delta")


@query(
    "top_shares",
    REPS
    + """, t AS (SELECT s.season, s.unit, s.current_share, rep, row_number() OVER (PARTITION BY season ORDER BY s.current_share DESC, s.unit) AS r
    FROM shift s JOIN l ON l.unit = s.unit WHERE rep <> '')
    SELECT season, unit, rnd(current_share) AS current_share, rep AS representative FROM t WHERE r <= 5""",
    "feats mp vd shift",
)
def top_shares(spark, sf):
    frozen = roles.space(spark, sf)
    rows = roles.features(spark, sf, frozen, vectors=True)
    shift = forecast_shift(rows, frozen.mapping(), frozen.size, labels=_labels(spark, sf, frozen, rows))
    top = dists.top_shares(shift, keys=["season"])
    return rounded(top.select("season", "unit", "current_share", "representative"), "current_share")


FAMS = """WITH c AS (SELECT anchor, family, count(*) AS n FROM feats JOIN fam USING (roster_id) GROUP BY ALL),
    fa AS (SELECT anchor, arg_min(family, (-n, family)) AS family FROM c GROUP BY anchor)"""


def _family_rows(spark, sf, frozen):
    return roles.features(spark, sf, frozen).join(roles.families(spark, sf), "roster_id", "left")


@query("classify_family", "SELECT roster_id, family FROM fam", "fam")
def classify_family(spark, sf):
    return roles.families(spark, sf)


@query("family_of_anchor", FAMS + " SELECT anchor, family FROM fa", "feats fam")
def family_of_anchor(spark, sf):
    return dists.family_of_anchor(_family_rows(spark, sf, roles.space(spark, sf)))


@query(
    "family_shares",
    """WITH c AS (SELECT season, anchor, family, count(*) AS n FROM feats JOIN fam USING (roster_id) WHERE season = (SELECT arg_max(season, period) FROM feats) GROUP BY ALL),
    fa AS (SELECT anchor, arg_min(family, (-n, family)) AS family FROM c GROUP BY anchor),
    s AS (SELECT family, sum(p) / sum(sum(p)) OVER () AS a, sum(p_hat) / sum(sum(p_hat)) OVER () AS b
    FROM nxt JOIN fa USING (anchor) WHERE season = (SELECT arg_max(season, period) FROM feats) GROUP BY family), t AS (SELECT *, b - a AS d FROM s)
    SELECT family, rnd(a) AS current_share, rnd(b) AS predicted_share, rnd(d) AS delta FROM t""",
    "feats fam nxt",
)
def family_shares(spark, sf):
    frozen = roles.space(spark, sf)
    rows = stage(_family_rows(spark, sf, frozen), "family-rows")
    state = field_state(rows, frozen.mapping(), frozen.size, roles.latest_season(rows))
    return rounded(state.family_shares, "current_share", "predicted_share", "delta")


@query(
    "kl_divergence",
    """WITH s AS (SELECT season, anchor, p, p_hat FROM nxt), k AS (SELECT season, sum(a * log2(a / b)) AS kl FROM (
    SELECT season, (p + 1e-9) / sum(p + 1e-9) OVER (PARTITION BY season) AS a, (p_hat + 1e-9) / sum(p_hat + 1e-9) OVER (PARTITION BY season) AS b FROM s) q
    GROUP BY season) SELECT season, rnd(kl) AS kl FROM k""",
    "nxt",
)
def kl_divergence(spark, sf):
    frozen = roles.space(spark, sf)
    nxt = next_distribution(roles.features(spark, sf, frozen), frozen.size)
    p = nxt.select("season", "anchor", "p")
    q = nxt.select("season", "anchor", F.col("p_hat").alias("p"))
    return rounded(dists.kl_divergence(p, q, ("season",)), "kl")


def _rows_as_arrays(P):
    return P.groupBy("season", "period_ix").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("anchor", "p"))), lambda s: s["p"]).alias("p")
    )


@query(
    "alr",
    """SELECT season, period_ix, CAST(row_number() OVER (PARTITION BY season, period_ix ORDER BY anchor) AS BIGINT) AS i, rnd(y) AS y
    FROM lr WHERE anchor <> (SELECT ref FROM ref)""",
    "lr",
)
def alr_query(spark, sf):
    frozen = roles.space(spark, sf)
    rows = roles.features(spark, sf, frozen)
    ref = dists.most_common_anchor(rows).first()["anchor"]
    P = _rows_as_arrays(dists.weekly_anchor_matrix(rows, frozen.size))
    flat = P.select("season", "period_ix", F.posexplode(alr(F.col("p"), ref)).alias("i", "y"))
    return rounded(flat.withColumn("i", (F.col("i") + 1).cast("long")), "y")


@query("inv_alr", "SELECT season, period_ix, anchor, round(p, 9) AS p FROM pm", "pm")
def inv_alr_query(spark, sf):
    frozen = roles.space(spark, sf)
    rows = roles.features(spark, sf, frozen)
    ref = dists.most_common_anchor(rows).first()["anchor"]
    P = _rows_as_arrays(dists.weekly_anchor_matrix(rows, frozen.size))
    back = inv_alr(alr(F.col("p"), ref), ref)
    flat = P.select("season", "period_ix", F.posexplode(back).alias("anchor", "p"))
    return flat.withColumn("p", F.round("p", 9))


@query(
    "context_sets",
    """WITH x AS (SELECT roster_id AS row_id, season, CAST(dense_rank() OVER (PARTITION BY season ORDER BY period) - 1 AS BIGINT) AS period_ix,
    md5(roster_id || '|0') AS d FROM seasoned),
    pos AS (SELECT row_id, season, period_ix, row_number() OVER (PARTITION BY season ORDER BY period_ix, d, row_id) - 1 AS pos FROM x),
    per AS (SELECT season, period_ix, count(*) AS n, coalesce(sum(count(*)) OVER (PARTITION BY season ORDER BY period_ix
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before FROM x GROUP BY season, period_ix),
    u AS (SELECT pos.*, n, before, n - 1 AS others, pos - before AS own,
      ('0x' || substr(md5(row_id || '|0:mask'), 1, 8))::UBIGINT / 4294967296.0::DOUBLE AS um,
      ('0x' || substr(md5(row_id || '|0:ratio'), 1, 8))::UBIGINT / 4294967296.0::DOUBLE AS ur,
      ('0x' || substr(md5(row_id || '|0:budget'), 1, 8))::UBIGINT / 4294967296.0::DOUBLE AS ub
      FROM pos JOIN per USING (season, period_ix) WHERE period_ix >= 1),
    b AS (SELECT *, [64, 128, 256][floor(ub * 3)::INTEGER + 1] AS budget FROM u),
    c AS (SELECT *, least(round_even(CASE WHEN um < 0.5 THEN 0 ELSE 1 - ur END * others, 0)::BIGINT, budget) AS cur FROM b),
    e AS (SELECT *, CASE WHEN cur + least(budget - cur, before) = 0 THEN least(1, before) ELSE least(budget - cur, before) END AS past FROM c),
    want AS (SELECT row_id, season, period_ix, before, own, 'current' AS part, cur AS k, others AS m FROM e WHERE cur > 0
      UNION ALL SELECT row_id, season, period_ix, before, own, 'past', past, before FROM e WHERE past > 0),
    f AS (SELECT *, least(k, m - k) AS few FROM want),
    raw AS (SELECT *, floor(('0x' || substr(md5(row_id || '|0:' || part || '|' || j // 4), (j % 4) * 8 + 1, 8))::UBIGINT::DOUBLE * m
        / 4294967296.0::DOUBLE)::BIGINT AS i FROM (SELECT *, unnest(range(4 * ((2 * few + 16) // 4 + 1))) AS j FROM f) q
      UNION ALL SELECT *, j - 1000000 AS i FROM (SELECT *, unnest(range(1000000, 1000000 + least(m, 2 * few))) AS j FROM f) q),
    once AS (SELECT row_id, part, i, min(j) AS j, any_value(few) AS few FROM raw WHERE few > 0 GROUP BY row_id, part, i),
    chosen_few AS (SELECT row_id, part, i FROM (SELECT *, row_number() OVER (PARTITION BY row_id, part ORDER BY j) AS r FROM once) q WHERE r <= few),
    every AS (SELECT row_id, part, unnest(range(m)) AS i FROM f WHERE k > m - k),
    taken AS (SELECT s.row_id, s.part, s.i FROM chosen_few s JOIN f USING (row_id, part) WHERE k <= m - k
      UNION ALL SELECT row_id, part, i FROM every ANTI JOIN chosen_few USING (row_id, part, i)),
    w AS (SELECT f.row_id, f.season, f.period_ix, CASE WHEN f.part = 'past' THEN i ELSE before + i + CASE WHEN i >= own THEN 1 ELSE 0 END END AS pos
      FROM taken t JOIN f USING (row_id, part)),
    o AS (SELECT w.row_id, w.season, w.period_ix, p.row_id AS context_id, p.period_ix AS pix FROM w JOIN pos p USING (season, pos))
    SELECT row_id, count(*) FILTER (WHERE pix = period_ix) AS n_current, count(*) FILTER (WHERE pix < period_ix) AS n_past,
    CAST(sum(context_id) AS BIGINT) AS context_sum, CAST(min(pix - period_ix) AS BIGINT) AS oldest FROM o GROUP BY row_id""",
    "seasoned",
)
def context_sets(spark, sf):
    from fieldshift.operators.seasons import with_period_index

    rows = with_period_index(roles.seasoned(spark, sf).select(F.col("roster_id").alias("row_id"), "season", "period"))
    sets = contexts.context_sets(rows)
    return sets.groupBy("row_id").agg(
        F.count_if("is_current").alias("n_current"),
        F.count_if(~F.col("is_current")).alias("n_past"),
        F.sum("context_id").alias("context_sum"),
        F.min("weeks_ago").cast("long").alias("oldest"),
    )
