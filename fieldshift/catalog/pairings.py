"""Win probability, matrices, ratings and completion."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from fieldshift.catalog import roles
from fieldshift.catalog.records import TOKENS
from fieldshift.catalog.registry import query, rounded
from fieldshift.operators import pairing
from fieldshift.operators.codebook import feature_stats, standardize
from fieldshift.operators.recommend import Vocabulary, pooled, recommend_completions, roster_sums, token_sums, with_tokens
from fieldshift.plans.forecasts import field_state
from fieldshift.plans.rating import rate_batch, rate_details
from fieldshift.session import stage

SCORED = """WITH pr AS (SELECT pairing_id, label, 1 / (1 + exp(b.s - a.s)) AS p FROM pairing JOIN st a ON a.vec_id = vec_a
    JOIN st b ON b.vec_id = vec_b)"""


def _scored(spark, sf):
    frozen = roles.space(spark, sf)
    model = roles.mean_difference_model(spark, sf, frozen)
    return pairing.score_pairs(roles.pairings(spark, sf), roles.roster_vectors(spark, sf, frozen), model)


@query("win_probability", SCORED + " SELECT pairing_id, label, rnd(p) AS win_prob FROM pr", "pairing st")
def win_probability(spark, sf):
    return rounded(_scored(spark, sf).select("pairing_id", "label", "win_prob"), "win_prob")


@query(
    "pairing_metrics",
    SCORED
    + """, q AS (SELECT round(p, 9) AS p, label FROM pr), k AS (SELECT p, label, rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2.0 AS r FROM q),
    a AS (SELECT (sum(CASE WHEN label = 1 THEN r END) - sum(label) * (sum(label) + 1) / 2.0) / (sum(label) * (count(*) - sum(label))) AS auc FROM k),
    m AS (SELECT avg(CASE WHEN (p > 0.5) = (label = 1) THEN 1.0 ELSE 0.0 END) AS acc, avg(-(label * ln(p) + (1 - label) * ln(1 - p))) AS ll,
    avg((p - label) ** 2) AS br, avg(label) AS rate FROM q), t AS (
    SELECT 'model' AS method, auc, acc, ll, br FROM a, m UNION ALL SELECT 'coin flip', 0.5, greatest(rate, 1 - rate), ln(2), 0.25 FROM m)
    SELECT method, rnd(auc) AS auc, rnd(acc) AS accuracy, rnd(ll) AS log_loss, rnd(br) AS brier FROM t""",
    "pairing st",
)
def pairing_metrics(spark, sf):
    # probabilities are rounded so that ties mean the same in both engines
    scored = _scored(spark, sf).select("label", F.round("win_prob", 9).alias("win_prob"))
    out = pairing.pairing_metrics(stage(scored, "scored"))
    return rounded(out, "auc", "accuracy", "log_loss", "brier")


@query(
    "train_val_split",
    """SELECT pairing_id, row_number() OVER (ORDER BY md5(pairing_id || '|0'), pairing_id) <= floor(count(*) OVER () * 0.15::DOUBLE) AS is_val FROM pairing""",
    "pairing",
)
def train_val_split(spark, sf):
    return pairing.train_val_split(roles.pairings(spark, sf)).select("pairing_id", "is_val")


SAMPLES = """WITH sm AS (SELECT unit, roster_id, s FROM (SELECT unit, roster_id, s, row_number() OVER (PARTITION BY unit ORDER BY md5(roster_id || '|0'), roster_id) AS r
    FROM roster JOIN st USING (vec_id)) q WHERE r <= 25)"""


@query("unit_samples", SAMPLES + " SELECT unit, roster_id FROM sm", "roster st")
def unit_samples(spark, sf):
    return pairing.unit_samples(roles.roster(spark, sf)).select("unit", "roster_id")


def _samples(spark, sf, frozen):
    """Ids are sampled first; only the sampled rosters fetch a vector."""
    ids = pairing.unit_samples(roles.roster(spark, sf)).select("unit", "roster_id", "vec_id")
    return ids.join(frozen.vectors.select("vec_id", "embedding"), "vec_id")


@query(
    "expected_winrate",
    SAMPLES
    + """, e AS (SELECT v.vec_id, sm.unit, avg(1 / (1 + exp(sm.s - v.s))) AS w FROM st v CROSS JOIN sm GROUP BY ALL)
    SELECT roster_id, e.unit, rnd(w) AS win_rate FROM roster JOIN e USING (vec_id)""",
    "roster st",
)
def expected_winrate(spark, sf):
    frozen = roles.space(spark, sf)
    model = roles.mean_difference_model(spark, sf, frozen)
    field = pairing.Field.load(_samples(spark, sf, frozen))
    rated = pairing.expected_winrate(roles.roster_vectors(spark, sf, frozen), field, model)
    return rounded(rated, "win_rate")


@query(
    "weighted_winrate",
    SAMPLES
    + """, e AS (SELECT v.vec_id, sm.unit, avg(1 / (1 + exp(sm.s - v.s))) AS w FROM st v CROSS JOIN sm GROUP BY ALL),
    h AS (SELECT unit, sum(weight) / sum(sum(weight)) OVER () AS share FROM roster GROUP BY unit),
    o AS (SELECT vec_id, sum(w * share) / sum(share) AS w FROM e JOIN h USING (unit) GROUP BY vec_id)
    SELECT roster_id, rnd(w) AS win_rate FROM roster JOIN o USING (vec_id)""",
    "roster st",
)
def weighted_winrate(spark, sf):
    frozen = roles.space(spark, sf)
    model = roles.mean_difference_model(spark, sf, frozen)
    field = pairing.Field.load(_samples(spark, sf, frozen))
    out = pairing.weighted_rates(roles.roster_vectors(spark, sf, frozen), field, _shares(spark, sf), {"win_rate": "share"}, model)
    return rounded(out, "win_rate")


MATRIX = SAMPLES + """, mx AS (SELECT a.unit AS unit_a, b.unit AS unit_b, CASE WHEN a.unit = b.unit THEN 0.5 ELSE avg(1 / (1 + exp(b.s - a.s))) END AS w
    FROM sm a CROSS JOIN sm b GROUP BY a.unit, b.unit), sh AS (SELECT unit, sum(weight) / sum(sum(weight)) OVER () AS share FROM roster GROUP BY unit)"""


def _matrix(spark, sf):
    frozen = roles.space(spark, sf)
    model = roles.mean_difference_model(spark, sf, frozen)
    return pairing.advantage_matrix(_samples(spark, sf, frozen), model)


def _shares(spark, sf):
    weights = roles.roster(spark, sf).groupBy("unit").agg(F.sum("weight").alias("w"))
    return weights.select("unit", (F.col("w") / F.sum("w").over(Window.partitionBy())).alias("share"))


@query("advantage_matrix", MATRIX + " SELECT unit_a, unit_b, rnd(w) AS win_prob FROM mx", "roster st")
def advantage_matrix(spark, sf):
    return rounded(_matrix(spark, sf), "win_prob")


@query(
    "advantage_graph",
    MATRIX
    + """, nd AS (SELECT unit_a AS unit, sum(share * w) / sum(share) AS f FROM mx JOIN sh ON sh.unit = unit_b WHERE unit_a <> unit_b GROUP BY unit_a)
    SELECT 'node' AS part, nd.unit AS source, '' AS target, rnd(f) AS value FROM nd
    UNION ALL SELECT 'edge', unit_a, unit_b, rnd(w) FROM mx WHERE unit_a <> unit_b AND w > 0.501""",
    "roster st",
)
def advantage_graph(spark, sf):
    matrix = stage(_matrix(spark, sf), "matrix")
    shares = _shares(spark, sf)
    nodes = pairing.advantage_nodes(matrix, shares).select(
        F.lit("node").alias("part"), F.col("unit").alias("source"), F.lit("").alias("target"), F.col("field_winrate").alias("value")
    )
    edges = pairing.advantage_edges(matrix, shares, threshold=0.501).select(
        F.lit("edge").alias("part"), "source", "target", F.col("advantage").alias("value")
    )
    return rounded(nodes.unionByName(edges), "value")


RATED = """WITH fr AS (SELECT f.*, mp.unit AS core, coalesce(fam.family, 'none') AS family, st.s FROM feats f JOIN mp USING (anchor) JOIN st USING (vec_id)
    LEFT JOIN fam USING (roster_id)),
    us AS (SELECT core, s FROM (SELECT core, s, row_number() OVER (PARTITION BY core ORDER BY md5(roster_id || '|0'), roster_id) AS r FROM fr) q WHERE r <= 25),
    fs2 AS (SELECT family, s FROM (SELECT family, s, row_number() OVER (PARTITION BY family ORDER BY md5(roster_id || '|0'), roster_id) AS r FROM fr) q WHERE r <= 25),
    ue AS (SELECT v.vec_id, core, avg(1 / (1 + exp(us.s - v.s))) AS w FROM st v CROSS JOIN us GROUP BY ALL),
    fe AS (SELECT v.vec_id, family, avg(1 / (1 + exp(fs2.s - v.s))) AS w FROM st v CROSS JOIN fs2 GROUP BY ALL),
    cn AS (SELECT anchor, family, count(*) AS n FROM fr WHERE season = (SELECT arg_max(season, period) FROM feats) GROUP BY ALL),
    fa AS (SELECT anchor, arg_min(family, (-n, family)) AS family FROM cn GROUP BY anchor),
    fsh AS (SELECT family, sum(p) / sum(sum(p)) OVER () AS a, sum(p_hat) / sum(sum(p_hat)) OVER () AS b FROM nxt JOIN fa USING (anchor)
      WHERE season = (SELECT arg_max(season, period) FROM feats) GROUP BY family),
    ush AS (SELECT unit AS core, current_share AS a, predicted_share AS b FROM shift WHERE season = (SELECT arg_max(season, period) FROM feats) AND current_share >= 0.005),
    o AS (SELECT vec_id, sum(w * a) / sum(a) AS ua, sum(w * b) / sum(b) AS ub FROM ue JOIN ush USING (core) GROUP BY vec_id),
    p AS (SELECT vec_id, sum(w * a) / sum(a) AS fa, sum(w * b) / sum(b) AS fb FROM fe JOIN fsh USING (family) GROUP BY vec_id)"""


def _field(spark, sf):
    frozen = roles.space(spark, sf)
    rows = stage(
        roles.features(spark, sf, frozen)
        .join(roles.families(spark, sf), "roster_id", "left")
        .join(frozen.mapping().withColumnRenamed("unit", "core"), "anchor")
        .select("roster_id", "vec_id", "season", "period", "anchor", "weight", F.coalesce("family", F.lit("none")).alias("family"), F.col("core").alias("unit")),
        "field-rows",
    )
    vec = frozen.vectors.select("vec_id", "embedding")
    units = pairing.unit_samples(rows, "unit").join(vec, "vec_id")
    fams = pairing.unit_samples(rows, "family").join(vec, "vec_id")
    return frozen, rows, units, fams


@query(
    "rate_rosters",
    RATED
    + """ SELECT roster_id, rnd(ua) AS current_by_unit, rnd(ub) AS predicted_by_unit, rnd(fa) AS current_by_family, rnd(fb) AS predicted_by_family
    FROM roster JOIN o USING (vec_id) JOIN p USING (vec_id)""",
    "feats mp fam st nxt shift roster",
)
def rate_rosters(spark, sf):
    frozen, rows, units, fams = _field(spark, sf)
    state = field_state(rows, frozen.mapping(), frozen.size, roles.latest_season(rows))
    model = roles.mean_difference_model(spark, sf, frozen)
    out = rate_batch(roles.roster_vectors(spark, sf, frozen), units, fams, state, model)
    return rounded(out, "current_by_unit", "predicted_by_unit", "current_by_family", "predicted_by_family")


@query(
    "rate_rosters_detail",
    RATED
    + """ SELECT roster_id, 'unit' AS kind, CAST(core AS VARCHAR) AS name, rnd(w) AS rate FROM roster JOIN ue USING (vec_id) JOIN ush USING (core)
    UNION ALL SELECT roster_id, 'family', family, rnd(w) FROM roster JOIN fe USING (vec_id)""",
    "feats mp fam st nxt shift roster",
)
def rate_rosters_detail(spark, sf):
    frozen, rows, units, fams = _field(spark, sf)
    state = field_state(rows, frozen.mapping(), frozen.size, roles.latest_season(rows))
    model = roles.mean_difference_model(spark, sf, frozen)
    return rounded(rate_details(roles.roster_vectors(spark, sf, frozen), units, fams, state, model), "rate")


@query(
    "worst_matchups",
    RATED
    + """, k AS (SELECT vec_id, family, w, row_number() OVER (PARTITION BY vec_id ORDER BY round(w, 12), family) AS r FROM fe),
    z AS (SELECT *, avg(w) OVER (PARTITION BY vec_id) AS m FROM k WHERE r <= 3)
    SELECT roster_id, CAST(r AS INTEGER) AS rank, family, rnd(w) AS win_rate, rnd(m) AS worst_mean FROM roster JOIN z USING (vec_id)""",
    "feats mp fam st nxt shift roster",
)
def worst_matchups(spark, sf):
    frozen, _, _, fams = _field(spark, sf)
    model = roles.mean_difference_model(spark, sf, frozen)
    field = pairing.Field.load(fams, "family")
    out = pairing.worst_matchups(roles.roster_vectors(spark, sf, frozen), field, model, 3, "family")
    return rounded(out, "win_rate", "worst_mean")


# --- trained models ---


TRAINED = """SELECT count(*) AS n, CAST(floor(count(*) * 0.15) AS BIGINT) AS n_val, true AS at_optimum, true AS antisymmetric FROM pairing"""


def _trained(split, model, crossed: bool, reg: float):
    """Sizes of the split, whether the gradient vanishes at the model, and whether swapping the sides flips it."""
    train = split.where(~F.col("is_val"))
    weights = list(model.weights)
    if crossed:
        size = len(weights)
        weights += [model.gain[i][j] for i in range(size) for j in range(i + 1, size)]
    norm = pairing.gradient_norm(train, pairing.pair_features(F.col("a"), F.col("b"), crossed), weights, "label", reg)
    flips = F.abs(model.win_prob(F.col("a"), F.col("b")) + model.win_prob(F.col("b"), F.col("a")) - 1) < 1e-9
    return split.agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if("is_val").alias("n_val"),
        F.lit(norm < 1e-4).alias("at_optimum"),
        F.min(flips).alias("antisymmetric"),
    )


@query("fit_strength", TRAINED, "pairing")
def fit_strength(spark, sf):
    frozen = roles.space(spark, sf)
    split = stage(pairing.train_val_split(roles.pairing_vectors(spark, sf, frozen)), "pairs")
    return _trained(split, pairing.fit_strength(split.where(~F.col("is_val")), reg=1e-3), False, 1e-3)


@query("fit_interactions", TRAINED, "pairing")
def fit_interactions(spark, sf):
    frozen = roles.space(spark, sf)
    raw = frozen.vectors.select("vec_id", F.col("embedding").alias("vec"))
    small = pairing.pca_project(raw, raw, k=8).select("vec_id", F.col("xyz").alias("embedding"))
    ids = roles.roster(spark, sf).select("roster_id", "vec_id").join(small, "vec_id")
    pairs = roles.pairings(spark, sf)
    for side in ("a", "b"):
        named = ids.select(F.col("roster_id").alias(f"roster_{side}"), F.col("embedding").alias(side))
        pairs = pairs.join(named, f"roster_{side}")
    split = stage(pairing.train_val_split(pairs), "pairs")
    return _trained(split, pairing.fit_interactions(split.where(~F.col("is_val"))), True, 1e-3)


COMPLETED = (
    TOKENS
    + r""", tv AS (SELECT token, i, ('0x' || substr(md5(token || '|' || i), 1, 8))::BIGINT / 4294967296.0::DOUBLE - 0.5 AS v
      FROM (SELECT DISTINCT token FROM tk) q CROSS JOIN range(8) d(i)),
    ms AS (SELECT roster_id, slot, i, sum(v) AS s, count(*) AS n FROM tk JOIN tv USING (token) GROUP BY ALL),
    rs AS (SELECT roster_id, i, sum(s) AS s, sum(n) AS n FROM ms GROUP BY ALL),
    fr AS (SELECT i, avg(s / n) AS m, CASE WHEN stddev_pop(s / n) < 1e-8 THEN 1.0::DOUBLE ELSE stddev_pop(s / n) END AS sd FROM rs GROUP BY i),
    z AS MATERIALIZED (SELECT roster_id, i, (s / n - m) / sd AS z FROM rs JOIN fr USING (i)),
    pz AS MATERIALIZED (SELECT pairing_id, a.i, a.z AS za, b.z AS zb, CASE WHEN label = 1 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END AS sg
      FROM pairing JOIN z a ON a.roster_id = roster_a JOIN z b ON b.roster_id = roster_b AND b.i = a.i),
    w AS (SELECT i, 2 * avg(sg * (za - zb)) AS w FROM pz GROUP BY i),
    h AS (SELECT a.i, b.i AS j, 2 * avg(a.sg * (a.za * b.zb - b.za * a.zb)) AS g FROM pz a JOIN pz b USING (pairing_id) GROUP BY a.i, b.i),
    fld AS (SELECT unit, q.roster_id AS opp, i, z FROM (SELECT roster_id, unit, row_number() OVER (PARTITION BY unit ORDER BY md5(roster_id || '|0'), roster_id) AS r
      FROM roster) q JOIN z USING (roster_id) WHERE r <= 25),
    gy AS (SELECT opp, h.i, sum(g * z) AS gy FROM fld JOIN h ON h.j = fld.i GROUP BY opp, h.i),
    c AS (SELECT opp, unit, i, (w + gy) / sd AS c, m, w * z AS wz FROM fld JOIN gy USING (opp, i) JOIN w USING (i) JOIN fr USING (i)),
    k AS (SELECT opp, unit, -sum(wz) - sum(m * c) AS k FROM c GROUP BY ALL),
    gone AS (SELECT roster_id, token FROM tk JOIN sized USING (roster_id) WHERE n_members < 6 AND ((slot = 1 AND starts_with(token, 'item:'))
      OR (slot = 2 AND starts_with(token, 'ability:')))),
    gs AS (SELECT roster_id, i, sum(v) AS v FROM gone JOIN tv USING (token) GROUP BY ALL),
    sp AS MATERIALIZED (SELECT rs.roster_id, opp, unit, sum((rs.s - gs.v) * c) AS sp, any_value(rs.n) AS n FROM rs JOIN gs USING (roster_id, i)
      JOIN c USING (i) GROUP BY rs.roster_id, opp, unit),
    ra AS (SELECT roster_id, sp.unit, avg(1 / (1 + exp(-(sp / n + k)))) AS w FROM sp JOIN k USING (opp) GROUP BY ALL),
    wr AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY roster_id ORDER BY round(w, 12), unit) AS wi FROM ra) q WHERE wi <= 3),
    pk AS (SELECT roster_id, slot, species, item, ability, lower(regexp_replace(species, '[^\p{L}\p{N}]', '', 'g')) AS species_id,
      string_split(moves_text, ' ') AS moves FROM member),
    po AS (SELECT species_id, lower(item) AS item_id, lower(ability) AS ability_id, array_to_string(list_sort(moves), ',') AS move_ids, count(*) AS uses,
      arg_min(roster_id, (roster_id, slot)) AS roster_id, arg_min(slot, (roster_id, slot)) AS slot, arg_min(species || ' @ ' || item, (roster_id, slot)) AS label
      FROM pk GROUP BY 1, 2, 3, 4 ORDER BY uses DESC, 1, 2, 3, 4 LIMIT 150),
    pool AS (SELECT *, row_number() OVER (ORDER BY uses DESC, species_id, item_id, ability_id, move_ids) AS place FROM po),
    own AS (SELECT DISTINCT roster_id, species_id FROM pk),
    bs AS (SELECT DISTINCT roster_id FROM gone),
    vals AS (SELECT species_id, 'item' AS kind, item AS value FROM pk UNION ALL SELECT species_id, 'ability', ability FROM pk
      UNION ALL SELECT species_id, 'move', unnest(moves) FROM pk),
    opts AS (SELECT species_id, kind, value, r, kind || ':' || lower(value) AS ck FROM (SELECT *, row_number() OVER (PARTITION BY species_id, kind ORDER BY n DESC, value) AS r
      FROM (SELECT species_id, kind, value, count(*) AS n FROM vals GROUP BY ALL) q0) q WHERE r <= CASE kind WHEN 'item' THEN 6 WHEN 'ability' THEN 3 ELSE 12 END),
    o AS (SELECT roster_id, 'member' AS slot, label, ck, added FROM (SELECT bs.roster_id, label, 'p' || place AS ck, row_number() OVER (PARTITION BY bs.roster_id ORDER BY place) AS r,
        (SELECT max(n) FROM ms WHERE ms.roster_id = pool.roster_id AND ms.slot = pool.slot) AS added
      FROM bs, pool WHERE NOT EXISTS (SELECT 1 FROM own WHERE own.roster_id = bs.roster_id AND own.species_id = pool.species_id)) q WHERE r <= 120
      UNION ALL SELECT bs.roster_id, 'item on ' || species || ' 1', value, ck, 0 FROM bs JOIN pk ON pk.roster_id = bs.roster_id AND slot = 1 JOIN opts USING (species_id) WHERE kind = 'item'
      UNION ALL SELECT bs.roster_id, 'ability on ' || species || ' 2', value, ck, 0 FROM bs JOIN pk ON pk.roster_id = bs.roster_id AND slot = 2 JOIN opts USING (species_id) WHERE kind = 'ability'
      UNION ALL SELECT roster_id, slot, value, ck, 1 FROM (SELECT bs.roster_id, 'move on ' || species || ' ' || slot AS slot, value, ck,
        row_number() OVER (PARTITION BY bs.roster_id, slot ORDER BY r) AS nth FROM bs JOIN pk ON pk.roster_id = bs.roster_id JOIN opts USING (species_id)
        WHERE kind = 'move' AND len(moves) < 4 AND NOT list_contains(list_transform(moves, lambda x: lower(x)), lower(value))) q WHERE nth <= 6),
    cv AS (SELECT 'p' || place AS ck, i, s AS v FROM pool JOIN ms USING (roster_id, slot) UNION ALL SELECT token, i, v FROM tv),
    tc AS MATERIALIZED (SELECT ck, opp, sum(v * c) AS t FROM cv JOIN c USING (i) GROUP BY ALL),
    rate AS (SELECT o.roster_id, o.slot, o.label, o.ck, wi, wr.unit, any_value(wr.w) AS base, avg(1 / (1 + exp(-((sp + t) / (n + added) + k)))) AS w
      FROM o JOIN wr USING (roster_id) JOIN sp ON sp.roster_id = o.roster_id AND sp.unit = wr.unit JOIN tc ON tc.ck = o.ck AND tc.opp = sp.opp JOIN k ON k.opp = sp.opp GROUP BY ALL),
    tot AS (SELECT roster_id, slot, label, ck, avg(w) AS rate, avg(base) AS base, max(CASE WHEN wi = 1 THEN unit END) AS family_1, max(CASE WHEN wi = 2 THEN unit END) AS family_2,
      max(CASE WHEN wi = 3 THEN unit END) AS family_3, max(CASE WHEN wi = 1 THEN w END) AS r1, max(CASE WHEN wi = 2 THEN w END) AS r2, max(CASE WHEN wi = 3 THEN w END) AS r3
      FROM rate GROUP BY ALL),
    best AS (SELECT *, rate - base AS d, row_number() OVER (PARTITION BY roster_id, slot ORDER BY round(rate, 12) DESC, label) AS kk FROM tot)
    SELECT roster_id, slot, CAST(kk AS INTEGER) AS rank, label, rnd(rate) AS winrate_vs_worst, rnd(d) AS delta,
      family_1, family_2, family_3, rnd(r1) AS rate_1, rnd(r2) AS rate_2, rnd(r3) AS rate_3 FROM best WHERE kk <= 5"""
)


@query("recommend_completions", COMPLETED, "member sized roster pairing")
def recommend(spark, sf):
    """Every roster of fewer than six members, with one item and one ability left out."""
    dim = stage(roles.dimension(spark, sf), "dimension")
    rows = stage(with_tokens(roles.members(spark, sf, "size"), dim, roles.ROLE_STATS), "members")
    members = rows.drop("tokens", "size")
    vectors = stage(roles.token_vectors(rows), "token-vectors")
    whole = roster_sums(token_sums(rows, vectors, Vocabulary.load(vectors)), 8).select("roster_id", pooled(F.col("s"), F.col("n")).alias("embedding"))
    whole = stage(whole, "pooled")
    frame = stage(feature_stats(whole), "frame")
    rosters = standardize(whole, frame)
    pairs = roles.pairings(spark, sf)
    for side in ("a", "b"):
        pairs = pairs.join(rosters.select(F.col("roster_id").alias(f"roster_{side}"), F.col("embedding").alias(side)), f"roster_{side}")
    model = pairing.first_step_model(pairs)
    sampled = pairing.unit_samples(roles.roster(spark, sf)).select("roster_id", F.col("unit").alias("family"))
    field = pairing.Field.load(sampled.join(rosters, "roster_id"), "family")
    unfinished = (
        rows.where(F.col("size") < 6)
        .drop("tokens", "size")
        .withColumn("item", F.when(F.col("slot") != 1, F.col("item")))
        .withColumn("ability", F.when(F.col("slot") != 2, F.col("ability")))
    )
    out = recommend_completions(unfinished, dim, vectors, frame, model, field, members, roles.ROLE_STATS)
    wide = out.select(
        "roster_id", "slot", "rank", "label", "winrate_vs_worst", "delta",
        *[F.get("per_family", F.lit(i))["family"].alias(f"family_{i + 1}") for i in range(3)],
        *[F.get("per_family", F.lit(i))["rate"].alias(f"rate_{i + 1}") for i in range(3)],
    )
    # millions of win rates: rounded by arithmetic, since F.round goes through decimal text for each
    shown = {c: F.rint(F.col(c) * 1e6) / 1e6 + 0.0 for c in ("winrate_vs_worst", "delta", "rate_1", "rate_2", "rate_3")}
    return wide.withColumns(shown)
