import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldshift.operators import dists, evaluate, forecast


def to_long(spark, mats):
    rows = [(s, t, k, float(P[t, k])) for s, P in mats.items() for t in range(len(P)) for k in range(P.shape[1])]
    return spark.createDataFrame(rows, "season string, period_ix int, anchor int, p double")


@pytest.fixture(scope="module")
def mats():
    rng = np.random.default_rng(4)
    return {s: rng.dirichlet(np.full(5, 3.0), size=w) for s, w in (("a", 6), ("b", 4), ("c", 1))}


@pytest.fixture(scope="module")
def P(spark, mats):
    return to_long(spark, mats)


def table(df):
    """{(label, season, origin): vector}"""
    out = {}
    for r in df.orderBy("anchor").collect():
        out.setdefault((r["label"], r["season"], r["period_ix"]), []).append(r["p_hat"])
    return {k: np.array(v) for k, v in out.items()}


def log_ratio(M, ref):
    return np.log(np.delete(M, ref, 1)) - np.log(M[:, [ref]])


def back(a, ref):
    full = np.insert(a, ref, 0.0)
    e = np.exp(full - full.max())
    return e / e.sum()


def level(M, ref, q):
    Y = log_ratio(M, ref)
    a, v = Y[0], 1.0
    for y in Y[1:]:
        g = (v + q) / (v + q + 1)
        a, v = a + g * (y - a), (v + q) * (1 - g)
    return back(a, ref)


def stoch(M, ref, q, g_):
    Y = log_ratio(M, ref)
    a, v, vol = Y[0], 1.0, 1.0
    for y in Y[1:]:
        g = (v + q * vol) / (v + q * vol + 1)
        miss = y - a
        a, v = a + g * miss, (v + q * vol) * (1 - g)
        vol = g_ * vol + (1 - g_) * (miss**2).mean()
    return back(a, ref)


def test_filters_match_direct_recursion_at_every_origin(P, mats):
    ll = table(forecast.fc_local_level(P.repartition(7), 2, (0.2, 2.0)))
    sv = table(forecast.fc_stoch_vol(P.repartition(7), 2, ((0.5, 0.8),)))
    for s, M in mats.items():
        for t in range(len(M)):
            for q in (0.2, 2.0):
                assert ll[f"local_level({q:g})", s, t] == pytest.approx(level(M[: t + 1], 2, q), abs=1e-10)
            assert sv["stoch_vol(0.5,0.8)", s, t] == pytest.approx(stoch(M[: t + 1], 2, 0.5, 0.8), abs=1e-10)


def test_endpoints(P, mats):
    glide = table(forecast.fc_glide(P, (0.0, 1.0)))
    base = forecast.fc_local_level(P, 0, (0.5,))
    mix = table(forecast.fc_combination(base, (0.0, 1.0)))
    tracked = table(forecast.fc_local_level(P, 0, (1e9,)))
    level_ = table(base)
    for s, M in mats.items():
        for t in range(len(M)):
            assert glide["glide(0)", s, t] == pytest.approx(M[t]) and glide["glide(1)", s, t] == pytest.approx(M[: t + 1].mean(0))
            assert tracked["local_level(1e+09)", s, t] == pytest.approx(M[t], abs=1e-4)
            assert mix["combo(0,local_level(0.5))", s, t] == pytest.approx(M[t])
            assert mix["combo(1,local_level(0.5))", s, t] == pytest.approx(level_["local_level(0.5)", s, t])


def test_custom_forecaster_sees_only_the_past(P, mats):
    got = table(forecast.custom_forecaster(P, lambda h: h.mean(axis=0), "mean"))
    for s, M in mats.items():
        for t in range(len(M)):
            assert got["mean", s, t] == pytest.approx(M[: t + 1].mean(0))


def kl(p, q):
    p, q = p + 1e-9, q + 1e-9
    p, q = p / p.sum(), q / q.sum()
    return float((p * np.log2(p / q)).sum())


def test_scores_selection_and_race(spark, P, mats):
    forecasts = evaluate.all_candidates(P, 1)
    scores = evaluate.score_candidates(forecasts)
    got = {(r["label"], r["season"], r["period_ix"]): r["kl"] for r in scores.collect()}
    hats = table(forecasts)
    assert {k[1] for k in got} == {"a", "b"}
    for (label, s, t), value in got.items():
        assert value == pytest.approx(kl(mats[s][t + 1], hats[label, s, t]), abs=1e-9)
    chosen = {(r["family"], r["season"]): r["label"] for r in evaluate.loro_select(scores).collect()}
    for held, other in (("a", "b"), ("b", "a")):
        means = {f"glide({x:g})": np.mean([got[f"glide({x:g})", other, t] for t in range(len(mats[other]) - 1)]) for x in forecast.GLIDE_LAMBDAS}
        assert chosen["glide", held] == min(means, key=means.get)
    race = evaluate.horse_race(scores).collect()
    assert [r["mean_kl"] for r in race] == sorted(r["mean_kl"] for r in race) and len(race) == 5
    mapping = spark.createDataFrame([(k, k % 2) for k in range(5)], "anchor int, unit int")
    shift = evaluate.best_next_forecast(forecasts, scores, "b", mapping).collect()
    assert sum(r["current_share"] for r in shift) == pytest.approx(1.0)
    assert sum(r["delta"] for r in shift) == pytest.approx(0.0, abs=1e-12)


def test_backtests(spark, P):
    scores = evaluate.score_candidates(forecast.fc_persistence(P).unionByName(forecast.fc_glide(P, (0.3,))))
    sizes = P.select("season", "period_ix").distinct().withColumn("n", F.lit(10).cast("long"))
    rolling = evaluate.backtest_rolling(scores, sizes, "glide(0.3)").collect()
    assert sorted((r["season"], r["period_ix"]) for r in rolling) == [("a", 4), ("a", 5), ("b", 2), ("b", 3)]
    out = {r["season"]: r["n"] for r in evaluate.backtest_season_out(scores, sizes, "glide(0.3)").collect()}
    assert out == {"a": 60, "b": 40}


def test_histogram_domain_and_kl(spark):
    rows = spark.createDataFrame([(0, 1.0), (0, 1.0), (1, 2.0)], "anchor int, weight double")
    got = [r["p"] for r in dists.anchor_histogram(rows, 4).orderBy("anchor").collect()]
    assert got == pytest.approx([3 / 8, 3 / 8, 1 / 8, 1 / 8])
    p = dists.anchor_histogram(rows, 4)
    assert abs(dists.kl_divergence(p, p).first()["kl"]) < 1e-9


def test_weekly_matrix(spark):
    rows = spark.createDataFrame([("s", "w1", 0, 1.0), ("s", "w1", 1, 1.0), ("s", "w3", 2, 4.0)], "season string, period string, anchor int, weight double")
    got = {(r["period_ix"], r["anchor"]): r["p"] for r in dists.weekly_anchor_matrix(rows.repartition(7), 3).collect()}
    assert len(got) == 6 and got[0, 0] == pytest.approx(2 / 5) and got[1, 2] == pytest.approx(5 / 7)


def test_shift_table_guards_small_shares(spark):
    cur = spark.createDataFrame([(0, 0.995), (1, 0.005)], "unit int, share double")
    nxt = spark.createDataFrame([(0, 0.9), (1, 0.05), (2, 0.05)], "unit int, share double")
    got = {r["unit"]: r for r in dists.shift_table(cur, nxt).collect()}
    assert got[1]["pct_change"] is None and got[2]["current_share"] == 0.0
    assert got[0]["pct_change"] == pytest.approx(-0.095 / 0.995)


def test_decayed_persistence(spark):
    rows = spark.createDataFrame([("s", 0, 0), ("s", 1, 1), ("s", 1, 1)], "season string, period_ix int, anchor int")
    got = [r["p"] for r in forecast.fc_decayed_persistence(rows, 3, decay=0.5).orderBy("anchor").collect()]
    raw = np.array([np.exp(-1.0) + 1, 2 * np.exp(-0.5) + 1, 1.0])
    assert got == pytest.approx(list(raw / raw.sum()))


def _small_matrix(spark, weeks=6, anchors=3, seed=5):
    rng = np.random.default_rng(seed)
    rows = [("s", f"w{t:02d}", a, float(rng.integers(0, 5))) for t in range(weeks) for a in range(anchors)]
    counts = spark.createDataFrame(rows, "season string, period string, anchor int, weight double")
    return counts, dists.weekly_anchor_matrix(counts, anchors), np.array([r[3] for r in rows]).reshape(weeks, anchors)


def test_discounted_sums_of_all_pairs_in_one_scan(spark):
    counts, P, w = _small_matrix(spark)
    params = [(0.4, 1.0), (0.4, 3.0), (1.2, 0.5)]
    got = {(r["cand_ix"], r["period_ix"], r["anchor"]): r["p_hat"] for r in forecast.fc_discounted(P, counts, params).collect()}
    assert len(got) == 3 * 6 * 3
    for i, (decay, smoothing) in enumerate(params):
        for t in range(6):
            mass = sum(w[s] * np.exp(decay * (s - t - 1)) for s in range(t + 1)) + smoothing
            for a in range(3):
                assert got[i, t, a] == pytest.approx(mass[a] / mass.sum(), abs=1e-12)


def test_custom_forecasters_race_beside_the_built_in_ones(spark):
    counts, P, _ = _small_matrix(spark, weeks=7)
    two = P.unionByName(P.withColumn("season", F.lit("t")))
    mean = lambda history, n: history[-n:].mean(axis=0)
    held = forecast.Forecasters().add("mean", mean, [(2,), (4,)]).add("last", lambda h: h[-1], min_history=3)
    assert len(held) == 2
    out = evaluate.all_candidates(two, 0, custom=held)
    last = out.where("family = 'last'")
    assert last.where("period_ix < 2").count() == 0 and last.where("abs(p - p_hat) > 1e-15").count() == 0
    assert {r[0] for r in out.where("family = 'mean'").select("label").distinct().collect()} == {"mean(2)", "mean(4)"}
    scores = evaluate.score_candidates(out)
    race = {r["family"]: r for r in evaluate.horse_race(scores).collect()}
    assert {"mean", "last", "glide", "persistence"} <= set(race) and race["last"]["beats_pct"] == 0.0
    sizes = two.select("season", "period_ix").distinct().withColumn("n", F.lit(1))
    assert evaluate.backtest_rolling(scores, sizes, "mean(2)").count() == 4
    assert evaluate.backtest_season_out(scores, sizes, "mean(4)").count() == 2
    with pytest.raises(ValueError):
        held.add("glide", mean)
    with pytest.raises(ValueError):
        held.add("mean", mean)
    with pytest.raises(Exception, match="anchors"):
        forecast.fc_custom(P, forecast.Forecasters().add("short", lambda h: h[-1][:2])).collect()
