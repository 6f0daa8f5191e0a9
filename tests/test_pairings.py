import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldshift.operators import pairing


def pairs_frame(spark, a, b, y):
    rows = [(i, [float(v) for v in p], [float(v) for v in q], int(l)) for i, (p, q, l) in enumerate(zip(a, b, y))]
    return spark.createDataFrame(rows, "pairing_id long, a array<double>, b array<double>, label int")


def test_antisymmetry_holds_for_any_weights(spark):
    rng = np.random.default_rng(0)
    g = rng.normal(size=(4, 4))
    model = pairing.PairModel(tuple(rng.normal(size=4)), tuple(map(tuple, g - g.T)))
    df = pairs_frame(spark, rng.normal(size=(9, 4)), rng.normal(size=(9, 4)), [0] * 9)
    got = df.select(
        (model.win_prob(F.col("a"), F.col("b")) + model.win_prob(F.col("b"), F.col("a"))).alias("s"),
        model.win_prob(F.col("a"), F.col("a")).alias("h"),
    ).collect()
    assert all(abs(r["s"] - 1) < 1e-12 and abs(r["h"] - 0.5) < 1e-12 for r in got)


def test_strength_and_interactions_are_recovered(spark):
    rng = np.random.default_rng(1)
    a, b = rng.normal(size=(2000, 3)), rng.normal(size=(2000, 3))
    df = pairs_frame(spark, a, b, ((a - b) @ [2.0, -1.0, 0.5] > 0)).persist()
    fitted = pairing.fit_strength(df)
    scored = pairing.win_probability(df, fitted)
    got = {r["method"]: r for r in pairing.pairing_metrics(scored).collect()}
    assert got["model"]["accuracy"] > 0.95 and got["model"]["auc"] > 0.98 and got["coin flip"]["brier"] == 0.25
    spin = a[:, 0] * b[:, 1] - a[:, 1] * b[:, 0]
    turn = pairs_frame(spark, a, b, spin > 0)
    line = pairing.pairing_metrics(pairing.win_probability(turn, pairing.fit_strength(turn))).first()
    cross = pairing.pairing_metrics(pairing.win_probability(turn, pairing.fit_interactions(turn))).first()
    assert line["accuracy"] < 0.6 < 0.9 < cross["accuracy"]


def test_auc_with_ties_matches_counting(spark):
    rng = np.random.default_rng(2)
    p = np.concatenate([np.round(rng.random(300), 2), np.full(200, 0.5)])  # a hot score
    y = (rng.random(500) < p).astype(int)
    df = spark.createDataFrame([(float(s), int(l)) for s, l in zip(p, y)], "win_prob double, label int")
    pos, neg = p[y == 1], p[y == 0]
    want = ((pos[:, None] > neg[None]).sum() + 0.5 * (pos[:, None] == neg[None]).sum()) / (len(pos) * len(neg))
    assert pairing.auc(df.repartition(6)).first()["auc"] == pytest.approx(want, abs=1e-12)


def test_split_is_exact_and_stable(spark):
    df = spark.range(1003).withColumnRenamed("id", "pairing_id")
    one = pairing.train_val_split(df).where("is_val")
    assert one.count() == 150
    again = pairing.train_val_split(df.repartition(9)).where("is_val")
    assert one.select("pairing_id").exceptAll(again.select("pairing_id")).count() == 0


def test_field_rates_matrix_and_graph(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(12, 3))
    unit = ["u", "v", "w"] * 4
    df = spark.createDataFrame([(i, unit[i], [float(v) for v in x[i]]) for i in range(12)], "roster_id long, unit string, embedding array<double>")
    g = rng.normal(size=(3, 3))
    model = pairing.PairModel(tuple(rng.normal(size=3)), tuple(map(tuple, g - g.T)))
    w, G = np.array(model.weights), np.array(model.gain)
    logit = (x @ w)[:, None] - (x @ w)[None] + x @ G @ x.T
    prob = 1 / (1 + np.exp(-logit))
    groups = {u: [i for i in range(12) if unit[i] == u] for u in "uvw"}
    got = {(r["roster_id"], r["unit"]): r["win_rate"] for r in pairing.expected_winrate(df, pairing.Field.load(df), model).collect()}
    for i in range(12):
        for u, idx in groups.items():
            assert got[i, u] == pytest.approx(prob[i, idx].mean())
    matrix = pairing.advantage_matrix(df, model)
    M = {(r["unit_a"], r["unit_b"]): r["win_prob"] for r in matrix.collect()}
    assert M["u", "u"] == 0.5 and M["u", "v"] == pytest.approx(prob[np.ix_(groups["u"], groups["v"])].mean())
    assert M["u", "v"] + M["v", "u"] == pytest.approx(1.0)
    shares = spark.createDataFrame([("u", 0.5), ("v", 0.3), ("w", 0.2)], "unit string, share double")
    nodes = {r["unit"]: r["field_winrate"] for r in pairing.advantage_nodes(matrix, shares).collect()}
    assert nodes["u"] == pytest.approx((0.3 * M["u", "v"] + 0.2 * M["u", "w"]) / 0.5)
    edges = {(r["source"], r["target"]) for r in pairing.advantage_edges(matrix, shares).collect()}
    assert edges == {k for k, v in M.items() if v > 0.53 and k[0] != k[1]}


def _worlds(spark, n, opponents, units, width=4):
    rng = np.random.default_rng(9)
    mine = [(i, rng.normal(size=width).tolist()) for i in range(n)]
    theirs = [(f"u{i % units:05d}", rng.normal(size=width).tolist()) for i in range(opponents)]
    gain = rng.normal(size=(width, width))
    model = pairing.PairModel(tuple(rng.normal(size=width)), tuple(map(tuple, gain - gain.T)))
    field = spark.createDataFrame(theirs, "unit string, embedding array<double>")
    return spark.createDataFrame(mine, "roster_id long, embedding array<double>"), field, model, mine, theirs


def test_field_of_a_hundred_thousand_opponents(spark, monkeypatch):
    """More opponents than the driver may hold: partial sums over blocks, equal to numpy."""
    monkeypatch.setattr(pairing, "FIELD_BYTES", 1 << 20)
    monkeypatch.setattr(pairing, "ROSTER_BLOCK", 8 * 4 * 16)
    rosters, samples, model, mine, theirs = _worlds(spark, 40, 100_000, 700)
    field = pairing.Field.load(samples)
    assert isinstance(field, pairing.FieldTable) and len(field.numbers) >= 3
    got = {(r[0], r[1]): r[2] for r in pairing.expected_winrate(rosters, field, model).collect()}
    assert len(got) == 40 * 700
    points = np.array([v for _, v in theirs])
    w, gain = np.array(model.weights), np.array(model.gain)
    for i, x in mine[::7]:
        p = 1 / (1 + np.exp(-((np.array(x) @ w) - points @ w + (np.array(x) @ gain) @ points.T)))
        for u in (0, 13, 699):
            assert got[i, f"u{u:05d}"] == pytest.approx(p[u::700].mean(), abs=1e-12)


def test_field_table_agrees_with_held_field(spark):
    rosters, samples, model, _, _ = _worlds(spark, 30, 200, 7)
    held, table = pairing.Field.load(samples), pairing.Field.load(samples, max_bytes=100)
    shares = spark.createDataFrame([(f"u{i:05d}", 0.1 * i, 0.3) for i in range(9)], "unit string, now double, next double")
    near = lambda df: sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.collect())
    for f in (
        lambda x: pairing.expected_winrate(rosters, x, model),
        lambda x: pairing.worst_matchups(rosters, x, model, 3),
        lambda x: pairing.weighted_rates(rosters, x, shares, {"a": "now", "b": "next"}, model),
        lambda x: pairing.weighted_rates(rosters, x, shares.where("unit = 'none'"), {"a": "now"}, model),
    ):
        assert near(f(held)) == near(f(table))
    with pytest.raises(ValueError):
        pairing.Field.load(samples.limit(0))


def test_completion_matches_brute_force(spark):
    """Every addition is re-pooled and re-scored from scratch by a fitted interaction model, with and without a held vocabulary."""
    from fieldshift.operators.codebook import feature_stats
    from fieldshift.operators.recommend import recommend_completions

    rng = np.random.default_rng(6)
    names = [f"s{i}" for i in range(9)]
    rows = []
    for r in range(20):
        for slot, i in enumerate(rng.choice(9, size=6, replace=False)):
            moves = [f"m{k}" for k in rng.choice(8, size=4, replace=False)]
            rows.append((r, slot + 1, names[i], f"it{rng.integers(3)}", f"ab{rng.integers(2)}", moves, "n"))
    schema = "roster_id long, slot int, species string, item string, ability string, moves array<string>, nature string"
    corpus = spark.createDataFrame(rows, schema)
    mine = [(100, 1, "s0", "", "ab0", ["m0", "m1", "m2", "m3"], "n"), (100, 2, "s1", "it0", None, ["m5"], "n")]
    mine += [(101, i + 1, f"s{i + 2}", "it1", "ab1", ["m0", "m1", "m2", "m7"], "n") for i in range(6)]
    dim = spark.createDataFrame([(n, [], 1) for n in names], "id string, types array<string>, hp int")
    words = ["base_stat:hp:1", "ability:ab0", "ability:ab1", "nature:n", "item:unknown"] + [f"item:it{i}" for i in range(3)] + [f"move:m{i}" for i in range(8)]
    vec = {w: rng.normal(size=3) for w in words}
    vectors = spark.createDataFrame([(w, v.tolist()) for w, v in vec.items()], "token string, vec array<double>")

    def pooled(team):
        toks = []
        for _, _, _, item, ability, moves, nature in team:
            toks += ["base_stat:hp:1", f"item:{item or 'unknown'}", f"ability:{ability or 'unknown'}", f"nature:{nature}"] + [f"move:{m}" for m in moves]
        return np.sum([vec.get(t, np.zeros(3)) for t in toks], axis=0) / len(toks)

    teams = {}
    for row in rows:
        teams.setdefault(row[0], []).append(row)
    raw = np.array([pooled(t) for t in teams.values()])
    mean, std = raw.mean(axis=0), raw.std(axis=0)
    frame = feature_stats(spark.createDataFrame([(v.tolist(),) for v in raw], "embedding array<double>"))
    z = (raw - mean) / std
    truth = z @ np.array([0.5, -0.3, 0.2]) + z[:, 0] * z[:, 1]
    games = [(z[i].tolist(), z[j].tolist(), int(truth[i] + rng.normal() > truth[j])) for i in range(20) for j in range(20) if i != j]
    model = pairing.fit_interactions(spark.createDataFrame(games, "a array<double>, b array<double>, label int"))
    w, gain = np.array(model.weights), np.array(model.gain)
    assert np.abs(gain).max() > 0.01
    opp = spark.createDataFrame([(f"f{i % 4}", rng.normal(size=3).tolist()) for i in range(24)], "family string, embedding array<double>")
    field = pairing.Field.load(opp, "family")
    fams = {}
    for r in opp.collect():
        fams.setdefault(r[0], []).append(np.array(r[1]))

    def rate(team, f):
        x = (pooled(team) - mean) / std
        return np.mean([1 / (1 + np.exp(-(w @ (x - y) + x @ gain @ y))) for y in fams[f]])

    target = spark.createDataFrame(mine, schema)
    got = recommend_completions(target, dim, vectors, frame, model, field, corpus, ("hp",)).collect()
    joined = recommend_completions(target, dim, vectors, frame, model, field, corpus, ("hp",), max_bytes=0).collect()
    key = lambda r: (r["roster_id"], r["slot"], r["rank"])
    for one, two in zip(sorted(got, key=key), sorted(joined, key=key), strict=True):
        assert key(one) == key(two) and one["winrate_vs_worst"] == pytest.approx(two["winrate_vs_worst"], abs=1e-12)
    team = mine[:2]
    worst = sorted(fams, key=lambda f: rate(team, f))[:3]
    mean_rate = lambda t: np.mean([rate(t, f) for f in worst])
    base = mean_rate(team)
    counts = {}
    for row in rows:
        counts.setdefault((row[2], row[3], row[4], tuple(sorted(row[5]))), []).append(row)
    pool = [v[0] for k, v in sorted(counts.items(), key=lambda kv: (-len(kv[1]), kv[0]))[:150]]
    options = sorted((mean_rate(team + [m]) for m in pool if m[2] not in ("s0", "s1")), reverse=True)[:5]
    added = sorted((r["rank"], r["winrate_vs_worst"]) for r in got if r["slot"] == "member")
    assert [v for _, v in added] == pytest.approx(options, abs=1e-9)
    tried = {"item on s0 1": lambda o: [(*mine[0][:3], o, *mine[0][4:]), mine[1]], "ability on s1 2": lambda o: [mine[0], (*mine[1][:4], o, *mine[1][5:])]}
    tried["move on s1 2"] = lambda o: [mine[0], (*mine[1][:5], mine[1][5] + [o], "n")]
    for slot, changed in tried.items():
        held = [r for r in got if r["slot"] == slot]
        assert held and [r["rank"] for r in sorted(held, key=key)] == list(range(1, len(held) + 1))
        for r in held:
            v = mean_rate(changed(r["label"]))
            assert r["winrate_vs_worst"] == pytest.approx(v, abs=1e-9) and r["delta"] == pytest.approx(v - base, abs=1e-9)
            assert [x["family"] for x in r["per_family"]] == worst
            assert [x["rate"] for x in r["per_family"]] == pytest.approx([rate(changed(r["label"]), f) for f in worst], abs=1e-9)
            assert [x["base"] for x in r["per_family"]] == pytest.approx([rate(team, f) for f in worst], abs=1e-9)
    assert "m5" not in {r["label"] for r in got if r["slot"] == "move on s1 2"}
    assert {r["slot"] for r in got} == {"member", *tried} and {r["roster_id"] for r in got} == {100}
    more = recommend_completions(target, dim, vectors, frame, model, field, corpus, ("hp",), full_moves=5).collect()
    assert "move on s0 1" in {r["slot"] for r in more}


def test_first_step_model_is_the_gradient_at_zero(spark):
    rng = np.random.default_rng(8)
    a, b = rng.normal(size=(40, 3)), rng.normal(size=(40, 3))
    y = rng.integers(0, 2, 40)
    pairs = spark.createDataFrame([(a[i].tolist(), b[i].tolist(), int(y[i])) for i in range(40)], "a array<double>, b array<double>, label int")
    model = pairing.first_step_model(pairs, rate=2.0)
    sign = np.where(y == 1, 1.0, -1.0)
    assert np.allclose(model.weights, (sign[:, None] * (a - b)).mean(axis=0))
    gain = np.einsum("n,ni,nj->ij", sign, a, b) / 40
    assert np.allclose(np.array(model.gain), gain - gain.T)




def test_split_does_not_move_pairs(spark):
    pairs = spark.range(500).withColumnRenamed("id", "pairing_id").withColumn("a", F.array(F.lit(1.0)))
    out = pairing.train_val_split(pairs, 0.15)
    assert out.where("is_val").count() == 75 and out.count() == 500 and out.columns == ["pairing_id", "a", "is_val"]
    assert "Window" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert pairing.train_val_split(pairs, 0.0).where("is_val").count() == 0
    assert pairing.train_val_split(pairs, 1.0).where("is_val").count() == 500


def test_series_rates_stay_within_their_error():
    from fieldshift.operators.recommend import SCREEN, series_rates

    rng = np.random.default_rng(11)
    errors = []
    for scale in (0.05, 1.0, 8.0):
        mine, gain, constant = scale * rng.normal(size=(50, 6)) * 20, scale * rng.normal(size=(30, 6)) * 4, rng.normal(size=6)
        count = rng.integers(5, 40, 50).astype(float)
        got, error = series_rates(mine, count, gain, 7.0, constant)
        logit = (mine[:, None, :] + gain[None]) / (count[:, None, None] + 7.0) + constant
        want = (1 / (1 + np.exp(-logit))).mean(axis=2)
        assert (np.abs(got - want).max(axis=1) <= error).all()
        errors.append(error.max())
    assert errors[0] < SCREEN < errors[2]


@pytest.mark.parametrize("scale", [0.05, 30.0])
def test_completion_scores_gaps_without_multiplying_rosters(spark, scale):
    """Weak models are screened by series, strong ones cell by cell; either way the best members are those of a search of all."""
    from fieldshift.operators.recommend import recommend_completions

    rng = np.random.default_rng(12)
    schema = "roster_id long, slot int, species string, item string, ability string, moves array<string>, nature string"
    # each species has one configuration, so that a candidate is a species
    kind = {f"s{i}": (f"it{i % 4}", f"ab{i % 3}", [f"m{j}" for j in rng.choice(9, size=2 + i % 3, replace=False)]) for i in range(30)}
    corpus = [(r, k + 1, s, *kind[s], "n") for r in range(40) for k, s in enumerate(rng.choice(sorted(kind), size=6, replace=False))]
    mine = [(r, k + 1, s, *kind[s], "n") for r in range(100, 112) for k, s in enumerate(rng.choice(sorted(kind), size=1 + r % 5, replace=False))]
    dim = spark.createDataFrame([(s, [], 1) for s in kind], "id string, types array<string>, hp int")

    def tokens(s):
        item, ability, moves = kind[s]
        return ["base_stat:hp:1", f"item:{item}", f"ability:{ability}", "nature:n"] + [f"move:{m}" for m in moves]

    vec = {t: rng.normal(size=4) for t in sorted({t for s in kind for t in tokens(s)})}
    vectors = spark.createDataFrame([(t, v.tolist()) for t, v in vec.items()], "token string, vec array<double>")
    frame = spark.createDataFrame([([0.1] * 4, [0.5] * 4)], "mean array<double>, std array<double>")
    g = rng.normal(size=(4, 4)) * scale
    model = pairing.PairModel(tuple((rng.normal(size=4) * scale).tolist()), tuple(map(tuple, (g - g.T).tolist())))
    opponents = [(f"f{i % 4}", rng.normal(size=4).tolist()) for i in range(24)]
    field = pairing.Field.load(spark.createDataFrame(opponents, "family string, embedding array<double>"), "family")
    frames = [spark.createDataFrame(x, schema) for x in (mine, corpus)]
    out = recommend_completions(frames[0], dim, vectors, frame, model, field, frames[1], ("hp",))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and plan.count("Join") == 1  # the dimension's

    def rate(species, f):
        toks = [t for s in species for t in tokens(s)]
        x = (np.sum([vec[t] for t in toks], axis=0) / len(toks) - 0.1) / 0.5
        w, gain = np.array(model.weights), np.array(model.gain)
        return np.mean([1 / (1 + np.exp(-(w @ (x - np.array(y)) + x @ gain @ np.array(y)))) for u, y in opponents if u == f])

    got = {}
    for r in out.collect():
        if r["slot"] == "member":
            got.setdefault(r["roster_id"], {})[r["rank"]] = (r["label"], r["winrate_vs_worst"])
    assert set(got) == {r[0] for r in mine}
    seen = {r[2] for r in corpus}
    for roster, found in got.items():
        team = [r[2] for r in mine if r[0] == roster]
        worst = sorted((f"f{i}" for i in range(4)), key=lambda f: (round(rate(team, f), 12), f))[:3]
        best = sorted((-round(np.mean([rate([*team, s], f) for f in worst]), 12), f"{s} @ {kind[s][0]}") for s in seen - set(team))[:5]
        assert [found[k][1] for k in range(1, 6)] == pytest.approx([-v for v, _ in best], abs=1e-9)
        if scale < 1:
            assert [found[k][0] for k in range(1, 6)] == [label for _, label in best]
