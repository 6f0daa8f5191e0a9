import itertools
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from fieldshift.functions.draws import draw, lowest_draws, numbered
from fieldshift.functions.simplex import alr, inv_alr, softmax
from fieldshift.functions.vectors import unit_length
from fieldshift.operators import codebook as cb
from fieldshift.operators import contexts, neighbors


def frame(spark, matrix, key="row_id"):
    return spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(matrix)], f"{key} long, embedding array<float>")


def test_standardize_population_and_floor(spark):
    x = np.array([[1.0, 5.0, 2.0], [3.0, 5.0, 4.0], [5.0, 5.0, 9.0]])
    df = frame(spark, x)
    out = np.array([r["embedding"] for r in cb.standardize(df, cb.feature_stats(df.repartition(3))).orderBy("row_id").collect()])
    assert np.allclose(out.mean(0), 0) and np.allclose(out[:, [0, 2]].std(0), 1) and np.allclose(out[:, 1], 0)


def test_nearest_breaks_ties_low_and_keeps_distance(spark):
    book = spark.createDataFrame([("unit", 3, [0.0, 0.0]), ("unit", 1, [2.0, 0.0])], "kind string, id int, vec array<double>")
    units = cb.Centroids.load(book, "unit")
    got = cb.assign_codebook(frame(spark, [[1, 0], [0, 1], [5, 0]]), units, distance="d").orderBy("row_id").collect()
    assert [(r["unit"], round(r["d"], 6)) for r in got] == [(1, 1.0), (3, 1.0), (1, 3.0)]
    with pytest.raises(ValueError):
        cb.Centroids.load(book, "unit", max_bytes=8)


def test_fit_scores_and_fingerprint(spark):
    rng = np.random.default_rng(0)
    book = spark.createDataFrame([("unit", i, [float(v) for v in rng.normal(size=4)]) for i in range(12)], "kind string, id int, vec array<double>")
    units = cb.Centroids.load(book, "unit")
    x = rng.normal(size=(5, 4))
    got = cb.fingerprint(frame(spark, x, "roster_id"), units, top=8, temperature=2.0).collect()
    assert len(got) == 40
    for i in range(5):
        d = np.linalg.norm(x[i].astype(np.float32) - units.matrix, axis=1)
        e = np.exp(-d / 2) / np.exp(-d / 2).sum()
        mine = sorted([r for r in got if r["roster_id"] == i], key=lambda r: r["rank"])
        assert [r["unit"] for r in mine] == list(np.argsort(-e)[:8])
        assert np.allclose([r["fit"] for r in mine], np.sort(e)[::-1][:8])


def test_three_representative_rules_differ(spark):
    points = [[0.0, 0.0], [1.0, 0.0], [5.0, 0.0], [10.0, 0.0], [10.5, 0.0]]
    df = frame(spark, points).withColumn("unit", F.when(F.col("row_id") < 3, 0).otherwise(1))
    by_mean = {r["unit"]: (r["representative_id"], r["unit_size"]) for r in cb.representatives_by_mean(df).collect()}
    assert by_mean == {0: (1, 3), 1: (3, 2)}
    book = spark.createDataFrame([("unit", 0, [4.0, 0.0]), ("unit", 1, [11.0, 0.0]), ("unit", 2, [-9.0, 0.0])], "kind string, id int, vec array<double>")
    units = cb.Centroids.load(book, "unit")
    pooled = {r["unit"]: r["row_id"] for r in cb.representatives_pooled(df.repartition(4), units, ("row_id",)).collect()}
    assert pooled == {0: 2, 1: 4, 2: 0}
    mapping = spark.createDataFrame([(7, 0), (8, 1)], "anchor int, unit int")
    anchored = df.withColumn("anchor", F.when(F.col("row_id") < 2, 7).otherwise(8)).drop("unit")
    current = {r["unit"]: r["representative_id"] for r in cb.representatives_current(anchored, mapping, units).collect()}
    assert current == {0: 1, 1: 4}


def brute(x, k, metric):
    x = x.astype(np.float32).astype(float)
    if metric == "cosine":
        n = np.linalg.norm(x, axis=1, keepdims=True)
        u = x / np.where(n < 1e-8, 1, n)
        d = 1 - u @ u.T
    else:
        d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    out = []
    for i in range(len(x)):
        others = sorted((round(d[i, j], 9), j) for j in range(len(x)) if j != i)
        out.append([j for _, j in others[:k]])
    return out


@pytest.mark.parametrize("metric", ["cosine", "euclidean"])
def test_knn_matches_brute_force_with_hot_copies(spark, metric, monkeypatch):
    monkeypatch.setattr(neighbors, "BLOCK_BYTES", 8 * 8 * 5)  # some eight vectors a block
    staged = {}
    keep = neighbors.stage
    monkeypatch.setattr(neighbors, "stage", lambda df, name: staged.setdefault(name, df.columns) and keep(df, name))
    rng = np.random.default_rng(1)
    x = rng.normal(size=(90, 5))
    x[30:60] = x[0]  # a third of all rows are copies of one vector
    got = {}
    for r in neighbors.knn_exact(frame(spark, x).repartition(6), 4, metric).collect():
        got.setdefault(r["id"], {})[r["neighbor_rank"]] = r["neighbor_id"]
    want = brute(x, 4, metric)
    assert [[got[i][k] for k in range(1, 5)] for i in range(90)] == want
    assert staged["knn-visits"] == ["g", "cell", "block", "other", "gap", "nth"]  # ids only, no vector


def test_knn_visits_shrink_and_pivots_are_bounded(spark, monkeypatch):
    """Clustered data: most cells are never visited; a small byte limit for pivots leaves the result as it is."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(20, 4))[rng.integers(0, 20, 400)] * 20 + rng.normal(size=(400, 4)) * 0.1
    visits = {}
    keep = neighbors.stage

    def counted(df, name):
        out = keep(df, name)
        visits[name] = visits.get(name, 0) + (out.count() if name == "knn-visits" else 0)
        return out

    monkeypatch.setattr(neighbors, "stage", counted)
    first = sorted(map(tuple, neighbors.knn_exact(frame(spark, x), 3, "euclidean").collect()))
    assert visits["knn-visits"] < 400 * 20 / 3
    monkeypatch.setattr(neighbors, "PIVOT_BYTES", 8 * 4 * 3)
    again = sorted(map(tuple, neighbors.knn_exact(frame(spark, x), 3, "euclidean").collect()))
    assert [r[:3] for r in first] == [r[:3] for r in again]


def test_knn_small_corpus_and_approximate_recall(spark):
    x = np.random.default_rng(2).normal(size=(40, 3))
    exact = neighbors.knn_exact(frame(spark, x), 5, "cosine")
    assert exact.count() == 200
    few = neighbors.knn_exact(frame(spark, x[:3]), 5, "euclidean")
    assert few.count() == 6


def test_knn_approx_reaches_its_recall_and_reports_it(spark, monkeypatch):
    monkeypatch.setattr(neighbors, "BLOCK_BYTES", 8 * 9 * 40)  # some forty of 1,200 vectors a block
    rng = np.random.default_rng(4)
    x = rng.normal(size=(60, 8))[rng.integers(0, 60, 1200)] + rng.normal(size=(1200, 8)) * 0.3
    x[:300] = x[0]  # copies are searched once and never crowd a block
    df = frame(spark, x)
    out = neighbors.knn_approx(df, 5, "cosine", sample=100)
    exact = neighbors.knn_exact(df, 5, "cosine")
    measured = neighbors.recall(out.neighbors, exact).first()["recall"]
    assert out.recall >= 0.9 and measured >= 0.85 and out.sampled == 100
    assert out.neighbors.count() == 6000
    with pytest.raises(ValueError):
        neighbors.knn_approx(df, 5, "cosine", recall=1.01, step=2, most=2)


@pytest.mark.parametrize("metric", ["cosine", "euclidean"])
def test_knn_of_some_rows_among_all(spark, metric, monkeypatch):
    """Queries against all rows, in many blocks and with copies, as by brute force; a null flag is no query."""
    monkeypatch.setattr(neighbors, "BLOCK_BYTES", 8 * 6 * 7)  # some seven vectors a block
    monkeypatch.setattr(neighbors, "HELD_BLOCKS", 2)
    x = np.random.default_rng(11).normal(size=(300, 5))
    x[100:180] = x[0]
    asked = F.when(F.col("row_id") != 5, F.col("row_id") % 5 == 0)
    got = {}
    for r in neighbors.knn_exact(frame(spark, x).repartition(6), 4, metric, queries=asked).collect():
        got.setdefault(r["id"], {})[r["neighbor_rank"]] = r["neighbor_id"]
    want = brute(x, 4, metric)
    assert {i: [v[k] for k in range(1, 5)] for i, v in got.items()} == {i: want[i] for i in range(0, 300, 5) if i != 5}


def test_knn_approx_of_some_rows_checks_every_query(spark, monkeypatch):
    """Recall is that of all queries, and only they search; a table moves the vectors once."""
    monkeypatch.setattr(neighbors, "BLOCK_BYTES", 8 * 9 * 40)
    rng = np.random.default_rng(4)
    x = rng.normal(size=(60, 8))[rng.integers(0, 60, 1200)] + rng.normal(size=(1200, 8)) * 0.3
    x[:300] = x[0]
    df = frame(spark, x)
    asked = F.col("row_id") % 3 == 0
    out = neighbors.knn_approx(df, 5, "cosine", sample=50, queries=asked)
    exact = neighbors.knn_exact(df, 5, "cosine", queries=asked)
    assert out.recall >= 0.9 and out.sampled == 301 and neighbors.recall(out.neighbors, exact).first()["recall"] >= 0.85
    assert {r["id"] for r in out.neighbors.select("id").distinct().collect()} == set(range(0, 1200, 3))
    space = neighbors._groups(df, "row_id", "cosine", asked)
    plan = neighbors._table_hits(space, np.ones((1, 8, 9)), np.zeros((1, 8)), 0, 5)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1


def test_unit_length_and_simplex(spark):
    df = spark.createDataFrame([([3.0, 4.0], [0.2, 0.3, 0.5]), ([0.0, 0.0], [0.1, 0.1, 0.8])], "v array<double>, p array<double>")
    got = df.select(unit_length(F.col("v")).alias("u"), inv_alr(alr(F.col("p"), 1), 1).alias("b"), softmax(F.col("v")).alias("s"), "p").collect()
    assert got[0]["u"] == pytest.approx([0.6, 0.8]) and got[1]["u"] == [0.0, 0.0]
    for r in got:
        assert r["b"] == pytest.approx(r["p"], abs=1e-12) and sum(r["s"]) == pytest.approx(1.0)


def test_numbered_and_first_k_match_plain_windows(spark):
    df = spark.range(4000).select(F.col("id"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("g"), F.col("id") % 7)).alias("g"))
    df = df.withColumn("d", draw(1, F.col("id")))
    plain = df.withColumn("n", F.row_number().over(Window.partitionBy("g").orderBy("d", "id")))
    mine = numbered(df.repartition(5), ["g"], [F.substring("d", 1, 2)], [F.col("d"), F.col("id")], "n")
    assert plain.select("id", "n").exceptAll(mine.select("id", F.col("n").cast("int"))).count() == 0
    cut = lowest_draws(df, ["g"], F.col("d"), "id", 1200)
    assert cut.select("id").exceptAll(plain.where("n <= 1200").select("id")).count() == 0
    assert cut.count() == plain.where("n <= 1200").count()


@pytest.mark.parametrize("full", [1.0, 0.0])
def test_context_sets_never_leak(spark, full):
    rows = [(s * 1000 + p * 100 + i, f"s{s}", p) for s in range(2) for p in range(5) for i in range(12)]
    df = spark.createDataFrame(rows, "row_id long, season string, period_ix int")
    sets = contexts.context_sets(df, full_mask_prob=full, budgets=(8,)).collect()
    by = {}
    for r in sets:
        assert r["context_id"] != r["row_id"] and r["context_id"] // 1000 == r["row_id"] // 1000 and r["weeks_ago"] <= 0
        by.setdefault(r["row_id"], []).append(r)
    assert set(by) == {r[0] for r in rows if r[2] >= 1}
    for got in by.values():
        assert len(got) == 8 and len({r["context_id"] for r in got}) == 8
        assert full == 0.0 or not any(r["is_current"] for r in got)
    assert full == 1.0 or any(r["is_current"] for r in sets)


def test_trained_codebook_is_no_worse_than_label_means(spark):
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(size=(40, 3)) + c for c in ([0, 0, 0], [8, 0, 0], [0, 8, 0])])
    df = frame(spark, x)
    book = cb.fit_units(df, k=3, restarts=3)
    cost = cb.assign_codebook(df, cb.Centroids.load(book, "unit"), distance="d").agg(F.sum(F.col("d") ** 2)).first()[0]
    means = sum(((x[i : i + 40] - x[i : i + 40].mean(0)) ** 2).sum() for i in (0, 40, 80))
    assert cost <= means * 1.01
    assert cb.fit_anchors(df.limit(5), k=128, restarts=1).count() == 5


def test_restarts_share_their_scans(spark, monkeypatch):
    """Each restart ends where it would end alone; together they scan as often as the slowest, not as often as all."""
    rng = np.random.default_rng(6)
    x = rng.normal(size=(300, 3))
    df = frame(spark, x).repartition(4).persist()
    scans = []
    whole = cb.centre_sums
    monkeypatch.setattr(cb, "centre_sums", lambda rows, centres: scans.append(len(centres)) or whole(rows, centres))

    def lloyd(centres):
        for n in range(1, 300):
            best = ((x.astype(np.float32)[:, None] - centres[None]) ** 2).sum(-1).argmin(1)
            moved = np.array([x.astype(np.float32)[best == i].mean(0) if (best == i).any() else centres[i] for i in range(len(centres))], float)
            if np.abs(moved - centres).max() < 1e-9:
                return centres, n
            centres = moved

    alone, counts = [], []
    for i in range(4):
        alone.append(cb.Centroids.load(cb.fit_centroids(df, 6, "unit", seed=7 + i, restarts=1), "unit").matrix)
        counts.append(len(scans))
        scans.clear()
    book = cb.Centroids.load(cb.fit_centroids(df, 6, "unit", seed=7, restarts=4), "unit").matrix
    assert len(scans) == max(counts) < sum(counts) and sum(scans) == sum(counts)
    cost = lambda c: ((x.astype(np.float32)[:, None] - c[None]) ** 2).sum(-1).min(1).sum()
    costs = [cost(c) for c in alone]
    assert np.allclose(book, alone[int(np.argmin(costs))])
    for c in alone:
        assert np.allclose(lloyd(c)[0], c, atol=1e-6)  # settled


def test_word_vectors_do_not_depend_on_member_order(spark):
    base = [(r, s, 0, f"t{(r * 7 + s) % 5}") for r in range(30) for s in range(3)]
    twin = [(99, 0, 0, "t1"), (99, 1, 0, "t2"), (98, 0, 0, "t2"), (98, 1, 0, "t1")]
    toks = spark.createDataFrame(base + twin, "roster_id long, slot int, pos int, token string")
    rosters, words = cb.embed_rosters(toks, size=8)
    got = {r["roster_id"]: np.array(r["embedding"]) for r in rosters.collect()}
    assert np.allclose(got[98], got[99]) and words.count() == 5


def test_context_sets_are_independent_between_targets(spark):
    """2,000 targets of one period, 64 of 1,999 each: a pair of contexts meets about twice, never often."""
    df = spark.createDataFrame([(i, "s", i // 2000) for i in range(4000)], "row_id long, season string, period_ix long")
    sets = contexts.context_sets(df, full_mask_prob=0.0, budgets=(64,), min_prev_periods=1)
    current = sets.where("is_current").select("row_id", "context_id")
    other = current.withColumnRenamed("context_id", "other_id")
    pairs = current.join(other, "row_id").where("context_id < other_id").groupBy("context_id", "other_id").count()
    assert pairs.agg({"count": "max"}).first()[0] <= 16
    sizes = sets.groupBy("row_id").count().select("count").distinct().collect()
    assert [r[0] for r in sizes] == [64]


def test_pairing_vectors_join_ids_before_vectors(spark):
    """The joins below the first join with vectors carry ids alone."""
    from fieldshift.catalog import roles

    sf = "/root/testdata/sf0.001"
    rows = roles.pairing_vectors(spark, sf, roles.space(spark, sf))
    assert rows.columns == ["pairing_id", "roster_a", "roster_b", "label", "a", "b"]
    lines = rows._jdf.queryExecution().optimizedPlan().toString().splitlines()
    joins = [line for line in lines if "Join" in line]
    assert "roster_" not in joins[0] + joins[1] and all("roster_" in line for line in joins[2:4])


def test_context_sets_write_no_pairs_and_cross_ranges(spark, monkeypatch):
    """Places are looked up where a range's rows meet its targets: no shuffle holds a row per pair, ranges change nothing."""
    df = spark.createDataFrame([(f"r{i}", f"s{i % 2}", i // 300) for i in range(900)], "row_id string, season string, period_ix int")
    sets = contexts.context_sets(df, budgets=(16,))
    assert "Join" not in sets._jdf.queryExecution().optimizedPlan().toString()
    whole = sorted(map(tuple, sets.collect()))
    period = {f"r{i}": (f"s{i % 2}", i // 300) for i in range(900)}
    assert len(whole) == 600 * 16 and all(period[r[0]] == (r[1], r[2]) and period[r[3]] == (r[1], r[2] + r[5]) for r in whole)
    assert all(r[4] == (r[5] == 0) for r in whole)
    by_range = contexts._by_range
    range_ = contexts.RANGE

    def cut(target):
        run = by_range(target)

        def each(batches):
            contexts.RANGE = 64  # in the worker
            yield from run(batches)
            contexts.RANGE = range_

        return each

    monkeypatch.setattr(contexts, "_by_range", cut)
    assert sorted(map(tuple, contexts.context_sets(df, budgets=(16,)).collect())) == whole


def test_arrays_written_and_read_back(spark, tmp_path):
    from fieldshift.sources import arrays
    from fieldshift.sources.tables import read_codebook, write_codebook

    rng = np.random.default_rng(7)
    wide, flat = rng.normal(size=(9000, 3)), rng.normal(size=5)
    np.savez_compressed(tmp_path / "a.npz", wide=wide, flat=flat.astype(np.float32), cube=np.arange(24).reshape(2, 3, 4), one=np.float64(4), text=np.array(["x"]), obj=np.array([{}], dtype=object))
    np.savez(tmp_path / "b.npz", flat=flat, none=np.zeros((0, 2)))
    rows = arrays.read_arrays(spark, f"file://{tmp_path}/*.npz").collect()
    held = {}
    for r in rows:
        held.setdefault((r["path"][-5:], r["name"]), {})[r["row"]] = r["values"]
    assert set(held) == {("a.npz", "wide"), ("a.npz", "flat"), ("a.npz", "cube"), ("a.npz", "one"), ("b.npz", "flat")}
    assert (np.array([held["a.npz", "wide"][i] for i in range(9000)]) == wide).all()
    assert held["b.npz", "flat"] == {0: flat.tolist()} and held["a.npz", "one"] == {0: [4.0]}
    assert held["a.npz", "cube"][1] == [float(x) for x in range(12, 24)]
    with pytest.raises(Exception, match="numeric|pickle"):
        arrays.read_arrays(spark, f"file://{tmp_path}/a.npz", ["obj"]).collect()
    stats = spark.createDataFrame([([1.0, 2.0], [3.0, 4.0])], "mean array<double>, std array<double>")
    kinds = [("unit", i, [float(i), -1.0]) for i in range(3)] + [("anchor", i, [0.5 * i, 2.0]) for i in range(5)]
    kinds += [(f"other{i}", 0, [0.0, 0.0]) for i in range(12)]  # many kinds hide none
    book = spark.createDataFrame(kinds, "kind string, id int, vec array<double>")
    near = lambda df: sorted(map(tuple, df.select("kind", "id", "vec").collect()))
    path = f"file://{tmp_path}/book.npz"
    write_codebook(stats, book, path)
    with np.load(tmp_path / "book.npz") as archive:
        assert archive["feature_mean"].shape == (2,) and archive["anchor_centroids"].shape == (5, 2)
    back = read_codebook(spark, path)
    assert near(back[1]) == sorted(kinds[:8]) and tuple(back[0].first()) == ([1.0, 2.0], [3.0, 4.0])
    write_codebook(stats, book, f"file://{tmp_path}/tables")
    assert near(read_codebook(spark, f"file://{tmp_path}/tables")[1]) == sorted(kinds)
    write_codebook(stats, book.where("kind = 'unit'"), path)
    assert near(read_codebook(spark, path)[1].where("kind = 'anchor'")) == sorted(("anchor", k[1], k[2]) for k in kinds[:3])
    write_codebook(stats, book.where("kind = 'anchor'"), path)
    with pytest.raises(ValueError, match="unit"):
        read_codebook(spark, path)
    with pytest.raises(ValueError, match="bytes"):
        arrays.write_arrays(spark.createDataFrame([("a", 0, [1.0])], "name string, row int, values array<double>"), path, max_bytes=10)


def test_codebook_of_two_hundred_thousand_entries(spark):
    """More entries than are held: assignments equal brute force, ties to the lowest id, most cells unvisited."""
    from fieldshift.operators.large_codebook import CodebookTable, load_codebook

    rng = np.random.default_rng(8)
    hubs = rng.normal(size=(300, 4)) * 10
    centres = hubs[rng.integers(0, 300, 200_000)] + rng.normal(size=(200_000, 4))
    centres[150_000] = centres[5]  # an equal entry with a higher id
    x = hubs[rng.integers(0, 300, 400)] + rng.normal(size=(400, 4))
    x[0], x[1:100] = centres[5], x[300]  # a tie, and copies
    vec = pa.ListArray.from_arrays(pa.array(np.arange(0, 800_001, 4), pa.int32()), pa.array(centres.ravel()))
    book = spark.createDataFrame(pa.table({"kind": ["unit"] * 200_000, "id": pa.array(np.arange(200_000), pa.int32()), "vec": vec})).repartition(8)
    table = load_codebook(book, "unit", max_bytes=1 << 20)
    assert isinstance(table, CodebookTable)
    rows = spark.createDataFrame([(i, v.tolist(), "x") for i, v in enumerate(x)] + [(999, None, "y")], "row_id long, embedding array<double>, g string")
    out = cb.assign_codebook(rows, table, "embedding", "unit", "d")
    assert out.columns == ["row_id", "embedding", "g", "unit", "d"]
    got = {r["row_id"]: (r["unit"], r["d"]) for r in out.collect()}
    assert len(got) == 400
    for i, v in enumerate(x):
        d = np.sqrt(((centres - v) ** 2).sum(axis=1))
        assert got[i][0] == int(d.argmin()) and got[i][1] == pytest.approx(d.min(), abs=1e-9)
    assert got[0] == (5, 0.0)


def test_fingerprint_of_a_large_codebook_equals_the_held_one(spark, monkeypatch):
    from fieldshift.operators.large_codebook import load_codebook

    monkeypatch.setattr(neighbors, "BLOCK_BYTES", 8 * 3 * 10)
    rng = np.random.default_rng(9)
    book = spark.createDataFrame([("unit", i, rng.normal(size=3).tolist()) for i in range(90)], "kind string, id int, vec array<double>")
    rows = spark.createDataFrame([(i, rng.normal(size=3).tolist()) for i in range(40)], "roster_id long, embedding array<double>")
    near = lambda df: sorted((r[0], r[1], r[2], round(r[3], 10), round(r[4], 10)) for r in df.collect())
    table = load_codebook(book, "unit", max_bytes=100)
    assert near(cb.fingerprint(rows, table, top=5)) == near(cb.fingerprint(rows, cb.Centroids.load(book, "unit"), top=5))


def test_roster_embedding_learns_from_every_pair(spark, monkeypatch):
    """Pairs are counted whatever the slices; 300 rosters are enough to part 20 topics."""
    from fieldshift.operators import word_vectors

    rng = np.random.default_rng(0)
    lengths = rng.integers(1, 9, 100)
    ids = rng.integers(0, 7, lengths.sum())
    want = np.zeros((7, 7))
    for part in np.split(ids, np.cumsum(lengths)[:-1]):
        for i, j in itertools.permutations(range(len(part)), 2):
            want[part[i], part[j]] += 1
    for pairs, cells in ((1 << 19, 1 << 22), (3, 1 << 22), (50, 1)):
        monkeypatch.setattr(word_vectors, "PAIRS", pairs)
        monkeypatch.setattr(word_vectors, "CELLS", cells)
        got = np.zeros((7, 7))
        for a, b, n in word_vectors.counted_pairs(ids, lengths, 7):
            np.add.at(got, (a, b), n)
        assert (got == want).all()
    monkeypatch.undo()

    topics = rng.integers(0, 20, 300)
    rows = [
        (r, s, 0, f"t{g if rng.random() > 0.3 else rng.integers(0, 20)}_{rng.integers(0, 15)}")
        for r, g in enumerate(topics.tolist())
        for s in range(12)
    ]
    rosters, words = cb.embed_rosters(spark.createDataFrame(rows, "roster_id long, slot int, pos int, token string"), size=32)
    held = {r["token"]: np.array(r["vec"]) for r in words.collect()}
    names = sorted(held)
    unit = np.array([held[t] / np.linalg.norm(held[t]) for t in names])
    near = unit @ unit.T
    np.fill_diagonal(near, -1)
    topic = np.array([t.split("_")[0] for t in names])
    assert (topic[near.argmax(axis=1)] == topic).mean() > 0.85
    mine = {r["roster_id"]: r["embedding"] for r in rosters.collect()}
    assert all(np.allclose(mine[r], np.mean([held[x[3]] for x in rows if x[0] == r], axis=0)) for r in range(5))


def test_roster_embedding_of_one_token_or_none(spark):
    schema = "roster_id long, slot int, pos int, token string"
    rosters, words = cb.embed_rosters(spark.createDataFrame([(1, 0, 0, "a"), (2, 0, 0, "a"), (2, 1, 0, "a")], schema), size=4)
    assert [len(r["embedding"]) for r in rosters.collect()] == [4, 4] and words.count() == 1
    rosters, words = cb.embed_rosters(spark.createDataFrame([], schema), size=4)
    assert rosters.count() == words.count() == 0


@pytest.mark.parametrize("name", ["knn_exact", "knn_exact_euclidean", "knn_report", "knn_lsh"])
def test_every_vector_is_a_query(spark, name):
    """The registered searches ask for the neighbours of every row, not of some ids."""
    import __spark_entry__ as entry_point

    sf = "/root/testdata/sf0.001"
    rows = entry_point.queries()[name](spark, sf)
    ids = {r["vec_id"] for r in spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id").collect()}
    if name == "knn_lsh":
        assert tuple(rows.first()) == (10 * len(ids), len(ids), True, True)
    elif name == "knn_report":  # only vectors that a roster holds have a text
        held = {r["o_custkey"] % len(ids) for r in spark.read.parquet(f"{sf}/orders.parquet").select("o_custkey").distinct().collect()}
        near = neighbors.knn_exact(spark.read.parquet(f"{sf}/embeddings.parquet"), 5, "euclidean", "vec_id").select("id", "neighbor_id").collect()
        assert {r["id"] for r in rows.collect()} == {r["id"] for r in near if r["id"] in held and r["neighbor_id"] in held}
    else:
        assert sorted(r["id"] for r in rows.collect()) == sorted(i for i in ids for _ in range(10))


def test_knn_by_groups_of_blocks_matches_brute_force(spark, monkeypatch):
    """Many groups, each meeting all others: the same neighbours, and no row holds two blocks."""
    monkeypatch.setattr(neighbors, "BLOCK_BYTES", 8 * 5 * 6)
    monkeypatch.setattr(neighbors, "GROUP_BYTES", 8 * 5 * 60)
    plans = {}
    keep = neighbors.stage
    monkeypatch.setattr(neighbors, "stage", lambda df, name: plans.setdefault(name, df._jdf.queryExecution().optimizedPlan().toString()) and keep(df, name))
    x = np.random.default_rng(8).normal(size=(250, 5))
    x[90:110] = x[3]
    got = {}
    for r in neighbors.knn_exact(frame(spark, x).repartition(5), 4, "euclidean").collect():
        got.setdefault(r["id"], {})[r["neighbor_rank"]] = r["neighbor_id"]
    assert [[got[i][k] for k in range(1, 5)] for i in range(250)] == brute(x, 4, "euclidean")
    assert "points_other" not in plans["knn-near"] + plans["knn-rest"]


def test_fit_units_runs_every_restart_from_all_rows(spark, monkeypatch):
    """The query moves ten restarts, as the reference does, and what they start from is drawn among all rows."""
    import __spark_entry__ as entry_point

    scans = []
    whole = cb.centre_sums
    monkeypatch.setattr(cb, "centre_sums", lambda rows, centres: scans.append(len(centres)) or whole(rows, centres))
    assert tuple(entry_point.queries()["fit_units"](spark, "/root/testdata/sf0.001").first())[3:] == (True, True)
    assert scans[0] == 10
    # a far cluster of 5 among 4,000 rows, of which hardly any small sample holds one
    x = np.random.default_rng(9).normal(size=(4000, 3))
    x[:5] += 500.0
    rows = frame(spark, x).select(F.col("embedding").cast("array<double>").alias("v")).withColumn("n", F.lit(1).cast("long")).withColumn("h", F.xxhash64("v"))
    first = cb.first_centres(rows.repartition(3), 2, [7, 8, 9])
    assert all((centres[:, 0] > 250).sum() == 1 for centres in first)
    assert np.allclose(first, cb.first_centres(rows.repartition(5), 2, [7, 8, 9]))


def test_embed_rosters_moves_no_token_rows(spark, monkeypatch):
    """Tokens are gathered where members were numbered, and neither training nor the check moves them again."""
    import __spark_entry__ as entry_point

    plans = {}
    keep = cb.stage
    monkeypatch.setattr(cb, "stage", lambda df, name: plans.setdefault(name, df._jdf.queryExecution().executedPlan().toString()) and keep(df, name))
    rows = entry_point.queries()["embed_rosters"](spark, "/root/testdata/sf0.001")
    sentences = plans["sentences"].split("== Initial Plan ==")[0]
    assert sentences[: sentences.index("Window")].count("Exchange hashpartitioning(") == 0
    moved = [line for line in rows._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange hashpartitioning(" in line]
    assert len(moved) == 1 and "roster_id" in moved[0]
    assert all(r["is_mean"] and r["dim"] == 32 for r in rows.collect())


def test_context_draws_stop_when_enough(monkeypatch):
    """k of n by the hashes of a key, as if all draws were made; most rows make few more than they need."""
    from hashlib import md5

    def plain(key, k, n):
        few = min(k, n - k)
        if k <= 0 or few <= 0:
            return set(range(n)) if k > 0 else set()
        digests = (md5(f"{key}|{j}".encode()).hexdigest() for j in range((2 * few + contexts.SPARE) // 4 + 1))
        raw = [int(int(d[8 * q : 8 * q + 8], 16) * n / 4294967296.0) for d in digests for q in range(4)]
        got = list(dict.fromkeys(raw))[:few]
        got += [i for i in range(min(n, 2 * few)) if i not in got][: few - len(got)]
        return set(got) if k <= n - k else set(range(n)) - set(got)

    made = []
    monkeypatch.setattr(contexts, "md5", lambda x: made.append(x) or md5(x))
    cases = [(k, n) for n in (0, 1, 2, 3, 7, 65, 130, 5000) for k in (0, 1, 2, 3, 40, 64, 100, 128) if k <= n] * 5
    keys = [f"{i}|0:past" for i in range(len(cases))]
    row, number = contexts.sample_positions([key.encode() for key in keys], *(np.array(x, np.int64) for x in zip(*cases)))
    assert [sorted(number[row == i].tolist()) for i in range(len(cases))] == [sorted(plain(key, *case)) for key, case in zip(keys, cases)]
    made.clear()
    contexts.sample_positions([key.encode() for key in keys], np.full(len(keys), 128), np.full(len(keys), 100_000))
    assert len(made) < 40 * len(keys)  # 69 blocks each in all
