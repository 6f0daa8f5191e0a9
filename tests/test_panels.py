import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldshift.functions.periods import iso_period_of_epoch, periods_ago
from fieldshift.operators import panels, seasons, stats

ROWS = [
    ("2024-W01", "a", True, 1.0, ["A", "B"]),
    ("2024-W01", "a", False, 1.0, ["A"]),
    ("2024-W01", "b", None, 2.0, ["B", None]),
    ("2024-W02", "b", True, 1.0, ["C", "C"]),
    ("2024-W02", "b", False, 3.0, ["A"]),
    ("2024-W02", "b", None, 4.0, []),
]


@pytest.fixture(scope="module")
def frame(spark):
    schema = "period string, unit string, won boolean, weight double, elements array<string>"
    return spark.createDataFrame(ROWS, schema)


def rows(df, *keys):
    return {tuple(r[k] for k in keys): r.asDict() for r in df.collect()}


@pytest.mark.parametrize("parts", [None, 7])
def test_unit_panel(frame, parts):
    df = frame if parts is None else frame.repartition(parts)
    got = rows(panels.unit_panel(df), "period", "unit")
    assert set(got) == {("2024-W01", "a"), ("2024-W01", "b"), ("2024-W02", "b")}
    assert got["2024-W01", "a"]["share"] == 0.5 and got["2024-W01", "a"]["win_rate"] == 0.5
    assert got["2024-W01", "b"]["win_rate"] is None
    assert got["2024-W02", "b"]["n"] == 3 and got["2024-W02", "b"]["win_rate"] == 0.25


def test_element_panel_counts_a_row_once(frame):
    got = rows(panels.element_panel(frame), "period", "element")
    assert got["2024-W02", "C"]["n"] == 1 and got["2024-W02", "C"]["usage"] == 1 / 8
    assert got["2024-W01", "B"]["usage"] == 3 / 4
    assert all(k[1] is not None for k in got)


def test_entropy(frame):
    got = rows(panels.period_entropy(panels.unit_panel(frame)), "period")
    assert got[("2024-W01",)]["entropy_bits"] == pytest.approx(1.0)
    assert got[("2024-W02",)]["entropy_bits"] == pytest.approx(0.0)


def test_drift_and_novelty(spark):
    data = [("w1", [0.0, 0.0]), ("w1", [2.0, 0.0]), ("w2", [4.0, 4.0]), ("w3", [4.0, 4.0]), ("w3", [8.0, 4.0])]
    df = spark.createDataFrame(data, "period string, embedding array<float>")
    drift = rows(panels.centroid_drift(df), "period")
    assert drift[("w2",)]["centroid_drift"] == pytest.approx(5.0) and drift[("w3",)]["prev_period"] == "w2"
    novelty = rows(panels.period_novelty(df), "period")
    assert novelty[("w2",)]["novelty"] == pytest.approx(5.0) and novelty[("w3",)]["novelty"] == pytest.approx(2.0)


def test_iso_year_differs_from_calendar_year(spark):
    df = spark.createDataFrame([(1735516800,), (1704067200,)], "s long")  # 2024-12-30, 2024-01-01
    got = [r[0] for r in df.select(iso_period_of_epoch(F.col("s"))).collect()]
    assert got == ["2025-W01", "2024-W01"]


def test_lags_step_over_rows(spark):
    data = [("w1", "u", 0.1, 0.5), ("w3", "u", 0.3, None), ("w4", "u", 0.6, 0.4)]
    panel = spark.createDataFrame(data, "period string, unit string, share double, win_rate double")
    got = rows(panels.panel_lags(panel), "period")
    assert got[("w3",)]["value_lag1"] == 0.1 and got[("w3",)]["winrate_lag1"] == 0.5
    assert got[("w4",)]["delta_lag1"] == pytest.approx(0.2) and got[("w4",)]["winrate_lag1"] is None


def test_periods_ago(spark):
    df = spark.createDataFrame([(3,), (2,), (0,)], "i int")
    assert [r[0] for r in df.select(periods_ago(F.col("i"), 4)).collect()] == [-1.0, -2.0, -4.0]


def test_ols_matches_least_squares(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 2)) * [1.0, 50.0] + [1000.0, -3.0]
    y = 2 + x @ [3.0, -0.5] + rng.normal(size=300)
    df = spark.createDataFrame([(float(a), float(b), float(c)) for (a, b), c in zip(x, y)], "a double, b double, y double")
    for intercept in (True, False):
        got = rows(stats.ols(df.repartition(5), "y", ["a", "b"], intercept, p_values=True), "term")
        design = np.column_stack([np.ones(300), x]) if intercept else x
        beta, res = np.linalg.lstsq(design, y, rcond=None)[:2]
        names = ["intercept", "a", "b"] if intercept else ["a", "b"]
        s2 = res[0] / (300 - design.shape[1])
        se = np.sqrt(np.diag(np.linalg.inv(design.T @ design)) * s2)
        for i, name in enumerate(names):
            assert got[(name,)]["coef"] == pytest.approx(beta[i], rel=1e-6)
            assert got[(name,)]["se"] == pytest.approx(se[i], rel=1e-6)
        assert got[("a",)]["r2"] == pytest.approx(1 - res[0] / ((y - y.mean()) ** 2).sum(), rel=1e-6)
        assert got[("a",)]["p_value"] < 1e-6


def _ar_panel(spark, coef, seed=0):
    rng = np.random.default_rng(seed)
    out = []
    for u in range(20):
        level, change = 0.5, 0.0
        for w in range(12):
            change = coef * change + rng.normal() * 0.01
            level += change
            out.append((f"w{w:02d}", f"u{u}", level, 0.5))
    return spark.createDataFrame(out, "period string, unit string, share double, win_rate double")


def test_momentum_found_and_not_found(spark):
    strong = rows(stats.momentum_test(_ar_panel(spark, 0.8), p_values=True), "term")[("delta_lag1",)]
    none = rows(stats.momentum_test(_ar_panel(spark, 0.0), fixed_effects=False, p_values=True), "term")[("delta_lag1",)]
    assert strong["coef"] > 0.4 and strong["p_value"] < 0.01
    assert abs(none["t_stat"]) < 3


def test_season_windows_are_closed_and_respect_names(spark):
    events = spark.sql(
        """SELECT id, CAST(t AS TIMESTAMP) ts, name FROM VALUES (1,'2024-01-31 00:00:00','open'), (2,'2024-01-31 00:00:01','open'),
        (3,'2024-02-10 00:00:00','Other Cup'), (4,'2024-01-01 00:00:00','open'), (5,'2023-12-31 23:59:59','open') v(id,t,name)"""
    )
    windows = spark.sql(
        """SELECT s season, CAST(a AS TIMESTAMP) start_ts, CAST(b AS TIMESTAMP) end_ts, array('other') exclude FROM VALUES
        ('s1','2024-01-01','2024-01-31'), ('s2','2024-02-01','2024-04-15') v(s,a,b)"""
    )
    plain = {r["id"]: r["season"] for r in seasons.season_windows(events, windows.drop("exclude")).collect()}
    assert plain == {1: "s1", 3: "s2", 4: "s1"}
    named = {r["id"] for r in seasons.season_windows(events, windows, name="name").collect()}
    assert named == {1, 4}


def test_balance_modes(spark):
    df = spark.createDataFrame([("a", 1.0)] * 3 + [("b", 2.0)] * 6, "season string, weight double")
    total = {
        m: {r[0]: r[1] for r in seasons.balance_seasons(df, m).groupBy("season").agg(F.sum("weight")).collect()}
        for m in ("equal", "sqrt", "none")
    }
    assert total["equal"]["a"] == pytest.approx(7.5) and total["equal"]["b"] == pytest.approx(7.5)
    assert total["sqrt"]["b"] / total["sqrt"]["a"] == pytest.approx(2.0)
    assert total["none"] == {"a": 3.0, "b": 12.0}
    assert math.isclose(sum(total["sqrt"].values()), 15.0)


def test_lowest_draws_cuts_before_it_sorts(spark):
    """Same rows as a full ranking, null groups included; only rows up to the threshold reach the window."""
    from pyspark.sql import Window

    from fieldshift.functions.draws import draw, lowest_draws

    rows = spark.range(3000).selectExpr("id AS row_id", "CASE WHEN id % 7 = 0 THEN NULL WHEN id % 3 = 0 THEN 'a' ELSE 'b' END AS season")
    few = spark.createDataFrame([(9000, "c")], "row_id long, season string")
    df = rows.union(few)
    for k in (1, 40, 5000):
        ranked = df.withColumn("r", F.row_number().over(Window.partitionBy("season").orderBy(draw(3, F.col("row_id")), "row_id")))
        want = {tuple(r) for r in ranked.where(F.col("r") <= k).select("row_id", "season").collect()}
        got = lowest_draws(df, ["season"], draw(3, F.col("row_id")), "row_id", k)
        assert got.columns == ["row_id", "season"]
        assert {tuple(r) for r in got.collect()} == want
    # copies of one row are all kept apart by nothing but their place
    copies = lowest_draws(df.where("row_id = 1").unionAll(df.where("row_id = 1")), ["season"], draw(3, F.col("row_id")), "row_id", 1)
    assert copies.count() == 1
