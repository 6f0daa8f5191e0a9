import datetime as dt

from pyspark.sql import functions as F

from fieldshift.operators import dists, forecast, panels
from fieldshift.session import fresh_path
from fieldshift.streaming import weekly


def at(day, hour=0):
    return dt.datetime(2024, 1, 1) + dt.timedelta(days=day, hours=hour)


SCHEMA = "ts timestamp, unit string, weight double, won boolean"


def drain(spark, start, folder, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
    start().awaitTermination()


def test_counts_equal_batch_for_closed_weeks_and_drop_late_rows(spark):
    folder, out, log = (fresh_path(spark, n) for n in ("in", "out", "log"))
    first = [(at(d), "u", 1.0, d % 2 == 0) for d in range(0, 20)]
    spark.createDataFrame(first, SCHEMA).coalesce(1).write.parquet(folder)

    def start():
        stream = spark.readStream.schema(SCHEMA).parquet(folder)
        return weekly.start_append(weekly.stream_period_counts(stream, "2 days"), out, log)

    start().awaitTermination()
    # day 1 is long behind the watermark: its week has closed and must not change
    drain(spark, start, folder, [(at(1), "u", 50.0, None), (at(30), "u", 1.0, None)], SCHEMA)
    got = {r["period"]: (r["n"], r["weight"], r["win_rate"]) for r in spark.read.parquet(out).collect()}
    frame = spark.createDataFrame(first, SCHEMA).withColumn("period", weekly.iso_period(F.col("ts")))
    want = {r["period"]: (r["n"], r["weight"], r["win_rate"]) for r in panels.unit_panel(frame).collect()}
    assert got == want and set(got) == {"2024-W01", "2024-W02", "2024-W03"}


FEATURES = "season string, period string, anchor int, weight double"


def test_refresh_waits_accumulates_and_survives_replay(spark):
    folder, state, log = (fresh_path(spark, n) for n in ("in", "state", "log"))
    parts = [
        [("s", f"w{i % 3}", i % 4, 1.0) for i in range(10)],
        [("s", f"w{i % 4}", i % 3, 2.0) for i in range(15)],
        [("s", "w5", 1, 3.0)],
    ]
    spark.createDataFrame(parts[0], FEATURES).coalesce(1).write.parquet(folder)

    def start():
        stream = spark.readStream.schema(FEATURES).parquet(folder)
        return weekly.start_forecast_refresh(stream, state, log, anchors=4, min_rows=20)

    start().awaitTermination()
    import os

    assert not os.path.exists(f"{state}/forecast")  # ten rows are too few
    drain(spark, start, folder, parts[1], FEATURES)
    drain(spark, start, folder, parts[2], FEATURES)
    everything = spark.createDataFrame(sum(parts, []), FEATURES)
    want = forecast.fc_glide(dists.weekly_anchor_matrix(everything, 4), [0.3]).select("period_ix", "anchor", "p_hat")

    def same():
        got = weekly.current_forecast(spark, state).select("period_ix", "anchor", "p_hat")
        a = {(r[0], r[1]): round(r[2], 12) for r in got.collect()}
        return a == {(r[0], r[1]): round(r[2], 12) for r in want.collect()}

    assert same()
    # a replayed batch overwrites its own sums
    weekly.refresh_step(state, 4, min_rows=20)(spark.createDataFrame(parts[2], FEATURES), 2)
    assert same()


def test_dedupe_keeps_one_row_per_key_across_batches(spark):
    folder, out, log = (fresh_path(spark, n) for n in ("in", "out", "log"))
    schema = "ts timestamp, roster_hash string"
    spark.createDataFrame([(at(0), "a"), (at(0, 1), "a"), (at(0, 2), "b")], schema).write.parquet(folder)

    def start():
        stream = spark.readStream.schema(schema).parquet(folder)
        return weekly.start_append(weekly.stream_dedupe(stream), out, log)

    start().awaitTermination()
    drain(spark, start, folder, [(at(0, 3), "b"), (at(0, 4), "c")], schema)
    assert sorted(r[0] for r in spark.read.parquet(out).select("roster_hash").collect()) == ["a", "b", "c"]


def test_only_touched_seasons_change(spark, tmp_path):
    state = f"file://{tmp_path}/state"
    assert weekly.current_forecast(spark, state).count() == 0

    def rows(season, weight=1.0):
        return [(season, f"2020-W{w:02d}", a, weight) for w in range(1, 5) for a in range(4)]

    def files(kind, season):
        return {p: (p.stat().st_mtime_ns, p.stat().st_size) for p in (tmp_path / "state" / kind / f"season={season}").rglob("*.parquet")}

    step = weekly.refresh_step(state, 4, min_rows=17)
    step(spark.createDataFrame(rows("a") * 2 + rows("b:1") * 2 + [(None, "2020-W01", 1, 9.0)], FEATURES), 0)
    step(spark.createDataFrame(rows("c"), FEATURES), 1)  # too few rows for a forecast
    before = {(k, s): files(k, s) for k in ("sums", "forecast") for s in ("a", "b%3A1", "c")}
    assert before["forecast", "a"] and before["sums", "c"] and not before["forecast", "c"]
    changed = [("a", "2020-W05", 2, 7.0)]
    for batch in (2, 2):  # once more as a replay
        step(spark.createDataFrame(changed, FEATURES), batch)
        for kind in ("sums", "forecast"):
            assert files(kind, "b%3A1") == before[kind, "b%3A1"] and files(kind, "c") == before[kind, "c"]
            assert set(files(kind, "a")) > set(before[kind, "a"])  # the version before stays
    step(spark.createDataFrame(rows("c"), FEATURES), 3)
    step(spark.createDataFrame(changed, FEATURES), 4)
    assert sorted(p.name for p in (tmp_path / "state" / "sums" / "season=a").iterdir()) == ["batch=2", "batch=4"]
    whole = spark.createDataFrame(rows("a") * 2 + rows("b:1") * 2 + rows("c") * 2 + changed * 2, FEATURES)
    want = forecast.fc_glide(dists.weekly_anchor_matrix(whole, 4), [0.3]).select("season", "period_ix", "anchor", "p_hat")
    near = lambda df: {(r[0], r[1], r[2]): round(r[3], 12) for r in df.collect()}
    assert near(weekly.current_forecast(spark, state).select("season", "period_ix", "anchor", "p_hat")) == near(want)
    # a new stream over the old folder starts anew
    step(spark.createDataFrame(rows("c") * 2, FEATURES), 0)
    assert {r[0] for r in weekly.current_forecast(spark, state).select("season").distinct().collect()} == {"c"}
