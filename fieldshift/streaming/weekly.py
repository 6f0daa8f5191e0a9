"""Weekly counts, forecast refresh and de-duplication over an arriving table."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from fieldshift.functions.periods import iso_period
from fieldshift.operators.dists import weekly_anchor_matrix
from fieldshift.operators.forecast import GLIDE_LAMBDA, fc_glide
from fieldshift.operators.panels import win_rate

MIN_ROWS = 300
SUMS = "season string, period string, anchor int, weight double, n bigint"


def iso_week_window(ts: str):
    """Tumbling week starting on Mondays (epoch day 4 is a Monday)."""
    return F.window(ts, "7 days", "7 days", "4 days")


def stream_period_counts(rows: DataFrame, delay: str = "2 days", ts: str = "ts") -> DataFrame:
    """Weekly weighted unit counts; rows later than the watermark are dropped.

    Same columns as the batch panel, without the share: a share needs the whole
    week, so it is taken after the window has closed.
    """
    return (
        rows.withWatermark(ts, delay)
        .groupBy(iso_week_window(ts).alias("w"), "unit")
        .agg(F.count(F.lit(1)).alias("n"), F.sum("weight").alias("weight"), win_rate().alias("win_rate"))
        .select(iso_period(F.col("w.start")).alias("period"), "unit", "n", "weight", "win_rate", F.col("w.end").alias("closes"))
    )


def stream_dedupe(rows: DataFrame, key: str = "roster_hash", delay: str = "2 days", ts: str = "ts") -> DataFrame:
    """First-seen rows by key within the watermark."""
    return rows.withWatermark(ts, delay).dropDuplicatesWithinWatermark([key])


def start_append(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Drain what is available into a Parquet table, exactly once."""
    return (
        stream.writeStream.format("parquet")
        .outputMode("append")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


class _Manifest:
    """Which batch's files hold for every season, and which held before; one small file beside the state.

    ``{kind: {season: [batch, rows, batch before, rows before]}}`` for the kinds
    ``sums`` and ``forecast``: as large as the calendar.
    """

    def __init__(self, spark: SparkSession, state: str):
        self.state, self.jvm = state, spark.sparkContext._jvm
        self.fs = self._path().getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, *parts: str):
        return self.jvm.org.apache.hadoop.fs.Path("/".join([self.state, *parts]))

    def save(self, held: dict) -> None:
        """Written aside, then moved into place."""
        aside, place = self._path("CURRENT.next"), self._path("CURRENT")
        out = self.fs.create(aside, True)
        out.write(bytearray(json.dumps(held).encode()))
        out.close()
        self.fs.delete(place, False)
        self.fs.rename(aside, place)

    def load(self) -> dict:
        for name in ("CURRENT", "CURRENT.next"):  # the second only if the move was cut short
            if self.fs.exists(self._path(name)):
                source = self.fs.open(self._path(name))
                text = self.jvm.org.apache.commons.io.IOUtils.toString(source, "UTF-8")
                source.close()
                return json.loads(text)
        return {"sums": {}, "forecast": {}}

    def prune(self, kind: str, seasons: dict) -> None:
        """Delete files of these seasons that are neither in force nor the ones before."""
        for folder in self.fs.listStatus(self._path(kind)) if self.fs.exists(self._path(kind)) else []:
            season = self.jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.unescapePathName(folder.getPath().getName())[len("season=") :]
            if season not in seasons:
                continue
            for status in self.fs.listStatus(folder.getPath()):
                name = status.getPath().getName()
                if name.startswith("batch=") and int(name[6:]) not in (seasons[season][0], seasons[season][2]):
                    self.fs.delete(status.getPath(), True)


def _versions(spark: SparkSession, path: str, schema: str, batches: dict[str, int]) -> DataFrame:
    """Rows of these seasons' files of these batches; other files are not read."""
    wanted = F.lit(False)
    for season, batch in batches.items():
        wanted = wanted | ((F.col("season") == season) & (F.col("batch") == batch))
    table = spark.read.schema(f"{schema}, batch int").parquet(path)
    return table.where(wanted).drop("batch")


def _write(df: DataFrame, path: str, batch_id: int) -> None:
    """A file set per season and batch; those of other seasons and batches stay as they are."""
    ready = df.withColumn("batch", F.lit(batch_id)).repartition("season")
    ready.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("season", "batch").parquet(path)


def _moved(entry: list | None, batch_id: int, rows: int) -> list:
    """Manifest entry of a season after a batch; a replayed batch takes the place of itself."""
    before = _base(entry, batch_id)
    return [batch_id, rows, before[0], before[1]] if before else [batch_id, rows, None, 0]


def _base(entry: list | None, batch_id: int) -> list | None:
    """(batch, rows) a season had before a batch."""
    for at in (0, 2):
        if entry and entry[at] is not None and entry[at] < batch_id:
            return entry[at : at + 2]
    return None


def refresh_step(state: str, anchors: int, lam: float = GLIDE_LAMBDA, min_rows: int = MIN_ROWS) -> Callable[[DataFrame, int], None]:
    """foreachBatch step: add the batch to the sums of the seasons it touches, and forecast these anew.

    Sums and forecasts lie in a folder per season and batch. A step reads and
    writes the touched seasons only; version b of a season is its version before
    b plus batch b, so a replayed batch overwrites itself and nothing is counted
    twice. The manifest names the versions in force and is replaced last. Of a
    touched season the versions in force and before stay. A season with fewer than
    ``min_rows`` rows so far has no forecast. Batch 0 starts anew: a new stream
    over an old folder inherits nothing. Rows without a season are left out.
    """

    def step(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        key = ["season", "period", "anchor"]
        arrived = batch.where(F.col("season").isNotNull()).groupBy(*key).agg(F.sum("weight").alias("weight"), F.count(F.lit(1)).alias("n"))
        arrived = arrived.persist()  # read twice; what is lost is summed again
        touched = {r["season"]: r["n"] for r in arrived.groupBy("season").agg(F.sum("n").alias("n")).collect()}
        files = _Manifest(spark, state)
        held = files.load() if batch_id > 0 else {"sums": {}, "forecast": {}}
        bases = {s: b for s in touched if (b := _base(held["sums"].get(s), batch_id))}
        sums = arrived
        if bases:
            before = _versions(spark, f"{state}/sums", SUMS, {s: b[0] for s, b in bases.items()})
            sums = sums.unionByName(before).groupBy(*key).agg(F.sum("weight").alias("weight"), F.sum("n").alias("n"))
        if touched:
            _write(sums, f"{state}/sums", batch_id)
        arrived.unpersist()
        for season, n in touched.items():
            rows = n + (bases[season][1] if season in bases else 0)
            held["sums"][season] = _moved(held["sums"].get(season), batch_id, rows)
        ready = {s: batch_id for s in touched if held["sums"][s][1] >= min_rows}
        if ready:
            matrix = weekly_anchor_matrix(_versions(spark, f"{state}/sums", SUMS, ready), anchors)
            _write(fc_glide(matrix, [lam]).select("season", "period_ix", "anchor", "p", "p_hat"), f"{state}/forecast", batch_id)
            for season in ready:
                held["forecast"][season] = _moved(held["forecast"].get(season), batch_id, held["sums"][season][1])
        files.save(held)
        files.prune("sums", {s: held["sums"][s] for s in touched})
        files.prune("forecast", {s: held["forecast"][s] for s in ready})

    return step


FORECAST = "season string, period_ix int, anchor int, p double, p_hat double"


def start_forecast_refresh(
    rows: DataFrame, state: str, checkpoint: str, anchors: int, lam: float = GLIDE_LAMBDA, min_rows: int = MIN_ROWS
) -> StreamingQuery:
    """``rows`` is a stream of (season, period, anchor, weight)."""
    return (
        rows.writeStream.foreachBatch(refresh_step(state, anchors, lam, min_rows))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def current_forecast(spark: SparkSession, state: str) -> DataFrame:
    """The forecasts in force; without one yet, no rows."""
    held = _Manifest(spark, state).load()["forecast"]
    if not held:
        return spark.createDataFrame([], FORECAST)
    return _versions(spark, f"{state}/forecast", FORECAST, {s: v[0] for s, v in held.items()})
