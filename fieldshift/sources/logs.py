"""Battle-log files: JSON maps of battle id to ``[timestamp, log text]``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldshift.operators.extract import full_rosters, rosters_of_logs

LOG_MAP = "map<string, array<string>>"


def read_battle_logs(
    spark: SparkSession,
    path: str,
    max_battles: int | None = None,
    one_map_per_file: bool = True,
) -> DataFrame:
    """(battle_id, ts, season, log), the season taken from ``logs_<season>`` in the path.

    The native file is a single JSON map and cannot be split, so a large corpus
    is best rewritten once with ``one_map_per_file=False`` input (a map per
    line) or to Parquet, from where every later scan splits.
    """
    lines = spark.read.text(path, wholetext=one_map_per_file).select(
        F.regexp_extract(F.col("_metadata.file_path"), r"logs_([^/.]+)", 1).alias("season"),
        F.explode(F.from_json("value", LOG_MAP)).alias("battle_id", "entry"),
    )
    battles = lines.select(
        "battle_id",
        F.get("entry", F.lit(0)).cast("long").alias("ts"),
        "season",
        F.get("entry", F.lit(1)).alias("log"),
    )
    return battles if max_battles is None else battles.limit(max_battles)


def write_battle_logs(battles: DataFrame, path: str) -> None:
    """One JSON map per line in folders ``part=logs_<season>``."""
    entry = F.array(F.col("ts").cast("string"), F.col("log"))
    (
        battles.select(
            F.concat(F.lit("logs_"), F.col("season")).alias("part"),
            F.to_json(F.create_map(F.col("battle_id").cast("string"), entry)).alias("value"),
        )
        .write.partitionBy("part")
        .text(path)
    )


def read_log_rosters(
    spark: SparkSession,
    path: str,
    max_battles: int | None = None,
    full_only: bool = True,
    one_map_per_file: bool = True,
) -> DataFrame:
    """Rosters of every logged battle, by default only full ones."""
    rosters = rosters_of_logs(read_battle_logs(spark, path, max_battles, one_map_per_file))
    return full_rosters(rosters) if full_only else rosters
