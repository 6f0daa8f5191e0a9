"""Tournament files: event index and standings with decklists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldshift.schemas import EVENT, STANDINGS


def read_event_index(spark: SparkSession, path: str) -> DataFrame:
    """Index rows with defaults: empty name and format, zero players."""
    return spark.read.schema(EVENT).json(path).select(
        "id",
        F.coalesce("name", F.lit("")).alias("name"),
        "date",
        F.coalesce("format", F.lit("")).alias("format"),
        F.coalesce("players", F.lit(0)).alias("players"),
    )


def read_standings(spark: SparkSession, path: str) -> DataFrame:
    """One row per (event, standing). An event may come in several documents."""
    return (
        spark.read.schema(STANDINGS)
        .json(path)
        .select(F.col("tournament").alias("event"), F.explode("standings").alias("standing"))
        .select("event", "standing.*")
    )
