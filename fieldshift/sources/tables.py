"""Round trips: rosters, panels, codebooks and the season manifest."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fieldshift.schemas import PANEL, ROSTER
from fieldshift.session import stage
from fieldshift.sources import arrays

# Names of the arrays in a codebook archive, with the columns and kinds they hold.
STAT_ARRAYS = (("feature_mean", "mean"), ("feature_std", "std"))
CENTROID_ARRAYS = (("cluster_centroids", "unit"), ("anchor_centroids", "anchor"))


def write_rosters(rosters: DataFrame, path: str, fmt: str = "json") -> None:
    """Weighted rosters, one folder per season; text formats are written compressed."""
    writer = rosters.write.format(fmt).partitionBy("season")
    (writer.option("compression", "gzip") if fmt in ("json", "csv") else writer).save(path)


def read_rosters(spark: SparkSession, path: str, fmt: str = "json") -> DataFrame:
    """Saved rosters; outcomes are not stored and come back NULL."""
    return (
        spark.read.schema(ROSTER)
        .format(fmt)
        .load(path)
        .withColumn("won", F.lit(None).cast("boolean"))
    )


def write_panel(panel: DataFrame, path: str) -> None:
    panel.write.option("header", True).csv(path)


def read_panel(spark: SparkSession, path: str, schema: str = PANEL) -> DataFrame:
    return spark.read.schema(schema).option("header", True).csv(path)


def write_codebook(stats: DataFrame, codebook: DataFrame, path: str) -> None:
    """Feature statistics and centroids: an archive of arrays if the path ends in ``.npz``, else two Parquet tables."""
    if path.endswith(".npz"):
        parts = [
            stats.select(F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.lit(0).alias("row"), F.col(c).alias("values")) for n, c in STAT_ARRAYS])).alias("x")).select("x.*")
        ]
        place = F.row_number().over(Window.partitionBy("kind").orderBy("id")) - 1
        for name, kind in CENTROID_ARRAYS:
            held = codebook.where(F.col("kind") == kind).withColumn("row", place)
            parts.append(held.select(F.lit(name).alias("name"), "row", F.col("vec").alias("values")))
        rows = parts[0]
        for part in parts[1:]:
            rows = rows.unionByName(part)
        arrays.write_arrays(rows, path, flat=[n for n, _ in STAT_ARRAYS])
        return
    stats.write.parquet(f"{path}/feature_stats")
    codebook.write.parquet(f"{path}/codebook")


def read_codebook(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(feature_stats, codebook). Without anchors the units stand in for them; an entry's id in an archive is its row."""
    if path.endswith(".npz"):
        found = stage(arrays.read_arrays(spark, path, [n for n, _ in (*STAT_ARRAYS, *CENTROID_ARRAYS)]), "codebook-arrays")
        stats = found.groupBy().agg(*[F.max(F.when(F.col("name") == n, F.col("values"))).alias(c) for n, c in STAT_ARRAYS])
        kind = F.coalesce(*[F.when(F.col("name") == n, F.lit(k)) for n, k in CENTROID_ARRAYS])
        codebook = found.select(kind.alias("kind"), F.col("row").alias("id"), F.col("values").alias("vec")).where(F.col("kind").isNotNull())
    else:
        stats = spark.read.parquet(f"{path}/feature_stats")
        codebook = spark.read.parquet(f"{path}/codebook")
    held = codebook.agg(*[F.coalesce(F.bool_or(F.col("kind") == k), F.lit(False)).alias(k) for k in ("unit", "anchor")]).first()
    if not held["unit"]:
        raise ValueError(f"no unit centroids in {path}; fit and write them first")
    if not held["anchor"]:
        codebook = codebook.unionByName(codebook.where(F.col("kind") == "unit").withColumn("kind", F.lit("anchor")))
    return stats, codebook


def season_manifest(rosters: DataFrame) -> DataFrame:
    """Per season: rosters, first and last instant, mean weight."""
    return rosters.groupBy("season").agg(
        F.count(F.lit(1)).alias("n"),
        F.min("ts").alias("first_ts"),
        F.max("ts").alias("last_ts"),
        F.avg("weight").alias("mean_weight"),
    )


def merge_sources(ladder: DataFrame, tournament: DataFrame) -> DataFrame:
    """Union with a source label; ladder rosters weigh one, untimed rows go."""
    left = ladder.withColumn("source", F.lit("ladder")).withColumn("weight", F.lit(1.0))
    right = tournament.withColumn("source", F.lit("tournament"))
    return left.unionByName(right, allowMissingColumns=True).where(F.col("ts").isNotNull())
