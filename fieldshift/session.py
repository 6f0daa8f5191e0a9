"""Session settings and the shared folder used for staged tables."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | str = "*", app_name: str = "fieldshift") -> SparkSession:
    """Session for tests and the bench; a cluster brings its own settings."""
    cores = os.cpu_count() if cpus == "*" else int(cpus)
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app_name)
        .config("spark.driver.memory", os.environ.get("FIELDSHIFT_DRIVER_MEMORY", "8g"))
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        # small local files: keep every core busy although partitions hold few bytes
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "32k")
        .config("spark.sql.files.openCostInBytes", "65536")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )


def ship(spark: SparkSession) -> None:
    """Send the package to the session's Python workers, once per Spark context.

    Functions that run on executors import it, and these know nothing of the driver's path.
    """
    context = spark.sparkContext
    if getattr(context, "_fieldshift_shipped", False):
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    folder = tempfile.mkdtemp(prefix="fieldshift-package-")  # the driver serves it to the executors
    source = os.path.join(folder, "source")
    shutil.copytree(
        os.path.join(root, "fieldshift"), os.path.join(source, "fieldshift"), ignore=shutil.ignore_patterns("__pycache__")
    )
    context.addPyFile(shutil.make_archive(os.path.join(folder, "fieldshift"), "zip", source))
    context._fieldshift_shipped = True


def shared_folder(spark: SparkSession) -> str:
    """Folder every executor can reach: the session's ``spark.checkpoint.dir``.

    Only a local-mode session without that setting gets a temporary folder.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
    folder = tempfile.mkdtemp(prefix="fieldshift-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex[:12]}"


_STAGED: dict[str, list[str]] = {}


def release(spark: SparkSession) -> int:
    """Delete the tables staged by this session so far; frames read from them can't be used again."""
    paths = _STAGED.pop(spark.sparkContext.applicationId, [])
    jvm = spark.sparkContext._jvm
    for name in paths:
        path = jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    return len(paths)


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write a derived table once and read it back.

    Lineage is cut on durable storage, the work is not repeated by later
    branches, and the optimiser sees the table's real size, so a join picks
    broadcast only when the measured size is below the session's threshold.
    """
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    _STAGED.setdefault(df.sparkSession.sparkContext.applicationId, []).append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
