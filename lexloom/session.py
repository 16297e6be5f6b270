"""A session with the settings the library is written for, and shipping of the package to workers."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = Path(__file__).resolve().parent.parent

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}

#: Rows that a task is dealt where it sorts, gathers or reads them in Python.
TASK_ROWS = 200_000


def session(master: str = "local[*]", shuffle_partitions: int = 8, **more: str) -> SparkSession:
    builder = SparkSession.builder.master(master).config(map=SETTINGS | {"spark.sql.shuffle.partitions": str(shuffle_partitions)} | more)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """A folder that all executors share: spark.checkpoint.dir; only where that is unset and Spark runs in this one process a temporary one takes its place."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    context = spark.sparkContext
    if context.master != "local" and not context.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not hasattr(spark, "_lexloom_folder"):
        spark._lexloom_folder = "file://" + tempfile.mkdtemp(prefix="lexloom-")
    return spark._lexloom_folder


def cut(df: DataFrame) -> DataFrame:
    """df written to the checkpoint folder all executors share, so that loops carry no lineage."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def shares(df: DataFrame, rows: int | None = None) -> int:
    """How many tasks df's rows need, by a count of them; few rows still get as many as a shuffle has, since a small file is one task otherwise."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-df.count() // (rows or TASK_ROWS)))


def dealt(df: DataFrame, *keys: str, rows: int | None = None) -> DataFrame:
    """df in as many partitions as its rows need, hashed by keys if any are given: a task's share does not grow with the table."""
    return df.repartition(shares(df, rows), *keys)


def ship(spark: SparkSession) -> None:
    """Send the package to the workers, unless they can import it from where they start."""
    seen = [os.getcwd(), *os.environ.get("PYTHONPATH", "").split(":")]
    if str(ROOT) in map(os.path.realpath, filter(None, seen)) or getattr(spark, "_lexloom_shipped", False):
        return
    target = Path(tempfile.mkdtemp()) / "lexloom.zip"
    with zipfile.ZipFile(target, "w") as out:
        for path in [*ROOT.glob("*.py"), *ROOT.glob("lexloom/**/*.py")]:
            out.write(path, path.relative_to(ROOT))
    spark.sparkContext.addPyFile(str(target))
    spark._lexloom_shipped = True
