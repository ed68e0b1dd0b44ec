"""Session settings and the shared work folder."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

# UTC because snapshot days and trailing windows are defined on UTC instants.
# The top-k threshold sends very deep offsets to a distributed sort instead of
# a heap on one task.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.topKSortFallbackThreshold": "100000",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # timestamps are instants, also where a file marks them as local
    "spark.sql.parquet.inferTimestampNTZ.enabled": "false",
    # whole pages travel in Arrow batches, so batches are kept short
    "spark.sql.execution.arrow.maxRecordsPerBatch": "500",
}


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, **extra: str) -> SparkSession:
    """A session for tests and benches; a cluster brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("tsubo")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    )
    for key, value in {**SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def apply_settings(spark: SparkSession) -> SparkSession:
    """Set the runtime options the jobs rely on; leaves cluster sizing alone."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def ship_package(spark: SparkSession) -> None:
    """Hand this package to the Python workers, once per Spark context."""
    context = spark.sparkContext
    if not getattr(context, "_tsubo_shipped", False):
        # the driver serves the archive to the executors itself
        archive = os.path.join(tempfile.mkdtemp(prefix="tsubo-"), "tsubo")
        package = Path(__file__).resolve().parent
        context.addPyFile(shutil.make_archive(archive, "zip", package.parent, package.name))
        context._tsubo_shipped = True


def work_dir(spark: SparkSession, label: str) -> str:
    """A new folder under the shared folder named by spark.checkpoint.dir.

    Only a local master may fall back to a folder of this machine.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="tsubo-")
        spark.conf.set("spark.checkpoint.dir", base)
    return os.path.join(base, f"{label}-{uuid.uuid4().hex}")


def written(df: DataFrame, label: str) -> DataFrame:
    """The frame as a table in the shared folder: costly rows are made once, and
    the table outlives the executors that made it."""
    path = work_dir(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fixed_rows(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A small fixed table as a local relation, whose size the optimizer knows."""
    names = [column.split()[0] for column in schema.split(",")]
    return spark.createDataFrame(pd.DataFrame(rows, columns=names), schema)
