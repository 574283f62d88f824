"""Cutting long lineages in a folder that all executors share; sending this package to executors."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

PACKAGE = Path(__file__).resolve().parents[1]
_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors' Python, once for each application, unless their PYTHONPATH has it."""
    sc = spark.sparkContext
    if str(PACKAGE.parent) in os.environ.get("PYTHONPATH", "").split(os.pathsep) or sc.applicationId in _shipped:
        return
    to = Path(tempfile.mkdtemp(prefix="hexloom-")) / f"{PACKAGE.name}.zip"
    with zipfile.ZipFile(to, "w") as z:
        for file in sorted(PACKAGE.rglob("*.py")):
            z.write(file, file.relative_to(PACKAGE.parent))
    sc.addPyFile(str(to))
    _shipped.add(sc.applicationId)


def cut(df: DataFrame) -> DataFrame:
    """A checkpoint in the shared folder."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    return df.checkpoint()


def by_sorting(df: DataFrame) -> DataFrame:
    """df as a side of a join that sorts and merges, whatever sizes are estimated.

    The estimate of a table's size knows nothing of the rows that generators make: cells and pieces that come of a small
    table of shapes would be taken for a small table, brought to the driver and broadcast.
    """
    return df.hint("merge")


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session. A temporary folder is set only in local mode, and only where that is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='hexloom-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")
