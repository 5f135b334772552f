"""Session set-up: the package where Python workers run, and a folder that all of them share."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile
from functools import lru_cache
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_SHIPPED: set[str] = set()
#: Rows that a task makes distinct or sorts, about.
TASK_ROWS = 200_000


def ship(spark: SparkSession) -> None:
    """Adds this package to the job's Python files, once an application."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    top = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp()) / "quillmill.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for source in sorted(top.rglob("*.py")):
            z.write(source, source.relative_to(top.parent))
    context.addPyFile(str(archive))
    # stream readers run beside the driver, in processes that don't get Python files
    known = context.environment.get("PYTHONPATH")
    context.environment["PYTHONPATH"] = f"{top.parent}{os.pathsep}{known}" if known else str(top.parent)
    _SHIPPED.add(context.applicationId)


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; only a local master may lack it, and gets one that goes when the process ends."""
    context = spark.sparkContext
    where = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if where:
        return where.rstrip("/")
    if not (context.master == "local" or context.master.startswith("local[")):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return _local_dir()


def partitions(spark: SparkSession, rows: int | None = None) -> int:
    """How many partitions to ask for by number: enough for so many rows, else as ``spark.sql.shuffle.partitions`` says.

    Adaptive execution joins partitions by their compressed bytes, which for short repeating strings makes tasks of
    millions of rows; it leaves those that were asked for by number as they are.
    """
    if rows is None:
        return int(spark.conf.get("spark.sql.shuffle.partitions"))
    return max(spark.sparkContext.defaultParallelism, -(-rows // TASK_ROWS))


def stored(rows: DataFrame, name: str) -> DataFrame:
    """The rows written to the shared folder and read again, so that what is built on them doesn't make them anew for each use."""
    path = f"{shared_dir(rows.sparkSession)}/{name}-{uuid.uuid4().hex}"
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


@lru_cache(maxsize=1)
def _local_dir() -> str:
    path = f"/tmp/checkpoints/quillmill-{uuid.uuid4().hex}"
    atexit.register(shutil.rmtree, path, ignore_errors=True)
    return path
