"""Folders that all executors share, for tables that live as long as the session."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import SparkSession


def exists(spark: SparkSession, pattern: str) -> bool:
    """Whether any path is of this pattern."""
    where = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    return bool(where.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(where))


def _delete(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):  # the session may be over
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def temporary(spark: SparkSession, name: str) -> str:
    """A new folder below spark.checkpoint.dir, deleted when the driver ends.

    Where that is unset and Spark runs on this machine alone, a local temporary folder serves.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir is unset; it has to name a folder that all executors share")
        root = f"file://{tempfile.gettempdir()}"
    path = f"{root.rstrip('/')}/palaver/{name}-{uuid.uuid4().hex}"
    atexit.register(_delete, spark, path)
    return path
