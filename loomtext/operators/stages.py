"""Stages: tables that a job commits one after the other, so that a job that was stopped goes on after the last of them."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_own: str | None = None


def new_folder(spark: SparkSession, label: str) -> str:
    """A new folder name under spark.checkpoint.dir, which driver and executors share; a temporary one in local mode where that is unset."""
    global _own
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        _own = _own or f"file://{tempfile.mkdtemp(prefix='loomtext-')}"
        base = _own
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def file_system(spark: SparkSession, path: str):
    """(path, its file system), of the JVM: whatever Spark can write to."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def is_committed(spark: SparkSession, path: str) -> bool:
    p, fs = file_system(spark, f"{path}/_SUCCESS")
    return fs.exists(p)


def stage(spark: SparkSession, path: str, make: Callable[[], DataFrame]) -> DataFrame:
    """The table at path. It is made by make() if it was not committed before; what an earlier try left half written goes."""
    if not is_committed(spark, path):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
