"""Mutable tables on plain parquet: every change is a new snapshot folder."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession


def _versions(spark: SparkSession, root: str) -> list[str]:
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/v=*/_SUCCESS")
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    return sorted(str(s.getPath().getParent()) for s in files.globStatus(path) or [])


def write_snapshot(df: DataFrame, root: str) -> str:
    """Write the next version; readers switch once its success marker exists.

    A job that dies half-way leaves a folder without the marker, which is never read.
    """
    target = f"{root}/v={time.time_ns():020d}"
    df.write.mode("errorifexists").parquet(target)
    return target


def read_snapshot(spark: SparkSession, root: str) -> DataFrame:
    """The newest complete version."""
    versions = _versions(spark, root)
    if not versions:
        raise FileNotFoundError(f"no complete snapshot below {root}")
    return spark.read.parquet(versions[-1])
