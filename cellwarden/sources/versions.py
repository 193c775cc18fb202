"""Keyed tables whose changes rewrite only the files that hold the changed keys.

The rows of a table are range-partitioned by their key, so the files of a version hold disjoint ranges of keys. A version is
a small table that names its live files with their least key, greatest key and rows. Every key belongs to one file: the last
one that begins at or before it. A change reads and rewrites the files its keys belong to and writes the next version,
which keeps all other files; so old versions stay readable. A version is there once its success marker is; two
writers of one version meet in an error, since a version is never overwritten.

The list of live files passes through the driver, as it does for any reader of files. Keys must not be null.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellwarden.scale import lookup_join
from cellwarden.session import cut_lineage


def versions(spark: SparkSession, root: str) -> list[int]:
    """Numbers of the complete versions, oldest first."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/versions/v=*/_SUCCESS")
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    return sorted(int(s.getPath().getParent().getName()[2:]) for s in files.globStatus(path) or [])


def live_files(spark: SparkSession, root: str, version: int | None = None) -> pd.DataFrame:
    """File, low, high and rows of a version (the newest one by default), in order of the keys."""
    known = versions(spark, root)
    if not known or (version is not None and version not in known):
        raise FileNotFoundError(f"no complete version{'' if version is None else f' {version}'} below {root}")
    return spark.read.parquet(f"{root}/versions/v={known[-1] if version is None else version}").orderBy("low").toPandas()


def _write_version(spark: SparkSession, root: str, number: int, schema, kept: pd.DataFrame, folder: str, key: str) -> int:
    """Describe the files of ``folder`` and write the version that holds them and ``kept``."""
    written = spark.read.schema(schema).option("recursiveFileLookup", True).parquet(folder)
    described = (
        written.groupBy(F.col("_metadata.file_path").alias("file"))
        .agg(F.min(key).alias("low"), F.max(key).alias("high"), F.count("*").alias("rows"))
    )
    if len(kept):
        described = described.unionByName(spark.createDataFrame(kept, described.schema))
    described.coalesce(1).write.parquet(f"{root}/versions/v={number}")  # a row per file
    return number


def create_table(rows: DataFrame, root: str, key: str, files: int | None = None) -> int:
    """Write the first version in about ``files`` files (one per shuffle partition by default)."""
    spark = rows.sparkSession
    parts = files or int(spark.conf.get("spark.sql.shuffle.partitions"))
    folder = f"{root}/data/{uuid.uuid4().hex}"
    rows.repartitionByRange(parts, key).sortWithinPartitions(key).write.parquet(folder)
    return _write_version(spark, root, 1, rows.schema, pd.DataFrame(), folder, key)


def read_table(spark: SparkSession, root: str, version: int | None = None) -> DataFrame:
    """All rows of a version, the newest one by default."""
    files = live_files(spark, root, version)["file"].tolist()
    return spark.read.parquet(*files) if files else spark.read.parquet(f"{root}/data/*")


def _owner(lows: list):
    """Number of the file a key belongs to."""

    def find(keys: pd.Series) -> pd.Series:
        return pd.Series(np.maximum(np.searchsorted(np.array(lows, dtype=keys.dtype), keys.to_numpy(), side="right") - 1, 0).astype("int32"))

    return F.pandas_udf(find, "int")


def rewrite(
    spark: SparkSession, root: str, keys: DataFrame, key: str, change: Callable[[DataFrame], DataFrame], *, adds: bool = False
) -> int:
    """Apply ``change`` to the rows of the files that hold ``keys`` and write the next version; returns its number.

    ``change`` gets those rows and returns what takes their place; it must not alter keys. Without ``adds``, files that hold none
    of the keys stay; with it, the files new keys belong to are rewritten too. Nothing to rewrite leaves the version as it is.
    """
    number, files = versions(spark, root), live_files(spark, root)
    lows = files["low"].tolist()
    schema = read_table(spark, root).schema
    if lows:
        owned = cut_lineage(keys.select(key).where(F.col(key).isNotNull()).distinct().withColumn("_file", _owner(lows)(F.col(key))), "owners")
        touched = sorted(r["_file"] for r in owned.select("_file").distinct().collect())  # numbers of files
    else:
        touched = []
    if touched and not adds:
        # Only files that really hold a key, by their key columns alone.
        rows = spark.read.schema(schema).parquet(*files["file"].iloc[touched]).select(key, F.col("_metadata.file_path").alias("_path"))
        holding = {r["_path"] for r in lookup_join(rows, owned.select(key), [key], "left_semi").select("_path").distinct().collect()}
        touched = [i for i in touched if files["file"].iloc[i] in holding]
    if not touched and not (adds and not lows):
        return number[-1]
    old = spark.read.schema(schema).parquet(*files["file"].iloc[touched]) if touched else spark.createDataFrame([], schema)
    folder = f"{root}/data/{uuid.uuid4().hex}"
    new = change(old).select(*schema.names)
    owner = _owner(lows)(F.col(key)) if lows else F.lit(0)
    new.withColumn("_file", owner).repartition("_file").sortWithinPartitions("_file", key).write.partitionBy("_file").parquet(folder)
    return _write_version(spark, root, number[-1] + 1, schema, files.drop(index=touched), folder, key)
