"""Day-partitioned, cell-clustered table layout."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DAY = "date"


def write_partitioned(
    df: DataFrame,
    ts_col: str,
    cluster_cols: Sequence[str],
    path: str,
    *,
    shards: int = 16,
    mode: str = "append",
) -> None:
    """Write with one folder per day, rows of a cell together and sorted inside the files.

    Rows are dealt by (day, one of ``shards`` hashes of the cell), and the number of tasks follows from bytes: adaptive execution
    joins small parts and splits those beyond ``spark.sql.adaptive.advisoryPartitionSizeInBytes``, so a large day, or a
    cell that holds most rows of it, is written by as many tasks as its bytes need.
    """
    (
        df.withColumn(DAY, F.to_date(ts_col))
        .withColumn("_shard", F.pmod(F.xxhash64(*cluster_cols), F.lit(shards)))
        .hint("rebalance", DAY, "_shard")
        .sortWithinPartitions(DAY, *cluster_cols, ts_col)
        .drop("_shard")
        .write.partitionBy(DAY)
        .mode(mode)
        .parquet(path)
    )


def write_bucketed(
    df: DataFrame, table: str, cluster_cols: Sequence[str], sort_cols: Sequence[str], path: str, buckets: int | None = None
) -> DataFrame:
    """Write a catalog table whose rows lie in buckets by ``cluster_cols``, sorted inside, one file each; returns the table.

    Joins and aggregates by these columns read bucket by bucket and do not shuffle the table, if it has at least as many buckets
    as a shuffle has partitions (the default); with fewer Spark prefers to shuffle it. A bucket is read by one task, in order, so for a table
    where one cell holds far more than a fair share the day layout is the better one.
    """
    buckets = buckets or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    (
        df.repartition(buckets, *cluster_cols)
        .write.bucketBy(buckets, *cluster_cols).sortBy(*cluster_cols, *sort_cols)
        .option("path", path).mode("overwrite").saveAsTable(table)
    )
    return df.sparkSession.table(table)


def read_days(spark: SparkSession, path: str, first=None, last=None) -> DataFrame:
    """Read the table, pruned to the days ``first``..``last`` when given."""
    table = spark.read.parquet(path)
    if first is not None:
        table = table.where(F.col(DAY) >= F.lit(first).cast("date"))
    if last is not None:
        table = table.where(F.col(DAY) <= F.lit(last).cast("date"))
    return table
