"""Intermediate tables and connected components shared by the operators of this package."""

from __future__ import annotations

import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellwarden.session import shared_dir


def new_path(spark: SparkSession, name: str) -> str:
    """A path below the shared folder that no other run uses."""
    return f"{shared_dir(spark).rstrip('/')}/llm/{name}-{uuid.uuid4().hex}"


def fresh(name: str, columns: Iterable[str]) -> str:
    """``name``, with underscores after it until no column is called so (upper or lower case)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


#: Bytes of an Arrow batch, or one row.
BATCH_BYTES = 8 << 20


def bounded_batches(spark: SparkSession) -> SparkSession:
    """Let Arrow batches end at ``BATCH_BYTES``: texts differ in length, and a task holds several copies of a batch."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    return spark


class Scratch:
    """Tables of one call, written to the shared folder; ``drop`` deletes those that are done with."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.paths: dict[int, str] = {}

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` and go on from the written table, so nothing before it runs again."""
        path = new_path(self.spark, name)
        df.write.parquet(path)
        table = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(table)] = path
        return table

    def drop(self, *tables: DataFrame) -> None:
        for table in tables:
            delete(self.spark, self.paths.pop(id(table)))


def delete(spark: SparkSession, path: str) -> None:
    """Delete a path through Spark's file system layer, wherever it lies."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def release(spark: SparkSession) -> None:
    """Let Spark delete shuffle files of finished steps: its cleaner follows the driver's garbage collector."""
    spark._jvm.System.gc()


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """Smallest node reachable from each node: columns ``node`` and ``root``.

    ``edges`` has columns ``a`` and ``b`` of type long, none null. Each round links all neighbours of a node to
    the smallest of them, first the larger ones, then the smaller ones; the number of rounds is
    logarithmic in practice. The tables stay in the shared folder; only two sums reach the driver.
    """

    def star(pairs: DataFrame, large: bool) -> DataFrame:
        both = pairs.select("a", "b").union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        both = both if large else both.where("b < a")
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        linked = both.join(least, "a")
        if large:
            return linked.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        small = linked.select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        return small.union(least.select("a", F.col("m").alias("b"))).distinct()

    current = scratch.keep(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    mark = None
    while True:
        following = scratch.keep(star(star(current, True), False), "stars")
        sums = following.agg(
            F.count("*").alias("n"), F.sum(F.xxhash64("a", "b") % 1_000_003).alias("s")
        ).first()
        scratch.drop(current)
        current = following
        if mark == (sums["n"], sums["s"]):
            break
        mark = (sums["n"], sums["s"])
    nodes = current.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return nodes.union(nodes.select(F.col("root").alias("node"), "root").distinct())
