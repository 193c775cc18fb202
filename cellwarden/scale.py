"""Size checks, salting and distributed ranking shared by the operators.

The rule for every join here: a side is broadcast only after its rows and bytes were measured
and found within a bound; otherwise the join shuffles, with the rows of hot keys salted.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import add

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cellwarden.session import cut_lineage

BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 64 * 1024 * 1024
SALTS = 16


def literal_rows(spark: SparkSession, rows: Sequence[Sequence], schema: pa.Schema) -> DataFrame:
    """A constant relation from Python values; its size is known when the plan is built."""
    columns = list(zip(*rows)) if rows else [[] for _ in schema]
    arrays = [pa.array(list(c), type=f.type) for c, f in zip(columns, schema)]
    return spark.createDataFrame(pa.Table.from_arrays(arrays, schema=schema))


def _width(field: T.StructField) -> Column:
    col = F.col(f"`{field.name}`")
    if isinstance(field.dataType, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(col), F.lit(0))
    if isinstance(field.dataType, (T.ArrayType, T.MapType, T.StructType)):
        return F.coalesce(F.octet_length(F.to_json(F.struct(col))), F.lit(0))
    return F.lit(8)


def _size(df: DataFrame) -> list[Column]:
    """Rows and bytes of ``df`` as aggregates."""
    bytes_per_row = reduce(add, [_width(f) for f in df.schema.fields], F.lit(0)).cast("long")
    return [F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(bytes_per_row), F.lit(0)).alias("bytes")]


def fits(df: DataFrame, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES) -> bool:
    """Measure rows and bytes (one aggregate, combined before its shuffle) against the bounds."""
    size = df.agg(*_size(df)).first()
    return size["rows"] <= max_rows and size["bytes"] <= max_bytes


def measured(df: DataFrame, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES) -> tuple[DataFrame, bool]:
    """``df`` as a written table, and whether it is within the bounds: measured by the job that writes it, so it is evaluated once.

    A task that runs again may count twice, which can only make a table look larger.
    """
    seen = Observation()
    table = cut_lineage(df.observe(seen, *_size(df)), "lookup")
    size = seen.get
    return table, size.get("rows", 0) <= max_rows and size.get("bytes", 0) <= max_bytes


def hot_keys(df: DataFrame, on: Sequence[str]) -> DataFrame:
    """Keys with more rows than a fair shuffle partition; never more keys than partitions.

    Counting combines before its shuffle, and the counts (one row per key) are written, because
    both the total and the hot ones are read from them.
    """
    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counts = cut_lineage(df.groupBy(*on).agg(F.count("*").alias("_rows")), "key-counts")
    total = counts.agg(F.coalesce(F.sum("_rows"), F.lit(0)).alias("n")).first()["n"]
    return counts.where(F.col("_rows") * partitions > total).select(*on)


def salt_hot_keys(
    facts: DataFrame,
    table: DataFrame,
    on: Sequence[tuple[str, str]],
    salts: int = SALTS,
    names: tuple[str, str] = ("_salt", "_table_salt"),
) -> tuple[DataFrame, DataFrame]:
    """Spread the facts of hot keys over ``salts`` tasks; repeat only their table rows.

    ``on`` pairs fact columns with table columns. Each fact row gets one salt, from its whole
    content, and each table row of a hot key occurs once per salt, so a join that also compares
    the salts finds exactly what it found before. Adaptive execution splits what stays uneven.
    """
    hot = F.broadcast(hot_keys(facts, [f for f, _ in on]).toDF(*[f"_hot{i}" for i in range(len(on))]))
    marks = [f"_hot{i}" for i in range(len(on))]

    def marked(df: DataFrame, keys: list[str]) -> DataFrame:
        same = [F.col(k).eqNullSafe(F.col(m)) for k, m in zip(keys, marks)]
        return df.join(hot.withColumn("_is_hot", F.lit(True)), same, "left").drop(*marks)

    plain = [F.col(f"`{f.name}`") for f in facts.schema.fields if f.dataType.typeName() != "map"]
    own = F.pmod(F.xxhash64(*plain), F.lit(salts)).cast("int")
    left = marked(facts, [f for f, _ in on]).withColumn(
        names[0], F.when(F.col("_is_hot"), own).otherwise(0)
    )
    every = F.when(F.col("_is_hot"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    right = marked(table, [t for _, t in on]).withColumn(names[1], F.explode(every))
    return left.drop("_is_hot"), right.drop("_is_hot")


def lookup_join(
    facts: DataFrame,
    table: DataFrame,
    on: Sequence[str],
    how: str = "inner",
    *,
    max_rows: int = BROADCAST_ROWS,
    salts: int = SALTS,
    rows: int | None = None,
) -> DataFrame:
    """Join many fact rows to a lookup table whose key may be hot on the fact side.

    The table is written and measured in one job. Within the bound it is broadcast and the facts stay where they are. Beyond it both
    sides shuffle, with hot keys salted; inner, left, semi and anti joins stay exact because
    each fact row carries exactly one salt. ``rows`` is an upper bound of the rows of a table
    of ids and numbers, which the caller has already counted.
    """
    on = list(on)
    if rows is None:
        table, small = measured(table, max_rows)
    else:
        small = rows <= max_rows
    if small:
        return facts.join(F.broadcast(table), on, how)
    left, right = salt_hot_keys(facts, table, [(c, c) for c in on], salts, ("_salt", "_salt"))
    return left.join(right, [*on, "_salt"], how).drop("_salt")


def with_global_rank(
    df: DataFrame, order: Sequence[Column], name: str, partitions: int | None = None
) -> DataFrame:
    """Number all rows 1..n in ``order`` without pulling them into one task.

    Rows are range-partitioned by the whole sort key (ties on a prefix still split), written
    to the checkpoint folder so that the partition numbers stay fixed, ranked inside their
    partition and shifted by the size of the partitions before. ``order`` should end in a
    unique column.
    """
    spark = df.sparkSession
    if partitions is None:
        partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = cut_lineage(
        df.repartitionByRange(partitions, *order).withColumn("_part", F.spark_partition_id())
    )
    sizes = ranged.groupBy("_part").agg(F.count("*").alias("_size"))
    # One row per partition, so this window and this broadcast are bounded by ``partitions``.
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        "_part", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_offset")
    )
    inside = Window.partitionBy("_part").orderBy(*order)
    return (
        ranged.withColumn("_local", F.row_number().over(inside))
        .join(F.broadcast(offsets), "_part")
        .withColumn(name, (F.col("_local") + F.col("_offset")).cast("long"))
        .drop("_part", "_local", "_offset")
    )
