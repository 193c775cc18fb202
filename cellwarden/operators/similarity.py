"""Nearest prior incidents by embedding."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cellwarden.functions.columns import or_default
from cellwarden.functions.vectors import DISTANCE_DIGITS, METRICS, local_topk, nearest_first
from cellwarden.scale import fits, lookup_join
from cellwarden.session import cut_lineage

# Neighbours per query, cutoff, limit of a likely match, texts.
TOP_K = 5
CUTOFF = 0.5
LIKELY = 0.9
LIKELY_LABEL = "likely match"
OTHER_LABEL = "somewhat similar"
UNDETERMINED = "Not yet determined"
# Own text: the state of a query that has no embedding.
NOT_COMPARED = "error: the event log has no embedding"
NONE_FOUND = "no similar incidents found"

# A query set of up to this many numbers (64 MB) is sent to every task as one matrix.
BROADCAST_NUMBERS = 8_000_000
# Numbers of a block when both sides are partitioned (32 MB): two meet in a task. The larger they are, the less often rows are repeated.
BLOCK_NUMBERS = 4_000_000


def _comparable(vector: Column) -> Column:
    """Whether a vector has components, all of them finite numbers; a NULL one is not."""
    inf = F.lit(math.inf)
    sound = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < inf))
    return F.coalesce((F.size(vector) > 0) & sound, F.lit(False))


def nonempty_embeddings(df: DataFrame, vector_col: str = "events_embeddings") -> DataFrame:
    return df.where(F.size(vector_col) > 0)


def _narrow(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    kind = df.schema[vector_col].dataType
    half = isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.FloatType)  # half the bytes to move; measured as doubles
    vector = F.col(vector_col) if half else F.col(vector_col).cast("array<double>")
    rows = df.select(F.col(id_col).alias("id"), vector.alias("vector"))
    return rows.where(_comparable(F.col("vector")))


def _matrix(vectors: pa.Array) -> np.ndarray:
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    lengths = vectors.value_lengths()
    if len(vectors) and (lengths.null_count or pc.min(lengths).as_py() != pc.max(lengths).as_py()):
        raise ValueError("vectors of different lengths cannot be compared")
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    return flat.reshape(len(vectors), -1) if len(vectors) else flat.reshape(0, 0)


def _codes(buckets: pa.ChunkedArray) -> np.ndarray:
    """One row per vector, one column per hash table."""
    return buckets.combine_chunks().flatten().to_numpy().reshape(len(buckets), -1)


def _ids(column) -> np.ndarray:
    values = column.to_pylist()
    return np.asarray(values)


RESULT = ["query_id", "base_id", "distance"]


def _result(id_type: pa.DataType, query_ids, base_ids, distances) -> pa.Table:
    columns = [
        pa.array(query_ids.tolist(), type=id_type),
        pa.array(base_ids.tolist(), type=id_type),
        pa.array(distances, type=pa.float64()),
    ]
    return pa.table(columns, names=RESULT)


def _result_schema(id_type: T.DataType) -> T.StructType:
    return T.StructType(
        [
            T.StructField("query_id", id_type),
            T.StructField("base_id", id_type),
            T.StructField("distance", T.DoubleType()),
        ]
    )


def _against_matrix(base: DataFrame, queries: DataFrame, k: int, metric: str, exclude_self: bool, cutoff: float) -> DataFrame:
    """Base rows stay in place; each task keeps the k best per query over all its batches."""
    held = queries.toArrow()
    query_ids, matrix = _ids(held["id"]), _matrix(held["vector"])
    shared = base.sparkSession.sparkContext.broadcast((query_ids, matrix))
    id_type = held.schema.field("id").type

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, matrix = shared.value
        best_q = np.empty(0, dtype=np.int64)
        best_id = np.empty(0, dtype=ids.dtype)
        best_d = np.empty(0)
        for batch in batches:
            if not batch.num_rows or not len(ids):
                continue
            rows = _ids(batch.column("id"))
            q, b, d = local_topk(
                rows, _matrix(batch.column("vector")), ids, matrix, k, metric, exclude_self, cutoff=cutoff
            )
            best_q = np.concatenate([best_q, q])
            best_id = np.concatenate([best_id, rows[b]])
            best_d = np.concatenate([best_d, d])
            order = nearest_first(best_q, best_d, best_id)
            best_q, best_id, best_d = best_q[order], best_id[order], best_d[order]
            keep = np.arange(len(best_q)) - np.searchsorted(best_q, best_q, side="left") < k
            best_q, best_id, best_d = best_q[keep], best_id[keep], best_d[keep]
        if len(best_q):
            yield from _result(id_type, ids[best_q], best_id, best_d).to_batches()

    # Every task sends k rows per query, so there are no more tasks than run at a time.
    return base.coalesce(base.sparkSession.sparkContext.defaultParallelism).mapInArrow(
        nearest, _result_schema(base.schema["id"].dataType)
    )


def _block_pairs(base: DataFrame, queries: DataFrame, group: list[str], k: int, metric: str, exclude_self: bool, cutoff: float) -> DataFrame:
    """Compare blocks of base rows with blocks of queries; only k rows per query leave a pair.

    Both frames carry ``group`` (may be empty), ``_blocks`` and ``_others``: how many blocks
    their own group and the other side's group is cut into. A group of any size is therefore
    spread over block pairs of bounded size. Rows that carry ``buckets`` are compared only if they share one of them.
    """
    hashed = "buckets" in base.columns

    def blocked(df: DataFrame, own: str, other: str) -> DataFrame:
        return df.withColumn(own, F.pmod(F.xxhash64("id"), F.col("_blocks")).cast("int")).withColumn(
            other, F.explode(F.sequence(F.lit(0), (F.col("_others") - 1).cast("int")))
        ).drop("_blocks", "_others")

    id_type = base.schema["id"].dataType

    def nearest(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            none = np.empty(0)
            return _result(left.schema.field("id").type, none, none, none)
        base_ids, query_ids = _ids(left["id"]), _ids(right["id"])
        buckets = (_codes(left["buckets"]), _codes(right["buckets"])) if hashed else None
        q, b, d = local_topk(
            base_ids, _matrix(left["vector"]), query_ids, _matrix(right["vector"]), k, metric, exclude_self, buckets, cutoff
        )
        ids = [table["id"].combine_chunks().take(pa.array(rows)) for table, rows in ((right, q), (left, b))]
        return pa.table([*ids, pa.array(d, type=pa.float64())], names=RESULT)

    keys = [*group, "_b", "_q"]
    left = blocked(base, "_b", "_q").groupBy(*keys)
    right = blocked(queries, "_q", "_b").groupBy(*keys)
    return left.cogroup(right).applyInArrow(nearest, _result_schema(id_type))


def _blocks(spark: SparkSession, rows: int, dim: int, size: int | None) -> int:
    """Blocks of ``size`` rows; without it of ``BLOCK_NUMBERS`` numbers, and enough that their pairs keep all cores busy."""
    if size is not None:
        return max(1, math.ceil(rows / size))
    busy = math.ceil(math.sqrt(2 * spark.sparkContext.defaultParallelism))
    return max(1, min(rows, busy), math.ceil(rows * dim / BLOCK_NUMBERS))


def _all_blocks(
    base: DataFrame, queries: DataFrame, base_rows: int, query_rows: int, dim: int, base_block: int | None, query_block: int | None,
    k: int, metric: str, exclude_self: bool, cutoff: float,
) -> DataFrame:
    """Every block of base rows meets every block of queries."""
    blocks, others = _blocks(base.sparkSession, base_rows, dim, base_block), _blocks(base.sparkSession, query_rows, dim, query_block)

    def cut(df: DataFrame, own: int, other: int) -> DataFrame:
        return df.withColumn("_blocks", F.lit(own)).withColumn("_others", F.lit(other))

    return _block_pairs(cut(base, blocks, others), cut(queries, others, blocks), [], k, metric, exclude_self, cutoff)


def random_directions(dim: int, tables: int, width: float, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors, one column per hash table, and the shift of each table's buckets."""
    rng = np.random.default_rng(seed)
    directions = rng.standard_normal((dim, tables))
    directions /= np.linalg.norm(directions, axis=0)
    return directions, rng.uniform(0, width, tables)


def _random_projection_buckets(df: DataFrame, dim: int, tables: int, width: float, seed: int) -> DataFrame:
    """Per hash table the bucket of the vector's projection on a random direction, as ``buckets``."""
    directions, offsets = random_directions(dim, tables, width, seed)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buckets = np.floor((_matrix(batch.column("vector")) @ directions + offsets) / width)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id"),
                    batch.column("vector"),
                    pa.array(list(buckets.astype(np.int64)), type=pa.list_(pa.int64())),
                ],
                names=["id", "vector", "buckets"],
            )

    schema = T.StructType([*df.schema.fields, T.StructField("buckets", T.ArrayType(T.LongType()))])
    return df.mapInArrow(project, schema)


def vector_topk(
    base: DataFrame,
    queries: DataFrame,
    k: int = TOP_K,
    *,
    id_col: str = "incident_id",
    vector_col: str = "events_embeddings",
    metric: str = "euclidean",
    exclude_self: bool = False,
    cutoff: float = math.inf,
    method: str = "exact",
    tables: int = 6,
    width: float = 1.0,
    seed: int = 7,
    max_query_numbers: int = BROADCAST_NUMBERS,
    base_block: int | None = None,
    query_block: int | None = None,
) -> DataFrame:
    """(query_id, base_id, distance, rank) of the k nearest base vectors of every query.

    Vectors that are NULL, empty or hold NULL or non-finite components are left out on both sides, and
    so are base vectors of another length than the queries', which must have one length. Ties (to nine digits) go to the smaller id. ``exact``
    measures every base vector: against a broadcast query matrix while the counted queries fit
    the bound, else block by block. Base vectors beyond ``cutoff`` (to nine digits) are left out, which spares a caller that
    drops them later their way there. ``lsh`` compares only vectors that share a random-projection
    bucket in one of ``tables`` hash tables and may miss neighbours. Buckets so wide that they hold more pairs than there are
    (a pair counts in every table) do not deal out the rows: all pairs of blocks meet once, and only rows that share a bucket count
    (if no two rows of a side share an id).
    """
    if metric not in METRICS or method not in ("exact", "lsh"):
        raise ValueError(f"unknown metric or method: {metric}, {method}")
    base_rows = _narrow(base, id_col, vector_col)
    query_rows = _narrow(queries, id_col, vector_col)
    size = query_rows.agg(
        F.count("*").alias("n"),
        F.coalesce(F.min(F.size("vector")), F.lit(0)).alias("least"),
        F.coalesce(F.max(F.size("vector")), F.lit(0)).alias("dim"),
    ).first()
    if size["least"] != size["dim"]:
        raise ValueError(f"queries have vectors of {size['least']} to {size['dim']} numbers")
    base_rows = base_rows.where(F.size("vector") == size["dim"])
    if not size["n"] or (method == "exact" and size["n"] * size["dim"] <= max_query_numbers):
        near = _against_matrix(base_rows, query_rows, k, metric, exclude_self, cutoff)
    elif method == "exact":
        near = _all_blocks(base_rows, query_rows, base_rows.count(), size["n"], size["dim"], base_block, query_block, k, metric, exclude_self, cutoff)
    else:
        group = ["_table", "_bucket"]
        base_rows = cut_lineage(_random_projection_buckets(base_rows, size["dim"], tables, width, seed), "base-buckets")
        query_rows = cut_lineage(_random_projection_buckets(query_rows, size["dim"], tables, width, seed), "query-buckets")

        def dealt(df: DataFrame) -> DataFrame:
            return df.select("id", "vector", F.posexplode("buckets").alias(*group))

        def counted(df: DataFrame, name: str) -> DataFrame:
            return dealt(df).groupBy(*group).agg(F.count("*").alias(name))

        sizes = cut_lineage(counted(base_rows, "_base").join(counted(query_rows, "_query"), group), "bucket-sizes")
        pairs = sizes.agg(F.coalesce(F.sum(F.col("_base").cast("double") * F.col("_query")), F.lit(0.0)).alias("n")).first()["n"]
        rows = base_rows.count()
        # Rows that share an id count once per table, which one pass over all pairs would not tell.
        unique = all(df.agg(F.count("*") == F.count_distinct("id")).first()[0] for df in (base_rows, query_rows))
        if unique and pairs >= float(rows) * size["n"]:
            near = _all_blocks(base_rows, query_rows, rows, size["n"], size["dim"], base_block, query_block, k, metric, exclude_self, cutoff)
        else:
            limit = max(1, BLOCK_NUMBERS // size["dim"])

            def parts(own: str, block: int | None, other: str, other_block: int | None) -> DataFrame:
                cut = {"_blocks": (own, block), "_others": (other, other_block)}
                return sizes.select(*group, *[F.ceil(F.col(c) / (n or limit)).cast("int").alias(name) for name, (c, n) in cut.items()])

            near = _block_pairs(
                lookup_join(dealt(base_rows), parts("_base", base_block, "_query", query_block), group),
                lookup_join(dealt(query_rows), parts("_query", query_block, "_base", base_block), group),
                group, k, metric, exclude_self, cutoff,
            ).groupBy("query_id", "base_id").agg(F.min("distance").alias("distance"))
    order = Window.partitionBy("query_id").orderBy(F.round("distance", DISTANCE_DIGITS), "base_id")
    return near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def distance_cutoff(matches: DataFrame, cutoff: float = CUTOFF) -> DataFrame:
    """Drop matches beyond the cutoff; applied after the top-k, so fewer than k may remain."""
    return matches.where(F.col("distance") <= cutoff)


def match_label(matches: DataFrame, likely: float = LIKELY) -> DataFrame:
    label = F.when(F.col("distance") < likely, LIKELY_LABEL).otherwise(OTHER_LABEL)
    return matches.withColumn("match", label)


def with_incident_columns(matches: DataFrame, incidents: DataFrame, columns: list[str]) -> DataFrame:
    """Add columns of the matched incidents.

    The matches are written first, so that counting them does not search twice. Few are
    broadcast to the incident table. Otherwise the table is first cut to the matched ids, and
    the matches are salted: one incident may be the nearest to a large share of all queries.
    """
    matches = cut_lineage(matches, "matches")
    wanted = incidents.select(F.col("incident_id").alias("base_id"), *columns)
    if fits(matches):
        return wanted.join(F.broadcast(matches), "base_id")
    hit = wanted.join(matches.select("base_id").distinct(), "base_id", "left_semi")
    return lookup_join(matches, hit, ["base_id"])


def format_prior_incidents(matches: DataFrame, queries: DataFrame) -> DataFrame:
    """One text block per match, collected per query in order of distance.

    ``matches`` needs query_id, base_id, distance, rank, match, events, final_analysis, cause
    and resolution, at most k rows per query. A query without matches gets the status text; one whose ``events_embeddings``
    are null or empty could not be compared and says so.
    """

    def part(title: str, text) -> list:
        return [F.lit(f"**{title}**\n"), text, F.lit("\n")]

    block = F.concat(
        F.lit("*Incident "), F.col("base_id").cast("string"), F.lit("*\n"),
        F.lit("**Search distance**: "), F.round("distance", DISTANCE_DIGITS).cast("string"),
        F.lit(" ("), F.col("match"), F.lit(")\n"),
        *part("Events", F.coalesce("events", F.lit(""))),
        *part("Final analysis", or_default(F.col("final_analysis"), UNDETERMINED)),
        *part("Cause", or_default(F.col("cause"), UNDETERMINED)),
        *part("Resolution", or_default(F.col("resolution"), UNDETERMINED)),
    )
    found = matches.groupBy("query_id").agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("rank", block.alias("text")))), lambda m: m["text"]
        ).alias("prior_incidents")
    )
    failed = F.lit(False)
    if "events_embeddings" in queries.columns:
        failed = F.coalesce(F.size("events_embeddings") < 1, F.lit(True))
    return (
        queries.select(F.col("incident_id").alias("query_id"), failed.alias("_failed"))
        .join(found, "query_id", "left")
        .select(
            F.col("query_id").alias("incident_id"),
            F.when(F.col("_failed"), NOT_COMPARED).when(F.col("prior_incidents").isNull(), NONE_FOUND)
            .otherwise("success").alias("prior_incidents_status"),
            F.coalesce("prior_incidents", F.array().cast("array<string>")).alias("prior_incidents"),
        )
    )
