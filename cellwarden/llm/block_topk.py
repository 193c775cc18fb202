"""Exact top-k by inner product with block-at-a-time pruning.

A vector is read as a document and its components as terms with whole-number weights. Documents are renumbered so that similar
ones stand together (by the nearest of some sampled vectors, then by id) and cut into ranges of equal
size. A block has a forward index (its weights as one matrix) and the least and greatest weight of
each term. For a query, the sum over terms of the greater of ``q * least`` and ``q * greatest``
bounds all scores in a block. A task orders its blocks by that bound for each query, scores
them in this order through their matrices, and leaves a query's remaining blocks as soon as their bound is below
the k-th best score so far. A query starts from the k-th best score in its own block.

Queries are handled in groups that fit a stated number of weights, against blocks that stay where they are;
only candidates at or above a query's starting score leave a task, at most k for each query.

Defined results: vectors that are null, empty or hold null or non-finite components take no part, neither as
query nor as candidate, and so do rows without an id. Vectors are compared with those of their own length.
Equal scores are ordered by the smaller id. Rows that repeat an id are documents of their own: each is a query with a ranking
of its own, and every row but itself is its candidate. Fewer candidates than k give fewer rows. Weights beyond 2**62 are held at
2**62 (or its negative), scores beyond 64 bits at the last 64-bit number.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cellwarden.llm.tables import Scratch

BLOCK = 256
#: Blocks whose matrices a task holds at once.
WAVE = 64
#: Weights of queries sent to all tasks at once.
QUERY_WEIGHTS = 4_000_000
ANCHORS = 64
_SAFE = float(1 << 53)
#: Below all scores but held ones; its negative is a 64-bit number too.
LOWEST, HIGHEST = np.iinfo(np.int64).min + 1, np.iinfo(np.int64).max
_HELD = 2.0**62


def _weights(batches: Iterator[pa.RecordBatch], scale: float) -> Iterator[pa.RecordBatch]:
    """(id, bytes of 64-bit weights) of the vectors that take part: floor(scale * component), as double, held within 2**62."""
    for batch in batches:
        column = batch.column(1)
        lengths = np.nan_to_num(column.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)
        numbers = column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
        end, keep, out = 0, [], []
        for i, n in enumerate(lengths.tolist()):
            end += n
            v = numbers[end - n : end]
            if n and np.isfinite(v).all() and batch.column(0)[i].is_valid:
                keep.append(i)
                with np.errstate(over="ignore"):
                    out.append(np.clip(np.floor(scale * v), -_HELD, _HELD).astype(np.int64).tobytes())
        ids = batch.column(0).take(pa.array(keep, pa.int64()))
        yield pa.RecordBatch.from_arrays([ids, pa.array(out, pa.binary())], names=["id", "raw"])


def _rows(raw: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(raw), np.int64).reshape(len(raw), -1)


def dot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of whole numbers, held in 64 bits: in doubles while all sums stay below 2**53, else as Python numbers."""
    if not a.size or not b.size:
        return np.zeros((len(a), len(b)), np.int64)
    if float(np.abs(a).max()) * float(np.abs(b).max()) * a.shape[1] < _SAFE:
        return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    return np.clip(a.astype(object) @ b.T.astype(object), LOWEST, HIGHEST).astype(np.int64)


def bounds(queries: np.ndarray, least: np.ndarray, greatest: np.ndarray) -> np.ndarray:
    """Greatest possible score of each query in each block."""
    up, down = np.maximum(queries, 0), np.minimum(queries, 0)
    return dot(np.hstack([up, down]), np.hstack([greatest, least]))


def _nearest(batches: Iterator[pa.RecordBatch], anchors) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        raw = batch.column("raw").to_pylist()
        place = np.zeros(len(raw), np.int32)
        sizes = np.array([len(r) for r in raw], np.int64)
        for size, a in anchors.value.items():
            rows = np.flatnonzero(sizes == size)
            if len(rows):
                place[rows] = (_rows([raw[i] for i in rows]).astype(np.float64) @ a.T).argmax(axis=1)
        yield batch.append_column("anchor", pa.array(place))


_BLOCKS = (
    "size long, ids binary, rows binary, weights binary, least binary, greatest binary, "
    "query_ids binary, query_rows binary, query_weights binary, start binary"
)


def _blocks(batches: Iterator[pa.RecordBatch], every: int, k: int) -> Iterator[pa.RecordBatch]:
    """Blocks of consecutive rows of one length, with their queries and those queries' k-th best score in the block."""

    def made(ids: list[int], numbers: list[int], raw: list[bytes]) -> pa.RecordBatch:
        vid, row_of, x = np.array(ids, np.int64), np.array(numbers, np.int64), _rows(raw)
        asked = np.flatnonzero(vid % every == 0)
        start = np.full(len(asked), LOWEST)
        scores = dot(x[asked], x)
        for row, q in enumerate(asked):
            own = np.delete(scores[row], q)
            if len(own) >= k:
                start[row] = np.partition(own, len(own) - k)[len(own) - k]
        cells = (vid, row_of, x, x.min(axis=0), x.max(axis=0), vid[asked], row_of[asked], x[asked], start)
        names = ["size", *[c.split()[0] for c in _BLOCKS.split(", ")[1:]]]
        return pa.RecordBatch.from_arrays(
            [pa.array([x.shape[1]], pa.int64()), *[pa.array([c.tobytes()], pa.binary()) for c in cells]], names=names
        )

    ids, numbers, raw = [], [], []
    for batch in batches:
        for i, n, r in zip(*(batch.column(c).to_pylist() for c in ("id", "row", "raw"))):
            if len(ids) == BLOCK or raw and len(raw[-1]) != len(r):
                yield made(ids, numbers, raw)
                ids, numbers, raw = [], [], []
            ids.append(i)
            numbers.append(n)
            raw.append(r)
    if ids:
        yield made(ids, numbers, raw)


class _Best:
    """The k best candidates of each query: scores falling, ids rising, empty places last."""

    def __init__(self, start: np.ndarray, k: int):
        self.k, self.floor = k, start
        self.score = np.full((len(start), k), LOWEST)
        self.vid = np.full((len(start), k), HIGHEST)
        self.filled = np.zeros((len(start), k), bool)

    def kth(self) -> np.ndarray:
        return np.maximum(self.floor, self.score[:, -1])

    def add(self, rows: np.ndarray, scores: np.ndarray, vid: np.ndarray, numbers: np.ndarray, own: np.ndarray) -> None:
        """``scores`` of the queries ``rows`` (whose row numbers are ``own``) for the documents ``vid``, of row ``numbers``."""
        may = (scores >= self.kth()[rows][:, None]) & (numbers[None, :] != own[:, None])
        for r in np.flatnonzero(may.any(axis=1)):
            q, hit = rows[r], may[r]
            s = np.append(self.score[q], scores[r][hit])
            v = np.append(self.vid[q], vid[hit])
            filled = np.append(self.filled[q], np.ones(len(v) - self.k, bool))
            best = np.lexsort((v, -s, ~filled))[: self.k]
            self.score[q], self.vid[q], self.filled[q] = s[best], v[best], filled[best]


def _search(batches: Iterator[pa.RecordBatch], queries, k: int) -> Iterator[pa.RecordBatch]:
    """Candidates (query, document, score) of one task's blocks."""
    groups: dict[int, tuple] = queries.value
    best = {size: _Best(start, k) for size, (_, _, _, start) in groups.items()}

    def wave(size: int, blocks: list[tuple]) -> None:
        _, own, asked, _ = groups[size]
        top = bounds(asked, np.array([b[3] for b in blocks]), np.array([b[4] for b in blocks]))
        order = np.argsort(-top, axis=1, kind="stable")
        active = np.arange(len(own))
        for step in range(len(blocks)):
            block = order[active, step]
            # The bounds that follow are smaller still. An equal score may win by its id, so it is looked at.
            alive = top[active, block] >= best[size].kth()[active]
            active, block = active[alive], block[alive]
            if not len(active):
                return
            by_block = np.argsort(block, kind="stable")
            cuts = np.flatnonzero(np.diff(block[by_block])) + 1
            for some in np.split(by_block, cuts):
                rows = active[some]
                vid, numbers, x, _, _ = blocks[block[some[0]]]
                best[size].add(rows, dot(asked[rows], x), vid, numbers, own[rows])

    held: dict[int, list[tuple]] = {}
    for batch in batches:
        for i in range(batch.num_rows):
            size = batch.column("size")[i].as_py()
            if size not in groups:
                continue
            vid, numbers, x, least, greatest = (
                np.frombuffer(batch.column(c)[i].as_py(), np.int64) for c in ("ids", "rows", "weights", "least", "greatest")
            )
            held.setdefault(size, []).append((vid, numbers, x.reshape(len(vid), -1), least, greatest))
            if len(held[size]) == WAVE:
                wave(size, held.pop(size))
    for size, blocks in held.items():
        wave(size, blocks)
    for size, found in best.items():
        ids, own, _, _ = groups[size]
        q, place = np.nonzero(found.filled)
        yield pa.RecordBatch.from_arrays(
            [pa.array(own[q]), pa.array(ids[q]), pa.array(found.vid[q, place]), pa.array(found.score[q, place])],
            names=["query_row", "query_id", "vec_id", "score"],
        )


def top_k(
    vectors: DataFrame, k: int = 5, every: int = 50, scale: float = 256.0, id_col: str = "vec_id", vector_col: str = "embedding"
) -> DataFrame:
    """``query_id``, ``rank`` (from 1), ``vec_id`` and ``score``; queries are the rows whose id is divisible by ``every``."""
    spark = vectors.sparkSession
    scratch = Scratch(spark)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = scratch.keep(
        vectors.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{vector_col}`").cast("array<double>").alias("v"))
        .mapInArrow(partial(_weights, scale=scale), "id long, raw binary")
        .withColumn("row", F.monotonically_increasing_id()),  # written, so it stays a row's number
        "weights",
    )
    anchors: dict[int, np.ndarray] = {}
    sizes = [r["n"] for r in rows.select(F.octet_length("raw").alias("n")).distinct().orderBy("n").limit(ANCHORS).collect()]
    for size in sizes:  # lengths without anchors stand together in the order of their ids
        first = rows.where(F.octet_length("raw") == size).orderBy(F.xxhash64("id"), "id").limit(ANCHORS).select("raw").collect()
        x = _rows([bytes(r["raw"]) for r in first]).astype(np.float64)
        anchors[size] = x / np.maximum(np.linalg.norm(x, axis=1), 1)[:, None]
    sent = spark.sparkContext.broadcast(anchors)
    near = rows.mapInArrow(partial(_nearest, anchors=sent), "id long, raw binary, row long, anchor int")
    order = [F.octet_length("raw"), F.col("anchor"), F.col("id"), F.col("row")]
    blocks = scratch.keep(
        near.repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInArrow(partial(_blocks, every=every, k=k), _BLOCKS),
        "blocks",
    )
    asked = blocks.where(F.octet_length("query_ids") > 0).select(
        "size", "query_ids", "query_rows", "query_weights", "start", F.crc32("query_rows").alias("deal")
    )
    weights = asked.agg(F.sum(F.octet_length("query_weights"))).first()[0] or 0
    groups = max(1, -(-(weights // 8) // QUERY_WEIGHTS))
    found = []
    for g in range(groups):
        # About QUERY_WEIGHTS weights of queries, whatever the number of documents.
        by_size: dict[int, list] = {}
        for r in asked.where(F.pmod("deal", F.lit(groups)) == g).toLocalIterator():
            by_size.setdefault(r["size"], []).append(r)
        joined = {}
        for size, some in by_size.items():
            ids, own, x, start = (
                np.frombuffer(b"".join(bytes(r[c]) for r in some), np.int64) for c in ("query_ids", "query_rows", "query_weights", "start")
            )
            joined[size] = (ids, own, x.reshape(len(own), -1), start)
        queries = spark.sparkContext.broadcast(joined)
        found.append(blocks.mapInArrow(partial(_search, queries=queries, k=k), "query_row long, query_id long, vec_id long, score long"))
    best = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id")
    return (
        reduce(DataFrame.union, found)
        .withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
