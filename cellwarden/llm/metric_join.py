"""Near-duplicate embeddings by an exact range join in pivot cells.

Vectors are compared as unit vectors, by the angle between them, which is a metric. Vectors of one label whose id falls
to a fixed share by hash are that label's pivots. A vector's home is the cell of its nearest pivot.
For y to have its home with pivot j, and x with pivot i, ``y.(p_j - p_i) >= 0`` must hold, and y is
within the angle r of x, so x is sent to each cell j for which
``x.(p_i - p_j) <= |p_i - p_j| * sin(r)`` (and to all cells if r is a right angle or more): the boundary replication. A cell finds all
links of its home vectors among its home vectors and guests, without any other cell.

Cells with more home vectors than fit a task are cut into sub-cells, and each vector sent to the cell goes to
all of them, home vectors too. A task holds the home vectors of one sub-cell, and guests stream past them in batches.
Equal vectors of a label are one vector with a count. Links are counted in the cells, never listed: a cell
passes on one link for each guest and home vector that changes which vectors are connected.

Defined results: a vector that is null, empty or zero, or has a null or non-finite component, and
one with a null label, links with nothing; its component is itself. Vectors of different lengths do not link. The cosine is taken
in double precision; pairs within 1e-9 of the bound are decided by exactly rounded sums. Rows that repeat an id stay
rows of their own and link with each other if they have equal vectors. A row without an id links as any other, but gives no component its id.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellwarden.llm.tables import Scratch, components

#: One of so many vectors is a pivot, and so many home vectors a sub-cell has at most on average.
CELL = 2048
#: Beyond so many pivots (all of them are sent to every task) pivots are rarer and cells have sub-cells.
MOST_PIVOTS = 4096
_NEAR = 1e-9


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of binary doubles of one length as a matrix."""
    return np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(len(column), -1)


def _directions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Add each vector as bytes of doubles, null where it takes no part."""
    for batch in batches:
        column = batch.column("vector")
        lengths = np.nan_to_num(column.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)
        values = column.flatten()
        numbers = values.cast(pa.float64()).to_numpy(zero_copy_only=False)
        out: list[bytes | None] = []
        end = 0
        for n in lengths.tolist():
            end += n
            v = numbers[end - n : end]
            top = np.abs(v).max() if n else 0.0
            out.append((v + 0.0).tobytes() if n and np.isfinite(top) and top > 0 else None)
        yield batch.drop_columns(["vector"]).append_column("raw", pa.array(out, pa.binary()))


def _unit(raw: list[bytes]) -> np.ndarray:
    x = np.frombuffer(b"".join(raw), np.float64).reshape(len(raw), -1)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # so that squares neither overflow nor vanish
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def _reach(batches: Iterator[pa.RecordBatch], pivots, sine: float) -> Iterator[pa.RecordBatch]:
    """Home cell of each vector, and all cells it is sent to, its home first."""
    own: dict[tuple[int, int], np.ndarray] = pivots.value
    for batch in batches:
        labels, raw = batch.column("label").to_pylist(), batch.column("raw").to_pylist()
        groups: dict[tuple[int, int], list[int]] = {}
        for i, (label, v) in enumerate(zip(labels, raw)):
            groups.setdefault((label, len(v)), []).append(i)
        cells: list = [[0]] * len(raw)
        for key, rows in groups.items():
            p = own.get(key)
            if p is None:
                continue
            apart = np.sqrt(np.maximum(0, 2 - 2 * (p @ p.T)))
            for k in range(0, len(rows), 1024):
                some = rows[k : k + 1024]
                near = _unit([raw[i] for i in some]) @ p.T
                home = near.argmax(axis=1)
                behind = near[np.arange(len(some)), home][:, None] - near
                sent = behind <= apart[home] * sine + _NEAR
                sent[np.arange(len(some)), home] = False
                for i, h, to in zip(some, home.tolist(), sent):
                    cells[i] = [h, *np.flatnonzero(to).tolist()]
        yield batch.append_column("cells", pa.array(cells, pa.list_(pa.int32())))


def _exact(x: np.ndarray, y: np.ndarray) -> float:
    dot = math.fsum(a * b for a, b in zip(x.tolist(), y.tolist()))
    return dot / math.sqrt(math.fsum(a * a for a in x.tolist()) * math.fsum(b * b for b in y.tolist()))


class _Cell:
    """The home vectors of one sub-cell, the links counted for them, and who is connected."""

    def __init__(self, bound: float):
        self.bound = bound
        self.vid: list[int] = []
        self.raw: list[bytes] = []
        self.copies: list[int] = []
        self.links: np.ndarray | None = None

    def close(self) -> None:
        """Called when all home vectors are there."""
        self.unit = _unit(self.raw)
        self.weight = np.array(self.copies, np.int64)
        self.links = self.weight - 1
        self.group = np.arange(len(self.vid))
        self.edges: list[tuple[int, int]] = []
        for k in range(0, len(self.vid), 512):
            self.meet(self.vid[k : k + 512], self.raw[k : k + 512], self.weight[k : k + 512], k)

    def meet(self, vid: list[int], raw: list[bytes], copies: np.ndarray, inside: int | None = None) -> None:
        """Compare a few vectors, guests or (from row ``inside`` on) home vectors, with all home vectors."""
        near = _unit(raw) @ self.unit.T
        hit = near >= self.bound
        for i, j in zip(*np.nonzero(np.abs(near - self.bound) <= _NEAR)):
            x, y = np.frombuffer(raw[i], np.float64), np.frombuffer(self.raw[j], np.float64)
            hit[i, j] = _exact(x, y) >= self.bound
        if inside is not None:
            rows = np.arange(len(vid))
            hit[rows, rows + inside] = False
        self.links += copies @ hit
        some = np.flatnonzero(hit.any(axis=1))
        for i in some.tolist():
            met = np.unique(self.group[hit[i]])
            if inside is not None:
                met = np.union1d(met, self.group[inside + i : inside + i + 1])
            else:
                self.edges.append((vid[i], self.vid[met[0]]))
            if len(met) > 1:
                self.edges.extend((self.vid[g], self.vid[met[0]]) for g in met[1:].tolist())
                self.group[np.isin(self.group, met[1:])] = met[0]


_FOUND = "vid long, links long, a long, b long"


def _in_cells(batches: Iterator[pa.RecordBatch], bound: float) -> Iterator[pa.RecordBatch]:
    """Counts (vid, links, null, null) and links (null, null, a, b) of sub-cells whose rows come home vectors first."""
    place, cell = None, None

    def result(done: _Cell | None) -> Iterator[pa.RecordBatch]:
        if done is None:
            return
        if done.links is None:
            done.close()
        n, m = len(done.vid), len(done.edges)
        none = [None] * n
        a, b = zip(*done.edges) if m else ((), ())
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(done.vid + [None] * m, pa.int64()), pa.array(done.links.tolist() + [None] * m, pa.int64()),
                pa.array([*none, *a], pa.int64()), pa.array([*none, *b], pa.int64()),
            ],
            names=["vid", "links", "a", "b"],
        )

    for batch in batches:
        rows = batch.to_pydict()
        keys = list(zip(rows["label"], rows["size"], rows["cell"], rows["sub"]))
        k = 0
        while k < len(keys):
            end = k + 1
            while end < len(keys) and keys[end] == keys[k] and rows["guest"][end] == rows["guest"][k] and end - k < 1024:
                end += 1
            if keys[k] != place:
                yield from result(cell)
                place, cell = keys[k], None
            if not rows["guest"][k]:
                cell = cell or _Cell(bound)
                cell.vid += rows["vid"][k:end]
                cell.raw += rows["raw"][k:end]
                cell.copies += rows["copies"][k:end]
            elif cell is not None:  # guests of a cell without home vectors have nobody to meet
                if cell.links is None:
                    cell.close()
                cell.meet(rows["vid"][k:end], rows["raw"][k:end], np.array(rows["copies"][k:end], np.int64))
            k = end
    yield from result(cell)


def near_vectors(
    vectors: DataFrame,
    bound: float = 0.93,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str | None = "label",
    cell: int = CELL,
) -> DataFrame:
    """Id, ``n_links``, ``component_id`` and ``kept`` of every row; links join rows of one label with cosine >= ``bound``."""
    if not 0 < bound <= 1:
        raise ValueError("the bound is a cosine above 0")
    spark = vectors.sparkSession
    scratch = Scratch(spark)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    label = F.lit(0).cast("long") if label_col is None else F.col(f"`{label_col}`").cast("long")
    rows = scratch.keep(
        vectors.select(
            F.col(f"`{id_col}`").cast("long").alias("id"), label.alias("label"),
            F.col(f"`{vector_col}`").cast("array<double>").alias("vector"),
        ).mapInArrow(_directions, "id long, label long, raw binary")
        .withColumn("raw", F.when(F.col("label").isNotNull(), F.col("raw")))
        .withColumn("vid", F.xxhash64("label", "raw")),
        "vectors",
    )
    # Equal vectors of a label are one from here on, called by a hash of both.
    distinct = scratch.keep(
        rows.where("raw is not null").groupBy("vid").agg(
            F.first("label").alias("label"), F.first("raw").alias("raw"), F.count("*").alias("copies"), F.min("id").alias("least")
        ),
        "distinct",
    )
    total = distinct.count()
    share = max(cell, -(-total // MOST_PIVOTS))
    chosen: dict[tuple[int, int], list[bytes]] = {}
    for r in distinct.where(F.pmod(F.xxhash64("vid"), F.lit(share)) == 0).select("label", "raw", "vid").sort("vid").collect():
        chosen.setdefault((r["label"], len(r["raw"])), []).append(bytes(r["raw"]))
    pivots = spark.sparkContext.broadcast({k: _unit(v) for k, v in chosen.items()})
    sine = math.sqrt(1 - bound * bound)
    placed = scratch.keep(
        distinct.select("vid", "label", "raw", "copies").mapInArrow(
            partial(_reach, pivots=pivots, sine=sine), "vid long, label long, raw binary, copies long, cells array<int>"
        ).withColumn("size", F.octet_length("raw")),
        "placed",
    )
    homes = placed.groupBy("label", "size", F.col("cells")[0].alias("cell")).agg(F.count("*").alias("n"))
    subs = homes.select("label", "size", "cell", F.ceil(F.col("n") / (2 * cell)).cast("int").alias("subs"))
    sent = (
        placed.select("*", F.posexplode("cells").alias("at", "cell"))
        .join(subs, ["label", "size", "cell"])
        .withColumn("own", F.when(F.col("at") == 0, F.pmod(F.xxhash64("vid", F.lit(7)), F.col("subs"))).otherwise(-1))
        .withColumn("sub", F.explode(F.sequence(F.lit(0), F.col("subs") - 1)))
        .withColumn("guest", F.col("own") != F.col("sub"))
        .select("label", "size", "cell", "sub", "guest", "vid", "raw", "copies")
    )
    found = scratch.keep(
        sent.repartition(parts, "label", "size", "cell", "sub")
        .sortWithinPartitions("label", "size", "cell", "sub", "guest")
        .mapInArrow(partial(_in_cells, bound=bound), _FOUND),
        "found",
    )
    counts = found.where("vid is not null").select("vid", "links")
    roots = components(found.where("a is not null").select("a", "b"), scratch).toDF("vid", "root")
    known = distinct.select("vid", "least").join(counts, "vid", "left").join(roots, "vid", "left")
    known = scratch.keep(known.withColumn("root", F.coalesce("root", "vid")), "known")
    smallest = known.groupBy("root").agg(F.min("least").alias("component"))
    named = known.join(smallest, "root").select("vid", "links", "component")
    takes_part = F.col("raw").isNotNull()
    out = rows.join(named, "vid", "left").select(
        F.col("id").alias(id_col),
        F.when(takes_part, F.coalesce("links", F.lit(0))).otherwise(0).cast("long").alias("n_links"),
        F.when(takes_part, F.col("component")).otherwise(F.col("id")).alias("component_id"),
    )
    return out.withColumn("kept", F.coalesce(F.col(f"`{id_col}`") == F.col("component_id"), F.lit(False)))
