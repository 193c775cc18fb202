"""Containment join of intervals by a sweep over sorted rows: which windows of its cell hold a fact.

Facts and windows are sorted by cell and start. A task reads its rows once: a window joins the active set
at its start, a fact matches the active windows that end no earlier than it does. So no window is copied
per day, and no fact is compared with windows of another time.

A cell with more facts than a fair partition is cut into slices of time with about equal numbers of facts. The cuts come from counts
by cell and hour; there are at most as many hot cells and about as many cuts as partitions. Only windows that reach over
a cut are repeated, once per slice.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cellwarden.session import cut_lineage

HOUR = 3_600_000_000
#: An end that never comes.
OPEN = (1 << 63) - 1


def micros(col: Column) -> Column:
    return F.unix_micros(col.cast("timestamp"))


def count_by_hour(facts: DataFrame, keys: Sequence[str], start: str, end: str) -> DataFrame:
    """Facts per cell and hour of their start, and how many of them end before they start; written, since it is read twice."""
    hour = F.floor(micros(F.col(start)) / HOUR)
    counted = facts.groupBy(*keys, hour.alias("hour")).agg(
        F.count("*").alias("n"), F.count_if(F.col(end) < F.col(start)).alias("inverted")
    )
    return cut_lineage(counted, "hours")


def hot_cuts(counts: DataFrame, keys: Sequence[str], parts: int) -> DataFrame:
    """Per hot cell the microseconds at which it is cut; one row for each of at most ``parts`` cells."""
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    fair = max(1, total // parts)
    hot = counts.groupBy(*keys).agg(F.sum("n").alias("_all")).where(F.col("_all") > fair).drop("_all")
    before = Window.partitionBy(*keys).orderBy("hour").rowsBetween(Window.unboundedPreceding, -1)
    hours = counts.join(F.broadcast(hot), list(keys)).withColumn("_slice", F.floor(F.coalesce(F.sum("n").over(before), F.lit(0)) / fair))
    cuts = hours.groupBy(*keys, "_slice").agg(F.min("hour").alias("hour")).where("_slice > 0")
    return cuts.groupBy(*keys).agg(F.array_sort(F.collect_list(F.col("hour") * HOUR)).alias("_cuts"))


def sweep_join(facts: DataFrame, windows: DataFrame, keys: Sequence[str], start: str, end: str, counts: DataFrame) -> DataFrame:
    """Facts that do not end before they start, with the ``incident_id`` of each window that holds them.

    ``windows`` has incident_id, the keys as ``_w_<key>``, ``_w_start`` and ``_w_end`` (null: open). ``counts`` are those of
    ``count_by_hour``. A fact without end is held by open windows only; without start by none.
    """
    parts = int(facts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cuts = F.broadcast(hot_cuts(counts, keys, parts))

    def slice_of(at: Column) -> Column:
        return F.size(F.filter("_cuts", lambda c: c <= at))

    forward = facts.where(F.col(start).isNotNull() & F.coalesce(F.col(end) >= F.col(start), F.lit(True)))
    id_type = windows.schema["incident_id"].dataType
    events = forward.join(cuts, list(keys), "left").select(
        *facts.columns, F.coalesce(slice_of(micros(F.col(start))), F.lit(0)).alias("_slice"), F.lit(1).alias("_kind"),
        micros(F.col(start)).alias("_at"), F.coalesce(micros(F.col(end)), F.lit(OPEN)).alias("_end"), F.lit(None).cast(id_type).alias("incident_id"),
    )
    named = windows.select(
        *[F.col(f"_w_{k}").alias(k) for k in keys], micros(F.col("_w_start")).alias("_at"),
        F.coalesce(micros(F.col("_w_end")), F.lit(OPEN)).alias("_end"), "incident_id",
    ).where("_at <= _end")
    reached = F.when(F.col("_cuts").isNull(), F.array(F.lit(0))).otherwise(F.sequence(slice_of(F.col("_at")), slice_of(F.col("_end"))))
    others = [F.lit(None).cast(f.dataType).alias(f.name) for f in facts.schema.fields if f.name not in keys]
    starts = named.join(cuts, list(keys), "left").select(
        *keys, *others, F.explode(reached).alias("_slice"), F.lit(0).alias("_kind"), "_at", "_end", "incident_id"
    )
    order = [*keys, "_slice", "_at", "_kind"]  # a window before the facts of its first moment
    cells = [events.columns.index(c) for c in [*keys, "_slice"]]
    schema = T.StructType([*facts.schema.fields, T.StructField("incident_id", id_type)])
    return (
        events.unionByName(starts)
        .repartition(parts, *keys, "_slice").sortWithinPartitions(*order)
        .mapInArrow(partial(_swept, cells=cells, fields=len(facts.columns)), schema)
    )


def _swept(batches: Iterator[pa.RecordBatch], cells: list[int], fields: int) -> Iterator[pa.RecordBatch]:
    """Facts with the windows that hold them; columns after the first ``fields`` are _slice, _kind, _at, _end and the id."""
    cell, ends, ids = None, np.zeros(0, np.int64), []
    for batch in (b for b in batches if b.num_rows):
        kind, at, end = (batch.column(fields + i).to_numpy() for i in (1, 2, 3))
        names = batch.column(fields + 4)
        turn = np.zeros(batch.num_rows, bool)  # the first row of a cell or slice
        for c in cells:
            column = batch.column(c)
            turn[1:] |= ~pc.fill_null(pc.equal(column[1:], column[:-1]), False).to_numpy(zero_copy_only=False)
        turn[0] = cell != [batch.column(c)[0].as_py() for c in cells]
        cell = [batch.column(c)[batch.num_rows - 1].as_py() for c in cells]
        # Runs begin at a new cell and at every window; the rest of a run are facts.
        begins = np.union1d(np.flatnonzero(turn | (kind == 0)), [0])
        rows, found = [], []
        for low, high in zip(begins.tolist(), [*begins[1:].tolist(), batch.num_rows]):
            if turn[low]:
                ends, ids = np.zeros(0, np.int64), []
            if kind[low] == 0:
                gone = int(np.searchsorted(ends, at[low]))  # these windows ended before any fact to come
                place = max(gone, int(np.searchsorted(ends, end[low])))
                ends = np.concatenate([ends[gone:place], end[low : low + 1], ends[place:]])
                ids = [*ids[gone:place], names[low], *ids[place:]]
                low += 1
            if low < high and len(ends):
                first = np.searchsorted(ends, end[low:high])  # windows that end no earlier than the fact
                times = len(ends) - first
                rows.append(np.repeat(np.arange(low, high), times))
                found += [ids[i] for i in ragged(first, times).tolist()]
        if found:
            own = batch.take(pa.array(np.concatenate(rows)))
            yield pa.RecordBatch.from_arrays(
                [*own.columns[:fields], pa.array([i.as_py() for i in found], names.type)], names=[*own.schema.names[:fields], "incident_id"]
            )


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """``starts[i]`` to ``starts[i] + lengths[i] - 1`` for all i, one after another."""
    before = np.cumsum(lengths) - lengths
    return np.arange(int(lengths.sum())) + np.repeat(starts - before, lengths)
