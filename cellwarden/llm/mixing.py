"""Interleave sources at target weights by Pfair scheduling of their blocks.

Documents of a source are cut into blocks of equal size, and slots are given to blocks. With weight
w, a share of all weights, block k of a source (from 1) is released at slot floor((k - 1) / w)
and due by slot ceil(k / w); of the released blocks the one due first takes the slot. As the
shares add up to one, every block meets its deadline, and after any number of slots t each source has
had more than w * t - 1 and fewer than w * t + 1 blocks.

Weights are whole numbers, so the schedule repeats after as many slots as they add up to: one period
is worked out on the driver and every block's slot follows from its number. When a source is used up, the
others go on with their weights alone, as a new phase from the next slot on; there are at most as many phases as
sources. No document is left out or repeated.

Defined results: sources without a weight, null among them, share the further weight equally, each as a class of its own, so the bound on
blocks holds for each of them. Only if there are more than ``own_classes`` such sources do they share one class, whose blocks mix them: a
period has as many slots as all weights times these sources, and is worked out on the driver. Documents of a class
are ordered by a hash of their id, and of their text where the id is null; the order of equal rows does not
matter. A class may have no documents. An empty table gives an empty table. Further columns are kept as they are.
"""

from __future__ import annotations

import heapq
from bisect import bisect_left
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellwarden.llm.tables import fresh

NAMES = ("block", "slot", "position")


def period(weights: Mapping[int, int]) -> dict[int, list[int]]:
    """Slots of each class in one period of sum(weights) slots, by earliest deadline first."""
    slots = sum(weights.values())
    waiting = [((k * slots) // w, -((-(k + 1) * slots) // w), c) for c, w in weights.items() for k in range(w)]
    waiting.sort()
    ready: list[tuple[int, int]] = []
    taken: dict[int, list[int]] = {c: [] for c in weights}
    following = 0
    for slot in range(slots):
        while following < len(waiting) and waiting[following][0] <= slot:
            _, due, c = waiting[following]
            heapq.heappush(ready, (due, c))
            following += 1
        due, c = heapq.heappop(ready)
        assert due > slot
        taken[c].append(slot)
    return taken


def phases(weights: Mapping[int, int], blocks: Mapping[int, int]) -> tuple[dict[int, list[tuple]], dict[int, int]]:
    """For each class its phases (first block, end block, first slot, slots a period, slots in it), and its last slot."""
    left = {c: n for c, n in blocks.items() if n > 0}
    used = dict.fromkeys(left, 0)
    plan: dict[int, list[tuple]] = {c: [] for c in left}
    last: dict[int, int] = {}
    begin = 0
    while left:
        own = {c: weights[c] for c in left}
        slots, taken = sum(own.values()), period(own)

        def slot_of(c: int, k: int) -> int:
            return k // own[c] * slots + taken[c][k % own[c]]

        length = min(slot_of(c, n - 1) for c, n in left.items()) + 1
        for c in list(left):
            count = length // slots * own[c] + bisect_left(taken[c], length % slots)
            plan[c].append((used[c], used[c] + count, begin, slots, taken[c]))
            used[c] += count
            left[c] -= count
            if not left[c]:
                last[c] = begin + slot_of(c, count - 1)
                del left[c]
        begin += length
    return plan, last


def mix(
    docs: DataFrame,
    weights: Mapping[str, int],
    block: int = 64,
    other_weight: int = 1,
    source_col: str = "source",
    id_col: str = "doc_id",
    text_col: str = "text",
    names: Sequence[str] = NAMES,
    own_classes: int = 256,
) -> DataFrame:
    """``docs`` with the number of the block in its class, the block's slot and the row's position in the mixture.

    One scan finds the sources and one of two columns counts the classes. Rows meet once by a bucket of their hash, so no
    task holds a whole source; counts of the buckets before, one row per bucket and class, complete the ranks.
    """
    spark = docs.sparkSession
    if min([other_weight, *weights.values()]) < 1:
        raise ValueError("weights are whole numbers from 1")
    buckets = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    source = F.col(f"`{source_col}`")
    unlisted = docs.where(source.isNull() | ~source.isin(*weights)) if weights else docs
    found = sorted({r[0] for r in unlisted.select(source).distinct().limit(own_classes + 1).collect()}, key=lambda s: (s is not None, s or ""))
    if len(found) > own_classes:
        found = []
    order = {s: i for i, s in enumerate([*sorted(weights), *found])}
    # Equal shares of the further weight, with all weights still whole numbers.
    each = max(1, len(found))
    own_weights = {order[s]: w * each for s, w in weights.items()} | {order[s]: other_weight for s in found}
    if not found:
        own_weights[len(order)] = other_weight
    # The row as one column, so that no name of it clashes with those made here.
    rows_ = docs.select(
        F.struct("*").alias("row_"), F.col(f"`{source_col}`").alias("source_"), F.col(f"`{id_col}`").alias("id_"),
        F.xxhash64(F.lit(1), F.col(f"`{text_col}`")).alias("text_"),
    )
    of_class: Column = F.lit(len(order))
    for s, i in order.items():
        of_class = F.when(F.col("source_").eqNullSafe(s), i).otherwise(of_class)
    by_hash = F.when(F.col("id_").isNull(), F.col("text_")).otherwise(F.xxhash64(F.lit(0), F.col("id_")))
    marked = rows_.select("row_", "id_", of_class.alias("class_"), by_hash.alias("hash_"))
    marked = marked.withColumn("bucket_", F.pmod("hash_", F.lit(buckets)).cast("int"))
    counted = marked.groupBy("class_", "bucket_").agg(F.count("*").alias("n")).collect()  # buckets x classes at most

    rows = {c: 0 for c in own_weights}
    before: dict[tuple[int, int], int] = {}
    for r in sorted(counted, key=lambda r: (r["class_"], r["bucket_"])):
        before[r["class_"], r["bucket_"]] = rows[r["class_"]]
        rows[r["class_"]] += r["n"]
    plan, last = phases(own_weights, {c: -(-n // block) for c, n in rows.items()})
    lookup = spark.createDataFrame(
        [(c, b, n, plan[c]) for (c, b), n in before.items()],
        "class_ int, bucket_ int, before_ long, "
        "phases_ array<struct<first:long,end:long,begin:long,slots:long,taken:array<int>>>",
    )  # buckets x classes rows, each with the slots of a period per phase: bounded by the parameters
    missing = [(last[c], block - rows[c] % block) for c in last if rows[c] % block]
    inside = Window.partitionBy("class_", "bucket_").orderBy("hash_", "id_")
    slot, number = F.col("slot_"), F.col("block_")
    ranked = (
        marked.withColumn("rank_", F.row_number().over(inside))
        .join(F.broadcast(lookup), ["class_", "bucket_"])
        .withColumn("rank_", (F.col("rank_") - 1 + F.col("before_")).cast("long"))
        .withColumn("block_", F.floor(F.col("rank_") / block))
        .withColumn("phase_", F.element_at(F.filter("phases_", lambda p: p["end"] > number), 1))
        .withColumn("step_", number - F.col("phase_.first"))
        .withColumn("each_", F.size("phase_.taken"))
        .withColumn(
            "slot_",
            (
                F.col("phase_.begin")
                + F.floor(F.col("step_") / F.col("each_")) * F.col("phase_.slots")
                + F.element_at("phase_.taken", (F.col("step_") % F.col("each_")).cast("int") + 1)
            ).cast("long"),
        )
    )
    # The last block of a class may be short, which moves all later rows forward.
    moved: Column = F.lit(0)
    for at, short in missing:
        moved = moved + F.when(slot > at, short).otherwise(0)
    position = (slot * block + F.col("rank_") % block - moved).cast("long")
    own = mixture_columns(docs, names)
    return ranked.select("row_.*", number.alias(own[0]), slot.alias(own[1]), position.alias(own[2]))


def mixture_columns(docs: DataFrame, names: Sequence[str] = NAMES) -> list[str]:
    """Names of the block, the slot and the position that ``mix`` adds; changed where ``docs`` has such a column."""
    return [fresh(n, docs.columns) for n in names]


def in_order(mixed: DataFrame, position: str = "position") -> DataFrame:
    """Rows sorted by position over all partitions, so that files written from them follow the mixture."""
    parts = int(mixed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return mixed.repartitionByRange(parts, F.col(f"`{position}`")).sortWithinPartitions(F.col(f"`{position}`"))
