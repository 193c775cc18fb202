"""Merkle manifest of a table: a root that every row can be checked against by the digests beside its path.

A leaf is the SHA-256, as lower-case hex text, of a row's columns. Leaves of a group stand in ascending order of their id; while a
group has several nodes, every ``ARITY`` consecutive ones (the last run may have fewer, even one) become the digest of their
concatenated texts. What remains is the group's subroot; a single leaf is that itself. Subroots, in the order of their groups' names,
make the root the same way.

How it runs. An aligned block of ``ARITY ** LEVELS`` nodes holds each of its levels as one string of digests with a fixed width. A level's
parents are the digests of substrings of ``ARITY`` digests; the siblings of a node are the substrings beside it in its run. A block's root
is a node of the next layer, which has blocks of its own; so the number of layers is a logarithm of the rows. Positions come from a
range partitioning by group and id: each row's number in its sorted partition, and the rows of the group in the partitions before.
On the way down each block joins the path above its root and hands it to its nodes; no row meets more than one other row. All of
it is DataFrame work, and the written layers are the manifest.

Defined results: a null column is ``-``, any other one its number of UTF-8 bytes, ``:`` and its text, so a null and an empty text differ. Rows
without an id come first in their group, rows with one id follow each other by their leaves. Rows without a group are a group of
their own, before all others; names are ordered by their bytes. Repeated rows are leaves of their own. An empty table gives an
empty manifest. Columns that are not named play no part.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellwarden.llm.tables import Scratch
from cellwarden.scale import lookup_join

ARITY = 8
LEVELS = 3
#: Characters of a digest.
WIDTH = 64
RUN = ARITY * WIDTH
#: Bits of a row's number in its partition, as ``monotonically_increasing_id`` makes it.
ROW_BITS = 33
PATH = "array<struct<l:string,r:string>>"


def digest(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def leaf(columns: Sequence[Column]) -> Column:
    """Digest of a row: each column with its length in bytes, or ``-``."""
    texts = [c.cast("string") for c in columns]
    return digest(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]))


def group_key(name: Column) -> Column:
    """A key that is never null and sorts as the name does, null first."""
    return F.coalesce(F.concat(F.lit("."), name.cast("string")), F.lit(""))


def placed(rows: DataFrame, order: Sequence[str], scratch: Scratch) -> DataFrame:
    """``rows`` with ``at``, the place in ``group_`` by ``order`` (from 0), and ``n``, the rows of the group.

    ``rows`` should be a written table, since a range partitioning reads it twice.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = ["group_", *order]
    ranged = scratch.keep(
        rows.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).withColumn("row_", F.monotonically_increasing_id())
        .withColumns({"part_": F.shiftright("row_", ROW_BITS), "row_": F.col("row_").bitwiseAND((1 << ROW_BITS) - 1)}),
        "ranged",
    )
    # A row for each group in each partition: groups and partitions at most.
    found = scratch.keep(ranged.groupBy("group_", "part_").agg(F.count("*").alias("rows_"), F.min("row_").alias("first_")), "sizes")
    total = found.groupBy("group_").agg(
        F.sum("rows_").alias("n"), F.array_sort(F.collect_list(F.struct("part_", "rows_", "first_"))).alias("parts_")
    )
    before = F.aggregate(F.slice("parts_", 1, F.col("i_")), F.lit(0).cast("long"), lambda s, p: s + p["rows_"])
    starts = scratch.keep(
        total.select("group_", "n", "parts_", F.posexplode("parts_").alias("i_", "p_"))
        .select("group_", "n", F.col("p_.part_").alias("part_"), (before - F.col("p_.first_")).alias("shift_")),
        "starts",
    )
    joined = lookup_join(ranged, starts, ["group_", "part_"])
    return joined.withColumn("at", F.col("row_") + F.col("shift_")).drop("row_", "part_", "shift_")


def parents(level: Column) -> Column:
    """The level above a level: digests of its runs."""
    runs = F.sequence(F.lit(0), F.floor((F.length(level) - 1) / RUN).cast("int"))
    made = F.transform(runs, lambda i: F.sha2(F.substring(level, i * RUN + 1, F.lit(RUN)), 256))
    return F.array_join(made, "").cast("binary")


def sides(level: Column, at: Column) -> Column:
    """The siblings before and after a node of a level, as two strings."""
    within = at % ARITY
    left = F.substring(level, (at - within) * WIDTH + 1, within * WIDTH)
    right = F.substring(level, (at + 1) * WIDTH + 1, (ARITY - 1 - within) * WIDTH)
    return F.struct(left.cast("string").alias("l"), right.cast("string").alias("r"))


def build(nodes: DataFrame, scratch: Scratch, levels: int = LEVELS) -> list[DataFrame]:
    """The layers of blocks above ``nodes`` (group_, at, n, digest, item), each a written table.

    A block has its nodes' ``items`` in order, its levels as strings ``level0`` to ``level{levels}`` (null above its root), its height
    and its root. Groups of one block have their subroot as its root.
    """
    block, layers = ARITY**levels, []
    while True:
        height = F.lit(0)
        for h in range(levels):
            height = height + (F.col("n") > ARITY**h).cast("int")
        made = (
            nodes.groupBy("group_", "n", F.floor(F.col("at") / block).alias("block"))
            .agg(F.array_sort(F.collect_list(F.struct("at", "digest", "item"))).alias("nodes_"))
            .withColumn("height", height)
            .withColumn("items", F.transform("nodes_", lambda m: m["item"]))
            .withColumn("level0", F.array_join(F.transform("nodes_", lambda m: m["digest"]), "").cast("binary"))
            .drop("nodes_")
        )
        for h in range(levels):
            made = made.withColumn(f"level{h + 1}", F.when(F.col("height") > h, parents(F.col(f"level{h}"))))
        top = F.coalesce(*[F.col(f"level{h}") for h in range(levels, -1, -1)])
        layers.append(scratch.keep(made.withColumn("root", top.cast("string")), "layer"))
        larger = layers[-1].where(F.col("n") > block)
        if larger.isEmpty():
            return layers
        nodes = larger.select(
            "group_", F.col("block").alias("at"), F.ceil(F.col("n") / block).alias("n"), F.col("root").alias("digest"),
            F.lit(None).cast("int").alias("item"),
        )


def paths(layers: Sequence[DataFrame], above: DataFrame, levels: int = LEVELS) -> DataFrame:
    """Per node of the lowest layer its group, ``item``, ``digest``, ``path`` and the further columns of ``above``.

    ``above`` has one row per group with the ``path`` above its subroot. A path is the pairs of siblings from the node upwards.
    """
    further = [c for c in above.columns if c not in ("group_", "path")]
    upper = None
    for layer in reversed(layers):
        single = F.col("n") <= ARITY**levels
        blocks = layer.drop("root")
        met = blocks.where(single).join(above, "group_")
        if upper is not None:
            met = met.unionByName(blocks.where(~single).join(upper, ["group_", "block"]))

        def node(item: Column, at: Column) -> Column:
            pairs = F.array(*[sides(F.col(f"level{h}"), F.floor(at / ARITY**h).cast("int")) for h in range(levels)])
            own = F.substring(F.col("level0"), at * WIDTH + 1, F.lit(WIDTH)).cast("string")
            return F.struct(at.alias("in_block"), item.alias("item"), own.alias("digest"), F.slice(pairs, 1, F.col("height")).alias("own_"))

        each = met.select("group_", "block", F.inline(F.transform("items", node)), "path", *further)
        whole = F.concat("own_", "path")
        upper = each.select("group_", (F.col("block") * ARITY**levels + F.col("in_block")).alias("block"), whole.alias("path"), *further)
    return each.select("group_", "item", "digest", whole.alias("path"), *further)


@dataclass
class Manifest:
    """Written layers of the groups' trees and of the tree over their subroots."""

    layers: list[DataFrame]
    tops: list[DataFrame]
    levels: int = LEVELS

    def subroots(self) -> DataFrame:
        """``group_``, ``subroot``, ``root`` and the ``path`` from the subroot to the root, a row for each group."""
        start = self.tops[-1].where(F.col("n") <= ARITY**self.levels).select(
            "group_", F.array().cast(PATH).alias("path"), F.col("root")
        )
        found = paths(self.tops, start, self.levels)
        return found.select(F.col("item").alias("group_"), F.col("digest").alias("subroot"), "root", "path")

    def proofs(self) -> DataFrame:
        """Per row of the table: ``item``, ``digest`` (its leaf), ``subroot``, ``root`` and ``path`` from the leaf to the root."""
        return paths(self.layers, self.subroots(), self.levels)


def manifest(rows: DataFrame, order: Sequence[str], levels: int = LEVELS) -> Manifest:
    """The manifest of ``rows`` (group_, the columns of ``order``, digest, item)."""
    scratch = Scratch(rows.sparkSession)
    written = scratch.keep(rows, "leaves")
    layers = build(placed(written, order, scratch), scratch, levels)
    single = F.col("n") <= ARITY**levels
    roots = layers[0].where(single).select("group_", "root")
    for layer in layers[1:]:
        roots = roots.union(layer.where(single).select("group_", "root"))
    nodes = scratch.keep(roots.select(F.lit("").alias("group_"), F.col("group_").alias("item"), F.col("root").alias("digest")), "subroots")
    return Manifest(layers, build(placed(nodes, ["item"], scratch), scratch, levels), levels)


def folded(start: Column, path: Column) -> Column:
    """The root that follows from a leaf and the siblings on its path."""
    return F.aggregate(path, start, lambda own, p: digest(F.concat(p["l"], own, p["r"])))


def siblings(path: Column) -> Column:
    """All siblings of a path as one string, level by level, left to right."""
    return F.array_join(F.transform(path, lambda p: F.concat(p["l"], p["r"])), "")
