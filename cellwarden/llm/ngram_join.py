"""Near-duplicate documents by an exact Jaccard join of word n-grams on PartEnum signatures.

Texts are lower-cased (A-Z only) and cut into white-space separated words. A document's set is its
distinct n-grams of words; with fewer words the whole sequence is one; without words the set is
empty and links with nothing. Two documents link when ``den * |intersection| >= num * |union|``.

Defined results: a null text is an empty one. Every input row gives one row, also repeated ones.
A row without an id is joined as any other, but is never a component's id; a component in which
all ids are null has a null id. Further input columns play no part, whatever they are called.

How it runs. (1) One pass gives each document the size, a 64-bit key and a small sketch of its
set; documents with equal sets are one set from here on. (2) A second pass makes the signatures of
each set (see ``partenum``). Equal sets are dropped inside their task. A signature that many sets
of one task share is combined there before the shuffle. (3) Sets with a common signature meet in
sorted partitions that are streamed: few of them give all their pairs, many of them give pairs
with the smallest key (a star), as one component needs no more; the members of such large groups
are remembered. (4) Pairs pass a bound from the sketches and then an exact comparison of their
sets, which are made anew from the texts of those documents alone. (5) Components. (6) Large groups
whose members are still in several components are compared in blocks, in full, by sketch and then
exactly; most have none left. No step drops a pair that could link.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellwarden.llm import partenum
from cellwarden.llm.tables import Scratch, components, release
from cellwarden.llm.textbatch import U64, chunks, lower, mix, words

#: A group of sets with one signature gives all pairs up to this size, beyond it a star.
LARGE = 64
#: n-grams found in one of so many documents of a slab are counted, as their order comes last.
FREQUENT = 1000
SLAB = 1 << 20
#: Only the most frequent n-grams are sent to the tasks. They order tokens; results do not depend on them.
MOST_FREQUENT = 1 << 17
BLOCK = 256


def shingle_sets(data: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct hashes of each text's n-grams, ascending; the text each belongs to; the texts' set sizes."""
    texts = len(offsets) - 1
    found, _, _, owner = words(lower(data), offsets)
    factors = mix(np.arange(n, dtype=U64) + U64(99)) | U64(1)
    counts = np.bincount(owner, minlength=texts)
    grams, of = np.zeros(0, U64), np.zeros(0, np.int64)
    if len(found) >= n:
        grams = np.zeros(len(found) - n + 1, U64)
        for k in range(n):
            grams += found[k : len(found) - n + 1 + k] * factors[k]
        whole = owner[: len(grams)] == owner[n - 1 :]
        grams, of = mix(grams[whole] + U64(n)), owner[: len(grams)][whole]
    short = np.flatnonzero((counts > 0) & (counts < n))
    if len(short):
        begin = np.cumsum(counts) - counts
        few = np.array(
            [(found[begin[t] : begin[t] + counts[t]] * factors[: counts[t]]).sum(dtype=U64) for t in short], U64
        )
        grams = np.append(grams, mix(few + counts[short].astype(U64)))
        of = np.append(of, short)
        order = np.argsort(of, kind="stable")
        grams, of = grams[order], of[order]
    each = np.bincount(of, minlength=texts)
    ends = np.cumsum(each)
    for a, b in zip((ends - each).tolist(), ends.tolist()):
        grams[a:b].sort()
    new = np.ones(len(grams), bool)
    new[1:] = (grams[1:] != grams[:-1]) | (of[1:] != of[:-1])
    return grams[new], of[new], np.bincount(of[new], minlength=texts)


def set_keys(grams: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """One 64-bit hash per set, as a signed number; 0 for the empty set."""
    keys = np.zeros(len(sizes), U64)
    full = sizes > 0
    if full.any():
        begin = (np.cumsum(sizes) - sizes)[full]
        total = np.add.reduceat(mix(grams ^ U64(0xA0761D6478BD642F)), begin)
        keys[full] = mix(total + sizes[full].astype(U64)) | U64(1)
    return keys.view(np.int64)


def sketch_bits(size: int) -> int:
    """Bits of a set's parity sketch: the power of two above twice its size, 64 at least."""
    return max(64, 1 << (2 * int(size)).bit_length())


def sketches(grams: np.ndarray, sizes: np.ndarray) -> list[bytes]:
    """Parity sketches: each n-gram flips one bit. Two of them differ in no more bits than their sets in n-grams."""
    out, ends = [], np.cumsum(sizes)
    for size, end in zip(sizes.tolist(), ends.tolist()):
        bits = sketch_bits(size)
        flips = np.bincount((grams[end - size : end] & U64(bits - 1)).astype(np.int64), minlength=bits) & 1
        out.append(np.packbits(flips.astype(np.uint8), bitorder="little").tobytes())
    return out


def fold(sketch: np.ndarray, size: int) -> np.ndarray:
    """The sketch with fewer bytes; again one of the same set."""
    while len(sketch) > size:
        sketch = sketch[: len(sketch) // 2] ^ sketch[len(sketch) // 2 :]
    return sketch


_COUNT = pa.schema([("id_", pa.int64()), ("n_", pa.int64()), ("key_", pa.int64()), ("sketch_", pa.binary()),
                    ("gram_", pa.int64()), ("df_", pa.int64())])


def _summaries(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    """A row per document, and rows (gram, documents) of what is frequent in a slab of documents."""
    slab, held, seen = [], 0, 0

    def frequent() -> pa.RecordBatch:
        values, counts = np.unique(np.concatenate(slab), return_counts=True)
        often = (counts * FREQUENT >= seen) & (counts >= 8)
        none = pa.nulls(int(often.sum()), pa.int64())
        return pa.RecordBatch.from_arrays(
            [none, none, none, pa.nulls(len(none), pa.binary()), pa.array(values[often].view(np.int64)), pa.array(counts[often])],
            schema=_COUNT,
        )

    for batch in batches:
        for row, data, offsets in chunks(batch.column(1)):
            grams, _, sizes = shingle_sets(data, offsets, n)
            texts = len(sizes)
            none = pa.nulls(texts, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(row, texts), pa.array(sizes.astype(np.int64)), pa.array(set_keys(grams, sizes)),
                 pa.array(sketches(grams, sizes), pa.binary()), none, none],
                schema=_COUNT,
            )
            slab.append(grams)
            held, seen = held + len(grams), seen + texts
            if held >= SLAB:
                yield frequent()
                slab, held, seen = [], 0, 0
    if held:
        yield frequent()


_SIGNED = pa.schema([("sig", pa.int64()), ("key", pa.int64()), ("spread", pa.int32())])


def _signed(batches: Iterator[pa.RecordBatch], n: int, bands: partenum.Bands, often) -> Iterator[pa.RecordBatch]:
    """Signature rows of the distinct sets of each slab.

    ``spread`` is 0 for a plain row. A signature that more than ``LARGE`` sets of the slab share
    gives a plain row only for its smallest key, with -1 in ``spread``, and each of its
    sets a row with a number from 1 on that keeps these rows apart in the shuffle.
    """
    slab: list[tuple[np.ndarray, np.ndarray]] = []
    known: set[int] = set()
    held = 0

    def rows() -> pa.RecordBatch:
        sig = np.concatenate([s for s, _ in slab])
        key = np.concatenate([k for _, k in slab])
        order = np.argsort(sig, kind="stable")
        sig, key = sig[order], key[order]
        start = np.flatnonzero(np.append(True, sig[1:] != sig[:-1]))
        count = np.diff(np.append(start, len(sig)))
        spread = np.zeros(len(sig), np.int32)
        heads = []
        for a, c in zip(start[count > LARGE].tolist(), count[count > LARGE].tolist()):
            spread[a : a + c] = 1 + (mix(key[a : a + c].view(U64)) % U64(1 << 20)).astype(np.int32)
            heads.append((sig[a], key[a : a + c].min()))
        if heads:
            sig = np.append(sig, np.array([h[0] for h in heads], np.int64))
            key = np.append(key, np.array([h[1] for h in heads], np.int64))
            spread = np.append(spread, np.full(len(heads), -1, np.int32))
        return pa.RecordBatch.from_arrays([pa.array(sig), pa.array(key), pa.array(spread)], schema=_SIGNED)

    frequent = often.value
    for batch in batches:
        for _, data, offsets in chunks(batch.column(0)):
            grams, _, sizes = shingle_sets(data, offsets, n)
            keys = set_keys(grams, sizes)
            fresh = np.zeros(len(keys), bool)
            for i, k in enumerate(keys.tolist()):
                if k and k not in known:
                    known.add(k)
                    fresh[i] = True
            of = np.repeat(np.arange(len(sizes)), sizes)
            number = np.cumsum(fresh) - 1
            pick = fresh[of]
            sig, owner = partenum.signatures(grams[pick], number[of[pick]], sizes[fresh], bands, frequent)
            slab.append((sig.view(np.int64), keys[fresh][owner]))
            held += len(sig)
            if held >= SLAB:
                yield rows()
                slab, held = [], 0
                known.clear()
    if held:
        yield rows()


_MET = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("sig", pa.int64())])


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of sets with one signature, from rows sorted by signature and key.

    (a, b, null): all pairs of a small group. (member, null, signature): members of a large one.
    Only an unfinished small group is held; one that grows beyond ``LARGE`` is passed on row by row.
    """
    recent: set[tuple[int, int]] = set()
    last, group, large = None, [], False
    out: list[tuple] = []

    def close() -> None:
        if large or len(group) < 2:
            return
        for j in range(1, len(group)):
            for i in range(j):
                pair = (group[i], group[j])
                if pair not in recent:
                    recent.add(pair)
                    out.append((*pair, None))

    def table() -> pa.RecordBatch:
        columns = list(zip(*out)) if out else [[], [], []]
        out.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], schema=_MET)

    for batch in batches:
        sig, key, spread = (batch.column(i).to_numpy() for i in range(3))
        # Rows whose signature occurs once are most of them and need no Python.
        same = np.zeros(len(sig), bool)
        same[1:] |= sig[1:] == sig[:-1]
        same[:-1] |= sig[1:] == sig[:-1]
        same |= spread != 0
        same[:1] = same[-1:] = True
        for s, k, p in zip(sig[same].tolist(), key[same].tolist(), spread[same].tolist()):
            if p > 0:
                out.append((k, None, s))
                continue
            if s != last:
                close()
                last, group, large = s, [], False
            if group and group[-1] == k and p == 0:
                continue
            if large:
                out.append((k, None, s))
                continue
            group.append(k)
            if p < 0 or len(group) > LARGE:
                large = True
                out.extend((k, None, s) for k in group)
                group = []
        if len(recent) > 1 << 18:
            recent.clear()
        yield table()
    close()
    yield table()


def _bounded(batches: Iterator[pa.RecordBatch], bands: partenum.Bands) -> Iterator[pa.RecordBatch]:
    """Pairs whose sizes and sketches leave it possible that they link."""
    for batch in batches:
        na, nb = batch.column(2).to_numpy(), batch.column(3).to_numpy()
        most = bands.differ(na + nb)
        keep = np.abs(na - nb) <= most
        for i in np.flatnonzero(keep):
            x = np.frombuffer(batch.column(4)[i].as_buffer(), np.uint8)
            y = np.frombuffer(batch.column(5)[i].as_buffer(), np.uint8)
            size = min(len(x), len(y))
            keep[i] = np.bitwise_count(fold(x, size) ^ fold(y, size)).sum() <= most[i]
        yield pa.RecordBatch.from_arrays(batch.columns[:2], names=["a", "b"]).filter(pa.array(keep))


def _sets(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    """Sets of texts; a text found by an id that several rows have counts only if its key is the one wanted."""
    for batch in batches:
        for row, data, offsets in chunks(batch.column(1)):
            grams, _, sizes = shingle_sets(data, offsets, n)
            wanted = batch.column(0).slice(row, len(sizes)).to_numpy()
            right = np.flatnonzero(set_keys(grams, sizes) == wanted)
            ends = np.cumsum(sizes)
            sets = [grams[e - s : e].tobytes() for s, e in zip(sizes[right].tolist(), ends[right].tolist())]
            yield pa.RecordBatch.from_arrays(
                [pa.array(wanted[right]), pa.array(sets, pa.binary())], names=["key", "grams"]
            )


def _linked(batches: Iterator[pa.RecordBatch], num: int, den: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = np.zeros(batch.num_rows, bool)
        for i in range(batch.num_rows):
            x = np.frombuffer(batch.column(2)[i].as_buffer(), U64)
            y = np.frombuffer(batch.column(3)[i].as_buffer(), U64)
            both = len(np.intersect1d(x, y, assume_unique=True))
            keep[i] = den * both >= num * (len(x) + len(y) - both)
        yield pa.RecordBatch.from_arrays(batch.columns[:2], names=["a", "b"]).filter(pa.array(keep))


def _in_blocks(table: pa.Table, bands: partenum.Bands) -> pa.Table:
    """Pairs of a block of minor members (side 0) and a block of any (side 1) of one group, in different components, that their sketches let link."""
    side, key, root, n = (table.column(c).to_numpy() for c in ("side", "key", "root", "n"))
    minor = table.column("minor").to_numpy()
    raw = [np.frombuffer(x.as_buffer(), np.uint8) for x in table.column("sketch").combine_chunks()]
    long = np.array([len(r) for r in raw])
    left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    a, b = [], []
    for size in np.unique(long[left]).tolist():
        # Both sides folded to the shorter sketch, once for each length.
        for other in np.unique(long[right]).tolist():
            width = min(size, other)
            ys = right[long[right] == other]
            folded = np.stack([fold(raw[y], width) for y in ys])
            for x in left[long[left] == size]:
                most = bands.differ(n[ys] + n[x])
                may = (root[ys] != root[x]) & (np.abs(n[ys] - n[x]) <= most) & (~minor[ys] | (key[ys] > key[x]))
                if may.any():
                    apart = np.bitwise_count(folded[may] ^ fold(raw[x], width)).sum(axis=1, dtype=np.int64)
                    some = ys[may][apart <= most[may]]
                    a.extend([key[x]] * len(some))
                    b.extend(key[some].tolist())
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, num: int = 3, den: int = 4
) -> DataFrame:
    """One row per document: id, ``n_shingles`` and ``component_id``, the smallest id linked with it, directly or not.

    ``num / den`` is the least similarity; ``n`` the words of an n-gram.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    bands = partenum.Bands(num, den)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    source = docs.select(F.col(f"`{id_col}`").cast("long").alias("id_"), F.col(f"`{text_col}`").alias("text_"))

    summary = scratch.keep(
        source.mapInArrow(partial(_summaries, n=n), "id_ long, n_ long, key_ long, sketch_ binary, gram_ long, df_ long"),
        "summary",
    )
    each = summary.where("key_ is not null")
    total = each.count()
    often = (
        summary.where("gram_ is not null").groupBy("gram_").agg(F.sum("df_").alias("df"))
        .where(F.col("df") * FREQUENT >= total).orderBy(F.desc("df"), "gram_").limit(MOST_FREQUENT).select("gram_")
    )
    frequent = np.sort(often.toPandas()["gram_"].to_numpy(np.int64).view(U64))
    sent = spark.sparkContext.broadcast(frequent)

    signed = source.select("text_").mapInArrow(
        partial(_signed, n=n, bands=bands, often=sent), "sig long, key long, spread int"
    )
    met = scratch.keep(
        signed.repartition(parts, "sig", F.greatest("spread", F.lit(0)))
        .sortWithinPartitions("sig", F.greatest("spread", F.lit(0)), "key")
        .mapInArrow(_met, "a long, b long, sig long"),
        "met",
    )
    release(spark)
    # A large group as a star around its smallest key.
    member = met.where("sig is not null").select("sig", F.col("a").alias("key")).distinct()
    leader = member.groupBy("sig").agg(F.min("key").alias("least"))
    star = member.join(leader, "sig").where("key > least").select(F.col("least").alias("a"), F.col("key").alias("b"))
    pairs = met.where("sig is null").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))

    sets = scratch.keep(
        each.where("key_ <> 0").groupBy(F.col("key_").alias("key"))
        .agg(F.min("id_").alias("id"), F.first("n_").alias("n"), F.first("sketch_").alias("sketch")),
        "sets",
    )

    def verified(candidates: DataFrame) -> DataFrame:
        small = sets.select("key", "n", "sketch")
        joined = (
            candidates.distinct()
            .join(small.toDF("a", "na", "sa"), "a").join(small.toDF("b", "nb", "sb"), "b")
            .select("a", "b", "na", "nb", "sa", "sb")
        )
        possible = scratch.keep(joined.mapInArrow(partial(_bounded, bands=bands), "a long, b long"), "possible")
        release(spark)
        wanted = possible.select("a").union(possible.select("b")).distinct()
        keyed = each.where("key_ <> 0").select(F.col("id_"), F.col("key_").alias("key")).join(wanted.toDF("key"), "key")
        # One text for each wanted set; a set that only documents without an id have is found by them.
        one = keyed.groupBy("key").agg(F.min("id_").alias("id_"))
        texts = source.join(one, source["id_"].eqNullSafe(one["id_"])).select("key", "text_")
        made = texts.mapInArrow(partial(_sets, n=n), "key long, grams binary")
        made = scratch.keep(made, "wanted")
        release(spark)
        found = scratch.keep(
            possible.join(made.toDF("a", "ga"), "a").join(made.toDF("b", "gb"), "b")
            .select("a", "b", "ga", "gb").mapInArrow(partial(_linked, num=num, den=den), "a long, b long").distinct(),
            "links",
        )
        scratch.drop(possible, made)
        release(spark)
        return found

    links = verified(pairs.union(star))
    roots = scratch.keep(components(links, scratch), "roots")
    # Large groups that are still in several components.
    placed = member.join(roots.toDF("key", "root"), "key", "left").select(
        "sig", "key", F.coalesce("root", "key").alias("root")
    )
    by_root = placed.groupBy("sig", "root").agg(
        F.count("*").alias("n"), F.sum(F.xxhash64("key") % 1_000_000_007).alias("whom")
    )
    open_groups = (
        by_root.groupBy("sig")
        .agg(F.max(F.struct("n", "root")).alias("main"), F.sum("n").alias("members"), F.sum("whom").alias("whom"),
             F.count("*").alias("roots"))
        .where("roots > 1")
        .groupBy("members", "whom", "main").agg(F.min("sig").alias("sig"))
        .select("sig", F.col("main.root").alias("main"))
    )
    # The groups around one component are handled as one, as they have nearly the same members.
    around = scratch.keep(placed.join(open_groups, "sig").select("main", "key", "root").distinct(), "around")
    minor = F.col("root") != F.col("main")
    sizes = around.groupBy("main").agg(
        F.ceil(F.sum(minor.cast("int")) / BLOCK).cast("int").alias("few"), F.ceil(F.count("*") / BLOCK).cast("int").alias("all")
    )
    rest = scratch.keep(around.join(sizes, "main").withColumn("minor", minor), "open")
    if rest.head(1):
        # Members outside a group's largest component meet all members; those inside it need not meet each other.
        own = F.xxhash64("key")
        each_block = F.sequence(F.lit(0), F.when(F.col("side") == 0, F.col("all")).otherwise(F.col("few")) - 1)
        sides = rest.withColumn(
            "side", F.explode(F.when(F.col("minor"), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(1))))
        ).withColumn("other", F.explode(each_block))
        dealt = sides.select(
            "main", "key", "root", "minor", "side",
            F.when(F.col("side") == 0, F.pmod(own, F.col("few")).cast("int")).otherwise(F.col("other")).alias("i"),
            F.when(F.col("side") == 0, F.col("other")).otherwise(F.pmod(own, F.col("all")).cast("int")).alias("j"),
        )
        found = (
            dealt.join(sets.select("key", "n", "sketch"), "key")
            .groupBy("main", "i", "j").applyInArrow(lambda table: _in_blocks(table, bands), "a long, b long")
        )
        links = scratch.keep(links.union(verified(found)), "all-links")
        roots = scratch.keep(components(links, scratch), "all-roots")

    least = (
        sets.select("key", "id").join(roots.toDF("key", "root"), "key", "left")
        .withColumn("root", F.coalesce("root", "key"))
    )
    smallest = least.groupBy("root").agg(F.min("id").alias("component_id"))
    named = least.join(smallest, "root").select(F.col("key").alias("key_"), "component_id")
    return each.join(named, "key_", "left").select(
        F.col("id_").alias(id_col),
        F.col("n_").alias("n_shingles"),
        F.when(F.col("key_") == 0, F.col("id_")).otherwise(F.col("component_id")).alias("component_id"),
    )
