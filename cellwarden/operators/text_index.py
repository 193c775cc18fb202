"""A written inverted index with block maxima, and exact ranked search that skips blocks.

Documents are dealt into blocks of about ``BLOCK_DOCS``, fewer if they are long: first by length (half octaves), then by a hash of the id, so the documents of a block
are about equally long and the greatest weight of a term in a block bounds all of them closely. One row per block and term holds the
documents, their weights and the greatest weight; rows lie in folders by shard, a run of blocks. Terms are counted inside each document,
which then moves whole to its block, where the lists of all its terms are made.

A search reads the greatest weights of its terms and sums them to a bound per query and block. The ``FIRST`` blocks with the highest
bounds are scored; the k-th best score found there is a floor, and further blocks are scored only if their bound reaches
it. A block is scored in one place from its own lists, and only its k best documents per query leave it, so queries never meet
documents row by row. Shards without a block to score are not read.

Defined results: documents without tokens are counted and never found; a null text counts as no document. Rows that share an id add up.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cellwarden.functions.text import TOKEN
from cellwarden.scale import lookup_join
from cellwarden.session import cut_lineage, scratch_path

K1, B = 1.2, 0.75
SCORE_DIGITS = 6
BLOCK_DOCS = 1024
#: Tokens of a block, about: long documents make smaller blocks.
BLOCK_TOKENS = 4_000_000
#: Texts that are counted at a time.
TEXTS = 1000
#: Blocks of a folder at least, and folders at most.
SHARD_BLOCKS, SHARDS = 16, 4096
#: Blocks of a query that are scored before the others are compared with the floor.
FIRST = 2
#: Queries that meet a block's lists at a time.
QUERIES = 2048


@dataclass
class TextIndex:
    """The tables of a written index: ``postings``, ``terms`` and one row of ``stats``."""

    spark: SparkSession
    path: str

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}")


def length_class(length: Column) -> Column:
    return F.floor(2 * F.log2(length + 1)).cast("int")


def block_of(classes: list[tuple[int, int]], block_docs: int, length: str = "length") -> tuple[Column, int]:
    """Block of a document by ``length`` and ``doc_id``, and the number of blocks; ``classes`` holds (class, documents)."""
    firsts, sizes, total = [], [], 0
    for name, docs in sorted(classes):  # a class per half octave of lengths
        number = -(-docs // block_docs)
        firsts += [F.lit(name), F.lit(total)]
        sizes += [F.lit(name), F.lit(number)]
        total += number
    if not classes:
        return F.lit(0), 0
    own = length_class(F.col(length))
    return F.create_map(*firsts)[own] + F.pmod(F.xxhash64("doc_id"), F.create_map(*sizes)[own]).cast("int"), total


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, length and (term, tf) of the distinct terms of each lower-cased text."""
    token = re.compile(TOKEN)
    for batch in batches:
        for start in range(0, batch.num_rows, TEXTS):
            ids, texts = batch.slice(start, TEXTS).columns
            lengths, ends, terms, times = [], [0], [], []
            for text in texts.to_pylist():
                found = Counter(token.findall(text))
                lengths.append(sum(found.values()))
                terms += found.keys()
                times += found.values()
                ends.append(len(terms))
            pairs = pa.StructArray.from_arrays([pa.array(terms, pa.string()), pa.array(times, pa.int32())], names=["term", "tf"])
            words = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pairs)
            yield pa.RecordBatch.from_arrays([ids, pa.array(lengths, pa.int32()), words], names=["doc_id", "length", "words"])


def lists_of_block(docs: pa.Table, mean: float, of_shard: int, names: list[str]) -> pa.Table:
    """One row per term of a block: its documents in order, their weights and the greatest weight. Rows of one id add up."""
    own = pc.dictionary_encode(docs["doc_id"].combine_chunks(), null_encoding="encode")
    ids = own.dictionary
    place = np.empty(len(ids), dtype=np.int64)
    place[pc.array_sort_indices(ids, null_placement="at_start").to_numpy()] = np.arange(len(ids))
    lengths = docs["length"].to_numpy().astype(np.int64)
    document = place[own.indices.to_numpy()]
    order = np.lexsort((lengths, document))
    new = np.r_[True, (np.diff(document[order]) != 0) | (np.diff(lengths[order]) != 0)]
    number = np.empty(len(order), dtype=np.int64)
    number[order] = np.cumsum(new) - 1
    first = order[new]  # a row of each document, in their order

    words = docs["words"].combine_chunks()
    pairs = words.flatten()
    terms = pc.dictionary_encode(pairs.field("term"))
    key = terms.indices.to_numpy().astype(np.int64) * len(first) + np.repeat(number, words.value_lengths().to_numpy())
    sort = np.argsort(key, kind="stable")
    key = key[sort]
    starts = np.flatnonzero(np.r_[True, np.diff(key) != 0])
    tf = np.add.reduceat(pairs.field("tf").to_numpy()[sort].astype(np.int64), starts)
    term, hit = np.divmod(key[starts], len(first))
    weights = tf * (K1 + 1.0) / (tf + K1 * (1.0 - B + B * lengths[first[hit]] / mean))
    rows = np.diff(np.r_[np.flatnonzero(np.r_[True, np.diff(term) != 0]), len(term)])
    # Weights of rows of one id but several lengths add up to one entry.
    whose = document[first[hit]]
    starts = np.flatnonzero(np.r_[True, (np.diff(term) != 0) | (np.diff(whose) != 0)])
    weights, term, hit = np.add.reduceat(weights, starts), term[starts], hit[starts]
    runs = np.flatnonzero(np.r_[True, np.diff(term) != 0])
    ends = pa.array(np.r_[runs, len(term)], pa.int32())
    block = docs["block"][0].as_py()
    return pa.Table.from_arrays(
        [
            pa.array(np.full(len(runs), block // of_shard), pa.int32()), pa.array(np.full(len(runs), block), pa.int32()),
            terms.dictionary.take(pa.array(term[runs])), pa.array(np.maximum.reduceat(weights, runs)), pa.array(rows, pa.int64()),
            pa.ListArray.from_arrays(ends, docs["doc_id"].combine_chunks().take(pa.array(first[hit]))), pa.ListArray.from_arrays(ends, pa.array(weights)),
        ],
        names=names,
    )


def build_index(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", block_docs: int = BLOCK_DOCS) -> TextIndex:
    """Read and cut every text once and write the index below ``path``."""
    spark = docs.sparkSession
    id_type = docs.schema[id_col].dataType
    texts = docs.select(F.col(id_col).alias("doc_id"), F.lower(F.col(text_col)).alias("text")).where(F.col("text").isNotNull())
    # One row per row of ``docs``: its terms are counted in place, and no term is shuffled by itself.
    pairs = T.ArrayType(T.StructType([T.StructField("term", T.StringType()), T.StructField("tf", T.IntegerType())]))
    row = T.StructType([T.StructField("doc_id", id_type), T.StructField("length", T.IntegerType()), T.StructField("words", pairs)])
    counted = cut_lineage(texts.mapInArrow(_counted, row), "counted")
    # Rows that share an id go to one block, that of the longest.
    key = F.xxhash64("doc_id").alias("key")
    ids = counted.select("doc_id", "length").distinct().groupBy(key).agg(
        F.max("length").alias("longest"), F.count("*").alias("n"), F.sum("length").alias("s")
    )
    classes = ids.groupBy(length_class(F.col("longest")).alias("c")).agg(
        F.count("*").alias("ids"), F.sum("n").alias("n"), F.sum("s").alias("s"), F.max("n").alias("most")
    ).collect()
    n = sum(r["n"] for r in classes)
    mean = sum(r["s"] for r in classes) / n if n else 0.0
    sizes = [(r["c"], max(r["ids"], -(-r["s"] * block_docs // BLOCK_TOKENS))) for r in classes]
    block, blocks = block_of(sizes, block_docs, "longest")
    of_shard = max(SHARD_BLOCKS, -(-blocks // SHARDS))
    # Whole documents go to their block; all that follows happens there.
    dealt = counted.where("length > 0")
    if any(r["most"] > 1 for r in classes):
        dealt = lookup_join(dealt.withColumn("key", key), ids.where("n > 1").select("key", "longest"), ["key"], "left").drop("key")
        dealt = dealt.withColumn("longest", F.coalesce("longest", "length"))
    else:
        dealt = dealt.withColumn("longest", F.col("length"))
    dealt = dealt.select("doc_id", "length", "words", block.alias("block"))
    columns = ["shard int", "block int", "term string", "top double", "rows long", f"docs array<{id_type.simpleString()}>", "weights array<double>"]
    names = [c.split()[0] for c in columns]

    def listed(docs: pa.Table) -> pa.Table:
        return lists_of_block(docs, mean or 1.0, of_shard, names)

    lists = dealt.groupBy("block").applyInArrow(listed, ", ".join(columns))
    lists = lists.sortWithinPartitions("shard", "term", "block")
    if mean:
        lists.write.partitionBy("shard").parquet(f"{path}/postings")
    else:  # no token at all: a folder without partitions would have no schema
        lists.write.parquet(f"{path}/postings")
    written = spark.read.parquet(f"{path}/postings")
    written.groupBy("term").agg(F.sum("rows").alias("df")).write.parquet(f"{path}/terms")
    spark.range(1).select(F.lit(n).alias("n"), F.lit(mean).alias("mean_length"), F.lit(blocks).alias("blocks")).write.parquet(f"{path}/stats")
    return TextIndex(spark, path)


def best_of_block(lists: pa.Table, asked: pa.Table, k: int, names: list[str]) -> pa.Table:
    """The ``k`` best documents of one block for each query, and those that rounding may tie with them."""
    docs = lists["docs"].combine_chunks()
    codes = pc.dictionary_encode(docs.flatten(), null_encoding="encode")
    place, ids = codes.indices.to_numpy(), codes.dictionary
    weights, edges = lists["weights"].combine_chunks().flatten().to_numpy(), docs.offsets.to_numpy() - docs.offsets[0].as_py()
    at = {t: (edges[i], edges[i + 1]) for i, t in enumerate(lists["term"].to_pylist())}
    queries = pc.dictionary_encode(asked["query_id"].combine_chunks(), null_encoding="encode")
    of, terms, idf = queries.indices.to_numpy(), asked["term"].to_pylist(), asked["idf"].to_numpy()
    order = np.argsort(of, kind="stable")
    found_query, found_doc, found_score = [], [], []
    for mine in np.split(order, np.flatnonzero(np.diff(of[order])) + 1):
        scores = np.zeros(len(ids))
        for i in sorted(mine.tolist(), key=terms.__getitem__):  # one order of terms, so that sums are the same everywhere
            if terms[i] in at:
                low, high = at[terms[i]]
                scores[place[low:high]] += idf[i] * weights[low:high]
        hits = np.flatnonzero(scores)
        if len(hits) > k:
            hits = hits[scores[hits] >= np.partition(scores[hits], -k)[-k] - 10.0**-SCORE_DIGITS]
        found_query.append(np.full(len(hits), of[mine[0]]))
        found_doc.append(hits)
        found_score.append(scores[hits])
    query, doc = queries.dictionary.take(pa.array(np.concatenate(found_query))), ids.take(pa.array(np.concatenate(found_doc)))
    return pa.Table.from_arrays([query, doc, pa.array(np.concatenate(found_score))], names=names)


def _scored(index: TextIndex, visits: DataFrame, weights: DataFrame, parts: int, k: int) -> DataFrame:
    """(query_id, doc_id, score) of the best documents of the visited blocks."""
    asked = lookup_join(visits, weights, ["query_id"]).withColumn("part", F.pmod(F.xxhash64("query_id"), F.lit(parts)))
    asked = cut_lineage(asked, "visits")
    # Numbers of folders, SHARDS at most.
    shards = [r["shard"] for r in asked.select("shard").distinct().collect()]
    # Blocks and terms are looked up apart: there are few of both, but many pairs. The terms that no query asks of a block are passed over there.
    parts_of = {c: asked.select(c, F.col("part").alias("list_part")).distinct() for c in ("term", "block")}
    postings = index.table("postings").where(F.col("shard").isin(shards))
    lists = lookup_join(postings.select("block", "term", "docs", "weights"), parts_of["term"], ["term"])
    lists = lookup_join(lists, parts_of["block"], ["block", "list_part"], "left_semi")
    id_type, query_type = postings.schema["docs"].dataType.elementType, weights.schema["query_id"].dataType
    schema = T.StructType([T.StructField("query_id", query_type), T.StructField("doc_id", id_type), T.StructField("score", T.DoubleType())])
    scored = lists.groupBy(F.col("block").alias("list_block"), "list_part").cogroup(asked.groupBy("block", "part")).applyInArrow(
        partial(_block, k=k, names=schema.names), schema
    )
    return scored.withColumn("score", F.round("score", SCORE_DIGITS))


def _block(lists: pa.Table, asked: pa.Table, k: int, names: list[str]) -> pa.Table:
    return best_of_block(lists, asked, k, names)


def search_index(index: TextIndex, terms: DataFrame, k: int) -> DataFrame:
    """BM25 of query terms (query_id, term, distinct): query_id, doc_id, score, rank, at most ``k`` per query."""
    n = index.table("stats").first()["n"]
    idf = F.log(1.0 + (F.lit(n) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weights = cut_lineage(lookup_join(index.table("terms"), terms, ["term"]).select("query_id", "term", idf.alias("idf")), "weights")
    parts = max(1, -(-weights.select("query_id").distinct().count() // QUERIES))
    tops = index.table("postings").select("shard", "block", "term", "top")
    bounds = (
        lookup_join(tops, weights, ["term"])
        .groupBy("query_id", "shard", "block").agg(F.sum(F.col("idf") * F.col("top")).alias("bound"))
        .withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("bound").desc(), "block")))
    )
    bounds = cut_lineage(bounds, "bounds")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "doc_id")

    def best(found: DataFrame) -> DataFrame:
        return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

    first = cut_lineage(best(_scored(index, bounds.where(F.col("place") <= FIRST), weights, parts, k)), "first")
    floor = first.where(F.col("rank") == k).select("query_id", F.col("score").alias("floor"))
    open_blocks = (
        lookup_join(bounds.where(F.col("place") > FIRST), floor, ["query_id"], "left")
        .where(F.col("floor").isNull() | (F.col("bound") >= F.col("floor") - 10.0**-SCORE_DIGITS))
        .drop("floor")
    )
    more = _scored(index, open_blocks, weights, parts, k)
    return best(first.drop("rank").unionByName(more))


def scratch_index(docs: DataFrame, id_col: str, text_col: str) -> TextIndex:
    """An index in the shared folder, for one search or several of a run."""
    return build_index(docs, scratch_path(docs.sparkSession, "index"), id_col, text_col)
