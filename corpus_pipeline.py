"""A training corpus from raw documents, as stages that each take and give the documents table.

``toxicity``: documents that the classifier rejects go. ``near_duplicates``: of each group of near
duplicates the document with the smallest id stays. ``secrets``: secrets in the texts are replaced, the documents
stay. ``mixing``: rows are put in the order of the mixture of sources, over all files. ``tokens``: each text
becomes token ids, with its place in the mixture (number of the file and row in it).

Rows with the same id and text are one document. Different texts under one id are documents of their own; of those in one
group the one with the smallest hash of its text stays. A row without an id counts as larger than all ids. Rows with null texts have a text without
words: they are in no group and keep their null. Empty tables give empty tables. Extra columns are kept up to the
last stage.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

import public_tokenizers
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cellwarden.llm import mixing, ngram_join, piece_codec, queries, secrets, tables, toxicity

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score below 0.5."""
    model = queries.toxicity_model(docs, queries.table(spark, sf_dir, "labels"))
    score = tables.fresh("score", docs.columns)
    scored = toxicity.with_scores(docs, model, score)
    return scored.where(F.col(f"`{score}`") < 0.5).drop(score)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near duplicates (five words, similarity 0.75).

    Rows are told apart by a hash of id and text, so texts that share an id are judged each by itself.
    """
    key = F.xxhash64("doc_id", "text").alias("key_")
    groups = ngram_join.near_duplicates(docs.select(key.alias("doc_id"), "text"), n=5, num=3, den=4)
    groups = groups.select(F.col("doc_id").alias("key_"), "component_id").distinct()
    order = F.struct(F.col("doc_id").isNull().alias("without"), "doc_id", F.xxhash64("text").alias("hash"), "key_")
    least = docs.select(key, "doc_id", "text").select("key_", order.alias("order_")).join(groups, "key_")
    stay = least.groupBy("component_id").agg(F.min("order_").alias("first_")).select(F.col("first_.key_").alias("key_"))
    rows = docs.select(key, F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns]).alias("hash_"), F.struct("*").alias("row_"))
    once = Window.partitionBy("key_").orderBy("hash_")
    return (
        rows.join(stay, "key_", "left_semi")
        .withColumn("number_", F.row_number().over(once)).where("number_ = 1").select("row_.*")
    )


def replace_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with ``[SECRET]`` in place of each finding that the forest keeps."""
    known = secrets.dictionary(docs)
    trees = secrets.fit(secrets.labelled_findings(docs, known))
    return secrets.redact(docs, known, trees)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents in the order of the mixture."""
    mixed = mixing.mix(docs, queries.SOURCE_WEIGHTS, block=64, other_weight=8)
    return mixing.in_order(mixed, mixing.mixture_columns(docs)[2]).select(*[F.col(f"`{c}`") for c in docs.columns])


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Per document: doc_id, ids, n_tokens, and its place: ``mix_file`` and ``mix_row`` (null if docs is no file)."""
    path = public_tokenizers.path("piece_bpe_32k.model")
    file = F.regexp_extract("_metadata.file_name", r"part-(\d+)", 1).cast("int")
    try:
        rows = docs.select(
            F.col("doc_id").cast("long"), file.alias("mix_file"), F.col("_metadata.row_index").alias("mix_row"), "text"
        )
    except AnalysisException:  # rows that come from no file have no place in one
        none = F.lit(None)
        rows = docs.select(F.col("doc_id").cast("long"), none.cast("int").alias("mix_file"), none.cast("long").alias("mix_row"), "text")
    made = rows.mapInArrow(
        partial(piece_codec.encode, path=path), "doc_id long, mix_file int, mix_row long, ids array<int>"
    )
    return made.select("doc_id", "ids", F.size("ids").cast("long").alias("n_tokens"), "mix_file", "mix_row")


def _prepared(stage: Stage) -> Stage:
    """The stage, with Arrow batches bounded in bytes."""

    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        return stage(tables.bounded_batches(spark), docs, sf_dir)

    return run_stage


STAGES = [
    ("toxicity", _prepared(drop_toxic)),
    ("near_duplicates", _prepared(drop_near_duplicates)),
    ("secrets", _prepared(replace_secrets)),
    ("mixing", _prepared(mix_sources)),
    ("tokens", _prepared(encode_tokens)),
]

#: SQL cannot express the classifier, the forest and the search; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages one after another, each written to the shared folder and read again."""
    scratch = tables.Scratch(spark)
    docs = queries.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = scratch.keep(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
