"""The registered queries of this subpackage and the SQL they are compared with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cellwarden.llm import (
    block_topk,
    class_lm,
    compression_quality,
    fill_middle,
    merkle,
    metric_join,
    mixing,
    ngram_join,
    piece_codec,
    secrets,
    tables,
    token_files,
    toxicity,
    url_rules,
)
from cellwarden.llm.tables import new_path

#: Host, path and verdict of the listed URL rules.
URL_RULES = [
    ("org", "/", url_rules.ALLOW),
    ("example.org", "/es/", url_rules.BLOCK),
    ("example.org", "/en/1", url_rules.BLOCK),
    ("com", "/fr/", url_rules.ALLOW),
    ("com", "/de/", url_rules.BLOCK),
]
#: Parts of the mixture; sources without a weight share one part.
SOURCE_WEIGHTS = {"src0": 6, "src1": 3, "src2": 3, "src4": 2, "src5": 2, "src8": 2}
END_ID = 2


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remainder(column: str) -> Column:
    """crc32 of an id as text, modulo 5; of an empty text for a null id."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % 5


def toxicity_model(docs: DataFrame, labels: DataFrame) -> toxicity.Model:
    """Fitted on labelled documents outside the held-out fifth, at most 1,000 of each class."""
    known = labels.where((remainder("doc_id") != 0) & F.col("toxic").isin(0, 1)).select("doc_id", "toxic")
    totals = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    chosen = known.where("toxic = 0").orderBy(*order).limit(1000).union(known.where("toxic = 1").orderBy(*order).limit(1000))
    # 2,000 rows of two numbers at most, so the texts need no shuffle.
    joined = tables.Scratch(docs.sparkSession).keep(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id"), "labelled")
    return toxicity.train(joined, F.col("text"), F.col("toxic"), F.col("doc_id"), sample=1000, marks=128, totals=totals)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity_model(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).select(
        "doc_id", (remainder("doc_id") == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


def op2_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return block_topk.top_k(table(spark, sf_dir, "embeddings"), k=5, every=50)


def op3_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_rules.judge(table(spark, sf_dir, "pages"), URL_RULES)


def op4_class_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return class_lm.score(table(spark, sf_dir, "documents"), remainder("doc_id") != 1)


def op5_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    known = secrets.dictionary(docs)
    trees = secrets.fit(secrets.labelled_findings(docs, known))
    return secrets.find(docs, known, trees).withColumn("is_secret", F.col("probability") >= 0.5)


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return piece_codec.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op7_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mixing.mix(docs, SOURCE_WEIGHTS, block=64, other_weight=8).drop("text")


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = new_path(spark, "tokens")
    docs = table(spark, sf_dir, "documents")
    token_files.write_tokens(docs, path, public_tokenizers.path("byte_bpe_50k.json"), END_ID, special=True)
    return token_files.digests(token_files.read_tokens(spark, path))


def op9_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(table(spark, sf_dir, "documents"), n=5, num=3, den=4)


def op10_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metric_join.near_vectors(table(spark, sf_dir, "embeddings"), bound=0.93)


def quality_model(docs: DataFrame, labels: DataFrame) -> compression_quality.Model:
    """Fitted on labelled documents outside the held-out fifth, at most 4,000 of each class."""
    known = labels.where((remainder("doc_id") != 0) & F.col("quality").isin(0, 1)).select("doc_id", "quality")
    totals = {r["quality"]: r["count"] for r in known.groupBy("quality").count().collect()}
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    chosen = known.where("quality = 0").orderBy(*order).limit(4000).union(known.where("quality = 1").orderBy(*order).limit(4000))
    # 8,000 rows of two numbers at most, so the texts need no shuffle.
    scratch = tables.Scratch(docs.sparkSession)
    joined = scratch.keep(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id"), "labelled")
    model = compression_quality.train(joined, F.col("text"), F.col("quality"), F.col("doc_id"), sample=4000, blocks=8000, totals=totals)
    scratch.drop(joined)
    return model


def op11_compression_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality_model(docs, table(spark, sf_dir, "labels"))
    return compression_quality.score(docs, model).select(
        "doc_id", (remainder("doc_id") == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted")
    )


def document_leaves(docs: DataFrame) -> DataFrame:
    """Leaves of documents in groups by language; the item is the id and the leaf to fold, of a tampered text where 3 divides the id's CRC-32."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    fields = ["doc_id", "source", "lang", "n_chars"]
    plain = merkle.leaf([F.col(c) for c in [*fields, "text"]])
    tampered = merkle.leaf([*map(F.col, fields), F.translate("text", upper, lower)])
    # An id that is null has no CRC-32 and stays as it is.
    start = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0, tampered)
    rows = docs.select(merkle.group_key(F.col("lang")).alias("group_"), F.col("doc_id").cast("long").alias("doc_id"), plain.alias("digest"), start.alias("start"))
    return rows.select("group_", "doc_id", "digest", F.struct("doc_id", "start").alias("item"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = merkle.manifest(document_leaves(table(spark, sf_dir, "documents")), ["doc_id", "digest"])
    start = F.coalesce("item.start", "digest")
    rows = made.proofs().select(
        F.col("item.doc_id").alias("doc_id"), F.col("digest").alias("leaf"), "subroot", "root",
        merkle.digest(merkle.siblings(F.col("path"))).alias("proof_sha256"), merkle.folded(start, F.col("path")).alias("folded_root"),
    )
    return rows.withColumn("verified", F.col("folded_root") == F.col("root"))


def op13_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_middle.transform(table(spark, sf_dir, "documents"), seed=1, rate=90, spm=20)
    back = fill_middle.restored(F.col("output"), F.col("form"))
    return made.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars",
        F.sha2("output", 256).alias("output_sha256"), F.sha2(back, 256).alias("restored_sha256"),
    )


def _prepared(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return query(tables.bounded_batches(spark), sf_dir)

    return run


_ALL = (
    op1_toxicity, op2_exact_topk, op3_url_filters, op4_class_lm, op5_secret_scans, op6_sentencepiece, op7_source_mixing, op8_token_files,
    op9_ngram_jaccard_join, op10_embedding_near_dedup, op11_compression_quality, op12_merkle_manifest, op13_fill_middle,
)
QUERIES = {query.__name__: _prepared(query) for query in _ALL}
