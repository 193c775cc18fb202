"""Quality scores of texts by compression with two zstandard dictionaries.

Two dictionaries are built, from blocks of texts labelled good and of texts labelled bad. A text is cut into blocks of ``BLOCK`` bytes, each block is
compressed alone with either dictionary, and the sizes are summed over the whole text. The bad size less the good one, divided by the
text's bytes, is the normalised difference: texts like the good ones gain more from the good dictionary. Blocks keep the
dictionary's share equal in short and long texts, as a long text compressed at once becomes its own dictionary.

Calibration: the share of good texts as a rising function of the difference, by pooling adjacent violators, with straight lines
between the pools. Half of the labelled texts, by a hash of their key, make the dictionaries, the other half the curve, weighted to the
classes' shares among all labelled rows.

Training takes at most ``sample`` labelled texts of each class, those with the smallest hash of their key, and at most ``blocks`` of their blocks
for a dictionary, again by hash, so the result does not depend on the partitions. Only those blocks, and one number for each text of the other half, pass
through the driver.

Defined results: a null or empty text has the difference 0 and gets the score of that. Every row gets a score, repeated rows equal ones. Rows
with null labels teach nothing. If one class lacks texts for a dictionary, or no text is left for the curve, every score is the share
of good rows (0 without any labelled rows).
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellwarden.llm.tables import Scratch
from cellwarden.llm.textbatch import flat

BLOCK = 1024
DICTIONARY = 112 << 10
LEVEL = 3


def dictionary(samples: list[bytes], size: int = DICTIONARY) -> bytes:
    """A trained dictionary; of too few samples for training, the samples themselves, as raw content."""
    try:
        return zstandard.train_dictionary(size, samples, level=LEVEL).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"".join(samples)[:size]


def compressor(made: bytes) -> zstandard.ZstdCompressor:
    held = zstandard.ZstdCompressionDict(made)
    held.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=held, write_content_size=False, write_dict_id=False)


def size(text: memoryview, by: zstandard.ZstdCompressor) -> int:
    """Compressed bytes of all blocks of a text."""
    return sum(len(by.compress(text[i : i + BLOCK])) for i in range(0, len(text), BLOCK))


def differences(column: pa.Array, bad: zstandard.ZstdCompressor, good: zstandard.ZstdCompressor) -> np.ndarray:
    """Normalised size difference of each text."""
    data, offsets = flat(column)
    view, places = memoryview(data), offsets.tolist()
    out = np.zeros(len(column))
    for i, (a, b) in enumerate(zip(places[:-1], places[1:])):
        if b > a:
            out[i] = (size(view[a:b], bad) - size(view[a:b], good)) / (b - a)
    return out


def rising(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the rising curve of y (0 or 1) over x: pools of adjacent violators, half a row of each class added to each."""
    order = np.lexsort((y, x))
    pools: list[list[float]] = []  # sums of x, y and weight
    for a, b, w in zip(x[order].tolist(), y[order].tolist(), (weight / weight.mean())[order].tolist()):
        pools.append([a * w, b * w, w])
        while len(pools) > 1 and pools[-2][1] * pools[-1][2] >= pools[-1][1] * pools[-2][2]:
            last = pools.pop()
            pools[-1] = [p + q for p, q in zip(pools[-1], last)]
    sums = np.array(pools)
    return sums[:, 0] / sums[:, 2], np.maximum.accumulate((sums[:, 1] + 0.5) / (sums[:, 2] + 1))


@dataclass
class Model:
    """Both dictionaries (None where every score is the same) and the curve's knots."""

    bad: bytes | None
    good: bytes | None
    knots: np.ndarray
    shares: np.ndarray


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(label, block) of all blocks of the texts."""
    for batch in batches:
        data, offsets = flat(batch.column(1))
        raw = data.tobytes()
        for label, a, b in zip(batch.column(0).to_pylist(), offsets[:-1].tolist(), offsets[1:].tolist()):
            if b > a:
                cut = [raw[i : min(i + BLOCK, b)] for i in range(a, b, BLOCK)]
                yield pa.RecordBatch.from_arrays([pa.array([label] * len(cut), pa.int64()), pa.array(cut, pa.binary())], names=["label", "block"])


def _differences(batches: Iterator[pa.RecordBatch], dictionaries) -> Iterator[pa.RecordBatch]:
    bad, good = map(compressor, dictionaries.value)
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(differences(batch.column(1), bad, good))], names=["label", "x"])


def train(
    texts: DataFrame, text: Column, label: Column, key: Column, sample: int = 4000, blocks: int = 8000, totals: Mapping[int, int] | None = None
) -> Model:
    """Fit on rows with a label of 0 (bad) or 1 (good).

    ``sample`` bounds the texts of each class, ``blocks`` the blocks of a dictionary. ``totals`` tells the labelled rows of each
    class if ``texts`` is a sample of them already.
    """
    spark = texts.sparkSession
    scratch = Scratch(spark)
    rows = texts.select(text.alias("text"), label.cast("long").alias("label"), key.cast("string").alias("key")).where("label in (0, 1)")
    counts = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    totals = totals or counts
    none, some = totals.get(0, 0), totals.get(1, 0)
    flat_model = Model(None, None, np.zeros(1), np.array([some / max(1, none + some)]))
    order = [F.xxhash64("key"), F.xxhash64("text"), F.col("key")]
    chosen = rows.where("label = 0").orderBy(*order).limit(sample).union(rows.where("label = 1").orderBy(*order).limit(sample))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    chosen = scratch.keep(chosen.repartition(parts, "key", F.xxhash64("text")).withColumn("half", F.xxhash64(F.lit("half"), "key") % 2 == 0), "labelled")
    cut = chosen.where("half").select("label", "text").mapInArrow(_blocks, "label long, block binary")
    cut = scratch.keep(cut.withColumn("order", F.xxhash64("block")), "blocks")
    made = []
    for c in (0, 1):
        picked = cut.where(F.col("label") == c).orderBy("order", "block").limit(blocks).select("block").collect()  # of a bounded size each
        made.append(dictionary([bytes(r["block"]) for r in picked]))
    if not all(made):
        scratch.drop(cut, chosen)
        return flat_model
    sent = spark.sparkContext.broadcast(tuple(made))
    curve = chosen.where(~F.col("half")).select("label", "text").mapInArrow(partial(_differences, dictionaries=sent), "label long, x double")
    points = curve.toPandas()  # a number for each of 2 * sample texts at most
    scratch.drop(cut, chosen)
    y = points["label"].to_numpy()
    if not len(y):
        return flat_model
    share = {c: totals.get(c, 0) / max(1, min(sample, counts.get(c, 0))) for c in (0, 1)}
    return Model(*made, *rising(points["x"].to_numpy(), y.astype(float), np.where(y == 1, share[1], share[0])))


def _scores(batches: Iterator[pa.RecordBatch], model) -> Iterator[pa.RecordBatch]:
    dictionaries, knots, shares = model.value
    by = dictionaries and [compressor(d) for d in dictionaries]
    for batch in batches:
        x = differences(batch.column(1), *by) if by else np.zeros(batch.num_rows)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(x), pa.array(np.interp(x, knots, shares))], names=["id_", "difference", "score"])


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Id, ``difference`` and ``score`` (the share of good texts at that difference) of every row."""
    dictionaries = model.bad and (model.bad, model.good)
    sent = docs.sparkSession.sparkContext.broadcast((dictionaries, model.knots, model.shares))
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id_"), F.col(f"`{text_col}`").alias("text_"))
    made = rows.mapInArrow(partial(_scores, model=sent), "id_ long, difference double, score double")
    return made.withColumnRenamed("id_", id_col)
