"""Text to vector."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellwarden.functions.text import TOKEN

Embedder = Callable[[Iterator[pd.Series]], Iterator[pd.Series]]


def embed_with_model(df: DataFrame, text_col: str, embedder: Embedder, out: str = "embedding") -> DataFrame:
    """Use an external model: ``embedder`` maps an iterator of text batches to vectors.

    The iterator form lets it load its model once per task. NULL marks a failed text.
    """

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        yield from embedder(batches)

    model = F.pandas_udf(run, "array<double>")
    return df.withColumn(out, model(F.col(text_col)))


def embed_texts(df: DataFrame, text_col: str, dim: int = 64, out: str = "embedding") -> DataFrame:
    """Default embedder: hashed term counts of the whole text, scaled to unit length.

    A token's bucket comes from the first 32 bits of its MD5 value. One pass over the texts, without a shuffle or an id; a text
    without any token has no embedding (NULL).
    """

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        token = re.compile(TOKEN)
        buckets: dict[str, int] = {}
        for texts in batches:
            vectors: list[np.ndarray | None] = []
            for text in texts:
                found = token.findall(text) if text else []
                if len(buckets) > 1_000_000:
                    buckets.clear()
                for t in found:
                    if t not in buckets:
                        buckets[t] = int(hashlib.md5(t.encode()).hexdigest()[:8], 16) % dim
                counts = np.bincount([buckets[t] for t in found], minlength=dim).astype(float) if found else None
                vectors.append(None if counts is None else counts / np.sqrt((counts * counts).sum()))
            yield pd.Series(vectors, index=texts.index, dtype=object)

    embed = F.pandas_udf(run, "array<double>")
    return df.withColumn(out, embed(F.lower(F.col(text_col))))
