"""Token ids of documents in ORC files: run-length encoded integers, row indexes, Bloom filters on ids.

``write_tokens`` sorts the texts by document id over all partitions, encodes them batch by batch and
writes one row per document. ORC stores the ids with its integer run-length encoding, keeps least
and greatest values for every ``rows_per_index`` rows of a stripe, and a Bloom filter of document ids, so a
reader of few documents skips whole stripes, and readers of all documents split a file by stripes.

Encoding: the tokenizer cuts every text before white space, and between letters, digits and signs, except
after an apostrophe. The pieces between such places of ASCII and Latin characters are found by array
operations, and each distinct piece is encoded once by the library; ids are then gathered for all pieces. Texts are cut
around each occurrence of an added token's content, and that is a piece of its own. Where an added token asks for more than its
content (white space beside it, whole words), a text that holds it is one piece. The result equals that of whole texts.
With ``special`` the contents of special tokens in a text give their ids, as in a plain call of the library; without, they are
text like any other (the library's ``encode_special_tokens``).

Defined results: a null text is an empty one and has only the end id. Rows without a document
id come first. Rows with one id follow each other in the order of a hash of their texts. An empty
table gives an empty folder of files. Further columns play no part.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator
from functools import partial
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellwarden.llm.textbatch import Memory, chunks, distinct, hashes, ragged

_SCHEMA = "doc_id long, first long, n_tokens long, ids array<int>"
_loaded: dict[tuple[str, bool], tuple] = {}

# Kinds of bytes: no cut is made beside those of kind 0.
_OTHER, _LETTER, _DIGIT, _SIGN, _BLANK = range(5)
_KIND = np.zeros(256, np.uint8)
_KIND[0x21:0x7F] = _SIGN
_KIND[0x30:0x3A] = _DIGIT
_KIND[0x41:0x5B] = _KIND[0x61:0x7B] = _LETTER
_KIND[[0x20, *range(0x09, 0x0E)]] = _BLANK
_APOSTROPHE = 0x27


def _byte_letters() -> dict[int, str]:
    """The letter that byte-level vocabularies write for each byte: itself if printable, else from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = (b for b in range(256) if b not in shown)
    return {b: chr(b) for b in shown} | {b: chr(0x100 + i) for i, b in enumerate(others)}


def _tokenizer(path: str, special: bool):
    """The tokenizer of a file, its letters for bytes, the ids of pieces met so far, and a pattern of the added tokens
    (None without any) with whether a text is cut around them."""
    if (path, special) not in _loaded:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        made = Tokenizer.from_file(path)
        made.encode_special_tokens = not special
        added = [t for t in made.get_added_tokens_decoder().values() if t.content and (special or not t.special)]
        # The library takes the first, and of these the longest.
        contents = sorted({t.content.encode() for t in added}, key=len, reverse=True)
        pattern = re.compile(b"|".join(map(re.escape, contents))) if contents else None
        cut = not any(t.lstrip or t.rstrip or t.single_word for t in added) and len({t.normalized for t in added}) < 2
        _loaded[path, special] = (made, _byte_letters(), Memory(np.int32), pattern, cut)
    return _loaded[path, special]


def _piece_ids(tokenizer, letters: dict[int, str], pieces: list[bytes], plain: list[bool], added) -> tuple[np.ndarray, np.ndarray]:
    """Number of ids of each piece, and all ids. A plain piece, letters with or without a space before
    them, is one unit for the model; all others, and added tokens, go the whole way."""
    model, out = tokenizer.model, [None] * len(pieces)
    rest = []
    for i, (piece, one) in enumerate(zip(pieces, plain)):
        if one and not (added and added.search(piece)):
            out[i] = [t.id for t in model.tokenize(piece.decode("latin-1").translate(letters))]
        else:
            rest.append(i)
    for k in range(0, len(rest), 4096):
        some = rest[k : k + 4096]
        for i, made in zip(some, tokenizer.encode_batch([pieces[i].decode() for i in some], add_special_tokens=False)):
            out[i] = made.ids
    sizes = np.fromiter(map(len, out), np.int64, len(out))
    return sizes, np.fromiter(chain.from_iterable(out), np.int32, int(sizes.sum()))


def _kinds(data: np.ndarray) -> np.ndarray:
    """Kind of each byte. Both bytes of U+00C0 to U+023F are letters, but for the signs U+00D7 and U+00F7."""
    kind = _KIND[data]
    lead = np.flatnonzero((data[:-1] >= 0xC3) & (data[:-1] <= 0xC8)) if len(data) else np.zeros(0, np.int64)
    lead = lead[(data[lead] != 0xC3) | ((data[lead + 1] != 0x97) & (data[lead + 1] != 0xB7))]
    kind[lead] = kind[lead + 1] = _LETTER
    return kind


def _cuts(data: np.ndarray, kind: np.ndarray, offsets: np.ndarray, raw: bytes, added, around: bool) -> np.ndarray:
    """Where pieces begin: at texts, before white space, and where the kind changes but to letters after an
    apostrophe or white space, or to anything after white space; at and after added tokens, or nowhere in a text that holds one."""
    begin = np.zeros(len(data) + 1, bool)
    if len(data) > 1:
        before, after = kind[:-1], kind[1:]
        change = (before != after) & (before != _OTHER) & (after != _OTHER) & (before != _BLANK)
        change &= (after != _LETTER) | (data[:-1] != _APOSTROPHE)
        begin[1:-1] = change
    at = 0
    while added and (met := added.search(raw, at)):
        t = int(np.searchsorted(offsets, met.start(), "right")) - 1
        low, at = offsets[t : t + 2].tolist()
        inside = [m.span() for m in added.finditer(raw, low, at)]  # none that crosses the end of a text
        if inside and not around:
            begin[low:at] = False
        for a, b in inside if around else []:
            begin[a:b] = False
            begin[[a, b]] = True
    begin[offsets[:-1]] = True
    return np.flatnonzero(begin[:-1])


def encode(batches: Iterator[pa.RecordBatch], path: str, end_id: int, special: bool = False) -> Iterator[pa.RecordBatch]:
    """Ids of each text with the end id, and how many ids of this partition come before."""
    tokenizer, letters, known, added, around = _tokenizer(path, special)
    first = 0
    for batch in batches:
        for row, data, offsets in chunks(batch.column(1)):
            kind, raw = _kinds(data), data.tobytes()
            starts = _cuts(data, kind, offsets, raw, added, around)
            ends = np.append(starts[1:], len(data))
            keys, at, piece = distinct(hashes(data, starts, ends))
            at_start, at_end = starts[at], ends[at]
            odd = np.append(0, np.cumsum(kind != _LETTER))  # bytes that are no letters
            plain = odd[at_end] - odd[at_start] == (data[at_start] == 0x20) if len(at) else np.zeros(0, bool)
            plain &= at_end - at_start > (data[at_start] == 0x20) if len(at) else plain

            def make(places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
                cut = [raw[a:b] for a, b in zip(at_start[places].tolist(), at_end[places].tolist())]
                return _piece_ids(tokenizer, letters, cut, plain[places].tolist(), added)

            begins, sizes, store = known.lookup(keys, make)
            each = sizes[piece]
            ids = store[ragged(begins[piece], each)]
            texts_n = len(offsets) - 1
            owner = np.searchsorted(offsets, starts, "right") - 1
            lengths = np.bincount(owner, weights=each, minlength=texts_n).astype(np.int64)
            stops = np.cumsum(lengths)
            ids = np.insert(ids, stops, end_id).astype(np.int32)
            lengths += 1
            places = np.append(0, np.cumsum(lengths))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).slice(row, texts_n),
                    pa.array(first + places[:-1]),
                    pa.array(lengths),
                    pa.ListArray.from_arrays(pa.array(places.astype(np.int32)), pa.array(ids)),
                ],
                names=["doc_id", "first", "n_tokens", "ids"],
            )
            first += int(places[-1])


def write_tokens(
    docs: DataFrame,
    path: str,
    tokenizer: str,
    end_id: int,
    id_col: str = "doc_id",
    text_col: str = "text",
    rows_per_index: int = 1000,
    stripe_bytes: int = 8 << 20,
    special: bool = False,
) -> None:
    """Write the ids of all texts below ``path``; files and rows are in ascending order of the document id.

    ``special``: contents of special tokens in a text give their ids, as in a plain call of the library.
    """
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    # The hash parts the rows of one id, and those without an id, as well.
    order = ["doc_id", F.xxhash64("text"), "text"]
    (
        rows.repartitionByRange(parts, *order[:2])
        .sortWithinPartitions(*order)
        .mapInArrow(partial(encode, path=tokenizer, end_id=end_id, special=special), _SCHEMA)
        .write.option("orc.bloom.filter.columns", "doc_id")
        .option("orc.row.index.stride", rows_per_index)
        .option("orc.stripe.size", stripe_bytes)
        .option("orc.create.index", "true")
        .option("compression", "zstd")
        .orc(path)
    )


def read_tokens(spark: SparkSession, path: str, ids: list[int] | None = None) -> DataFrame:
    """Rows of the files, with ``start``, the ids of all documents before; of the documents ``ids`` only, if given.

    A range or list of ids reaches the files as a filter on stripe statistics and Bloom filters.
    """
    files = spark.read.schema(_SCHEMA).orc(path).select("*", F.col("_metadata.file_name").alias("file"))
    # One row per file.
    sizes = files.groupBy("file").agg(F.sum("n_tokens").alias("n")).collect()
    before, total = [], 0
    for r in sorted(sizes, key=lambda r: int(r["file"].split("-")[1])):
        before.append((r["file"], total))
        total += r["n"]
    offsets = spark.createDataFrame(before, "file string, before long")  # a row per file
    if ids is not None:
        files = files.where(F.col("doc_id").isin(ids))
    return files.join(F.broadcast(offsets), "file").select(
        "doc_id", (F.col("before") + F.col("first")).alias("start"), "n_tokens", "ids"
    )


def _checksums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column(2)
        values, places = ids.values.to_numpy().astype("<u4", copy=False), ids.offsets.to_numpy()
        sums = [zlib.crc32(values[a:b]) for a, b in zip(places[:-1].tolist(), places[1:].tolist())]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(np.diff(places).astype(np.int64)), pa.array(sums, pa.int64())],
            names=["doc_id", "start", "n_tokens", "ids_crc32"],
        )


def digests(tokens: DataFrame) -> DataFrame:
    """``doc_id``, ``start``, ``n_tokens`` and the CRC-32 of the ids as little-endian 32-bit numbers."""
    return tokens.select("doc_id", "start", "ids").mapInArrow(
        _checksums, "doc_id long, start long, n_tokens long, ids_crc32 long"
    )
