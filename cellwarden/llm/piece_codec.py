"""Encode texts to SentencePiece ids by a batched Viterbi search, and decode them.

The text gets a leading space, and spaces are written as the piece sign, as the library does. A piece
has piece signs only at its front, so the text falls into units (piece signs and the characters up to the next
one) that no piece crosses, and the best path of a text is that of its units. Each distinct unit is searched
once: units of equal length form a matrix and advance together, position by position. The
hashes of all substrings up to the longest piece are probed in the sorted keys of the pieces; the best score of
each position is a vectorised maximum, of equal ones the longest piece, and its length and id are the back pointer.

The best path has the greatest sum of piece scores. A character that is no piece costs ten more than the
worst piece and is written as its UTF-8 bytes. A piece sign in the text itself is such a character, so decoding
gives back every text exactly.

Defined results: a null text is encoded as an empty one, which has no ids, and so decodes to an empty text. Each row gives one row. Further columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellwarden.llm.textbatch import _BASE, U64, Memory, _grown, chunks, distinct, mix, ragged

SIGN = 0x2581
#: Stands for a piece sign that is part of the text; no code point.
OWN_SIGN = 0x110000
#: Characters searched together.
AREA = 1 << 18


class Pieces:
    """Sorted piece keys with ids and scores, and the bytes of each id."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        normal, self.byte_id, spelled = [], np.zeros(256, np.int32), []
        for i in range(model.vocab_size()):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                value = int(piece[3:5], 16)
                self.byte_id[value] = i
                spelled.append(bytes([value]))
            elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
                spelled.append(b"")
            else:
                normal.append((piece, i, model.get_score(i)))
                spelled.append(piece.replace(chr(SIGN), " ").encode())
        if any(chr(SIGN) in p.lstrip(chr(SIGN)) for p, _, _ in normal):
            raise ValueError("a piece has a piece sign after another character")
        self.longest = max(len(p) for p, _, _ in normal)
        keys = np.concatenate([substrings(codes(p)[None, :], len(p))[0] for p, _, _ in normal])
        order = np.argsort(keys)
        self.keys = keys[order]
        self.ids = np.array([i for _, i, _ in normal], np.int32)[order]
        self.scores = np.array([s for _, _, s in normal])[order]
        self.unknown = self.scores.min() - 10.0
        self.lengths = np.array([len(s) for s in spelled], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.spelled = np.frombuffer(b"".join(spelled), np.uint8)

    def look_up(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Scores and ids; minus infinity and -1 where there is no such piece."""
        at = np.minimum(np.searchsorted(self.keys, hashes), len(self.keys) - 1)
        hit = self.keys[at] == hashes
        return np.where(hit, self.scores[at], -np.inf), np.where(hit, self.ids[at], -1)


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32)


def substrings(units: np.ndarray, length: int) -> np.ndarray:
    """Hashes of all substrings of one length, for each row of code points."""
    n = units.shape[1]
    sums = np.zeros((len(units), n + 1), U64)
    np.cumsum(mix(units.astype(U64) + U64(1)) * _grown("up", _BASE, n), axis=1, out=sums[:, 1:])
    down = _grown("down", pow(_BASE, -1, 1 << 64), n)
    return mix((sums[:, length:] - sums[:, :-length]) * down[: n - length + 1] + U64(length))


def best_paths(units: np.ndarray, pieces: Pieces) -> tuple[np.ndarray, np.ndarray]:
    """Ids of the best path of each row, in order, one row after another, -1 for an unknown character; counts."""
    rows, n = units.shape
    longest = min(n, pieces.longest)
    probes = [pieces.look_up(substrings(units, k)) for k in range(1, longest + 1)]
    single, _ = probes[0]
    single[np.isneginf(single)] = pieces.unknown
    best = np.zeros((n + 1, rows))
    back = np.zeros((n + 1, rows), np.int64)
    chosen = np.zeros((n + 1, rows), np.int32)
    every = np.arange(rows)
    for end in range(1, n + 1):
        upto = min(end, longest)
        # The longest piece first, as the first of equal maxima is taken.
        options = np.stack([best[end - k] + probes[k - 1][0][:, end - k] for k in range(upto, 0, -1)])
        winner = options.argmax(axis=0)
        best[end] = options[winner, every]
        back[end] = upto - winner
        ids = np.stack([probes[k - 1][1][:, end - k] for k in range(upto, 0, -1)])
        chosen[end] = ids[winner, every]
    place, step = np.full(rows, n), 0
    steps, active = [], every
    while len(active):
        steps.append((active, np.full(len(active), step), chosen[place[active], active]))
        place[active] -= back[place[active], active]
        active = active[place[active] > 0]
        step += 1
    row, at, ids = (np.concatenate(c) for c in zip(*steps))
    order = np.lexsort((-at, row))
    return ids[order], np.bincount(row, minlength=rows)


_loaded: dict[str, tuple[Pieces, Memory]] = {}


def load(path: str) -> tuple[Pieces, Memory]:
    if path not in _loaded:
        _loaded[path] = (Pieces(path), Memory(np.int32))
    return _loaded[path]


def unit_ids(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray, pieces: Pieces) -> list[np.ndarray]:
    """Ids of each unit, equal lengths together."""
    out: list = [None] * len(starts)
    order = np.argsort(lengths, kind="stable")
    cuts = np.flatnonzero(np.diff(lengths[order])) + 1
    for same in np.split(order, cuts) if len(order) else []:
        n = int(lengths[same[0]])
        each = max(1, AREA // n)
        for k in range(0, len(same), each):
            some = same[k : k + each]
            units = flat[starts[some][:, None] + np.arange(n)]
            ids, counts = best_paths(units, pieces)
            ends = np.cumsum(counts)
            for i, unit, a, b in zip(some.tolist(), units, (ends - counts).tolist(), ends.tolist()):
                out[i] = ids[a:b] if (ids[a:b] >= 0).all() else _with_bytes(ids[a:b], unit, pieces)
    return out


def _with_bytes(ids: np.ndarray, unit: np.ndarray, pieces: Pieces) -> np.ndarray:
    """Replace -1 by the ids of the character's UTF-8 bytes."""
    out, at = [], 0
    for i in ids.tolist():
        if i >= 0:
            out.append(i)
            text = pieces.spelled[pieces.starts[i] : pieces.starts[i] + pieces.lengths[i]].tobytes().decode()
            at += len(text)
        else:
            code = int(unit[at])
            out.extend(pieces.byte_id[list(chr(SIGN if code == OWN_SIGN else code).encode())].tolist())
            at += 1
    return np.array(out, np.int32)


def encode(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    """Replace the last column, the text, by its ids."""
    pieces, known = load(path)
    for batch in batches:
        for row, data, offsets in chunks(batch.column(batch.num_columns - 1)):
            texts = len(offsets) - 1
            flat = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32).copy()
            heads = np.append(0, np.cumsum((data & 0xC0) != 0x80))[offsets]  # first character of each text
            flat[flat == SIGN] = OWN_SIGN
            flat[flat == 0x20] = SIGN
            full = np.flatnonzero(np.diff(heads) > 0)
            flat = np.insert(flat, heads[full], SIGN)  # the leading space of each text that is not empty
            begins = heads[full] + np.arange(len(full))
            sign = flat == SIGN
            first = sign.copy()
            first[1:] &= ~sign[:-1]
            first[begins] = True
            starts = np.flatnonzero(first)
            lengths = np.diff(np.append(starts, len(flat)))
            sums = np.zeros(len(flat) + 1, U64)
            np.cumsum(mix(flat.astype(U64) + U64(1)) * _grown("up", _BASE, len(flat)), out=sums[1:])
            down = _grown("down", pow(_BASE, -1, 1 << 64), len(flat))
            hashes = mix((sums[starts + lengths] - sums[starts]) * down[starts] + lengths.astype(U64))
            keys, at, unit = distinct(hashes)

            def make(places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
                parts = unit_ids(flat, starts[at[places]], lengths[at[places]], pieces)
                return np.fromiter(map(len, parts), np.int64, len(parts)), np.concatenate(parts)

            begin, sizes, store = known.lookup(keys, make)
            ids = store[ragged(begin[unit], sizes[unit])]
            owner = full[np.searchsorted(begins, starts, "right") - 1] if len(full) else np.zeros(0, np.int64)
            counts = np.bincount(owner, weights=sizes[unit], minlength=texts).astype(np.int64)
            places = np.append(0, np.cumsum(counts)).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [*(c.slice(row, texts) for c in batch.columns[:-1]), pa.ListArray.from_arrays(pa.array(places), pa.array(ids))],
                names=[*batch.schema.names[:-1], "ids"],
            )


def spell(column: pa.ListArray, pieces: Pieces) -> pa.Array:
    """Texts of lists of ids."""
    ids = column.values.to_numpy()[column.offsets[0].as_py() : column.offsets[-1].as_py()]
    places = column.offsets.to_numpy() - column.offsets[0].as_py()
    data = pieces.spelled[ragged(pieces.starts[ids], pieces.lengths[ids])]
    ends = np.append(0, np.cumsum(pieces.lengths[ids]))[places]
    full = np.diff(ends) > 0
    data = np.delete(data, ends[:-1][full])  # the leading space
    ends = ends - np.append(0, np.cumsum(full))
    return pa.LargeStringArray.from_buffers(len(column), pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(data)).cast(pa.string())


def _decoded(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    pieces, _ = load(path)
    for batch in batches:
        yield pa.RecordBatch.from_arrays([*batch.columns, spell(batch.column(1), pieces)], names=["id_", "ids", "decoded"])


def _checked(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    """Encode and decode a batch: id, ids, and whether the text came back."""
    pieces, _ = load(path)
    for batch in batches:
        for row, data, offsets in chunks(batch.column(1)):
            some = batch.slice(row, len(offsets) - 1)
            made = pa.Table.from_batches(encode(iter([some]), path)).combine_chunks()
            column = made.column("ids").combine_chunks()
            column = column.chunk(0) if isinstance(column, pa.ChunkedArray) else column
            texts = some.column(1).to_pylist()
            same = [a == (b or "") for a, b in zip(spell(column, pieces).to_pylist(), texts)]
            yield pa.RecordBatch.from_arrays([some.column(0), column, pa.array(same)], names=["id_", "ids", "restored"])


def _columns(df: DataFrame, id_col: str, value: str) -> DataFrame:
    return df.select(F.col(f"`{id_col}`").cast("long").alias("id_"), F.col(f"`{value}`").alias("value_"))


def encode_texts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Id and ``ids`` of each text."""
    made = _columns(docs, id_col, text_col).mapInArrow(partial(encode, path=path), "id_ long, ids array<int>")
    return made.withColumnRenamed("id_", id_col)


def decode_ids(tokens: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """Id, ``ids`` and the ``decoded`` text of each row; null ids decode to an empty text."""
    filled = _columns(tokens, id_col, ids_col).select("id_", F.coalesce("value_", F.array().cast("array<int>")))
    made = filled.mapInArrow(partial(_decoded, path=path), "id_ long, ids array<int>, decoded string")
    return made.withColumnRenamed("id_", id_col)


def round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Id, ``ids``, ``n_tokens`` and ``restored``: whether decoding the ids gives the whole text again."""
    made = _columns(docs, id_col, text_col).mapInArrow(
        partial(_checked, path=path), "id_ long, ids array<int>, restored boolean"
    )
    return made.select(F.col("id_").alias(id_col), "ids", F.size("ids").cast("long").alias("n_tokens"), "restored")
