"""Fill-in-the-middle texts: a text cut into prefix, middle and suffix between units, and put in another order.

Units are runs of ASCII letters and single other code points. One ``fullmatch`` of ``(unit)*`` by the regex
library keeps every repetition of its group, so ``ends(1)`` holds the ends of all units: their number is n, and the
ends number ``a`` and ``b`` are both cuts. Captures need some 80 bytes for each character, so a text beyond ``WINDOW`` characters
is matched in windows that end after a character that is no letter, where a unit ends in any case.

``a <= b`` are the two draws ``h1 % (n + 1)`` and ``h2 % (n + 1)``; prefix is ``a`` units, prefix and middle ``b`` units. h1 to h4
are the first four groups of eight hex digits of the SHA-256 of ``seed:id``. A text stays plain if it is empty or contains
one of the markers, or if ``h3 % 100 >= rate``; otherwise the form is spm if ``h4 % 100 < spm``, else psm:

- psm: ``<P>`` prefix ``<S>`` suffix ``<M>`` middle
- spm: ``<S>`` suffix ``<P>`` prefix ``<M>`` middle

Defined results: a null text is an empty one and plain, with n 0. A row without an id draws from ``seed:`` alone. Each row gives one
row, repeated ones equal ones; an empty table gives an empty one. Further columns play no part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellwarden.llm.textbatch import flat

WINDOW = 1 << 19
#: Bytes of text that make one batch of results, or one text.
BATCH = 4 << 20
# The markers.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
PLAIN, PSM, SPM = "plain", "psm", "spm"

_UNITS = regex.compile(r"([A-Za-z]+|[^A-Za-z])*+")
_OTHER = regex.compile(r"[^A-Za-z]")

SCHEMA = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"


def unit_ends(text: str, window: int = WINDOW) -> np.ndarray:
    """Where each unit of the text ends, in code points."""
    found, at = [], 0
    while at < len(text):
        edge = _OTHER.search(text, at + window - 1) if len(text) - at > window else None
        end = edge.end() if edge else len(text)
        found.append(np.array(_UNITS.fullmatch(text, at, end).ends(1), np.int64))
        at = end
    return np.concatenate(found) if found else np.zeros(0, np.int64)


def draws(doc_id: int | None, seed: int) -> list[int]:
    made = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(made[i : i + 8], 16) for i in range(0, 32, 8)]


def cut(doc_id: int | None, text: str, seed: int, rate: int, spm: int) -> tuple[int, str, int | None, int | None, str]:
    """n, form, characters of prefix and middle, and the text in its new order."""
    ends = unit_ends(text)
    n = len(ends)
    h1, h2, h3, h4 = draws(doc_id, seed)
    if not text or any(m in text for m in (PREFIX, SUFFIX, MIDDLE)) or h3 % 100 >= rate:
        return n, PLAIN, None, None, text
    low, high = (int(ends[k - 1]) if k else 0 for k in sorted((h1 % (n + 1), h2 % (n + 1))))
    prefix, middle, suffix = text[:low], text[low:high], text[high:]
    if h4 % 100 < spm:
        return n, SPM, low, high - low, f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
    return n, PSM, low, high - low, f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"


def _rows(batches: Iterator[pa.RecordBatch], seed: int, rate: int, spm: int) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()]

    def batch_of(rows: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    for batch in batches:
        data, offsets = flat(batch.column(1))
        places = offsets.tolist()
        rows, held = [], 0
        for i, doc_id in enumerate(batch.column(0).to_pylist()):
            text = data[places[i] : places[i + 1]].tobytes().decode()
            rows.append((doc_id, *cut(doc_id, text, seed, rate, spm)))
            held += places[i + 1] - places[i]
            if held >= BATCH:
                yield batch_of(rows)
                rows, held = [], 0
        if rows:
            yield batch_of(rows)


def transform(
    docs: DataFrame, seed: int = 1, rate: int = 90, spm: int = 20, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Id, ``n``, ``form``, ``prefix_chars``, ``middle_chars`` (null if plain) and ``output`` of every row.

    ``rate`` of a hundred texts are cut, and ``spm`` of a hundred of these put the suffix first.
    """
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    made = rows.mapInArrow(partial(_rows, seed=seed, rate=rate, spm=spm), SCHEMA)
    return made.withColumnRenamed("doc_id", id_col)


def restored(output: Column, form: Column) -> Column:
    """The text from its output and form alone: a text that was cut holds no marker, so the markers part it."""
    parts = F.split(output, "<[PSM]>", -1)
    return (
        F.when(form == PLAIN, output)
        .when(form == PSM, F.concat(parts[1], parts[3], parts[2]))
        .when(form == SPM, F.concat(parts[2], parts[3], parts[1]))
    )
