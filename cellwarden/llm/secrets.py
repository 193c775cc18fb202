"""Find secrets in texts: assigned values and long runs of key characters, with a random forest that removes false findings.

Candidates are whole values assigned to a name for secrets (``password = "..."``, ``pwd: ...``), quoted or up to the next white space
or one of ``,;<>``, of any length and signs; passwords in addresses (``://user:password@``); and other runs of at least
``SHORTEST`` letters, digits and ``+/_-``, which need no name. The features of a candidate are its length, its
characters and the changes between their kinds, the share of its letters that the corpus's dictionary covers, whether it
looks like a path, and the words and signs beside it. The dictionary is the letter triples of words that make up at least
``WORD_SHARE`` of all words, counted over all texts.

The forest is fitted by Spark ML on labelled findings, at most ``sample`` of each class. Without labels of its own a
corpus labels its clear cases: a candidate of hexadecimal or mixed characters that is assigned to a name for
secrets is one; one of letters alone that is assigned to nothing, or that a word for checksums names, is not; nor is a bare
value of dictionary letters, of less than four letters, or a bare number of less than six digits. The others, and these,
are then judged by the forest. Its trees are sent as arrays to the tasks, which find, judge and replace candidates in one pass over the
texts without a shuffle.

Defined results: null and empty texts have no candidates and stay as they are. Places are bytes of the UTF-8
text. Rows that repeat give repeated findings. Without labelled findings of both classes there is no forest: clear cases of
secrets get probability 1, all other candidates 0. Further columns are kept by ``redact``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellwarden.llm.tables import Scratch
from cellwarden.llm.textbatch import chunks, hashes, lower, spans, words

SHORTEST = 16
WORD_SHARE = 5e-5
SLAB = 1 << 20
BESIDE = 48
FEATURES = ["length", "changes", "digits", "uppers", "hex", "variety", "covered", "slashes", "joints", "path", "assigned",
            "quoted", "secret_word", "checksum_word", "words_beside"]

_RUN = np.zeros(256, bool)
_RUN[list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-")] = True
_KIND = np.zeros(256, np.int8)
_KIND[list(b"abcdefghijklmnopqrstuvwxyz")] = 1
_KIND[list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ")] = 2
_KIND[list(b"0123456789")] = 3
_HEX = np.zeros(256, bool)
_HEX[list(b"0123456789abcdefABCDEF")] = True
_SECRET = re.compile(rb"(?i)(token|secret|passw|pwd|api|key|auth|credential|bearer|access)")
#: A name for secrets, and the value assigned to it: in quotes, or up to white space and some signs, without a stop at its end.
_VALUE = re.compile(
    rb"(?i)(?:token|secret|passw|pwd|api_?key|auth|credential|bearer|access)[A-Za-z0-9_.-]{0,64}[\"'`]?\s{0,8}(?:=>|:=|[:=])\s{0,8}"
    rb"(?:\"([^\"\n]{1,4096})\"|'([^'\n]{1,4096})'|`([^`\n]{1,4096})`|([^\s\"'`,;<>]*[^\s\"'`,;<>.)\]}]))"
)
#: The password of an address.
_ADDRESS = re.compile(rb"://[^\s/:@]{1,256}:([^\s/@]{1,256})@")
_CHECKSUM = re.compile(rb"(?i)(sha\d*|md5|hash|checksum|digest|commit|revision|etag|uuid)$")
_BEFORE = re.compile(rb"([A-Za-z][A-Za-z0-9_-]*)([\s\"'`:=>]*)$")
_WORD = re.compile(rb"^\W*[A-Za-z]{2,}\W*(?:\s|$)")


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(hash of a word, count) of each slab of texts, and (null, words) of it."""
    slab, held = [], 0

    def rows() -> pa.RecordBatch:
        word, n = np.unique(np.concatenate(slab), return_counts=True)
        return pa.RecordBatch.from_arrays(
            [pa.array([*word.view(np.int64).tolist(), None], pa.int64()), pa.array([*n.tolist(), held], pa.int64())], names=["word", "n"]
        )

    for batch in batches:
        for _, data, offsets in chunks(batch.column(0)):
            found = words(lower(data), offsets)[0]
            slab.append(found)
            held += len(found)
            if held >= SLAB:
                yield rows()
                slab, held = [], 0
    if held:
        yield rows()


def _spelled(batches: Iterator[pa.RecordBatch], often) -> Iterator[pa.RecordBatch]:
    """The letters of each frequent word, once for each task."""
    wanted, seen = often.value, np.zeros(len(often.value), bool)
    for batch in batches:
        made = []
        for _, data, offsets in chunks(batch.column(0)):
            data = lower(data)
            found, starts, ends, _ = words(data, offsets)
            at = np.minimum(np.searchsorted(wanted, found), len(wanted) - 1)
            new = np.flatnonzero((wanted[at] == found) & ~seen[at])
            number, first = np.unique(at[new], return_index=True)
            seen[number] = True
            made += [data[starts[i] : ends[i]].tobytes() for i in new[first].tolist()]
        if made:
            yield pa.RecordBatch.from_arrays([pa.array(made, pa.binary())], names=["word"])


def dictionary(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """Which letter triples (26 ** 3 of them) occur in frequent words; 1 / WORD_SHARE words at most reach the driver."""
    spark = docs.sparkSession
    scratch = Scratch(spark)
    texts = docs.select(F.col(f"`{text_col}`"))
    counts = scratch.keep(texts.mapInArrow(_counted, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")), "words")
    total = counts.where("word is null").agg(F.sum("n")).first()[0] or 0
    often = [r["word"] for r in counts.where(F.col("word").isNotNull() & (F.col("n") >= WORD_SHARE * total)).select("word").collect()]
    scratch.drop(counts)
    table = np.zeros(26**3, bool)
    if not often:
        return table
    sent = spark.sparkContext.broadcast(np.sort(np.array(often, np.int64).view(np.uint64)))
    for r in texts.mapInArrow(partial(_spelled, often=sent), "word binary").distinct().collect():
        letters = np.frombuffer(bytes(r["word"]), np.uint8).astype(np.int64) - 97
        triple = np.stack([letters[:-2], letters[1:-1], letters[2:]]) if len(letters) > 2 else np.zeros((3, 0), np.int64)
        triple = triple[:, ((triple >= 0) & (triple < 26)).all(axis=0)]
        table[triple[0] * 676 + triple[1] * 26 + triple[2]] = True
    return table


def named_values(raw: bytes, offsets: np.ndarray) -> list[tuple[int, int, bool]]:
    """Start and end of each value assigned to a name for secrets, and of each password in an address (marked); none crosses a text's end."""
    found, ends = [], offsets.tolist()
    for pattern, address in ((_VALUE, False), (_ADDRESS, True)):
        at = 0
        while met := pattern.search(raw, at):
            limit = ends[int(np.searchsorted(offsets, met.start(), "right"))]
            if met.end() > limit:
                met = pattern.search(raw, met.start(), limit)
                if not met:
                    at = limit
                    continue
            found.append((*met.span(met.lastindex), address))
            at = met.end()
    found.sort()
    kept: list[tuple[int, int, bool]] = []
    for value in found:
        if not kept or value[0] >= kept[-1][1]:
            kept.append(value)
    return kept


def candidates(data: np.ndarray, offsets: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start, end, text and features of every candidate."""
    raw = data.tobytes()
    values = named_values(raw, offsets)
    first, last = (np.array([v[i] for v in values], np.int64) for i in (0, 1))
    starts, ends = spans(data, offsets, ~_RUN)
    alone = ends - starts >= SHORTEST
    if values:  # runs beside the values only
        following = np.searchsorted(last, starts, "right")
        alone &= (following == len(last)) | (first[np.minimum(following, len(last) - 1)] >= ends)
    starts, ends = np.append(starts[alone], first), np.append(ends[alone], last)
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], ends[order]
    in_address = np.append(np.zeros(int(alone.sum()), bool), [v[2] for v in values])[order].astype(bool)
    text = np.searchsorted(offsets, starts, "right") - 1
    n = ends - starts
    sums = lambda flags: np.append(0, np.cumsum(flags))
    share = lambda flags: (s := sums(flags))[ends] - s[starts]
    kind = _KIND[data]
    change = np.zeros(len(data), np.int64)
    change[1:] = kind[1:] != kind[:-1]
    changes = sums(change)[ends] - sums(change)[np.minimum(starts + 1, len(data))]
    letter = lower(data).astype(np.int64) - 97
    letter[(letter < 0) | (letter > 25)] = -1
    triple = np.zeros(len(data), bool)
    if len(data) > 2:
        whole = (letter[:-2] >= 0) & (letter[1:-1] >= 0) & (letter[2:] >= 0)
        triple[:-2] = whole & known[np.where(whole, letter[:-2] * 676 + letter[1:-1] * 26 + letter[2:], 0)]
    inside = sums(triple)
    covered = inside[np.maximum(ends - 2, starts)] - inside[starts]
    rows = np.zeros((len(starts), len(FEATURES)))
    slash = share(data == 0x2F)
    rows[:, 0], rows[:, 1] = n, changes / np.maximum(n - 1, 1)
    rows[:, 2], rows[:, 3], rows[:, 4] = share(kind == 3) / n, share(kind == 2) / n, share(_HEX[data]) / n
    rows[:, 6], rows[:, 7], rows[:, 8] = covered / np.maximum(n - 2, 1), slash, share(kind == 0) - slash
    low, high = offsets[text], offsets[text + 1]
    for i, (a, b, u, v) in enumerate(zip(starts.tolist(), ends.tolist(), low.tolist(), high.tolist())):
        before, after = raw[max(u, a - BESIDE) : a], raw[b : min(v, b + BESIDE)]
        rows[i, 5] = len(set(raw[a:b])) / min(b - a, 64)
        rows[i, 9] = before.endswith((b"/", b".", b"\\")) or after.startswith((b".", b"/", b"\\", b"("))
        name = _BEFORE.search(before)
        if name:
            assigned = b"=" in name[2] or b":" in name[2]
            rows[i, 10], rows[i, 12] = assigned, assigned and bool(_SECRET.search(name[1]))
            rows[i, 13] = bool(_CHECKSUM.search(name[1]))
        rows[i, 11] = before.endswith((b'"', b"'", b"`")) and after.startswith((b'"', b"'", b"`"))
        rows[i, 14] = bool(_WORD.search(after)) + bool(name and not name[2].strip())
    rows[in_address, 10] = rows[in_address, 12] = 1
    return starts, ends, text, rows


def clear_cases(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which candidates are secrets in any case, and which are none."""
    at = {name: rows[:, k] for k, name in enumerate(FEATURES)}
    secret = (at["secret_word"] == 1) & (at["digits"] > 0) & (at["digits"] < 1) & (at["checksum_word"] == 0)
    bare = (at["quoted"] == 0) & (at["joints"] == 0)
    plain = bare & (at["digits"] == 0) & ((at["covered"] >= 0.9) | (at["length"] < 4))
    number = bare & (at["digits"] == 1) & (at["length"] < 6)
    return secret, ((at["digits"] == 0) & (at["assigned"] == 0)) | (at["checksum_word"] == 1) | plain | number


def _examples(batches: Iterator[pa.RecordBatch], known) -> Iterator[pa.RecordBatch]:
    """Features and label of the clear cases, and a hash to choose among them."""
    table = known.value
    for batch in batches:
        for _, data, offsets in chunks(batch.column(0)):
            starts, ends, _, rows = candidates(data, offsets, table)
            secret, harmless = clear_cases(rows)
            clear = np.flatnonzero(secret | harmless)
            columns = [pa.array(rows[clear, k]) for k in range(len(FEATURES))]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(secret[clear].astype(float)), pa.array(hashes(data, starts, ends)[clear].view(np.int64))],
                names=[*FEATURES, "label", "pick"],
            )


def labelled_findings(docs: DataFrame, known: np.ndarray, text_col: str = "text") -> DataFrame:
    """The clear cases of a corpus: one column per feature, ``label`` and ``pick``."""
    sent = docs.sparkSession.sparkContext.broadcast(known)
    schema = ", ".join(f"{f} double" for f in FEATURES) + ", label double, pick long"
    return docs.select(F.col(f"`{text_col}`")).mapInArrow(partial(_examples, known=sent), schema)


def fit(findings: DataFrame, sample: int = 5000, trees: int = 20, depth: int = 5) -> list[tuple]:
    """Trees (feature, threshold, left, right, probability of a secret per node) of a forest fitted on labelled findings.

    Of each class the ``sample`` findings with the smallest ``pick`` are used. Without both classes there are no trees.
    """
    scratch = Scratch(findings.sparkSession)
    order = ["pick", *FEATURES]
    rows = scratch.keep(findings, "findings")
    parts = [rows.where(F.col("label") == c).orderBy(*order).limit(sample) for c in (0.0, 1.0)]
    chosen = scratch.keep(parts[0].union(parts[1]), "chosen")
    counts = {r["label"]: r["count"] for r in chosen.groupBy("label").count().collect()}
    if len(counts) < 2:
        return []
    vectors = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(chosen)
    forest = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=7).fit(vectors.select("features", "label"))

    def arrays(tree) -> tuple:
        nodes: list[list] = []

        def add(node) -> int:
            place = len(nodes)
            stats = node.impurityStats().stats()
            nodes.append([-1, 0.0, 0, 0, stats[1] / max(stats[0] + stats[1], 1e-300)])
            if node.subtreeDepth():
                split = node.split()
                nodes[place][:2] = [split.featureIndex(), split.threshold()]
                nodes[place][2], nodes[place][3] = add(node.leftChild()), add(node.rightChild())
            return place

        add(tree._java_obj.rootNode())
        feature, threshold, left, right, share = zip(*nodes)
        return np.array(feature), np.array(threshold), np.array(left), np.array(right), np.array(share)

    return [arrays(t) for t in forest.trees]


def probability(rows: np.ndarray, trees: list[tuple]) -> np.ndarray:
    """Mean of the trees' leaves; without trees 1 for clear secrets and 0 for all others."""
    if not trees:
        return clear_cases(rows)[0].astype(float)
    total = np.zeros(len(rows))
    every = np.arange(len(rows))
    for feature, threshold, left, right, share in trees:
        node = np.zeros(len(rows), np.int64)
        while True:
            inner = feature[node] >= 0
            if not inner.any():
                break
            goes = rows[every, np.maximum(feature[node], 0)] <= threshold[node]
            node = np.where(inner, np.where(goes, left[node], right[node]), node)
        total += share[node]
    return total / len(trees)


def _found(batches: Iterator[pa.RecordBatch], model) -> Iterator[pa.RecordBatch]:
    known, trees = model.value
    for batch in batches:
        for row, data, offsets in chunks(batch.column(1)):
            starts, ends, text, rows = candidates(data, offsets, known)
            ids = batch.column(0).slice(row, len(offsets) - 1).take(pa.array(text))
            raw = data.tobytes()
            values = [raw[a:b].decode() for a, b in zip(starts.tolist(), ends.tolist())]
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(starts - offsets[text]), pa.array(ends - offsets[text]), pa.array(values, pa.string()),
                 pa.array(probability(rows, trees))],
                names=["id_", "start", "end", "value", "probability"],
            )


def find(docs: DataFrame, known: np.ndarray, trees: list[tuple], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every candidate: id, first and end byte, value, and the forest's ``probability`` of a secret."""
    sent = docs.sparkSession.sparkContext.broadcast((known, trees))
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id_"), F.col(f"`{text_col}`").alias("text_"))
    made = rows.mapInArrow(partial(_found, model=sent), "id_ long, start long, end long, value string, probability double")
    return made.withColumnRenamed("id_", id_col)


def _redacted(batches: Iterator[pa.RecordBatch], model, at: int, chars: int | None, mark: str, limit: float) -> Iterator[pa.RecordBatch]:
    known, trees = model.value
    for batch in batches:
        column = batch.column(at)
        changed: dict[int, str] = {}
        for row, data, offsets in chunks(column):
            starts, ends, text, rows = candidates(data, offsets, known)
            bad = probability(rows, trees) >= limit
            for t in np.unique(text[bad]).tolist():
                mine = np.flatnonzero(bad & (text == t))
                raw, out, end = data[offsets[t] : offsets[t + 1]].tobytes(), [], 0
                for a, b in zip((starts[mine] - offsets[t]).tolist(), (ends[mine] - offsets[t]).tolist()):
                    out += [raw[end:a], mark.encode()]
                    end = b
                changed[row + t] = b"".join([*out, raw[end:]]).decode()
        if changed:
            texts = column.to_pylist()
            for i, new in changed.items():
                texts[i] = new
            batch = batch.set_column(at, batch.schema.field(at), pa.array(texts, column.type))
            if chars is not None:
                counts = batch.column(chars).to_pylist()
                for i, new in changed.items():
                    counts[i] = len(new)
                batch = batch.set_column(chars, batch.schema.field(chars), pa.array(counts, batch.column(chars).type))
        yield batch


def redact(
    docs: DataFrame, known: np.ndarray, trees: list[tuple], text_col: str = "text", chars_col: str | None = "n_chars",
    mark: str = "[SECRET]", limit: float = 0.5,
) -> DataFrame:
    """``docs`` with every candidate of at least ``limit`` replaced by ``mark``, and its characters counted anew."""
    sent = docs.sparkSession.sparkContext.broadcast((known, trees))
    at = docs.columns.index(text_col)
    chars = docs.columns.index(chars_col) if chars_col in docs.columns else None
    return docs.mapInArrow(partial(_redacted, model=sent, at=at, chars=chars, mark=mark, limit=limit), docs.schema)
