"""Toxicity scores of texts by a support vector machine on a subsequence string kernel, with Nyström landmarks.

Kernel. Two words are compared by the letter triples they have as subsequences, gaps included: a triple
that spans d letters weighs ``decay ** d``, spans go up to ``SPAN`` letters. So a word with an inserted, doubled
or missing letter still shares most of its triples with the plain word. The front of a word counts as a letter. The kernel is normalised and raised to a
power, and the kernel of two sentences is the sum over their pairs of distinct words. The kernel is approximated on
``m`` landmark words (Nyström): a word's features are its kernel values with the landmarks times the inverse square
root of the landmarks' own kernel matrix. A linear machine on the summed features then gives each
word a number, a sentence their sum, and a text the greatest of its sentences.

Words are white-space separated; ASCII signs inside them do not count, single letters in a row are one word, and
words of more than ``LONGEST`` bytes are cut into overlapping windows. Sentences end at line ends, at ``.!?`` before white space and after ``WORDS`` words.

Training takes at most ``sample`` labelled texts of each class, those with the smallest hash of their id, and once more with a
character inserted in each word: the toxic ones and a quarter of the others. A
toxic text's label belongs to some sentences of it, not known in advance: the machine is fitted, each toxic text's highest
sentence, and those that score above all sentences of other texts, are taken as its examples, and this is repeated. A logistic curve on the texts' scores, weighted to the classes' shares
among all labelled rows, gives the probability. The sentences' features stay in the cluster: a step of the fit sums small matrices over
parts of them. Landmark words, these matrices, the sample's highest margins and the fitted numbers pass through the driver.

Defined results: a null or empty text, or one without words, gets the score of a sentence without words. Every
row gets a score, repeated rows equal ones. Rows with null labels teach nothing. If the labelled rows lack one
of the classes, every score is the share of toxic rows (0 without any labelled rows).
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator, Mapping
from dataclasses import dataclass
from functools import partial
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cellwarden.llm.tables import Scratch
from cellwarden.llm.textbatch import _SPACE, Memory, chunks, distinct, hashes, lower, ragged, spans

SPAN = 7
DECAY = 0.9
POWER = 4
LONGEST = 24
#: Words of a sentence; a longer one is cut.
WORDS = 32
#: Parts of the training sentences; each sends one matrix to the driver in a step.
PARTS = 32
#: Letters, digits, four kinds of other bytes, and the front of a word.
LETTERS = 41
FRONT = 40

_CODE = np.zeros(256, np.int64)
_CODE[97:123] = np.arange(26)
_CODE[48:58] = 26 + np.arange(10)
_CODE[128:] = 36 + (np.arange(128) & 3)
_LETTER = np.zeros(256, bool)
_LETTER[97:123] = _LETTER[48:58] = _LETTER[128:] = True
_STOP = np.zeros(256, bool)
_STOP[[0x21, 0x2E, 0x3F]] = True


def triples(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of all triples in n letters, and the letters each spans."""
    places = [c for c in combinations(range(n), 3) if c[2] - c[0] < SPAN]
    return np.array(places, np.int64).reshape(-1, 3), np.array([c[2] - c[0] + 1 for c in places], np.int64)


def features(letters: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For words of one length (rows): triple numbers, their weights, and each word's kernel with itself."""
    letters = np.hstack([np.full((len(letters), 1), FRONT), letters])
    places, wide = triples(letters.shape[1])
    numbers = (letters[:, places[:, 0]] * LETTERS + letters[:, places[:, 1]]) * LETTERS + letters[:, places[:, 2]]
    weights = DECAY**wide
    row = np.arange(len(letters))[:, None]
    order = np.sort(((row * LETTERS**3 + numbers) * 8 + wide).ravel())
    first = np.flatnonzero(np.append(True, np.diff(order >> 3) != 0))
    sums = np.add.reduceat(DECAY ** (order & 7).astype(float), first)
    owner = (order[first] >> 3) // LETTERS**3
    return numbers, weights, np.bincount(owner, weights=sums**2, minlength=len(letters))


@dataclass
class Landmarks:
    """Weight of each triple in each landmark word, rows only for triples that occur."""

    row_of: np.ndarray
    rows: np.ndarray

    @classmethod
    def of(cls, words: list[bytes]) -> Landmarks:
        table: dict[int, np.ndarray] = {}
        for k, word in enumerate(words):
            numbers, weights, own = features(_CODE[np.frombuffer(word, np.uint8)][None, :])
            for number, weight in zip(numbers[0].tolist(), weights.tolist()):
                table.setdefault(number, np.zeros(len(words)))[k] += weight / np.sqrt(own[0])
        row_of = np.zeros(LETTERS**3, np.int32)
        row_of[list(table)] = np.arange(1, len(table) + 1)
        return cls(row_of, np.array([np.zeros(len(words)), *table.values()], np.float32))

    def kernel(self, letters: np.ndarray) -> np.ndarray:
        """Normalised kernel to the power of words of one length with all landmarks."""
        numbers, weights, own = features(letters)
        out = np.zeros((len(letters), self.rows.shape[1]), np.float32)
        at = self.row_of[numbers]
        for t, weight in enumerate(weights.tolist()):
            hit = np.flatnonzero(at[:, t])
            out[hit] += np.float32(weight) * self.rows[at[hit, t]]
        return (out / np.sqrt(np.maximum(own, 1e-12))[:, None].astype(np.float32)) ** POWER


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """Letters of lower-cased texts; start, end and text of each word in them; and where a new sentence starts."""
    space = _SPACE[data]
    last = np.ones(len(data), bool)  # white space or the end of the text follows
    last[:-1] = space[1:]
    last[offsets[1:][offsets[1:] > 0] - 1] = True
    stop = np.cumsum((data == 0x0A) | (_STOP[data] & last))
    keep = _LETTER[data] | space
    where = np.flatnonzero(keep)
    data, offsets = data[keep], np.append(0, np.cumsum(keep))[offsets]
    starts, ends = spans(data, offsets)
    text = np.searchsorted(offsets, starts, "right") - 1
    # Letters that stand alone one after another are one word.
    alone = ends - starts == 1
    joined = np.zeros(len(starts), bool)
    joined[1:] = alone[1:] & alone[:-1] & (text[1:] == text[:-1])
    if joined.any():
        gone = np.zeros(len(data), bool)
        gone[ragged(ends[:-1][joined[1:]], (starts[1:] - ends[:-1])[joined[1:]])] = True
        where, data, offsets = where[~gone], data[~gone], offsets - np.append(0, np.cumsum(gone))[offsets]
        starts, ends = spans(data, offsets)
        text = np.searchsorted(offsets, starts, "right") - 1
    sentence = stop[where[starts]] if len(starts) else np.zeros(0, np.int64)
    new = np.ones(len(starts), bool)
    new[1:] = (sentence[1:] != sentence[:-1]) | (text[1:] != text[:-1])
    if len(starts):
        first = np.flatnonzero(new)
        within = np.arange(len(starts)) - np.repeat(first, np.diff(np.append(first, len(starts))))
        new |= within % WORDS == 0
    # Long words as overlapping windows.
    half = LONGEST // 2
    windows = 1 + np.maximum(0, -(-(ends - starts - LONGEST) // half))
    if (windows > 1).any():
        number = ragged(np.zeros(len(starts), np.int64), windows)
        first = np.repeat(starts, windows) + number * half
        ends = np.minimum(first + LONGEST, np.repeat(ends, windows))
        new = np.repeat(new, windows) & (number == 0)
        starts, text = first, np.repeat(text, windows)
    return data, starts, ends, text, new


def once_each(word: np.ndarray, new: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the distinct words of each sentence, and the sentence of each; ``word`` holds small numbers."""
    sentence = np.cumsum(new) - 1
    key = np.sort(sentence * (int(word.max()) + 1) + word) if len(word) else sentence
    key = key[np.append(True, np.diff(key) != 0)] if len(key) else key
    width = int(word.max()) + 1 if len(word) else 1
    return key % width, key // width


#: Rows handled at a time while fitting.
STRIP = 8192


def per_word(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, made, width: int) -> np.ndarray:
    """``made(letters)`` of each word, words of one length together; zeros for words without a triple."""
    out = np.zeros((len(starts), width), np.float32)
    order = np.argsort(lengths, kind="stable")
    cuts = np.flatnonzero(np.diff(lengths[order])) + 1
    for same in np.split(order, cuts) if len(order) else []:
        n = int(lengths[same[0]])
        if n < 2:
            continue
        for k in range(0, len(same), 4096):
            some = same[k : k + 4096]
            out[some] = made(_CODE[data[starts[some][:, None] + np.arange(n)]])
    return out


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct words of each text, with its class."""
    for batch in batches:
        for row, raw, offsets in chunks(batch.column(0)):
            data, starts, ends, text, _ = word_spans(lower(raw), offsets)
            found = hashes(data, starts, ends)
            order = np.lexsort((found, text))
            new = np.ones(len(order), bool)
            new[1:] = np.diff(found[order]).astype(bool) | np.diff(text[order]).astype(bool)
            once = order[new]
            label = batch.column(1).slice(row, len(offsets) - 1).to_numpy()
            whole = data.tobytes()
            words = [whole[a:b] for a, b in zip(starts[once].tolist(), ends[once].tolist())]
            yield pa.RecordBatch.from_arrays(
                [pa.array(words, pa.binary()), pa.array(label[text[once]].astype(np.int64))], names=["word", "toxic"]
            )


def _sentences(batches: Iterator[pa.RecordBatch], landmarks) -> Iterator[pa.RecordBatch]:
    """Summed kernel values of each sentence: text's row key, its class, bytes."""
    marks = Landmarks(*landmarks.value)
    width = marks.rows.shape[1]
    for batch in batches:
        # By the key, so that the examples do not depend on the partitions.
        quarter = np.array([zlib.crc32((k or "").encode()) % 4 == 0 for k in batch.column(2).to_pylist()], bool)
        for row, raw, offsets in chunks(batch.column(0)):
            data, starts, ends, text, new = word_spans(lower(raw), offsets)
            if not len(starts):
                continue
            keys, at, word = distinct(hashes(data, starts, ends))
            each = per_word(data, starts[at], (ends - starts)[at], marks.kernel, width)
            first = np.flatnonzero(new)
            found, sentence = once_each(word, new)
            sums = np.add.reduceat(each[found], np.flatnonzero(np.append(True, np.diff(sentence) != 0)), axis=0)
            ids, label = batch.column(2), batch.column(1)
            toxic = label.to_numpy()[row + text[first]]
            own = pa.array(row + text[first])
            yield sentence_rows(ids.take(own), label.take(own), sums)
            # The same sentences with a character inserted in each word: all toxic texts, and a quarter of the others.
            each = per_word(*with_insertions(data, starts[at], (ends - starts)[at], keys), marks.kernel, width)
            sums = np.add.reduceat(each[found], np.flatnonzero(np.append(True, np.diff(sentence) != 0)), axis=0)
            some = np.flatnonzero((toxic == 1) | quarter[row + text[first]])
            own = pa.array(row + text[first[some]])
            yield sentence_rows(pc.binary_join_element_wise(ids.take(own), "inserted", "/"), label.take(own), sums[some])


def sentence_rows(keys: pa.Array, labels: pa.Array, sums: np.ndarray) -> pa.RecordBatch:
    values = pa.array([s.tobytes() for s in sums.astype(np.float16)], pa.binary())
    return pa.RecordBatch.from_arrays([keys, labels.cast(pa.int64()), values], names=["key", "toxic", "sums"])


def with_insertions(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, ...]:
    """Words with one letter or digit inserted, chosen by the word's hash; short and full ones as they are."""
    flat = data[ragged(starts, lengths)]
    begin = np.cumsum(lengths) - lengths
    long = (lengths >= 4) & (lengths < LONGEST)
    at = begin + 1 + (keys % np.maximum(lengths - 1, 1).astype(np.uint64)).astype(np.int64)
    letters = np.frombuffer(b"abcdefghijklmnopqrstuvwxyz0123456789", np.uint8)[((keys >> np.uint64(32)) % np.uint64(36)).astype(int)]
    return np.insert(flat, at[long], letters[long]), begin + np.cumsum(long) - long, lengths + long


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """Number, text of each sentence, class and kernel sums of each part of the training table, whose rows lie together."""
    held: list[pa.RecordBatch] = []

    def whole() -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
        table = pa.Table.from_batches(held).combine_chunks()
        text = pc.dictionary_encode(table["key"].chunk(0), null_encoding="encode").indices.to_numpy()
        sums = table["sums"].chunk(0)
        places = np.frombuffer(sums.buffers()[1], np.int32)[sums.offset : sums.offset + len(sums) + 1]
        values = np.frombuffer(sums.buffers()[2], np.uint8)[places[0] : places[-1]].view(np.float16)
        return table["part"][0].as_py(), text, table["toxic"].to_numpy(), values.reshape(len(sums), -1)

    for batch in batches:
        number = batch.column(0).to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(number)) + 1).tolist(), len(number)]
        for a, b in zip(cuts, cuts[1:]):
            if b > a:
                if held and held[0].column(0)[0].as_py() != number[a]:
                    yield whole()
                    held.clear()
                held.append(batch.slice(a, b - a))
    if held:
        yield whole()


def _margins(sums: np.ndarray, root: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Margin of each sentence under ``w``, strip by strip."""
    line = w.astype(np.float32)
    strips = [(sums[k : k + STRIP].astype(np.float32) @ root) @ line[:-1] + line[-1] for k in range(0, len(sums), STRIP)]
    return np.concatenate(strips)


def _highest(margin: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Place of the highest sentence of each text, the first of equal ones, by number of the text."""
    top = np.lexsort((-margin, text))
    return top[np.append(True, np.diff(text[top]) != 0)]


def _newton_part(
    batches: Iterator[pa.RecordBatch], root, w: np.ndarray, earlier: tuple[np.ndarray, float] | None, balance: float
) -> Iterator[pa.RecordBatch]:
    """Per part: the normal equations of the sentences within the margin under ``w``, which ones these are, and the highest other sentence.

    Without an ``earlier`` machine a toxic text's sentences share a cost of one, and another sentence costs ``balance``. With one (weights, and its
    highest sentence of another text), toxic examples are the sentences above that and the highest of each text.
    """
    root = root.value
    for number, text, toxic, sums in _parts(batches):
        bad = toxic == 1
        if earlier is None:
            cost = np.where(bad, 1.0 / np.bincount(text)[text], balance)
        else:
            before = _margins(sums, root, earlier[0])
            telling = bad & (before > earlier[1])
            first = _highest(before, text)
            telling[first] |= bad[first]
            cost = (~bad | telling).astype(float)
        margin = _margins(sums, root, w)
        y = np.where(bad, 1.0, -1.0)
        inside = (y * margin < 1) & (cost > 0)
        square, right = np.zeros((len(w), len(w))), np.zeros(len(w))
        inner = np.flatnonzero(inside)
        for k in range(0, len(inner), STRIP):
            some = inner[k : k + STRIP]
            z = np.ones((len(some), len(w)))
            z[:, :-1] = sums[some].astype(np.float32) @ root
            part = z * cost[some][:, None]
            square += part.T @ z
            right += part.T @ y[some]
        clear = float(margin[~bad].max()) if (~bad).any() else -np.inf
        yield pa.RecordBatch.from_pydict(
            {
                "part": pa.array([number], pa.int64()), "inside": pa.array([zlib.crc32(np.packbits(inside).tobytes())], pa.int64()),
                "clear": [clear], "square": [square.tobytes()], "right": [right.tobytes()],
            }
        )


def _highest_part(batches: Iterator[pa.RecordBatch], root, w: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Class and highest margin of each text."""
    for number, text, toxic, sums in _parts(batches):
        margin = _margins(sums, root.value, w)
        first = _highest(margin, text)
        yield pa.RecordBatch.from_pydict(
            {
                "part": np.full(len(first), number), "text": text[first].astype(np.int64),
                "toxic": toxic[first].astype(np.int64), "margin": margin[first].astype(float),
            }
        )


def fit_linear(
    rows: DataFrame, root, start: np.ndarray, earlier: tuple[np.ndarray, float] | None = None, balance: float = 1.0, steps: int = 30
) -> tuple[np.ndarray, float]:
    """Weights of a squared-hinge machine, the last one the constant, and its highest sentence of another text.

    Newton steps from ``start``. A step is one job: each part of ``rows`` sends a small matrix, the driver adds them in the parts' order.
    """
    w, met = start, None
    ridge = np.eye(len(w))
    ridge[-1, -1] = 1e-6
    for step in range(steps + 1):
        made = rows.mapInArrow(
            partial(_newton_part, root=root, w=w, earlier=earlier, balance=balance),
            "part long, inside long, clear double, square binary, right binary",
        )
        parts = sorted(made.collect(), key=lambda r: (r["part"], r["inside"]))
        clear, inside = max(r["clear"] for r in parts), [(r["part"], r["inside"]) for r in parts]
        if inside == met or step == steps:
            break
        met = inside
        square = ridge + sum(np.frombuffer(r["square"]).reshape(ridge.shape) for r in parts)
        w = np.linalg.solve(square, sum(np.frombuffer(r["right"]) for r in parts))
    return w, clear


def fit_curve(margin: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and constant of the logistic curve of y (0 or 1), with a small ridge; the slope is not negative."""
    z = np.stack([margin, np.ones(len(margin))], axis=1)
    w = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (weight * p * (1 - p))[:, None]).T @ z + np.eye(2) * 1e-3, z.T @ (weight * (p - y)) + 1e-3 * w)
        w -= np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-9:
            break
    return max(float(w[0]), 0.0), float(w[1])


@dataclass
class Model:
    """What scoring needs: landmarks, the number each landmark adds, and the curve."""

    landmarks: Landmarks | None
    weights: np.ndarray
    constant: float
    slope: float
    offset: float

    def plain(self) -> tuple:
        """The same as arrays and numbers, which tasks can read without this package."""
        marks = self.landmarks and (self.landmarks.row_of, self.landmarks.rows)
        return marks, self.weights, self.constant, self.slope, self.offset

    def probability(self, margin: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * margin + self.offset, -30, 30)))


def train(
    texts: DataFrame, text: Column, label: Column, key: Column, sample: int = 1000, marks: int = 128,
    totals: Mapping[int, int] | None = None, sentences: int = 1_000_000,
) -> Model:
    """Fit on rows with a label of 0 or 1; ``sample`` bounds the rows of each class, ``sentences`` about their sentences.

    Of texts with more sentences than that, those with the smallest hashes are taken, so each step reads 256 bytes for each of ``sentences`` at most.
    ``totals`` tells the labelled rows of each class if ``texts`` is a sample of them already.
    """
    spark = texts.sparkSession
    rows = texts.select(text.alias("text"), label.cast("long").alias("toxic"), key.cast("string").alias("key"))
    rows = rows.where(F.col("toxic").isin(0, 1))
    counts = {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}
    none, some = counts.get(0, 0), counts.get(1, 0)
    if not none or not some:
        share = some / max(1, none + some)
        return Model(None, np.zeros(0), 0.0, 0.0, float(np.log(max(share, 1e-13) / max(1 - share, 1e-13))))
    order = [F.xxhash64("key"), F.xxhash64("text"), F.col("key")]
    picked = rows.where("toxic = 0").orderBy(*order).limit(sample).union(rows.where("toxic = 1").orderBy(*order).limit(sample))
    # At most 2 * sample rows, but of any length, so they stay in the cluster.
    scratch = Scratch(spark)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    picked = scratch.keep(picked.repartition(parts, "key", F.xxhash64("text")), "labelled")
    taken = {c: min(sample, n) for c, n in counts.items()}
    if totals:
        none, some = totals.get(0, none), totals.get(1, some)
    words = (
        picked.select("text", "toxic").mapInArrow(_words, "word binary, toxic long")
        .groupBy("word").agg(F.sum("toxic").alias("t"), F.sum(1 - F.col("toxic")).alias("c"))
        .where((F.octet_length("word") >= 2) & (F.col("t") + F.col("c") >= 2))
    )
    words = scratch.keep(words, "words")
    pt, pc = F.col("t") / taken[1], F.col("c") / taken[0]
    spread = F.sqrt((F.col("t") + F.col("c") + 1) / (taken[0] + taken[1]))
    telling = words.orderBy(F.desc((pt - pc) / spread), "word").limit(marks * 3 // 4).select("word")
    common = words.orderBy(F.desc("c"), "word").limit(marks // 8).select("word")
    other = words.orderBy(F.xxhash64("word"), "word").limit(marks // 8).select("word")
    chosen = sorted({bytes(r["word"]) for r in telling.union(common).union(other).collect()})
    if not chosen:
        share = some / (none + some)
        return Model(None, np.zeros(0), 0.0, 0.0, float(np.log(share / (1 - share))))
    landmarks = Landmarks.of(chosen)
    sent = spark.sparkContext.broadcast((landmarks.row_of, landmarks.rows))
    made = scratch.keep(
        picked.select("text", "toxic", "key").mapInArrow(partial(_sentences, landmarks=sent), "key string, toxic long, sums binary"), "sentences"
    )
    number = made.count()
    if number > sentences:
        made = made.where(F.pmod(F.xxhash64("key", "sums"), F.lit(number)) < sentences)
    # Parts, and an order in them, that do not depend on the partitions, so neither do sums over them; a text lies in one part.
    made = made.withColumn("part", F.pmod(F.xxhash64("key"), F.lit(PARTS)))
    made = made.repartition(PARTS, "part").sortWithinPartitions("part", "key", "sums").select("part", "key", "toxic", "sums")
    made = scratch.keep(made, "training")
    own = np.concatenate(
        [landmarks.kernel(_CODE[np.frombuffer(w, np.uint8)][None, :]) for w in chosen]
    ).astype(float)
    values, vectors = np.linalg.eigh((own + own.T) / 2)
    keep = values > 1e-6
    root = vectors[:, keep] / np.sqrt(values[keep])
    shared = spark.sparkContext.broadcast(root.astype(np.float32))
    sizes = made.agg(
        F.sum(1 - F.col("toxic")).alias("clean"), F.countDistinct(F.when(F.col("toxic") == 1, F.col("key"))).alias("texts")
    ).first()
    if sizes["clean"] is None:  # no labelled text has a word
        share = some / (none + some)
        return Model(None, np.zeros(0), 0.0, 0.0, float(np.log(share / (1 - share))))
    w, clear = fit_linear(made, shared, np.zeros(root.shape[1] + 1), balance=max(1, sizes["texts"]) / max(1, sizes["clean"]))
    for _ in range(5):
        w, clear = fit_linear(made, shared, w, earlier=(w, clear))
    tops = made.mapInArrow(partial(_highest_part, root=shared, w=w), "part long, text long, toxic long, margin double").collect()
    tops = sorted(tuple(r) for r in tops)  # at most four rows for each text of the sample
    label_of, top = np.array([t[2] for t in tops], float), np.array([t[3] for t in tops])
    share = np.where(label_of == 1, some / taken[1], none / taken[0])
    slope, offset = fit_curve(top, label_of, share)
    scratch.drop(made)
    return Model(landmarks, (root @ w[:-1]).astype(np.float32), float(w[-1]), slope, offset)


_remembered: dict[str, Memory] = {}


def _scores(batches: Iterator[pa.RecordBatch], model, name: str, column: str) -> Iterator[pa.RecordBatch]:
    """Put the score, as ``column``, in the place of the last column, the text. ``name`` is that of the model."""
    marks, *numbers = model.value
    fitted = Model(marks and Landmarks(*marks), *numbers)
    if name not in _remembered:
        _remembered.clear()  # a worker may serve several models one after another
    known = _remembered.setdefault(name, Memory(np.float32))
    for batch in batches:
        margins = np.full(batch.num_rows, fitted.constant)
        if fitted.landmarks is not None:
            for row, raw, offsets in chunks(batch.column(batch.num_columns - 1)):
                data, starts, ends, text, new = word_spans(lower(raw), offsets)
                if not len(starts):
                    continue
                keys, at, word = distinct(hashes(data, starts, ends))
                begin, length = starts[at], (ends - starts)[at]

                def make(places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
                    numbers = per_word(
                        data, begin[places], length[places],
                        lambda letters: (fitted.landmarks.kernel(letters) @ fitted.weights)[:, None], 1,
                    )
                    return np.ones(len(places), np.int64), numbers[:, 0]

                at, _, store = known.lookup(keys, make)
                each = store[at].astype(float)
                first = np.flatnonzero(new)
                found, sentence = once_each(word, new)
                sums = np.bincount(sentence, weights=each[found]) + fitted.constant
                best = np.full(len(offsets) - 1, -np.inf)
                np.maximum.at(best, text[first], sums)
                some = np.isfinite(best)
                margins[row : row + len(best)][some] = best[some]
        score = pa.array(fitted.probability(margins))
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], score], names=[*batch.schema.names[:-1], column])


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Id and ``score`` (the probability of the toxic class) of every row."""
    sent = docs.sparkSession.sparkContext.broadcast(model.plain())
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id_"), F.col(f"`{text_col}`").alias("text_"))
    name = uuid.uuid4().hex
    made = rows.mapInArrow(partial(_scores, model=sent, name=name, column="score"), "id_ long, score double")
    return made.withColumnRenamed("id_", id_col)


def with_scores(docs: DataFrame, model: Model, name: str = "score", text_col: str = "text") -> DataFrame:
    """``docs`` with the score as a last column ``name``, which must not be one of its columns."""
    sent = docs.sparkSession.sparkContext.broadcast(model.plain())
    schema = T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())])
    rows = docs.select("*", F.col(f"`{text_col}`").alias(name))
    return rows.mapInArrow(partial(_scores, model=sent, name=uuid.uuid4().hex, column=name), schema)
