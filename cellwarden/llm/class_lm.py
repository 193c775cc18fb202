"""Brown class-based bigram scores of texts.

Text is lower-cased (A-Z only) and cut into white-space separated words, followed by one end token. Every word
belongs to one class. The model's probability of a token is that of its class after the class before it,
times that of the word in its class; the first token follows the end token's class.

Classes. Every word that occurs at least ``LEAST`` times is clustered, whatever the size of the corpus. First, the commonest words
(all from the least count on that at most ``EXCHANGED`` words reach) make the classes by exchange: each step evaluates,
for a quarter of the words, the exact change of the class bigram likelihood for a move to each class with the counts of the step
before, and makes the best moves; a step that lowers the likelihood is undone. Then each further word joins the class
with the best gain in likelihood when its own bigrams are added to these class bigrams; its neighbours count in the classes of the
exchange, or in those of their endings. Words met once stand for the unseen ones: both belong to a class given by their
last two bytes. The end token has a class of its own.

Probabilities. ``P(class | before) = (N(before, class) + PRIOR * P(class)) / (N(before) + PRIOR)``, with
``P(class) = (N(class) + 0.5) / (N + 0.5 * classes)``; ``P(word | class) = (c + 0.5) / (N(class) + 0.5 * (V(class) + 1))``
with the word's count c and the class's distinct words V, so half a count is left for all unseen words. Counts are those of the
whole training corpus. The base score takes all words as one class without a word before.

How it runs. Words are counted per slab of a task, then by a shuffle of hashes and numbers. Class bigrams of the exchange's words are a
table with a row per word, of at most as many neighbours as there are such words and classes; the steps of the
exchange read it without a shuffle and give the driver one class per word of the exchange. Further words' bigrams meet by a shuffle
of hashes and numbers, and their classes stay a table. A pass over the texts has the classes and counts of at most ``AT_HAND`` of the commonest words;
each rarer word meets its class and count by a join on the hash, once per slab of texts. Slabs, a byte per token, and their rare
words are brought together by number and streamed, so a task holds one slab. Class bigrams and scores are made from the classes of the
texts. Words are told apart by 64-bit hashes: two among a billion distinct words share one with a probability of 3 %.

Defined results: a null or empty text is its end token alone. Each row gives one row, repeated rows and rows
without an id too. Without training rows N is 0 and every count is 0. Further columns play no part.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellwarden.llm.tables import Scratch, release
from cellwarden.llm.textbatch import U64, chunks, hashes, lower, mix, words

LEAST = 2
#: Words of the exchange, at most.
EXCHANGED = 20_000
#: Words whose classes and counts a pass over the texts has at hand, at most.
AT_HAND = 1 << 19
CLASSES = 64
ENDINGS = 32
PRIOR = 10.0
STEPS = 12
SLAB = 2 << 20
#: Tokens of a slab of texts whose words meet their classes together.
CODED = 1 << 20
#: Words whose gains are computed at a time.
GAINS = 4096


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, text and ending class (from 0) of every word; ``data`` is lower-cased."""
    found, starts, ends, text = words(data, offsets)
    ending = hashes(data, np.maximum(starts, ends - 2), ends) % U64(ENDINGS)
    return found, text, ending.astype(np.int64)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, ending class, count) of each slab; the end token is the null word."""
    slab, held, texts = [], 0, 0

    def rows() -> pa.RecordBatch:
        found = np.concatenate([f for f, _ in slab])
        ending = np.concatenate([e for _, e in slab])
        word, at, count = np.unique(found, return_index=True, return_counts=True)
        return pa.RecordBatch.from_arrays(
            [pa.array(word.view(np.int64)), pa.array(ending[at]), pa.array(count.astype(np.int64))],
            names=["word", "ending", "n"],
        )

    for batch in batches:
        for _, data, offsets in chunks(batch.column(0)):
            found, _, ending = tokens(lower(data), offsets)
            slab.append((found, ending))
            held, texts = held + len(found), texts + len(offsets) - 1
            if held >= SLAB:
                yield rows()
                slab, held = [], 0
    if held:
        yield rows()
    if texts:
        yield pa.RecordBatch.from_arrays(
            [pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.array([texts], pa.int64())], names=["word", "ending", "n"]
        )


def numbered(found: np.ndarray, ending: np.ndarray, frequent: np.ndarray) -> np.ndarray:
    """Number of each word: that among the sorted frequent hashes, or after them that of its ending class."""
    if not len(frequent):
        return ending
    at = np.minimum(np.searchsorted(frequent, found), len(frequent) - 1)
    return np.where(frequent[at] == found, at, len(frequent) + ending)


def sequence(number: np.ndarray, text: np.ndarray, texts: int, end: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Numbers before and of each token (end tokens included), and the token's text."""
    counts = np.bincount(text, minlength=texts)
    stops = np.cumsum(counts)
    all_tokens = np.insert(number, stops, end)
    before = np.append(end, all_tokens[:-1])  # an end token stands before each text
    return before, all_tokens, np.repeat(np.arange(texts), counts + 1)


def _paired(batches: Iterator[pa.RecordBatch], frequent) -> Iterator[pa.RecordBatch]:
    """(before, token, count) of each slab."""
    often = frequent.value
    end = len(often) + ENDINGS
    slab, held = [], 0

    def rows() -> pa.RecordBatch:
        pair, count = np.unique(np.concatenate(slab), return_counts=True)
        return pa.RecordBatch.from_arrays(
            [pa.array((pair // (end + 1)).astype(np.int32)), pa.array((pair % (end + 1)).astype(np.int32)), pa.array(count.astype(np.int64))],
            names=["before", "token", "n"],
        )

    for batch in batches:
        for _, data, offsets in chunks(batch.column(0)):
            found, text, ending = tokens(lower(data), offsets)
            before, token, _ = sequence(numbered(found, ending, often), text, len(offsets) - 1, end)
            slab.append(before * (end + 1) + token)
            held += len(token)
            if held >= SLAB:
                yield rows()
                slab, held = [], 0
    if held:
        yield rows()


def xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1e-300))


def likelihood(pairs: np.ndarray) -> float:
    """Class bigram log likelihood, up to a constant of the corpus."""
    return float(xlogx(pairs).sum() - xlogx(pairs.sum(axis=0)).sum() - xlogx(pairs.sum(axis=1)).sum())


def best_class(after: np.ndarray, ahead: np.ndarray, own: float, now: int, pairs: np.ndarray, movable: int) -> tuple[int, float]:
    """Best class of a word and the gain in likelihood, by exact exchange.

    ``after[c]`` and ``ahead[c]``: tokens of class c after and before it, itself in its class ``now``; ``own``: times it follows
    itself; ``pairs``: class bigrams with the word in ``now``. The first ``movable`` classes take words.
    """
    rest = pairs.copy()
    rest[now] -= after
    rest[:, now] -= ahead
    rest[now, now] += own
    after, ahead = after.copy(), ahead.copy()
    after[now] -= own
    ahead[now] -= own
    # The word's neighbours keep their places as first or second of a pair, wherever it goes.
    rows, columns = rest.sum(axis=1) + ahead, rest.sum(axis=0) + after
    b = np.arange(movable)
    down, across = rest[:movable], rest[:, :movable].T
    right = xlogx(down + after) - xlogx(down)
    left = xlogx(across + ahead) - xlogx(across)
    right[b, b] = left[b, b] = 0
    itself = rest[b, b]
    gain = right.sum(axis=1) + left.sum(axis=1) + xlogx(itself + after[b] + ahead[b] + own) - xlogx(itself)
    total_after, total_ahead = after.sum() + own, ahead.sum() + own
    gain -= xlogx(rows[b] + total_after) - xlogx(rows[b]) + xlogx(columns[b] + total_ahead) - xlogx(columns[b])
    to = int(gain.argmax())
    return to, float(gain[to] - gain[now])


def _neighbours(batch: pa.RecordBatch, classes: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, float]]:
    """Each word, its class counts after and before it, and how often it follows itself."""
    width = int(classes.max()) + 1
    for i in range(batch.num_rows):
        word = batch.column(0)[i].as_py()
        near = batch.column(1)[i].values
        other, side, n = (near.field(c).to_numpy() for c in ("other", "side", "n"))
        after = np.bincount(classes[other[side == 1]], weights=n[side == 1], minlength=width)
        ahead = np.bincount(classes[other[side == 0]], weights=n[side == 0], minlength=width)
        yield word, after, ahead, float(n[(side == 1) & (other == word)].sum())


def _counts(pairs: np.ndarray) -> pa.RecordBatch:
    """A matrix of whole numbers as rows (pair, n) of its places and values other than 0."""
    places = np.flatnonzero(pairs)
    return pa.RecordBatch.from_arrays([pa.array(places.astype(np.int32)), pa.array(pairs.ravel()[places].astype(np.int64))], names=["pair", "n"])


def summed(parts: DataFrame, width: int) -> np.ndarray:
    """The sum of the tasks' matrices; one number for each pair of classes reaches the driver."""
    pairs = np.zeros(width * width)
    for r in parts.groupBy("pair").agg(F.sum("n").alias("n")).collect():
        pairs[r["pair"]] = r["n"]
    return pairs.reshape(width, width)


def _matrix(batches: Iterator[pa.RecordBatch], classes: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Class bigrams of the words of one task."""
    width = int(classes.max()) + 1
    pairs = np.zeros((width, width))
    for batch in batches:
        for word, after, _, _ in _neighbours(batch, classes):
            pairs[classes[word]] += after
    yield _counts(pairs)


def _moves(batches: Iterator[pa.RecordBatch], classes: np.ndarray, pairs: np.ndarray, words_n: int, step: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [(word, *best_class(after, ahead, own, int(classes[word]), pairs, CLASSES))
                 for word, after, ahead, own in _neighbours(batch, classes) if word < words_n and word % 4 == step % 4]
        columns = list(zip(*found)) if found else [[], [], []]
        yield pa.RecordBatch.from_arrays(
            [pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.float64())],
            names=["word", "to", "gain"],
        )


def cluster(near: DataFrame, words_n: int, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Class of each number (words, endings, end) and class bigrams, by exchange from classes dealt by frequency."""
    rank = np.empty(words_n, np.int64)
    rank[np.lexsort((np.arange(words_n), -counts))] = np.arange(words_n)
    classes = np.append(rank % CLASSES, CLASSES + np.arange(ENDINGS + 1))

    def bigrams(of: np.ndarray) -> np.ndarray:
        return summed(near.mapInArrow(partial(_matrix, classes=of), "pair int, n long"), CLASSES + ENDINGS + 1)

    pairs = bigrams(classes)
    value = likelihood(pairs)
    for step in range(STEPS if words_n else 0):
        made = near.mapInArrow(
            partial(_moves, classes=classes, pairs=pairs, words_n=words_n, step=step), "word int, to int, gain double"
        ).where("gain > 1e-9").collect()  # clustered words at most
        tried = classes.copy()
        for r in made:
            tried[r["word"]] = r["to"]
        after = bigrams(tried)
        if made and likelihood(after) > value:
            classes, pairs, value = tried, after, likelihood(after)
    return classes, pairs


def _placed(batches: Iterator[pa.RecordBatch], frequent, classes: np.ndarray) -> Iterator[pa.RecordBatch]:
    """(word, place, n) of the words outside the exchange, for each slab: ``place`` is the class before times the number of classes and the class after."""
    often = frequent.value
    end, width = len(often) + ENDINGS, int(classes.max()) + 1
    slab, held = [], 0

    def rows() -> pa.RecordBatch:
        word, place = (np.concatenate(c) for c in zip(*slab))
        order = np.lexsort((place, word))
        word, place = word[order], place[order]
        new = np.ones(len(word), bool)
        new[1:] = (word[1:] != word[:-1]) | (place[1:] != place[:-1])
        first = np.flatnonzero(new)
        n = np.diff(np.append(first, len(word)))
        return pa.RecordBatch.from_arrays(
            [pa.array(word[first].view(np.int64)), pa.array(place[first].astype(np.int32)), pa.array(n.astype(np.int64))],
            names=["word", "place", "n"],
        )

    for batch in batches:
        for _, data, offsets in chunks(batch.column(0)):
            found, text, ending = tokens(lower(data), offsets)
            before, token, of = sequence(numbered(found, ending, often), text, len(offsets) - 1, end)
            rest = np.flatnonzero((token >= len(often)) & (token < end))  # an end token follows each text, so there is a next one
            # A token's place among all words: end tokens of the texts before it are left out.
            slab.append((found[rest - of[rest]], classes[before[rest]] * width + classes[token[rest + 1]]))
            held += len(rest)
            if held >= SLAB:
                yield rows()
                slab, held = [], 0
    if held:
        yield rows()


def gains(after: np.ndarray, ahead: np.ndarray, pairs: np.ndarray, movable: int) -> np.ndarray:
    """Gain in likelihood (row per word) when a word's tokens are added to each of the first ``movable`` classes.

    ``after[w, c]`` and ``ahead[w, c]``: tokens of class c after and before word w, ``pairs``: class bigrams without it.
    The word's neighbours keep their places as second or first of a pair.
    """
    total = np.zeros((len(after), movable))
    for counts, near in ((after, pairs[:movable]), (ahead, pairs[:, :movable].T)):
        w, c = np.nonzero(counts)
        n = counts[w, c]
        # Few counts differ: one row of gains for each class and count.
        kinds, which = np.unique(c * (int(n.max(initial=0)) + 1) + n.astype(np.int64), return_inverse=True)
        cls, times = np.divmod(kinds, int(n.max(initial=0)) + 1)
        each = xlogx(near[:, cls] + times) - xlogx(near[:, cls])
        starts = np.flatnonzero(np.append(True, w[1:] != w[:-1])) if len(w) else w
        if len(w):
            total[w[starts]] += np.add.reduceat(each.T[which], starts, axis=0)
    b = np.arange(movable)
    own, x, y = pairs[b, b], after[:, :movable], ahead[:, :movable]
    total += xlogx(own + x + y) - xlogx(own + x) - xlogx(own + y) + xlogx(own)
    rows, columns = pairs.sum(axis=1)[:movable], pairs.sum(axis=0)[:movable]
    # The neighbours keep the classes' other totals; the word adds its tokens to both totals of its own class.
    times = after.sum(axis=1, keepdims=True)
    return total - (xlogx(rows + times) - xlogx(rows)) - (xlogx(columns + times) - xlogx(columns))


def _assigned(batches: Iterator[pa.RecordBatch], pairs: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Class of each word from its ``near`` places."""
    width = len(pairs)
    for batch in batches:
        for at in range(0, batch.num_rows, GAINS):
            part = batch.slice(at, GAINS)
            near = part.column(1)
            values, sizes = near.flatten(), np.diff(near.offsets.to_numpy())
            w, n = np.repeat(np.arange(part.num_rows), sizes), values.field("n").to_numpy()
            before, after = np.divmod(values.field("place").to_numpy().astype(np.int64), width)
            counts = [np.bincount(w * width + c, weights=n, minlength=part.num_rows * width).reshape(-1, width) for c in (after, before)]
            best = gains(*counts, pairs, CLASSES).argmax(axis=1)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(best.astype(np.int32))], names=["word", "cls"])


#: A slab of texts, one row of lists: classes are a byte per token; the token at ``places[i]`` is the rare word ``at[i]`` of the slab.
_SLAB = pa.schema([
    ("doc_id", pa.list_(pa.int64())), ("training", pa.list_(pa.bool_())), ("sizes", pa.list_(pa.int32())), ("classes", pa.binary()),
    ("places", pa.list_(pa.int32())), ("at", pa.list_(pa.int32())), ("known", pa.list_(pa.int32())), ("counts", pa.list_(pa.float64())),
])


def _list(values: pa.Array) -> pa.ListArray:
    """One list of all values."""
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


def _coded(batches: Iterator[pa.RecordBatch], hand, end: tuple[int, float]) -> Iterator[pa.RecordBatch]:
    """Rows (key, at, word, ending, slab): one per slab of texts, with ``at`` -1, and one per slab and word that is not at hand.

    ``hand`` holds the sorted hashes of words, their classes and logarithmic counts; ``end`` the end token's.
    """
    often, of_word, log_count = hand.value
    of_word, log_count = np.append(of_word, end[0]), np.append(log_count, end[1])
    number_of_end, key = len(often), TaskContext.get().partitionId() << 32
    slab, held = [], 0

    def rows() -> pa.RecordBatch:
        ids, training = (pa.concat_arrays(c) for c in list(zip(*slab))[:2])
        sizes, classes, rest, rw, re, known, counts = (np.concatenate(c) for c in list(zip(*slab))[2:])
        word, first, at = np.unique(rw, return_index=True, return_inverse=True)
        numbers = [_list(pa.array(c.astype(np.int32))) for c in (rest, at, known)]
        whole = pa.RecordBatch.from_arrays(
            [_list(ids), _list(training), _list(pa.array(sizes.astype(np.int32))), pa.array([classes.tobytes()], pa.binary()),
             *numbers, _list(pa.array(counts))],
            schema=_SLAB,
        )
        return pa.RecordBatch.from_arrays(
            [
                pa.array(np.full(len(word) + 1, key)),
                pa.array(np.arange(-1, len(word), dtype=np.int32)),
                pa.array(np.append(U64(0), word).view(np.int64)),
                pa.array(np.append(0, re[first]).astype(np.int32)),
                pa.array([whole.serialize().to_pybytes(), *[None] * len(word)], pa.binary()),
            ],
            names=["key", "at", "word", "ending", "slab"],
        )

    for batch in batches:
        for row, data, offsets in chunks(batch.column(2)):
            texts = len(offsets) - 1
            found, text, ending = tokens(lower(data), offsets)
            # Words that are not at hand have a number beyond that of the end token for now.
            number = numbered(found, np.ones(len(found), np.int64), often)
            _, token, of = sequence(number, text, texts, number_of_end)
            rest = np.flatnonzero(token > number_of_end)
            mine = rest - of[rest]  # their places without the end tokens of texts before
            token[rest] = number_of_end
            logs = log_count[token]
            logs[rest] = 0
            met = logs > math.log10(0.5)
            met[rest] = False
            slab.append((
                batch.column(0).slice(row, texts), batch.column(1).slice(row, texts), np.bincount(of, minlength=texts),
                of_word[token].astype(np.uint8), rest + held, found[mine], ending[mine],
                np.bincount(of[met], minlength=texts), np.bincount(of, weights=logs, minlength=texts),
            ))
            held += len(token)
            if held >= CODED:
                yield rows()
                slab, held, key = [], 0, key + 1
    if held:
        yield rows()


def _finished(made: bytes, at: np.ndarray, cls: np.ndarray, count: np.ndarray) -> pa.RecordBatch:
    """Texts of a slab, whose rare words have got their classes and counts."""
    slab = pa.ipc.read_record_batch(pa.py_buffer(made), _SLAB).to_struct_array()[0]
    sizes = slab["sizes"].values.to_numpy()
    starts = np.cumsum(sizes) - sizes  # every text has its end token
    classes = np.frombuffer(slab["classes"].as_py(), np.uint8).copy()
    places, word = slab["places"].values.to_numpy(), slab["at"].values.to_numpy()
    number = np.zeros(len(at) + 1, np.int64)
    number[at] = np.arange(len(at))
    classes[places] = cls[number[word]]
    text = np.searchsorted(starts, places, "right") - 1
    known = slab["known"].values.to_numpy() + np.bincount(text, weights=count[number[word]] > 0, minlength=len(sizes))
    counts = slab["counts"].values.to_numpy() + np.bincount(text, weights=np.log10(count[number[word]] + 0.5), minlength=len(sizes))
    stops = np.append(starts, len(classes)).astype(np.int32)
    return pa.RecordBatch.from_arrays(
        [
            slab["doc_id"].values, slab["training"].values,
            pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(stops), pa.py_buffer(classes)]),
            pa.array(known.astype(np.int64)), pa.array(counts),
        ],
        names=["doc_id", "training", "classes", "known", "counts"],
    )


def _resolved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each text's classes, a byte per token, its known tokens and the sum of its tokens' logarithmic counts.

    Rows are sorted by slab, each slab's own row before its words.
    """
    slab, words_of = None, []

    def finish() -> pa.RecordBatch:
        return _finished(slab, *(np.concatenate([w[i] for w in words_of] or [np.zeros(0, np.int64)]) for i in range(3)))

    for batch in batches:
        at = batch.column(0).to_numpy()
        edges = np.append(np.flatnonzero(at < 0), len(at)).tolist()
        for low, high, new in zip([0, *edges[:-1]], edges, [False] + [True] * (len(edges) - 1)):
            if new:
                if slab is not None:
                    yield finish()
                slab, words_of = batch.column(3)[low].as_py(), []
                low += 1
            words_of.append(tuple(batch.column(i).slice(low, high - low).to_numpy() for i in range(3)))
    if slab is not None:
        yield finish()


def _sequences(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Classes before and of each token, and the token's text."""
    sizes = np.array([len(v.as_py()) for v in column], np.int64)
    token = np.frombuffer(b"".join(v.as_py() for v in column), np.uint8).astype(np.int64)
    return np.append(width - 1, token[:-1]), token, np.repeat(np.arange(len(sizes)), sizes)  # texts end with the end token


def _class_pairs(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """Class bigrams of the texts of one task."""
    pairs = np.zeros(width * width, np.int64)
    for batch in batches:
        before, token, _ = _sequences(batch.column(0), width)
        if len(token):
            pairs += np.bincount(before * width + token, minlength=width * width)
    yield _counts(pairs)


def _scored(batches: Iterator[pa.RecordBatch], log_step: np.ndarray, log_class: np.ndarray, log_base: float) -> Iterator[pa.RecordBatch]:
    width = len(log_class)
    for batch in batches:
        texts = batch.num_rows
        before, token, of = _sequences(batch.column(2), width)
        n = np.bincount(of, minlength=texts)
        others = np.bincount(of, weights=log_step[before, token] - log_class[token], minlength=texts) if len(of) else np.zeros(texts)
        counts = batch.column(4).to_numpy()
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(n.astype(np.int64)), batch.column(3), pa.array(counts - n * log_base), pa.array(counts + others)],
            names=["doc_id", "training", "n_tokens", "n_known", "base_score", "score"],
        )


def score(docs: DataFrame, training: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Id, ``training``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score`` and ``score`` of every row.

    ``training`` tells the rows to learn from.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    rows = docs.select(
        F.col(f"`{id_col}`").cast("long").alias("id_"), F.coalesce(training, F.lit(False)).alias("training_"),
        F.col(f"`{text_col}`").alias("text_"),
    )
    learn = rows.where("training_").select("text_")
    counts = scratch.keep(
        learn.mapInArrow(_counted, "word long, ending long, n long").groupBy("word")
        .agg(F.first("ending").alias("ending"), F.sum("n").alias("n")),
        "counts",
    )
    release(spark)
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    n, v = total["n"], total["v"]
    bucket = F.floor(4 * F.log2("n"))
    some_word = F.col("word").isNotNull() & (F.col("n") >= LEAST)
    sizes = sorted(((r["b"], r["c"]) for r in counts.where(some_word).groupBy(bucket.alias("b")).agg(F.count("*").alias("c")).collect()), reverse=True)

    def bucket_of(most: int) -> int:
        """The least bucket from which on there are at most ``most`` words; a bucket is a quarter of an octave of counts."""
        least, taken = 1 << 20, 0
        for b, c in sizes:  # some hundred buckets at most
            taken += c
            if taken > most:
                break
            least = b
        return least

    in_exchange = F.coalesce((F.col("n") >= LEAST) & (bucket >= bucket_of(EXCHANGED)), F.lit(False))
    top = counts.where(F.col("word").isNotNull() & in_exchange).toPandas() if n else None
    if top is None or not len(top):
        frequent, numbers = np.zeros(0, U64), np.zeros(0, np.int64)
    else:
        frequent = top["word"].to_numpy(np.int64).view(U64)
        order = np.argsort(frequent)
        frequent, numbers = frequent[order], top["n"].to_numpy()[order]
    ends = (counts.where(F.col("word").isNull()).agg(F.sum("n")).first()[0] or 0) if n else 0
    sent = spark.sparkContext.broadcast(frequent)
    pairs = scratch.keep(
        learn.mapInArrow(partial(_paired, frequent=sent), "before int, token int, n long").groupBy("before", "token").agg(F.sum("n").alias("n")),
        "pairs",
    )
    release(spark)
    entry = lambda other, side: F.struct(F.col(other).alias("other"), F.lit(side).alias("side"), F.col("n"))
    near = scratch.keep(
        pairs.select(F.col("before").alias("word"), entry("token", 1).alias("e"))
        .union(pairs.select(F.col("token").alias("word"), entry("before", 0).alias("e")))
        .groupBy("word").agg(F.collect_list("e").alias("near")),
        "near",
    )
    scratch.drop(pairs)
    classes, bigrams = cluster(near, len(frequent), numbers)
    scratch.drop(near)
    width = CLASSES + ENDINGS + 1
    others = counts.where(F.col("word").isNotNull() & ~in_exchange)
    placed = learn.mapInArrow(partial(_placed, frequent=sent, classes=classes), "word long, place int, n long")
    further = others.where(F.col("n") >= LEAST).select("word")
    assigned = (
        placed.repartition("word").groupBy("word", "place").agg(F.sum("n").alias("n"))
        .groupBy("word").agg(F.collect_list(F.struct("place", "n")).alias("near"))
        .join(further, "word", "left_semi")
        .mapInArrow(partial(_assigned, pairs=bigrams), "word long, cls int")
    )
    of_ending = F.col("ending").cast("int") + CLASSES
    known = scratch.keep(
        others.join(assigned, "word", "left").select("word", F.col("n").alias("c"), F.coalesce("cls", of_ending).alias("cls")), "classes"
    )
    release(spark)
    # Tokens and distinct words of each class.
    in_class, distinct = np.zeros(width), np.zeros(width)
    np.add.at(in_class, classes[: len(frequent)], numbers)
    np.add.at(distinct, classes[: len(frequent)], 1)
    for r in known.groupBy("cls").agg(F.sum("c").alias("n"), F.count("*").alias("v")).collect():  # a row per class
        in_class[r["cls"]] += r["n"]
        distinct[r["cls"]] += r["v"]
    in_class[-1], distinct[-1] = ends, 1 if ends else 0
    often = known.where((F.col("c") >= LEAST) & (F.floor(4 * F.log2("c")) >= bucket_of(AT_HAND))).toPandas()
    words_at_hand = np.append(frequent, often["word"].to_numpy(np.int64).view(U64))
    order = np.argsort(words_at_hand)
    hand = (
        words_at_hand[order], np.append(classes[: len(frequent)], often["cls"].to_numpy(np.int64)).astype(np.int32)[order],
        np.log10(np.append(numbers, often["c"].to_numpy(np.int64)) + 0.5)[order],
    )
    coded = scratch.keep(
        rows.mapInArrow(
            partial(_coded, hand=spark.sparkContext.broadcast(hand), end=(width - 1, math.log10(ends + 0.5))),
            "key long, at int, word long, ending int, slab binary",
        ),
        "slabs",
    )
    met = (
        coded.where("at >= 0").select("key", "at", "word", "ending").join(known, "word", "left")
        .select("key", "at", F.coalesce("cls", of_ending).alias("cls"), F.coalesce("c", F.lit(0)).alias("c"), F.lit(None).alias("slab"))
    )
    none = F.lit(None)
    both = coded.where("at < 0").select("key", "at", none.cast("int").alias("cls"), none.cast("long").alias("c"), "slab").union(met)
    resolved = scratch.keep(
        both.repartition("key").sortWithinPartitions("key", "at").select("at", "cls", "c", "slab")
        .mapInArrow(_resolved, "doc_id long, training boolean, classes binary, known long, counts double"),
        "coded",
    )
    scratch.drop(coded, known, counts)
    release(spark)
    bigrams = summed(resolved.where("training").select("classes").mapInArrow(partial(_class_pairs, width=width), "pair int, n long"), width)
    share = (in_class + 0.5) / (n + 0.5 * width)
    log_step = np.log10((bigrams + PRIOR * share) / (bigrams.sum(axis=1, keepdims=True) + PRIOR))
    log_class = np.log10(in_class + 0.5 * (distinct + 1))
    log_base = math.log10(n + 0.5 * (v + 1)) if n + v else math.log10(0.5)
    made = resolved.mapInArrow(
        partial(_scored, log_step=log_step, log_class=log_class, log_base=log_base),
        "doc_id long, training boolean, n_tokens long, n_known long, base_score double, score double",
    )
    return made.select(
        F.col("doc_id").alias(id_col), (~F.col("training")).alias("held_out"), "n_tokens", "n_known",
        F.lit(n).cast("long").alias("train_tokens"), "base_score", "score",
    )
