"""Text operators against brute force, and on null, empty, long, repeated and clashing rows."""

import itertools
import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from cellwarden.llm import class_lm, mixing, ngram_join, partenum, piece_codec, queries, secrets, token_files, toxicity
from cellwarden.llm.tables import new_path
from cellwarden.llm.textbatch import Memory, chunks, distinct, lower, ragged, words

SF = "/root/testdata/sf0.001"
BPE = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
LONG = " ".join(f"word{i % 977} and{i % 13}" for i in range(20_000))
#: (doc_id, text, score, key_): extra columns are called as internal or result columns are.
ODD = [
    (1, None, "x", 1), (2, "", "x", 2), (3, "one two", "x", 3), (3, "one two", "x", 3), (None, "no id here at all", "x", 4),
    (4, LONG, None, 5), (5, LONG + " end", "x", 6), (6, "Tab\tand\nline   wide ▁ \U0001f600 é", "x", 7),
    (7, "x" * 5000, "x", 8), (8, "one two", "y", None), (9, " \n\t ", "x", 9),
]
SCHEMA = "doc_id long, text string, score string, key_ long"


def documents(spark, rows, schema=SCHEMA):
    return spark.createDataFrame(rows, schema)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}


def split(text):
    return (text or "").encode().lower().split()


# --- helpers


def test_words_are_those_of_split():
    sample = [t for _, t, *_ in ODD] + ["a", "", " a b", "b  a "]
    found = []
    for _, data, offsets in chunks(pa.array(sample), 64):
        data = lower(data)
        h, starts, ends, text = words(data, offsets)
        groups = defaultdict(list)
        for a, b, t in zip(starts, ends, text):
            groups[t].append(data[a:b].tobytes())
        found += [groups[t] for t in range(len(offsets) - 1)]
        assert len(set(h.tolist())) == len({w for g in groups.values() for w in g})
    assert found == [split(t) for t in sample]


def test_memory_returns_what_was_made():
    memory = Memory(np.int32, most=4)
    for keys in ([3, 1], [1, 2, 5], [9, 3], [7]):
        keys = np.array(keys, np.uint64)

        def make(places):
            return keys[places].astype(np.int64), np.repeat(keys[places], keys[places].astype(int)).astype(np.int32)

        starts, sizes, store = memory.lookup(keys, make)
        assert [store[a : a + n].tolist() for a, n in zip(starts, sizes)] == [[int(k)] * int(k) for k in keys]


def test_distinct_and_ragged():
    found, first, number = distinct(np.array([5, 7, 5, 9, 7], np.uint64))
    assert found.tolist() == [5, 7, 9] and first.tolist() == [0, 1, 3] and number.tolist() == [0, 1, 0, 2, 1]
    assert ragged(np.array([4, 0, 9]), np.array([2, 0, 3])).tolist() == [4, 5, 9, 10, 11]


# --- n-gram join


def shingles(text):
    w = split(text)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute_components(rows):
    """rows: list of (id, text); per row (n_shingles, component)."""
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    meet = defaultdict(list)
    for i, s in enumerate(sets):
        for g in s:
            meet[g].append(i)
    shared = Counter(p for g in meet.values() for p in itertools.combinations(g, 2))
    for (a, b), n in shared.items():
        if 100 * n >= 75 * (len(sets[a]) + len(sets[b]) - n):
            root[find(a)] = find(b)
    least = defaultdict(list)
    for i, (key, _) in enumerate(rows):
        least[find(i)].append(key)
    return sorted(
        ((key, len(sets[i]), min((k for k in least[find(i)] if k is not None), default=None)) for i, (key, _) in enumerate(rows)), key=str
    )


def found_components(df):
    return sorted(map(tuple, ngram_join.near_duplicates(df).collect()), key=str)


def test_join_equals_brute_force(docs, texts):
    assert found_components(docs) == brute_components(list(texts.items()))


def test_join_of_odd_rows(spark):
    assert found_components(documents(spark, ODD)) == brute_components([r[:2] for r in ODD])
    assert found_components(documents(spark, [])) == []


def test_join_of_a_large_group_of_near_copies(spark, monkeypatch):
    """Groups beyond the star bound, chains, common passages, and pairs at the bound itself."""
    monkeypatch.setattr(ngram_join, "LARGE", 5)
    monkeypatch.setattr(ngram_join, "BLOCK", 4)
    rng = np.random.default_rng(3)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(60):
        w = list(base)
        for at in rng.choice(60, rng.integers(0, 4), replace=False):
            w[at] = f"v{i}_{at}"
        rows.append((i, " ".join(w)))
    passage = " ".join(f"p{i}" for i in range(40))
    rows += [(100 + i, f"{passage} " + " ".join(f"u{i}_{j}" for j in range(int(rng.integers(3, 60))))) for i in range(60)]
    chain = [f"c{i}" for i in range(120)]
    rows += [(300 + i, " ".join(chain[4 * i : 4 * i + 60])) for i in range(12)]
    rows += [(400 + n, " ".join(f"s{i}" for i in range(n))) for n in range(1, 40)]
    assert found_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)) == brute_components(rows)


def test_similar_sets_share_a_signature():
    rng = np.random.default_rng(1)
    bands = partenum.Bands(3, 4)
    for _ in range(400):
        size = int(rng.integers(1, 90))
        s = set(rng.integers(0, 2**63, size).tolist())
        t = set(s)
        while True:  # change it as far as the bound allows
            u = set(t)
            if rng.random() < 0.5 and len(u) > 1:
                u.pop()
            else:
                u.add(int(rng.integers(0, 2**63)))
            if 4 * len(s & u) < 3 * len(s | u):
                break
            t = u
        pair = [np.array(sorted(x), np.uint64) for x in (s, t)]
        sizes = np.array([len(p) for p in pair])
        often = np.sort(pair[0][rng.random(len(pair[0])) < 0.2])
        sig, owner = partenum.signatures(np.concatenate(pair), np.repeat([0, 1], sizes), sizes, bands, often)
        assert set(sig[owner == 0].tolist()) & set(sig[owner == 1].tolist())


# --- toxicity


def test_toxicity_learns_words_and_their_variants(spark):
    rng = np.random.default_rng(0)
    plain = [f"{a}{b}" for a in ("ren", "tal", "mio", "sar", "vel") for b in ("do", "ki", "rum", "pan")]
    bad = ["gronkle", "blitzert", "snarfik"]
    rows = []
    for i in range(300):
        w = [plain[k] for k in rng.integers(0, len(plain), 30)]
        toxic = i % 3 == 0
        if toxic:
            w[int(rng.integers(0, 30))] = bad[i // 3 % len(bad)]
        rows.append((i, " ".join(w[:15]) + ". " + " ".join(w[15:]), int(toxic)))
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.train(df, F.col("text"), F.col("toxic"), F.col("doc_id"), sample=200, marks=32)
    tries = ["rendo talki gronkle miorum", "rendo g-r-o-n-k-l-e talki", "rendo gron0kle talki miopan", "g r o n k l e rendo",
             "rendo gronkkle", "rendo talki miorum velpan", "", None, "rendo " * 5000, "rendo. " * 3000 + "snarfik", "?!"]
    scores = {r["doc_id"]: r["score"] for r in toxicity.score(spark.createDataFrame(list(enumerate(tries)), "doc_id long, text string"), model).collect()}
    assert [scores[i] >= 0.5 for i in range(len(tries))] == [True] * 5 + [False] * 4 + [True, False]
    odd = toxicity.score(documents(spark, ODD), model).collect()
    assert len(odd) == len(ODD) and all(0 <= r["score"] <= 1 for r in odd)
    assert toxicity.score(documents(spark, []), model).count() == 0
    one_class = toxicity.train(df.where("toxic = 0"), F.col("text"), F.col("toxic"), F.col("doc_id"))
    assert {round(r["score"], 9) for r in toxicity.score(documents(spark, ODD), one_class).collect()} == {0.0}


def test_triple_kernel_equals_its_definition():
    def direct(a, b):
        def parts(w):
            w = "^" + w
            out = Counter()
            for c in itertools.combinations(range(len(w)), 3):
                if c[2] - c[0] < toxicity.SPAN:
                    out["".join(w[i] for i in c)] += toxicity.DECAY ** (c[2] - c[0] + 1)
            return out

        x, y = parts(a), parts(b)
        dot = lambda p, q: sum(p[k] * q[k] for k in p)
        return (dot(x, y) / math.sqrt(dot(x, x) * dot(y, y))) ** toxicity.POWER

    marks = toxicity.Landmarks.of([b"idiot", b"banana"])
    got = marks.kernel(toxicity._CODE[np.frombuffer(b"iddiot", np.uint8)][None, :])[0]
    assert np.allclose(got, [direct("iddiot", "idiot"), direct("iddiot", "banana")], atol=1e-5)


def test_held_out_accuracy(spark):
    found = queries.op1_toxicity(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id")
    held = found.where("held_out").select("predicted", "toxic").collect()
    assert sum(r["predicted"] == r["toxic"] for r in held) >= 0.9 * len(held)


# --- language model


def test_base_score_and_counts(spark, texts):
    found = {r["doc_id"]: r for r in queries.op4_class_lm(spark, SF).collect()}
    tokens = {d: [*split(t), None] for d, t in texts.items()}
    held = {d: zlib.crc32(str(d).encode()) % 5 == 1 for d in texts}
    counts = Counter(w for d, t in tokens.items() if not held[d] for w in t)
    total, distinct_words = sum(counts.values()), len(counts)
    assert found.keys() == texts.keys()
    for d, t in tokens.items():
        r = found[d]
        base = sum(math.log10((counts[w] + 0.5) / (total + 0.5 * (distinct_words + 1))) for w in t)
        assert math.isclose(r["base_score"], base, rel_tol=1e-9)
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[d], len(t), sum(counts[w] > 0 for w in t), total)
    out = [r for r in found.values() if r["held_out"]]
    assert sum(r["score"] for r in out) > sum(r["base_score"] for r in out)  # lower perplexity than the base


def test_model_is_a_probability(spark):
    """Over a small closed world the probabilities of all next tokens, and half a count for the unseen, add up to one."""
    train = [(i, t) for i, t in enumerate(["a b a b c", "b a", "c c a", "a b", ""] * 10)]
    rows = [*train, *[(1000 + i, f"a {w}") for i, w in enumerate("abc")], (1003, "a"), (1004, None), (None, "a b")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r["doc_id"]: r for r in class_lm.score(df, F.col("doc_id") < 1000).collect()}
    assert len(found) == len(rows) and found[1004]["n_tokens"] == 1
    assert all(r["score"] < 0 and r["base_score"] < 0 for r in found.values())
    odd = class_lm.score(documents(spark, ODD), F.col("doc_id") < 6).collect()
    assert len(odd) == len(ODD)
    assert class_lm.score(documents(spark, []), F.lit(True)).count() == 0
    untrained = class_lm.score(documents(spark, ODD), F.lit(False)).collect()
    assert {r["train_tokens"] for r in untrained} == {0} and {r["n_known"] for r in untrained} == {0}


def test_exchange_gain_is_the_change_of_likelihood(monkeypatch):
    monkeypatch.setattr(class_lm, "CLASSES", 4)
    rng = np.random.default_rng(2)
    n, width = 12, 6
    pair = rng.integers(0, 30, (n, n)).astype(float)
    classes = np.append(rng.integers(0, 4, n - 2), [4, 5])

    def bigrams(of):
        out = np.zeros((width, width))
        np.add.at(out, (of[:, None].repeat(n, 1), of[None, :].repeat(n, 0)), pair)
        return out

    base = bigrams(classes)
    for w in range(n - 2):
        after, ahead = np.bincount(classes, pair[w], width), np.bincount(classes, pair[:, w], width)
        to, gain = class_lm.best_class(after, ahead, pair[w, w], classes[w], base, 4)
        values = []
        for c in range(4):
            moved = classes.copy()
            moved[w] = c
            values.append(class_lm.likelihood(bigrams(moved)) - class_lm.likelihood(base))
        assert to == int(np.argmax(values)) and math.isclose(gain, max(values), abs_tol=1e-6)


def test_words_below_the_share_are_clustered_too(spark, monkeypatch):
    """A word outside the exchange gets the class of the words in its place, whatever its ending."""
    monkeypatch.setattr(class_lm, "CLASSES", 4)
    rng = np.random.default_rng(5)
    first, second = [f"a{i}x" for i in range(6)], [f"b{i}y" for i in range(6)]
    lines = [" ".join(w for _ in range(20) for w in (rng.choice(first), rng.choice(second))) for _ in range(200)]
    for i in range(8):  # words of both places, three times each, with one ending
        for _ in range(3):
            lines.append(f"q{i}zz {rng.choice(second)} {rng.choice(first)} r{i}zz")
    rows = [*enumerate(lines), (10_000, "a0x b0y q1zz b1y"), (10_001, "a0x q1zz b0y b1y")]
    monkeypatch.setattr(class_lm, "EXCHANGED", 12)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r["doc_id"]: r for r in class_lm.score(df, F.col("doc_id") < 10_000).collect()}
    for hand, coded in ((20, 50), (0, 1)):  # rare words met by the join, over several slabs
        monkeypatch.setattr(class_lm, "AT_HAND", hand)
        monkeypatch.setattr(class_lm, "CODED", coded)
        again = {r["doc_id"]: r for r in class_lm.score(df, F.col("doc_id") < 10_000).collect()}
        assert found.keys() == again.keys()
        for d, r in found.items():
            assert r["n_known"] == again[d]["n_known"] and math.isclose(r["score"], again[d]["score"], abs_tol=1e-9)
            assert math.isclose(r["base_score"], again[d]["base_score"], abs_tol=1e-9)
    assert found[10_000]["n_known"] == found[10_001]["n_known"] == 5
    # The same words: only the classes tell that a rare word stands for a first word.
    assert found[10_000]["score"] > found[10_001]["score"] + 2


def test_gain_of_a_further_word_is_the_change_of_likelihood():
    rng = np.random.default_rng(3)
    pairs = rng.integers(0, 30, (6, 6)).astype(float)
    after, ahead = rng.integers(0, 3, (2, 5, 6)).astype(float)
    ahead[:, 0] += np.maximum(after.sum(axis=1) - ahead.sum(axis=1), 0)
    after[:, 0] += np.maximum(ahead.sum(axis=1) - after.sum(axis=1), 0)
    found = class_lm.gains(after, ahead, pairs, 4)
    for w in range(5):
        values = []
        for c in range(4):
            more = pairs.copy()
            more[c] += after[w]
            more[:, c] += ahead[w]
            values.append(class_lm.xlogx(more).sum() - class_lm.xlogx(pairs).sum())
            for axis, near in ((0, after[w]), (1, ahead[w])):
                totals = pairs.sum(axis=axis)
                own = totals + np.where(np.arange(6) == c, after[w].sum(), 0)
                values[-1] -= (class_lm.xlogx(own) - class_lm.xlogx(totals)).sum()
        assert np.allclose(found[w], values)


# --- secrets

HEX = "04dbebab91ab85687d33eeaaf9ac699e1188f962"


def test_secrets_are_replaced_and_false_findings_stay(spark):
    filler = "the quick brown fox jumps over the lazy dog and internationalization of characteristics "
    rows = [(i, f'{filler} token = "{HEX[i % 20:] + HEX[: i % 20]}" {filler}' if i % 2 else filler * 2, None) for i in range(60)]
    rows += [(100, f"see sha1 {HEX} in the commit", 7), (101, None, 7), (102, "", 7), (103, f"{filler} secret: {HEX} end", 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_chars long")
    known = secrets.dictionary(df)
    trees = secrets.fit(secrets.labelled_findings(df, known))
    out = {r["doc_id"]: r for r in secrets.redact(df, known, trees).collect()}
    assert len(out) == len(rows)
    for i, text, _ in rows:
        if i < 100:
            assert ("[SECRET]" in out[i]["text"]) == (i % 2 == 1) and HEX not in out[i]["text"]
    assert out[1]["text"].startswith(filler) and out[1]["text"].endswith(filler) and out[1]["n_chars"] == len(out[1]["text"])
    assert out[101]["text"] is None and out[102]["text"] == "" and out[0]["n_chars"] is None
    assert "[SECRET]" in out[103]["text"] and "internationalization" in out[103]["text"]
    found = secrets.find(df, known, trees).where("doc_id = 1 and probability >= 0.5").collect()
    assert [rows[1][1][r["start"] : r["end"]] for r in found] == [r["value"] for r in found] != []
    assert secrets.find(documents(spark, ODD), known, trees).where("probability >= 0.5").count() == 0
    assert secrets.redact(documents(spark, ODD), known, trees).count() == len(ODD)
    none = documents(spark, [])
    nothing = secrets.fit(secrets.labelled_findings(none, secrets.dictionary(none)))
    assert secrets.probability(np.zeros((2, len(secrets.FEATURES))), nothing).tolist() == [0, 0]


# --- piece codec


def test_viterbi_equals_brute_force_and_round_trips(spark, texts):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    score = {
        model.id_to_piece(i): (model.get_score(i), i)
        for i in range(model.vocab_size())
        if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))
    }
    unknown = min(s for s, _ in score.values()) - 10

    def best(text):
        text = "▁" + text.replace(" ", "▁")
        paths = [(0.0, [])] + [None] * len(text)
        for end in range(1, len(text) + 1):
            options = []
            for start in range(max(0, end - 16), end):
                piece = text[start:end]
                if piece in score:
                    s, i = score[piece]
                    options.append((paths[start][0] + s, -start, paths[start][1] + [i]))
                elif end - start == 1:
                    options.append((paths[start][0] + unknown, -start, paths[start][1] + [3 + b for b in piece.encode()]))
            top = max(options, key=lambda o: (o[0], o[1]))
            paths[end] = (top[0], top[2])
        return paths[-1][1]

    some = ["hello world", "a  b", "été 你好 \U0001f600", "", "x" * 70, *(t[:200] for t in list(texts.values())[:20])]
    df = spark.createDataFrame(list(enumerate(some)), "doc_id long, text string")
    got = {r["doc_id"]: r["ids"] for r in piece_codec.encode_texts(df, PIECES).collect()}
    for i, t in enumerate(some):
        assert got[i] == (best(t) if t else []), t
    rows = documents(spark, ODD)
    back = piece_codec.round_trip(rows, PIECES).collect()
    assert len(back) == len(ODD) and all(r["restored"] for r in back)
    again = piece_codec.decode_ids(piece_codec.encode_texts(rows, PIECES), PIECES).collect()
    assert Counter(r["decoded"] for r in again) == Counter(t or "" for _, t, *_ in ODD)
    assert piece_codec.round_trip(documents(spark, []), PIECES).count() == 0


def test_round_trip_of_all_documents(spark, texts):
    assert queries.op6_sentencepiece(spark, SF).where("restored").count() == len(texts)


# --- mixing


@pytest.mark.parametrize("weights", [{0: 1}, {0: 3, 1: 2, 2: 7}, {0: 5, 1: 5}, {0: 1, 1: 97, 2: 2}])
def test_pfair_lag_stays_below_one_block(weights):
    taken, total = mixing.period(weights), sum(weights.values())
    assert sorted(itertools.chain(*taken.values())) == list(range(total))
    for c, w in weights.items():
        for t in range(total + 1):
            assert abs(sum(s < t for s in taken[c]) - w * t / total) < 1


def test_phases_use_every_block_once():
    weights, blocks = {0: 6, 1: 3, 2: 1, 3: 2}, {0: 50, 1: 7, 2: 30, 3: 0}
    plan, last = mixing.phases(weights, blocks)
    slots = []
    for c, parts in plan.items():
        for first, end, begin, period, taken in parts:
            own = [begin + k // len(taken) * period + taken[k % len(taken)] for k in range(end - first)]
            slots += own
        assert parts[-1][1] == blocks[c] and own[-1] == last[c]
    assert sorted(slots) == list(range(sum(blocks.values())))


def test_mixture_keeps_rows_and_blocks(spark):
    rows = [(i, "abc"[i % 3] if i % 7 else None, str(i), i) for i in range(500)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string, position long")
    mixed = mixing.mix(df, {"a": 3, "b": 1}, block=8, other_weight=2)
    assert mixed.columns == ["doc_id", "source", "text", "position", "block", "slot", "position_"]
    got = sorted(mixed.collect(), key=lambda r: r["position_"])
    assert [r["position_"] for r in got] == list(range(500)) and {r["position"] for r in got} == set(range(500))
    slots = defaultdict(set)
    for r in got:
        slots[r["slot"]].add(r["source"] if r["source"] in ("a", "b") else "other")
    assert all(len(s) == 1 for s in slots.values()) and [r["slot"] for r in got] == sorted(r["slot"] for r in got)
    ordered = mixing.in_order(mixed, "position_").collect()
    assert [r["position_"] for r in ordered] == list(range(500))
    odd = spark.createDataFrame([(None, None, None)] * 3 + [(1, "a", "x")] * 2, "doc_id long, source string, text string")
    assert sorted(r["position"] for r in mixing.mix(odd, {"a": 1}, block=2).collect()) == [0, 1, 2, 3, 4]
    assert mixing.mix(odd.where("false"), {"a": 1}).count() == 0


# --- token files


def test_token_files_hold_the_ids_of_the_library(spark):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(BPE)
    tokenizer.encode_special_tokens = True
    odd = ["don't I'll 'twas a'b 'S", "a b \u0085c", "1,234.5 x2 3y", "×÷ łń é", "  lead", "trail  ", "\n\n a\r\nb", "<|endoftext|>",
           "١٢ ² ʰa", "\x00\x1c\x7f a\x1fb"]
    rows = [(i, t) for i, t, *_ in ODD] + [(100 + i, t) for i, t in enumerate(odd)]
    path = new_path(spark, "test-tokens")
    token_files.write_tokens(spark.createDataFrame(rows, "doc_id long, text string"), path, BPE, 2)
    got = sorted(token_files.read_tokens(spark, path).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in got] == sorted((r[0] for r in rows), key=lambda d: -1 if d is None else d)
    want = defaultdict(list)
    for d, t in rows:
        want[d].append(tokenizer.encode(t or "", add_special_tokens=False).ids + [2])
    start = 0
    for r in got:
        assert r["ids"] in want[r["doc_id"]] and r["start"] == start and r["n_tokens"] == len(r["ids"])
        start += r["n_tokens"]
    few = token_files.read_tokens(spark, path, [103]).collect()
    assert [r["ids"] for r in few] == want[103]
    empty = new_path(spark, "test-no-tokens")
    token_files.write_tokens(documents(spark, []), empty, BPE, 2)
    assert token_files.digests(token_files.read_tokens(spark, empty)).count() == 0


def test_token_digests(spark, texts):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(BPE)
    found = {r["doc_id"]: r for r in queries.op8_token_files(spark, SF).collect()}
    start = 0
    for d in sorted(texts):
        ids = np.array(tokenizer.encode(texts[d] or "", add_special_tokens=False).ids + [2], "<u4")
        r = found[d]
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


def test_token_query_matches_added_tokens_as_the_library(spark, tmp_path):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(BPE)
    end = "<|endoftext|>"
    rows = [(1, f"a {end} b"), (2, f"{end}{end}"), (3, f"it's {end}'s  {end}  \n{end}"), (4, "<|endoftext|"), (5, ">" + LONG), (6, f"é{end}١x")]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    found = {r["doc_id"]: r for r in queries.op8_token_files(spark, str(tmp_path)).collect()}
    start = 0
    for d, t in rows:
        ids = np.array(tokenizer.encode(t, add_special_tokens=False).ids + [2], "<u4")
        assert (found[d]["start"], found[d]["n_tokens"], found[d]["ids_crc32"]) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


def test_added_tokens_of_all_kinds_are_matched_as_by_the_library(tmp_path):
    from tokenizers import AddedToken, Tokenizer

    for n, more in enumerate([[AddedToken("foo", normalized=False), AddedToken("foobar", normalized=False)], [AddedToken("foo", single_word=True, lstrip=True)]]):
        tokenizer = Tokenizer.from_file(BPE)
        tokenizer.add_tokens(more)
        tokenizer.save(f"{tmp_path}/{n}.json")
        sample = ["a foo b", "foobarfoo", "fo", "o foox", "xfoo", "bar foob", "", "a  foo<|endoftext|> é"]
        batch = pa.RecordBatch.from_arrays([pa.array(range(len(sample))), pa.array(sample)], names=["doc_id", "text"])
        for special in (True, False):
            tokenizer.encode_special_tokens = not special
            got = next(token_files.encode(iter([batch]), f"{tmp_path}/{n}.json", 2, special)).column(3).to_pylist()
            assert got == [tokenizer.encode(t, add_special_tokens=False).ids + [2] for t in sample]
