"""Results that must not depend on partitions, and rows that share an id."""

import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from cellwarden.llm import mixing, queries, secrets, tables, token_files, toxicity

SF = "/root/testdata/sf0.001"


@pytest.fixture
def shuffle(spark):
    def set_to(parts):
        spark.conf.set("spark.sql.shuffle.partitions", parts)

    yield set_to
    spark.conf.set("spark.sql.shuffle.partitions", 8)


def test_toxicity_does_not_depend_on_the_partitions(spark, shuffle):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    seen = []
    for parts in (1, 4, 11):
        shuffle(parts)
        model = queries.toxicity_model(docs.repartition(parts), labels.repartition(parts))
        seen.append({r["doc_id"]: r["score"] for r in toxicity.score(docs.repartition(parts), model).collect()})
    first = np.array([seen[0][d] for d in sorted(seen[0])])
    for other in seen[1:]:
        scores = np.array([other[d] for d in sorted(other)])
        assert np.abs(first - scores).max() < 1e-5 and ((first >= 0.5) == (scores >= 0.5)).all()


def test_a_bounded_number_of_sentences_trains(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    rows = docs.join(labels, "doc_id")
    model = toxicity.train(rows, F.col("text"), F.col("toxic"), F.col("doc_id"), sentences=2000)
    assert toxicity.score(docs, model).where("score between 0 and 1").count() == docs.count()


def test_near_duplicates_of_different_texts_under_one_id(spark):
    words = [f"w{i}" for i in range(60)]
    a, near = " ".join(words), " ".join([*words[:-1], "end"])
    b = " ".join(f"b{i}" for i in range(40))
    rows = [(3, a), (5, near), (5, b), (7, b), (None, near), (9, b + " more"), (9, "alone with its own few words here")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = corpus_pipeline.drop_near_duplicates(spark, docs, SF)
    assert sorted(map(tuple, kept.collect())) == [(3, a), (5, b), (9, "alone with its own few words here")]


def test_token_files_of_one_id_are_written_by_several_tasks(spark):
    """One id for all rows: their order is that of the texts' hashes, and no task gets them all."""
    path = tables.new_path(spark, "tokens")
    docs = spark.read.parquet(f"{SF}/documents.parquet").select(F.lit(7).alias("doc_id"), "text")
    token_files.write_tokens(docs, path, public_tokenizers.path("byte_bpe_50k.json"), queries.END_ID, special=True)
    files = spark.read.orc(path).groupBy(F.col("_metadata.file_name")).count().collect()
    assert len(files) > 3
    found = token_files.digests(token_files.read_tokens(spark, path)).orderBy("start").collect()
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = [r["text"] for r in docs.orderBy(F.xxhash64("text"), "text").select("text").collect()]
    start = 0
    for row, made in zip(found, plain.encode_batch(texts, add_special_tokens=False)):
        ids = np.array([*made.ids, queries.END_ID], "<u4")
        assert (row["start"], row["n_tokens"], row["ids_crc32"]) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


# --- secrets: candidates of any length and signs


def brute_values(text):
    """Assigned values and passwords of one text, by a plain pattern over the whole of it."""
    raw, out, last = text.encode(), [], 0
    spans = [m.span(m.lastindex) for p in (secrets._VALUE, secrets._ADDRESS) for m in p.finditer(raw)]
    for a, b in sorted(spans):
        if a >= last:
            out.append(raw[a:b].decode())
            last = b
    return out


PASSWORDS = {
    'password = "Tr0ub4dor&3"': "Tr0ub4dor&3", "pwd: s3cr3t!": "s3cr3t!", "see postgres://admin:hunter2@db/x now": "hunter2",
    "api_key='Zx9$kd.. 81+q=pL0;mn#26ab'": "Zx9$kd.. 81+q=pL0;mn#26ab", "SECRET_TOKEN=>abc123é, more": "abc123é",
    '{"access_token": "a1 b2"}': "a1 b2", "auth:x7": "x7", "no value: here": None, "password": None, "pwd:": None, "key = ": None,
}


def test_values_assigned_to_secret_names_are_candidates():
    texts = list(PASSWORDS) * 3
    raw = "".join(texts).encode()  # no sign parts one text from the next
    offsets = np.append(0, np.cumsum([len(t.encode()) for t in texts]))
    found = {}
    for a, b, _ in secrets.named_values(raw, offsets):
        t = int(np.searchsorted(offsets, a, "right")) - 1
        assert b <= offsets[t + 1]
        found.setdefault(t, []).append(raw[a:b].decode())
    for t, text in enumerate(texts):
        assert found.get(t, []) == brute_values(text) == ([PASSWORDS[text]] if PASSWORDS[text] else [])


def test_passwords_are_redacted_and_clean_texts_stay(spark):
    filler = "The quick brown fox jumps over the lazy dog near internationalization characteristics. "
    hexes = "04dbebab91ab85687d33eeaaf9ac699e1188f962"
    rows = [(i, f'{filler} token = "{hexes[i % 20:] + hexes[: i % 20]}" {filler}' if i % 2 else filler * 2) for i in range(60)]
    rows += [(100 + i, f"{filler}{t} {filler}") for i, t in enumerate(PASSWORDS)]
    rows += [(200, filler + "the key: value of the fox and the access: 24 hours"), (201, f"commit {hexes} of the fox")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    known = secrets.dictionary(docs)
    trees = secrets.fit(secrets.labelled_findings(docs, known))
    out = {r["doc_id"]: r["text"] for r in secrets.redact(docs, known, trees).collect()}
    for i, (text, value) in enumerate(PASSWORDS.items()):
        if value:
            assert value not in out[100 + i] and "[SECRET]" in out[100 + i], text
        else:
            assert out[100 + i] == dict(rows)[100 + i]
    assert all(out[i] == t for i, t in rows if i < 60 and not i % 2) and "the key: value of the fox" in out[200]


def test_a_corpus_with_one_class_keeps_what_is_not_clear(spark):
    hexes = "04dbebab91ab85687d33eeaaf9ac699e1188f962"
    rows = [(1, f"see {hexes} there"), (2, "path/to/a1/very/long/name/of/files")]
    for more in ([], [(3, "pwd: s3cr3t!")], [(3, "internationalizationcharacteristics")]):
        docs = spark.createDataFrame(rows + more, "doc_id long, text string")
        known = secrets.dictionary(docs)
        out = dict(map(tuple, secrets.redact(docs, known, secrets.fit(secrets.labelled_findings(docs, known))).collect()))
        assert out[1] == rows[0][1] and out[2] == rows[1][1]
        assert out.get(3) in (None, "pwd: [SECRET]", "internationalizationcharacteristics")


def test_dictionary_does_not_depend_on_the_partitions(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    seen = [secrets.dictionary(docs.repartition(n)) for n in (1, 5)]
    assert (seen[0] == seen[1]).all() and seen[0].sum() > 100


# --- mixing: every source its own share


@pytest.mark.parametrize("own_classes", [256, 3])
def test_every_source_deviates_by_less_than_one_block(spark, own_classes):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "source", "text")
    weights = queries.SOURCE_WEIGHTS
    mixed = mixing.mix(docs, weights, block=4, other_weight=8, own_classes=own_classes).select("source", "slot").distinct().collect()
    sources = {r["source"] for r in mixed} - set(weights)
    assert len(sources) > 3
    name = lambda s: s if s in weights or own_classes > 3 else "all others"
    slots = {}
    for r in mixed:
        slots.setdefault(r["slot"], set()).add(name(r["source"]))
    assert all(len(s) == 1 for s in slots.values()) and sorted(slots) == list(range(len(slots)))
    total = sum(weights.values()) + 8
    share = {s: w / total for s, w in weights.items()}
    share |= {s: 8 / total / len(sources) for s in sources} if own_classes > 3 else {"all others": 8 / total}
    order = [next(iter(slots[t])) for t in range(len(slots))]
    last = min(max(t for t, s in enumerate(order) if s == name) for name in share)  # until the first source is used up
    taken = dict.fromkeys(share, 0)
    for t in range(last + 1):
        taken[order[t]] += 1
        for s, w in share.items():
            assert abs(taken[s] - w * (t + 1)) < 1 + 1e-9
    assert last > 20


def test_the_machine_fitted_in_parts_meets_its_optimum(spark):
    """The gradient of the squared hinge with ridge, summed plainly over all sentences, vanishes; equal keys stay one text."""
    rng = np.random.default_rng(5)
    sums = rng.normal(size=(600, 6)).astype(np.float16)
    toxic = (sums[:, 0] + rng.normal(size=600) > 0.8).astype(int)
    key = np.array([f"k{t}-{i // 5}" for i, t in enumerate(toxic)])
    rows = [(int(zlib.crc32(k.encode()) % 7), k, int(t), s.tobytes()) for k, t, s in zip(key, toxic, sums)]
    made = spark.createDataFrame(rows, "part long, key string, toxic long, sums binary")
    made = made.repartition(3, "part").sortWithinPartitions("part", "key", "sums")
    root = spark.sparkContext.broadcast(np.eye(6, dtype=np.float32))
    w, clear = toxicity.fit_linear(made, root, np.zeros(7), balance=0.25)
    x, y = np.hstack([sums.astype(float), np.ones((600, 1))]), np.where(toxic == 1, 1.0, -1.0)
    each = {k: (key == k).sum() for k in key}
    cost = np.where(toxic == 1, [1 / each[k] for k in key], 0.25)

    def slope(w, cost):
        ridge = np.append(np.ones(6), 1e-6) * w
        return ridge - x.T @ (cost * y * np.maximum(0, 1 - y * (x @ w)))

    assert np.abs(slope(w, cost)).max() < 1e-4
    assert abs(clear - (x @ w)[toxic == 0].max()) < 1e-4
    again, _ = toxicity.fit_linear(made, root, w, earlier=(w, clear))
    margin = x @ w
    best = {k: margin[key == k].max() for k in key}
    example = (toxic == 0) | (margin > clear) | np.isclose(margin, [best[k] for k in key], atol=1e-6)
    assert np.abs(slope(again, example.astype(float))).max() < 1e-4
