import hashlib
import math
import re
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cellwarden.functions import vectors
from cellwarden.operators import embedding, similarity
from tests.conftest import rows

SCHEMA = "incident_id string, events_embeddings array<double>"


def random_vectors(n, dim, seed, groups=8):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((groups, dim)) * 3
    return [(f"v{i:04d}", (centres[i % groups] + rng.standard_normal(dim) * 0.4).tolist()) for i in range(n)]


def frame(spark, data):
    return spark.createDataFrame(data, SCHEMA)


def distance(a, b, metric):
    a, b = np.array(a), np.array(b)
    if metric == "euclidean":
        return math.sqrt(((a - b) ** 2).sum())
    return 1 - a @ b / (np.linalg.norm(a) * np.linalg.norm(b))


def brute(base, queries, k, metric="euclidean", exclude_self=False):
    found = {}
    for q, v in queries:
        near = sorted((round(distance(b, v, metric), 9), i) for i, b in base if b and not (exclude_self and i == q))
        found[q] = [(i, d) for d, i in near[:k]]
    return found


def result(df):
    found = {}
    for r in df.orderBy("query_id", "rank").collect():
        found.setdefault(r.query_id, []).append((r.base_id, round(r.distance, 9)))
    return found


@pytest.mark.parametrize("metric", similarity.METRICS)
@pytest.mark.parametrize("exclude_self", [False, True])
@pytest.mark.parametrize("blocks", [False, True])
def test_exact_topk_matches_brute_force(spark, metric, exclude_self, blocks):
    data = random_vectors(120, 6, 1)
    options = {"max_query_numbers": 0, "base_block": 25, "query_block": 30} if blocks else {}
    found = similarity.vector_topk(
        frame(spark, data).repartition(5), frame(spark, data), 4, metric=metric, exclude_self=exclude_self, **options
    )
    assert result(found) == brute(data, data, 4, metric, exclude_self)


@pytest.mark.parametrize("blocks", [False, True])
def test_ties_empty_vectors_and_few_neighbours(spark, blocks):
    options = {"max_query_numbers": 0, "base_block": 2} if blocks else {}
    base = [("b", [0.0, 1.0]), ("a", [0.0, 1.0]), ("c", [0.0, 1.0]), ("empty", []), ("null", None)]
    queries = [("q", [0.0, 1.0]), ("e", [])]
    found = similarity.vector_topk(frame(spark, base).repartition(3), frame(spark, queries), 2, **options)
    assert result(found) == {"q": [("a", 0.0), ("b", 0.0)]}
    many = similarity.vector_topk(frame(spark, base), frame(spark, queries), 9, **options)
    assert [i for i, _ in result(many)["q"]] == ["a", "b", "c"]
    none = similarity.vector_topk(frame(spark, base[3:]), frame(spark, queries), 2, **options)
    assert none.count() == 0
    unasked = similarity.vector_topk(frame(spark, base), frame(spark, queries[1:]), 2, **options)
    assert unasked.count() == 0


def test_long_vectors_close_together(spark):
    """Differences far below the rounding of the matrix product still decide the order."""
    rng = np.random.default_rng(3)
    data = [(f"v{i:02d}", (1e5 + rng.standard_normal(5) * 1e-3).tolist()) for i in range(60)]
    found = similarity.vector_topk(frame(spark, data), frame(spark, data), 3, exclude_self=True)
    assert result(found) == brute(data, data, 3, exclude_self=True)


def test_lsh_recall_and_hot_bucket(spark):
    data = random_vectors(400, 8, 2)
    exact = brute(data, data, 5)
    found = result(similarity.vector_topk(
        frame(spark, data), frame(spark, data), 5, method="lsh", tables=6, width=4.0, base_block=20, query_block=20
    ))
    hits = sum(len({i for i, _ in found.get(q, [])} & {i for i, _ in near}) for q, near in exact.items())
    assert hits / (5 * len(exact)) > 0.95
    # One bucket holds everything when it is wide enough: the blocks must still give all neighbours.
    wide = similarity.vector_topk(
        frame(spark, data), frame(spark, data), 5, method="lsh", tables=1, width=1e6, base_block=50, query_block=70
    )
    assert result(wide) == exact


@pytest.mark.parametrize("width, once", [(4.0, True), (0.3, False)])
def test_lsh_compares_no_pair_more_than_once_when_buckets_are_wide(spark, monkeypatch, width, once):
    data = random_vectors(200, 6, 3)
    groups, plain = [], similarity._block_pairs

    def pairing(base, queries, group, *rest):
        groups.append((group, base.count()))
        return plain(base, queries, group, *rest)

    monkeypatch.setattr(similarity, "_block_pairs", pairing)
    near = similarity.vector_topk(frame(spark, data), frame(spark, data), 3, method="lsh", tables=4, width=width, exclude_self=True)
    assert groups == ([([], 200)] if once else [(["_table", "_bucket"], groups[0][1])])
    directions, offsets = similarity.random_directions(6, 4, width, 7)
    codes = {i: np.floor((np.array(v) @ directions + offsets) / width) for i, v in data}
    sharing = {i: [(j, w) for j, w in data if (codes[i] == codes[j]).any()] for i, _ in data}
    expected = {i: found for i, v in data if (found := brute(sharing[i], [(i, v)], 3, exclude_self=True)[i])}
    assert result(near) == expected


def test_blocks_repeat_vectors_few_times_and_as_they_are(spark, monkeypatch):
    """Half a million vectors of 64 floats: below 20 copies of a row of either side, of 4 bytes a number."""
    rows = 600_000
    blocks = similarity._blocks(spark, rows, 64, None)
    assert blocks <= 10 and rows / blocks * 64 <= similarity.BLOCK_NUMBERS
    floats = frame(spark, [("a", [0.5])]).select("incident_id", F.col("events_embeddings").cast("array<float>"))
    assert similarity._narrow(floats, "incident_id", "events_embeddings").schema["vector"].dataType.elementType.typeName() == "float"


def numbered(n, start=0):
    return np.array([f"v{i:05d}" for i in range(start, start + n)])


def searched(base_ids, base, query_ids, query, k, exclude_self, **options):
    q, b, d = vectors.local_topk(base_ids, base, query_ids, query, k, "euclidean", exclude_self, **options)
    found = [[] for _ in query]
    for place, i, distance in sorted(zip(q.tolist(), base_ids[b].tolist(), np.round(d, 9).tolist()), key=lambda x: (x[0], x[2], x[1])):
        found[place].append((distance, i))
    return found


@pytest.mark.parametrize("kind", ["spread", "grid", "far away", "one long", "repeated ids", "huge"])
@pytest.mark.parametrize("exclude_self", [False, True])
def test_tiles_hold_the_true_nearest(monkeypatch, kind, exclude_self):
    """Every tile, group and precision against all pairs, with and without a cutoff."""
    monkeypatch.setattr(vectors, "TILE_ROWS", 64)
    monkeypatch.setattr(vectors, "TILE_QUERIES", 33)
    monkeypatch.setattr(vectors, "WIDTH", 4)
    rng = np.random.default_rng(11)
    base, ids = rng.standard_normal((300, 5)), rng.permutation(numbered(300))
    if kind in ("grid", "repeated ids"):
        base = base.round()
    if kind == "repeated ids":
        ids = rng.choice(ids, 300)
    if kind == "far away":
        base = 1e5 + base * 1e-3
    if kind == "one long":
        base[7] *= 1e7
    if kind == "huge":
        base *= 1e20
    everything = np.sqrt(((base[:, None, :] - base[None, :, :]) ** 2).sum(axis=2)).round(9)
    middle = float(np.median(everything))
    for options, cutoff in (({}, math.inf), ({"cutoff": middle}, np.round(middle, 9))):
        expected = [
            sorted((d, i) for d, i in zip(row.tolist(), ids.tolist()) if d <= cutoff and not (exclude_self and i == own))[:4]
            for row, own in zip(everything, ids)
        ]
        assert searched(ids, base, ids, base, 4, exclude_self, **options) == expected


@pytest.mark.parametrize("kind", ["spread", "copies"])
def test_few_pairs_are_measured(monkeypatch, kind):
    """Neither rows apart nor equal rows, which all tie, are measured for every query."""
    rng = np.random.default_rng(12)
    base = rng.standard_normal((5000, 16)) if kind == "spread" else np.repeat(rng.standard_normal((2, 16)), 2500, axis=0)
    measured, plain = [], vectors.pair_distances
    monkeypatch.setattr(vectors, "pair_distances", lambda b, q, m: measured.append(len(b)) or plain(b, q, m))
    found = searched(numbered(5000), base, numbered(200), base[:200], 5, True)
    assert all(len(near) == 5 for near in found)
    if kind == "copies":
        assert found[3] == [(0.0, f"v{i:05d}") for i in (0, 1, 2, 4, 5)]
    assert sum(measured) < 20 * 200


@pytest.mark.parametrize("blocks", [False, True])
def test_a_cutoff_in_the_search_gives_what_it_gives_later(spark, blocks):
    options = {"max_query_numbers": 0, "base_block": 25, "query_block": 30} if blocks else {}
    data = [*random_vectors(80, 4, 5), ("same1", [9.0] * 4), ("same2", [9.0] * 4)]
    near = similarity.vector_topk(frame(spark, data), frame(spark, data), 5, exclude_self=True, **options)
    within = similarity.vector_topk(frame(spark, data), frame(spark, data), 5, exclude_self=True, cutoff=0.7, **options)
    expected = rows(similarity.distance_cutoff(near, 0.7), "query_id", "base_id", "distance", "rank")
    assert rows(within, "query_id", "base_id", "distance", "rank") == expected and 0 < len(expected) < near.count()


def test_cutoff_comes_after_topk_and_labels(spark):
    base = frame(spark, [("a", [0.0]), ("b", [0.4]), ("c", [0.5]), ("d", [0.95]), ("e", [2.0])])
    near = similarity.vector_topk(base, frame(spark, [("q", [0.0])]), 4)
    assert rows(similarity.distance_cutoff(near, 0.5), "base_id") == [("a",), ("b",), ("c",)]
    labels = rows(similarity.match_label(near), "base_id", "match")
    assert labels == [("a", "likely match"), ("b", "likely match"), ("c", "likely match"), ("d", "somewhat similar")]
    wider = similarity.distance_cutoff(similarity.vector_topk(base, frame(spark, [("q", [0.0])]), 2), 9.0)
    assert wider.count() == 2


def test_prior_incident_blocks(spark):
    matches = spark.createDataFrame(
        [
            ("q", "p2", 0.25, 2, "likely match", "log 2", "", None, "reset"),
            ("q", "p1", 0.125, 1, "likely match", "log 1", "done", "cable", ""),
        ],
        "query_id string, base_id string, distance double, rank int, match string, events string, "
        "final_analysis string, cause string, resolution string",
    )
    queries = spark.createDataFrame([("q",), ("alone",)], "incident_id string")
    found = {r.incident_id: r for r in similarity.format_prior_incidents(matches, queries).collect()}
    first, second = found["q"].prior_incidents
    assert first == (
        "*Incident p1*\n**Search distance**: 0.125 (likely match)\n**Events**\nlog 1\n**Final analysis**\ndone\n"
        "**Cause**\ncable\n**Resolution**\nNot yet determined\n"
    )
    assert "**Final analysis**\nNot yet determined\n**Cause**\nNot yet determined\n**Resolution**\nreset\n" in second
    assert found["q"].prior_incidents_status == "success"
    assert found["alone"].prior_incidents_status == "no similar incidents found" and found["alone"].prior_incidents == []


def test_hashed_embedding(spark):
    texts = [("a", "Call drop, call DROP 7"), ("b", "..."), ("c", None), ("d", "word " * 3000)]
    df = spark.createDataFrame(texts, "id string, text string")
    found = {r.id: r.embedding for r in embedding.embed_texts(df, "text", 16).collect()}
    assert found["b"] is None and found["c"] is None
    for key, text in (("a", texts[0][1]), ("d", texts[3][1])):
        expected = np.zeros(16)
        for token, n in Counter(re.findall("[a-z0-9]+", text.lower())).items():
            expected[int(hashlib.md5(token.encode()).hexdigest()[:8], 16) % 16] += n
        assert np.allclose(found[key], expected / np.linalg.norm(expected))


def test_external_model(spark):
    def model(batches):
        for batch in batches:
            yield pd.Series([None if t is None else [float(len(t)), 1.0] for t in batch])

    df = spark.createDataFrame([("abc",), (None,)], "text string")
    assert rows(embedding.embed_with_model(df, "text", model), "embedding") == sorted([([3.0, 1.0],), (None,)], key=str)


def test_unsound_vectors_are_absent_and_lengths_are_checked(spark):
    schema = "incident_id string, events_embeddings array<double>"
    inf, nan = float("inf"), float("nan")
    sound = [(f"b{i}", [float(i), 1.0, 0.0]) for i in range(10)]
    unsound = [("n", [nan, 1.0, 0.0]), ("i", [1.0, -inf, 0.0]), ("e", [1.0, None, 0.0]), ("z", None), ("y", []), ("long", [0.0] * 6)]
    base = spark.createDataFrame(sound + unsound, schema)
    asked = spark.createDataFrame([("q", [0.2, 1.0, 0.0]), ("bad", [nan, 0.0, 0.0])], schema)
    for options in ({}, {"max_query_numbers": 0, "base_block": 4, "query_block": 1}):
        found = similarity.vector_topk(base, asked, 5, **options).orderBy("rank").collect()
        assert [(r.query_id, r.base_id) for r in found] == [("q", f"b{i}") for i in range(5)]
    uneven = spark.createDataFrame([("q", [1.0, 2.0]), ("r", [1.0])], schema)
    with pytest.raises(ValueError, match="1 to 2 numbers"):
        similarity.vector_topk(base, uneven)


def test_many_ties_are_measured_in_slices(monkeypatch):
    monkeypatch.setattr(vectors, "PAIR_NUMBERS", 64)
    base, ids = np.ones((5000, 8)), np.arange(5000)[::-1]
    base[17] = 1.5
    q, b, d = vectors.local_topk(ids, base, np.array([1, 2]), np.ones((2, 8)), 4, "euclidean", False)
    assert q.tolist() == [0] * 4 + [1] * 4 and ids[b].tolist() == [0, 1, 2, 3] * 2 and not d.any()
