"""Vector operators against brute force, and on null, odd and repeated vectors."""

import math
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from cellwarden.llm import block_topk, metric_join

INF, NAN = math.inf, math.nan
SCHEMA = "vec_id long, embedding array<float>, label int, rank int, raw string"
ODD = [
    (0, [1.0, 0.0, 0.0], 1), (50, [1.0, 0.1, 0.0], 1), (100, None, 1), (150, [], 1), (200, [0.0, 0.0, 0.0], 1),
    (250, [NAN, 1.0, 0.0], 1), (300, [INF, 1.0, 0.0], 1), (350, [1.0, None, 0.0], 1), (1, [1.0, 0.0, 0.0], 1), (1, [1.0, 0.0, 0.0], 1),
    (2, [2.0, 0.0, 0.0], 2), (3, [2.0, 0.0, 0.0], None), (4, [1.0, 0.0], 1), (400, [1.0, 0.01], 1), (5, [-1.0, 0.0, 0.0], 1),
    (None, [1.0, 0.0, 0.0], 1), (450, [3.0, 0.0, 0.0], 2),
]


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA)


def usable(v):
    return bool(v) and all(x is not None and math.isfinite(x) for x in v)


def as_float(v):
    return [float(np.float32(x)) for x in v]


def brute_topk(rows, k, every):
    rows = [(i, [math.floor(256 * x) for x in as_float(v)]) for i, v, *_ in rows if i is not None and usable(v)]
    out = []
    for q, v in rows:
        if q % every == 0:
            scores = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in rows if i != q and len(w) == len(v))
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scores[:k])]
    return sorted(out)


def brute_links(rows, bound):
    def linked(a, b):
        (_, v, s), (_, w, t) = a, b
        if s is None or s != t or not usable(v) or not usable(w) or len(v) != len(w) or not any(v) or not any(w):
            return False
        v, w = as_float(v), as_float(w)
        return sum(x * y for x, y in zip(v, w)) / math.sqrt(sum(x * x for x in v) * sum(y * y for y in w)) >= bound

    near = defaultdict(set)
    for i, a in enumerate(rows):
        for j, b in enumerate(rows):
            if i != j and linked(a, b):
                near[i].add(j)
    out = []
    for i, r in enumerate(rows):
        seen, todo = {i}, [i]
        while todo:
            for j in near[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        component = min((rows[j][0] for j in seen if rows[j][0] is not None), default=None)
        out.append((r[0], len(near[i]), component, r[0] is not None and r[0] == component))
    return sorted(out, key=str)


def clustered(n, dims, centres, seed):
    """Vectors around few centres, a third of them around one, with equal vectors and equal scores among them."""
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(centres, dims))
    which = np.where(rng.random(n) < 0.33, 0, rng.integers(0, centres, n))
    x = middle[which] + rng.normal(size=(n, dims)) * rng.choice([0.05, 0.2, 0.5], (n, 1))
    x[rng.integers(0, n, n // 10)] = x[0]
    return [(int(i), [float(c) for c in v], int(which[i] % 3)) for i, v in enumerate(x)]


def test_search_of_odd_vectors(spark):
    assert sorted(map(tuple, block_topk.top_k(frame(spark, ODD), k=3).collect())) == brute_topk(ODD, 3, 50)
    assert block_topk.top_k(frame(spark, [])).count() == 0


@pytest.mark.parametrize("k", [1, 5])
def test_search_equals_brute_force(spark, monkeypatch, k):
    monkeypatch.setattr(block_topk, "BLOCK", 16)
    monkeypatch.setattr(block_topk, "QUERY_WEIGHTS", 200)  # several groups of queries
    rows = clustered(600, 8, 12, 4)
    found = block_topk.top_k(frame(spark, rows).repartition(5), k=k, every=20)
    assert sorted(map(tuple, found.collect())) == brute_topk(rows, k, 20)


def test_bounds_hold_and_large_weights_are_exact():
    rng = np.random.default_rng(1)
    q, x = rng.integers(-300, 300, (20, 6)), rng.integers(-300, 300, (40, 6))
    top = block_topk.bounds(q, x.min(axis=0)[None], x.max(axis=0)[None])
    assert (top[:, 0] >= block_topk.dot(q, x).max(axis=1)).all()
    big = np.array([[1 << 31, 1]])
    assert block_topk.dot(big, big)[0, 0] == (1 << 62) + 1


def test_rows_that_repeat_a_query_id_have_rankings_of_their_own(spark):
    rows = [(50, [1.0, 0.0], 1), (50, [0.0, 1.0], 1), (1, [1.0, 0.5], 1), (2, [0.25, 1.0], 1)]
    found = sorted(map(tuple, block_topk.top_k(frame(spark, rows), k=2).collect()))
    one = 256 * 256
    assert found == sorted([(50, 1, 1, one), (50, 2, 2, one // 4), (50, 1, 2, one), (50, 2, 1, one // 2)])


def test_very_large_components_are_held(spark):
    rows = [(50, [1e17, 0.0], 1), (1, [1e17, 1.0], 1), (2, [-3e38, 0.0], 1), (3, [2e16, 0.0], 1), (4, [0.0, 5.0], 1)]
    found = sorted(map(tuple, block_topk.top_k(frame(spark, rows), k=4).collect()))
    assert found == [(50, 1, 1, block_topk.HIGHEST), (50, 2, 3, block_topk.HIGHEST), (50, 3, 4, 0), (50, 4, 2, block_topk.LOWEST)]
    low, high = np.array([[-(1 << 62), -(1 << 62)]]), np.array([[1 << 62, 1 << 62]])
    assert block_topk.bounds(np.array([[1 << 62, 1]]), low, high)[0, 0] == block_topk.HIGHEST


def test_bounds_leave_most_blocks_of_clustered_vectors_unscored():
    rng = np.random.default_rng(3)
    middle = rng.normal(size=(40, 16))
    x = np.floor(256 * (middle[np.repeat(np.arange(40), 64)] + 0.05 * rng.normal(size=(2560, 16)))).astype(np.int64)
    blocks = x.reshape(10, 256, 16)
    top = block_topk.bounds(x[::50], blocks.min(axis=1), blocks.max(axis=1))
    kth = np.sort(block_topk.dot(x[::50], x), axis=1)[:, -6]
    assert (top >= kth[:, None]).mean() < 0.5


def test_cells_of_clustered_vectors_get_few_guests(spark):
    """Fewer than half the (vector, cell) pairs, and all links, where vectors lie around many centres."""
    rng = np.random.default_rng(8)
    middle = rng.normal(size=(30, 24))
    x = middle[rng.integers(0, 30, 1500)] + 0.03 * rng.normal(size=(1500, 24))
    pivots = metric_join._unit([v.tobytes() for v in x[::50]])

    class Sent:
        value = {(1, 24 * 8): pivots}

    batch = pa.RecordBatch.from_pydict({"label": [1] * len(x), "raw": [v.tobytes() for v in x]})
    cells = next(metric_join._reach(iter([batch]), Sent, math.sqrt(1 - 0.93**2))).column("cells").to_pylist()
    assert sum(map(len, cells)) < 0.5 * len(x) * len(pivots)
    rows = [(i, v.tolist(), 1) for i, v in enumerate(x[:300])]
    assert sorted(map(tuple, metric_join.near_vectors(frame(spark, rows), 0.93, cell=20).collect()), key=str) == brute_links(rows, 0.93)


def test_links_of_odd_vectors(spark):
    assert sorted(map(tuple, metric_join.near_vectors(frame(spark, ODD)).collect()), key=str) == brute_links(ODD, 0.93)
    assert metric_join.near_vectors(frame(spark, [])).count() == 0


@pytest.mark.parametrize("cell", [8, 40, 4096])
def test_links_equal_brute_force(spark, cell):
    """Many pivots, sub-cells (pivots rarer than home vectors allow) and a single cell give the same links."""
    rows = clustered(400, 8, 10, 9)
    found = metric_join.near_vectors(frame(spark, rows).repartition(4), 0.93, cell=cell)
    assert sorted(map(tuple, found.collect()), key=str) == brute_links(rows, 0.93)


def test_sub_cells_give_the_same_links(spark, monkeypatch):
    monkeypatch.setattr(metric_join, "MOST_PIVOTS", 2)
    rows = clustered(300, 8, 6, 5)
    assert sorted(map(tuple, metric_join.near_vectors(frame(spark, rows), 0.93, cell=10).collect()), key=str) == brute_links(rows, 0.93)


def test_pairs_at_the_bound(spark):
    turn = math.acos(0.93)
    rows = [(0, [1.0, 0.0], 0), (1, [math.cos(turn - 1e-6), math.sin(turn - 1e-6)], 0), (2, [math.cos(turn + 1e-6), -math.sin(turn + 1e-6)], 0)]
    assert sorted(map(tuple, metric_join.near_vectors(frame(spark, rows)).collect()), key=str) == brute_links(rows, 0.93)
