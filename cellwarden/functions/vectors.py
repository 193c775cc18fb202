"""Block kernel of the vector search, used inside tasks."""

from __future__ import annotations

import math

import numpy as np

METRICS = ("euclidean", "cosine")
DISTANCE_DIGITS = 9
# Scores held at a time (32 MB).
SCORE_CELLS = 4_000_000
# Numbers of pairs measured again at a time (32 MB a side).
PAIR_NUMBERS = 4_000_000
# Base rows and queries of a tile of the euclidean search (4 MB), and rows of which a tile keeps the greatest score.
TILE_ROWS, TILE_QUERIES, WIDTH = 4096, 256, 64
# Pairs left to measure by single precision, for each neighbour sought, beyond which double precision is used.
MANY = 64
# Lengths beyond which single precision has no squares.
LONG = 1e15


def pair_distances(base: np.ndarray, query: np.ndarray, metric: str) -> np.ndarray:
    """Distance of row i of ``base`` to row i of ``query``."""
    if metric == "euclidean":
        return np.sqrt(((base - query) ** 2).sum(axis=1))
    norms = np.linalg.norm(base, axis=1) * np.linalg.norm(query, axis=1)
    with np.errstate(invalid="ignore", divide="ignore"):
        return 1.0 - (base * query).sum(axis=1) / norms


def nearest_first(groups: np.ndarray, distances: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Order by group, distance to nine digits, id: the last bits must not decide ties."""
    return np.lexsort((ids, np.round(distances, DISTANCE_DIGITS), groups))


def _apart(base_buckets: np.ndarray, query_buckets: np.ndarray) -> np.ndarray:
    """Whether a query and a base row share a bucket in none of the hash tables."""
    apart = np.ones((len(query_buckets), len(base_buckets)), dtype=bool)
    for query, base in zip(query_buckets.T, base_buckets.T):
        apart &= query[:, None] != base[None, :]
    return apart


def _nothing() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64), np.empty(0)


def _measured(best, q, b, base_ids, base, query_ids, query, k: int, metric: str, exclude_self: bool, cutoff: float):
    """The k nearest of every query among ``best`` and the pairs (q, b), which are measured by direct difference.

    Any number of rows may tie at the k-th score, so pairs are measured in slices, and after each slice only the k best of every
    query stay.
    """
    step = max(1, PAIR_NUMBERS // max(1, base.shape[1]))
    best_q, best_b, best_d = best
    for start in range(0, len(q), step):
        part_q, part_b = q[start : start + step], b[start : start + step]
        if exclude_self:
            others = query_ids[part_q] != base_ids[part_b]
            part_q, part_b = part_q[others], part_b[others]
        distance = pair_distances(base[part_b], query[part_q], metric)
        if cutoff < math.inf:
            near = np.round(distance, DISTANCE_DIGITS) <= np.round(cutoff, DISTANCE_DIGITS)
            part_q, part_b, distance = part_q[near], part_b[near], distance[near]
        best_q, best_b = np.concatenate([best_q, part_q]), np.concatenate([best_b, part_b])
        best_d = np.concatenate([best_d, distance])
        order = nearest_first(best_q, best_d, base_ids[best_b])
        best_q, best_b, best_d = best_q[order], best_b[order], best_d[order]
        keep = np.arange(len(best_q)) - np.searchsorted(best_q, best_q, side="left") < k
        best_q, best_b, best_d = best_q[keep], best_b[keep], best_d[keep]
    return best_q, best_b, best_d


def _chunk_topk(base_ids, base, query_ids, query, k: int, metric: str, exclude_self: bool, buckets=None, cutoff: float = math.inf):
    rounding = np.full(len(query), 1e-9)
    if metric == "euclidean":
        base_norms, query_norms = (base**2).sum(axis=1), (query**2).sum(axis=1)
        scores = base_norms[None, :] - 2.0 * query @ base.T
        scores += query_norms[:, None]
        rounding += 1e-12 * (base_norms.max(initial=0.0) + query_norms)
    else:
        unit_base = base / np.maximum(np.linalg.norm(base, axis=1, keepdims=True), 1e-300)
        unit_query = query / np.maximum(np.linalg.norm(query, axis=1, keepdims=True), 1e-300)
        scores = 1.0 - unit_query @ unit_base.T
    if exclude_self:
        scores[query_ids[:, None] == base_ids[None, :]] = np.inf
    if buckets is not None:
        scores[_apart(*buckets)] = np.inf
    near = np.isfinite(scores)
    if scores.shape[1] > k:
        # The k-th of every fourth row is a bound of the k-th of all, found in a quarter of the time; a few more are measured.
        some = scores[:, ::4] if scores.shape[1] >= 64 * k else scores
        kth = np.partition(some, k - 1, axis=1)[:, k - 1]
        near &= scores <= (kth + 1e-9 * np.abs(kth) + rounding)[:, None]
    q, b = np.nonzero(near)
    return _measured(_nothing(), q, b, base_ids, base, query_ids, query, k, metric, exclude_self, cutoff)


def _few_copies(base_ids: np.ndarray, base: np.ndarray, most: int) -> np.ndarray:
    """Places of the rows without those that have ``most`` equal rows of smaller ids, which no query needs."""
    content = np.ascontiguousarray(base + 0.0).view(np.dtype((np.void, base.dtype.itemsize * base.shape[1]))).ravel()
    group = np.unique(content, return_inverse=True)[1]
    order = np.lexsort((base_ids, group))
    group = group[order]
    return np.sort(order[np.arange(len(group)) - np.searchsorted(group, group, side="left") < most])


def _near_pairs(base: np.ndarray, lengths: np.ndarray, query: np.ndarray, most: int, cutoff: float, blur: float, limit: float):
    """(q, b) of all pairs that can be among the ``most`` nearest of their query, by scores in the type of ``base``; None if
    more than ``limit`` are left. The last column of ``base`` is less half the squared length of its row.

    A pair's score is half the difference of the query's squared length and the squared distance. The ``most``-th highest of the
    greatest scores of groups of rows is a bound that rises from tile to tile; pairs below it by more than rounding are left out.
    """
    kind = base.dtype
    long = np.sqrt((query**2).sum(axis=1))
    rounding = (query.shape[1] + 8) * float(np.finfo(kind).eps) * (long + lengths.max()) ** 2
    bound = (long**2 - (cutoff + blur) ** 2) / 2.0 - rounding
    columns = np.ascontiguousarray(np.vstack([query.T, np.ones(len(query))]).astype(kind))
    top = np.empty((0, len(query)), dtype=kind)
    rows = min(len(base), TILE_ROWS)
    tile, marks = np.empty((rows, len(query)), dtype=kind), np.empty((rows, len(query)), dtype=bool)
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = [(*_nothing()[:2], np.empty(0, dtype=kind))]
    size = 0
    for start in range(0, len(base), TILE_ROWS):
        rows = min(len(base) - start, TILE_ROWS)
        scores = np.matmul(base[start : start + rows], columns, out=tile[:rows])
        groups = len(scores) // WIDTH
        top = np.concatenate([top, scores[: groups * WIDTH].reshape(WIDTH, groups, -1).max(axis=0) if groups >= most else scores])
        if len(top) >= most:
            top = np.partition(top, len(top) - most, axis=0)[len(top) - most :]
            # At least ``most`` rows are within this distance; equal ones to nine digits may be a little farther.
            within = np.sqrt(np.maximum(long**2 - 2.0 * (top[0] - rounding), 0.0)) + blur
            bound = np.maximum(bound, (long**2 - within**2) / 2.0 - rounding)
        least = np.nextafter(bound.astype(kind), kind.type(-np.inf))
        b, q = np.divmod(np.flatnonzero(np.greater_equal(scores, least, out=marks[:rows])), len(query))
        found.append((q, b + start, scores[b, q]))
        size += len(q)
        if size > limit or start + TILE_ROWS >= len(base):
            q, b, score = (np.concatenate(column) for column in zip(*found))
            near = score >= least[q]
            found = [(q[near], b[near], score[near])]
            size = len(found[0][0])
            if size > limit:
                return None
    return found[0][:2]


def _euclidean_topk(base_ids, base, query_ids, query, k: int, exclude_self: bool, cutoff: float):
    """The k nearest base rows of every query; ids are numbers in the order of the ids.

    Rows are shifted to the middle of the base, which keeps scores in single precision close. Where these leave too many pairs, double
    precision is used.
    """
    rows = np.flatnonzero(np.isfinite((base**2).sum(axis=1)))
    asked = np.flatnonzero(np.isfinite((query**2).sum(axis=1)))
    if k < 1 or not len(rows) or not len(asked):
        return _nothing()
    # A query may meet all rows of its own id among the nearest.
    most = k + int(exclude_self and np.unique(base_ids[rows], return_counts=True)[1].max())
    rows = rows[_few_copies(base_ids[rows], base[rows], most)]
    base_ids, base = base_ids[rows], base[rows]
    middle = base.mean(axis=0)
    doubles = base - middle
    lengths = np.sqrt((doubles**2).sum(axis=1))
    doubles = np.hstack([doubles, -(lengths**2)[:, None] / 2.0])
    singles = doubles.astype(np.float32) if lengths.max() < LONG else None
    far = np.abs(base).max()
    parts = []
    for start in range(0, len(asked), TILE_QUERIES):
        places = asked[start : start + TILE_QUERIES]
        part = query[places]
        shifted = part - middle
        # Distances tie to nine digits, and the shift rounds numbers.
        blur = 2e-9 + 4.0 * float(np.finfo(np.float64).eps) * math.sqrt(base.shape[1]) * max(far, np.abs(part).max())
        pairs = None
        if singles is not None and np.abs(shifted).max() < LONG:
            pairs = _near_pairs(singles, lengths, shifted, most, cutoff, blur, MANY * most * len(part))
        if pairs is None:
            pairs = _near_pairs(doubles, lengths, shifted, most, cutoff, blur, math.inf)
        q, b, d = _measured(_nothing(), *pairs, base_ids, base, query_ids[places], part, k, "euclidean", exclude_self, cutoff)
        parts.append((places[q], rows[b], d))
    return tuple(np.concatenate(column) for column in zip(*parts))


def _numbered(base_ids: np.ndarray, query_ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of base ids in their order, and those of the query ids (-1: no base id)."""
    names, numbers = np.unique(base_ids, return_inverse=True)
    place = np.minimum(np.searchsorted(names, query_ids), len(names) - 1)
    return numbers, np.where(names[place] == query_ids, place, -1)


def local_topk(base_ids, base, query_ids, query, k: int, metric: str, exclude_self: bool, buckets=None, cutoff: float = math.inf):
    """The k nearest rows of one base block for every row of one query block, and none beyond ``cutoff`` (to nine digits).

    The matrix product gives scores that are exact up to rounding; every row within that
    rounding of the k-th score is kept and measured again by direct difference, so the result
    holds the true k nearest. Queries are taken in chunks that bound the score matrix. ``buckets`` (of base rows and of queries,
    a column per hash table) leaves only pairs that share one.
    """
    base_ids, query_ids = _numbered(base_ids, query_ids)
    if metric == "euclidean" and buckets is None:
        return _euclidean_topk(base_ids, base, query_ids, query, k, exclude_self, cutoff)
    if buckets is not None:  # small numbers compare faster
        numbers, codes = np.unique(np.concatenate(buckets), return_inverse=True)
        codes = codes.reshape(-1, buckets[0].shape[1]).astype(np.uint8 if len(numbers) < 256 else np.int32)
        buckets = codes[: len(base)], codes[len(base) :]
    step = max(1, SCORE_CELLS // max(1, len(base)))
    parts = []
    for start in range(0, len(query), step):
        part = slice(start, start + step)
        shared = buckets and (buckets[0], buckets[1][part])
        q, b, d = _chunk_topk(base_ids, base, query_ids[part], query[part], k, metric, exclude_self, shared, cutoff)
        parts.append((q + start, b, d))
    return tuple(np.concatenate(column) for column in zip(*parts))
