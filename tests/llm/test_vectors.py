from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from helpers import by_id
from ledgerloom.llm import embedding_dedup, topk_search

SCHEMA = "vec_id long, embedding array<float>, label int, v long, rid long, block int, bucket long, score long"
BAD = [None, [], [1.0, None], [math.nan, 1.0], [math.inf, 1.0]]


def vectors(spark, rows, schema=SCHEMA):
    return spark.createDataFrame([(k, None if v is None else [x if x is None else float(x) for x in v], 0, 1, 1, 1, 1, 1) for k, v in rows], schema)


def plain_topk(rows, k, every):
    use = [(n, i, [math.floor(256 * float(np.float32(x))) for x in v]) for n, (i, v) in enumerate(rows) if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    found = []
    for n, q, a in use:
        if q % every == 0:
            scores = sorted((-sum(x * y for x, y in zip(a, b, strict=False)), i, m) for m, i, b in use if m != n)
            found += [(q, rank + 1, i, -s) for rank, (s, i, _) in enumerate(scores[:k])]
    return sorted(found)


@pytest.mark.parametrize("block", [topk_search.BLOCK, 7])
def test_topk_matches_all_scores(spark, block):
    rng = np.random.default_rng(1)
    rows = [(int(i), rng.integers(-3, 4, rng.integers(1, 9)).tolist()) for i in range(60)]
    rows += [(5, [1, 1]), (50, rows[50][1]), (50, rows[50][1]), (None, [9, 9]), *((100 + k, v) for k, v in enumerate(BAD))]
    found = topk_search.search(vectors(spark, rows), F.col("vec_id") % 50 == 0, block=block).collect()
    assert by_id(found, "query_id", "rank", "vec_id", "score") == sorted(plain_topk(rows, 5, 50), key=repr)


def test_topk_small_and_large(spark):
    few = vectors(spark, [(0, [1.0]), (1, [2.0])])
    assert by_id(topk_search.search(few, F.col("vec_id") == 0).collect(), "rank", "vec_id", "score") == [(1, 1, 131072)]
    assert topk_search.search(few.where("vec_id = 0"), F.lit(True)).count() == 0
    assert topk_search.search(few.limit(0), F.lit(True)).count() == 0
    big = spark.createDataFrame([(k, [1e15 * (k + 1)] * 3) for k in range(4)], "vec_id long, embedding array<double>")
    top = topk_search.search(big, F.col("vec_id") == 0).orderBy("rank").collect()
    assert [r["score"] for r in top] == [2**63 - 1] * 3
    assert [r["vec_id"] for r in top] == [1, 2, 3]


def test_select_takes_ties_in_order():
    scores = np.array([5, 9, 5, 5, 9, 1])
    assert topk_search.select(scores, 3, None).tolist() == [1, 4, 0]
    assert topk_search.select(scores, 3, 1).tolist() == [4, 0, 2]


def plain_links(rows, threshold=0.9):
    """links, component and kept of each row, by comparing all."""
    unit = []
    for i, v in rows:
        ok = i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)
        x = np.array(v, np.float32).astype(float) if ok else None
        unit.append(x / np.linalg.norm(x) if ok else None)
    root = list(range(len(rows)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    n = [0] * len(rows)
    for a in range(len(rows)):
        for b in range(a):
            if unit[a] is not None and unit[b] is not None and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= threshold:
                n[a] += 1
                n[b] += 1
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    low = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            low[find(k)] = min(i, low.get(find(k), i))
    return sorted(((i, n[k], low.get(find(k)) if i is not None else None, i is not None and low.get(find(k)) == i) for k, (i, _) in enumerate(rows)), key=repr)


def cloud(seed=2, groups=25, size=32):
    rng, rows = np.random.default_rng(seed), []
    for _ in range(groups):
        centre = rng.normal(size=size)
        for _ in range(rng.integers(1, 9)):
            rows.append((len(rows), (centre + rng.normal(scale=0.12, size=size)).tolist()))
    hot = rng.normal(size=size)
    rows += [(1000 - k, (hot + rng.normal(scale=0.1, size=size)).tolist()) for k in range(60)]
    rows += [(2000 + k, hot.tolist()) for k in range(20)]
    return rows


@pytest.mark.parametrize("most", [embedding_dedup.MOST, 8])
def test_links_match_all_pairs(spark, most):
    rows = cloud() + [(3000 + k, v) for k, v in enumerate([*BAD, [0.0, 0.0], [1.0, 2.0], [2.0, 4.0], [-1.0, -2.0]])] + [(3, [1.0, 2.1]), (None, [1.0, 2.0])]
    found = embedding_dedup.near_duplicates(vectors(spark, rows), most=most).collect()
    assert by_id(found, "vec_id", "n_links", "component_id", "kept") == plain_links(rows)


def test_no_rows(spark):
    assert embedding_dedup.near_duplicates(vectors(spark, []).limit(0)).count() == 0
    doubles = spark.createDataFrame([(1, [1e200, 1e200]), (2, [1e-200, 1e-200])], "vec_id long, embedding array<double>")
    assert {r["component_id"] for r in embedding_dedup.near_duplicates(doubles).collect()} == {1}


def test_lattice_points_are_nearest():
    rng = np.random.default_rng(3)
    x = rng.normal(scale=2, size=(200, 8))
    point = embedding_dedup.nearest_d8(x)
    assert (point.sum(1) % 2 == 0).all()
    steps = np.array([s * (np.eye(8)[i] + t * np.eye(8)[j]) for i in range(8) for j in range(i) for s in (1, -1) for t in (1, -1)])
    own = ((x - point) ** 2).sum(1)
    around = (((x - point)[:, None] - steps[None]) ** 2).sum(2)
    assert (own[:, None] <= around + 1e-9).all()


def test_recall_at_the_threshold():
    rng = np.random.default_rng(4)
    x = embedding_dedup.unit_vectors(rng.normal(size=(4000, 64)))
    z = rng.normal(size=x.shape)
    z -= (z * x).sum(1, keepdims=True) * x
    y = 0.9 * x + np.sqrt(1 - 0.81) * embedding_dedup.unit_vectors(z)
    a, b = embedding_dedup.buckets(x), embedding_dedup.buckets(y)
    assert np.mean([bool(set(p) & set(q)) for p, q in zip(a.tolist(), b.tolist(), strict=True)]) >= 0.95


@pytest.mark.parametrize("rows", [1, 2, 3, 4096])
def test_crowded_buckets_in_batches_of_any_size(spark, rows):
    x = [(k, v) for k, (_, v) in enumerate(cloud(5, 6))]
    want = {}
    for k, v in x:
        for b in set(embedding_dedup.buckets(embedding_dedup.unit_vectors(np.array([v])))[0].tolist()):
            want.setdefault(b, set()).add(k)
    embedding_dedup.bounded_batches(spark, rows)
    found = embedding_dedup.crowded(spark.createDataFrame(x, "rid long, v array<double>")).collect()
    got, places = {}, {}
    for r in found:
        got.setdefault(r["bucket"], set()).add(r["rid"])
        places.setdefault(r["bucket"], []).append(r["at"])
    assert got == {b: s for b, s in want.items() if len(s) > 1}
    assert all(sorted(p) == list(range(len(p))) for p in places.values())
    embedding_dedup.bounded_batches(spark)


def test_sketches_pass_pairs_at_the_threshold():
    rng = np.random.default_rng(6)
    x = embedding_dedup.unit_vectors(rng.normal(size=(3000, 64)))
    z = rng.normal(size=x.shape)
    z -= (z * x).sum(1, keepdims=True) * x
    y = 0.9 * x + np.sqrt(1 - 0.81) * embedding_dedup.unit_vectors(z)
    differ = np.bitwise_count(embedding_dedup.sketches(x) ^ embedding_dedup.sketches(y)).sum(1)
    assert differ.max() <= embedding_dedup.apart(0.9) < 90
