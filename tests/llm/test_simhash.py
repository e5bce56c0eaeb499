from __future__ import annotations

import random
import re
from functools import partial

import numpy as np
import pytest
import xxhash

from helpers import awkward, by_id, documents, prose
from ledgerloom.llm import simhash as op


def plain_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    hashes = [xxhash.xxh64(" ".join(words[k : k + 4]).encode(), seed=42).intdigest() for k in range(max(1, len(words) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(fps):
    """The smallest place of each one's component, by comparing all."""
    root = list(range(len(fps)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 4:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(k) for k in range(len(fps))]


@pytest.mark.parametrize("text", [None, "", " \n", "One", "a b C", "a b c d", "A b c d e é 日本", "x\x1fy\x85z w", prose("en", 500, 1), "w " * 70000])
def test_fingerprints(text):
    assert op.fingerprint(text) == plain_fingerprint(text)


def test_chunks_of_shingles_add_up():
    old, op.AT_ONCE = op.AT_ONCE, 7
    try:
        assert op.fingerprint(prose("de", 100, 2)) == plain_fingerprint(prose("de", 100, 2))
    finally:
        op.AT_ONCE = old


@pytest.mark.parametrize(("width", "r"), [(32, 5), (21, 4), (22, 4)])
def test_anchors_cover_every_pair_within_two_bits(width, r):
    rng = np.random.default_rng(1)
    x = rng.integers(0, 1 << width, 3000, dtype=np.int64)
    y = x.copy()
    for _ in range(2):
        y ^= 1 << rng.integers(0, width, 3000)
    at = [{} for _ in range(2)]
    for k, part in enumerate((x, y)):
        of, found = op.anchors(part, width, r)
        assert np.bincount(of).max() <= 17
        assert all(int(a ^ part[i]).bit_count() <= 2 for i, a in zip(of[:500], found[:500], strict=True))
        for i, a in zip(of.tolist(), found.tolist(), strict=True):
            at[k].setdefault(i, set()).add(a)
    assert all(at[0][i] & at[1][i] for i in range(3000))


@pytest.mark.parametrize("most", [op.MOST, 3])
def test_components_match_all_pairs(spark, most):
    rnd = random.Random(4)
    fps = []
    for _ in range(60):
        f = rnd.getrandbits(64)
        fps.append(f)
        for _ in range(rnd.randint(0, 6)):  # chains and stars at distances around the threshold
            f ^= sum(1 << b for b in rnd.sample(range(64), rnd.randint(1, 6)))
            fps.append(f)
    hot = rnd.getrandbits(64)
    fps += [hot ^ (1 << a) ^ (1 << b) for a in range(12) for b in range(a)]
    want = plain_components(fps)
    signed = lambda f: f - (1 << 64) if f >> 63 else f
    known = spark.createDataFrame([(k, signed(f)) for k, f in enumerate(fps)], "doc_id long, fp long")
    of = {r["fp"]: r["component_id"] for r in op.fingerprint_components(known, most).collect()}
    assert [of[signed(f)] for f in fps] == want


def shingles(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", words)
    return {" ".join(words[k : k + 5]) for k in range(max(1, len(words) - 4))}


def plain_kept(rows, similarity=0.8):
    """The ids that stay when all pairs of five-word shingle sets are compared."""
    sets = [shingles(t) for _, t, *_ in rows]
    root = list(range(len(rows)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] == sets[j] or len(sets[i] & sets[j]) >= similarity * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    best = {}
    for k, (doc_id, *_) in enumerate(rows):
        at = best.get(find(k), rows[k][0])
        best[find(k)] = doc_id if at is None else at if doc_id is None else min(at, doc_id)
    return list(best.values())


@pytest.mark.parametrize("together", [op.TOGETHER, 900])
def test_near_copies_go(spark, together):
    rnd = random.Random(8)
    rows = [(k, prose("en", 250, k), "en", "s") for k in range(30)]
    for k in range(60):
        words = rows[k % 12][1].split()
        for _ in range(rnd.choice([1, 2, 4, 40])):
            words[rnd.randrange(len(words))] = "changed"
        rows.append((100 + k, " ".join(words), "en", "s"))
    rows += [(300 + k, rows[3][1] + " more" * (k % 3), "en", "s") for k in range(20)]
    rnd.shuffle(rows)
    kept = op.deduplicated(documents(spark, rows), together=together)
    want = plain_kept(rows)
    assert len(want) < 70
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(want)


def edited(rnd, words, how):
    """A copy with one contiguous edit; its similarity is between 0.8 and 0.85."""
    n, more = len(words), prose("de", 300, rnd.random()).split()
    at = {"appended": n, "prepended": 0, "inserted": n // 2}.get(how)
    size = int(n * rnd.uniform(0.18, 0.23))
    if at is not None:
        return words[:at] + more[:size] + words[at:]
    return words[: n - int(n * rnd.uniform(0.16, 0.19))] if how == "cut off" else words[int(n * rnd.uniform(0.16, 0.19)) :]


@pytest.mark.parametrize("listed", [op.LISTED, 2])
def test_copies_with_one_long_edit_go(spark, listed, monkeypatch):
    monkeypatch.setattr(op, "candidates", partial(op.candidates, listed=listed))
    rnd = random.Random(6)
    rows = [(k, prose("en", 200 + 9 * k, 100 + k), "en", "s") for k in range(40)]
    line = prose("en", 12, 900)  # in many texts, so its shingles tell nothing
    rows += [(50 + k, f"{prose('fr', 60, 100 + k)} {line}", "fr", "s") for k in range(40)]
    for k in range(40):
        for j, how in enumerate(("appended", "prepended", "inserted", "cut off", "headless")):
            rows.append((1000 + 10 * k + j, " ".join(edited(rnd, rows[k][1].split(), how)), "en", "s"))
    alike = [len(a & b) / len(a | b) for a, b in ((shingles(rows[(i - 1000) // 10][1]), shingles(t)) for i, t, *_ in rows if i >= 1000)]
    assert sum(0.8 <= x < 0.86 for x in alike) > 150
    rnd.shuffle(rows)
    want = plain_kept(rows)
    assert sorted(r["doc_id"] for r in op.deduplicated(documents(spark, rows)).collect()) == sorted(want)


def test_any_order_of_shingles_leaves_no_pair_out():
    rng = np.random.default_rng(5)
    for n in [*range(1, 40), 200, 1001]:
        often = rng.integers(0, 3, op.BUCKETS)
        for _ in range(20):
            pool = rng.integers(0, 1 << 64, 2 * n, dtype=np.uint64)
            cut = int(rng.integers(0, n // 4 + 1))
            a, b = np.unique(pool[:n]), np.unique(pool[cut : n + int(rng.integers(0, cut + 1))])
            both = len(np.intersect1d(a, b))
            if both >= 0.8 * (len(a) + len(b) - both):
                assert len(np.intersect1d(op.prefix(a, often), op.prefix(b, often)))


def test_near_duplicates(spark):
    base = prose("en", 400, 5)
    rows = [(5, base, "en", "s"), (3, base, "en", "s"), (9, base.upper(), "en", "s"), (11, base + " the end", "en", "s"), (1, prose("fr", 200, 6), "fr", "s")]
    found = {r["doc_id"]: r for r in op.near_duplicates(documents(spark, rows)).collect()}
    assert {found[k]["component_id"] for k in (3, 5, 9)} == {3}
    assert found[1]["component_id"] == 1
    assert found[3]["fingerprint"] == f"{plain_fingerprint(base):016x}"


def test_awkward_rows(spark):
    df, rows = awkward(spark)
    fps = [plain_fingerprint(t) for _, t, _, _ in rows]
    root = plain_components(fps)
    ids = {}
    for k, (doc_id, *_) in enumerate(rows):
        if doc_id is not None:
            ids[root[k]] = min(doc_id, ids.get(root[k], doc_id))
    want = sorted(((d, f"{f:016x}", ids.get(root[k])) for k, ((d, *_), f) in enumerate(zip(rows, fps, strict=True))), key=repr)
    assert by_id(op.near_duplicates(df).collect(), "doc_id", "fingerprint", "component_id") == want
    assert op.near_duplicates(df.limit(0)).count() == 0
    kept = op.deduplicated(df)
    assert kept.columns == df.columns
    assert kept.where("_row <> 7").count() == 0
    assert sorted((str(r["doc_id"]) for r in kept.collect())) == sorted(map(str, plain_kept(rows)))
    assert op.deduplicated(df.limit(0)).count() == 0


def test_rows_keep_their_numbers_when_splits_change(spark, tmp_path, monkeypatch):
    rnd, name = random.Random(3), "spark.sql.files.maxPartitionBytes"
    rows = [(k, prose("en", 120, k // 2), "en", "s") for k in range(400)]
    rnd.shuffle(rows)
    documents(spark, rows).repartition(7).write.parquet(f"{tmp_path}/docs")
    docs, sizes = spark.read.parquet(f"{tmp_path}/docs"), iter([4096, 1 << 27, 8192, 1 << 20] * 20)
    real, before = op.cut, spark.conf.get(name)

    def cut(df):
        found = real(df)
        spark.conf.set(name, str(next(sizes)))
        return found

    monkeypatch.setattr(op, "cut", cut)
    try:
        assert sorted(r["doc_id"] for r in op.deduplicated(docs).collect()) == list(range(0, 400, 2))
    finally:
        spark.conf.set(name, before)


@pytest.mark.parametrize("together", [1 << 20, 2000, 300])
def test_groups_of_texts_match_all_pairs(spark, together):
    """One root that holds a large group, some small ones and texts alone, in any chunks."""
    rnd, rows = random.Random(9), []
    for base, many in ((1, 60), (2, 5), (3, 1), (4, 2), (5, 1)):
        words = prose("en", 90, base).split()
        for _ in range(many):
            own = list(words)
            own[rnd.randrange(90)] = f"w{rnd.randrange(10**6)}"
            rows.append((len(rows), " ".join(own), "en", "s"))
    texts = spark.createDataFrame([(7, k, t) for k, t, *_ in rows], "root long, cid long, text string")
    of = {r["cid"]: r["group"] for r in op.near_groups(texts, together).collect()}
    assert sorted({of.get(k, k) for k, *_ in rows}) == sorted(plain_kept(rows))


def test_sketches_rule_out_no_pair(spark):
    rng = np.random.default_rng(2)
    for n in (64, 200, 900):
        for _ in range(60):
            pool = rng.integers(0, 1 << 64, 2 * n, dtype=np.uint64)
            a, b = pool[:n], pool[n // 9 : n + n // 9]
            both = len(np.intersect1d(a, b))
            assert both < 0.81 * (len(a) + len(b) - both)
            assert np.bitwise_count(op.majority(iter([a]), op.SKETCH) ^ op.majority(iter([b]), op.SKETCH)).sum() <= op.APART
