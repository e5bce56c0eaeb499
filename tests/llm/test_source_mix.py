from __future__ import annotations

import hashlib
import math
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from helpers import awkward, by_id, documents, prose
from ledgerloom.llm import source_mix as op


def size_of(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def plain_targets(sizes, multiple=1.5, cap=2.0, weights=(3, 1, 2)):
    """Targets by resharing over and over, as the contract words it."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    w = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    target, free, left = dict.fromkeys(names, 0.0), set(names), multiple * sum(sizes.values())
    while left > 1e-9 and free:
        total = sum(w[s] for s in free)
        share = {s: left * w[s] / total for s in free}
        left = 0.0
        for s in sorted(free, key=str):
            target[s] += share[s]
            if target[s] > cap * sizes[s]:
                left += target[s] - cap * sizes[s]
                target[s] = cap * sizes[s]
        free = {s for s in free if target[s] < cap * sizes[s]}
    return target


def plain_mix(rows):
    sizes = defaultdict(int)
    for _, text, _, source in rows:
        sizes[source] += size_of(text)
    target = plain_targets(sizes)
    found = []
    for source in sizes:
        epochs = math.floor(target[source] / sizes[source] + 1e-12) if sizes[source] else 0
        rest, through = target[source] - epochs * sizes[source], 0
        order = []
        for doc_id, text, _, s in rows:
            if s == source:
                digits = hashlib.md5(f"mix:{'null' if doc_id is None else doc_id}".encode()).hexdigest()[:13]
                plain = len([c for c in text if c not in op.SYMBOLS]) / len(text) if text else 0.0
                key = -math.log((int(digits, 16) + 0.5) / 2**52) / (0.05 + 0.95 * plain * plain)
                order.append(((key, -(2**63) if doc_id is None else doc_id, size_of(text)), doc_id))
        order.sort(key=lambda x: x[0])
        for key, doc_id in order:
            through += key[2]
            taken = min(epochs + (2 * through - key[2] <= 2 * rest), 2) * key[2]
            found.append((doc_id, key[2], sizes[source], round(target[source], 6), taken))
    return sorted(found, key=repr)


def many(spark, n=400):
    return documents(spark, rows_of(n)), rows_of(n)


def rows_of(n):
    source = lambda k: ["hot", "b", "c", None, "é"][0 if k % 3 == 0 else k % 5]
    return [(k, prose("en", 1 + k * 7 % 60, k) + (" 123 !!" if k % 4 == 0 else ""), "en", source(k)) for k in range(n)]


@pytest.mark.parametrize("buckets", [op.BUCKETS, 3])
def test_mix_matches_a_plain_one(spark, buckets, monkeypatch):
    monkeypatch.setattr(op, "BUCKETS", buckets)
    df, rows = many(spark)
    found = [(*r[:3], round(r[3], 6), r[4]) for r in by_id(op.mix(df).collect(), "doc_id", "size", "source_size", "target", "taken")]
    assert sorted(found, key=repr) == plain_mix(rows)


def test_targets_and_bounds(spark):
    df, _ = many(spark)
    rows = op.mix(df.withColumn("which", F.col("source"))).collect()
    sums = defaultdict(lambda: [0, 0.0, 0])
    for r in rows:
        assert 0 <= r["taken"] <= 2 * r["size"]
        assert r["target"] <= 2 * r["source_size"] + 1e-9
        got = sums[r["source_size"], r["target"]]
        got[0] += r["taken"]
    assert abs(sum(t for _, t in sums) - 1.5 * sum(r["size"] for r in rows)) < 1e-6
    for (_, target), (taken, *_) in sums.items():
        assert abs(taken - target) <= 35
    again = op.mix(df.repartition(7)).collect()
    assert by_id(again, "doc_id", "taken") == by_id(rows, "doc_id", "taken")


@pytest.mark.parametrize("ids", [[7] * 1000, [None] * 1000, [None] * 500 + list(range(500))])
def test_repeated_rows_are_taken_as_far_as_they_fit(spark, ids):
    rows = [(i, prose("en", 8, 1), "en", "big") for i in ids] + [(9000 + k, prose("en", 9, k), "en", "other") for k in range(100)]
    df = documents(spark, rows).repartition(5)
    found = op.mix(df).collect()
    assert by_id(found, "doc_id", "size", "taken") == sorted(((d, s, t) for d, s, _, _, t in plain_mix(rows)), key=repr)
    for many in (8, 9):
        own = [r for r in found if r["size"] == many]
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= many
    whole = op.repeated(df)
    assert whole.columns == df.columns
    assert whole.count() == sum(r["taken"] // r["size"] for r in found)


def test_sql_of_repeated_rows(spark):
    import duckdb

    rows = [(k // 40, prose("en", 8 + k // 400, k // 400), "en", "ab"[k % 2]) for k in range(2000)]
    table = documents(spark, rows).select("doc_id", "text", "source")
    found = by_id(op.mix(table).collect(), "doc_id", "size", "source_size", "target", "taken")
    con = duckdb.connect()
    con.register("documents", table.toArrow())
    assert found == sorted((tuple(r) for r in con.sql(op.ORACLE_SQL).fetchall()), key=repr)


def test_a_long_text_of_one_line(spark):
    found = op.mix(documents(spark, [(1, "word " * 400_000, "en", "a"), (2, "x" * 1_000_000, "en", "b"), (3, "one two", "en", "b")])).collect()
    assert {r["doc_id"]: r["size"] for r in found} == {1: 400_000, 2: 1, 3: 2}


def test_heavier_documents_come_first(spark):
    rows = [(k, "word " * 20 if k % 2 else "#### ==== " * 10, "en", "big") for k in range(2000)] + [(5000, "w " * 40000, "en", "other")]
    found = op.mix(documents(spark, rows), weights=(1, 3, 2), multiple=1.0).collect()
    taken = [sum(r["taken"] for r in found if r["doc_id"] < 2000 and r["doc_id"] % 2 == odd) for odd in (0, 1)]
    assert taken[1] > 2 * taken[0]


def test_awkward_rows(spark):
    df, rows = awkward(spark)
    found = by_id(op.mix(df).collect(), "doc_id", "size", "source_size", "target", "taken")
    assert sorted(((*r[:3], round(r[3], 6), r[4]) for r in found), key=repr) == plain_mix(rows)
    assert op.mix(df.limit(0)).count() == 0
    empty = documents(spark, [(1, None, None, "s"), (2, "", None, None)])
    assert by_id(op.mix(empty).collect(), "doc_id", "source_size", "target", "taken") == [(1, 0, 0.0, 0), (2, 0, 0.0, 0)]
    whole = op.repeated(df)
    assert whole.columns == df.columns
    assert whole.where("size <> 7").count() == 0
    want = [i for i, size, _, _, taken in plain_mix(rows) for _ in range(taken // size if size else 0)]
    assert sorted((r["doc_id"] for r in whole.collect()), key=repr) == sorted(want, key=repr)


def test_the_plan_has_no_python(spark):
    df, _ = many(spark, 20)
    for out in (op.mix(df), op.repeated(df)):
        plan = out._jdf.queryExecution().toString()
        assert not re.search("Python|Pandas|Arrow", plan)
