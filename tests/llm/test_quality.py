from __future__ import annotations

import zlib

import numpy as np

from helpers import awkward, documents, prose
from ledgerloom.llm import quality as op

LABELS = "doc_id long, quality int, toxic int"


def corpus(spark, n=300):
    rows, labels = [], []
    for k in range(n):
        good = k % 4 != 0
        text = prose("en", 60, k).capitalize() + "." if good else " ".join(w.upper() + "!!" for w in prose("en", 10, k).split()) * 3
        rows.append((k, text, "en", "s"))
        labels.append((k, int(good), 0))
    return documents(spark, rows), spark.createDataFrame(labels, LABELS)


def test_held_out_accuracy(spark):
    df, labels = corpus(spark)
    rows = op.classify(df, labels).collect()
    held = [r for r in rows if r["held_out"]]
    assert held
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    assert all(r["predicted"] == int(r["score"] >= 0.3) for r in rows)
    assert np.mean([r["predicted"] == int(r["doc_id"] % 4 != 0) for r in held]) > 0.95
    again = {r["doc_id"]: r["score"] for r in op.classify(df.repartition(5), labels.repartition(3)).collect()}
    assert all(abs(again[r["doc_id"]] - r["score"]) < 1e-9 for r in rows)


def test_sum_of_squares_is_all_pairs():
    rng = np.random.default_rng(1)
    model = op.Model(0.3, rng.normal(size=op.WORDS + op.STATS), rng.normal(size=(op.WORDS + op.STATS, op.RANK)))
    index, value = op.features(prose("de", 40, 1))
    pairs = sum(model.factors[index[a]] @ model.factors[index[b]] * value[a] * value[b] for a in range(len(index)) for b in range(a))
    assert abs(op.raw_score(index, value, model) - (0.3 + model.linear[index] @ value + pairs)) < 1e-6


def test_training_lowers_the_loss():
    rows = [op.features(t) for t in ("good words here", "BAD!! BAD!!", "nice text", "BAD!! JUNK!!")] * 10
    labels = np.array([1.0, 0, 1, 0] * 10)
    model = op.fit(rows, labels, np.ones(40))
    scores = [op.logistic(op.raw_score(*r, model)) for r in rows[:4]]
    assert min(scores[0], scores[2]) > 0.5 > max(scores[1], scores[3])


def test_awkward_rows(spark):
    df, rows = awkward(spark)
    labels = spark.createDataFrame([(4, 1, 0), (7, 0, 0), (0, 1, None), (1, None, 0), (None, 1, 0), (4, 1, 0), (999, 1, 1)], LABELS)
    found = op.classify(df, labels).collect()
    assert len(found) == len(rows)
    assert all(0 <= r["score"] <= 1 for r in found)
    assert all(r["held_out"] is False for r in found if r["doc_id"] is None)
    assert op.classify(df.limit(0), labels).count() == 0
    assert {r["score"] for r in op.classify(df, labels.limit(0)).collect()} == {0.5}


def test_features_that_reach_the_driver_are_bounded(spark, monkeypatch):
    df = documents(spark, [(k, prose("en", 300, k) if k % 2 else "## 12 " * 30, "en", "s") for k in range(60)])
    labels = spark.createDataFrame([(k, k % 2) for k in range(60)], "doc_id long, quality int")
    seen, real = [], op.fit
    monkeypatch.setattr(op, "fit", lambda rows, *more: seen.append(sum(6 * len(i) for i, _ in rows)) or real(rows, *more))
    op.learn(df, labels)
    op.learn(df, labels, most_bytes=20_000)
    assert seen[1] <= 20_000 < seen[0]


def test_long_texts_of_one_line(spark):
    model = op.learn(*corpus(spark)[:2])
    texts = ["word " * 400_000, "x" * 2_000_000, " ".join(f"w{k}" for k in range(300_000))]
    found = op.scored(documents(spark, [(k, t, None, None) for k, t in enumerate(texts)]), model).collect()
    for r in found:
        index, value = op.features(texts[r["doc_id"]])
        assert len(index) <= op.WORDS + op.STATS
        assert abs(r["score"] - op.logistic(op.raw_score(index, value, model))) < 1e-9
