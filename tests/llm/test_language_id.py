from __future__ import annotations

import zlib

import numpy as np
import pytest

from helpers import awkward, documents, prose
from ledgerloom.llm import language_id as op


def corpus(spark, n=120):
    langs = sorted(["en", "de", "fr"])
    return documents(spark, [(k, prose(langs[k % 3], 40, k), langs[k % 3], "s") for k in range(n)])


def test_held_out_accuracy(spark):
    rows = op.identify(corpus(spark)).collect()
    held = [r for r in rows if r["held_out"]]
    assert held
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
    langs = sorted(["en", "de", "fr"])
    assert all(r["lang_pred"] == langs[r["doc_id"] % 3] and r["score"] > 0.9 for r in rows)


def test_mixtures_have_their_proportions(spark):
    model = op.learn(corpus(spark))
    text = f"{prose('en', 300, 900)} {prose('de', 100, 901)}"
    shares, n = op.mixtures([text, prose("fr", 50, 902)], model)
    share = dict(zip(model.languages, shares[0], strict=True))
    assert share["fr"] == 0.0  # the language set leaves it out
    assert 0.55 < share["en"] < 0.9
    assert share["en"] + share["de"] == np.float64(1.0) or abs(share["en"] + share["de"] - 1) < 1e-9
    assert shares[1].max() == 1.0
    assert n[1] > 0


def test_counts_are_those_of_the_whole_text():
    texts = ["Ab c", None, "", "12", "xyz " * 5000]
    owner, bucket, number = op.counts(texts)
    assert set(owner.tolist()) == {0, 4}
    whole = dict(zip(bucket[owner == 4].tolist(), number[owner == 4].tolist(), strict=True))
    old, op.AT_ONCE = op.AT_ONCE, 1000
    try:
        again = op.counts(texts)
    finally:
        op.AT_ONCE = old
    parts = dict(zip(again[1][again[0] == 4].tolist(), again[2][again[0] == 4].tolist(), strict=True))
    assert sum(parts.values()) == sum(whole.values()) == 15000
    # "ab c" has three letters, and a trigram around each
    assert number[owner == 0].sum() == 3


def test_neighbours_in_a_batch_change_nothing():
    signs, times = "abcdef", [34, 11, 6, 42, 5, 55]
    logs = [[2.6, -0.1, 0.1, 1.8], [-0.2, 4.0, -3.7, -3.2], [-0.7, 2.8, -0.2, -3.4], [1.9, -2.8, 3.2, 2.3], [3.8, 3.1, 2.7, 1.8], [-0.8, -0.3, 0.0, 0.5]]
    likelihood = np.full((op.BUCKETS, 4), 1e-6)
    likelihood[[int(op.counts([f"{c} {c}"])[1][0]) for c in signs]] = np.exp(logs) / 100
    model = op.Model(("a", "b", "c", "d"), likelihood)
    text, other = (" ".join(" ".join([c] * n) for c, n in zip(signs, many, strict=True)) for many in (times, [3000] * 6))
    alone, beside = op.mixtures([text], model)[0][0], op.mixtures([other, text], model)[0][1]
    assert (alone > 0).sum() == 4  # two languages are not worth their penalty, four are
    assert np.allclose(alone, beside)


def test_the_bound_leaves_no_better_set_out():
    rng = np.random.default_rng(3)
    at = [int(op.counts([f"{c} {c}"])[1][0]) for c in "abcdef"]
    old = op._bound
    for _ in range(60):
        likelihood = np.full((op.BUCKETS, 5), 1e-6)
        likelihood[at] = np.exp(rng.normal(scale=2.5, size=(6, 5))) / 100
        model = op.Model(tuple("vwxyz"), likelihood)
        texts = [" ".join(" ".join([c] * k) for c, k in zip("abcdef", rng.integers(0, 60, 6), strict=True)) for _ in range(20)]
        found = op.mixtures(texts, model)[0]
        op._bound = lambda p, number, starts, *_: np.full(len(starts), np.inf)  # every size for every document
        try:
            every = op.mixtures(texts, model)[0]
        finally:
            op._bound = old
        assert np.allclose(found, every)


def test_awkward_rows(spark):
    df, rows = awkward(spark)
    found = op.identify(df).collect()
    assert len(found) == len(rows)
    und = [r for r in found if r["lang_pred"] == "und"]
    assert sum(r["doc_id"] is None for r in und) == 1
    assert {r["doc_id"] for r in und} == {0, 1, 2, 8, None}
    assert all(r["score"] == 0 for r in und)
    assert all(0 <= r["score"] <= 1 for r in found)
    assert all(r["held_out"] is False for r in found if r["doc_id"] is None)
    assert op.identify(df.limit(0)).count() == 0
    nothing = op.identify(documents(spark, [(1, "some words", None, "s")])).first()
    assert (nothing["lang_pred"], nothing["score"]) == ("und", 0.0)
    kept = op.with_language(df, op.learn(df))
    assert kept.columns[: len(df.columns) - 1] == [c for c in df.columns if c != "score"]
    assert kept.count() == len(rows)


@pytest.mark.parametrize("at_once", [1, 2, 7, 1 << 20])
def test_counts_do_not_depend_on_chunks_or_neighbours(at_once, monkeypatch):
    texts = ["a", "", None, "é a1b  c", "1a", " a b ", "12", prose("de", 60, 1) + "," + prose("fr", 20, 2), "日本語。テ", "x"]

    def plain(text):
        low = "".join(c.lower()[0] if c.isalpha() else " " for c in text or "")
        low = f" {' '.join(low.split())} "
        return sum(c != " " for c in low)

    want = [op.counts([t])[1:] for t in texts]
    assert [int(n.sum()) for _, n in want] == [plain(t) for t in texts]
    monkeypatch.setattr(op, "AT_ONCE", at_once)
    owner, bucket, number = op.counts(texts)
    for k, (buckets, numbers) in enumerate(want):
        assert bucket[owner == k].tolist() == buckets.tolist()
        assert number[owner == k].tolist() == numbers.tolist()


def plain_mixture(text, model):
    """Proportions by expectation-maximisation in loops, with every size of set tried."""
    _, bucket, number = op.counts([text])
    many, n = len(model.languages), number.sum()

    def fitted(share, rounds):
        for _ in range(rounds):
            new = [0.0] * many
            for b, k in zip(bucket, number, strict=True):
                whole = sum(share[i] * model.likelihood[b, i] for i in range(many))
                for i in range(many):
                    new[i] += k * share[i] * model.likelihood[b, i] / whole / n
            share = new
        return share, sum(k * np.log(sum(share[i] * model.likelihood[b, i] for i in range(many))) for b, k in zip(bucket, number, strict=True))

    if not n:
        return [0.0] * many
    full, _ = fitted([1 / many] * many, op.FIRST)
    order, best = sorted(range(many), key=lambda i: -full[i]), (-np.inf, None)
    for size in range(1, many + 1):
        start = [max(full[i], 1e-9) if i in order[:size] else 0.0 for i in range(many)]
        share, fit = fitted([x / sum(start) for x in start], op.AGAIN if size > 1 else 0)
        value = fit - op.PENALTY * size * np.log(n + 1) / 2
        if value > best[0]:
            best = (value, share)
    return best[1]


def test_mixtures_match_plain_loops(spark):
    langs, parts = ["de", "en", "fr"], ["de", "en", "fr", "de", "en"]
    model = op.learn(documents(spark, [(k, prose(langs[k % 3], 60, k), langs[k % 3], "s") for k in range(90)]))
    texts = [" ".join(prose(x, 5 + 9 * k, 500 + k) for x in parts[k % 5 : k % 5 + 1 + k % 3]) for k in range(24)]
    texts += ["a", "", None, "xq zz", "12", "é"]
    shares, _ = op.mixtures(texts, model)
    for k, text in enumerate(texts):
        assert np.allclose(shares[k], plain_mixture(text, model), atol=1e-9)
        assert np.allclose(shares[k], op.mixtures([text], model)[0][0], atol=1e-12)
    assert (shares > 0).sum(1).max() > 1
