from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import discover as disc
from ledgerloom.operators.impact import impact
from ledgerloom.operators.normalise import DropRateError, Locale, NormaliseError, normalise
from ledgerloom.operators.reconcile import IdentityError, ReconcileError, infer_dates, reconcile
from ledgerloom.operators.verify import verify
from ledgerloom.plans.rules import parse_rules


def test_normalise(spark):
    df = spark.createDataFrame([(" 2025-01-02", "x\x00", "5.00", "keep"), ("2025-01-03", "y", "(7)", "k2"), ("bad", "z", "1", "k3")], "`Booking Date` string, Payee string, Debit string, extra string")
    with pytest.raises(DropRateError):
        normalise(df)
    out = normalise(df, fail_threshold=0.5, number_rows=True).orderBy("_row_id").collect()
    assert [(r["_row_id"], r["amount"], r["counterparty"], r["extra"], r["category"]) for r in out] == [(0, -5.0, "x", "keep", ""), (1, -7.0, "y", "k2", "")]
    with pytest.raises(DropRateError):
        normalise(df, fail_threshold=0.5, strict=True)
    with pytest.raises(NormaliseError):
        normalise(df.drop("Payee"))
    empty = normalise(df.limit(0), number_rows=True)
    assert empty.count() == 0


def test_normalise_maps_and_locales(spark):
    df = spark.createDataFrame([("02.01.2025", "1.234,5", "A", "note")], "d string, VALUE string, who string, type string")
    row = normalise(df, {"Date": "D", "counterparty": ["who"], "memo": ["type"], "amount": {"aliases": "value"}}, Locale(",", ".", True)).first()
    assert (str(row["date"])[:10], row["amount"], row["memo"]) == ("2025-01-02", 1234.5, "note")
    both = spark.createDataFrame([("2025-01-01", "a", "3", "10")], "date string, description string, debit string, credit string")
    assert normalise(both).first()["amount"] == 7.0


def ledger(spark, rows, names="_row_id long, date string, counterparty string, amount double, category string"):
    return spark.createDataFrame(rows, names).withColumn("date", F.to_timestamp_ntz("date"))


def test_discover(spark):
    rows = [(0, "2025-01-01", "Café", 5.0, ""), (1, "2025-01-03", "CAFE!", -9.0, None), (2, "2025-01-03", "cafe", 2.0, " "), (3, "2025-01-02", "done", 1.0, "Set"), (4, "2025-01-05", "big", -1000.0, ""), (5, "2025-01-01", "***", 1.0, "")]
    every = disc.discover_all(ledger(spark, rows))
    found = {r["counterparty_fingerprint"]: r for r in every.collect()}
    assert set(found) == {"CAFE", "BIG"}
    cafe = found["CAFE"]
    assert (cafe["count"], cafe["example_counterparty_name"], cafe["last_seen_date"], cafe["max_abs_amount"], cafe["total_value"], cafe["sample_amount"]) == (3, "CAFE!", "2025-01-03", 9.0, -2.0, -9.0)
    assert [r[0] for r in disc.candidates(every, 2).collect()] == ["CAFE"]
    assert [r[0] for r in disc.candidates(every, 2, 500.0).collect()] == ["CAFE", "BIG"]
    assert [r[0] for r in disc.candidates(every, 1, top_k=1).collect()] == ["CAFE"]
    out = ledger(spark, rows).withColumn("exclude", F.col("_row_id") == 4)
    assert disc.discover_all(out).count() == 1
    assert disc.discover_all(out, include_excluded=True).count() == 2
    assert disc.discover_all(ledger(spark, rows), since="2025-01-04").count() == 1
    assert disc.discover_all(ledger(spark, [])).count() == 0


def test_suggest():
    rows = [{"Counterparty_Fingerprint": "JOES GRILL LTD", "example_counterparty_name": "Joe's Grill Ltd", "count": 7, "sample_date": "2025-01-01", "sample_amount": -3.5}, {"fingerprint": "GRILL", "example": "grill"}, {"fingerprint": "12", "example": "12"}, {"fingerprint": "", "example": "x"}]
    drafts = disc.suggest(rows)
    assert [d.condition for d in drafts] == ['counterparty ~ "*GRILL*"']
    assert "# SUGGESTED (freq=7, last=2025-01-01, sample_amt=-3.5)" in drafts[0].text
    assert parse_rules(drafts[0].text)[0].match[0].value == "*GRILL*"
    assert disc.suggest(rows, existing=drafts[0].text) == []
    exact = disc.suggest(rows, kind="exact", quote="'")
    assert exact[0].condition == "counterparty == 'Joe\\'s Grill Ltd'"
    assert parse_rules(exact[0].text.replace("rule 'Suggested: JOE\\'S GRILL LTD'", "rule x"))[0].match[0].value == "Joe's Grill Ltd"
    assert disc.pattern_word("THE GROUP LTD") == "THE"
    assert disc.pattern_word("GROUP LTD") == "GROUP"
    assert disc.title_of("") == "CANDIDATE"


def test_verify(spark):
    a = ledger(spark, [(0, "2025-01-01", "=x", 1.0, ""), (1, "2025-01-02", "y", 2.004, "")])
    same = spark.createDataFrame([(0, "2025-01-01", "'=x", "1.00"), (1, "2025-01-02", "y", "2.00")], "_row_id long, date string, counterparty string, amount string")
    assert verify(a, same, "full").success
    wrong = same.withColumn("amount", F.when(F.col("_row_id") == 1, "9").otherwise(F.col("amount")))
    found = verify(a, wrong, "full")
    assert (found.success, found.mismatches) == (False, 1)
    assert found.rows.first()["field_diffs"] == "amount: '2.00' -> '9.00'"
    short = verify(a, same.limit(1))
    assert (short.mismatches, short.rows_checked) == (1, 1)
    with pytest.raises(ValueError):
        verify(a, same, "slow")


EXTERNAL = "_row_id long, date string, counterparty string, amount string, category string"


def test_reconcile_by_key(spark):
    left = ledger(spark, [(0, "2025-01-13", "+44 Taxi", 1.0, "A"), (1, "2025-01-02", "b", -2.5, "B"), (2, "2025-01-03", "c", 3.0, "C")])
    right = spark.createDataFrame([(0, "13/01/2025", " +44 TAXI", "1.0", "A"), (1, "02/01/2025", "B", "(2.50)", "b"), (2, "04/01/2025", "d", "3", "D")], EXTERNAL)
    found = reconcile(left, right, keys=("date", "amount", "counterparty"))
    assert found.dates.mode == "inferred"
    assert found.dates.dayfirst
    facts = found.summary()
    assert (facts["rows_compared"], facts["mismatches"], facts["orphans_left"], facts["orphans_right"], facts["match_rate"], facts["success"]) == (2, 1, 1, 1, 50.0, False)
    assert found.mismatches.first()["external_category"] == "b"  # values are compared as written
    assert found.orphans_right.first()["row_number"] == 3
    twice = right.union(right.limit(1))
    with pytest.raises(ReconcileError, match="not unique"):
        reconcile(left, twice, keys=("date", "amount", "counterparty"))


def test_reconcile_by_position(spark):
    left = ledger(spark, [(0, "2025-01-01", "a", 1.0, "A"), (1, "2025-01-02", "b", 2.0, "B")])
    right = spark.createDataFrame([(0, "01/02/2025", "A", "1.00", "A"), (1, "02/01/2025", "b", "2", "X")], EXTERNAL)
    found = reconcile(left, right)
    assert found.mismatches.count() == 1
    assert found.summary()["alignment_mode"] == "positional"
    with pytest.raises(IdentityError) as error:
        reconcile(left, right, identity=("date", "amount"))
    assert error.value.failures.first()["differing_identity_fields"] == "date"
    assert reconcile(left, right, identity=("amount", "counterparty")).mismatches.count() == 1
    for bad in ({"fields": ()}, {"fields": ("none",)}, {"keys": ("date",), "identity": ("date",)}, {"keys": ("nokey",)}):
        with pytest.raises(ReconcileError):
            reconcile(left, right, **bad)
    with pytest.raises(ReconcileError):
        reconcile(left, right.limit(1))


def test_date_conventions(spark):
    dates = lambda *texts: spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "_row_id long, date string")
    assert infer_dates(dates("01/02/2025", "13/01/2025")).dayfirst
    assert not infer_dates(dates("01/13/2025")).dayfirst
    assumed = infer_dates(dates("01/02/2025"))
    assert (assumed.mode, assumed.ambiguous_values) == ("assumed", 1)
    assert infer_dates(dates("2025-01-01", "")).mode == "not_applicable"
    with pytest.raises(ReconcileError):
        infer_dates(dates("13/01/2025", "01/13/2025"))
    left = ledger(spark, [(0, "2025-02-01", "a", 1.0, "A")])
    right = spark.createDataFrame([(0, "01/02/2025", "a", "1", "A")], EXTERNAL)
    assert reconcile(left, right, keys=("date",), date_format="%d/%m/%Y").summary()["success"]
    with pytest.raises(ReconcileError, match="does not read"):
        reconcile(left, right, keys=("date",), date_format="%Y-%m-%d")


def test_impact(spark):
    rule = lambda name, match, sets: f"rule {name} {{\nmatch:\n{match}\nset:\n{sets}\n}}\n"
    old = parse_rules(rule("a", "counterparty == x", "category = A\nflags += f") + rule("b", "counterparty == y", "category = B"))
    new = parse_rules(rule("a", "counterparty == x", "category = A2\nflags += g\nmemo = m") + rule("c", "counterparty == y", "category = B"))
    rows = [(k, "2025-01-01", c, amount, "") for k, (c, amount) in enumerate([("x", -5.0), ("x", 2.0), ("y", 1.0), ("z", 1.0)])]
    found = impact(ledger(spark, rows), old, new)
    assert found.summary() == {"rows_compared": 4, "behavioural_changed": 2, "attribution_changed": 1, "rows_stable": 1}
    assert [tuple(r) for r in found.transitions.collect()] == [("A", "A2", 2, 7.0)]
    assert [tuple(r) for r in found.rule_deltas.orderBy("position").collect()] == [(0, "a", 2, 2, 0, "present"), (1, "b", 1, 0, -1, "removed"), (2, "c", 0, 1, 1, "new")]
    assert [tuple(r) for r in found.flag_deltas.orderBy("flag").collect()] == [("f", 0, 2), ("g", 2, 0)]
    assert found.status_deltas.count() == 0
    assert found.changed_rows.count() == 3
    plan = found.compared._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan
    assert "Exchange" not in plan
