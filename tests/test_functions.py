from __future__ import annotations

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import text as fn


def values(spark, rows, column, kind="string"):
    df = spark.createDataFrame([(k, r) for k, r in enumerate(rows)], f"k int, s {kind}")
    return [r["v"] for r in df.select("k", column(F.col("s")).alias("v")).orderBy("k").collect()]


def test_numbers(spark):
    texts = ["1,234.56", "(5.00)", "12-", "7DR", "8 cr.", "\u22123", "£ 9", "1e3", "5d", "inf", "nan", " 4 ", "12.5 DEBIT", "", None, "(1)CR", "3 CREDIT DR", "1\u00A0000", "-5 dr", "5."]
    assert values(spark, texts, fn.to_number) == [None, -5.0, -12.0, -7.0, 8.0, -3.0, 9.0, 1000.0, None, float("inf"), None, 4.0, -12.5, None, None, 1.0, None, 1000.0, -5.0, 5.0]
    assert values(spark, ["1.234,56", "-1.000,5"], lambda c: fn.to_number(c, ",", ".")) == [1234.56, -1000.5]
    assert values(spark, ["1,234.56"], lambda c: fn.to_number(c, thousands=",")) == [1234.56]


def test_dates(spark):
    texts = ["2025-01-02", "13/01/2025", "01/13/2025", "03/04/2025", "2025-01-02T10:11:12Z", "5 Jan 2025", "x", None, "2025-02-30", "20250102"]
    month = values(spark, texts, fn.parse_date)
    day = values(spark, texts, lambda c: fn.parse_date(c, True))
    assert month == [datetime(2025, 1, 2), datetime(2025, 1, 13), datetime(2025, 1, 13), datetime(2025, 3, 4), datetime(2025, 1, 2, 10, 11, 12), datetime(2025, 1, 5), None, None, None, datetime(2025, 1, 2)]
    assert day[0] == month[0]  # an ISO date is never swapped
    assert day[3] == datetime(2025, 4, 3)
    assert values(spark, ["02.01.25", "2025-01-02"], lambda c: fn.parse_date(c, fmt="%d.%m.%y")) == [datetime(2025, 1, 2), None]
    with pytest.raises(ValueError):
        fn.java_format("%Q")


def test_texts(spark):
    assert values(spark, [" a\x00\u200B ", None, "b\uFEFF"], fn.hygiene) == ["a", "", "b"]
    assert values(spark, ["NA", "null", "x", "None"], fn.missing_to_null) == [None, None, "x", None]
    assert values(spark, [1e7, 0.125, 5.0, 1234567.891, 1e16, -0.5], fn.float_text, "double") == ["10000000.0", "0.125", "5.0", "1234567.891", "1.0e16", "-0.5"]
    assert values(spark, ["1.005", "2", "x ", None, "1e2"], fn.amount_2dp) == ["1.01", "2.00", "x", "", "100.00"]
    assert values(spark, ["a b  a", None, ""], fn.tokens) == [["a", "b"], [], []]


def test_guard_and_its_inverse(spark):
    texts = ["=1", " +2", "-x", "@", "\tq", "'=1", "ok", "", None, "'it"]
    safe = values(spark, texts, fn.guarded)
    assert safe == ["'=1", "' +2", "'-x", "'@", "'\tq", "'=1", "ok", "", None, "'it"]
    assert values(spark, safe, fn.unguarded) == ["=1", " +2", "-x", "@", "\tq", "=1", "ok", "", None, "'it"]


def test_fingerprints_fold_accents(spark):
    df = spark.createDataFrame([("CAFÉ  x.",), ("ﬁ-1",), (None,), ("***",), ("a\x00b c",)], "s string")
    found = {r["s"]: r["fp"] for r in fn.with_fingerprint(df, "s", "fp").collect()}
    assert found == {"CAFÉ  x.": "CAFE X", "ﬁ-1": "FI 1", None: "", "***": "", "a\x00b c": "AB C"}
