"""Verify that a ledger's immutable fields came through: fingerprints of date, amount and counterparty, row by row."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.functions.text import amount_2dp, parse_date, present, sha16, strip, to_number, unguarded

FIELDS = ("date", "amount", "counterparty")
SAMPLE = 10


def canonical(df: DataFrame) -> dict[str, Column]:
    """The immutable fields as the texts that are compared: ISO dates, amounts to two places, unquoted names."""
    date = F.col("date")
    if isinstance(df.schema["date"].dataType, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        date = F.date_format(date, "yyyy-MM-dd")
    return {"date": present(date), "amount": amount_2dp(F.col("amount")), "counterparty": unguarded(present(F.col("counterparty")))}


def fingerprints(df: DataFrame, key: str = "_row_id") -> DataFrame:
    """``key``, the canonical fields and ``fingerprint`` for every row; row-local."""
    fields = canonical(df)
    out = df.select(key, *(c.alias(f) for f, c in fields.items()))
    return out.withColumn("fingerprint", sha16(*(F.col(f) for f in FIELDS)))


def _both(before: DataFrame, after: DataFrame, key: str, how: str) -> DataFrame:
    side = lambda df, end: fingerprints(df, key).select(key, *(F.col(c).alias(f"{c}_{end}") for c in (*FIELDS, "fingerprint")))
    return side(before, "in").join(side(after, "out"), key, how)


def proof(before: DataFrame, after: DataFrame, key: str = "_row_id") -> DataFrame:
    """Both sides of every row that both have: the fields with ``_in`` and ``_out``, ``fingerprint_*`` and ``same``."""
    return _both(before, after, key, "inner").withColumn("same", F.col("fingerprint_in") == F.col("fingerprint_out"))


def _differs(mode: str) -> Column:
    """Whether a row's fingerprints, or in full mode also its fields, differ; null where a side has no such row."""
    if mode not in ("fast", "full"):
        raise ValueError(f"a verification is fast or full, not {mode!r}")
    found = F.col("fingerprint_in") != F.col("fingerprint_out")
    for f in FIELDS if mode == "full" else ():
        found = found | (F.col(f"{f}_in") != F.col(f"{f}_out"))
    return found


def mismatches(before: DataFrame, after: DataFrame, mode: str = "fast", key: str = "_row_id") -> DataFrame:
    """Rows whose fingerprints differ; in full mode also those whose fields do, with ``field_diffs``."""
    pairs = proof(before, after, key)
    differ = [F.when(F.col(f"{f}_in") != F.col(f"{f}_out"), F.concat(F.lit(f"{f}: '"), f"{f}_in", F.lit("' -> '"), f"{f}_out", F.lit("'"))) for f in FIELDS]
    out = pairs.where(_differs(mode))
    named = [F.when(F.col(f"{f}_in") != F.col(f"{f}_out"), F.lit(f"field mismatch ({f})")) for f in FIELDS]
    reason = F.when(~F.col("same"), F.lit("fingerprint mismatch")).otherwise(F.coalesce(*named))
    columns = [F.col(key), reason.alias("reason"), "fingerprint_in", "fingerprint_out"]
    return out.select(*columns, *([F.coalesce(F.nullif(F.concat_ws("; ", *differ), F.lit("")), F.lit("hash differs (fields appear equal)")).alias("field_diffs")] if mode == "full" else []))


def counts(before: DataFrame, after: DataFrame, mode: str = "fast", key: str = "_row_id") -> DataFrame:
    """One row, from one pass over both sides: ``rows_in, rows_out, rows_checked, mismatches``; another number of rows is one more."""
    both = _both(before, after, key, "full_outer")
    n = lambda end: F.count(f"fingerprint_{end}")
    both_there = F.col("fingerprint_in").isNotNull() & F.col("fingerprint_out").isNotNull()
    wrong = F.count_if(F.coalesce(_differs(mode), F.lit(False))) + (n("in") != n("out")).cast("long")
    return both.agg(n("in").alias("rows_in"), n("out").alias("rows_out"), F.count_if(both_there).alias("rows_checked"), wrong.alias("mismatches"))


def as_read(df: DataFrame, decimal: str = ".", thousands: str | None = None, dayfirst: bool = False, date_format: str | None = None, key: str = "_row_id") -> DataFrame:
    """The immutable fields of a table of texts, found by name in any case (empty if missing), as a ledger made of it has them.

    Dates that can be read become ISO, amounts that can be read become numbers; other texts stay as they are.
    """
    names = {c.lower(): c for c in df.columns}
    text = {f: strip(present(F.col(f"`{names[f]}`"))) if f in names else F.lit("") for f in FIELDS}
    day, number = F.date_format(parse_date(text["date"], dayfirst, date_format), "yyyy-MM-dd"), to_number(text["amount"], decimal, thousands)
    amount = F.when(number.isNotNull(), amount_2dp(number.cast("decimal(38,6)")))
    return df.select(key, F.coalesce(day, text["date"]).alias("date"), F.coalesce(amount, text["amount"]).alias("amount"), strip(unguarded(text["counterparty"])).alias("counterparty"))


@dataclass(frozen=True)
class Verification:
    success: bool
    rows_in: int
    rows_out: int
    rows_checked: int
    mismatches: int
    mode: str
    rows: DataFrame
    proof: DataFrame


def verify(before: DataFrame, after: DataFrame, mode: str = "fast", key: str = "_row_id") -> Verification:
    """Counts, and the mismatching rows as a frame. Another number of rows is a finding by itself."""
    n = counts(before, after, mode, key).first()
    return Verification(n.mismatches == 0, n.rows_in, n.rows_out, n.rows_checked, n.mismatches, mode, mismatches(before, after, mode, key), proof(before, after, key))
