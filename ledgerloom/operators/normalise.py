"""Any table of transactions to a canonical ledger: dates, amounts, clean text, and no invalid rows."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.functions.text import hygiene, parse_date, to_number
from ledgerloom.sources.csv import canonical_headers, with_row_ids

REQUIRED = ("date", "amount", "counterparty")
CLEANED = ("counterparty", "memo", "category")


class NormaliseError(ValueError):
    """A table that isn't a ledger."""


class DropRateError(NormaliseError):
    """More rows were invalid than allowed."""


@dataclass(frozen=True)
class Locale:
    decimal: str = "."
    thousands: str | None = None
    dayfirst: bool = False
    date_format: str | None = None


def _number(df: DataFrame, name: str, locale: Locale) -> Column:
    if isinstance(df.schema[name].dataType, T.NumericType):
        return F.col(name).cast("double")
    return to_number(F.col(name), locale.decimal, locale.thousands)


def synthesise_amount(df: DataFrame, locale: Locale = Locale()) -> DataFrame:
    """``amount`` as credit less debit, both without their signs, where only those columns are there; they are kept."""
    if "amount" in df.columns or not {"debit", "credit"} & set(df.columns):
        return df
    leg = lambda name: F.abs(F.coalesce(_number(df, name, locale), F.lit(0.0))) if name in df.columns else F.lit(0.0)
    return df.withColumn("amount", leg("credit") - leg("debit"))


def typed(df: DataFrame, locale: Locale = Locale()) -> DataFrame:
    """The canonical columns with their types; invalid dates and amounts are null."""
    if gone := [x for x in REQUIRED if x not in df.columns]:
        raise NormaliseError(f"missing required columns: {', '.join(sorted(gone))}")
    kind = df.schema["date"].dataType
    date = F.col("date").cast("timestamp_ntz") if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)) else parse_date(F.col("date"), locale.dayfirst, locale.date_format)
    amount = _number(df, "amount", locale)
    columns = {"date": date, "amount": F.when(~F.isnan(amount), amount)}
    columns |= {x: hygiene(F.col(x)) if x in df.columns else F.lit("") for x in CLEANED}
    columns |= {} if "flags" in df.columns else {"flags": F.lit("")}
    return df.withColumns(columns)


VALID = "date IS NOT NULL AND amount IS NOT NULL"


def drop_stats(df: DataFrame) -> DataFrame:
    """One row ``total, dropped`` for a typed table."""
    return df.agg(F.count(F.lit(1)).alias("total"), F.count_if(~F.expr(VALID)).alias("dropped"))


def normalise(
    df: DataFrame,
    mapping: Mapping[str, Any] | None = None,
    locale: Locale = Locale(),
    fail_threshold: float = 0.01,
    strict: bool = False,
    number_rows: bool = False,
) -> DataFrame:
    """The canonical ledger: only rows with a date and an amount.

    An error if more than ``fail_threshold`` of the rows are dropped, or any with ``strict``; that takes one action, a count
    over two columns. ``number_rows`` adds a dense ``_row_id`` after the drop.
    """
    ledger = typed(synthesise_amount(canonical_headers(df, mapping), locale), locale)
    found = drop_stats(ledger).first()
    if found.total and found.dropped / found.total > (0.0 if strict else fail_threshold):
        raise DropRateError(f"{found.dropped} of {found.total} rows have no valid date or amount")
    valid = ledger.where(VALID)
    return with_row_ids(valid.drop("_row_id")) if number_rows else valid
