"""Reconcile a categorised ledger with an external system, by position or by a composite key."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.functions.text import amount_2dp, java_format, parse_date, present, strip, to_number, unguarded

CONTEXT = ("date", "amount", "counterparty", "memo")
ORPHAN = (*CONTEXT, "category")
#: Fixed value: a date in local order.
LOCAL_DATE = r"^\s*(\d{1,2})[/.\-](\d{1,2})[/.\-](\d{2,4})\s*$"
EXAMPLES, REASON = 5, 200


class ReconcileError(ValueError):
    """Two sides that can't be compared."""


class IdentityError(ReconcileError):
    """Rows in the same place that aren't the same transaction; ``failures`` has them all."""

    def __init__(self, message: str, failures: DataFrame):
        super().__init__(message)
        self.failures = failures


@dataclass(frozen=True)
class DateConvention:
    mode: str  # explicit, inferred, assumed or not_applicable
    dayfirst: bool = False
    ambiguous_values: int = 0
    evidence: str | None = None


def is_ambiguous_date(text: Column) -> Column:
    """True for d/m/y texts that could be read either way."""
    part = lambda k: F.regexp_extract(text, LOCAL_DATE, k).try_cast("int")
    return F.coalesce(text.rlike(LOCAL_DATE) & (part(1) <= 12) & (part(2) <= 12), F.lit(False))


def date_evidence(df: DataFrame, column: str = "date", key: str = "_row_id") -> DataFrame:
    """One row about a text column: how many values are day-first, month-first or ambiguous, and the first of each kind."""
    part = lambda k: F.regexp_extract("text", LOCAL_DATE, k)
    rows = df.select(F.col(key).alias("key"), strip(present(F.col(column))).alias("text"))
    rows = rows.select("key", "text", part(1).alias("one"), part(2).alias("two"))  # empty where the text is no such date
    rows = rows.where("one <> ''").select("key", "text", F.col("one").cast("int").alias("one"), F.col("two").cast("int").alias("two"))
    kinds = {"day_first": F.col("one") > 12, "month_first": (F.col("one") <= 12) & (F.col("two") > 12), "ambiguous": (F.col("one") <= 12) & (F.col("two") <= 12)}
    counts = [F.count_if(hit).alias(name) for name, hit in kinds.items()]
    examples = [F.min_by(F.when(kinds[k], F.col("text")), F.when(kinds[k], F.col("key"))).alias(f"{k}_example") for k in ("day_first", "month_first")]
    return rows.agg(*counts, *examples)


def infer_dates(df: DataFrame, column: str = "date", key: str = "_row_id") -> DateConvention:
    """The convention of a whole column; two conventions in one column are an error, and no evidence means month-first."""
    e = date_evidence(df, column, key).first()
    if e.day_first and e.month_first:
        raise ReconcileError(f"dates of both kinds: {e.day_first_example!r} is day-first, {e.month_first_example!r} is month-first")
    if e.day_first or e.month_first:
        return DateConvention("inferred", bool(e.day_first), e.ambiguous, e.day_first_example if e.day_first else e.month_first_example)
    return DateConvention("assumed" if e.ambiguous else "not_applicable", False, e.ambiguous)


def check_date_format(df: DataFrame, fmt: str, column: str = "date", key: str = "_row_id") -> DateConvention:
    """An error unless every date that isn't empty is of the format; it names the first row that isn't."""
    java_format(fmt)
    text = strip(present(F.col(column)))
    found = df.where(text != "").agg(F.count(F.lit(1)).alias("n"), F.min_by(F.struct(F.col(key).alias("row"), text.alias("text")), F.when(parse_date(text, fmt=fmt).isNull(), F.col(key))).alias("bad")).first()
    if not found.n:
        raise ReconcileError(f"the date format {fmt!r} was given, but there are no dates")
    if found.bad is not None:
        raise ReconcileError(f"the date format {fmt!r} does not read {found.bad.text!r} (row {found.bad.row + 1})")
    return DateConvention("explicit", False, 0, fmt)


def field_key(df: DataFrame, field: str, convention: DateConvention | None = None) -> Column:
    """A field as it is compared in keys and identities: amounts to two places, dates as ISO, other text in lower case."""
    column = next((c for c in df.columns if c.lower() == field.lower()), None)
    if column is None:
        raise ReconcileError(f"no column {field!r}")
    value, kind = F.col(f"`{column}`"), df.schema[column].dataType
    if isinstance(kind, T.IntegralType) and field.lower() != "amount":
        return present(value)
    text = strip(present(value))
    if field.lower() == "amount":
        number = value.cast("double") if isinstance(kind, T.NumericType) else to_number(value)
        return F.coalesce(amount_2dp(number.cast("decimal(38,4)")) if isinstance(kind, T.NumericType) else F.when(number.isNotNull(), amount_2dp(number)), text)
    if field.lower() == "date":
        if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
            return present(F.date_format(value, "yyyy-MM-dd"))
        fmt = convention.evidence if convention and convention.mode == "explicit" else None
        return F.coalesce(F.date_format(parse_date(text, bool(convention and convention.dayfirst), fmt), "yyyy-MM-dd"), text)
    return F.lower(strip(unguarded(text)))


def _keyed(df: DataFrame, fields: Sequence[str], convention: DateConvention | None = None) -> DataFrame:
    return df.select("*", *(field_key(df, f, convention).alias(f"_key_{k}") for k, f in enumerate(fields)))


def _names(fields: Sequence[str]) -> list[str]:
    return [f"_key_{k}" for k in range(len(fields))]


def duplicate_keys(df: DataFrame, fields: Sequence[str], convention: DateConvention | None = None) -> DataFrame:
    """Composite keys that are on more than one row, with their number ``n``."""
    keyed = _keyed(df, fields, convention).groupBy(*_names(fields)).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return keyed.select(*(F.col(k).alias(f) for k, f in zip(_names(fields), fields, strict=True)), "n")


def _require(df: DataFrame, fields: Sequence[str], side: str) -> None:
    if gone := [f for f in fields if f.lower() not in {c.lower() for c in df.columns}]:
        raise ReconcileError(f"the {side} side has no column {', '.join(gone)}")


def _resolved(df: DataFrame, field: str) -> Column:
    column = next((c for c in df.columns if c.lower() == field.lower()), None)
    if column is None:
        return F.lit("")
    value = F.col(f"`{column}`")
    return present(F.date_format(value, "yyyy-MM-dd") if isinstance(df.schema[column].dataType, (T.DateType, T.TimestampType, T.TimestampNTZType)) else value)


def _sides(left: DataFrame, right: DataFrame, keys: list[str], fields: Sequence[str], row: str) -> tuple[DataFrame, DataFrame]:
    rule = [_resolved(left, c).alias(f"l_{c}") for c in ("rule", "reason")]
    wanted = dict.fromkeys([*CONTEXT, "category", *fields])
    side = lambda df, mark, more: df.select(*keys, F.col(row).alias(f"{mark}_row"), *(_resolved(df, f).alias(f"{mark}_{f}") for f in wanted), *more)
    return side(left, "l", rule), side(right, "r", [])


def _mismatches(pairs: DataFrame, fields: Sequence[str]) -> DataFrame:
    differ = [F.when(F.col(f"l_{f}") != F.col(f"r_{f}"), F.lit(f)) for f in fields]
    return pairs.where(F.coalesce(*differ).isNotNull()).select(
        (F.col("l_row") + 1).alias("row_number"),
        *(F.col(f"l_{f}").alias(f) for f in CONTEXT),
        F.concat_ws(",", *differ).alias("differing_fields"),
        F.col("l_rule").alias("rule_matched"),
        F.substring("l_reason", 1, REASON).alias("audit_reason"),
        *(c for f in fields for c in (F.col(f"r_{f}").alias(f"external_{f}"), F.col(f"l_{f}").alias(f"ledger_{f}"))),
    )


def _orphans(rows: DataFrame, mark: str) -> DataFrame:
    return rows.select((F.col(f"{mark}_row") + 1).alias("row_number"), *(F.col(f"{mark}_{f}").alias(f) for f in ORPHAN))


@dataclass(frozen=True)
class Reconciliation:
    """Frames of what differs; nothing is collected until counts are asked for."""

    compared: DataFrame
    mismatches: DataFrame
    orphans_left: DataFrame | None
    orphans_right: DataFrame | None
    alignment: str
    dates: DateConvention
    fields: tuple[str, ...]

    def counts(self) -> DataFrame:
        """One row: rows compared, mismatches, orphans of either side, and the rate of matches in percent, 100 of none."""
        differ = F.lit(False)
        for f in self.fields:
            differ = differ | (F.col(f"l_{f}") != F.col(f"r_{f}"))
        parts = [self.compared.agg(F.count(F.lit(1)).alias("rows_compared"), F.count_if(differ).alias("mismatches"))]
        for df, name in ((self.orphans_left, "orphans_left"), (self.orphans_right, "orphans_right")):
            parts.append(df.agg(F.count(F.lit(1)).alias(name)) if df is not None else self.compared.limit(0).agg(F.count(F.lit(1)).alias(name)))
        rate = F.when(F.col("rows_compared") > 0, F.round(100.0 * (F.col("rows_compared") - F.col("mismatches")) / F.col("rows_compared"), 2)).otherwise(F.lit(100.0))
        one, two, three = parts  # a row each
        return one.crossJoin(two).crossJoin(three).withColumn("match_rate", rate)

    def summary(self) -> dict[str, object]:
        found = self.counts().first()
        n, wrong = found.rows_compared, found.mismatches
        lost = [found.orphans_left, found.orphans_right]
        return {"success": not (wrong or any(lost)), "rows_compared": n, "matches": n - wrong, "mismatches": wrong, "match_rate": found.match_rate, "orphans_left": lost[0], "orphans_right": lost[1], "alignment_mode": self.alignment, "date_convention": self.dates.__dict__}


def check_unique(left: DataFrame, right: DataFrame, keys: Sequence[str], dates: DateConvention | None = None) -> None:
    """An error if a key is on several rows of a side; one pass over the key columns of both."""
    names = _names(keys)
    side = lambda df, how, mark: _keyed(df, keys, how).select(*names, F.lit(mark).alias("_right"))
    both = side(left, None, 0).unionByName(side(right, dates, 1))
    counted = both.groupBy(*names).agg(F.sum(1 - F.col("_right")).alias("l"), F.sum("_right").alias("r"))
    twice = counted.where("l > 1 OR r > 1").limit(EXAMPLES).collect()
    for name, mark in (("ledger", "l"), ("external", "r")):
        if found := [x for x in twice if x[mark] > 1]:
            shown = "; ".join(f"{tuple(x[k] for k in names)!r} on {x[mark]} rows" for x in found)
            raise ReconcileError(f"keys of the {name} side are not unique: {shown}")


def reconcile(
    left: DataFrame,
    right: DataFrame,
    fields: Sequence[str] = ("category",),
    keys: Sequence[str] | None = None,
    identity: Sequence[str] | None = None,
    date_format: str | None = None,
    row: str = "_row_id",
) -> Reconciliation:
    """Compares ``fields`` as they are written, row by row.

    Without ``keys`` row n is compared with row n, and unequal numbers of rows are an error; ``identity`` first makes sure
    that rows in the same place are the same transaction. With ``keys`` rows meet by their canonical key, a key on several
    rows of a side is an error, and rows without a partner are orphans. ``left`` may have ``rule`` and ``reason`` columns.
    """
    if not fields:
        raise ReconcileError("no field to compare")
    if identity and keys:
        raise ReconcileError("identity guards positions and keys replace them; give one of them")
    for df, side in ((left, "ledger"), (right, "external")):
        _require(df, [*fields, *(keys or ()), *(identity or ())], side)
    dates = DateConvention("not_applicable")
    if "date" in {f.lower() for f in (keys or identity or ())} and isinstance(right.schema[next(c for c in right.columns if c.lower() == "date")].dataType, T.StringType):
        dates = check_date_format(right, date_format, key=row) if date_format else infer_dates(right, key=row)
    if keys:
        check_unique(left, right, keys, dates)
        names = _names(keys)
        a, b = _sides(_keyed(left, keys), _keyed(right, keys, dates), names, fields, row)
        pairs = a.join(b, names)
        only = lambda one, other, mark: _orphans(one.join(other.select(*names), names, "left_anti"), mark)
        return Reconciliation(pairs, _mismatches(pairs, fields), only(a, b, "l"), only(b, a, "r"), "key:" + ",".join(keys), dates, tuple(fields))
    n, m = left.count(), right.count()
    if n != m:
        raise ReconcileError(f"the sides have {n} and {m} rows; rows can't be compared by position")
    if identity:
        a, b = (_keyed(df, identity, how).select(F.col(row), *_names(identity), *(_resolved(df, f).alias(f"_raw_{k}") for k, f in enumerate(identity))) for df, how in ((left, None), (right, dates)))
        a, b = a.toDF(row, *(f"{c}_l" for c in a.columns[1:])), b.toDF(row, *(f"{c}_r" for c in b.columns[1:]))
        differ = [F.when(~F.col(f"_key_{k}_l").eqNullSafe(F.col(f"_key_{k}_r")), F.lit(f)) for k, f in enumerate(identity)]
        failures = a.join(b, row).where(F.coalesce(*differ).isNotNull())
        failures = failures.select((F.col(row) + 1).alias("row_number"), F.concat_ws(",", *differ).alias("differing_identity_fields"), *(c for k, f in enumerate(identity) for c in (F.col(f"_raw_{k}_l").alias(f"ledger_{f}"), F.col(f"_raw_{k}_r").alias(f"external_{f}"))))
        if not failures.isEmpty():
            wrong = failures.count()
            raise IdentityError(f"{wrong} of {n} rows are not the same transaction on both sides; compare by key", failures)
    a, b = _sides(left, right, [], fields, row)
    pairs = a.join(b, F.col("l_row") == F.col("r_row"))
    return Reconciliation(pairs, _mismatches(pairs, fields), None, None, "positional", dates, tuple(fields))
