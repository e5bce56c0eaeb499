"""Find counterparties that no rule covers, and draft rules for them."""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.text import present, strip, with_fingerprint

EXCLUDED = ("true", "1", "yes")


def uncategorised(df: DataFrame, include_excluded: bool = False) -> Column:
    open_ = strip(present(F.col("category"))) == ""
    if include_excluded or "exclude" not in df.columns:
        return open_
    return open_ & ~F.lower(strip(present(F.col("exclude")))).isin(*EXCLUDED)


def discover_all(df: DataFrame, since: str | None = None, include_excluded: bool = False, key: str = "_row_id") -> DataFrame:
    """A row per fingerprint of the uncategorised rows, with count, latest date, largest and total amount and an example.

    The example is that of the latest date, then of the largest amount, then of the first row. Rows are summed up by
    counterparty before fingerprints are made, so accents are folded once per name and partial sums carry little.
    """
    rows = df.where(uncategorised(df, include_excluded))
    if since:
        rows = rows.where(F.col("date") >= F.to_timestamp_ntz(F.lit(since)))
    absolute = F.abs("amount")
    first = F.struct(F.col("date").isNotNull().alias("dated"), "date", absolute.alias("size"), (-F.col(key)).alias("first"))
    by_name = rows.groupBy(present(F.col("counterparty")).alias("counterparty")).agg(
        F.count(F.lit(1)).alias("n"),
        F.max("date").alias("last"),
        F.max(absolute).alias("most"),
        F.sum(F.col("amount").cast("decimal(38,4)")).alias("total"),
        F.max(F.struct(*(first[f] for f in ("dated", "date", "size", "first")), "amount")).alias("best"),
    )
    named = with_fingerprint(by_name, "counterparty", "fingerprint").where("fingerprint <> ''")
    example = F.max(F.struct("best", "counterparty"))
    found = named.groupBy("fingerprint").agg(F.sum("n").alias("count"), F.max("last").alias("last"), F.max("most").alias("max_abs_amount"), F.sum("total").alias("total"), example.alias("e"))
    day = lambda c: F.date_format(c, "yyyy-MM-dd")
    return found.select(
        F.col("fingerprint").alias("counterparty_fingerprint"),
        F.col("e.counterparty").alias("example_counterparty_name"),
        F.col("count"),
        day(F.col("last")).alias("last_seen_date"),
        "max_abs_amount",
        F.col("total").cast("double").alias("total_value"),
        F.col("e.best.amount").alias("sample_amount"),
        day(F.col("e.best.date")).alias("sample_date"),
    )


def candidates(every: DataFrame, min_count: int = 5, min_amount: float | None = None, top_k: int | None = None) -> DataFrame:
    """The shortlist of :func:`discover_all`, most frequent first, ties by fingerprint."""
    keep = F.col("count") >= min_count
    if min_amount is not None:
        keep = keep | (F.col("max_abs_amount") >= min_amount)
    out = every.where(keep).select("counterparty_fingerprint", "example_counterparty_name", "count", "sample_amount", "sample_date")
    out = out.orderBy(F.desc("count"), "counterparty_fingerprint")
    return out if top_k is None else out.limit(top_k)


#: Words of company names that would match too much, and what isn't kept in words and titles.
STOPWORDS = ("LTD", "LLC", "PLC", "INC", "GROUP", "COMPANY", "CO", "SAS", "GMBH", "CORP")
NOT_WORD, NOT_TITLE = r"[^A-Z0-9&]+", r"[^A-Z0-9&_ '-]+"
#: Column names under which candidates come, by what they are.
ALIASES = {
    "fingerprint": ("counterparty_fingerprint", "fingerprint"),
    "example": ("example_counterparty_name", "example_name", "example"),
    "count": ("count", "freq", "frequency"),
    "last": ("last_seen_date", "sample_date", "last_seen", "last"),
    "amount": ("sample_amount", "amount"),
}


@dataclass(frozen=True)
class Draft:
    title: str
    condition: str
    text: str


def read_candidate(row: Mapping[str, object]) -> dict[str, str]:
    """A candidate's parts as text, whatever the case and alias of their names."""
    low = {str(k).strip().lower(): "" if v is None else str(v) for k, v in row.items()}
    return {part: next((low[a] for a in names if a in low), "").strip() for part, names in ALIASES.items()}


def pattern_word(name: str) -> str | None:
    """The longest word, of 3 or more letters, digits or &, to match a counterparty by; ties by alphabet."""
    words = [w for w in re.split(NOT_WORD, name.upper()) if len(w) >= 3 and not w.isdigit() and re.search(r"[A-Z0-9]", w)]
    words = [w for w in words if w not in STOPWORDS] or words
    return min(words, key=lambda w: (-len(w), w), default=None)


def title_of(name: str) -> str:
    """An upper-case title of at most 64 characters."""
    return re.sub(r"\s+", " ", re.sub(NOT_TITLE, " ", name.upper())).strip()[:64] or "CANDIDATE"


def known_patterns(text: str) -> tuple[list[str], list[str]]:
    """The wildcard and the exact counterparties that a rule text already has."""
    find = lambda op: [m[2] for m in re.finditer(rf"counterparty\s*{op}\s*(['\"])(.*?)['\"]", text, re.I | re.S)]
    return find("~"), find("==")


def _covered(kind: str, value: str, wild: Iterable[str], exact: set[str]) -> bool:
    cores = [(p, p.strip("*")) for p in wild]
    if kind == "exact":
        return value.lower() in exact or any(core and core.lower() in value.lower() for _, core in cores)
    own = value.strip("*")
    return any(value == p or (own and core and (core in value or own in p)) for p, core in cores)


def suggest(found: Iterable[Mapping[str, object]], prefix: str = "Suggested", category: str = "Review", existing: str = "", kind: str = "fuzzy", quote: str = '"') -> list[Draft]:
    """Draft rules for candidates that no rule of ``existing`` covers. Fuzzy ones match a word, exact ones the example.

    A shortlist is small by its nature, so this works on its rows; each pattern is drafted once.
    """
    wild, exact = known_patterns(existing)
    names, drafts, seen = {x.lower() for x in exact}, [], set()
    escape = lambda s: s.replace(quote, f"\\{quote}")
    for row in map(read_candidate, found):
        if not row["fingerprint"] or not row["example"]:
            continue
        word = row["example"] if kind == "exact" else pattern_word(row["example"]) or pattern_word(row["fingerprint"])
        if not word:
            continue
        value = word if kind == "exact" else f"*{word}*"
        if _covered(kind, value, wild, names) or (kind != "exact" and value in seen):
            continue
        seen.add(value)
        title = f"{prefix}: {title_of(word) if kind == 'exact' else word}"
        condition = f"counterparty {'==' if kind == 'exact' else '~'} {quote}{escape(value)}{quote}"
        facts = [f"{label}={row[part]}" for label, part in (("freq", "count"), ("last", "last"), ("sample_amt", "amount")) if row[part]]
        head = "# SUGGESTED" + (f" ({', '.join(facts)})" if facts else "")
        body = [head, f"# Example: {row['example']}", f"# Fingerprint: {row['fingerprint']}", f"rule {quote}{escape(title)}{quote} {{", "  match:", f"    - {condition}", "  set:", f"    - category = {quote}{escape(category)}{quote}", "}", ""]
        drafts.append(Draft(title, condition, "\n".join(body)))
    return drafts
