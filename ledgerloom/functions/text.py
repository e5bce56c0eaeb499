"""Column functions over text, amounts and dates. All stay in the JVM but for the folding of accents."""

from __future__ import annotations

import unicodedata
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.shipping import ship

#: Control and format characters that text fields lose; currency signs and hard spaces that amounts lose.
CONTROLS = r"[\x00-\x1F\x7F-\x9F\u200B-\u200D\u2028\u2029\uFEFF]"
CURRENCY = r"[£€$¥₹\u00A0\u202F]"
SIGNS = "£€$¥₹\u00A0\u202F"
#: Endings that mark credits and debits, and leads that a spreadsheet would take for a formula.
CREDIT, DEBIT = r"(?:CR|CRED|CREDIT)\.?\s*$", r"(?:DR|DEB|DEBIT)\.?\s*$"
DANGER = r"^ *[=+\-@\t]"
#: Texts that stand for a missing value in CSV files.
MISSING = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")
BLANK = r"[\s\x1C-\x1F]"
NUMERIC = r"^[+-]?(?:\d+(?:\.\d*)?|\.\d+)(?:[eE][+-]?\d+)?$"
INFINITE = r"^[+-]?inf(?:inity)?$"


def present(text: Column) -> Column:
    """Null becomes the empty text."""
    return F.coalesce(text.cast("string"), F.lit(""))


def strip(text: Column) -> Column:
    """Without white space, of any kind, at either end."""
    return F.regexp_replace(text, rf"(?U)^{BLANK}+|{BLANK}+$", "")


def hygiene(text: Column) -> Column:
    """A text field without control characters and white space at its ends; null becomes empty. Clean texts are only looked at."""
    found = present(text)
    return F.when(found.rlike(rf"(?U)^{BLANK}|{BLANK}$|{CONTROLS}"), strip(F.regexp_replace(found, CONTROLS, ""))).otherwise(found)


def missing_to_null(text: Column) -> Column:
    """CSV texts that stand for a missing value become null."""
    return F.when(~text.isin(*MISSING), text)


def to_number(text: Column, decimal: str = ".", thousands: str | None = None) -> Column:
    """An amount as a double, null if it isn't one.

    In this order: trim; the minus sign U+2212 becomes -; a minus at the end moves to the front; a credit or debit ending
    is noted and dropped; (x) becomes -x; ``thousands`` and currency signs go; ``decimal`` becomes a point. A debit is then
    negative, a credit positive. Without ``thousands`` a text such as 1,234.56 is not a number.
    """
    raw = text.cast("string")

    def written(s: Column) -> Column:
        """The amount of a text that has more than signs, thousands and currencies about it."""
        n = F.regexp_replace(F.regexp_replace(s, rf"(?i)\s*{CREDIT}", ""), rf"(?i)\s*{DEBIT}", "")
        n = F.regexp_replace(n, r"(?s)^\((.*)\)$", "-$1")
        if thousands:
            n = F.replace(n, F.lit(thousands), F.lit(""))
        n = F.regexp_replace(n, CURRENCY, "")
        if decimal and decimal != ".":
            n = F.replace(n, F.lit(decimal), F.lit("."))
        n = F.regexp_replace(strip(n), r"^-\s+", "-")
        value = F.regexp_extract(n, rf"(?i){NUMERIC}|{INFINITE}", 0).try_cast("double")
        marked = lambda v: F.when(F.upper(s).rlike(CREDIT), F.abs(v)).when(F.upper(s).rlike(DEBIT), -F.abs(v)).otherwise(v)
        return bound(value, marked)

    slow = bound(F.regexp_replace(F.translate(strip(raw), "\u2212", "-"), r"(?s)^(.*)-$", "-$1"), written)
    decimal = decimal or "."
    if not all(c in ".,;:'_ \u00A0\u202F" for c in decimal + (thousands or "")) or decimal == thousands:
        return slow
    # most amounts are plain numbers once these characters are gone, whatever the order of the steps above
    gone = "".join(c for c in f"{SIGNS}{thousands or ''}" if c != decimal)
    swap = "\u2212" + (decimal if decimal != "." else "")
    simple = F.trim(F.translate(raw, swap + gone, "-" + ("." if decimal != "." else "")))
    return F.when(simple.rlike(NUMERIC), simple.try_cast("double")).otherwise(slow)


def bound(value: Column, then) -> Column:
    """``then(value)`` with the value made once, however often it is used; keeps generated code small."""
    return F.transform(F.array(value), then)[0]


MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")

#: Strftime directives and their Java patterns.
DIRECTIVES = {"%Y": "yyyy", "%y": "yy", "%m": "M", "%d": "d", "%H": "H", "%I": "h", "%M": "m", "%S": "s", "%f": "SSSSSS", "%b": "MMM", "%B": "MMMM", "%p": "a", "%%": "%"}


def java_format(fmt: str) -> str:
    """A strftime format as a Java pattern; letters outside directives are quoted."""
    out, at = "", 0
    while at < len(fmt):
        if fmt[at] == "%":
            if fmt[at : at + 2] not in DIRECTIVES:
                raise ValueError(f"{fmt!r} is not a valid date format")
            out, at = out + DIRECTIVES[fmt[at : at + 2]], at + 2
        else:
            out, at = out + (f"'{fmt[at]}'" if fmt[at].isalpha() else fmt[at]), at + 1
    return out


def parse_date(text: Column, dayfirst: bool = False, fmt: str | None = None) -> Column:
    """A timestamp without a zone, null if the text isn't a date.

    With ``fmt`` (strftime) only that format holds. Otherwise years in front are ISO, and never swapped; then d/m/y or m/d/y
    by ``dayfirst``, and the other one where a part above 12 leaves no choice. Years of two digits are 1969 to 2068. A zone is
    dropped. Texts are rewritten and cast, which costs no exceptions for what doesn't fit.
    """
    s = strip(text.cast("string"))
    if fmt:
        return F.try_to_timestamp(s, F.lit(java_format(fmt))).cast("timestamp_ntz")
    s = F.regexp_replace(s, r"^(.*\d:\d{2}(?:\.\d+)?)\s*(?:Z|[+-]\d{2}:?\d{2})$", "$1")
    for years, century in ((r"69|[7-9]\d", "19"), (r"[0-5]\d|6[0-8]", "20")):
        s = F.regexp_replace(s, rf"^(\d{{1,2}}[/.\-]\d{{1,2}}[/.\-])({years})(?=[ T]|$)", f"$1{century}$2")
    clock = r"((?:[ T]\d{1,2}:\d{2}.*)?)$"
    local = rf"^(\d{{1,2}})[/.\-](\d{{1,2}})[/.\-](\d{{4}}){clock}"
    cast = lambda pattern, order: F.regexp_replace(s, pattern, order).try_cast("timestamp_ntz")
    iso = cast(rf"^(\d{{4}})[-/]?(\d{{1,2}})[-/]?(\d{{1,2}}){clock}", "$1-$2-$3$4")
    day, month = cast(local, "$3-$2-$1$4"), cast(local, "$3-$1-$2$4")
    spelled = r"^(\d{1,2})[ -]([A-Za-z]{3,9})[ -](\d{4})$"
    word = F.regexp_replace(s, r"^([A-Za-z]{3,9}) (\d{1,2}),? (\d{4})$", "$2 $1 $3")
    at = F.array_position(F.lit([*MONTHS, *(m[:3] for m in MONTHS)]), F.lower(F.regexp_extract(word, spelled, 2)))
    number = F.when(at > 0, F.pmod(at - 1, F.lit(12)) + 1).cast("string")
    named = F.concat(F.regexp_extract(word, spelled, 3), F.lit("-"), number, F.lit("-"), F.regexp_extract(word, spelled, 1)).try_cast("timestamp_ntz")
    found = F.when(s.rlike(r"^\d{4}(?:[-/]\d{1,2}[-/]\d{1,2}|\d{4})(?:[ T]|$)"), iso)
    return found.when(s.rlike(local), F.coalesce(day, month) if dayfirst else F.coalesce(month, day)).when(s.rlike("[A-Za-z]{3}"), named)


def amount_2dp(amount: Column) -> Column:
    """A number as text with two places, rounded half up in decimal; other text is only stripped."""
    number = F.when(present(amount).rlike(NUMERIC), amount.try_cast("decimal(38,2)"))
    return F.coalesce(number.cast("string"), strip(present(amount)))


def float_text(x: Column) -> Column:
    """A double as Python writes it: 1e7 is 10000000.0; up to 1e16 without an exponent."""
    whole = F.concat(x.try_cast("bigint").cast("string"), F.lit(".0"))
    plain = F.regexp_replace(x.try_cast("decimal(38,17)").cast("string"), r"(\.\d+?)0+$", "$1")
    return F.when((x == F.floor(x)) & (F.abs(x) < 1e16), whole).when((F.abs(x) >= 1e-4) & (F.abs(x) < 1e16), plain).otherwise(F.lower(x.cast("string")))


def sha16(*parts: Column) -> Column:
    """The first 16 hex digits of the SHA-256 of the parts, joined by |."""
    return F.substring(F.sha2(F.concat_ws("|", *parts).cast("binary"), 256), 1, 16)


def guarded(text: Column) -> Column:
    """A quote before what a spreadsheet would take for a formula; null stays null."""
    return F.when(text.rlike(DANGER) & ~text.startswith("'"), F.concat(F.lit("'"), text)).otherwise(text)


def unguarded(text: Column) -> Column:
    """The inverse of :func:`guarded`."""
    rest = text.substr(F.lit(2), F.length(text))
    return F.when(text.startswith("'") & rest.rlike(DANGER), rest).otherwise(text)


def tokens(text: Column) -> Column:
    """The distinct tokens of a text, in order."""
    return F.array_distinct(F.filter(F.split(present(text), rf"(?U){BLANK}+"), lambda x: x != ""))


def _plain_fingerprint(text: Column) -> Column:
    upper = F.upper(F.regexp_replace(present(text), CONTROLS, ""))
    return strip(F.regexp_replace(F.regexp_replace(upper, r"[^A-Z0-9\s]", " "), r"\s+", " "))


def folded(text: str) -> str:
    """Compatibility forms resolved, accents and all else beyond ASCII dropped."""
    return unicodedata.normalize("NFKD", text).encode("ascii", "ignore").decode()


def with_fingerprint(df: DataFrame, column: str, name: str) -> DataFrame:
    """Adds a counterparty's fingerprint: accents folded, upper case, only letters, digits and single spaces.

    One column over one scan: names beyond ASCII are folded in Arrow batches, for the others nothing is sent.
    """
    ship(df.sparkSession)
    fold = F.pandas_udf(_fold, "string")
    source = F.regexp_replace(present(F.col(column)), CONTROLS, "")
    other = F.when(F.length(source) != F.octet_length(source), source)
    return df.withColumn(name, _plain_fingerprint(F.coalesce(fold(other), F.col(column))))


def _fold(series: pd.Series) -> pd.Series:
    return series.map(folded, na_action="ignore")


def all_of(columns: Sequence[Column]) -> Column:
    found = F.lit(True)
    for column in columns:
        found = found & column
    return found
