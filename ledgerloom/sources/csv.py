"""CSV sources and sinks: encoding and delimiter picks, header checks, header maps, and guarded writing.

A sample of at most ``SAMPLE`` bytes, of as many files as that takes, is looked at on the driver, through Hadoop's file systems, so any
store that Spark reads will do. The delimiter comes from the sample. So do the encoding and whether quoted fields hold line ends if
the sample is all there is; else many tasks look at every line of every file for these. All columns are read as text; types
come from the normaliser.
"""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.functions.text import guarded, missing_to_null

#: Encodings in order of trial; sampled bytes and lines; agreement and preference of delimiters.
ENCODINGS = ("utf-8-sig", "cp1252", "latin-1")
SAMPLE, LINES, STRICT_LINES, AGREE, PREFER = 65536, 50, 200, 0.9, 1.2
#: What ISO-8859-1, which Spark reads, has for the bytes that cp1252 gives other characters, and these.
_OWN = [b for b in range(0x80, 0xA0) if bytes([b]).decode("cp1252", "ignore")]
WESTERN = ("".join(map(chr, _OWN)), bytes(_OWN).decode("cp1252"))
NOT_WESTERN = "[" + "".join(f"\\x{b:02X}" for b in range(0x80, 0xA0) if b not in _OWN) + "]"
DELIMITERS = (";", ",", "\t", "|")
CORRUPT = "_corrupt_record"


class SourceError(ValueError):
    """A file whose structure can't be trusted."""


def head(spark: SparkSession, path: str, size: int = SAMPLE) -> tuple[bytes, bool]:
    """The first bytes of the files of ``path``, each file on lines of its own, and whether these are all."""
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    store = where.getFileSystem(spark._jsc.hadoopConfiguration())
    if not store.exists(where):
        raise SourceError(f"{path} does not exist")
    files = [store.getFileStatus(where)]
    if files[0].isDirectory():
        files = [s for s in store.listStatus(where) if s.isFile() and not s.getPath().getName().startswith(("_", "."))]
        if not files:
            raise SourceError(f"{path} holds no file")
    found = b""
    for file in sorted((s.getPath() for s in files if s.getLen()), key=lambda x: str(x.toString())):
        if found and not found.endswith(b"\n"):
            found += b"\n"
        stream = store.open(file)
        try:
            found += bytes(stream.readNBytes(size + 1 - len(found)))
        finally:
            stream.close()
        if len(found) > size:
            return found[:size], False
    return found, True


def pick_encoding(sample: bytes, whole: bool = False) -> str:
    """The first of the encodings that reads the sample; a character cut at its end doesn't count, unless the sample is the ``whole``."""
    for encoding in ENCODINGS:
        try:
            sample.decode(encoding)
        except UnicodeDecodeError as error:
            if encoding != "utf-8-sig" or whole or error.reason != "unexpected end of data":
                continue
        return encoding
    return ENCODINGS[0]


def pick_delimiter(text: str) -> str | None:
    """The delimiter of a sample by counts; semicolons win over commas where they are 1.2 times as many."""
    lines = [x for x in text.splitlines() if x.strip()][:LINES]
    n = {d: sum(x.count(d) for x in lines) for d in DELIMITERS}
    if n[";"] and n[";"] >= int(n[","] * PREFER):
        return ";"
    for one in ("\t", "|"):
        if n[one] > max(n[d] for d in DELIMITERS if d != one):
            return one
    if n[","] and n[","] >= max(n[d] for d in DELIMITERS):
        return ","
    return ";" if n[";"] else None


def check_delimiter(text: str, delimiter: str) -> None:
    """An error unless 9 of 10 sampled lines have the usual number of delimiters."""
    counts = Counter(x.count(delimiter) for x in [x for x in text.splitlines() if x.strip()][:STRICT_LINES])
    if counts and counts.most_common(1)[0][1] < AGREE * counts.total():
        raise SourceError(f"lines differ in their number of {delimiter!r}")


def check_headers(names: Sequence[str]) -> list[str]:
    """What is wrong with header names: empty or repeated ones."""
    low = [x.strip().lower() for x in names]
    found = [f"column {k + 1} has no name" for k, x in enumerate(low) if not x]
    return found + [f"column name {x!r} is repeated" for x, n in Counter(low).items() if n > 1 and x]


def looked_through(spark: SparkSession, path: str) -> tuple[bool, str]:
    """Whether a quoted field holds a line end: then some line has an odd number of quotes; and the encoding that reads every line."""
    rows = spark.read.text(path).select("value", F.decode(F.col("value").cast("binary"), "ISO-8859-1").alias("bytes"))
    quotes = F.length("bytes") - F.length(F.translate("bytes", '"', ""))
    any_of = lambda c: F.coalesce(F.bool_or(c), F.lit(False))
    odd, other, beyond = rows.select(any_of(quotes % 2 == 1), any_of(~F.is_valid_utf8("value")), any_of(F.col("bytes").rlike(NOT_WESTERN))).first()
    return odd, ENCODINGS[0] if not other else ENCODINGS[2] if beyond else ENCODINGS[1]


@dataclass(frozen=True)
class CsvOptions:
    delimiter: str | None = None
    encoding: str | None = None
    strict: bool = False
    missing: bool = True  # texts such as NA and null are missing values
    ragged: str = "drop"  # rows with another number of fields: "drop", "error", or "keep" what fits the header
    multiline: bool | None = None  # whether quoted fields hold line ends, so a file is one task; None: looked for


def read_csv(spark: SparkSession, path: str, options: CsvOptions = CsvOptions(), order: bool = False) -> DataFrame:
    """The file, or folder of files, with all columns as text; ``order`` adds ``_row_id``, dense, in the order of the file.

    A row with too many or too few fields is dropped, or an error that shows the first one.
    """
    sample, whole = head(spark, path)
    multiline, encoding = options.multiline, options.encoding
    if multiline is None or encoding is None:
        seen = (any(x.count(b'"') % 2 for x in sample.splitlines()), pick_encoding(sample, True)) if whole else looked_through(spark, path)
        multiline, encoding = seen[0] if multiline is None else multiline, encoding or seen[1]
    text = sample.decode(encoding, errors="ignore")
    delimiter = options.delimiter or pick_delimiter(text) or ","
    if options.strict:
        check_delimiter(text, delimiter)
    java = {"utf-8-sig": "UTF-8", "cp1252": "ISO-8859-1", "latin-1": "ISO-8859-1"}.get(encoding, encoding)
    western = (lambda c: F.translate(c, *WESTERN)) if encoding == "cp1252" else lambda c: c
    reader = spark.read.option("header", True).option("sep", delimiter).option("encoding", java).option("quote", '"').option("escape", '"').option("multiLine", multiline)
    names = reader.option("inferSchema", False).csv(path).columns
    names = [x.removeprefix("\uFEFF").translate(str.maketrans(*WESTERN) if encoding == "cp1252" else {}) for x in names]
    if (faults := check_headers(names)) and options.strict:
        raise SourceError("; ".join(faults))
    schema = T.StructType([T.StructField(x, T.StringType()) for x in names] + [T.StructField(CORRUPT, T.StringType())])
    rows = reader.schema(schema).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT).option("enforceSchema", True).option("columnPruning", False).option("nullValue", "").csv(path)
    # a reader of the corrupt column alone is refused, so the test looks at a column of the data too
    bad = F.concat_ws("", CORRUPT, F.substring(f"`{names[0]}`", 1, 0)) != ""
    if options.ragged == "error":
        found = rows.select(CORRUPT, *names[:1]).where(bad).limit(1).collect()
        if found:
            raise SourceError(f"{path}: a row has another number of fields than the header: {found[0][0][:200]!r}")
    rows = (rows if options.ragged == "keep" else rows.where(~bad)).drop(CORRUPT)
    if options.missing or encoding == "cp1252":
        tidy = missing_to_null if options.missing else lambda c: c
        rows = rows.select(*(tidy(western(F.col(f"`{x}`"))).alias(x) for x in names))
    return with_row_ids(rows) if order else rows


def with_row_ids(df: DataFrame, name: str = "_row_id") -> DataFrame:
    """A dense row number from 0 in the order of the rows, as ``name``; no single task sees all rows.

    Rows are numbered in their partition; offsets come from a table of one row per partition. Both come from a scan each, so
    the number of splits of files is fixed for the session, whatever executors come and go.
    """
    spark, splits = df.sparkSession, "spark.sql.files.minPartitionNum"
    if spark.conf.get(splits, None) is None:
        spark.conf.set(splits, str(spark.sparkContext.defaultParallelism))
    own = df.withColumn("_place", F.monotonically_increasing_id())
    part = F.shiftright("_place", 33)
    sizes = own.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    total = F.sum("_n").over(_before())
    starts = sizes.select("_part", F.coalesce(total, F.lit(0)).alias("_start"))
    joined = own.withColumn("_part", part).join(F.broadcast(starts), "_part")  # one row per partition
    number = F.col("_start") + F.col("_place").bitwiseAND((1 << 33) - 1)
    return joined.select(number.cast("long").alias(name), *(F.col(f"`{c}`") for c in df.columns))


def _before():
    from pyspark.sql import Window

    return Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)


#: The header names that are taken for each field when no map is given.
DEFAULT_MAP: dict[str, Any] = {
    "date": [
        "date",
        "transaction_date",
        "txn_date",
        "posted_date",
        "post_date",
        "value_date",
        "booking_date",
        "timestamp",
        "transaction date",
        "posted date",
        "value date",
        "booking date",
        "completed date",
        "started date",
    ],
    "counterparty": ["description", "payee", "vendor", "merchant", "narrative", "details"],
    "memo": ["type", "notes", "note", "memo"],
    "amount": {"aliases": ["amount", "value", "transaction_amount", "amt"], "debit": "debit", "credit": "credit"},
}


def load_header_map(path: str | Path) -> dict[str, Any]:
    return json.loads(Path(path).read_text(encoding="utf-8-sig"))


def _names(spec: Any) -> list[str]:
    found = [spec] if isinstance(spec, str) else list(spec or [])
    return [x for x in (str(x).strip().lower() for x in found) if x]


def header_renames(columns: Sequence[str], mapping: Mapping[str, Any]) -> dict[str, str]:
    """Canonical name by present name, for columns already in lower case. The first alias that is there is taken."""
    present, renames = set(columns), {}

    def take(field: str, names: Sequence[str]) -> None:
        if field in present:
            return
        if alias := next((x for x in names if x in present), None):
            renames[alias] = field
            present.remove(alias)
            present.add(field)

    spec = {str(k).strip().lower(): v for k, v in mapping.items()}
    for field, names in spec.items():
        take(field, _names(names.get("aliases")) if isinstance(names, Mapping) else _names(names))
    amount = spec.get("amount")
    if isinstance(amount, Mapping):
        low = {str(k).strip().lower(): v for k, v in amount.items()}
        for leg in ("debit", "credit"):
            take(leg, [*_names(low.get(leg)), *_names(low.get(f"{leg}_aliases"))])
    return renames


def canonical_headers(df: DataFrame, mapping: Mapping[str, Any] | None = None) -> DataFrame:
    """Column names in lower case, with aliases resolved; a map given replaces the default one."""
    df = df.toDF(*(x if x == "_row_id" else x.strip().lower() for x in df.columns))
    return df.withColumnsRenamed(header_renames(df.columns, DEFAULT_MAP if mapping is None else mapping))


def guarded_columns(df: DataFrame) -> DataFrame:
    """The frame with every text column safe for spreadsheets; numbers stay as they are."""
    return df.select(*((guarded(F.col(f"`{f.name}`")).alias(f.name) if isinstance(f.dataType, T.StringType) else F.col(f"`{f.name}`")) for f in df.schema.fields))


def _as_written(field: T.StructField):
    """A column as CSV has it: nested values as JSON, a time of midnight as its day."""
    column = F.col(f"`{field.name}`")
    if isinstance(field.dataType, (T.ArrayType, T.MapType, T.StructType)):
        return F.to_json(column).alias(field.name)
    if isinstance(field.dataType, T.TimestampNTZType):
        day = F.date_format(column, "yyyy-MM-dd")
        return F.when(column == F.date_trunc("day", column), day).otherwise(F.date_format(column, "yyyy-MM-dd HH:mm:ss.SSSSSS")).alias(field.name)
    return column


def write_csv(df: DataFrame, path: str, guard: bool = True, mode: str = "overwrite") -> None:
    """Writes a folder of CSV files with headers; text that a spreadsheet would take for a formula gets a quote."""
    out = guarded_columns(df) if guard else df
    plain = out.select(*map(_as_written, out.schema.fields))
    plain.write.mode(mode).option("header", True).option("quote", '"').option("escape", '"').option("emptyValue", "").csv(path)
