"""Queries over files, rule text, reports and edge cases of the operators, and SQL, written by hand, that gives the same rows."""

from __future__ import annotations

import atexit
import json
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions import text as fn
from ledgerloom.operators import discover as disc
from ledgerloom.operators import reconcile as rec
from ledgerloom.operators import verify as ver
from ledgerloom.operators.categorise import audit, capped, categorise
from ledgerloom.operators.impact import impact
from ledgerloom.plans.ledgers import BASE_RULES, NEW_RULES, orders_ledger
from ledgerloom.plans.rules import Rule, load_rules, parse_rules, text_digest
from ledgerloom.queries import _EXTERNAL, _FIRINGS, _OPEN, CANDIDATE, LEDGER, OUTCOME, PAIR_KEYS, Query, _external, _left, _tampered, discover_topk
from ledgerloom.sources import reports
from ledgerloom.sources.csv import CsvOptions, SourceError, canonical_headers, check_delimiter, check_headers, load_header_map, pick_delimiter, pick_encoding, read_csv, write_csv


def key() -> Column:
    return F.col("_row_id")


def place(spark: SparkSession, name: str) -> str:
    """A new folder name in the shared folder, or in a temporary one of this process where none is named and the master is local."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir is unset: it must name a folder that driver and executors share")
        base = getattr(place, "own", None)
        if base is None:
            base = place.own = tempfile.mkdtemp(prefix="ledger-")
            atexit.register(shutil.rmtree, base, ignore_errors=True)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def local(name: str) -> Path:
    folder = Path(tempfile.mkdtemp(prefix=f"{name}-"))
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return folder


# --- CSV -----------------------------------------------------------------------------------------------------------


def csv_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A ledger written in a western encoding with semicolons, found out and read strictly."""
    path = place(spark, "csv-scan")
    rows = orders_ledger(spark, sf_dir).select(key().alias("k"), F.date_format("date", "yyyy-MM-dd").alias("date"), F.concat("counterparty", F.lit(' "é"; x')).alias("counterparty"), F.col("amount").cast("decimal(18,2)").cast("string").alias("amount"))
    rows.write.option("header", True).option("sep", ";").option("encoding", "ISO-8859-1").option("escape", '"').csv(path)
    found = read_csv(spark, path, CsvOptions(strict=True, ragged="error"))
    return found.select(F.col("k").cast("long").alias("k"), "date", "counterparty", fn.to_number(F.col("amount")).alias("amount"))


def csv_line_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quoted fields with line ends, written with the guard and read back."""
    path = place(spark, "csv-lines")
    write_csv(orders_ledger(spark, sf_dir).select(key().alias("k"), F.concat(F.lit("=a\n"), "memo").alias("memo"), "amount"), path)
    return read_csv(spark, path).select(F.col("k").cast("long").alias("k"), fn.unguarded(F.col("memo")).alias("memo"), F.col("amount").cast("double").alias("amount"))


def _lines(spark: SparkSession, sf_dir: str, header: str, line) -> str:
    path = place(spark, "lines")
    rows = orders_ledger(spark, sf_dir).withColumn("_first", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1) == 0)
    rows.select(F.when(F.col("_first"), F.concat(F.lit(f"{header}\n"), line)).otherwise(line).alias("value")).write.text(path)
    return path


def _ragged(spark: SparkSession, sf_dir: str) -> str:
    return _lines(spark, sf_dir, "k,name", F.concat(key().cast("string"), F.when(key() % 31 == 0, ",a,b").when(key() % 37 == 0, "").otherwise(",a")))


def csv_ragged_dropped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_csv(spark, _ragged(spark, sf_dir)).select(F.col("k").cast("long").alias("k"), "name")


def csv_ragged_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_csv(spark, _ragged(spark, sf_dir), CsvOptions(ragged="keep")).select(F.col("k").cast("long").alias("k"), fn.present(F.col("name")).alias("name"))


def csv_missing_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts that stand for a missing value, taken as such and as they are."""
    path = _lines(spark, sf_dir, "k,v,w", F.concat_ws(",", key().cast("string"), F.element_at(F.array(*map(F.lit, ("NA", "null", "x", "nan", "na"))), (key() % 5 + 1).cast("int")), F.lit("w")))
    as_null, as_text = (read_csv(spark, path, CsvOptions(missing=m)).select(F.col("k").cast("long").alias("k"), F.col("v").alias(n)) for m, n in ((True, "v"), (False, "text")))
    return as_null.join(as_text, "k")


def csv_discover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Discovery over a CSV file of texts."""
    path = place(spark, "csv-discover")
    write_csv(orders_ledger(spark, sf_dir).select("_row_id", "date", "counterparty", "amount", F.when(key() % 3 == 0, "Set").otherwise(F.lit("")).alias("category")), path)
    rows = read_csv(spark, path)
    rows = rows.withColumns({"_row_id": F.col("_row_id").cast("long"), "date": fn.parse_date(F.col("date")), "amount": fn.to_number(F.col("amount"))})
    return disc.discover_all(rows).select("counterparty_fingerprint", "count", "last_seen_date", "max_abs_amount")


def sniff_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = {"commas": b"a,b\n1,2\n", "semicolons": b"a;b;c\n1,5;2;3\n", "tabs": b"a\tb\n", "bars": b"a|b|c\n", "none": b"abc\n", "western": b"caf\xe9;b\n", "latin": b"\x81,b\n", "mark": "﻿é,b\n".encode()}
    return spark.createDataFrame([(k, e := pick_encoding(t), pick_delimiter(t.decode(e))) for k, t in texts.items()], "name string, encoding string, delimiter string")


def source_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files and columns that can't be trusted, and what is said about them."""
    ledger = orders_ledger(spark, sf_dir).select("_row_id", F.date_format("date", "yyyy-MM-dd").alias("date"))

    def said(run) -> str:
        try:
            found = run()
        except (SourceError, rec.ReconcileError) as error:
            return type(error).__name__
        return "fine" if found is None else str(found)

    cases = {
        "lines that differ": lambda: check_delimiter("a,b\n1\n", ","),
        "lines alike": lambda: check_delimiter("a,b\n1,2\n", ","),
        "headers": lambda: len(check_headers(["a", "A ", "", "b"])),
        "ragged": lambda: read_csv(spark, _ragged(spark, sf_dir), CsvOptions(ragged="error")),
        "no file": lambda: read_csv(spark, place(spark, "none")),
        "dates of the format": lambda: rec.check_date_format(ledger, "%Y-%m-%d").mode,
        "dates of another format": lambda: rec.check_date_format(ledger, "%d/%m/%Y"),
        "both conventions": lambda: rec.infer_dates(ledger.select("_row_id", F.when(key() % 2 == 0, "13/01/2025").otherwise(F.lit("01/13/2025")).alias("date"))),
    }
    return spark.createDataFrame([(name, said(run)) for name, run in cases.items()], "name string, outcome string")


def header_map_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headers renamed by a map in a file that begins with a byte order mark."""
    path = local("map") / "map.json"
    path.write_text("﻿" + json.dumps({"Date": ["Tag"], "counterparty": "Wer", "amount": {"aliases": ["none"], "debit": "Soll", "credit_aliases": ["Haben"]}}), encoding="utf-8")
    raw = orders_ledger(spark, sf_dir).select("_row_id", F.col("date").alias(" TAG "), F.col("counterparty").alias("wer"), F.col("amount").alias("SOLL"), F.col("memo").alias("Haben"))
    return canonical_headers(raw, load_header_map(path)).select(key().alias("k"), F.date_format("date", "yyyy-MM-dd").alias("date"), "counterparty", "debit", "credit")


def verify_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file of local dates and amounts against what was made of it, some rows changed."""
    one, two = place(spark, "before"), place(spark, "after")
    rows = orders_ledger(spark, sf_dir)
    european = F.translate(F.format_number(F.col("amount").cast("decimal(18,2)"), 2), ",.", ".,")
    rows.select("_row_id", F.date_format("date", "dd/MM/yyyy").alias("Date"), european.alias("AMOUNT"), F.concat(F.lit(" "), "counterparty").alias("counterparty")).write.option("header", True).csv(one)
    write_csv(rows.withColumn("amount", F.when(key() % 40 == 0, F.col("amount") + 1).otherwise(F.col("amount"))).withColumn("counterparty", F.when(key() % 60 == 0, "else").otherwise(F.col("counterparty"))), two)
    texts = lambda path: read_csv(spark, path, CsvOptions(missing=False, ragged="keep")).withColumn("_row_id", key().cast("long"))
    before, after = ver.as_read(texts(one), ",", ".", True), ver.as_read(texts(two))
    return ver.mismatches(before, after, "full").select(key().alias("k"), "reason", "field_diffs")


# --- rules ---------------------------------------------------------------------------------------------------------

RULE_TEXTS = (
    'rule "quotes # and \\\\ slashes" { # a comment\nmatch:\n - memo == "say \\"hi\\" \\\\ there" // more\nset:\n - category = \'It\\\'s\'\n}\nrule bare {\nmatch:\n - amount in -5..10.5\n - Counterparty ~ *x*\nset:\n - flags += f\n - exclude\n}\n',
    'rule "one line" { match: - memo == "x" set: - category = "y" }\nrule "no action" {\nmatch:\n - memo == x\nset:\n}\n',
)


def _shown(rules: list[Rule]) -> list[tuple]:
    return [(k, r.name, ", ".join(f"{c.field} {c.op} {c.value}" for c in r.match), ", ".join(f"{a.field} {a.op} {a.value}" for a in r.set), r.active) for k, r in enumerate(rules)]


def rule_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules read from two files in order: quotes, comments, blocks that can never fire."""
    folder = local("rules")
    for name, text in zip("ab", RULE_TEXTS, strict=True):
        (folder / name).write_text(text, encoding="utf-8")
    return spark.createDataFrame(_shown(load_rules(folder / "a", folder / "b")), "place int, name string, conditions string, actions string, active boolean")


def rule_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([("marked", text_digest("# --- BEGIN pack ---\nrule x\n# --- END pack ---")), ("plain", text_digest("rule x"))], "name string, digest string")


def amount_equal(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = "".join(f'rule "r{n}" {{\nmatch:\n - amount == {n}\nset:\n - category = "c{n}"\n}}\n' for n in (5000, -7000, 12000.0, 0))
    rows = orders_ledger(spark, sf_dir).withColumn("amount", F.floor(F.col("amount") / 1000) * 1000.0)
    return categorise(rows, parse_rules(rules)).select(key().alias("k"), "category")


def missing_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A condition on a column that isn't there never holds; rules without conditions or actions do nothing."""
    rules = 'rule a {\nmatch:\n - counterparty ~ "*1*"\nset:\n - category = A\n}\nrule b {\nmatch:\n - memo == "1-urgent"\nset:\n - category = B\n}\nrule c {\nset:\n - category = C\n}\nrule d {\nmatch:\n - memo ~ "*"\n}\n'
    return categorise(orders_ledger(spark, sf_dir).drop("counterparty"), parse_rules(rules), attribution=True).select(key().alias("k"), "category", "rule")


def exclude_input(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Markers that come with the ledger, as text of any case, and rules that set them anew."""
    rules = 'rule out {\nmatch:\n - memo == "1-urgent"\nset:\n - exclude = no\n}\nrule in {\nmatch:\n - memo == "5-low"\nset:\n - exclude\n}\n'
    text = F.element_at(F.array(F.lit(" TRUE "), F.lit("no"), F.lit(None).cast("string"), F.lit("true")), (key() % 4 + 1).cast("int"))
    return categorise(orders_ledger(spark, sf_dir).withColumn("exclude", text), parse_rules(rules)).select(key().alias("k"), "exclude")


def audit_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The capped log, and whether there is more: a report of 50."""
    entries, more = capped(audit(orders_ledger(spark, sf_dir), parse_rules(BASE_RULES), "full"), 50)
    return entries.select(key().alias("k"), "rule_idx", "rule", F.lit(more).alias("more"))


def audit_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log as a JSON file of 20 entries and the message that ends it."""
    path = local("audit") / "audit.json"
    entries, more = capped(audit(orders_ledger(spark, sf_dir), parse_rules(BASE_RULES), "lite"), 20)
    reports.audit_json(entries, more, 20, path)
    found = json.loads(path.read_text(encoding="utf-8"))
    rows = [(k, e.get("index"), e.get("rule"), e.get("changes", {}).get("category", {}).get("new"), e.get("message")) for k, e in enumerate(found)]
    return spark.createDataFrame(rows, "place int, k long, rule string, category string, message string")


# --- texts ---------------------------------------------------------------------------------------------------------


def date_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clocks, zones, two-digit years, month names and explicit formats."""
    at = F.col("date") + F.make_dt_interval(hours=(key() % 24).cast("int"), mins=(key() % 60).cast("int"))
    ways = [F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.date_format(at, "dd/MM/yyyy HH:mm"), F.date_format(at, "d MMM yyyy"), F.date_format(at, "MMMM d, yyyy"), F.date_format(at, "dd.MM.yy"), F.date_format(at, "yyyyMMdd")]
    text = F.element_at(F.array(*ways), (key() % 6 + 1).cast("int"))
    stamp = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm")
    rows = orders_ledger(spark, sf_dir).select(key().alias("k"), text.alias("t"))
    return rows.select("k", stamp(fn.parse_date(F.col("t"), True)).alias("at"), stamp(fn.parse_date(F.col("t"), fmt="%d/%m/%Y %H:%M")).alias("by_format"))


ACCENTS = (("Café", "CAFE"), ("ﬁn & co", "FIN CO"), ("Ünal​-Œ", "UNAL"), ("naïve  ½", "NAIVE 12"), ("ÀÇ™", "ACTM"), ("日本 x", "X"), ("plain #1", "PLAIN 1"))


def accents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of names beyond ASCII."""
    names = F.element_at(F.array(*(F.lit(a) for a, _ in ACCENTS)), (key() % len(ACCENTS) + 1).cast("int"))
    rows = orders_ledger(spark, sf_dir).select(key().alias("k"), F.concat_ws(" ", names, "memo").alias("name"))
    return fn.with_fingerprint(rows, "name", "fingerprint").select("k", "fingerprint")


def word_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ("Joe's Grill Ltd", "THE GROUP LTD", "GROUP CO", "12 34", "a&b 999999", "", "x" * 70)
    return spark.createDataFrame([(n, disc.pattern_word(n), disc.title_of(n)) for n in names], "name string, word string, title string")


def html_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(reports.table([{"a<b": "<script>&'\"", "n": None}], "T & x"),), (reports.table([]),)], "html string")


# --- discover, suggest, reconcile, impact -----------------------------------------------------------------------------


def suggest_fuzzy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Drafts by word for the shortlist of 20, under other column names; words that rules cover already are left out."""
    rows = ({"Example": r["example_counterparty_name"], "FINGERPRINT": r["counterparty_fingerprint"], "freq": r["count"]} for r in discover_topk(spark, sf_dir).toLocalIterator())
    drafts = disc.suggest(rows, existing='rule x {\nmatch:\n - counterparty ~ "*AUTOMOBILE*"\n}')
    return spark.createDataFrame([(d.title, d.condition) for d in drafts], "title string, condition string")


def growth_loop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Discover, draft, read the drafts as rules, categorise again: rows by what they are now."""
    drafts = disc.suggest((r.asDict() for r in discover_topk(spark, sf_dir).toLocalIterator()), category="Found", kind="exact")
    rules = [*parse_rules(BASE_RULES), *parse_rules("\n".join(d.text for d in drafts))]
    out = categorise(orders_ledger(spark, sf_dir), rules)
    return out.groupBy((F.col("category") == "Found").alias("found")).agg(F.count(F.lit(1)).alias("n"))


def reconcile_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rec.reconcile(_left(spark, sf_dir), _external(spark, sf_dir), keys=PAIR_KEYS).counts()


def verify_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ver.counts(orders_ledger(spark, sf_dir), _tampered(spark, sf_dir).where("_row_id % 19 <> 0"), "full")


def report_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The transitions as the impact report orders them: a row per pair of categories."""
    facts = reports.impact_report(impact(orders_ledger(spark, sf_dir), parse_rules(BASE_RULES), parse_rules(NEW_RULES)), place(spark, "impact"))
    return spark.createDataFrame([(k, t["old_category"], t["new_category"], t["rows"]) for k, t in enumerate(facts["transitions"])], "place int, old_category string, new_category string, rows long")


def report_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The changed rows as the impact report writes them."""
    folder = place(spark, "impact")
    reports.impact_report(impact(orders_ledger(spark, sf_dir), parse_rules(BASE_RULES), parse_rules(NEW_RULES)), folder)
    rows = read_csv(spark, f"{folder}/impact_changes", CsvOptions(missing=False))
    return rows.select(F.col("row_number").cast("long").alias("row_number"), fn.present(F.col("old_category")).alias("old_category"), fn.present(F.col("new_category")).alias("new_category"), "change_class")


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        csv_scan, csv_line_ends, csv_ragged_dropped, csv_ragged_kept, csv_missing_values, csv_discover, sniff_cases, source_faults, header_map_file, verify_files,
        rule_text, rule_digest, amount_equal, missing_column, exclude_input, audit_cap, audit_file,
        date_texts, accents, word_cases, html_cells, suggest_fuzzy, growth_loop, reconcile_counts, verify_counts, report_transitions, report_changes,
    )
}

_FP = "trim(regexp_replace(regexp_replace(upper(counterparty), '[^A-Z0-9\\s]', ' ', 'g'), '\\s+', ' ', 'g'))"
_DAY = "strftime(date, '%Y-%m-%d')"
_ACCENTS_SQL = ", ".join(f"'{b}'" for _, b in ACCENTS)

ORACLES: dict[str, str] = {
    "csv_scan": f"WITH {LEDGER} SELECT k, {_DAY} AS date, counterparty || ' \"é\"; x' AS counterparty, amount FROM ledger",
    "csv_line_ends": f"WITH {LEDGER} SELECT k, '=a' || chr(10) || memo AS memo, amount FROM ledger",
    "csv_ragged_dropped": f"WITH {LEDGER} SELECT k, 'a' AS name FROM ledger WHERE k % 31 <> 0 AND k % 37 <> 0",
    "csv_ragged_kept": f"WITH {LEDGER} SELECT k, CASE WHEN k % 31 <> 0 AND k % 37 = 0 THEN '' ELSE 'a' END AS name FROM ledger",
    "csv_missing_values": f"WITH {LEDGER} SELECT k, CASE k % 5 WHEN 2 THEN 'x' WHEN 4 THEN 'na' END AS v, ['NA', 'null', 'x', 'nan', 'na'][(k % 5 + 1)::INT] AS text FROM ledger",
    "csv_discover": f"WITH {LEDGER} SELECT {_FP} AS counterparty_fingerprint, count(*) AS count, strftime(max(date), '%Y-%m-%d') AS last_seen_date, max(abs(amount)) AS max_abs_amount FROM ledger WHERE k % 3 <> 0 GROUP BY 1",
    "sniff_cases": """SELECT * FROM (VALUES ('commas', 'utf-8-sig', ','), ('semicolons', 'utf-8-sig', ';'), ('tabs', 'utf-8-sig', chr(9)), ('bars', 'utf-8-sig', '|'), ('none', 'utf-8-sig', NULL),
      ('western', 'cp1252', ';'), ('latin', 'latin-1', ','), ('mark', 'utf-8-sig', ',')) t(name, encoding, delimiter)""",
    "source_faults": """SELECT * FROM (VALUES ('lines that differ', 'SourceError'), ('lines alike', 'fine'), ('headers', '2'), ('ragged', 'SourceError'), ('no file', 'SourceError'),
      ('dates of the format', 'explicit'), ('dates of another format', 'ReconcileError'), ('both conventions', 'ReconcileError')) t(name, outcome)""",
    "header_map_file": f"WITH {LEDGER} SELECT k, {_DAY} AS date, counterparty, amount AS debit, memo AS credit FROM ledger",
    "verify_files": f"""WITH {LEDGER} SELECT k, 'fingerprint mismatch' AS reason, concat_ws('; ', 'amount: ''' || printf('%.2f', amount) || ''' -> ''' || printf('%.2f', amount + 1) || '''',
      CASE WHEN k % 60 = 0 THEN 'counterparty: ''' || counterparty || ''' -> ''else''' END) AS field_diffs FROM ledger WHERE k % 40 = 0
      UNION ALL SELECT k, 'fingerprint mismatch', 'counterparty: ''' || counterparty || ''' -> ''else''' FROM ledger WHERE k % 60 = 0 AND k % 40 <> 0""",
    "rule_text": r"""SELECT * FROM (VALUES (0, 'quotes # and \\ slashes', 'memo == say "hi" \ there', 'category = It''s', true), (1, 'bare', 'amount in (-5.0, 10.5), counterparty ~ *x*', 'flags += f, exclude = True', true),
      (2, 'one line', '', '', false), (3, 'no action', 'memo == x', '', false)) t(place, name, conditions, actions, active)""",
    "rule_digest": "SELECT n AS name, sha256('rule x') AS digest FROM (VALUES ('marked'), ('plain')) t(n)",
    "amount_equal": f"WITH {LEDGER}, a AS (SELECT k, floor(amount / 1000) * 1000 AS v FROM ledger) SELECT k, CASE v WHEN 5000 THEN 'c5000' WHEN -7000 THEN 'c-7000' WHEN 12000 THEN 'c12000.0' WHEN 0 THEN 'c0' ELSE '' END AS category FROM a",
    "missing_column": f"WITH {LEDGER} SELECT k, CASE WHEN memo = '1-URGENT' THEN 'B' ELSE '' END AS category, CASE WHEN memo = '1-URGENT' THEN 'b' ELSE '' END AS rule FROM ledger",
    "exclude_input": f"WITH {LEDGER} SELECT k, CASE memo WHEN '1-URGENT' THEN false WHEN '5-LOW' THEN true ELSE k % 4 IN (0, 3) END AS exclude FROM ledger",
    "audit_cap": f"WITH {OUTCOME}, x AS ({_FIRINGS}) SELECT k, i AS rule_idx, rule, (SELECT count(*) > 50 FROM x) AS more FROM x ORDER BY i, k LIMIT 50",
    "audit_file": f"""WITH {OUTCOME}, x AS (SELECT (row_number() OVER (ORDER BY k) - 1)::INT AS place, k, 'Any machinery' AS rule, 'Plant' AS category FROM m WHERE machine)
      SELECT place, k, rule, category, NULL::VARCHAR AS message FROM x WHERE place < 20 UNION ALL SELECT 20, NULL, NULL, NULL, 'Audit log capped at 20 entries.'""",
    "date_texts": f"""WITH {LEDGER}, t AS (SELECT k, date + to_hours((k % 24)::INT) + to_minutes((k % 60)::INT) AS t FROM ledger)
      SELECT k, strftime(CASE WHEN k % 6 IN (0, 1) THEN t ELSE date_trunc('day', t) END, '%Y-%m-%d %H:%M') AS at, CASE WHEN k % 6 = 1 THEN strftime(t, '%Y-%m-%d %H:%M') END AS by_format FROM t""",
    "accents": f"WITH {LEDGER} SELECT k, [{_ACCENTS_SQL}][(k % {len(ACCENTS)} + 1)::INT] || ' ' || trim(regexp_replace(regexp_replace(upper(memo), '[^A-Z0-9]', ' ', 'g'), ' +', ' ', 'g')) AS fingerprint FROM ledger",
    "word_cases": """SELECT * FROM (VALUES ('Joe''s Grill Ltd', 'GRILL', 'JOE''S GRILL LTD'), ('THE GROUP LTD', 'THE', 'THE GROUP LTD'), ('GROUP CO', 'GROUP', 'GROUP CO'), ('12 34', NULL, '12 34'), ('a&b 999999', 'A&B', 'A&B 999999'),
      ('', NULL, 'CANDIDATE'), (repeat('x', 70), repeat('X', 70), repeat('X', 64))) t(name, word, title)""",
    "html_cells": """SELECT * FROM (VALUES ('<h2>T &amp; x</h2><table><tr><th>a&lt;b</th><th>n</th></tr><tr><td>&lt;script&gt;&amp;&#x27;&quot;</td><td></td></tr></table>'), ('<p>None.</p>')) t(html)""",
    "suggest_fuzzy": f"""WITH {_OPEN}, t AS (SELECT * FROM g WHERE n >= 5 OR most >= 400000 ORDER BY n DESC, fp LIMIT 20), w AS (
        SELECT DISTINCT (CASE WHEN length(string_split(fp, ' ')[3]) > 8 THEN string_split(fp, ' ')[3] ELSE least('CUSTOMER', string_split(fp, ' ')[3]) END) AS w FROM t)
      SELECT 'Suggested: ' || w AS title, 'counterparty ~ "*' || w || '*"' AS condition FROM w WHERE w <> 'AUTOMOBILE'""",
    "growth_loop": f"""WITH {_OPEN}, t AS (SELECT * FROM g WHERE n >= 5 OR most >= 400000 ORDER BY n DESC, fp LIMIT 20)
      SELECT counterparty IN (SELECT example FROM t) AS found, count(*) AS n FROM base GROUP BY 1""",
    "reconcile_counts": f"""WITH {_EXTERNAL}, p AS (SELECT base.category AS a, ext.category AS b FROM base JOIN ext ON base.k = ext.k AND {_DAY.replace("date", "base.date", 1)} = ext.day), n AS (SELECT count(*) AS n, count(*) FILTER (WHERE a <> b) AS w FROM p)
      SELECT n AS rows_compared, w AS mismatches, (SELECT count(*) FROM base WHERE k NOT IN (SELECT k FROM ext)) AS orphans_left, (SELECT count(*) FROM ext WHERE k NOT IN (SELECT k FROM base)) AS orphans_right, round(100.0::DOUBLE * (n - w) / n, 2) AS match_rate FROM n""",
    "verify_counts": f"""WITH {LEDGER} SELECT count(*) AS rows_in, count(*) FILTER (WHERE k % 19 <> 0) AS rows_out, count(*) FILTER (WHERE k % 19 <> 0) AS rows_checked,
      count(*) FILTER (WHERE k % 19 <> 0 AND (k % 50 = 0 OR k % 75 = 0)) + 1 AS mismatches FROM ledger""",
    "report_transitions": f"""WITH {CANDIDATE}, t AS (SELECT CASE WHEN category = '' THEN '(uncategorised)' ELSE category END AS old_category, CASE WHEN new_category = '' THEN '(uncategorised)' ELSE new_category END AS new_category, count(*) AS rows,
        sum(abs(amount)::DECIMAL(38,2)) AS a FROM classed WHERE category <> new_category GROUP BY 1, 2)
      SELECT (row_number() OVER (ORDER BY a DESC, old_category, new_category) - 1)::INT AS place, old_category, new_category, rows FROM t""",
    "report_changes": f"WITH {CANDIDATE} SELECT k + 1 AS row_number, category AS old_category, new_category, change_class FROM classed WHERE change_class <> 'stable'",
}
