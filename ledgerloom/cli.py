"""The command line: ``python -m ledgerloom.cli categorise|discover|suggest|verify|reconcile|impact``.

Exit codes: 0 fine, 1 an input that can't be used, 2 options or rows that aren't valid, 3 something to review.
"""

from __future__ import annotations

import argparse
import csv
import os
import sys
from collections.abc import Sequence
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from ledgerloom.operators import discover as disc
from ledgerloom.operators.categorise import AUDIT_CAP, audit, capped, categorise
from ledgerloom.operators.impact import impact
from ledgerloom.operators.normalise import Locale, NormaliseError, normalise
from ledgerloom.operators.reconcile import IdentityError, ReconcileError, reconcile
from ledgerloom.operators.verify import as_read, verify
from ledgerloom.plans.packs import pack
from ledgerloom.plans.rules import Rule, RuleError, inert, load_rules, text_digest
from ledgerloom.sources import reports
from ledgerloom.sources.csv import CsvOptions, SourceError, load_header_map, read_csv, with_row_ids, write_csv

OK, FAILED, INVALID, REVIEW = 0, 1, 2, 3


class UsageError(Exception):
    """Options that don't go together."""


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="ledgerloom", description="Rules for ledgers, on Spark.")
    top.add_argument("--timings", action="store_true", help="print how long the run took")
    commands = top.add_subparsers(dest="command", required=True)
    reading = argparse.ArgumentParser(add_help=False)
    reading.add_argument("--input", required=True, help="a CSV file or folder, or a .parquet one")
    reading.add_argument("--map", help="a JSON file of header names, in place of the default one")
    reading.add_argument("--encoding", default="auto")
    reading.add_argument("--delimiter")
    reading.add_argument("--decimal", default=".")
    reading.add_argument("--thousands")
    reading.add_argument("--dayfirst", action="store_true")
    reading.add_argument("--date-format")
    reading.add_argument("--strict-parse", action="store_true")
    reading.add_argument("--fail-threshold", type=float, default=0.01)
    ruled = argparse.ArgumentParser(add_help=False)
    ruled.add_argument("--rules", action="append", default=[], help="a rule file; repeatable, later ones win")
    ruled.add_argument("--pack", action="append", default=[], help="a starter pack; repeatable, behind the files")
    ruled.add_argument("--strict-schema", action="store_true")

    one = commands.add_parser("categorise", parents=[reading, ruled])
    one.add_argument("--output", required=True)
    one.add_argument("--audit", help="where the audit goes, as JSON")
    one.add_argument("--audit-mode", choices=("none", "lite", "full"), default=os.environ.get("LEDGER_AUDIT_MODE", "lite"))
    one.add_argument("--audit-max", type=int, default=int(os.environ.get("LEDGER_AUDIT_MAX", AUDIT_CAP)))
    one.add_argument("--no-guard", action="store_true", help="leave text that looks like a formula as it is")
    one.add_argument("--verify", choices=("fast", "full"))
    one.add_argument("--report-dir")
    one.add_argument("--html", action="store_true")
    one.add_argument("--reconcile", metavar="EXTERNAL", help="also compare with a table of another system")
    compared = argparse.ArgumentParser(add_help=False)
    compared.add_argument("--fields", default="category")
    compared.add_argument("--key")
    compared.add_argument("--identity-fields")
    compared.add_argument("--external-date-format")
    for action in compared._actions:
        one._add_action(action)

    two = commands.add_parser("reconcile", parents=[reading, ruled, compared])
    two.add_argument("--external", required=True)
    two.add_argument("--report-dir", required=True)
    two.add_argument("--html", action="store_true")

    three = commands.add_parser("impact", parents=[reading, ruled])
    three.add_argument("--candidate", required=True)
    three.add_argument("--report-dir", required=True)
    three.add_argument("--html", action="store_true")

    four = commands.add_parser("discover", parents=[reading])
    four.add_argument("--output", required=True)
    four.add_argument("--all-output")
    four.add_argument("--min-count", type=int, default=5)
    four.add_argument("--min-amount", type=float)
    four.add_argument("--since")
    four.add_argument("--top-k", type=int)
    four.add_argument("--include-excluded", action="store_true")

    six = commands.add_parser("verify", parents=[reading])
    six.add_argument("--output", required=True, help="what was made of the input, compared row by row")
    six.add_argument("--mode", choices=("fast", "full"), default="fast")
    six.add_argument("--report-dir")
    six.add_argument("--html", action="store_true")

    five = commands.add_parser("suggest")
    five.add_argument("--candidates", required=True)
    five.add_argument("--output", required=True)
    five.add_argument("--existing")
    five.add_argument("--prefix", default="Suggested")
    five.add_argument("--category", default="Review")
    five.add_argument("--emit-match", choices=("fuzzy", "exact"), default="fuzzy")
    five.add_argument("--overwrite", action="store_true")
    return top


def check(args: argparse.Namespace) -> None:
    for name in ("decimal", "thousands"):
        if (value := getattr(args, name, None)) is not None and len(value) != 1:
            raise UsageError(f"--{name} is one character")
    if getattr(args, "thousands", None) and args.thousands == args.decimal:
        raise UsageError("--decimal and --thousands are not the same")
    if args.command == "categorise" and args.reconcile and not args.report_dir:
        raise UsageError("--reconcile needs --report-dir")
    if args.command in ("reconcile", "categorise"):
        if args.key and args.identity_fields:
            raise UsageError("--key replaces positions and --identity-fields guards them; give one of them")
        if args.external_date_format and not (args.key or args.identity_fields):
            raise UsageError("--external-date-format needs --key or --identity-fields")
        if not split(args.fields):
            raise UsageError("--fields names at least one field")
    if args.command in ("categorise", "verify") and args.html and not args.report_dir:
        raise UsageError("--html needs --report-dir")
    if getattr(args, "audit_max", 1) < 1:
        raise UsageError("--audit-max is 1 or more")


def split(text: str | None) -> list[str]:
    return [x.strip() for x in (text or "").split(",") if x.strip()]


def read(spark: SparkSession, args: argparse.Namespace, number: bool = True) -> DataFrame:
    raw = spark.read.parquet(args.input) if args.input.rstrip("/").endswith(".parquet") else read_csv(spark, args.input, CsvOptions(args.delimiter, None if args.encoding == "auto" else args.encoding, args.strict_parse))
    mapping = load_header_map(args.map) if args.map else None
    return normalise(raw, mapping, Locale(args.decimal, args.thousands, args.dayfirst, args.date_format), args.fail_threshold, args.strict_parse, number)


def rules_of(args: argparse.Namespace) -> list[Rule]:
    rules = [*load_rules(*args.rules), *(rule for name in args.pack for rule in pack(name))]
    for name in inert(rules):
        print(f"rule {name!r} has no condition or no action and never fires", file=sys.stderr)
    return rules


def run_categorise(spark: SparkSession, args: argparse.Namespace) -> int:
    rules, ledger = rules_of(args), read(spark, args)
    out = categorise(ledger, rules, strict=args.strict_schema)
    write_csv(out.drop("_row_id"), args.output, guard=not args.no_guard)
    if args.audit and args.audit_mode != "none":
        entries, more = capped(audit(ledger, rules, args.audit_mode), args.audit_max)
        reports.audit_json(entries, more, args.audit_max, args.audit)
    good = True  # both checks run and report, whichever fails
    if args.verify:
        found = verify(ledger, out, args.verify)
        if args.report_dir:
            reports.verify_report(found, args.report_dir, args.html)
        good = found.success
    if args.reconcile:
        good = compare(spark, args, categorise(ledger, rules, attribution=True), args.reconcile) and good
    return OK if good else REVIEW


def run_verify(spark: SparkSession, args: argparse.Namespace) -> int:
    """File against file: rows in the same place, the input's texts read as the ledger's are."""
    def texts(path: str) -> DataFrame:
        if path.rstrip("/").endswith(".parquet"):
            return with_row_ids(spark.read.parquet(path).drop("_row_id"))
        return read_csv(spark, path, CsvOptions(missing=False, ragged="keep"), order=True)

    before = as_read(texts(args.input), args.decimal, args.thousands, args.dayfirst, args.date_format)
    found = verify(before, as_read(texts(args.output)), args.mode)
    if args.report_dir:
        reports.verify_report(found, args.report_dir, args.html)
    return OK if found.success else REVIEW


def compare(spark: SparkSession, args: argparse.Namespace, left: DataFrame, external: str) -> bool:
    right = with_row_ids(read_csv(spark, external, CsvOptions(missing=False, ragged="error"))).na.fill("")
    try:
        found = reconcile(left, right, split(args.fields), split(args.key) or None, split(args.identity_fields) or None, args.external_date_format)
    except IdentityError as error:
        reports.identity_report(error, args.report_dir)
        raise
    return bool(reports.reconcile_report(found, args.report_dir, args.html)["success"])


def run_reconcile(spark: SparkSession, args: argparse.Namespace) -> int:
    left = categorise(read(spark, args), rules_of(args), attribution=True, strict=args.strict_schema)
    return OK if compare(spark, args, left, args.external) else REVIEW


def run_impact(spark: SparkSession, args: argparse.Namespace) -> int:
    baseline, candidate = rules_of(args), load_rules(args.candidate)
    digests = {"baseline_rules_sha256": text_digest("\n".join(Path(x).read_text(encoding="utf-8-sig") for x in args.rules)), "candidate_rules_sha256": text_digest(Path(args.candidate).read_text(encoding="utf-8-sig"))}
    facts = reports.impact_report(impact(read(spark, args), baseline, candidate), args.report_dir, digests, args.html)
    return REVIEW if facts["behavioural_changed"] else OK


def run_discover(spark: SparkSession, args: argparse.Namespace) -> int:
    every = disc.discover_all(read(spark, args), args.since, args.include_excluded)
    shortlist = disc.candidates(every, args.min_count, args.min_amount, args.top_k)
    write_csv(shortlist.coalesce(1), args.output)  # in order, and of the size of a report
    if args.all_output:
        write_csv(every.drop("sample_amount", "sample_date"), args.all_output)
    return OK


def run_suggest(spark: SparkSession | None, args: argparse.Namespace) -> int:
    source = Path(args.candidates)
    names = sorted(source.glob("*.csv")) if source.is_dir() else [source]
    rows = [row for name in names for row in csv.DictReader(name.open(encoding="utf-8-sig", newline=""))]
    existing = Path(args.existing).read_text(encoding="utf-8-sig") if args.existing else ""
    drafts = disc.suggest(rows, args.prefix, args.category, existing, args.emit_match)
    target = Path(args.output)
    before = "" if args.overwrite or not target.exists() else target.read_text(encoding="utf-8").rstrip("\n") + "\n\n"
    target.write_text(before + "\n".join(d.text for d in drafts), encoding="utf-8")
    return OK


RUNS = {"categorise": run_categorise, "verify": run_verify, "reconcile": run_reconcile, "impact": run_impact, "discover": run_discover, "suggest": run_suggest}


def main(argv: Sequence[str] | None = None, spark: SparkSession | None = None) -> int:
    import time

    began = time.time()
    try:
        args = parser().parse_args(argv)
        check(args)
        if args.command != "suggest" and spark is None:
            spark = SparkSession.builder.appName("ledgerloom").config("spark.sql.session.timeZone", "UTC").getOrCreate()
        code = RUNS[args.command](spark, args)
    except SystemExit as end:
        return int(end.code or 0)
    except (UsageError, NormaliseError, RuleError) as error:
        print(f"error: {error}", file=sys.stderr)
        return INVALID
    except FileNotFoundError as error:
        print(f"error: {error}", file=sys.stderr)
        return INVALID if getattr(args, "rules", None) else FAILED
    except (SourceError, ReconcileError, OSError) as error:
        print(f"error: {error}", file=sys.stderr)
        return FAILED
    if args.timings:
        print(f"{time.time() - began:.2f} s")
    return code


if __name__ == "__main__":
    sys.exit(main())
