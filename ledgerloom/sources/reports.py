"""Report sinks: JSON, CSV and self-contained HTML of what the operators found.

Summaries are counts. Rows are written by Spark as folders of CSV; only bounded samples reach the driver for HTML.
"""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from html import escape
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.operators.impact import Impact
from ledgerloom.operators.reconcile import IdentityError, Reconciliation
from ledgerloom.operators.verify import SAMPLE, Verification
from ledgerloom.sources.csv import write_csv

HTML_ROWS, JSON_ROWS = 50, 100
PAGE = """<!doctype html>
<html lang="en"><head><meta charset="utf-8"><title>{title}</title>
<style>body{{font:15px sans-serif;margin:2em auto;max-width:70em}}table{{border-collapse:collapse;margin:1em 0}}td,th{{border:1px solid #bbb;padding:.2em .6em;text-align:left}}.no{{color:#a00}}.yes{{color:#060}}</style>
</head><body><h1>{title}</h1>{body}</body></html>
"""


def table(rows: Sequence[Mapping[str, object]], title: str = "") -> str:
    """An HTML table of rows, every value escaped."""
    if not rows:
        return f"<h2>{escape(title)}</h2><p>None.</p>" if title else "<p>None.</p>"
    head = "".join(f"<th>{escape(str(k))}</th>" for k in rows[0])
    body = "".join("<tr>" + "".join(f"<td>{escape('' if v is None else str(v))}</td>" for v in row.values()) + "</tr>" for row in rows)
    return (f"<h2>{escape(title)}</h2>" if title else "") + f"<table><tr>{head}</tr>{body}</table>"


def page(title: str, *parts: str) -> str:
    return PAGE.format(title=escape(title), body="".join(parts))


def verdict(good: bool, yes: str, no: str) -> str:
    return f'<p class="{"yes" if good else "no"}">{escape(yes if good else no)}</p>'


def sample(df: DataFrame | None, rows: int) -> list[dict]:
    return [] if df is None else [r.asDict() for r in df.limit(rows).collect()]


def write_json(content: object, path: str | Path) -> None:
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(json.dumps(content, indent=2, ensure_ascii=False, default=str) + "\n", encoding="utf-8")


def _write_page(folder: Path, name: str, text: str) -> None:
    folder.mkdir(parents=True, exist_ok=True)
    (folder / name).write_text(text, encoding="utf-8")


def verify_report(found: Verification, folder: str | Path, html: bool = False) -> dict:
    folder = Path(folder)
    facts = {"success": found.success, "mode": found.mode, "rows_in": found.rows_in, "rows_out": found.rows_out, "rows_checked": found.rows_checked, "mismatches": found.mismatches}
    write_json(facts, folder / "verify_report.json")
    write_csv(found.proof, str(folder / "verify_proof"))
    if found.mismatches:
        write_csv(found.rows, str(folder / "verify_mismatches"))
    if html:
        shown = sample(found.proof.orderBy("_row_id"), SAMPLE)
        text = page("Integrity", verdict(found.success, "Every row came through.", f"{found.mismatches} findings."), table([facts]), table(sample(found.rows, HTML_ROWS), "Mismatches"), table(shown, "Fingerprints"))
        _write_page(folder, "verify_report.html", text)
    return facts


def reconcile_report(found: Reconciliation, folder: str | Path, html: bool = False) -> dict:
    folder, facts = Path(folder), found.summary()
    write_json(facts, folder / "reconcile_report.json")
    for df, n, name in ((found.mismatches, facts["mismatches"], "mismatches"), (found.orphans_left, facts["orphans_left"], "orphans_ledger"), (found.orphans_right, facts["orphans_right"], "orphans_external")):
        if df is not None and n:
            write_csv(df.orderBy("row_number"), str(folder / f"reconcile_{name}"))
    if html:
        parts = [table(sample(df.orderBy("row_number") if df is not None else None, HTML_ROWS), name) for df, name in ((found.mismatches, "Mismatches"), (found.orphans_left, "Only in the ledger"), (found.orphans_right, "Only in the external system"))]
        _write_page(folder, "reconcile_report.html", page("Reconciliation", verdict(bool(facts["success"]), "Both sides agree.", "There is something to review."), table([facts]), *parts))
    return facts


def identity_report(error: IdentityError, folder: str | Path) -> None:
    """All failures as CSV, the first ones as JSON."""
    folder = Path(folder)
    write_csv(error.failures.orderBy("row_number"), str(folder / "reconcile_identity_failures"))
    write_json({"message": str(error), "failures": sample(error.failures.orderBy("row_number"), JSON_ROWS)}, folder / "reconcile_identity_failures.json")


def impact_report(found: Impact, folder: str | Path, digests: Mapping[str, str] | None = None, html: bool = False) -> dict:
    """Deltas are one row per rule, flag, status or pair of categories, so they are small; changed rows go out as CSV."""
    folder = Path(folder)
    ordered = {
        "transitions": found.transitions.orderBy(F.desc("indicative_amount"), "old_category", "new_category"),
        "rule_deltas": found.rule_deltas.orderBy("position").drop("position"),
        "flag_deltas": found.flag_deltas.orderBy("flag"),
        "status_deltas": found.status_deltas.orderBy("status"),
    }
    facts: dict = {"schema": "impact/1", **found.summary(), **(digests or {})}
    facts |= {name: [r.asDict() for r in df.collect()] for name, df in ordered.items()}
    write_json(facts, folder / "impact_report.json")
    changed = found.changed_rows.orderBy("row_number")
    if facts["behavioural_changed"] or facts["attribution_changed"]:
        write_csv(changed, str(folder / "impact_changes"))
    if html:
        head = [{k: v for k, v in facts.items() if not isinstance(v, list)}]
        parts = [table(facts[name], name.replace("_", " ").capitalize()) for name in ordered]
        text = page("Impact", verdict(not facts["behavioural_changed"], "No outcome changes.", "Outcomes change."), table(head), *parts, table(sample(changed, HTML_ROWS), "Changed rows"))
        _write_page(folder, "impact_report.html", text)
    return facts


def audit_json(entries: DataFrame, more: bool, cap: int, path: str | Path) -> None:
    """The capped log as a JSON list; a message ends it where there is more."""
    clean = lambda e: {k: v for k, v in (("index", e["_row_id"]), ("rule", e["rule"]), ("match", e.get("match")), ("set", e.get("set")), ("changes", {f: c for f, c in (e["changes"] or {}).items() if c})) if v is not None}
    found = [clean(r.asDict(recursive=True)) for r in entries.orderBy("rule_idx", "_row_id").collect()]
    write_json(found + ([{"message": f"Audit log capped at {cap} entries."}] if more else []), path)
