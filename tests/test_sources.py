from __future__ import annotations

import csv
import json

import pytest

from ledgerloom import cli
from ledgerloom.sources.csv import CsvOptions, SourceError, check_delimiter, check_headers, header_renames, pick_delimiter, pick_encoding, read_csv, with_row_ids, write_csv


def test_picks():
    assert pick_encoding("é".encode()) == "utf-8-sig"
    assert pick_encoding("é".encode()[:1] and ("x" * 9 + "é").encode()[:-1]) == "utf-8-sig"  # cut in a character
    assert pick_encoding(b"caf\xe9 noir") == "cp1252"
    assert pick_encoding(b"\x81 bla bla") == "latin-1"
    assert [pick_delimiter(x) for x in ("a,b\n1,2", "a;b\n1;2,5", "a\tb", "a|b|c", "abc", "")] == [",", ";", "\t", "|", None, None]
    check_delimiter("a,b\n" * 20 + "x\n", ",")
    with pytest.raises(SourceError):
        check_delimiter("a,b\nx\n", ",")
    assert len(check_headers(["a", " A", ""])) == 2


def test_renames():
    assert header_renames(["booking date", "payee", "amt", "x"], {"date": ["booking date"], "counterparty": ["payee"], "amount": {"aliases": ["amt"]}}) == {"booking date": "date", "payee": "counterparty", "amt": "amount"}
    assert header_renames(["date", "timestamp"], {"date": ["timestamp"]}) == {}
    assert header_renames(["out", "in"], {"amount": {"debit": "Out", "credit_aliases": ["in"]}}) == {"out": "debit", "in": "credit"}


def test_csv_round_trip(spark, tmp_path):
    path = tmp_path / "in.csv"
    path.write_text('date;payee;value;note\n2025-01-01;"A; ""q""\nline";1;NA\n2025-01-02;=cmd;-2;null\n2025-01-03;short\n', encoding="utf-8-sig")
    df = read_csv(spark, str(path), order=True)
    rows = df.orderBy("_row_id").collect()
    assert [tuple(r) for r in rows] == [(0, "2025-01-01", 'A; "q"\nline', "1", None), (1, "2025-01-02", "=cmd", "-2", None)]
    with pytest.raises(SourceError):
        read_csv(spark, str(path), CsvOptions(ragged="error"))
    with pytest.raises(SourceError):
        read_csv(spark, str(tmp_path / "none.csv"))
    write_csv(df.drop("_row_id").selectExpr("*", "CAST(-1.5 AS double) AS number"), str(tmp_path / "out"))
    written = [r for p in sorted((tmp_path / "out").glob("*.csv")) for r in csv.DictReader(p.open(newline=""))]
    assert {r["payee"] for r in written} == {'A; "q"\nline', "'=cmd"}
    assert {r["number"] for r in written} == {"-1.5"}


def test_row_ids_are_dense_and_in_order(spark):
    df = with_row_ids(spark.range(0, 1000, 1, 7).where("id % 3 <> 0"))
    rows = df.orderBy("_row_id").collect()
    assert [r["_row_id"] for r in rows] == list(range(len(rows)))
    assert [r["id"] for r in rows] == sorted(r["id"] for r in rows)


RULES = 'rule "Cab" {\n match:\n  - counterparty ~ "*cab*"\n set:\n  - category = "Transport"\n  - flags += "ride"\n}\n'


@pytest.fixture
def files(tmp_path):
    (tmp_path / "in.csv").write_text("date,counterparty,amount,memo\n2025-01-01,Yellow Cab,-5.00,a\n2025-01-02,Shop,10,b\n2025-01-03,Cab & Co,-1,=x\n")
    (tmp_path / "a.rules").write_text(RULES)
    (tmp_path / "b.rules").write_text(RULES.replace("Transport", "Travel"))
    return tmp_path


def out_rows(folder):
    return [r for p in sorted(folder.glob("*.csv")) for r in csv.DictReader(p.open(newline=""))]


def test_cli_categorise(spark, files):
    args = ["categorise", "--input", str(files / "in.csv"), "--rules", str(files / "a.rules"), "--pack", "sanity", "--output", str(files / "out"), "--audit", str(files / "audit.json"), "--audit-mode", "full", "--verify", "full", "--report-dir", str(files / "rep"), "--html"]
    assert cli.main(args, spark) == 0
    rows = out_rows(files / "out")
    assert [r["category"] for r in rows] == ["Transport", "", "Transport"]
    assert rows[2]["memo"] == "'=x"
    log = json.loads((files / "audit.json").read_text())
    assert [e["index"] for e in log] == [0, 2]
    assert log[0]["changes"]["category"] == {"old": None, "new": "Transport"}
    assert "<script" not in (files / "rep" / "verify_report.html").read_text()
    assert cli.main([*args, "--audit-max", "1"], spark) == 0
    assert json.loads((files / "audit.json").read_text())[-1] == {"message": "Audit log capped at 1 entries."}


def test_cli_exit_codes(spark, files):
    base = ["categorise", "--input", str(files / "in.csv"), "--output", str(files / "o")]
    assert cli.main([*base, "--rules", str(files / "gone")], spark) == 2
    assert cli.main([*base, "--pack", "gone"], spark) == 2
    assert cli.main([*base, "--decimal", ",,"], spark) == 2
    assert cli.main(["--help"], spark) == 0
    assert cli.main(["categorise"], spark) == 2
    assert cli.main(["categorise", "--input", str(files / "gone.csv"), "--output", "x"], spark) == 1
    (files / "bad.csv").write_text("date,counterparty,amount\nx,a,1\n2025-01-01,b,2\n")
    assert cli.main(["categorise", "--input", str(files / "bad.csv"), "--output", str(files / "o")], spark) == 2


def test_cli_reconcile_and_impact(spark, files):
    (files / "ext.csv").write_text("date,counterparty,amount,category\n2025-01-01,yellow cab,-5,Transport\n2025-01-02,shop,10,Food\n2025-01-09,else,1,X\n")
    base = ["--input", str(files / "in.csv"), "--rules", str(files / "a.rules")]
    code = cli.main(["reconcile", *base, "--external", str(files / "ext.csv"), "--key", "date,amount,counterparty", "--report-dir", str(files / "r"), "--html"], spark)
    assert code == 3
    facts = json.loads((files / "r" / "reconcile_report.json").read_text())
    assert (facts["rows_compared"], facts["mismatches"], facts["orphans_left"], facts["orphans_right"]) == (2, 1, 1, 1)
    assert cli.main(["reconcile", *base, "--external", str(files / "ext.csv"), "--identity-fields", "counterparty", "--report-dir", str(files / "i")], spark) == 1
    assert (files / "i" / "reconcile_identity_failures.json").exists()
    code = cli.main(["impact", *base, "--candidate", str(files / "b.rules"), "--report-dir", str(files / "m"), "--html"], spark)
    assert code == 3
    facts = json.loads((files / "m" / "impact_report.json").read_text())
    assert facts["behavioural_changed"] == 2
    assert facts["transitions"][0]["new_category"] == "Travel"
    assert cli.main(["impact", *base, "--candidate", str(files / "a.rules"), "--report-dir", str(files / "m2")], spark) == 0


def test_cli_growth_loop(spark, files):
    assert cli.main(["discover", "--input", str(files / "in.csv"), "--output", str(files / "cand"), "--min-count", "1", "--all-output", str(files / "all")], spark) == 0
    assert len(out_rows(files / "cand")) == 3
    args = ["suggest", "--candidates", str(files / "cand"), "--output", str(files / "new.rules"), "--category", "Found"]
    assert cli.main(args, spark) == 0
    assert cli.main(["categorise", "--input", str(files / "in.csv"), "--rules", str(files / "new.rules"), "--output", str(files / "again")], spark) == 0
    assert {r["category"] for r in out_rows(files / "again")} == {"Found"}
    before = (files / "new.rules").read_text()
    assert cli.main([*args, "--existing", str(files / "new.rules")], spark) == 0
    assert (files / "new.rules").read_text().strip() == before.strip()


def test_cli_verify(spark, files):
    base = ["--input", str(files / "in.csv"), "--rules", str(files / "a.rules"), "--output", str(files / "out")]
    assert cli.main(["categorise", *base], spark) == 0
    both = ["verify", "--input", str(files / "in.csv"), "--output", str(files / "out")]
    assert cli.main([*both, "--mode", "full", "--report-dir", str(files / "v"), "--html"], spark) == 0
    (files / "other.csv").write_text((files / "in.csv").read_text().replace("10,b", "11,b"))
    assert cli.main(["verify", "--input", str(files / "other.csv"), "--output", str(files / "out"), "--report-dir", str(files / "w")], spark) == 3
    facts = json.loads((files / "w" / "verify_report.json").read_text())
    assert (facts["rows_in"], facts["rows_checked"], facts["mismatches"]) == (3, 3, 1)
    (files / "short.csv").write_text("Date;Amount;Counterparty\n01/01/2025;-5,0;Yellow Cab\n02/01/2025;10;Shop;more\n")
    args = ["verify", "--input", str(files / "short.csv"), "--output", str(files / "out"), "--decimal", ",", "--dayfirst", "--report-dir", str(files / "s")]
    assert cli.main(args, spark) == 3
    facts = json.loads((files / "s" / "verify_report.json").read_text())
    assert (facts["rows_in"], facts["rows_out"], facts["rows_checked"], facts["mismatches"]) == (2, 3, 2, 1)
    assert cli.main([*both, "--html"], spark) == 2
    assert cli.main(["verify", "--input", str(files / "gone.csv"), "--output", str(files / "out")], spark) == 1


def test_cli_checks_after_categorise(spark, files):
    (files / "ext.csv").write_text("date,counterparty,amount,category\n2025-01-01,yellow cab,-5,Transport\n2025-01-02,shop,10,Food\n2025-01-03,cab & co,-1,Transport\n")
    base = ["categorise", "--input", str(files / "in.csv"), "--rules", str(files / "a.rules"), "--output", str(files / "out"), "--verify", "fast", "--report-dir", str(files / "r")]
    assert cli.main([*base, "--reconcile", str(files / "ext.csv")], spark) == 3
    assert json.loads((files / "r" / "verify_report.json").read_text())["success"]
    assert json.loads((files / "r" / "reconcile_report.json").read_text())["mismatches"] == 1
    (files / "ext.csv").write_text((files / "ext.csv").read_text().replace("Food", ""))
    assert cli.main([*base, "--reconcile", str(files / "ext.csv"), "--key", "date,counterparty"], spark) == 0
    assert cli.main([*base[:-4], "--reconcile", str(files / "ext.csv")], spark) == 2
    assert cli.main([*base, "--reconcile", str(files / "gone.csv")], spark) == 1


def test_line_ends_in_quotes_are_looked_for(spark, tmp_path):
    rows = [f'{k},"x {k}"' for k in range(9000)]
    (tmp_path / "plain.csv").write_text("\n".join(["a,b", *rows]))
    plain = read_csv(spark, str(tmp_path / "plain.csv"), order=True)
    assert plain.where("_row_id = a").count() == 9000
    (tmp_path / "late.csv").write_text("\n".join(["a,b", *rows, '9000,"two\nlines"']))
    late = read_csv(spark, str(tmp_path / "late.csv"))
    assert late.where("a = 9000").first()["b"] == "two\nlines"
    assert late.count() == 9001


def test_western_files(spark, tmp_path):
    (tmp_path / "w.csv").write_bytes("date;café;€\n2025-01-01;€5 – é;x\n".encode("cp1252"))
    df = read_csv(spark, str(tmp_path / "w.csv"))
    assert df.columns == ["date", "café", "€"]
    assert df.first()[1] == "€5 – é"


@pytest.mark.parametrize(("encoding", "text"), [("utf-8", "€5 – é"), ("cp1252", "€5 – é"), ("latin-1", "é\x81")])
def test_every_file_and_line_counts_for_the_encoding(spark, tmp_path, encoding, text):
    (tmp_path / "part-0.csv").write_bytes(b"")
    (tmp_path / "part-1.csv").write_bytes(b"k;name\n")  # of a task without rows
    (tmp_path / "part-2.csv").write_bytes(f'k;name\n1;"{text}"'.encode(encoding))
    assert [tuple(r) for r in read_csv(spark, str(tmp_path), CsvOptions(strict=True)).collect()] == [("1", text)]
    late = [*(f"{k};plain" for k in range(9000)), f'9000;"{text}"', f'9001;"{text}"']
    (tmp_path / "part-3.csv").write_bytes("\n".join(["k;name", *late]).encode(encoding))
    found = read_csv(spark, str(tmp_path), CsvOptions(strict=True))
    assert found.where("CAST(k AS int) >= 9000").orderBy("k").collect() == [("9000", text), ("9001", text)]
    assert found.count() == 9003
