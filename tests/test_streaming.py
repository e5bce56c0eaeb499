from __future__ import annotations

from ledgerloom.operators.categorise import categorise
from ledgerloom.plans.ledgers import BASE_RULES, orders_ledger
from ledgerloom.plans.rules import parse_rules
from ledgerloom.streaming.categorise import categorised, each_batch, read_ledger, totals, write


def source(spark, tmp_path):
    ledger = orders_ledger(spark, "/root/testdata/sf0.001").selectExpr("_row_id", "CAST(date AS timestamp) AS date", "counterparty", "amount", "memo")
    ledger.repartition(3).write.parquet(str(tmp_path / "in"))
    return ledger


def test_a_stream_gives_what_the_table_gives(spark, tmp_path):
    ledger, rules = source(spark, tmp_path), parse_rules(BASE_RULES)
    query = write(categorised(read_ledger(spark, str(tmp_path / "in"), files_per_batch=1), rules), str(tmp_path / "out"), str(tmp_path / "cp"))
    query.awaitTermination(60)
    found = spark.read.parquet(str(tmp_path / "out"))
    want = categorise(ledger, rules, attribution=True)
    columns = ["_row_id", "category", "flags", "status", "rule"]
    assert found.select(columns).exceptAll(want.select(columns)).count() == 0
    assert found.count() == want.count()


def test_window_totals(spark, tmp_path):
    source(spark, tmp_path)
    seen = []
    stream = totals(read_ledger(spark, str(tmp_path / "in")), parse_rules(BASE_RULES), "3650 days", "1 day")
    query = stream.writeStream.format("memory").queryName("totals").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination(60)
    assert spark.sql("SELECT sum(n) AS n FROM totals").first()["n"] == spark.read.parquet(str(tmp_path / "in")).count()
    batch = each_batch(read_ledger(spark, str(tmp_path / "in")), lambda df, k: seen.append((k, df.count())), str(tmp_path / "cp2"))
    batch.awaitTermination(60)
    assert sum(n for _, n in seen) == spark.read.parquet(str(tmp_path / "in")).count()
