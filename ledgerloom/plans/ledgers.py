"""Ledgers made from the star-schema tables, for queries and benchmarks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def orders_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One transaction per order: ``_row_id`` is the order's key; the amount of a finished order is negative."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    customers = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", F.concat_ws(" ", "c_name", "c_mktsegment").alias("counterparty"))
    amount = F.when(F.col("o_orderstatus") == "F", -F.col("o_totalprice")).otherwise(F.col("o_totalprice"))
    return orders.join(customers, orders["o_custkey"] == customers["c_custkey"]).select(
        F.col("o_orderkey").alias("_row_id"), F.col("o_orderdate").cast("timestamp_ntz").alias("date"), "counterparty", amount.alias("amount"), F.col("o_orderpriority").alias("memo")
    )


def events_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One transaction per event."""
    return spark.read.parquet(f"{sf_dir}/events.parquet").select(
        F.col("event_id").alias("_row_id"), F.col("ts").cast("timestamp_ntz").alias("date"), F.col("event_type").alias("counterparty"), F.col("value").alias("amount"), F.col("props").alias("memo")
    )


def raw_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The orders ledger with amounts as texts, in eight ways of writing them by turns."""
    ledger = orders_ledger(spark, sf_dir)
    size = F.abs("amount").cast("decimal(18,2)").cast("string")
    grouped = F.format_number(F.abs("amount").cast("decimal(18,2)"), 2)
    european = F.translate(grouped, ",.", ".,")
    ways = [size, F.concat(F.lit("£"), grouped), F.concat(F.lit("("), size, F.lit(")")), F.concat(size, F.lit("-")), F.concat(size, F.lit("DR")), F.concat(size, F.lit(" CR")), F.concat(F.lit("\u2212"), size), european]
    return ledger.withColumn("amount", F.element_at(F.array(*ways), (F.col("_row_id") % 8 + 1).cast("int")))


#: Rules about segments and priorities of the orders ledger.
BASE_RULES = """
rule "Any machinery" {
  match:
    - counterparty ~ "*MACHINERY"
  set:
    - category = "Plant"
    - flags += "heavy"
}
rule "Buildings" {
  match:
    - counterparty ~ "*building*"   # any case
  set:
    - category = "Property"
    - flags += "fixed"
    - status = "open"
}
rule "Urgent machines" {
  match:
    - counterparty ~ "*MACHINERY"
    - memo == "1-urgent"
  set:
    - category = "Plant: rush"
    - flags += "rush"
}
rule "Some customers" {
  match:
    - counterparty ~ "Customer*1*HOUSEHOLD"
  set:
    - category = "Home"
}
rule "Big refunds" {
  match:
    - amount in -500000..-250000
  set:
    - flags += "large"
    - status = "review"
}
rule "One name" {
  match:
    - counterparty == "customer#000000007 FURNITURE"
  set:
    - category = "Known"
}
"""

#: The same with one rule gone, one changed and one new.
NEW_RULES = """
rule "Any machinery" {
  match:
    - counterparty ~ "*MACHINERY"
  set:
    - category = "Plant"
    - flags += "heavy"
}
rule "Buildings" {
  match:
    - counterparty ~ "*building*"
  set:
    - category = "Real estate"
    - flags += "fixed"
    - flags += "heavy"
}
rule "Urgent machines" {
  match:
    - counterparty ~ "*MACHINERY"
    - memo == "1-urgent"
  set:
    - category = "Plant: rush"
    - flags += "rush"
}
rule "Repeats machinery" {
  match:
    - counterparty ~ "*MACHINERY"
    - amount in -100000..100000
  set:
    - flags += "heavy"
}
rule "Big refunds" {
  match:
    - amount in -500000..-250000
  set:
    - flags += "large"
    - status = "review"
}
"""

CHAINED_RULES = """
rule "Plant" {
  match:
    - counterparty ~ "*MACHINERY"
  set:
    - category = "Plant"
}
rule "Rush plant" {
  match:
    - category == "plant"
    - memo ~ "1-*"
  set:
    - category = "Rush"
    - memo += "seen"
}
rule "Seen" {
  match:
    - memo ~ "*seen"
  set:
    - status += "checked"
    - status += "twice"
}
rule "Out" {
  match:
    - amount in -1000000..-300000
  set:
    - exclude
}
rule "Back in" {
  match:
    - status ~ "*checked*"
  set:
    - exclude = false
}
"""
