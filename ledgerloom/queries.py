"""One query per operator over the test tables, and SQL, written by hand, that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions import text as fn
from ledgerloom.operators import discover as disc
from ledgerloom.operators import impact as imp
from ledgerloom.operators import reconcile as rec
from ledgerloom.operators import verify as ver
from ledgerloom.operators.categorise import audit, categorise, fired
from ledgerloom.operators.normalise import Locale, drop_stats, normalise, synthesise_amount, typed
from ledgerloom.plans.ledgers import BASE_RULES, CHAINED_RULES, NEW_RULES, events_ledger, orders_ledger, raw_orders
from ledgerloom.plans.rules import parse_rules
from ledgerloom.sources.csv import canonical_headers, guarded_columns

Query = Callable[[SparkSession, str], DataFrame]

# --- shared SQL ----------------------------------------------------------------------------------------------------

LEDGER = """
ledger AS (
  SELECT o_orderkey AS k, o_orderdate AS date, c_name || ' ' || c_mktsegment AS counterparty,
    CASE WHEN o_orderstatus = 'F' THEN -o_totalprice ELSE o_totalprice END AS amount, o_orderpriority AS memo
  FROM orders JOIN customer ON o_custkey = c_custkey
)"""

OUTCOME = f"""{LEDGER}, m AS (
  SELECT *, counterparty LIKE '%MACHINERY' AS machine, counterparty LIKE '%BUILDING%' AS building, memo = '1-URGENT' AS urgent,
    counterparty LIKE 'Customer%1%HOUSEHOLD' AS home, amount BETWEEN -500000 AND -250000 AS large,
    counterparty = 'Customer#000000007 FURNITURE' AS known
  FROM ledger
), base AS (
  SELECT *,
    CASE WHEN known THEN 'Known' WHEN home THEN 'Home' WHEN machine AND urgent THEN 'Plant: rush' WHEN building THEN 'Property' WHEN machine THEN 'Plant' ELSE '' END AS category,
    trim(concat_ws(' ', CASE WHEN machine THEN 'heavy' END, CASE WHEN building THEN 'fixed' END, CASE WHEN machine AND urgent THEN 'rush' END, CASE WHEN large THEN 'large' END)) AS flags,
    CASE WHEN large THEN 'review' WHEN building THEN 'open' ELSE '' END AS status,
    CASE WHEN known THEN 'One name' WHEN large THEN 'Big refunds' WHEN home THEN 'Some customers' WHEN machine AND urgent THEN 'Urgent machines' WHEN building THEN 'Buildings' WHEN machine THEN 'Any machinery' ELSE '' END AS rule
  FROM m
)"""

CANDIDATE = f"""{OUTCOME}, pairs AS (
  SELECT *,
    CASE WHEN machine AND urgent THEN 'Plant: rush' WHEN building THEN 'Real estate' WHEN machine THEN 'Plant' ELSE '' END AS new_category,
    machine OR building AS n_heavy, building AS n_fixed, machine AND urgent AS n_rush, large AS n_large,
    CASE WHEN large THEN 'review' ELSE '' END AS new_status,
    CASE WHEN large THEN 'Big refunds' WHEN machine AND amount BETWEEN -100000 AND 100000 THEN 'Repeats machinery' WHEN machine AND urgent THEN 'Urgent machines' WHEN building THEN 'Buildings' WHEN machine THEN 'Any machinery' ELSE '' END AS new_rule
  FROM base
), classed AS (
  SELECT *, CASE WHEN category <> new_category OR status <> new_status OR machine <> n_heavy THEN 'behavioural' WHEN rule <> new_rule THEN 'attribution' ELSE 'stable' END AS change_class
  FROM pairs
)"""

# --- categorise ----------------------------------------------------------------------------------------------------


def categorise_last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = categorise(orders_ledger(spark, sf_dir), parse_rules(BASE_RULES), attribution=True)
    return out.select(F.col("_row_id").alias("k"), "category", "status", "rule")


def flags_accumulate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return categorise(orders_ledger(spark, sf_dir), parse_rules(BASE_RULES)).select(F.col("_row_id").alias("k"), "flags")


def categorise_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = categorise(orders_ledger(spark, sf_dir), parse_rules(BASE_RULES))
    return out.groupBy("category").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("amount").cast("decimal(18,2)")).cast("double").alias("total"))


def chained_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = categorise(orders_ledger(spark, sf_dir), parse_rules(CHAINED_RULES))
    return out.select(F.col("_row_id").alias("k"), "category", "memo", "status", "exclude")


def many_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """400 rules: equal, prefix, suffix and contains, the data-driven forms of the compiler."""
    parts = [f'rule r{k} {{\n match:\n  - counterparty ~ "{p}"\n set:\n  - category = "c{k}"\n}}' for k, p in enumerate(MANY_PATTERNS)]
    return categorise(orders_ledger(spark, sf_dir), parse_rules("\n".join(parts))).select(F.col("_row_id").alias("k"), "category")


MANY_PATTERNS = [f"Customer#{k:09d} BUILDING" for k in range(100)] + [f"*#{k:06d}*" for k in range(100)] + [f"Customer#{k:07d}*" for k in range(100)] + [f"*{k:02d} MACHINERY" for k in range(100)]
_MANY_SQL = f"""WITH {LEDGER}, hits AS (
  SELECT k, (CASE WHEN regexp_full_match(counterparty, 'Customer#[0-9]{{9}} BUILDING') AND substr(counterparty, 10, 9)::BIGINT < 100 THEN substr(counterparty, 10, 9)::BIGINT END) AS a,
    CASE WHEN substr(counterparty, 10, 6)::BIGINT < 100 THEN 100 + substr(counterparty, 10, 6)::BIGINT END AS b,
    CASE WHEN substr(counterparty, 10, 7)::BIGINT < 100 THEN 200 + substr(counterparty, 10, 7)::BIGINT END AS c,
    CASE WHEN counterparty LIKE '% MACHINERY' THEN 300 + substr(counterparty, 17, 2)::BIGINT END AS d
  FROM ledger
)
SELECT k, coalesce('c' || coalesce(d, c, b, a)::VARCHAR, '') AS category FROM hits"""


def audit_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = audit(orders_ledger(spark, sf_dir), parse_rules(BASE_RULES), "full")
    return log.select(F.col("_row_id").alias("k"), "rule", F.col("changes.category.old").alias("old_category"), F.col("changes.category.new").alias("new_category"), F.col("changes.flags.new").alias("new_flags"), F.col("match")[0].alias("reason"))


def audit_lite(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(orders_ledger(spark, sf_dir), parse_rules(NEW_RULES), "lite").groupBy("rule").agg(F.count(F.lit(1)).alias("n"))


def audit_capped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 50 entries in rule order: a report of that many."""
    log = audit(orders_ledger(spark, sf_dir), parse_rules(BASE_RULES), "full")
    return log.orderBy("rule_idx", "_row_id").limit(50).select(F.col("_row_id").alias("k"), "rule_idx", "rule")


def rule_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fired(orders_ledger(spark, sf_dir), parse_rules(BASE_RULES)).groupBy("rule").agg(F.count(F.lit(1)).alias("n"))


# --- normalise -----------------------------------------------------------------------------------------------------


def to_number_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    plain = raw_orders(spark, sf_dir)
    european = F.col("_row_id") % 8 == 7
    amount = F.when(european, fn.to_number(F.col("amount"), ",", ".")).otherwise(fn.to_number(F.col("amount"), ".", ","))
    return plain.select(F.col("_row_id").alias("k"), amount.alias("amount"), fn.to_number(F.col("amount")).alias("default_amount"))


def parse_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates written as ISO, day-first, month-first and with a clock, read day-first."""
    d = F.col("date")
    ways = F.array(F.date_format(d, "yyyy-MM-dd"), F.date_format(d, "dd/MM/yyyy"), F.date_format(d, "dd.MM.yyyy"), F.date_format(d, "yyyy-MM-dd HH:mm:ss"), F.lit("no date"))
    rows = orders_ledger(spark, sf_dir).select(F.col("_row_id").alias("k"), F.element_at(ways, (F.col("_row_id") % 5 + 1).cast("int")).alias("text"))
    return rows.select("k", F.date_format(fn.parse_date(F.col("text"), True), "yyyy-MM-dd").alias("day"))


def amount_synthesis(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = orders_ledger(spark, sf_dir).select(F.col("_row_id").alias("k"), F.when(F.col("amount") < 0, F.col("amount")).alias("debit"), F.when(F.col("amount") >= 0, F.col("amount").cast("string")).alias("credit"))
    return synthesise_amount(rows).select("k", "amount")


def header_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = orders_ledger(spark, sf_dir).select("_row_id", F.col("date").alias(" Booking Date "), F.col("counterparty").alias("Payee"), F.col("memo").alias("Notes"), F.col("amount").alias("VALUE"))
    return canonical_headers(raw).select(F.col("_row_id").alias("k"), F.date_format("date", "yyyy-MM-dd").alias("date"), "counterparty", "memo", "amount")


def _broken(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = orders_ledger(spark, sf_dir)
    return rows.withColumns({"amount": F.when(F.col("_row_id") % 101 != 0, F.col("amount")), "date": F.when(F.col("_row_id") % 97 != 0, F.col("date")), "counterparty": F.concat(F.lit(" \u200B"), "counterparty", F.lit("\x07 "))})


def drop_guard_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drop_stats(typed(_broken(spark, sf_dir)))


def normalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = normalise(_broken(spark, sf_dir), locale=Locale(), fail_threshold=0.05)
    return out.select(F.col("_row_id").alias("k"), "counterparty", "amount", "category", "flags")


def csv_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    lead = F.element_at(F.array(*map(F.lit, ("=", " +", "-", "@", "'=", "x", "\t", ""))), (F.col("_row_id") % 8 + 1).cast("int"))
    rows = orders_ledger(spark, sf_dir).select(F.col("_row_id").alias("k"), F.concat(lead, "memo").alias("memo"), "amount")
    return guarded_columns(rows)


def csv_unguard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return csv_guard(spark, sf_dir).select("k", fn.unguarded(F.col("memo")).alias("memo"))


# --- discover ------------------------------------------------------------------------------------------------------


def _open_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return categorise(orders_ledger(spark, sf_dir), parse_rules(BASE_RULES))


def discover_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return disc.discover_all(_open_rows(spark, sf_dir))


def discover_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return disc.candidates(discover_all(spark, sf_dir), min_count=5, min_amount=400000.0, top_k=20)


def discover_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events_ledger(spark, sf_dir).withColumns({"category": F.when(F.col("counterparty") == "click", "Web").otherwise(F.lit(" ")), "exclude": F.col("counterparty") == "error"})
    return disc.discover_all(rows, since="2024-01-03").select("counterparty_fingerprint", "count", "last_seen_date", "max_abs_amount", "total_value", "sample_amount")


def suggest_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Drafts for the shortlist, which is a report of 20 rows."""
    drafts = disc.suggest((r.asDict() for r in discover_topk(spark, sf_dir).toLocalIterator()), existing=BASE_RULES, kind="exact")
    return spark.createDataFrame([(d.title, d.condition, d.text) for d in drafts], "title string, condition string, text string")


# --- verify, reconcile ---------------------------------------------------------------------------------------------


def verify_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ver.fingerprints(orders_ledger(spark, sf_dir)).select(F.col("_row_id").alias("k"), "fingerprint")


def _tampered(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = orders_ledger(spark, sf_dir)
    return rows.withColumns({"amount": F.when(F.col("_row_id") % 50 == 0, F.col("amount") + 1).otherwise(F.col("amount")), "counterparty": F.when(F.col("_row_id") % 75 == 0, F.lit("else")).otherwise(F.col("counterparty"))})


def verify_mismatches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ver.mismatches(orders_ledger(spark, sf_dir), _tampered(spark, sf_dir), "full").select(F.col("_row_id").alias("k"), "reason", "fingerprint_in", "fingerprint_out", "field_diffs")


def _external(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The categorised ledger as another system has it: some categories changed, rows gone, rows of its own."""
    rows = categorise(orders_ledger(spark, sf_dir), parse_rules(BASE_RULES)).where("_row_id % 23 <> 0")
    key = F.col("_row_id")
    day = F.date_format("date", "dd/MM/yyyy")
    own = rows.select(key.alias("txn"), day.alias("date"), F.col("amount").cast("decimal(18,2)").cast("string").alias("amount"), F.upper("counterparty").alias("counterparty"), F.when(key % 17 == 0, "Other").otherwise(F.col("category")).alias("category"), key.alias("_row_id"))
    extra = rows.where("_row_id % 29 = 0").select((-key - 1).alias("txn"), day.alias("date"), F.lit("1.00").alias("amount"), F.lit("extra").alias("counterparty"), F.lit("New").alias("category"), (-key - 1).alias("_row_id"))
    return own.unionByName(extra)


def _left(spark: SparkSession, sf_dir: str) -> DataFrame:
    return categorise(orders_ledger(spark, sf_dir), parse_rules(BASE_RULES), attribution=True).withColumn("txn", F.col("_row_id"))


KEYS = ("txn",)
PAIR_KEYS = ("txn", "date")


def _reconciled(spark: SparkSession, sf_dir: str) -> rec.Reconciliation:
    return rec.reconcile(_left(spark, sf_dir), _external(spark, sf_dir), keys=PAIR_KEYS)


def reconcile_mismatches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _reconciled(spark, sf_dir).mismatches.select("row_number", "counterparty", "differing_fields", "rule_matched", "external_category", "ledger_category")


def reconcile_orphans_left(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _reconciled(spark, sf_dir).orphans_left.select("row_number", "date", "counterparty", "category")


def reconcile_orphans_right(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _reconciled(spark, sf_dir).orphans_right.select("row_number", "date", "amount", "counterparty", "category")


def reconcile_positional(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = _left(spark, sf_dir)
    right = left.withColumn("category", F.when(F.col("_row_id") % 17 == 0, "Other").otherwise(F.col("category")))
    return rec.reconcile(left, right, identity=("amount", "counterparty")).mismatches.select("row_number", "external_category", "ledger_category")


def duplicate_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber")
    return rec.duplicate_keys(lines, ("l_orderkey", "l_linenumber"))


def date_convention(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = rec.date_evidence(orders_ledger(spark, sf_dir).select("_row_id", F.date_format("date", "dd/MM/yyyy").alias("date")))
    return out.select("day_first", "month_first", "ambiguous", "day_first_example")


# --- impact --------------------------------------------------------------------------------------------------------


def _impact(spark: SparkSession, sf_dir: str) -> imp.Impact:
    return imp.impact(orders_ledger(spark, sf_dir), parse_rules(BASE_RULES), parse_rules(NEW_RULES))


def impact_headline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return imp.headline(_impact(spark, sf_dir).compared)


def impact_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _impact(spark, sf_dir).transitions


def impact_rule_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _impact(spark, sf_dir).rule_deltas


def impact_flag_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _impact(spark, sf_dir).flag_deltas


def impact_status_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _impact(spark, sf_dir).status_deltas


def impact_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _impact(spark, sf_dir).changed_rows.select("row_number", "old_category", "new_category", "old_status", "new_status", "old_rule", "new_rule", "change_class")


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        categorise_last_wins,
        flags_accumulate,
        categorise_summary,
        chained_rules,
        many_rules,
        audit_full,
        audit_lite,
        audit_capped,
        rule_attribution,
        to_number_formats,
        parse_dates,
        amount_synthesis,
        header_map,
        drop_guard_stats,
        normalised,
        csv_guard,
        csv_unguard,
        discover_all,
        discover_topk,
        discover_events,
        suggest_rules,
        verify_fingerprints,
        verify_mismatches,
        reconcile_mismatches,
        reconcile_orphans_left,
        reconcile_orphans_right,
        reconcile_positional,
        duplicate_keys,
        date_convention,
        impact_headline,
        impact_transitions,
        impact_rule_deltas,
        impact_flag_deltas,
        impact_status_deltas,
        impact_rows,
    )
}

_FIRINGS = """
  SELECT k, 0 AS i, 'Any machinery' AS rule FROM m WHERE machine
  UNION ALL SELECT k, 1, 'Buildings' FROM m WHERE building
  UNION ALL SELECT k, 2, 'Urgent machines' FROM m WHERE machine AND urgent
  UNION ALL SELECT k, 3, 'Some customers' FROM m WHERE home
  UNION ALL SELECT k, 4, 'Big refunds' FROM m WHERE large
  UNION ALL SELECT k, 5, 'One name' FROM m WHERE known
"""

_CHAINED = f"""{LEDGER}, s AS (
  SELECT *, counterparty LIKE '%MACHINERY' AS plant, counterparty LIKE '%MACHINERY' AND memo LIKE '1-%' AS rush FROM ledger
)"""

_OPEN = f"""{OUTCOME}, f AS (
  SELECT *, trim(regexp_replace(regexp_replace(upper(counterparty), '[^A-Z0-9\\s]', ' ', 'g'), '\\s+', ' ', 'g')) AS fp FROM base WHERE category = ''
), g AS (
  SELECT fp, arg_max(counterparty, {{'d': date, 'a': abs(amount), 'k': -k}}) AS example, count(*) AS n, max(date) AS last, max(abs(amount)) AS most,
    sum(amount::DECIMAL(38,4))::DOUBLE AS total, arg_max(amount, {{'d': date, 'a': abs(amount), 'k': -k}}) AS sample
  FROM f WHERE fp <> '' GROUP BY fp
)"""

_EXTERNAL = f"""{OUTCOME}, ext AS (
  SELECT k, strftime(date, '%Y-%m-%d') AS day, printf('%.2f', amount) AS amount, upper(counterparty) AS counterparty, CASE WHEN k % 17 = 0 THEN 'Other' ELSE category END AS category FROM base WHERE k % 23 <> 0
  UNION ALL SELECT -k - 1, strftime(date, '%Y-%m-%d'), '1.00', 'extra', 'New' FROM base WHERE k % 23 <> 0 AND k % 29 = 0
)"""

_SHA = "substr(sha256(strftime({d}, '%Y-%m-%d') || '|' || printf('%.2f', {a}) || '|' || {c}), 1, 16)"
_SHA_IN, _SHA_OUT = _SHA.format(d="date", a="amount", c="counterparty"), _SHA.format(d="date", a="a2", c="c2")

ORACLES: dict[str, str] = {
    "categorise_last_wins": f"WITH {OUTCOME} SELECT k, category, status, rule FROM base",
    "flags_accumulate": f"WITH {OUTCOME} SELECT k, flags FROM base",
    "categorise_summary": f"WITH {OUTCOME} SELECT category, count(*) AS n, sum(amount::DECIMAL(18,2))::DOUBLE AS total FROM base GROUP BY category",
    "chained_rules": f"""WITH {_CHAINED} SELECT k, CASE WHEN rush THEN 'Rush' WHEN plant THEN 'Plant' ELSE '' END AS category,
      CASE WHEN rush THEN memo || ' seen' ELSE memo END AS memo, CASE WHEN rush THEN 'checked twice' ELSE '' END AS status,
      amount BETWEEN -1000000 AND -300000 AND NOT rush AS exclude FROM s""",
    "many_rules": _MANY_SQL,
    "audit_full": f"""WITH {OUTCOME}, x AS ({_FIRINGS}), y AS (SELECT x.*, m.machine, m.building, m.urgent, m.home, m.large FROM x JOIN m USING (k))
      SELECT k, rule,
        CASE rule WHEN 'Urgent machines' THEN 'Plant' END AS old_category,
        CASE rule WHEN 'Any machinery' THEN 'Plant' WHEN 'Buildings' THEN 'Property' WHEN 'Urgent machines' THEN 'Plant: rush' WHEN 'Some customers' THEN 'Home' WHEN 'One name' THEN 'Known' END AS new_category,
        CASE rule WHEN 'Any machinery' THEN 'heavy' WHEN 'Buildings' THEN 'fixed' WHEN 'Urgent machines' THEN 'heavy rush'
          WHEN 'Big refunds' THEN concat_ws(' ', CASE WHEN machine THEN 'heavy' END, CASE WHEN building THEN 'fixed' END, CASE WHEN machine AND urgent THEN 'rush' END, 'large') END AS new_flags,
        CASE rule WHEN 'Any machinery' THEN 'counterparty ~ "*MACHINERY"' WHEN 'Urgent machines' THEN 'counterparty ~ "*MACHINERY"' WHEN 'Buildings' THEN 'counterparty ~ "*building*"'
          WHEN 'Some customers' THEN 'counterparty ~ "Customer*1*HOUSEHOLD"' WHEN 'Big refunds' THEN 'amount in -500000..-250000' ELSE 'counterparty == "customer#000000007 FURNITURE"' END AS reason
      FROM y""",
    "audit_lite": f"""WITH {OUTCOME} SELECT rule, count(*) AS n FROM (
      SELECT 'Any machinery' AS rule FROM m WHERE machine UNION ALL SELECT 'Buildings' FROM m WHERE building
      UNION ALL SELECT 'Urgent machines' FROM m WHERE machine AND urgent UNION ALL SELECT 'Big refunds' FROM m WHERE large) GROUP BY rule""",
    "audit_capped": f"WITH {OUTCOME}, x AS ({_FIRINGS}) SELECT k, i AS rule_idx, rule FROM x ORDER BY i, k LIMIT 50",
    "rule_attribution": f"WITH {OUTCOME}, x AS ({_FIRINGS}) SELECT rule, count(*) AS n FROM x GROUP BY rule",
    "to_number_formats": f"""WITH {LEDGER}, a AS (SELECT k, k % 8 AS r, abs(amount) AS v FROM ledger)
      SELECT k, CASE WHEN r IN (2, 3, 4, 6) THEN -v ELSE v END AS amount, CASE WHEN r IN (2, 3, 4, 6) THEN -v WHEN r IN (0, 5) THEN v END AS default_amount FROM a""",
    "parse_dates": f"WITH {LEDGER} SELECT k, CASE WHEN k % 5 <> 4 THEN strftime(date, '%Y-%m-%d') END AS day FROM ledger",
    "amount_synthesis": f"WITH {LEDGER} SELECT k, amount FROM ledger",
    "header_map": f"WITH {LEDGER} SELECT k, strftime(date, '%Y-%m-%d') AS date, counterparty, memo, amount FROM ledger",
    "drop_guard_stats": f"WITH {LEDGER} SELECT count(*) AS total, count(*) FILTER (WHERE k % 101 = 0 OR k % 97 = 0) AS dropped FROM ledger",
    "normalised": f"WITH {LEDGER} SELECT k, counterparty, amount, '' AS category, '' AS flags FROM ledger WHERE k % 101 <> 0 AND k % 97 <> 0",
    "csv_guard": f"""WITH {LEDGER}, l AS (SELECT k, ['=', ' +', '-', '@', '''=', 'x', chr(9), ''][(k % 8 + 1)::INT] || memo AS memo, amount FROM ledger)
      SELECT k, CASE WHEN k % 8 IN (0, 1, 2, 3, 6) THEN '''' || memo ELSE memo END AS memo, amount FROM l""",
    "csv_unguard": f"""WITH {LEDGER} SELECT k, ['=', ' +', '-', '@', '=', 'x', chr(9), ''][(k % 8 + 1)::INT] || memo AS memo FROM ledger""",
    "discover_all": f"""WITH {_OPEN} SELECT fp AS counterparty_fingerprint, example AS example_counterparty_name, n AS count, strftime(last, '%Y-%m-%d') AS last_seen_date, most AS max_abs_amount,
      total AS total_value, sample AS sample_amount, strftime(last, '%Y-%m-%d') AS sample_date FROM g""",
    "discover_topk": f"""WITH {_OPEN} SELECT fp AS counterparty_fingerprint, example AS example_counterparty_name, n AS count, sample AS sample_amount, strftime(last, '%Y-%m-%d') AS sample_date
      FROM g WHERE n >= 5 OR most >= 400000 ORDER BY n DESC, fp LIMIT 20""",
    "discover_events": """SELECT upper(event_type) AS counterparty_fingerprint, count(*) AS count, strftime(max(ts), '%Y-%m-%d') AS last_seen_date, max(abs(value)) AS max_abs_amount,
      sum(value::DECIMAL(38,4))::DOUBLE AS total_value, arg_max(value, {'d': ts, 'a': abs(value), 'k': -event_id}) AS sample_amount
      FROM events WHERE event_type NOT IN ('click', 'error') AND ts >= TIMESTAMP '2024-01-03' GROUP BY 1""",
    "suggest_rules": f"""WITH {_OPEN}, t AS (SELECT * FROM g WHERE n >= 5 OR most >= 400000 ORDER BY n DESC, fp LIMIT 20), q AS (
        SELECT *, 'Suggested: ' || upper(replace(example, '#', ' ')) AS title, 'counterparty == "' || example || '"' AS condition, sample::VARCHAR AS amount_text FROM t)
      SELECT title, condition, '# SUGGESTED (freq=' || n || ', last=' || strftime(last, '%Y-%m-%d') || ', sample_amt=' || amount_text || ')' || chr(10) || '# Example: ' || example || chr(10) || '# Fingerprint: ' || fp || chr(10)
        || 'rule "' || title || '" {{' || chr(10) || '  match:' || chr(10) || '    - ' || condition || chr(10) || '  set:' || chr(10) || '    - category = "Review"' || chr(10) || '}}' || chr(10) AS text
      FROM q WHERE NOT (lower(example) = 'customer#000000007 furniture')""".replace("{{", "{").replace("}}", "}"),
    "verify_fingerprints": f"WITH {LEDGER} SELECT k, {_SHA_IN} AS fingerprint FROM ledger",
    "verify_mismatches": f"""WITH {LEDGER}, t AS (SELECT *, CASE WHEN k % 50 = 0 THEN amount + 1 ELSE amount END AS a2, CASE WHEN k % 75 = 0 THEN 'else' ELSE counterparty END AS c2 FROM ledger)
      SELECT k, 'fingerprint mismatch' AS reason, {_SHA_IN} AS fingerprint_in, {_SHA_OUT} AS fingerprint_out,
        concat_ws('; ', CASE WHEN amount <> a2 THEN 'amount: ''' || printf('%.2f', amount) || ''' -> ''' || printf('%.2f', a2) || '''' END,
          CASE WHEN counterparty <> c2 THEN 'counterparty: ''' || counterparty || ''' -> ''' || c2 || '''' END) AS field_diffs
      FROM t WHERE a2 <> amount OR c2 <> counterparty""",
    "reconcile_mismatches": f"""WITH {_EXTERNAL} SELECT base.k + 1 AS row_number, base.counterparty, 'category' AS differing_fields, rule AS rule_matched, ext.category AS external_category, base.category AS ledger_category
      FROM base JOIN ext ON base.k = ext.k AND strftime(base.date, '%Y-%m-%d') = ext.day WHERE base.category <> ext.category""",
    "reconcile_orphans_left": f"WITH {_EXTERNAL} SELECT k + 1 AS row_number, strftime(date, '%Y-%m-%d') AS date, counterparty, category FROM base WHERE k NOT IN (SELECT k FROM ext)",
    "reconcile_orphans_right": f"WITH {_EXTERNAL} SELECT k + 1 AS row_number, substr(day, 9, 2) || '/' || substr(day, 6, 2) || '/' || substr(day, 1, 4) AS date, amount, counterparty, category FROM ext WHERE k NOT IN (SELECT k FROM base)",
    "reconcile_positional": f"WITH {OUTCOME} SELECT k + 1 AS row_number, 'Other' AS external_category, category AS ledger_category FROM base WHERE k % 17 = 0",
    "duplicate_keys": "SELECT l_orderkey::VARCHAR AS l_orderkey, l_linenumber::VARCHAR AS l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1",
    "date_convention": f"""WITH {LEDGER}, d AS (SELECT k, day(date) AS a, strftime(date, '%d/%m/%Y') AS t FROM ledger)
      SELECT count(*) FILTER (WHERE a > 12) AS day_first, 0::BIGINT AS month_first, count(*) FILTER (WHERE a <= 12) AS ambiguous, arg_min(t, k) FILTER (WHERE a > 12) AS day_first_example FROM d""",
    "impact_headline": f"""WITH {CANDIDATE} SELECT count(*) AS rows_compared, count(*) FILTER (WHERE change_class = 'behavioural') AS behavioural_changed,
      count(*) FILTER (WHERE change_class = 'attribution') AS attribution_changed, count(*) FILTER (WHERE change_class = 'stable') AS rows_stable FROM classed""",
    "impact_transitions": f"""WITH {CANDIDATE} SELECT CASE WHEN category = '' THEN '(uncategorised)' ELSE category END AS old_category, CASE WHEN new_category = '' THEN '(uncategorised)' ELSE new_category END AS new_category,
      count(*) AS rows, sum(abs(amount)::DECIMAL(38,2))::DOUBLE AS indicative_amount FROM classed WHERE category <> new_category GROUP BY 1, 2""",
    "impact_rule_deltas": f"""WITH {CANDIDATE}, n AS (SELECT count(*) FILTER (WHERE machine) AS machine, count(*) FILTER (WHERE building) AS building, count(*) FILTER (WHERE machine AND urgent) AS rush,
        count(*) FILTER (WHERE home) AS home, count(*) FILTER (WHERE large) AS large, count(*) FILTER (WHERE known) AS known, count(*) FILTER (WHERE machine AND amount BETWEEN -100000 AND 100000) AS again FROM m)
      SELECT 0 AS position, 'Any machinery' AS rule, machine AS matches_baseline, machine AS matches_candidate, 0::BIGINT AS delta, 'present' AS presence FROM n
      UNION ALL SELECT 1, 'Buildings', building, building, 0, 'present' FROM n UNION ALL SELECT 2, 'Urgent machines', rush, rush, 0, 'present' FROM n
      UNION ALL SELECT 3, 'Some customers', home, 0, -home, 'removed' FROM n UNION ALL SELECT 4, 'Big refunds', large, large, 0, 'present' FROM n
      UNION ALL SELECT 5, 'One name', known, 0, -known, 'removed' FROM n UNION ALL SELECT 6, 'Repeats machinery', 0, again, again, 'new' FROM n""",
    "impact_flag_deltas": f"WITH {CANDIDATE} SELECT 'heavy' AS flag, count(*) AS rows_gained, 0::BIGINT AS rows_lost FROM classed WHERE n_heavy AND NOT machine HAVING count(*) > 0",
    "impact_status_deltas": f"WITH {CANDIDATE} SELECT 'open' AS status, count(*) AS rows_baseline, 0::BIGINT AS rows_candidate, -count(*) AS delta FROM classed WHERE status = 'open' HAVING count(*) > 0",
    "impact_rows": f"""WITH {CANDIDATE} SELECT k + 1 AS row_number, category AS old_category, new_category, status AS old_status, new_status, rule AS old_rule, new_rule, change_class FROM classed WHERE change_class <> 'stable'""",
}
