"""Categorise a ledger by rules, and audit which rule changed what."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.plans.compiler import TEXT_STATE, WATCHED, compile_rules, constant
from ledgerloom.plans.rules import Rule

AUDIT_CAP = 5000


def categorise(df: DataFrame, rules: Sequence[Rule], attribution: bool = False, strict: bool = False) -> DataFrame:
    """The ledger with category, flags, memo, status and, where rules or the ledger use it, exclude set by the rules.

    Row-local: one projection, no shuffle, so it holds for streams too. ``attribution`` adds ``rule``, the name of the last
    rule that fired, empty if none did.
    """
    compiled = compile_rules(rules, df.columns, strict)
    out = compiled.apply(df)
    if attribution:
        out = out.withColumn("rule", last_rule(compiled.names, F.col("fired")))
    return out.drop("fired")


def rule_name(names: Sequence[str], place: Column) -> Column:
    """The name of the rule at ``place``, which is never null."""
    return F.element_at(constant(list(names), "array<string>"), place + 1) if names else F.lit("")


def last_rule(names: Sequence[str], fired: Column) -> Column:
    """The name of the last rule that fired, empty if none did."""
    return F.when(F.size(fired) > 0, rule_name(names, F.element_at(fired, F.lit(-1)))).otherwise(F.lit(""))


def fired(df: DataFrame, rules: Sequence[Rule], key: str = "_row_id") -> DataFrame:
    """A row ``(key, rule_idx, rule)`` per row and rule that fired on it."""
    compiled = compile_rules(rules, df.columns)
    hits = compiled.apply(df).select(key, F.explode("fired").alias("rule_idx"))
    return hits.withColumn("rule", rule_name(compiled.names, F.col("rule_idx")))


def audit(df: DataFrame, rules: Sequence[Rule], mode: str = "lite", key: str = "_row_id") -> DataFrame:
    """A row per rule and ledger row: ``key, rule_idx, rule, changes`` and, in full mode, ``match`` and ``set``.

    ``changes`` has, in order, category, flags, memo, status and exclude, each null or (old, new) with the empty text as
    null. Lite mode has what changed something; full mode has every firing. There is no cap here; see :func:`capped`.
    """
    if mode not in ("lite", "full"):
        raise ValueError(f"an audit is lite or full, not {mode!r}")
    compiled = compile_rules(rules, df.columns)
    exclude = compiled.uses_exclude() or "exclude" in df.columns
    fields = [f for f in WATCHED if f != "exclude" or exclude]
    # the state before the first rule is that of no rules at all
    before = compile_rules([]).apply(df.withColumn("exclude", F.lit(False)) if exclude and "exclude" not in df.columns else df, "_was_")
    both = compiled.apply(before)
    start = F.struct(*(F.col(f"_was_{f}").alias(f) for f in [*TEXT_STATE, *(["exclude"] if exclude else [])]))
    empty = F.array().cast("array<struct<rule_idx:int,old:struct<" + _types(exclude) + ">,new:struct<" + _types(exclude) + ">>>")

    def one(now: Column, place: Column) -> Column:
        new = compiled.step(now["state"], place, exclude)
        return F.struct(new.alias("state"), F.concat(now["log"], F.array(F.struct(place.alias("rule_idx"), now["state"].alias("old"), new.alias("new")))).alias("log"))

    log = F.aggregate("fired", F.struct(start.alias("state"), empty.alias("log")), one)["log"]
    rows = both.select(key, F.explode(log).alias("e"))

    def change(field: str) -> Column:
        old, new = F.col(f"e.old.{field}"), F.col(f"e.new.{field}")
        shown = (old, new) if field == "exclude" else (F.nullif(old, F.lit("")), F.nullif(new, F.lit("")))
        return F.when(old != new, F.struct(shown[0].alias("old"), shown[1].alias("new"))).alias(field)

    out = rows.select(key, F.col("e.rule_idx").alias("rule_idx"), rule_name(compiled.names, F.col("e.rule_idx")).alias("rule"), F.struct(*(change(f) for f in fields)).alias("changes"))
    if mode == "lite":
        changed = F.lit(False)
        for f in fields:
            changed = changed | F.col(f"changes.{f}").isNotNull()
        return out.where(changed)
    sources = lambda part: constant([[x.source for x in getattr(rule, part)] for rule in rules], "array<array<string>>")
    return out.withColumn("match", F.element_at(sources("match"), F.col("rule_idx") + 1)).withColumn("set", F.element_at(sources("set"), F.col("rule_idx") + 1))


def _types(exclude: bool) -> str:
    return ",".join(f"{f}:string" for f in TEXT_STATE) + ",exclude:boolean" * exclude


def capped(log: DataFrame, cap: int = AUDIT_CAP, key: str = "_row_id") -> tuple[DataFrame, bool]:
    """The first ``cap`` entries in the order of rules, then rows, and whether there are more."""
    first = log.orderBy("rule_idx", key).limit(cap)
    return first, log.limit(cap + 1).count() > cap
