"""What a candidate rule list would change: both lists are applied in one pass, and the results compared."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.text import present, tokens
from ledgerloom.operators.categorise import last_rule, rule_name
from ledgerloom.plans.compiler import compile_rules
from ledgerloom.plans.rules import Rule

UNCATEGORISED = "(uncategorised)"
OUTCOMES = ("category", "flags", "status")


def compare(df: DataFrame, baseline: Sequence[Rule], candidate: Sequence[Rule], key: str = "_row_id") -> DataFrame:
    """Every row with ``old_*`` and ``new_*`` outcomes, rules and fired ids, and ``change_class``: no join, no shuffle.

    A change is behavioural if category, the set of flags, or status differ; attribution if only the last rule that fired
    does; memo and exclude don't count.
    """
    a, b = compile_rules(baseline), compile_rules(candidate)
    both = b.apply(a.apply(df, "old_"), "new_")
    both = both.withColumns({"old_rule": last_rule(a.names, F.col("old_fired")), "new_rule": last_rule(b.names, F.col("new_fired"))})
    same_flags = F.array_sort(tokens(F.col("old_flags"))) == F.array_sort(tokens(F.col("new_flags")))
    behavioural = (F.col("old_category") != F.col("new_category")) | (F.col("old_status") != F.col("new_status")) | ~same_flags
    kind = F.when(behavioural, "behavioural").when(F.col("old_rule") != F.col("new_rule"), "attribution").otherwise("stable")
    context = [present(F.col(c)).alias(c) if c in df.columns else F.lit("").alias(c) for c in ("counterparty",)]
    kept = [F.col(c) for c in ("amount", "date") if c in df.columns] + [F.col("memo") if "memo" in df.columns else F.lit("").alias("memo")]
    pairs = [F.col(f"{side}_{f}") for f in (*OUTCOMES, "rule", "fired") for side in ("old", "new")]
    return both.select(key, *context, *kept, *pairs, kind.alias("change_class"))


def headline(compared: DataFrame) -> DataFrame:
    """One row: rows compared, and how many of each class."""
    count = lambda kind: F.count_if(F.col("change_class") == kind)
    return compared.agg(F.count(F.lit(1)).alias("rows_compared"), count("behavioural").alias("behavioural_changed"), count("attribution").alias("attribution_changed"), count("stable").alias("rows_stable"))


def transitions(compared: DataFrame) -> DataFrame:
    """Rows and absolute amounts by old and new category, of rows whose category changed."""
    name = lambda c: F.when(F.col(c) == "", UNCATEGORISED).otherwise(F.col(c)).alias(c)
    amount = F.sum(F.abs(F.coalesce(F.col("amount"), F.lit(0.0))).cast("decimal(38,4)"))
    out = compared.where("old_category <> new_category").groupBy(name("old_category"), name("new_category"))
    return out.agg(F.count(F.lit(1)).alias("rows"), F.round(amount, 2).cast("double").alias("indicative_amount"))


def rule_deltas(compared: DataFrame, baseline: Sequence[Rule], candidate: Sequence[Rule]) -> DataFrame:
    """Rows that each rule fired on before and after, by name; ``position`` is the order: baseline, then new rules.

    Counts come from one explode and one partial aggregation; the names are those of the rule lists.
    """
    spark = compared.sparkSession
    before, after = [r.name for r in baseline], [r.name for r in candidate]
    order = list(dict.fromkeys([*before, *after]))
    presence = [("present" if n in before and n in after else "removed" if n in before else "new") for n in order]
    names = spark.createDataFrame([(k, n, p) for k, (n, p) in enumerate(zip(order, presence, strict=True))], "position int, rule string, presence string")
    hits = compared.select(F.explode("old_fired").alias("i")).select(rule_name(before, F.col("i")).alias("rule"), F.lit(0).alias("side"))
    hits = hits.union(compared.select(F.explode("new_fired").alias("i")).select(rule_name(after, F.col("i")).alias("rule"), F.lit(1).alias("side")))
    counts = hits.groupBy("rule").agg(F.count_if(F.col("side") == 0).alias("a"), F.count_if(F.col("side") == 1).alias("b"))
    n = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    return names.join(counts, "rule", "left").select("position", "rule", n("a").alias("matches_baseline"), n("b").alias("matches_candidate"), (n("b") - n("a")).alias("delta"), "presence")


def flag_deltas(compared: DataFrame) -> DataFrame:
    """Rows that gained and lost each flag, of flags with any."""
    old, new = tokens(F.col("old_flags")), tokens(F.col("new_flags"))
    marks = lambda found, gain: F.transform(found, lambda t: F.struct(t.alias("flag"), F.lit(gain).alias("gain")))
    moved = compared.select(F.explode(F.concat(marks(F.array_except(new, old), 1), marks(F.array_except(old, new), 0))).alias("m"))
    return moved.groupBy(F.col("m.flag").alias("flag")).agg(F.count_if(F.col("m.gain") == 1).alias("rows_gained"), F.count_if(F.col("m.gain") == 0).alias("rows_lost"))


def status_deltas(compared: DataFrame) -> DataFrame:
    """Rows of each status before and after, of statuses whose number changed."""
    both = compared.select(F.explode(F.array(F.struct(F.col("old_status").alias("s"), F.lit(0).alias("side")), F.struct(F.col("new_status").alias("s"), F.lit(1).alias("side")))).alias("x"))
    out = both.where("x.s <> ''").groupBy(F.col("x.s").alias("status")).agg(F.count_if(F.col("x.side") == 0).alias("rows_baseline"), F.count_if(F.col("x.side") == 1).alias("rows_candidate"))
    return out.where("rows_baseline <> rows_candidate").withColumn("delta", F.col("rows_candidate") - F.col("rows_baseline"))


def changed_rows(compared: DataFrame, key: str = "_row_id") -> DataFrame:
    """The rows whose outcome or attribution changed, numbered from 1."""
    out = compared.where("change_class <> 'stable'").withColumn("row_number", F.col(key) + 1)
    return out.select("row_number", *(c for c in compared.columns if c not in (key, "old_fired", "new_fired")))


@dataclass
class Impact:
    """What differs, as frames; each is planned when it is first asked for."""

    compared: DataFrame
    baseline: Sequence[Rule]
    candidate: Sequence[Rule]
    key: str = "_row_id"

    transitions = cached_property(lambda self: transitions(self.compared))
    rule_deltas = cached_property(lambda self: rule_deltas(self.compared, self.baseline, self.candidate))
    flag_deltas = cached_property(lambda self: flag_deltas(self.compared))
    status_deltas = cached_property(lambda self: status_deltas(self.compared))
    changed_rows = cached_property(lambda self: changed_rows(self.compared, self.key))

    def summary(self) -> dict[str, int]:
        return headline(self.compared).first().asDict()


def impact(df: DataFrame, baseline: Sequence[Rule], candidate: Sequence[Rule], key: str = "_row_id") -> Impact:
    return Impact(compare(df, baseline, candidate, key), baseline, candidate, key)
