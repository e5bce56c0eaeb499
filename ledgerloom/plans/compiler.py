"""Rules to column expressions.

Rules run in order and later ones see what earlier ones wrote, but only through the fields that rules can both read and
write. So the list is cut into strata: a new one begins where a rule reads a field that an earlier rule of the stratum
writes. Within a stratum all conditions depend on its input alone; one array of the ids of the rules that fired is
computed, and every field is then set from that array at once. Most rule lists are one stratum, whatever their length.

Where the ids come from depends on the shape of a rule, as generated code has a size limit and planning time grows with the
expressions. Many rules of one condition on the same text field become data: equal values, and prefixes and suffixes of the
same length, are looked up in a literal hash table; parts of a text are one higher-order filter over a literal array; the rest are
one ``when`` each. What rules write is looked up by their id in literal arrays, so a row's cost follows the rules that fire.
"""

from __future__ import annotations

import json
import re
import zlib
from collections import defaultdict
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.text import all_of, float_text, present, strip, tokens
from ledgerloom.plans.rules import Condition, Rule, RuleError

#: A shape with at least so many rules is evaluated from data instead of one expression a rule.
MANY = 24
#: Prefixes and suffixes of up to so many lengths are looked up by length; of more, they are filtered one by one.
LENGTHS = 12
TEXT_STATE = ("category", "flags", "memo", "status")
WATCHED = (*TEXT_STATE[:2], "memo", "status", "exclude")

State = dict[str, Column]


def constant(value: object, kind: str) -> Column:
    """A literal of any type, in one call; the optimizer folds it."""
    return F.from_json(F.lit(json.dumps({"x": value})), f"struct<x:{kind}>")["x"]


def strata(rules: Sequence[Rule]) -> list[list[tuple[int, Rule]]]:
    """The rules that can fire, with their places in the list, cut where one reads what an earlier one writes."""
    found: list[list[tuple[int, Rule]]] = []
    written: set[str] = set()
    for place, rule in enumerate(rules):
        if not rule.active:
            continue
        if not found or rule.reads & written:
            found.append([])
            written = set()
        found[-1].append((place, rule))
        written |= rule.writes
    return found


def shape(value: str) -> tuple[str, str]:
    """How a wildcard value matches, and what is left of it: equal, prefix, suffix, contains or general."""
    low, stars = value.lower(), value.count("*")
    if stars == 0:
        return "equal", low
    if stars == 1 and value != "*":
        if value.endswith("*"):
            return "prefix", low[:-1]
        if value.startswith("*"):
            return "suffix", low[1:]
    if stars == 2 and len(value) > 2 and value.startswith("*") and value.endswith("*"):
        return "contains", low[1:-1]
    return "general", value


def java_regex(value: str) -> str:
    """An anchored Java pattern, in any case and over line ends, for a value with stars."""
    quote = lambda part: re.sub(r"([\\.\[\]{}()<>*+\-=!?^$|#&~\s])", r"\\\1", part)
    return r"(?siu)\A" + ".*".join(map(quote, value.split("*"))) + r"\z"


def _shape_of(condition: Condition) -> tuple[str, str]:
    if condition.op == "==":
        return "equal", str(condition.value).lower()
    return shape(str(condition.value))


def condition_column(condition: Condition, state: State, lowered: State) -> Column:
    """True where the condition holds; false for a column that is missing."""
    name = condition.field
    if name not in state:
        return F.lit(False)
    if condition.op == "in":
        return F.coalesce(state[name].between(*condition.value), F.lit(False))
    if name == "amount" and condition.op == "==":
        return F.coalesce(state[name] == F.lit(float(condition.value)), F.lit(False))
    kind, value = _shape_of(condition)
    if kind == "general":
        text = float_text(state[name]) if name == "amount" else state[name]
        return present(text).rlike(java_regex(value))
    low = lowered[name]
    return {"equal": lambda: low == F.lit(value), "prefix": lambda: low.startswith(value), "suffix": lambda: low.endswith(value), "contains": lambda: low.contains(value)}[kind]()


def _filtered(found: list[tuple[int, str]], test: Callable[[Column], Column]) -> Column:
    """The ids whose values pass ``test``, one by one."""
    pairs = F.filter(constant([{"v": v, "i": i} for i, v in found], "array<struct<v:string,i:int>>"), lambda x: test(x["v"]))
    return F.transform(pairs, lambda x: x["i"])


def _looked_up(found: list[tuple[int, str]], key: Column) -> Column:
    """The ids whose value is ``key``, from a hash table of short buckets."""
    by_value: dict[str, list[int]] = defaultdict(list)
    for place, value in found:
        by_value[value].append(place)
    size = 2 * len(by_value) + 1
    buckets: list[list[dict]] = [[] for _ in range(size)]
    for value, places in by_value.items():
        buckets[zlib.crc32(value.encode()) % size].append({"v": value, "i": places})
    table = constant(buckets, "array<array<struct<v:string,i:array<int>>>>")
    bucket = F.element_at(table, (F.crc32(key.cast("binary")) % size).cast("int") + 1)
    return F.flatten(F.transform(F.filter(bucket, lambda x: x["v"] == key), lambda x: x["i"]))


def _from_data(kind: str, found: list[tuple[int, str]], low: Column) -> list[Column]:
    """Arrays of the ids of rules of one shape that fire."""
    lengths = sorted({len(value) for _, value in found})
    if kind == "equal":
        return [_looked_up(found, low)]
    if kind == "contains" or len(lengths) > LENGTHS:
        return [_filtered(found, {"prefix": low.startswith, "suffix": low.endswith, "contains": low.contains}[kind])]
    end = (lambda n: F.substring(low, 1, n)) if kind == "prefix" else (lambda n: F.right(low, F.lit(n)))
    return [_looked_up([x for x in found if len(x[1]) == n], end(n)) for n in lengths]


def fired_ids(stratum: list[tuple[int, Rule]], state: State, lowered: State) -> Column:
    """The ids, ascending, of the rules of a stratum that fire."""
    grouped: dict[tuple[str, str], list[tuple[int, str]]] = defaultdict(list)
    for place, rule in stratum:
        first = rule.match[0]
        if len(rule.match) == 1 and first.op != "in" and first.field in state and not (first.field == "amount" and first.op == "=="):
            kind, value = _shape_of(first)
            if kind != "general":
                grouped[first.field, kind].append((place, value))
    many = {key: found for key, found in grouped.items() if len(found) >= MANY}
    dealt = {place for found in many.values() for place, _ in found}
    parts = [part for (name, kind), found in sorted(many.items()) for part in _from_data(kind, found, lowered[name])]
    single = [F.when(all_of([condition_column(c, state, lowered) for c in rule.match]), F.lit(place)) for place, rule in stratum if place not in dealt]
    if not parts:
        return F.array_compact(F.array(*single))
    return F.array_sort(F.concat(*parts, *([F.array_compact(F.array(*single))] if single else [])))


def _appended(current: Column, value: Column) -> Column:
    return strip(F.concat(current, F.when(current != "", F.lit(" ")).otherwise(F.lit("")), value))


def net_effect(rule: Rule, field: str) -> tuple[str | None, list[str]]:
    """What a rule does to a text field: a value that replaces it, if any, and values then added in turn."""
    assigned, added = None, []
    for action in rule.set:
        if action.field == field:
            if action.op == "=":
                assigned, added = str(action.value), []
            elif assigned is not None and field != "flags":
                assigned = f"{assigned}{' ' if assigned else ''}{action.value}".strip()
            else:
                added.append(str(action.value))
    return assigned, added


def _by_rule(size: int, values: dict[int, object], kind: str) -> Column:
    """A literal array of a value for each rule id, null where there is none."""
    return constant([values.get(k) for k in range(size)], f"array<{kind}>")


def _effects(fired: Column, values: Column) -> Column:
    """The values of the rules that fired, in order, without those that have none."""
    return F.filter(F.transform(fired, lambda i: F.element_at(values, i + 1)), lambda x: x.isNotNull())


def _text_field(field: str, size: int, stratum: list[tuple[int, Rule]], old: Column, fired: Column) -> Column:
    effects = {place: net_effect(rule, field) for place, rule in stratum if field in rule.writes}
    if field == "flags":
        added = F.flatten(_effects(fired, _by_rule(size, {k: a for k, (_, a) in effects.items()}, "array<string>")))
        return F.when(F.size(added) > 0, F.array_join(F.array_distinct(F.concat(tokens(old), added)), " ")).otherwise(old)
    if not any(added for _, added in effects.values()):
        return F.coalesce(F.try_element_at(_effects(fired, _by_rule(size, {k: v for k, (v, _) in effects.items()}, "string")), F.lit(-1)), old)
    steps = _effects(fired, _by_rule(size, {k: {"value": v, "added": a} for k, (v, a) in effects.items()}, "struct<value:string,added:array<string>>"))
    return F.aggregate(steps, old, lambda now, step: F.aggregate(step["added"], F.coalesce(step["value"], now), _appended))


def _exclude(size: int, stratum: list[tuple[int, Rule]], old: Column, fired: Column) -> Column:
    setters = {place: bool([a.value for a in rule.set if a.field == "exclude"][-1]) for place, rule in stratum if "exclude" in rule.writes}
    return F.coalesce(F.try_element_at(_effects(fired, _by_rule(size, setters, "boolean")), F.lit(-1)), old)


@dataclass(frozen=True)
class Compiled:
    """Rules ready for any ledger."""

    rules: tuple[Rule, ...]

    @property
    def names(self) -> list[str]:
        return [rule.name for rule in self.rules]

    def uses_exclude(self) -> bool:
        return any("exclude" in rule.writes for rule in self.rules)

    def apply(self, df: DataFrame, prefix: str = "", keep_before: bool = False) -> DataFrame:
        """Adds ``{prefix}category``, ``flags``, ``memo``, ``status``, perhaps ``exclude``, and ``{prefix}fired``.

        ``fired`` has the ids of all rules that fired, in order. With ``keep_before`` every stratum's own array is kept
        as ``{prefix}fired_0``, ... for the audit.
        """
        name = lambda field: f"{prefix}{field}"
        exclude = self.uses_exclude() or "exclude" in df.columns
        start = {name(f): present(F.col(f"`{f}`")) if f in df.columns else F.lit("") for f in TEXT_STATE}
        if exclude:
            flag = F.lower(strip(F.col("exclude").cast("string"))) == "true" if "exclude" in df.columns else F.lit(False)
            start[name("exclude")] = F.coalesce(flag, F.lit(False))
        out = df.withColumns(start)
        layers = strata(self.rules)
        for k, stratum in enumerate(layers):
            state = {f: F.col(f"`{f}`") for f in ("counterparty", "amount") if f in df.columns} | {f: F.col(f"`{name(f)}`") for f in TEXT_STATE}
            read = {f for _, rule in stratum for f in rule.reads if f in state}
            low = {f"_low_{f}": F.lower(float_text(state[f]) if f == "amount" else present(state[f])) for f in read}
            out = out.withColumns(low) if low else out
            lowered = {f: F.col(f"_low_{f}") for f in read}
            out = out.withColumn(name(f"fired_{k}"), fired_ids(stratum, state, lowered))
            fired = F.col(f"`{name(f'fired_{k}')}`")
            new = {name(f): _text_field(f, len(self.rules), stratum, F.col(f"`{name(f)}`"), fired) for f in TEXT_STATE if any(f in rule.writes for _, rule in stratum)}
            if any("exclude" in rule.writes for _, rule in stratum):
                new[name("exclude")] = _exclude(len(self.rules), stratum, F.col(f"`{name('exclude')}`"), fired)
            out = (out.withColumns(new) if new else out).drop(*low)
        every = [F.col(f"`{name(f'fired_{k}')}`") for k in range(len(layers))]
        out = out.withColumn(name("fired"), F.concat(*every) if every else F.array().cast("array<int>"))
        return out if keep_before else out.drop(*(name(f"fired_{k}") for k in range(len(layers))))

    def step(self, state: Column, place: Column, exclude: bool) -> Column:
        """The state (a struct of the watched fields) after the rule ``place``; the rule by rule form, for the audit."""
        places, n = [k for k, rule in enumerate(self.rules) if rule.active], len(self.rules)
        of = lambda values, kind: F.element_at(_by_rule(n, values, kind), place + 1)
        fields = []
        for field in TEXT_STATE:
            effects = {k: net_effect(self.rules[k], field) for k in places}
            value, added = of({k: v for k, (v, _) in effects.items()}, "string"), of({k: a for k, (_, a) in effects.items()}, "array<string>")
            if field == "flags":
                new = F.when(F.size(added) > 0, F.array_join(F.array_distinct(F.concat(tokens(state[field]), added)), " ")).otherwise(state[field])
            else:
                new = F.aggregate(added, F.coalesce(value, state[field]), _appended)
            fields.append(new.alias(field))
        if exclude:
            setters = {k: bool([a.value for a in self.rules[k].set if a.field == "exclude"][-1]) for k in places if "exclude" in self.rules[k].writes}
            fields.append(F.coalesce(of(setters, "boolean"), state["exclude"]).alias("exclude"))
        return F.struct(*fields)


def compile_rules(rules: Sequence[Rule], columns: Sequence[str] | None = None, strict: bool = False) -> Compiled:
    """Rules ready for a ledger; ``strict`` makes a condition on a column that isn't there an error."""
    if strict and columns is not None:
        for rule in rules:
            if gone := [c.field for c in rule.match if c.field not in columns and c.field not in TEXT_STATE]:
                raise RuleError(f"rule {rule.name!r} needs the missing column {gone[0]!r}")
    return Compiled(tuple(rules))
