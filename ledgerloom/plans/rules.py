"""Rule text to rules: ordered ``match`` conditions and ``set`` actions, checked when they are read.

    rule "Retail: Corner shop" {
      match:
        - counterparty ~ "*CORNER*"
        - amount in -50..0
      set:
        - category = "Groceries"
        - flags += "Retail"
    }

Comments start with # or // outside quotes. Conditions of a rule are joined by and. What stands on the same line behind
``match:`` or ``set:`` is not read, so a rule on one line has no conditions; it is kept, never fires, and
:func:`inert` names it. A quoted ``}`` ends a block, and a name holds no quote of its own kind.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterable
from dataclasses import dataclass, field
from pathlib import Path

MATCHABLE = ("counterparty", "amount", "category", "flags", "status", "memo")
SETTABLE = ("category", "status", "memo", "flags", "exclude")
TEXT = ("category", "status", "memo", "flags")


class RuleError(ValueError):
    """A rule that can't be read."""


@dataclass(frozen=True)
class Condition:
    field: str
    op: str  # "==", "~" or "in"
    value: str | float | tuple[float, float]
    source: str = ""


@dataclass(frozen=True)
class Action:
    field: str
    op: str  # "=" or "+="
    value: str | bool
    source: str = ""


@dataclass(frozen=True)
class Rule:
    name: str
    match: tuple[Condition, ...] = ()
    set: tuple[Action, ...] = field(default=())

    @property
    def active(self) -> bool:
        return bool(self.match and self.set)

    @property
    def reads(self) -> set[str]:
        return {c.field for c in self.match}

    @property
    def writes(self) -> set[str]:
        return {a.field for a in self.set}


QUOTED = r'"(?:\\.|[^"\\])*"' + "|" + r"'(?:\\.|[^'\\])*'"
NUMBER = r"-?\d+(?:\.\d+)?"
CONDITION = re.compile(rf"\s*(\w+)\s+(==|~|in)\s+({QUOTED}|{NUMBER}\s*\.\.\s*{NUMBER}|\S+)\s*\Z")
ACTION = re.compile(rf"\s*(\w+)\s*(\+=|=)\s*({QUOTED}|\S+)\s*\Z")
BLOCK = re.compile(r"""rule\s+(?:"([^"]*)"|'([^']*)'|(\S+))\s*\{(.*?)\}""", re.I | re.S)


def unquoted(text: str) -> str:
    """The text inside quotes; a doubled backslash is resolved before an escaped quote."""
    if len(text) < 2 or text[0] != text[-1] or text[0] not in "\"'":
        return text
    return text[1:-1].replace("\\\\", "\\").replace(f"\\{text[0]}", text[0])


def _finite(text: str) -> float:
    try:
        value = float(text)
    except ValueError:
        raise RuleError(f"{text!r} is not a number") from None
    if not math.isfinite(value):
        raise RuleError(f"{text!r} is not a finite number")
    return value


def parse_condition(text: str) -> Condition:
    found = CONDITION.match(text)
    if not found:
        raise RuleError(f"invalid condition {text!r}: expected field, one of == ~ in, and a value")
    name, op, raw = found[1].lower(), found[2], unquoted(found[3])
    if name not in MATCHABLE:
        raise RuleError(f"unknown field {name!r} in {text!r}")
    if op == "in":
        if name != "amount":
            raise RuleError(f"'in' holds for amount only: {text!r}")
        low, dots, high = raw.partition("..")
        if not dots:
            raise RuleError(f"a range is low..high: {text!r}")
        bounds = _finite(low.strip()), _finite(high.strip())
        if bounds[0] > bounds[1]:
            raise RuleError(f"the range's low end is above its high end: {text!r}")
        return Condition(name, op, bounds, text)
    if op == "==" and name == "amount":
        return Condition(name, op, _finite(raw), text)
    return Condition(name, op, raw, text)


def parse_action(text: str) -> Action:
    if text.strip().lower() == "exclude":
        return Action("exclude", "=", True, text)
    found = ACTION.match(text)
    if not found:
        raise RuleError(f"invalid action {text!r}: expected field = value or field += value")
    name, op, value = found[1].lower(), found[2], unquoted(found[3])
    if name not in SETTABLE:
        raise RuleError(f"unknown field {name!r} in {text!r}")
    if name == "flags" and op == "=":
        raise RuleError(f"flags can only be added to, with +=: {text!r}")
    if op == "+=" and name not in TEXT:
        raise RuleError(f"+= holds for text fields only: {text!r}")
    if name == "flags" and re.search(r"\s", value):
        raise RuleError(f"a flag holds no white space: {text!r}")
    if name == "exclude":
        return Action(name, op, value.strip().lower() == "true", text)
    return Action(name, op, value, text)


def without_comment(line: str) -> str:
    """The line up to a # or // that isn't inside quotes."""
    quote = ""
    for at, char in enumerate(line):
        if quote:
            quote = "" if char == quote else quote
        elif char in "\"'":
            quote = char
        elif char == "#" or line.startswith("//", at):
            return line[:at].rstrip()
    return line


def parse_rules(text: str) -> list[Rule]:
    """The rules of a text, in order. Any condition or action that can't be read is an error that names its rule."""
    rules = []
    for found in BLOCK.finditer(text.removeprefix("\ufeff")):
        name = next(x for x in found.groups()[:3] if x is not None)
        parts: dict[str, list] = {"match": [], "set": []}
        section, parse = None, {"match": parse_condition, "set": parse_action}
        for raw in found[4].splitlines():
            line = without_comment(raw).strip()
            head = next((x for x in parts if line.lower().startswith(f"{x}:")), None)
            if head:
                section = head
            elif line and section:
                try:
                    parts[section].append(parse[section](line.removeprefix("-").strip()))
                except RuleError as error:
                    raise RuleError(f"rule {name!r}: {error}") from None
        rules.append(Rule(name, tuple(parts["match"]), tuple(parts["set"])))
    return rules


def inert(rules: Iterable[Rule]) -> list[str]:
    """Names of rules without a condition or an action, which never fire."""
    return [rule.name for rule in rules if not rule.active]


def load_rules(*sources: str | Path) -> list[Rule]:
    """The rules of files in order, so a later one wins. A missing source is an error."""
    return [rule for source in sources for rule in parse_rules(Path(source).read_text(encoding="utf-8-sig"))]


def text_digest(text: str) -> str:
    """SHA-256 of rule text without the lines that mark where a combined source begins and ends."""
    kept = (line for line in text.removeprefix("\ufeff").splitlines() if not line.strip().startswith(("# --- BEGIN", "# --- END")))
    return hashlib.sha256("\n".join(kept).encode()).hexdigest()
