"""The rules, row by row in plain Python: a second reading of what the compiler must do."""

from __future__ import annotations

import re


def matches(condition, row) -> bool:
    value = row.get(condition.field)
    if condition.field not in row:
        return False
    if condition.op == "in":
        return value is not None and condition.value[0] <= value <= condition.value[1]
    if condition.field == "amount":
        if condition.op == "==":
            return value == condition.value
        value = str(value)
    text = value or ""
    if condition.op == "==" or "*" not in condition.value:
        return text.lower() == condition.value.lower()
    return re.match("(?s)" + ".*".join(map(re.escape, condition.value.split("*"))) + r"\Z", text, re.I) is not None


def run(rules, rows):
    """The rows after all rules, and per rule and row the state before and after."""
    rows = [{"category": "", "flags": "", "memo": "", "status": "", "exclude": False} | {k: v if v is not None or k == "amount" else "" for k, v in row.items()} for row in rows]
    log = []
    for place, rule in enumerate(rules):
        if not rule.match or not rule.set:
            continue
        for n, row in enumerate(rows):
            if not all(matches(c, row) for c in rule.match):
                continue
            before = dict(row)
            for action in rule.set:
                if action.field == "exclude" or action.op == "=":
                    row[action.field] = action.value
                    continue
                old = row[action.field]
                merged = (old + (" " if old else "") + action.value).strip()
                row[action.field] = " ".join(dict.fromkeys(merged.split())) if action.field == "flags" else merged
            log.append((place, n, before, dict(row)))
    return rows, log
