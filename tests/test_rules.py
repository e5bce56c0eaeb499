from __future__ import annotations

import pytest

from ledgerloom.plans.packs import PACKS, as_text, pack
from ledgerloom.plans.rules import Action, Condition, RuleError, inert, load_rules, parse_action, parse_condition, parse_rules, text_digest, unquoted, without_comment


@pytest.mark.parametrize(
    ("text", "field", "op", "value"),
    [
        ('counterparty == "A b"', "counterparty", "==", "A b"),
        ("Counterparty ~ *x*", "counterparty", "~", "*x*"),
        ("amount in -5..10.5", "amount", "in", (-5.0, 10.5)),
        ("amount in 0..0", "amount", "in", (0.0, 0.0)),
        ("amount == 12", "amount", "==", 12.0),
        ('amount ~ "1*"', "amount", "~", "1*"),
        ("memo == 'it\\'s'", "memo", "==", "it's"),
        ('memo == ""', "memo", "==", ""),
    ],
)
def test_conditions(text, field, op, value):
    assert parse_condition(text) == Condition(field, op, value, text)


@pytest.mark.parametrize("text", ["date == x", "amount in 5..1", "memo in 1..2", "amount == x", "amount == inf", "memo > 3", "memo ==", "amount in 1..inf", "memo=='a'"])
def test_bad_conditions(text):
    with pytest.raises(RuleError):
        parse_condition(text)


def test_actions():
    assert parse_action("exclude") == Action("exclude", "=", True, "exclude")
    assert parse_action("exclude = false").value is False
    assert parse_action("exclude = yes").value is False
    assert parse_action("memo+=x") == Action("memo", "+=", "x", "memo+=x")
    for bad in ("flags = x", 'flags += "a b"', "date = x", "exclude += true", "category", "amount = 3"):
        with pytest.raises(RuleError):
            parse_action(bad)


def test_unquoting_resolves_backslashes_before_quotes():
    assert unquoted(r'"a\\"') == "a\\"
    assert unquoted("plain") == "plain"


def test_comments():
    assert without_comment('a "# no" # yes') == 'a "# no"'
    assert without_comment("x // y") == "x"
    assert without_comment("'//' z") == "'//' z"


def test_rule_text():
    rules = parse_rules('\uFEFF# top\nRULE "a # b" {\nmatch:\n - memo == x # c\nset:\n - category = "y"\n}\nrule \'q\' { match:\n amount in 1..2\nset:\nflags += t\n}\nrule bare {\n}\n')
    assert [r.name for r in rules] == ["a # b", "q", "bare"]
    assert rules[1].match[0].value == (1.0, 2.0)
    assert inert(rules) == ["bare"]


def test_a_rule_on_one_line_never_fires():
    rules = parse_rules('rule "t" { match: - counterparty == "x" set: - category = "y" }')
    assert inert(rules) == ["t"]


def test_a_brace_ends_a_block_even_inside_quotes():
    rules = parse_rules('rule x {\nmatch:\n - memo == "a}"\nset:\n - category = b\n}')
    assert inert(rules) == ["x"]


def test_files_in_order(tmp_path):
    for name in "ab":
        (tmp_path / name).write_text(f"rule {name} {{\nmatch:\n memo == x\nset:\n category = {name}\n}}")
    assert [r.name for r in load_rules(tmp_path / "a", tmp_path / "b")] == ["a", "b"]
    with pytest.raises(FileNotFoundError):
        load_rules(tmp_path / "c")


def test_packs():
    assert {name: len(pack(name)) for name in PACKS} == {"retail": 7, "transport": 7, "subs": 5, "subscriptions": 5, "travel": 5, "financial": 5, "compliance": 4, "sanity": 3, "examples": 5}
    assert all(r.active for name in PACKS for r in pack(name))
    assert [len(r.set) for r in pack("compliance")] == [1] * 4
    assert parse_rules(as_text(pack("travel"))) == pack("travel")
    with pytest.raises(RuleError):
        pack("none")


def test_digest_leaves_out_marks():
    assert text_digest("# --- BEGIN a ---\nrule\n# --- END ---") == text_digest("rule")
    assert text_digest("a") != text_digest("b")
