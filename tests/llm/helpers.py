"""Tables for the tests: every case that an operator must take, and plain re-computations."""

from __future__ import annotations

import random

SYLLABLES = {
    "en": ["the", "and", "ing", "er", "th", "wh", "ou", "ly", "sh", "of", "ed"],
    "de": ["der", "und", "sch", "ung", "ein", "ver", "keit", "zu", "ü", "ß", "pf"],
    "fr": ["le", "que", "eau", "oi", "tion", "é", "è", "ç", "ment", "aux", "les"],
}


def prose(lang: str, words: int, seed: int) -> str:
    rnd = random.Random(f"{lang}{seed}")
    return " ".join("".join(rnd.choice(SYLLABLES[lang]) for _ in range(rnd.randint(1, 4))) for _ in range(words))


#: Columns that have the names that operators use inside.
CLASHING = "doc_id long, text string, lang string, source string, n_chars long, size long, fp long, row long, score double, _row long, _key double, key string, component_id long, n int"


def documents(spark, rows):
    """``rows`` of (doc_id, text, lang, source) with clashing extra columns."""
    full = [(i, t, lang, source, None if t is None else len(t), 7, 7, 7, 0.5, 7, 0.5, "k", 7, 7) for i, t, lang, source in rows]
    return spark.createDataFrame(full, CLASHING)


def awkward(spark):
    """Null and empty texts, nulls in all columns, a repeated row, a repeated id, no words, a very long text."""
    rows = [
        (0, None, "en", "a"),
        (1, "", "en", "a"),
        (2, " \t\n", None, None),
        (None, prose("en", 30, 1), None, "b"),
        (4, prose("en", 30, 2), "en", "b"),
        (4, prose("en", 30, 2), "en", "b"),
        (4, prose("de", 30, 3), "de", None),
        (7, prose("fr", 30000, 4), "fr", "a"),
        (8, "1234 !!! 5", "de", "b"),
        (9, "one", "en", "b"),
        (10, "日本語 テキスト 😀 é", None, "a"),
        (None, None, None, None),
    ]
    return documents(spark, rows), rows


def by_id(rows, *names):
    return sorted(((tuple(r[n] for n in names)) for r in rows), key=repr)
