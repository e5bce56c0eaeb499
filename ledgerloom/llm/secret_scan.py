"""Secret scans: three fixed kinds, and a linear-chain conditional random field that adds spans.

The fixed kinds are found by their patterns in the whole text, leftmost and non-overlapping per kind; matches that are too
short are consumed and dropped. The field tags the text's words (runs other than space and tab to carriage return) as
secret begin (B), inside (I) or outside (O). Its features are a word's shape (length, digits, case, symbols, hexadecimal,
changes between classes), whether it or a word before it names a secret, the shapes of its neighbours, and features of the
file (shares of digits and of code symbols). It is trained here, once per driver, by its likelihood on texts written by
rule with a fixed seed, so it depends on no table. Decoding is exact: a word whose score for O beats its other scores by more
than two transitions can make up is O on the best path, so only what lies between such words is decoded by Viterbi.
Words tagged B or I make spans without their quotes and end marks, of ``LEAST`` characters or more. The fixed ones stay as
they are; a span that reaches further than these is added whole, overlaps and all, and one that doesn't is left out.

Edge cases: a null or empty text has no spans. Offsets are code points, ends exclusive. Repeated rows and ids are rows of their
own; doc_id may be null. No rows give no rows. A text of any length is read in pieces of about ``AT_ONCE`` bytes at
word ends, with the two words before and the one after that features look at; only its words' scores and its spans are held whole.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm.common import bounded_batches, picked

#: Kinds in the order of ties, their patterns, the group whose length counts, and the least length.
KINDS = (
    ("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), 2, 8),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 16),
    ("hex", re.compile(r"[0-9a-f]{32,}"), 0, 32),  # runs of 32 or more are the runs that are long enough
)
ADDED = "crf"
RANK = {name: k for k, name in enumerate([*(k[0] for k in KINDS), ADDED])}
NAMES = ("password", "passwd", "pwd", "secret", "token", "apikey", "api_key", "api-key", "credential", "bearer", "private", "akia")
LEAST, AT_ONCE = 8, 1 << 20
TRIM = b"\"'`.,;:!?()[]{}<>"


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """The spans of the fixed kinds by start, then kind."""
    low, found = text.lower(), []
    hints = {"assign": any(x in low for x in ("passw", "secret", "token", "apikey", "api_key")), "access": "AKIA" in text, "hex": True}
    for kind, pattern, group, least in KINDS:
        if hints[kind]:
            found += [(kind, m.start(), m.end()) for m in pattern.finditer(text) if m.end(group) - m.start(group) >= least]
    return sorted(found, key=lambda x: (x[1], RANK[x[0]], x[2]))


# --- features ------------------------------------------------------------------------------------------------------

LENGTHS = np.array([4, 8, 12, 16, 20, 24, 32, 40, 64])
#: Number of values of every feature.
SIZES = (10, 5, 4, 6, 2, 2, 4, 4, 4, 4, 3, 3, 4)
OFFSETS = np.concatenate(([0], np.cumsum(SIZES)))
WIDTH = int(OFFSETS[-1])


def _table(chars: bytes) -> np.ndarray:
    found = np.zeros(256, bool)
    found[list(chars)] = True
    return found


SPACE, DIGIT = _table(b" \t\n\x0b\x0c\r"), _table(b"0123456789")
UPPER, LOWER = _table(bytes(range(65, 91))), _table(bytes(range(97, 123)))
HEX, ASSIGN, QUOTE, CODE = _table(b"0123456789abcdefABCDEF"), _table(b"=:"), _table(b"\"'`"), _table(b"=;{}()<>")
ADDRESS, PATH = _table(b"@"), _table(b"/")
WORD = re.compile(rb"[^ \t\n\x0b\x0c\r]+")
WORDS = re.compile("|".join(map(re.escape, NAMES)).encode(), re.I)


def word_features(data: np.ndarray, raw: bytes, file: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of ``data`` (bytes) and their features, a row each. ``file``: the two file features."""
    space = SPACE[data]
    edge = np.flatnonzero(np.diff(np.concatenate(([True], space, [True])).astype(np.int8)))
    starts, ends = edge[0::2], edge[1::2]
    n = len(starts)
    if not n:
        return starts, ends, np.zeros((0, len(SIZES)), np.int16)

    def within(hit: np.ndarray) -> np.ndarray:
        total = np.concatenate(([0], np.cumsum(hit, dtype=np.int64)))
        return total[ends] - total[starts]

    size = ends - starts
    digit, upper, lower = within(DIGIT[data]), within(UPPER[data]), within(LOWER[data])
    hexed, assign, quote = within(HEX[data]), within(ASSIGN[data]), within(QUOTE[data])
    kind = DIGIT[data].astype(np.int8) + 2 * UPPER[data] + 3 * LOWER[data]
    change = within(np.concatenate(([False], kind[1:] != kind[:-1]))) - 1
    plain = digit + upper + lower
    named = np.zeros(n, bool)
    if at := [m.start() for m in WORDS.finditer(raw)]:
        named[np.searchsorted(starts, at, "right") - 1] = True
    joint = (size <= 2) & (assign > 0)  # a sign of assignment by itself
    found = np.zeros((n, len(SIZES)), np.int16)
    found[:, 0] = np.searchsorted(LENGTHS, size, "left")
    share = digit / size
    found[:, 1] = (share > 0).astype(int) + (share > 0.2) + (share > 0.5) + (share == 1)
    found[:, 2] = (lower > 0) + 2 * (upper > 0)
    other = size - plain - assign - quote
    found[:, 3] = np.where(assign > 0, 1 + (assign == size), 0) + 3 * (other > 0)
    found[:, 4] = (hexed + quote == size) & (hexed >= 8)
    found[:, 5] = named
    before = np.zeros(n, int)
    before[1:] = named[:-1]
    before[2:] |= 2 * (named[:-2] & joint[1:-1])
    found[:, 6] = before
    found[:, 7] = np.searchsorted([0.1, 0.25, 0.5], np.maximum(change, 0) / size)
    short = np.searchsorted([4, 12, 20], size)
    found[1:, 8], found[:-1, 9] = short[:-1], short[1:]
    if file is None:
        file = file_features(np.array([DIGIT[data].sum(), CODE[data].sum()]), len(data))
    found[:, 10], found[:, 11] = file
    found[:, 12] = (within(ADDRESS[data]) > 0) + 2 * (within(PATH[data]) > 0)
    return starts, ends, found


def file_features(counts: np.ndarray, size: int) -> np.ndarray:
    """Values, 0 to 2, for the shares of digits and of code symbols in a whole file."""
    return np.array([np.searchsorted([0.02, 0.15], counts[0] / max(1, size)), np.searchsorted([0.01, 0.05], counts[1] / max(1, size))])


# --- the field -----------------------------------------------------------------------------------------------------


@dataclass
class Field:
    """Weights by feature value and label (O, B, I), and of transitions, first, last label."""

    emission: np.ndarray  # WIDTH x 3
    transition: np.ndarray  # 3 x 3


def emissions(found: np.ndarray, field: Field) -> np.ndarray:
    total = np.zeros((len(found), 3))
    for k in range(len(SIZES)):
        total += field.emission[OFFSETS[k] + found[:, k]]
    return total


def viterbi(score: np.ndarray, transition: np.ndarray, left: bool, right: bool) -> np.ndarray:
    """The best labels of a run; ``left``/``right``: an O stands beside it."""
    best = score[0] + (transition[0] if left else 0.0)
    back = np.zeros(score.shape, np.int8)
    for t in range(1, len(score)):
        ways = best[:, None] + transition
        back[t] = ways.argmax(0)
        best = ways.max(0) + score[t]
    if right:
        best = best + transition[:, 0]
    labels = np.zeros(len(score), np.int8)
    labels[-1] = best.argmax()
    for t in range(len(score) - 1, 0, -1):
        labels[t - 1] = back[t, labels[t]]
    return labels


def decode(score: np.ndarray, transition: np.ndarray) -> np.ndarray:
    """The best labels of a text; what must be O by its margin splits it into runs."""
    labels = np.zeros(len(score), np.int8)
    slack = 2 * (transition.max() - transition.min())
    open_ = np.flatnonzero(score[:, 0] - np.maximum(score[:, 1], score[:, 2]) <= slack)
    if len(open_):
        for run in np.split(open_, np.flatnonzero(np.diff(open_) > 1) + 1):
            a, b = int(run[0]), int(run[-1]) + 1
            labels[a:b] = viterbi(score[a:b], transition, a > 0, b < len(score))
    return labels


def _example(rng: np.random.Generator) -> tuple[str, list[tuple[int, int]]]:
    """A text by rule, and the places of its secrets."""
    pick = lambda chars, n: "".join(chars[k] for k in rng.integers(0, len(chars), n))
    hexes, digits, upper, lower = "0123456789abcdef", "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    mixed = upper + lower + digits

    def word() -> str:
        w = "".join(pick("bcdfghklmnprstvwz", 1) + pick("aeiouéüó", 1) + pick(" nrsth", 1).strip() for _ in range(rng.integers(1, 6)))
        style = rng.integers(0, 24)
        w = w.capitalize() if style < 4 else w.upper() if style < 6 else w
        return w + ["", "", "", "", ",", ".", "!!", "&&&", ";", "%%%", "$$$", "###"][rng.integers(0, 12)]

    def plain() -> str:
        return [
            lambda: pick(digits, rng.integers(1, 17)),
            lambda: f"{pick(digits, 4)}-{pick(digits, 2)}-{pick(digits, 2)}",
            lambda: f"{pick(lower, rng.integers(3, 10))}@{pick(lower, 7)}.com",
            lambda: f"{pick(lower, rng.integers(3, 10))}.{pick(digits, 2)}@{pick(lower, 4)}{pick(digits, 1)}.{pick(lower, 7)}.com",
            lambda: f"https://{pick(lower, 9)}.org/{pick(lower, 5)}/{pick(digits, 4)}?id={pick(digits, 3)}",
            lambda: f"+{pick(digits, 2)}-{pick(digits, 3)}-{pick(digits, 7)}",
            lambda: f"{pick(digits, 3)}.{pick(digits, 2)}.{pick(digits, 3)}.{pick(digits, 2)}",
            lambda: f"v{pick(digits, 1)}.{pick(digits, 2)}.{pick(digits, 1)}",
            lambda: f"#{pick(hexes, 6)}",
            lambda: f"{pick(lower, 5)}_{pick(lower, 6)} = {pick(digits, 3)};",
            lambda: f"{['password', 'token', 'secret', 'The secret', 'bearer'][rng.integers(0, 5)]} {word()}",
            lambda: "|",
            lambda: pick(upper, rng.integers(8, 20)),
            lambda: f"0{pick(digits, 9)}",
            lambda: f"{pick(digits, 4)}-{pick(digits, 2)}-{pick(digits, 2)}T{pick(digits, 2)}:{pick(digits, 2)}:{pick(digits, 2)}{['Z', '+02:00', '.123Z', ''][rng.integers(0, 4)]}",
            lambda: f"https://{pick(lower, 4)}.{pick(lower, 8)}.com/{pick(lower, 2)}{pick(digits, 1)}/{pick(lower, 6)}/{pick(upper, 3)}_{pick(digits, 8)}.{pick(lower, 3)}?{pick(lower, 5)}={pick(digits, 4)}&{pick(lower, 4)}={pick(lower, 2)}#{pick(lower, 7)}-{pick(digits, 1)}",
            lambda: ":".join(pick(["0123456789ABCDEF", hexes][rng.integers(0, 2)], 2) for _ in range(6)),
            lambda: f"{pick(hexes, 4)}::{':'.join(pick(hexes, rng.integers(1, 5)) for _ in range(rng.integers(1, 7)))}",
            lambda: f"{pick(upper, 1)}:\\{word().capitalize()}\\{word()}\\{word()}_{pick(digits, 4)}-{pick(lower, 5)}.{pick(lower, 4)}",
            lambda: f"/{pick(lower, 3)}/{pick(lower, 5)}/{word()}-{pick(digits, 1)}.{pick(digits, 2)}/{pick(lower, 6)}.{pick(lower, 2)}",
        ][rng.integers(0, 20)]()

    def value() -> str:
        return [
            lambda: pick(hexes, rng.integers(16, 41)),
            lambda: pick(mixed, rng.integers(12, 41)),
            lambda: pick(mixed + "-_", rng.integers(20, 60)),
            lambda: f"{pick(lower, 3)}_{pick(mixed, 30)}",
            lambda: f"eyJ{pick(mixed, 20)}.eyJ{pick(mixed, 30)}.{pick(mixed, 30)}",
            lambda: pick(mixed, 12) + pick("!@#$%^&*", 2) + pick(mixed, 4),
        ][rng.integers(0, 6)]()

    parts, spans, at = [], [], 0

    def add(part: str) -> None:
        nonlocal at
        parts.append(part)
        at += len(part) + 1

    for _ in range(rng.integers(8, 30)):
        kind = rng.integers(0, 14)
        if kind in (0, 4):
            add(plain())
        elif kind == 1:
            secret, name = value(), NAMES[rng.integers(0, 10)]
            before = [f"{name}=", f"{name}: ", f"{name} = ", f'{name} = "', f"{name} is ", f'"{name}": "', f"{name.upper()}=", "Authorization: Bearer "][rng.integers(0, 8)]
            head = before.rpartition(" ")[2] if " " in before else before
            start = at + len(before) - len(head)
            add(f"{before}{secret}" + ('"' if before.endswith('"') else ""))
            spans.append((start, at - 1))
        elif kind == 2 and rng.integers(0, 3) == 0:
            secret = f"AKIA{pick(upper + digits, 16)}" if rng.integers(0, 2) else pick(hexes, rng.integers(32, 65))
            spans.append((at, at + len(secret)))
            add(secret)
        elif kind == 3 and rng.integers(0, 6) == 0:
            secret = " ".join(pick(mixed + "+/", 64) for _ in range(rng.integers(2, 5)))
            add("-----BEGIN PRIVATE KEY-----")
            spans.append((at, at + len(secret)))
            add(secret)
            add("-----END PRIVATE KEY-----")
        else:
            add(" ".join(word() for _ in range(rng.integers(2, 6))))
    return " ".join(parts), spans


def train(texts: int = 500, rounds: int = 60, rate: float = 0.4, decay: float = 2e-4, seed: int = 3) -> Field:
    """Maximises the penalised likelihood of texts written by rule, by forward-backward sums over all texts at once."""
    rng, rows, marks = np.random.default_rng(seed), [], []
    for _ in range(texts):
        text, spans = _example(rng)
        raw = text.encode()
        starts, ends, found = word_features(np.frombuffer(raw, np.uint8), raw)
        shift = np.cumsum(np.concatenate(([0], [len(c.encode()) for c in text])))
        label = np.zeros(len(starts), int)
        for a, b in spans:
            inside = (starts < shift[min(b, len(text))]) & (ends > shift[a])
            label[inside] = 2
            label[np.flatnonzero(inside)[:1]] = 1
        rows.append(found + OFFSETS[:-1])
        marks.append(label)
    longest, n = max(map(len, rows)), len(rows)
    index, label, mask = np.zeros((n, longest, len(SIZES)), np.int64), np.zeros((n, longest), int), np.zeros((n, longest), bool)
    for k, (found, mark) in enumerate(zip(rows, marks, strict=True)):
        index[k, : len(mark)], label[k, : len(mark)], mask[k, : len(mark)] = found, mark, True
    emission, transition = np.zeros((WIDTH, 3)), np.zeros((3, 3))
    gained = [np.full_like(emission, 1e-8), np.full_like(transition, 1e-8)]
    real = np.zeros((WIDTH, 3))
    np.add.at(real, (index[mask], np.repeat(label[mask][:, None], len(SIZES), 1)), 1.0)
    moved = np.zeros((3, 3))
    np.add.at(moved, (label[:, :-1][mask[:, 1:]], label[:, 1:][mask[:, 1:]]), 1.0)
    flat = index[mask]
    for _ in range(rounds):
        score = emission[index].sum(2)
        ahead, back = np.zeros_like(score), np.zeros_like(score)
        ahead[:, 0] = score[:, 0]
        for t in range(1, longest):
            step = np.logaddexp.reduce(ahead[:, t - 1, :, None] + transition, axis=1) + score[:, t]
            ahead[:, t] = np.where(mask[:, t, None], step, ahead[:, t - 1])
        total = np.logaddexp.reduce(ahead[:, -1], axis=1)
        for t in range(longest - 2, -1, -1):
            step = np.logaddexp.reduce(transition + (score[:, t + 1] + back[:, t + 1])[:, None, :], axis=2)
            back[:, t] = np.where(mask[:, t + 1, None], step, 0.0)
        chance = np.exp(np.where(mask[:, :, None], ahead + back - total[:, None, None], -np.inf))[mask]
        expected = np.stack([np.bincount(flat.ravel(), np.repeat(chance[:, c], len(SIZES)), WIDTH) for c in range(3)], 1)
        pair = ahead[:, :-1, :, None] + transition + (score + back)[:, 1:, None, :] - total[:, None, None, None]
        expected_moves = np.exp(pair[mask[:, 1:]]).sum(0)
        for weight, gain, step in ((emission, gained[0], (real - expected) / n - decay * emission), (transition, gained[1], (moved - expected_moves) / n - decay * transition)):
            gain += step**2
            weight += rate * step / np.sqrt(gain)
    return Field(emission, transition)


@cache
def field() -> Field:
    return train()


# --- scanning ------------------------------------------------------------------------------------------------------


def _pieces(raw: bytes) -> Iterator[tuple[int, int]]:
    """Pieces of about AT_ONCE bytes that end behind a space."""
    at = 0
    while at < len(raw):
        stop = min(len(raw), at + AT_ONCE)
        while stop < len(raw) and not SPACE[raw[stop - 1]]:
            stop += 1
        yield at, stop
        at = stop


def reaches_further(start: int, end: int, base: list[tuple[str, int, int]]) -> bool:
    """Whether part of a span lies outside all of ``base`` (by start)."""
    for _, x, y in base:
        if x > start:
            break
        start = max(start, y)
    return start < end


def field_spans(text: str, base: list[tuple[str, int, int]], model: Field) -> list[tuple[str, int, int]]:
    """Spans that the field adds to ``base``."""
    raw = text.encode("utf-8", "surrogatepass")
    data = np.frombuffer(raw, np.uint8)
    file = file_features(np.array([DIGIT[data].sum(), CODE[data].sum()]), len(data)) if len(raw) > AT_ONCE else None
    parts, before = [], []  # the last two words before the piece
    for a, b in _pieces(raw):
        head, after = b"".join(x + b" " for x in before), WORD.search(raw, b)
        piece = head + raw[a:b] + (after[0] if after else b"")
        starts, ends, found = word_features(np.frombuffer(piece, np.uint8), piece, file)
        own = slice(len(before), len(starts) - (after is not None))
        starts, ends = starts[own] + (a - len(head)), ends[own] + (a - len(head))
        parts.append((starts, ends, emissions(found[own], model)))
        before = [*before, *(raw[x:y] for x, y in zip(starts[-2:].tolist(), ends[-2:].tolist(), strict=True))][-2:]
    if not parts:
        return []
    starts, ends, score = (np.concatenate(x) for x in zip(*parts, strict=True))
    labels = decode(score, model.transition) if len(score) else np.zeros(0, np.int8)
    hits, found = np.flatnonzero(labels), []
    if not len(hits):
        return []
    for run in np.split(hits, np.flatnonzero((np.diff(hits) > 1) | (labels[hits[1:]] == 1)) + 1):
        a, b = int(starts[run[0]]), int(ends[run[-1]])
        a += len(raw[a:b]) - len(raw[a:b].lstrip(TRIM))
        b = a + len(raw[a:b].rstrip(TRIM))
        start = len(raw[:a].decode("utf-8", "surrogatepass"))
        end = start + len(raw[a:b].decode("utf-8", "surrogatepass"))
        if end - start >= LEAST and reaches_further(start, end, base):
            found.append((ADDED, start, end))
    return found


def scan(text: str | None, model: Field) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """The fixed spans of a text, and all its spans."""
    text = text or ""
    base = base_spans(text)
    added = field_spans(text, base, model)
    return base, sorted(base + added, key=lambda x: (x[1], RANK[x[0]], x[2]))


def listed(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for kind, start, end in spans)


def redacted(text: str, spans: list[tuple[str, int, int]]) -> str:
    """``text`` with every span, or run of overlapping spans, replaced by ``[kind]`` of its first one."""
    parts, at = [], 0
    for kind, start, end in spans:
        if start >= at:
            parts += [text[at:start], f"[{kind}]"]
        at = max(at, end)
    return "".join([*parts, text[at:]])


def scanned(documents: DataFrame) -> DataFrame:
    """``doc_id, n_assign, n_access, n_hex, base_sha256, spans`` for every document."""
    bounded_batches(documents.sparkSession, 512)
    model = field()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [scan(x.as_py(), model) for x in batch.column("text")]
            counts = [pa.array([sum(x[0] == kind for x in base) for base, _ in found], pa.int64()) for kind, *_ in KINDS]
            digest = pa.array([hashlib.sha256(listed(base).encode()).hexdigest() for base, _ in found], pa.string())
            spans = pa.array([listed(every) for _, every in found], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *counts, digest, spans], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    rows = picked(documents, ("doc_id", "long"), ("text", "string"))
    return rows.mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def cleaned(documents: DataFrame) -> DataFrame:
    """The documents with their secrets redacted in ``text`` and ``n_chars`` to match; other columns as they are."""
    bounded_batches(documents.sparkSession, 512)
    model = field()
    rows = documents.withColumn("text", F.col("text").cast("string"))
    if "n_chars" in rows.columns:
        rows = rows.withColumn("n_chars", F.col("n_chars").cast("long"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [None if (t := x.as_py()) is None else redacted(t, scan(t, model)[1]) for x in batch.column("text")]
            columns = dict(zip(batch.schema.names, batch.columns, strict=True)) | {"text": pa.array(texts, pa.string())}
            if "n_chars" in columns:
                columns["n_chars"] = pa.array([n if t is None else len(t) for t, n in zip(texts, columns["n_chars"].to_pylist(), strict=True)], pa.int64())
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    return rows.mapInArrow(run, rows.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scanned(spark.read.parquet(f"{sf_dir}/documents.parquet"))
