"""Language identification by multilingual mixture inference.

Letters are lower-cased, everything else is one space, and the trigrams of that fall into ``BUCKETS`` by a hash. A language's
trigram likelihoods are learned, smoothed, from at most ``SAMPLE`` documents of it, those with the smallest hash of
their id, with their whole texts; the bound is there because likelihoods settle long before.

A document is taken as a mixture of languages. Expectation-maximisation finds the proportions under which its trigrams are
likeliest, first for all languages. The language set is then selected by penalised likelihood among the sets of its 1, 2, 3, ...
largest languages, re-estimated each: log likelihood less ``PENALTY`` * languages * log(trigrams) / 2. A document is done
with when even the likelihood that no mixture exceeds (log likelihood is concave in the proportions, so its slopes at any
one bound it) would not make up for the penalty; that depends on no other document. The prediction is the largest proportion of the selected set, ties to the smaller name, and the score is that proportion.

Whole texts are used, in chunks of about ``AT_ONCE`` characters with the characters beside them: a document's trigrams are
counted, so its memory is bounded by the buckets. A text's result depends on no other text, batch or chunk.

The model has ``BUCKETS`` numbers per language, 256 KB, on the driver and in each worker, and fitting takes time with the number of
languages for each set size. That is meant for hundreds of languages; over ``LANGUAGES`` learned labels are an error.

Edge cases: a null text or one without a letter is ``und`` with score 0. Without any learned language a text with letters
is ``und`` too. Null ids are not held out and not learned from. Repeated rows are rows of their own. No rows give no rows.
Texts of any length are taken. Columns other than doc_id, text and lang, whatever their names, play no part.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.llm.common import bounded_batches, cut, hash_sample, joined, picked, remainder

BUCKETS, SAMPLE, PENALTY, AT_ONCE, SMOOTH, LANGUAGES = 1 << 15, 400, 6.0, 1 << 20, 0.05, 500
FIRST, AGAIN = 10, 5
UNKNOWN = "und"


@dataclass(frozen=True)
class Model:
    """Languages in order, and by bucket and language the likelihood of a trigram."""

    languages: tuple[str, ...]
    likelihood: np.ndarray


@cache
def letters() -> np.ndarray:
    """By code point: 0, or the lower-case letter."""
    found = np.zeros(0x110000, np.int32)
    for code in range(0x110000):
        if (char := chr(code)).isalpha():
            found[code] = ord(char.lower()[0])
    return found


def grams(codes: np.ndarray, owner: np.ndarray, own: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Owner and bucket of every trigram of the owners' texts, which follow each other in ``codes``; those around ``own``, if given."""
    low = letters()[codes]
    same = np.zeros(len(codes), bool)
    same[1:] = owner[1:] == owner[:-1]
    keep = low > 0
    keep[1:] |= (low[:-1] > 0) & same[1:]
    low, owner = low[keep].astype(np.uint32), owner[keep]
    if not len(low):
        return owner, low.astype(np.int64)
    # a space stands before the first letter, so the letters of a text of any length count
    before = np.zeros(len(low), np.uint32)
    edge = np.zeros(len(low), bool)
    edge[0] = True
    edge[1:] = owner[1:] != owner[:-1]
    before[1:] = low[:-1]
    before[edge] = 0
    after = np.zeros(len(low), np.uint32)
    after[:-1] = low[1:]
    last = np.append(edge[1:], True)
    after[last] = 0
    mixed = (before * np.uint32(0x9E3779B1) ^ low * np.uint32(0x85EBCA6B) ^ after * np.uint32(0xC2B2AE35)) * np.uint32(0x27D4EB2F)
    real = low > 0 if own is None else (low > 0) & own[keep]
    return owner[real], (mixed[real] >> np.uint32(17)).astype(np.int64)


def counts(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Owner, bucket and number of every distinct trigram of every text, in the order of owners."""
    found: list[np.ndarray] = []
    numbers: list[np.ndarray] = []
    held: list[tuple[int, np.ndarray, np.ndarray]] = []
    size = 0

    def flush() -> None:
        codes, own = (np.concatenate([x[j] for x in held]) for j in (1, 2))
        owner = np.repeat(np.array([x[0] for x in held]), [len(x[1]) for x in held])
        of, bucket = grams(codes, owner, own)
        key = np.sort(of * BUCKETS + bucket)
        if len(key):
            starts = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
            found.append(key[starts])
            numbers.append(np.diff(np.append(starts, len(key))))

    for k, text in enumerate(texts):
        codes = np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), "<u4")
        for at in range(0, len(codes), AT_ONCE):
            low, high = max(0, at - 1), min(len(codes), at + AT_ONCE + 1)  # a character on either side, not counted here
            place = np.arange(low, high)
            held.append((k, codes[low:high], (place >= at) & (place < at + AT_ONCE)))
            size += high - low
            if size >= AT_ONCE or high < len(codes):
                flush()
                held, size = [], 0
    if held:
        flush()
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    key, number = np.concatenate(found), np.concatenate(numbers).astype(float)
    if (key[1:] <= key[:-1]).any():  # a text that was taken in more than one chunk
        key, at = np.unique(key, return_inverse=True)
        number = np.bincount(at, number)
    return key // BUCKETS, key % BUCKETS, number


def _proportions(p: np.ndarray, number: np.ndarray, starts: np.ndarray, sizes: np.ndarray, share: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Expectation-maximisation from ``share`` (document x language); proportions and log likelihoods. p is language x trigram."""
    total = np.add.reduceat(number, starts)
    for _ in range(rounds):
        part = p * np.repeat(share.T, sizes, axis=1)
        part *= number / part.sum(0)
        share = (np.add.reduceat(part, starts, axis=1) / total).T
    whole = (p * np.repeat(share.T, sizes, axis=1)).sum(0)
    return share, np.add.reduceat(number * np.log(whole), starts)


def _bound(p: np.ndarray, number: np.ndarray, starts: np.ndarray, sizes: np.ndarray, share: np.ndarray) -> np.ndarray:
    """What no proportions' log likelihood exceeds, by the slopes at ``share``."""
    whole = (p * np.repeat(share.T, sizes, axis=1)).sum(0)
    slopes = np.add.reduceat(p * (number / whole), starts, axis=1)
    return np.add.reduceat(number * np.log(whole), starts) + slopes.max(0) - (slopes * share.T).sum(0)


def mixtures(texts: list[str | None], model: Model) -> tuple[np.ndarray, np.ndarray]:
    """Proportions (text x language, zeros outside the selected set) and numbers of trigrams, 0 for texts without letters."""
    owner, bucket, number = counts(texts)
    shares, trigrams = np.zeros((len(texts), len(model.languages))), np.zeros(len(texts))
    if not len(owner) or not len(model.languages):
        return shares, trigrams
    starts = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
    sizes = np.diff(np.append(starts, len(owner)))
    documents, n = owner[starts], np.add.reduceat(number, starts)
    p = np.ascontiguousarray(model.likelihood[bucket].T)
    many = len(model.languages)
    full, _ = _proportions(p, number, starts, sizes, np.full((len(starts), many), 1 / many), FIRST)
    rank = (-full).argsort(axis=1, kind="stable").argsort(axis=1)
    best, worth, most = np.zeros_like(full), np.full(len(starts), -np.inf), _bound(p, number, starts, sizes, full)
    left = np.arange(len(starts))  # documents that a set of this size could still suit better; p and the rest are theirs
    for size in range(1, many + 1):
        share = np.where(rank[left] < size, np.maximum(full[left], 1e-9), 0.0)
        share, fit = _proportions(p, number, starts, sizes, share / share.sum(1, keepdims=True), AGAIN if size > 1 else 0)
        value = fit - PENALTY * size * np.log(n[left] + 1) / 2
        better = value > worth[left]
        best[left[better]], worth[left[better]] = share[better], value[better]
        open_ = most[left] - PENALTY * (size + 1) * np.log(n[left] + 1) / 2 > worth[left] - 1e-9 * np.abs(worth[left])
        if not open_.any():
            break
        if not open_.all():
            own = np.repeat(open_, sizes)
            p, number, sizes, left = p[:, own], number[own], sizes[open_], left[open_]
            starts = np.cumsum(sizes) - sizes
    shares[documents], trigrams[documents] = best, n
    return shares, trigrams


def learn(labelled: DataFrame, sample: int = SAMPLE) -> Model:
    """The model of ``labelled(doc_id, text, lang)``. What reaches the driver is one number per language and bucket."""
    spark = labelled.sparkSession
    bounded_batches(spark, 256)
    rows = picked(labelled, ("doc_id", "long"), ("text", "string"), ("lang", "string")).where("lang IS NOT NULL AND doc_id IS NOT NULL")
    if len(rows.select("lang").distinct().limit(LANGUAGES + 1).collect()) > LANGUAGES:
        raise ValueError(f"over {LANGUAGES} languages: map labels to fewer ones")
    chosen = cut(hash_sample(rows.select("doc_id", "lang"), "lang", "doc_id", sample).distinct())
    texts = joined(rows, chosen, ["doc_id", "lang"], "inner", chosen.count())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            languages = batch.column("lang").to_pylist()
            owner, bucket, number = counts(batch.column("text").to_pylist())
            for language in sorted(set(languages)):
                own = np.array([x == language for x in languages])[owner]
                total = np.bincount(bucket[own], number[own], BUCKETS)
                at = np.flatnonzero(total)
                yield pa.RecordBatch.from_arrays([pa.array([language] * len(at), pa.string()), pa.array(at), pa.array(total[at])], ["lang", "bucket", "n"])

    sums = texts.select("lang", "text").mapInArrow(run, "lang string, bucket long, n double").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    languages = tuple(sorted(sums["lang"].unique()))
    table = np.full((BUCKETS, len(languages)), SMOOTH)
    for k, language in enumerate(languages):
        own = sums[sums["lang"] == language]
        table[own["bucket"].to_numpy(), k] += own["n"].to_numpy()
    return Model(languages, table / table.sum(0, keepdims=True) if languages else table)


def predict(documents: DataFrame, model: Model) -> DataFrame:
    """``doc_id, lang_pred, score, proportions`` for every document; only the text is looked at."""
    bounded_batches(documents.sparkSession, 256)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = np.array([*model.languages, UNKNOWN])
        kind = pa.map_(pa.string(), pa.float64())
        for batch in batches:
            if not batch.num_rows:
                continue
            shares, n = mixtures(batch.column("text").to_pylist(), model)
            score = shares.max(1, initial=0.0)
            at = np.where(n > 0, shares.argmax(1) if len(model.languages) else 0, len(model.languages))
            parts = [[(model.languages[k], float(row[k])) for k in np.flatnonzero(row)] for row in shares]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(names[at].tolist()), pa.array(np.clip(score, 0, 1)), pa.array(parts, kind)], ["doc_id", "lang_pred", "score", "proportions"])

    rows = picked(documents, ("doc_id", "long"), ("text", "string"))
    return rows.mapInArrow(run, "doc_id long, lang_pred string, score double, proportions map<string,double>")


def with_language(documents: DataFrame, model: Model, pred: str = "lang_pred", score: str = "score") -> DataFrame:
    """The documents with all their columns, and the prediction and its score (which replace columns so named)."""
    bounded_batches(documents.sparkSession, 256)
    rows = documents.drop(pred, score).withColumn("text", F.col("text").cast("string"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = np.array([*model.languages, UNKNOWN])
        for batch in batches:
            if batch.num_rows:
                shares, n = mixtures(batch.column("text").to_pylist(), model)
                at = np.where(n > 0, shares.argmax(1) if len(model.languages) else 0, len(model.languages))
                added = [pa.array(names[at].tolist(), pa.string()), pa.array(np.clip(shares.max(1, initial=0.0), 0, 1), pa.float64())]
                yield pa.RecordBatch.from_arrays([*batch.columns, *added], [*batch.schema.names, pred, score])

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField(pred, T.StringType()), T.StructField(score, T.DoubleType())]))


def held_out() -> Column:
    return F.coalesce(remainder("doc_id", 4) == 2, F.lit(False))


def identify(documents: DataFrame) -> DataFrame:
    """Learns from documents that are not held out and predicts all."""
    model = learn(documents.where(remainder("doc_id", 4) != 2))
    found = predict(documents, model).withColumn("held_out", held_out())
    return found.select("doc_id", "held_out", "lang_pred", "score", "proportions")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(spark.read.parquet(f"{sf_dir}/documents.parquet"))
