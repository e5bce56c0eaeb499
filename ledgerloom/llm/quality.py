"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

A text's features are its lower-cased words, hashed into ``WORDS`` buckets and weighted by the root of their frequency, and
``STATS`` statistics of its structure and of its length as metadata. The score is the logistic of

    w0 + sum(w_i x_i) + 1/2 sum_f((sum(v_if x_i))^2 - sum((v_if x_i)^2))

whose last part is all pairwise interactions of rank ``RANK``, in time linear in the features by the sum-of-squares identity.

It is fitted on at most ``SAMPLE`` labelled documents of either label, those with the smallest hash of their id (the
bound is the parameter ``sample``), and of these on no more than have ``MOST_BYTES`` of features, from features alone, and
weighted so that both labels keep their share of all; that much reaches the driver. Scores are of whole texts.

Edge cases: a null text is an empty one; an empty text has the score of its statistics. Null ids are not held out and not
learned from, nor are null labels. Without labels every score is 0.5. Repeated rows are rows of their own; of repeated
labels of an id each counts. Texts of any length are taken; ties in the hash go by id. Columns other than doc_id, text and
quality, whatever their names, play no part. No rows give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerloom.llm.common import bounded_batches, cut, hash_sample, joined, picked, remainder

WORDS, STATS, RANK, SAMPLE, SEED = 1 << 14, 16, 8, 4000, 8
EPOCHS, RATE, BATCH, DECAY = 12, 0.05, 128, 1e-4
CUT = 0.3
#: Bytes of the features that the machine is fitted on.
MOST_BYTES = 128 << 20


@dataclass
class Model:
    bias: float
    linear: np.ndarray  # WORDS + STATS
    factors: np.ndarray  # (WORDS + STATS) x RANK


def empty_model() -> Model:
    return Model(0.0, np.zeros(WORDS + STATS), np.zeros((WORDS + STATS, RANK)))


def _classes() -> np.ndarray:
    """By byte: 0 other symbol, 1 lower, 2 upper, 3 digit, 4 space, 5 line end, 6 plain punctuation, 7 beyond ASCII."""
    found = np.zeros(256, np.uint8)
    for kind, chars in ((1, b"abcdefghijklmnopqrstuvwxyz"), (2, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"), (3, b"0123456789"), (4, b" \t"), (5, b"\r\n"), (6, b".,;:'\"-()?")):
        found[list(chars)] = kind
    found[128:] = 7
    return found


CLASSES = _classes()


def features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Indices and values of a text's features that aren't zero."""
    data = (text or "").encode("utf-8", "surrogatepass")
    words = data.lower().split()
    kinds = np.bincount(CLASSES[np.frombuffer(data, np.uint8)], minlength=8) / max(1, len(data))
    hashes, counts = np.unique(np.fromiter(map(crc32, words), np.uint32, len(words)), return_counts=True)
    lines = [x for x in data.split(b"\n") if x]
    n = max(1, len(words))
    stats = np.array(
        [
            *kinds,
            min(1.0, np.log1p(len(words)) / 10),
            min(1.0, (len(data) / n) / 20),
            len(hashes) / n,
            counts.max(initial=0) / n,
            len(set(lines)) / max(1, len(lines)),
            min(1.0, len(lines) / n * 5),
            float(not words),
            1.0 - kinds[1] - kinds[4] - kinds[7],
        ]
    )
    bucket, at = np.unique(hashes & (WORDS - 1), return_inverse=True)
    value = np.sqrt(np.bincount(at, counts, len(bucket)) / n) if len(bucket) else np.zeros(0)
    return np.concatenate((bucket.astype(np.int64), WORDS + np.arange(STATS))), np.concatenate((value, stats))


def raw_score(index: np.ndarray, value: np.ndarray, model: Model) -> float:
    """The machine's output by the sum-of-squares identity."""
    vx = model.factors[index] * value[:, None]
    return float(model.bias + model.linear[index] @ value + 0.5 * (vx.sum(0) ** 2 - (vx * vx).sum(0)).sum())


def logistic(x):
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def fit(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, weights: np.ndarray, epochs: int = EPOCHS) -> Model:
    """Adaptive gradient steps on the weighted logistic loss; the same rows give the same model."""
    model, rng = empty_model(), np.random.default_rng(SEED)
    if not len(rows):
        return model
    model.factors = rng.normal(scale=0.02, size=model.factors.shape)
    share = np.clip(np.average(labels, weights=weights), 0.001, 0.999)
    model.bias = float(np.log(share / (1 - share)))
    g_linear, g_factors, g_bias = np.full(WORDS + STATS, 1e-6), np.full(model.factors.shape, 1e-6), 1e-6
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for at in range(0, len(order), BATCH):
            some = order[at : at + BATCH]
            sizes = np.array([len(rows[k][0]) for k in some])
            index, x = (np.concatenate([rows[k][j] for k in some]) for j in (0, 1))
            starts = np.cumsum(sizes) - sizes
            vx = model.factors[index] * x[:, None]
            sums = np.add.reduceat(vx, starts)
            out = model.bias + np.add.reduceat(model.linear[index] * x, starts) + 0.5 * (sums**2 - np.add.reduceat(vx * vx, starts)).sum(1)
            error = (logistic(out) - labels[some]) * weights[some] / len(some)
            slope = np.repeat(error, sizes) * x
            used, place = np.unique(index, return_inverse=True)
            d_linear = np.bincount(place, slope, len(used)) + DECAY * model.linear[used]
            each = slope[:, None] * (np.repeat(sums, sizes, axis=0) - vx)
            d_factors = np.stack([np.bincount(place, each[:, f], len(used)) for f in range(RANK)], axis=1) + DECAY * model.factors[used]
            g_linear[used] += d_linear**2
            g_factors[used] += d_factors**2
            g_bias += error.sum() ** 2
            model.linear[used] -= RATE * d_linear / np.sqrt(g_linear[used])
            model.factors[used] -= RATE * d_factors / np.sqrt(g_factors[used])
            model.bias -= float(RATE * error.sum() / np.sqrt(g_bias))
    return model


def learn(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE, most_bytes: int = MOST_BYTES) -> Model:
    """The model of ``documents(doc_id, text)`` with ``labels(doc_id, quality)``; features of the sample reach the driver."""
    spark = documents.sparkSession
    bounded_batches(spark)
    marked = picked(labels, ("doc_id", "long"), ("quality", "int")).where("doc_id IS NOT NULL AND quality IN (0, 1)")
    share = {row["quality"]: row["n"] for row in marked.groupBy("quality").agg(F.count(F.lit(1)).alias("n")).collect()}
    chosen = cut(hash_sample(marked, "quality", "doc_id", sample))
    texts = joined(picked(documents, ("doc_id", "long"), ("text", "string")), chosen, "doc_id", "inner", chosen.count())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [features(x.as_py()) for x in batch.column("text")]
            packed = [pa.array([x[j].astype(kind).tobytes() for x in found], pa.binary()) for j, kind in ((0, "<u2"), (1, "<f4"))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("quality"), *packed], ["doc_id", "quality", "i", "x"])

    featured = texts.select("doc_id", "quality", "text").mapInArrow(run, "doc_id long, quality int, i binary, x binary")
    featured = cut(featured.withColumn("_k", F.monotonically_increasing_id()))
    # a row of sizes per document of the sample
    upto = F.sum(F.octet_length("i") + F.octet_length("x")).over(W.partitionBy("quality").orderBy(F.xxhash64("doc_id"), "doc_id", "_k"))
    fit_on = cut(featured.select("_k", upto.alias("upto")).where(F.col("upto") <= most_bytes // 2).select("_k"))
    found = joined(featured, fit_on, "_k", "left_semi", fit_on.count()).drop("_k").toArrow().sort_by([("doc_id", "ascending"), ("quality", "ascending")])
    rows = [(np.frombuffer(i.as_py(), "<u2").astype(np.int64), np.frombuffer(x.as_py(), "<f4").astype(np.float64)) for i, x in zip(found.column("i"), found.column("x"), strict=True)]
    quality = found.column("quality").to_numpy().astype(float)
    if not len(rows):
        return empty_model()
    weights = np.ones(len(rows))
    for label in (0, 1):
        own = quality == label
        if own.any():
            weights[own] = share[label] / own.sum()
    return fit(rows, quality, weights / weights.mean())


def scored(documents: DataFrame, model: Model, cut_at: float = CUT) -> DataFrame:
    """``doc_id, score, predicted`` for every document; only the text is looked at."""
    bounded_batches(documents.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.array([raw_score(*features(x.as_py()), model) for x in batch.column("text")], float)
            score = logistic(out)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(score, pa.float64()), pa.array((score >= cut_at).astype(np.int32), pa.int32())], ["doc_id", "score", "predicted"])

    return picked(documents, ("doc_id", "long"), ("text", "string")).mapInArrow(run, "doc_id long, score double, predicted int")


def classify(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """Learns from labels of rows that are not held out and scores all."""
    model = learn(documents, labels.where(remainder("doc_id", 5) != 0))
    held = F.coalesce(remainder("doc_id", 5) == 0, F.lit(False))
    return scored(documents, model).select("doc_id", held.alias("held_out"), "score", "predicted")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
