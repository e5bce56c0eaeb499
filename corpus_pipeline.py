"""The corpus pipeline: language ID, SimHash near-duplicates, secret scans, source mixing and byte-level BPE.

Every stage takes ``(spark, docs, sf_dir)`` and works on all that the stage before it kept. All but the last return the
columns of ``documents``:

- language_id drops documents without a language (no letters, or nothing was learned); a missing ``lang`` is filled in.
- simhash_near_dedup keeps, of each group of near copies, the row with the smallest doc_id.
- secret_scan redacts secrets in the text and sets ``n_chars`` to match; no document goes.
- source_mix repeats documents as often as the mix takes them; those it doesn't take go.
- byte_bpe encodes and decodes: doc_id, n_tokens, ids_sha256, decoded_sha256.

Edge cases: null texts and texts without a letter go in the first stage, also where they have a ``lang``; that is all it rejects,
and a ``lang`` that is given stays. Documents of the same words are near copies; null ids are kept behind all others, and of
rows alike in id and text one stays. Documents whose words are none have size 0 and are never taken by the mix. Extra
columns of any name come through to the last stage. An empty table gives an empty result. The folder of the stages is
removed whether or not a stage fails.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm import bpe, language_id, secret_scan, simhash, source_mix
from ledgerloom.llm.common import cut, fresh, remainder, scratch


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = language_id.learn(docs.where(remainder("doc_id", 4) != 2))
    pred = fresh(docs, "lang_pred")
    found = language_id.with_language(docs, model, pred, fresh(docs, "score")).where(F.col(pred) != language_id.UNKNOWN)
    return found.withColumn("lang", F.coalesce("lang", pred)).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.deduplicated(docs).select(*docs.columns)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secret_scan.cleaned(docs).select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return source_mix.repeated(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.encoded(docs)


STAGES = [("language_id", language), ("simhash_near_dedup", near_duplicates), ("secret_scan", secrets), ("source_mix", mix), ("byte_bpe", encode)]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to ``documents``, each written to the shared folder and read again by the next one."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    with scratch(spark, "pipeline") as folder:
        for name, stage in STAGES[:-1]:
            stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
            docs = spark.read.parquet(f"{folder}/{name}")
        return cut(STAGES[-1][1](spark, docs, sf_dir))
