"""Token counts by overlap resynchronisation.

Texts of up to ``CHUNK`` characters are encoded whole. A huge text is encoded in overlapping chunks, with offsets, and
the encodings are spliced inside each overlap at a stable common boundary.

Proof that a boundary is stable. No piece of the vocabulary holds the space mark behind any other character (checked
when a model is loaded), so no merge ever joins a character other than a space to a space behind it, and everything left
and right of such a place is merged by itself. Every chunk that holds both characters has a token boundary there. A place is only taken once two encodings of its
neighbourhood, as the chunk on its left sees it and as the one on its right does, which begins elsewhere, both have that
boundary and agree behind it; where they don't, the overlap is widened to the next place, up to the text's end, where the chunks become one. Each chunk
verifies its places once more in its own offsets: the chunk left of a place counts the tokens before it, the chunk right of
it those from there on. A task holds one chunk at a time; a text itself is one row.

Edge cases: a null text is empty; an empty text has no tokens and no bytes. Repeated rows and ids are kept, a row each;
doc_id may be null. No rows give no rows. Other columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import public_tokenizers
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm.common import bounded_batches, partitions, picked

CHUNK, OVERLAP, LIMIT = 32768, 512, 4096
MODEL = "piece_bpe_32k.model"
MARK = "▁"


@cache
def model(path: str) -> tuple[sentencepiece.SentencePieceProcessor, bool]:
    """One per process: the model, and whether places before a space are stable with it."""
    loaded = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = (loaded.id_to_piece(i) for i in range(loaded.get_piece_size()))
    stable = not any(MARK in piece.lstrip(MARK) for piece in pieces)
    # spaces are kept as they are, one is added in front, and other characters are not changed over a space
    alike = loaded.encode("a  b", return_type=str) == [f"{MARK}a", MARK, f"{MARK}b"]
    return loaded, stable and alike


def starts(text: str, loaded: sentencepiece.SentencePieceProcessor) -> list[int]:
    """Where tokens begin, in bytes."""
    return [piece.begin for piece in loaded.encode(text, return_type="proto").pieces]


def aligned(text: str, at: int, overlap: int, loaded: sentencepiece.SentencePieceProcessor) -> bool:
    """Whether two encodings of what is around ``at``, begun at different places, have a token that begins there and agree behind it."""
    end = at + overlap

    def behind(first: int) -> list[int]:
        shift = len(text[first:at].encode())
        return [x - shift for x in starts(text[first:end], loaded) if x >= shift]

    one, other = behind(max(0, at - 2 * overlap)), behind(max(0, at - overlap))
    return one == other and one[:1] == [0]


def splice(text: str, border: int, overlap: int, loaded: sentencepiece.SentencePieceProcessor | None = None) -> int | None:
    """The first place from ``border`` on where chunks meet: before a space behind another character, with more text to come."""
    at = text.find(" ", border, len(text) - 1)
    while at >= 0:
        if text[at - 1] not in f" {MARK}" and (loaded is None or aligned(text, at, overlap, loaded)):
            return at
        at = text.find(" ", at + 1, len(text) - 1)
    return None


def chunks(text: str, chunk: int = CHUNK, overlap: int = OVERLAP, loaded: sentencepiece.SentencePieceProcessor | None = None) -> list[tuple[str, int, int]]:
    """Overlapping chunks of ``text`` as (chunk, first, last): it counts the tokens in first to last, chunk offsets.

    A chunk begins up to ``overlap`` characters before its first place and ends as much behind its last one.
    """
    places = [0]
    for border in range(chunk, len(text), chunk):
        if border > places[-1]:
            if (at := splice(text, border, overlap, loaded)) is None:
                break  # nor is there one for any later border
            places.append(at)
    places.append(len(text))
    found = []
    for a, b in zip(places, places[1:], strict=False):
        start, end = max(0, a - overlap), min(len(text), b + overlap)
        found.append((text[start:end], a - start, b - start))
    return found


def count_chunk(text: str, first: int, last: int, path: str) -> int:
    """Tokens of a chunk whose offsets lie in first to last; both must be boundaries of its encoding."""
    begins = starts(text, model(path)[0])
    first, last, end = (len(text[:at].encode()) for at in (first, last, len(text)))
    inside = sum(first <= at < last for at in begins)
    if (first and first not in begins) or (last < end and last not in begins):
        raise ValueError("the encodings of two chunks do not meet at a stable place")
    return inside


def count(text: str | None, path: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> int:
    """Tokens of one text, by chunks if it is long."""
    loaded, stable = model(path)
    if text is None or len(text) <= chunk or not stable:
        return len(loaded.encode(text or "", num_threads=1))
    return sum(count_chunk(*part, path) for part in chunks(text, chunk, overlap, loaded))


def counted(documents: DataFrame, path: str | None = None, limit: int = LIMIT, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` for every document."""
    path = path or public_tokenizers.path(MODEL)
    spark = documents.sparkSession
    bounded_batches(spark, 256)
    documents = picked(documents, ("doc_id", "long"), ("text", "string")).withColumn("n_bytes", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long"))
    if not model(path)[1]:
        chunk = 1 << 62  # without proof that places are stable every text is encoded whole

    def short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loaded = model(path)[0]
        for batch in batches:
            n = [len(loaded.encode(x.as_py() or "", num_threads=1)) for x in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), pa.array(n, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loaded = model(path)[0]
        for batch in batches:
            for row, doc_id, n_bytes, text in zip(*(batch.column(k).to_pylist() for k in ("row", "doc_id", "n_bytes", "text")), strict=True):
                for part, first, last in chunks(text, chunk, overlap, loaded):
                    yield pa.RecordBatch.from_pydict({"row": [row], "doc_id": [doc_id], "n_bytes": [n_bytes], "part": [part], "first": [first], "last": [last]}, kinds)

    kinds = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("part", pa.string()), ("first", pa.int64()), ("last", pa.int64())])

    def count_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = [count_chunk(*part, path) for part in zip(*(batch.column(k).to_pylist() for k in ("part", "first", "last")), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("doc_id"), batch.column("n_bytes"), pa.array(n, pa.int64())], ["row", "doc_id", "n_bytes", "n_tokens"])

    long = F.length("text") > chunk
    one = documents.where(~F.coalesce(long, F.lit(False))).mapInArrow(short, "doc_id long, n_bytes long, n_tokens long")
    many = documents.withColumn("row", F.monotonically_increasing_id()).where(long)
    many = many.mapInArrow(deal, "row long, doc_id long, n_bytes long, part string, first long, last long")
    many = many.repartition(partitions(spark), "row", "first", "last").mapInArrow(count_parts, "row long, doc_id long, n_bytes long, n_tokens long")
    many = many.groupBy("row", "doc_id", "n_bytes").agg(F.sum("n_tokens").alias("n_tokens")).drop("row")
    return one.unionByName(many).withColumn("over_limit", F.col("n_tokens") > limit)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counted(spark.read.parquet(f"{sf_dir}/documents.parquet"))
