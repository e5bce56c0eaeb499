"""Byte-level BPE encoding and decoding with overlapping chunks.

Ranks come from a tiktoken rank file, and each match of the split pattern is encoded by itself, without special tokens.
Texts of up to ``CHUNK`` characters are one piece. A longer text is cut near every multiple of ``CHUNK``: it is split into
pre-tokens twice from there on, as the chunk on its left sees it (from ``OVERLAP`` characters earlier) and as the chunk on its
right does (from the border), and the cut goes to the first place where a pre-token ends in both and which is stable.
Stable places lie behind a character that isn't white space, before one of another class (white space, letters, numbers,
others), but for a letter behind an apostrophe. No pre-token of the pattern goes on over such a place, it looks ahead only
behind white space, and it never looks back, so each piece splits by itself as it does within the whole text. A search goes
on to the place or, once, to the text's end: the time is linear in the text, and only what no place divides stays together.
The pieces of long texts are then encoded in parallel, in any task, and put together again in their order while ids and
decoded bytes flow through the digests; a task holds one piece at a time. Other patterns than the public one get no cuts.

A run of ``RUN`` or more white space characters, which the library's expressions cannot take at any length, is split by
hand as the pattern does: all of it, or all but its last character if another one follows, is one pre-token.

Decoding concatenates the raw bytes of the ids.

Edge cases: a null text is empty; an empty text has no ids, and digests of no bytes. Repeated rows and ids are kept, a row
each; doc_id may be null. No rows give no rows. Other columns play no part.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm.common import bounded_batches, partitions, picked

CHUNK, OVERLAP, RUN = 32768, 512, 1 << 16
RANKS = "byte_bpe_50k.tiktoken"
COLUMNS = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
#: Places that no pre-token of the public pattern goes on over, whatever stands before and after.
STABLE = regex.compile(r"(?<=\S)(?=\s)|(?<=\p{L})(?=[^\s\p{L}])|(?<=\p{N})(?=[^\s\p{N}])|(?<=[^\s\p{L}\p{N}])(?=\p{N})|(?<=[^\s\p{L}\p{N}'])(?=\p{L})")
SPACES = regex.compile(r"\s{%d,}" % RUN)


@cache
def codec(path: str, pattern: str) -> tiktoken.Encoding:
    """One per process: the codec of a rank file."""
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding(f"ranks:{path}", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def encode(text: str | None, path: str, pattern: str) -> list[int]:
    text, of = text or "", codec(path, pattern)
    if len(text) < RUN or pattern != public_tokenizers.PATTERN:
        return of.encode_ordinary(text)
    ids, at = [], 0
    for run in SPACES.finditer(text):
        end = run.end() - (run.end() < len(text))
        ids += of.encode_ordinary(text[at : run.start()])
        ids += of._encode_single_piece(text[run.start() : end])
        at = end
    return ids + of.encode_ordinary(text[at:])


def decode(ids: list[int], path: str, pattern: str) -> bytes:
    return codec(path, pattern).decode_bytes(ids)


def meeting(text: str, border: int, overlap: int, split: regex.Pattern, start: int = 0) -> int | None:
    """The first stable place behind ``border`` where a pre-token ends, split from ``overlap`` earlier and from ``border``."""
    left = (m.end() for m in split.finditer(text, max(start, border - overlap)))
    right = (m.end() for m in split.finditer(text, border))
    a = b = border
    while True:
        a, b = next(left, None), next(right, None)
        while a is not None and b is not None and a != b:
            a, b = (next(left, None), b) if a < b else (a, next(right, None))
        if a is None or b is None or a == len(text):
            return None
        if STABLE.match(text, a):
            return a


def cut_points(text: str, pattern: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> list[int]:
    """Where a long text is cut: 0, stable places that pre-tokenisations from either side share, and its length."""
    split, found = regex.compile(pattern), [0]
    for border in range(chunk, len(text), chunk) if pattern == public_tokenizers.PATTERN else ():
        if border > found[-1]:
            if (place := meeting(text, border, overlap, split, found[-1])) is None:
                break  # nor is there one for any later border
            found.append(place)
    return [*found, len(text)]


def encoded(documents: DataFrame, path: str | None = None, pattern: str | None = None, chunk: int = CHUNK, overlap: int = OVERLAP, keep_ids: bool = False) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` and, with ``keep_ids``, ``ids`` (an array) for every document."""
    path, pattern = path or public_tokenizers.path(RANKS), pattern or public_tokenizers.PATTERN
    spark = documents.sparkSession
    bounded_batches(spark)
    columns = COLUMNS + ", ids array<int>" * keep_ids
    kinds = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())] + [("ids", pa.list_(pa.int32()))] * keep_ids)
    documents = picked(documents, ("doc_id", "long"), ("text", "string"))

    def rows(found: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*found, strict=True), kinds.types, strict=True)], schema=kinds)

    def short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                ids = encode(text.as_py(), path, pattern)
                packed, raw = np.array(ids, "<u4").tobytes(), decode(ids, path, pattern)
                found.append((doc_id, len(ids), hashlib.sha256(packed).hexdigest(), hashlib.sha256(raw).hexdigest()) + (ids,) * keep_ids)
            if found:
                yield rows(found)

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, doc_id, text in zip(batch.column("row").to_pylist(), batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                whole = text.as_py()
                at = cut_points(whole, pattern, chunk, overlap)
                for k, (a, b) in enumerate(zip(at, at[1:], strict=False)):
                    yield pa.RecordBatch.from_pydict({"row": [row], "doc_id": [doc_id], "k": [k], "piece": [whole[a:b]]}, pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("k", pa.int32()), ("piece", pa.string())]))

    def encode_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [np.array(encode(x.as_py(), path, pattern), "<u4").tobytes() for x in batch.column("piece")]
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("doc_id"), batch.column("k"), pa.array(ids, pa.binary())], ["row", "doc_id", "k", "ids"])

    def join_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current = doc = None
        for batch in batches:
            for row, doc_id, data in zip(batch.column("row").to_pylist(), batch.column("doc_id").to_pylist(), batch.column("ids"), strict=True):
                if row != current:
                    if current is not None:
                        yield rows([(doc, n, of_ids.hexdigest(), of_raw.hexdigest()) + (kept,) * keep_ids])
                    current, doc, n, of_ids, of_raw, kept = row, doc_id, 0, hashlib.sha256(), hashlib.sha256(), []
                packed = data.as_py()
                ids = np.frombuffer(packed, "<u4").tolist()
                n += len(ids)
                of_ids.update(packed)
                of_raw.update(decode(ids, path, pattern))
                if keep_ids:
                    kept += ids
        if current is not None:
            yield rows([(doc, n, of_ids.hexdigest(), of_raw.hexdigest()) + (kept,) * keep_ids])

    long = F.length("text") > chunk
    one = documents.where(~F.coalesce(long, F.lit(False))).mapInArrow(short, columns)
    # the row's number only ties the pieces of a text together; the scan below numbers rows alike when it is run again
    many = documents.withColumn("row", F.monotonically_increasing_id()).where(long)
    many = many.mapInArrow(pieces, "row long, doc_id long, k int, piece string")
    many = many.repartition(partitions(spark), "row", "k").mapInArrow(encode_pieces, "row long, doc_id long, k int, ids binary")
    many = many.repartition(partitions(spark), "row").sortWithinPartitions("row", "k").mapInArrow(join_pieces, columns)
    return one.unionByName(many)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoded(spark.read.parquet(f"{sf_dir}/documents.parquet"))
