"""Exact top-k search by term-at-a-time accumulation.

A vector's components become integers, floor(256 * x); component number t of a candidate is a weighted posting of term t.
Candidates are dealt by a hash into blocks of about ``BLOCK``, each shuffled once. The queries are a table in the shared folder
that the task of every block reads batch by batch, so no copy of them is shuffled. For each term the queries that hold it
scatter weight times posting into a dense array of scores, one row per query, a tile of candidates after the other;
the k best of each row are selected by partition, and the best of all blocks are merged. A task holds one block's
postings and the scores of ``QUERIES`` queries. All queries meet all candidates, as asked: the time grows with their product.

Scores are exact: 64-bit integers, or integers without a bound where sums could leave 64 bits (saturated in the result).
Ties go to the smaller vec_id, then to the earlier row.

Edge cases: vectors that are null, hold null or non-finite components, or have no id take no part. Vectors of different
lengths meet in the terms they share. Repeated rows and ids are rows of their own, and candidates of each other. With
fewer than k candidates a query has fewer rows; with none, no row. No rows give no rows. Columns other than vec_id and
embedding, whatever their names, play no part.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerloom.llm.common import bounded_batches, partitions, shared_dir, stored

K, EVERY, SCALE, BLOCK, LEAST, QUERIES, TILE = 5, 50, 256.0, 1 << 17, 1 << 13, 32, 1 << 12
FOUND = "query long, query_id long, vec long, vec_id long, score long"


def finite(vector: Column) -> Column:
    """True for vectors that are there and whose components are all finite."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & F.coalesce(fine, F.lit(False))


class Postings:
    """The postings of a block, tile by tile: by term, the candidates that hold it and their weights."""

    def __init__(self, lengths: np.ndarray, values: np.ndarray):
        self.n, self.most = len(lengths), float(np.abs(values.astype(float)).max(initial=0.0))
        ends, self.tiles = np.cumsum(lengths), []
        for low in range(0, self.n, TILE):
            sizes = lengths[low : low + TILE]
            start = int(ends[low] - lengths[low])
            own = values[start : start + int(sizes.sum())]
            rows = np.repeat(np.arange(len(sizes)), sizes)
            terms = np.arange(len(own)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            full = np.flatnonzero(own)
            order = full[np.argsort(terms[full], kind="stable")]
            found, at = np.unique(terms[order], return_index=True)
            lists = [(int(t), rows[x], own[x]) for t, x in zip(found, np.split(order, at[1:]), strict=True)] if len(order) else []
            self.tiles.append((low, len(sizes), [self._filled(len(sizes), *x) for x in lists]))

    @staticmethod
    def _filled(size: int, term: int, rows: np.ndarray, weights: np.ndarray) -> tuple[int, np.ndarray | None, np.ndarray]:
        """A long list of postings with zeros for the candidates that lack the term, and no rows."""
        if 4 * len(rows) < size:
            return term, rows, weights
        every = np.zeros(size, weights.dtype)
        every[rows] = weights
        return term, None, every

    def scores(self, lengths: np.ndarray, values: np.ndarray) -> np.ndarray:
        """Inner products of queries with all candidates of the block, term at a time."""
        starts, longest = np.cumsum(lengths) - lengths, int(lengths.max(initial=0))
        bound = self.most * float(np.abs(values.astype(float)).max(initial=0.0)) * max(longest, 1)
        kind = np.int32 if bound < 2.0**30 else np.int64 if bound < 2.0**62 else object
        found = np.zeros((len(lengths), self.n), kind)
        asked = []
        for t in range(longest):
            query = np.zeros(len(lengths), values.dtype)
            query[lengths > t] = values[starts[lengths > t] + t]
            holders = np.flatnonzero(query)
            asked.append((None, query.astype(kind)) if 2 * len(holders) > len(query) else (holders, query[holders].astype(kind)))
        for low, size, lists in self.tiles:
            dense, buffer = found[:, low : low + size], np.empty((len(lengths), size), kind)
            for t, rows, weights in lists:
                if t >= longest or not len(asked[t][1]):
                    continue
                holders, query = asked[t]
                weights = weights.astype(kind)
                if holders is None and rows is None:
                    dense += np.multiply(query[:, None], weights[None, :], out=buffer)
                elif rows is None:
                    dense[holders] += query[:, None] * weights[None, :]
                elif holders is None:
                    dense[:, rows] += query[:, None] * weights[None, :]
                else:
                    dense[np.ix_(holders, rows)] += query[:, None] * weights[None, :]
        return np.clip(found, -(2**63), 2**63 - 1).astype(np.int64) if kind is object else found


def select(scores: np.ndarray, k: int, own: int | None) -> np.ndarray:
    """The places of the k highest scores, ties to the smaller place, without ``own``."""
    if own is not None:
        rest = select(np.concatenate((scores[:own], scores[own + 1 :])), k, None)
        return rest + (rest >= own)
    places = np.arange(len(scores)) if len(scores) <= k else np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])
    return places[np.lexsort((places, -scores[places].astype(object)))][:k] if len(places) <= 4 * k else _ordered(scores, places, k)


def _ordered(scores: np.ndarray, places: np.ndarray, k: int) -> np.ndarray:
    """The first k of many ``places`` with equal scores among the highest ones."""
    least = scores[places].min()
    above = places[scores[places] > least]
    above = above[np.lexsort((above, -scores[above].astype(object)))]
    return np.concatenate((above, places[scores[places] == least]))[:k]


def search(vectors: DataFrame, queries: Column, k: int = K, block: int = BLOCK) -> DataFrame:
    """``query_id, rank, vec_id, score`` of the k best rows of ``vectors(vec_id, embedding)`` for rows where ``queries`` holds."""
    spark = vectors.sparkSession
    bounded_batches(spark)
    rows = vectors.select(F.monotonically_increasing_id().alias("vec"), F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("e"))
    rows = rows.where(F.col("vec_id").isNotNull() & finite(F.col("e")))
    rows = stored(rows.select("vec", "vec_id", F.transform("e", lambda x: F.floor(SCALE * x).cast("long")).alias("v")))  # numbered once
    n = rows.count()
    blocks = max(-(-n // block), min(partitions(spark), -(-n // LEAST)), 1)
    folder = f"{shared_dir(spark)}/queries-{uuid.uuid4().hex}"
    rows.where(queries).select("vec", "vec_id", "v").write.parquet(folder)
    candidates = rows.withColumn("block", F.pmod(F.xxhash64("vec", "vec_id"), F.lit(blocks)).cast("int"))
    candidates = candidates.repartition(blocks, "block").sortWithinPartitions("block", "vec_id", "vec")

    def flat(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        lists = batch.column("v")
        return np.diff(lists.offsets.to_numpy()), lists.flatten().to_numpy()

    def asked() -> Iterator[pa.RecordBatch]:
        store, path = fs.FileSystem.from_uri(folder)
        for info in sorted(store.get_file_info(fs.FileSelector(path)), key=lambda x: x.path):
            if info.base_name.endswith(".parquet"):
                with store.open_input_file(info.path) as file:
                    yield from pq.ParquetFile(file).iter_batches(QUERIES, columns=["vec", "vec_id", "v"])

    def answers(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        postings = Postings(*(np.concatenate(x) for x in zip(*map(flat, parts), strict=True)))
        ids, keys = (np.concatenate([p.column(c).to_numpy() for p in parts]) for c in ("vec_id", "vec"))
        place = dict(zip(keys.tolist(), range(len(keys)), strict=True))
        for ask in asked():
            if not ask.num_rows:
                continue
            scores = postings.scores(*flat(ask))
            best = [select(row, k, place.get(key)) for row, key in zip(scores, ask.column("vec").to_pylist(), strict=True)]
            n, found = np.array([len(x) for x in best]), np.concatenate(best)
            of = np.repeat(np.arange(len(best)), n)
            take = [np.repeat(ask.column(c).to_numpy(), n) for c in ("vec", "vec_id")]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (*take, keys[found], ids[found], scores[of, found].astype(np.int64))], ["query", "query_id", "vec", "vec_id", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parts = None, []
        for batch in batches:
            block_of = batch.column("block").to_numpy()
            borders = np.flatnonzero(np.diff(block_of) != 0) + 1
            for a, b in zip([0, *borders.tolist()], [*borders.tolist(), len(block_of)], strict=True):
                if a == b:
                    continue
                if block_of[a] != now and parts:
                    yield from answers(parts)
                    parts = []
                now = block_of[a]
                parts.append(batch.slice(a, b - a))
        if parts:
            yield from answers(parts)

    best = candidates.select("block", "vec", "vec_id", "v").mapInArrow(run, FOUND)
    order = W.partitionBy("query").orderBy(F.desc("score"), "vec_id", "vec")
    ranked = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % EVERY == 0)


ORACLE_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id
)
SELECT query_id, rank, vec_id, score FROM (
  SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INT AS rank FROM s
) WHERE rank <= 5
"""
