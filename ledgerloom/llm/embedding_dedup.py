"""Embedding near-duplicates by lattice hashing.

Vectors are scaled to length 1 in double precision. In each of ``TABLES`` tables, two groups of eight random projections,
divided by ``WIDTH``, are decoded to points of the lattice E8, which is D8 joined to D8 shifted by a half. A vector
probes, for each group, the nearest point of either shift: its own cell and the neighbouring cell across it. The cells of
both groups together name a bucket, so a vector is in four buckets of a table. Buckets hold ids only; those of one id go.
In the others vectors meet first as sketches, ``SKETCH`` signs of random projections: what is connected by sketches as close as
all but 1e-8 of the pairs at the threshold are makes a group, and equal groups of several buckets are one. Only then
are vectors fetched, once for each of their groups, and compared by cosine; a search over those not yet reached
gives links that span what links, never all pairs of a group.

Components of these links are then counted out exactly: within a component, block against block, every vector's partners
with a cosine of ``THRESHOLD`` or more are counted, so ``n_links`` does not depend on which buckets met. Pairs of cosine 0.9,
0.95 and 0.98 meet with probability 0.97, 0.998 and above 0.9999 by simulation (64 dimensions); pairs below the
threshold never link. Equal vectors are one vector with a weight. Buckets of more than ``MOST`` vectors, and
components of more than ``COUNTED``, are dealt out in pairs of chunks. Counting takes time with the square of a component.

Edge cases: vectors that are null, empty, zero or hold null or non-finite components, and rows without an id, link with
nothing: 0 links, and component is the row's own id (kept is false for a null id). Vectors of different lengths don't link.
Repeated rows and ids are vectors of their own. No rows give no rows. Columns other than vec_id and embedding, whatever
their names, play no part.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm.common import bounded_batches, components, cut, dealt, groups, joined, spanning, split_hot, stored
from ledgerloom.llm.topk_search import finite

THRESHOLD, TABLES, WIDTH, GROUPS, SEED, MOST, COUNTED, SKETCH = 0.9, 8, 2.25, 2, 9, 4096, 4096, 256
#: Groups of up to this many vectors are compared many at once.
SMALL = 24


@cache
def projections(size: int, tables: int = TABLES, width: float = WIDTH, seed: int = SEED) -> np.ndarray:
    """size x (tables * GROUPS * 8) Gaussian projections, the same in every process."""
    return np.random.default_rng([seed, size]).normal(size=(size, tables * GROUPS * 8)) / width


def nearest_d8(x: np.ndarray) -> np.ndarray:
    """The nearest points of D8: integers with an even sum; x is (..., 8)."""
    point = np.rint(x)
    error = x - point
    worst = np.abs(error).argmax(-1)[..., None]
    odd = (point.sum(-1, keepdims=True).astype(np.int64) & 1).astype(float)
    step = np.where(np.take_along_axis(error, worst, -1) >= 0, 1.0, -1.0) * odd
    np.put_along_axis(point, worst, np.take_along_axis(point, worst, -1) + step, -1)
    return point


def _mixed(cells: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit hash of the 8 integers in the last axis."""
    found = np.full(cells.shape[:-1], np.uint64(0x9E3779B97F4A7C15) * np.uint64(2 * seed + 1), np.uint64)
    for k in range(8):
        found ^= cells[..., k].astype(np.int64).view(np.uint64)
        found *= np.uint64(0xBF58476D1CE4E5B9)
        found ^= found >> np.uint64(29)
        found *= np.uint64(0x94D049BB133111EB)
        found ^= found >> np.uint64(32)
    return found


def buckets(unit: np.ndarray, tables: int = TABLES, width: float = WIDTH) -> np.ndarray:
    """n x (4 * tables) buckets of unit vectors."""
    size = unit.shape[1]
    with np.errstate(over="ignore"):
        x = (unit @ projections(size, tables, width)).reshape(len(unit), tables, GROUPS, 8)
        cells = np.stack([_mixed(2 * nearest_d8(x), 1), _mixed(2 * nearest_d8(x - 0.5) + 1, 1)])  # shift, n, table, group
        salt = (np.arange(tables, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93) + np.uint64(size))[None, :]
        pairs = [(a * np.uint64(31) + b * np.uint64(0xA0761D6478BD642F)) ^ salt for a in cells[:, :, :, 0] for b in cells[:, :, :, 1]]
    return np.concatenate(pairs, axis=1).view(np.int64)


def unit_vectors(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


@cache
def planes(size: int, seed: int = SEED) -> np.ndarray:
    return np.random.default_rng([seed, size, 1]).normal(size=(size, SKETCH))


def sketches(unit: np.ndarray) -> np.ndarray:
    """n x (SKETCH / 64) words of the signs of random projections."""
    return np.packbits(unit @ planes(unit.shape[1]) > 0, axis=1).view(np.uint64)


def apart(threshold: float) -> int:
    """Signs that sketches of vectors at the threshold differ in at most, but for one pair in 1e8 or fewer."""
    p = math.acos(threshold) / math.pi
    return math.ceil(SKETCH * p + 6 * math.sqrt(SKETCH * p * (1 - p)))


def matrices(lists: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, unit vectors) of the lists of each length."""
    lengths, flat = np.diff(lists.offsets.to_numpy()), lists.flatten().to_numpy()
    starts = np.cumsum(lengths) - lengths
    for size in np.unique(lengths):
        at = np.flatnonzero(lengths == size)
        yield at, unit_vectors(flat[starts[at][:, None] + np.arange(size)])


def _of(table: pa.Table) -> list[np.ndarray | None]:
    """The unit vector of every row."""
    found: list = [None] * table.num_rows
    for at, unit in matrices(table.column("v").combine_chunks()):
        for place, row in zip(at.tolist(), unit, strict=True):
            found[place] = row
    return found


def crowded(distinct: DataFrame, tables: int = TABLES, width: float = WIDTH) -> DataFrame:
    """``bucket, rid, at`` for the buckets of ``distinct(rid, v)`` that hold more than one; ``at`` counts a bucket's rows from 0."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rid = batch.column("rid")
            for at, unit in matrices(batch.column("v")):
                found, own = buckets(unit, tables, width), rid.take(pa.array(at))
                for column in range(found.shape[1]):
                    yield pa.RecordBatch.from_arrays([pa.array(found[:, column]), own], ["bucket", "rid"])

    def meeting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row is passed on when the one before or behind it has its bucket; one row is held back."""
        last, count, held = None, 0, None
        for batch in batches:
            bucket, rid = (batch.column(c).to_numpy() for c in ("bucket", "rid"))
            if not len(bucket):
                continue
            new = np.append(True, bucket[1:] != bucket[:-1])
            new[0] = bucket[0] != last
            starts = np.flatnonzero(new)
            first = np.append(-count, starts) if not new[0] else starts  # where each row's bucket began
            at = np.arange(len(bucket)) - first[np.cumsum(new) - (1 if new[0] else 0)]
            many = at > 0
            many[:-1] |= at[1:] > 0
            if held is not None and not new[0]:
                yield pa.RecordBatch.from_pydict({"bucket": [last], "rid": [held], "at": [0]}, kinds)
            held = int(rid[-1]) if at[-1] == 0 else None
            last, count = bucket[-1], int(at[-1]) + 1
            yield pa.RecordBatch.from_arrays([pa.array(bucket[many]), pa.array(rid[many]), pa.array(at[many].astype(np.int64))], schema=kinds)

    kinds = pa.schema([("bucket", pa.int64()), ("rid", pa.int64()), ("at", pa.int64())])
    rows = dealt(distinct.select("rid", "v").mapInArrow(place, "bucket long, rid long"), "bucket")
    return rows.mapInArrow(meeting, "bucket long, rid long, at long")


def connected(near: np.ndarray) -> np.ndarray:
    """For stacks of link matrices (groups x members x members), each member's smallest connected one."""
    label = np.broadcast_to(np.arange(near.shape[1]), near.shape[:2]).copy()
    while True:
        new = np.where(near, label[:, None, :], near.shape[1]).min(2)
        if (new == label).all():
            return label
        label = new


def meeting_groups(meet: DataFrame, most_apart: int) -> DataFrame:
    """``group, rid``: what sketches connect within each (``bucket``, ``part``) of ``meet(bucket, part, rid, s0, ...)``."""
    words = [f"s{k}" for k in range(SKETCH // 64)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, at in groups(batches, ["bucket", "part"]):
            rid, sizes = table.column("rid").to_numpy(), np.diff(at)
            sketch = np.stack([table.column(w).to_numpy().view(np.uint64) for w in words], 1)
            label = np.arange(len(rid))  # the place of the first one that each is connected to
            for size in np.unique(sizes[sizes <= SMALL]).tolist():
                of = at[:-1][sizes == size]
                for some in np.array_split(of, -(-len(of) * size * size // (1 << 19))):
                    places = some[:, None] + np.arange(size)
                    own = sketch[places]
                    near = np.bitwise_count(own[:, :, None] ^ own[:, None]).sum(3, dtype=np.int16) <= most_apart
                    label[places] = some[:, None] + connected(near)
            for start, end in zip(at[:-1][sizes > SMALL].tolist(), at[1:][sizes > SMALL].tolist(), strict=True):
                own = sketch[start:end]
                near = lambda some, others, own=own: (np.bitwise_count(own[some][:, None] ^ own[others]).sum(2, dtype=np.int16) <= most_apart).any(0)
                for root, member in spanning(len(own), near):
                    label[start + member] = start + root
            order = np.lexsort((rid, label))
            label, rid = label[order], rid[order]
            starts = np.flatnonzero(np.append(True, label[1:] != label[:-1]))
            sizes = np.diff(np.append(starts, len(label)))
            with np.errstate(over="ignore"):  # a group's name is made of its members, so equal groups have one name
                mixed = _mixed(np.stack([rid] + [np.zeros_like(rid)] * 7, 1), 3)
                names = np.repeat(np.add.reduceat(mixed, starts), sizes).view(np.int64) if len(starts) else rid
            many = np.repeat(sizes > 1, sizes)
            if many.any():
                yield pa.RecordBatch.from_arrays([pa.array(names[many]), pa.array(rid[many])], ["group", "rid"])

    return dealt(meet.select("bucket", "part", "rid", *words), "bucket", "part").mapInArrow(run, "group long, rid long")


def links(distinct: DataFrame, threshold: float = THRESHOLD, most: int = MOST, tables: int = TABLES, width: float = WIDTH) -> DataFrame:
    """Links ``(a, b)`` between rows ``rid`` of ``distinct(rid, v)`` that span those found with a cosine of ``threshold``."""
    words = [f"s{k}" for k in range(SKETCH // 64)]

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, unit in matrices(batch.column("v")):
                columns = np.ascontiguousarray(sketches(unit).T).view(np.int64)
                yield pa.RecordBatch.from_arrays([batch.column("rid").take(pa.array(at)), *map(pa.array, columns)], ["rid", *words])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, at in groups(batches, ["group"]):
            rid, sizes = table.column("rid").to_numpy(), np.diff(at)
            lists = table.column("v").combine_chunks()
            lengths = np.diff(lists.offsets.to_numpy())
            whole = unit_vectors(lists.flatten().to_numpy().reshape(len(rid), -1)) if (lengths == lengths[0]).all() else None
            suspects = sizes > SMALL
            for size in np.unique(sizes[~suspects]) if whole is not None else ():
                of = np.flatnonzero(sizes == size)
                for some in np.array_split(of, -(-len(of) * int(size) // 8192)):
                    stack = whole[at[some][:, None] + np.arange(size)]
                    near = np.triu(stack @ stack.transpose(0, 2, 1) >= threshold, 1)
                    suspects[some[near.any((1, 2))]] = True
            a, b = [], []
            rows = whole if whole is not None else _of(table)
            for start, end in zip(at[:-1][suspects | (whole is None)].tolist(), at[1:][suspects | (whole is None)].tolist(), strict=True):
                own = rows[start:end]
                if whole is None:  # a bucket's name covers the length, so unequal lengths are a collision of names
                    longest = max(map(len, own))
                    own = np.stack([np.concatenate((x, np.zeros(longest - len(x)))) if len(x) == longest else np.zeros(longest) for x in own])
                for x, y in spanning(len(own), lambda some, others, own=own: (own[some] @ own[others].T >= threshold).any(0)):
                    a.append(rid[start + x])
                    b.append(rid[start + y])
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    rows = stored(crowded(distinct, tables, width))
    hot = cut(rows.where(F.col("at") >= most).groupBy("bucket").agg((F.max("at") / most).cast("int").alias("last")))
    many = hot.count()
    meet = rows.withColumn("part", F.lit(0).cast("long"))
    if many:
        meet = joined(rows, hot, "bucket", "left", many).withColumns({"chunk": (F.col("at") / most).cast("int"), "last": F.coalesce("last", F.lit(0))})
        meet = meet.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("last"))))
        meet = meet.withColumn("part", F.least("chunk", "other") * (F.col("last").cast("long") + 1) + F.greatest("chunk", "other"))
    signs = distinct.select("rid", "v").mapInArrow(sketch, ", ".join(f"{c} long" for c in ("rid", *words)))
    met = joined(meet.select("bucket", "part", "rid"), signs, "rid", "inner", distinct.count())
    members = meeting_groups(met, apart(threshold)).distinct()
    return dealt(members.join(distinct.select("rid", "v"), "rid").select("group", "rid", "v"), "group").mapInArrow(compare, "a long, b long")


def partners(members: DataFrame, threshold: float = THRESHOLD, most: int = COUNTED) -> DataFrame:
    """``rid, n``: the weights of all other vectors of its ``root`` that link with each of ``members(root, rid, v, weight)``."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, at in groups(batches, ["root", "part"], 1):
            rid, weight, chunk = (table.column(c).to_numpy() for c in ("rid", "weight", "chunk"))
            inner = table.column("inner").to_numpy()
            rows, found = _of(table), np.zeros(len(rid), np.int64)
            for start, end in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                x, w = np.stack(rows[start:end]), weight[start:end]
                for low in range(0, len(x), 1024):
                    near = x[low : low + 1024] @ x.T >= threshold
                    if inner[start]:
                        some = np.arange(low, min(low + 1024, len(x)))
                        near[some - low, some] = False
                    else:
                        near &= chunk[start + low : start + low + len(near), None] != chunk[None, start:end]
                    found[start + low : start + low + len(near)] = near @ w
            yield pa.RecordBatch.from_arrays([pa.array(rid), pa.array(found)], ["rid", "n"])

    parts = dealt(split_hot(members, "root", "rid", most), "root", "part")
    return parts.mapInArrow(count, "rid long, n long").groupBy("rid").agg(F.sum("n").alias("n"))


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, most: int = MOST, tables: int = TABLES, width: float = WIDTH) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for every row of ``vectors(vec_id, embedding)``."""
    spark = vectors.sparkSession
    bounded_batches(spark)
    kind = "array<float>" if vectors.schema["embedding"].dataType.simpleString() == "array<float>" else "array<double>"
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(kind).alias("v"))
    fit = F.col("vec_id").isNotNull() & finite(F.col("v")) & F.exists("v", lambda x: x != 0)
    rows = rows.withColumn("v", F.when(fit, F.col("v")))
    # rows are numbered once; equal vectors meet by two hashes of 64 bits
    known = stored(rows.where("v IS NOT NULL").withColumns({"h": F.xxhash64("v"), "g": F.xxhash64(F.lit("again"), "v"), "rid": F.monotonically_increasing_id()}))
    equal = cut(known.groupBy("h", "g").agg(F.min("rid").alias("rid"), F.min("vec_id").alias("first"), F.count(F.lit(1)).alias("weight")))
    distinct = cut(joined(known.select("rid", "v"), equal.select("rid", "first", "weight"), "rid", "inner", equal.count()))
    root = components(links(distinct, threshold, most, tables, width)).withColumnRenamed("id", "rid")
    linked = cut(distinct.join(root, "rid"))
    lowest = cut(linked.groupBy("root").agg(F.min("first").alias("component_id")))
    counted = linked.select("rid", "root").join(partners(linked.select("root", "rid", "v", "weight"), threshold, min(most, COUNTED)), "rid")
    counted = joined(counted, lowest, "root", "inner", lowest.count()).drop("root")
    own = F.col("weight") - 1 + F.coalesce("n", F.lit(0))
    of = equal.join(counted, "rid", "left").select("h", "g", own.alias("n_links"), F.coalesce("component_id", "first").alias("component_id"))
    found = known.select("vec_id", "h", "g").join(of, ["h", "g"]).select("vec_id", "n_links", "component_id")
    alone = rows.where("v IS NULL").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return found.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
