"""SimHash near-duplicates by anchor-point covering.

A text's fingerprint has 64 bits: A-Z lower-cased, words are runs other than space and tab to carriage return, 4-word
shingles (repeats count; fewer words: the whole sequence) hash with XXH64, seed 42, and a bit is set if it is set in
over half of the hashes. No words, or a null text: fingerprint zero, which links like any other.

Two fingerprints link at ``THRESHOLD`` = 4 or fewer differing bits. One of their 32-bit halves then differs in at most 2
bits. The anchors of a half are the words of a covering code: the perfect Hamming code of length 31 (covering radius
R = 1) joined to the one remaining bit (R = 0). Two halves x, y that differ in at most 2 bits have a point z within 1 of
both; the anchor nearest to z is within R + 1 of x and of y. So every distinct fingerprint is copied, for either half, to
all anchors within the covering radius plus its share 1 of the threshold, at most 17 of 2 ** 27, and fingerprints are
compared, all 64 bits, only with those at the same anchor. That is exact: no linked pair is missed, none is made up.

Equal texts meet as one fingerprint beforehand. An anchor with more than ``MOST`` fingerprints is dealt out in pairs of
chunks. Within an anchor a search over those not yet reached gives links that span the linked sets, never all pairs.

:func:`deduplicated`, for pipelines, takes near copies as such: distinct five-word shingles with a Jaccard similarity of 0.8 or
more. Candidates are links of the fingerprints of these shingles, by the cover above, and, for copies that differ in more
bits, what prefix filtering finds. All sets are put in one order of shingles; of a set of n, the first n - ceil(0.8 n) + 1
are its prefix, and two sets that similar share a shingle of both prefixes. The order is by how many texts have a
shingle (counted in ``BUCKETS`` by hash), then by hash: it decides how many candidates there are, not which pairs are found.
Two that have a shingle in their prefixes are candidates if their sizes and its places allow the similarity. Where over
``LISTED`` have it, only neighbours in order of size are, by their sizes, so a large group costs no more than its rows; a
pair that is similar is still joined by such steps.

Pairs listed by prefixes are ruled out if fingerprints of ``SKETCH`` bits differ in over ``APART`` and both sets have ``PLAIN``
shingles or more: at a similarity of 0.8 a bit differs with probability 0.152 at most (a simulation; less above 0.8), so a pair
is missed with probability 2e-9. Within each component of what is left the sets themselves are compared, by their overlaps,
so nothing below 0.8 links. A component of more than ``TOGETHER`` shingles is dealt into chunks of about that, ``ROUNDS``
times anew; texts that do not then belong to its largest group are compared with all of it, chunk by chunk, so no pair goes
uncompared and a group of near copies costs a multiple of its rows.

Edge cases: a null or empty text has fingerprint zero. Repeated rows and ids are kept, a row each. A row with a null id
links as any other; component ids are smallest non-null ids, null where a component has none. No rows give no rows.
Columns other than ``doc_id`` and ``text`` are not looked at by the fingerprints.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm.common import bounded_batches, components, cut, dealt, fresh, groups, joined, partitions, picked, plain_plans, spanning, split_hot, stored

SHINGLE, SEED, THRESHOLD = 4, 42, 4
#: Words of the shingles of near copies, and their least similarity.
NEAR_SHINGLE, SIMILARITY = 5, 0.8
#: Fingerprints of one anchor that are compared in one task without dealing them out.
MOST = 8192
#: Shingles of one component that are compared in one task, and how often larger ones are dealt into such chunks.
TOGETHER, ROUNDS = 1 << 22, 2
#: Counters of shingles, by the upper bits of their hashes, and how many to a row.
BUCKETS, BUCKETS_A_ROW = 1 << 20, 1 << 12
#: Bits of the fingerprints that rule pairs out, how many may differ, and the size of sets from which on they do.
SKETCH, APART, PLAIN = 256, 76, 64
#: Rows of one long that are broadcast at most, tens of MB.
KEYS = 1_000_000
#: Sets with the same shingle in their prefixes whose pairs are listed.
LISTED = 32
#: Shingles whose bits are counted at once, which bounds the memory for a text of any length.
AT_ONCE = 1 << 16


@dataclass(frozen=True)
class Cover:
    """Bits that linked fingerprints may differ in, and the parts (offset, width, r) of a fingerprint, one of which then
    differs in at most 2. A part's anchors are the words of the Hamming code of length 2 ** r - 1 on its low bits, with
    any other bits: covering radius 1."""

    threshold: int
    parts: tuple[tuple[int, int, int], ...]

    def __post_init__(self):
        if self.threshold >= 3 * len(self.parts):
            raise ValueError("no part is sure to differ in 2 bits or fewer")


EXACT = Cover(THRESHOLD, ((0, 32, 5), (32, 32, 5)))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def shingle_hashes(words: list[bytes], size: int) -> Iterator[np.ndarray]:
    """The hashes of all shingles, some at a time."""
    if not words:
        return
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    count = max(1, len(words) - size + 1)
    starts, ends = starts[:count].tolist(), ends[min(size, len(words)) - 1 :].tolist()
    hashed = xxhash.xxh64_intdigest
    for at in range(0, count, AT_ONCE):
        yield np.fromiter((hashed(joined[a:b], SEED) for a, b in zip(starts[at : at + AT_ONCE], ends[at : at + AT_ONCE], strict=True)), "<u8")


def distinct_hashes(text: str | None, size: int = NEAR_SHINGLE) -> np.ndarray:
    """The hashes of a text's distinct shingles, ascending."""
    parts = [np.unique(x) for x in shingle_hashes(words_of(text), size)]
    return np.unique(np.concatenate(parts)) if parts else np.zeros(0, np.uint64)


def majority(hashes: Iterator[np.ndarray], bits: int = 64) -> np.ndarray:
    """The bits, in words of 64, that are set in over half of the hashes; words beyond the first mix them anew."""
    total, count = np.zeros(bits, np.int64), 0
    for some in hashes:
        words = [some, *(mixed(some, k) for k in range(1, bits // 64))]
        total += np.concatenate([np.unpackbits(x.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int32) for x in words])
        count += len(some)
    return np.packbits(2 * total > count, bitorder="little").view("<u8")


def mixed(hashes: np.ndarray, turn: int) -> np.ndarray:
    """Other 64-bit hashes, made of these."""
    x = hashes + np.uint64(0x9E3779B97F4A7C15 * turn & (1 << 64) - 1)
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


def fingerprint(text: str | None) -> int:
    """The unsigned 64-bit fingerprint of one text."""
    return int(majority(shingle_hashes(words_of(text), SHINGLE))[0])


def words_hash(text: str | None) -> tuple[int, int]:
    """Two hashes of the words: equal for texts of the same words."""
    joined = b" ".join(words_of(text))
    return xxhash.xxh64_intdigest(joined, SEED), xxhash.xxh64_intdigest(joined, SEED + 1)


def bucket_of(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(65 - BUCKETS.bit_length())).astype(np.int64)


def prefix(hashes: np.ndarray, often: np.ndarray, similarity: float = SIMILARITY) -> np.ndarray:
    """The shingles of a set, rare ones first, one of which any set that similar has in its own prefix, too."""
    n = len(hashes)
    size = n - math.ceil(similarity * n - 1e-9 * n) + 1 if n else 0
    return hashes[np.lexsort((hashes, often[bucket_of(hashes)]))[:size]]


def fingerprints(documents: DataFrame) -> DataFrame:
    """``doc_id`` and ``fp`` (the fingerprint as a signed long), a row per document."""
    bounded_batches(documents.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.fromiter((fingerprint(x.as_py()) for x in batch.column("text")), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found.view(np.int64))], ["doc_id", "fp"])

    return picked(documents, ("doc_id", "long"), ("text", "string")).mapInArrow(run, "doc_id long, fp long")


def _syndromes(width: int, r: int) -> np.ndarray:
    """By byte of a part and value: the exclusive or of the places, from 1, of the bits set inside the Hamming code."""
    value, length = np.arange(256), (1 << r) - 1
    place = lambda bit: bit + 1 if bit < length else 0
    return np.stack([np.bitwise_xor.reduce(np.stack([np.where(value >> bit & 1, place(byte * 8 + bit), 0) for bit in range(8)])) for byte in range(-(-width // 8))])


def anchors(part: np.ndarray, width: int = 32, r: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """All anchors within the covering radius plus 1 of each part: indices into ``part`` and the anchors."""
    part, length = part.astype(np.int64), (1 << r) - 1
    s = np.zeros(len(part), np.int64)
    for byte, table in enumerate(_syndromes(width, r)):
        s ^= table[part >> 8 * byte & 255]
    flip = np.concatenate(([0], 1 << np.arange(length, dtype=np.int64)))  # by place
    home, every = part ^ flip[s], np.arange(len(part))
    free = [home ^ 1 << bit for bit in range(length, width)]
    at, found = [every] * (1 + len(free)), [home, *free]
    for i in range(1, length + 1):  # the two flips i and i ^ s lead to a code word at distance 2
        j = i ^ s
        ok = np.flatnonzero(i < j)
        at.append(every[ok])
        found.append(part[ok] ^ flip[i] ^ flip[j[ok]])
    return np.concatenate(at), np.concatenate(found)


def at_anchors(distinct: DataFrame, cover: Cover = EXACT) -> DataFrame:
    """``anchor`` (with the part's number above its bits) and ``fp`` for every distinct ``fp``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column("fp").to_numpy()
            for number, (offset, width, r) in enumerate(cover.parts):
                at, found = anchors(fp >> offset & (1 << width) - 1, width, r)
                yield pa.RecordBatch.from_arrays([pa.array(found | number << 32), pa.array(fp[at])], ["anchor", "fp"])

    return distinct.select("fp").mapInArrow(run, "anchor long, fp long")


def links(distinct: DataFrame, most: int = MOST, cover: Cover = EXACT) -> DataFrame:
    """Links ``(a, b)`` between distinct fingerprints that span what links under ``cover``."""
    threshold = cover.threshold

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, at in groups(batches, ["anchor", "part"]):
            fp = table.column("fp").to_numpy().view(np.uint64)
            sizes = np.diff(at)
            two = at[:-1][sizes == 2]
            two = two[np.bitwise_count(fp[two] ^ fp[two + 1]) <= threshold]
            a, b = [fp[two]], [fp[two + 1]]
            for start, end in zip(at[:-1][sizes > 2].tolist(), at[1:][sizes > 2].tolist(), strict=True):
                own = fp[start:end]
                near = lambda some, others, own=own: (np.bitwise_count(own[some][:, None] ^ own[others][None, :]) <= threshold).any(0)
                if found := spanning(len(own), near):
                    x, y = np.array(found).T
                    a.append(own[x])
                    b.append(own[y])
            a, b = np.concatenate(a).view(np.int64), np.concatenate(b).view(np.int64)
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    meeting = split_hot(at_anchors(distinct, cover), "anchor", "fp", most)
    return dealt(meeting.select("anchor", "part", "fp"), "anchor", "part").mapInArrow(run, "a long, b long")


def fingerprint_components(known: DataFrame, most: int = MOST, cover: Cover = EXACT) -> DataFrame:
    """``fp, first, root, component_id`` for every distinct fingerprint of ``known(doc_id, fp)``."""
    distinct = cut(known.groupBy("fp").agg(F.min("doc_id").alias("first")))
    root = components(links(distinct, most, cover)).withColumnRenamed("id", "fp")
    linked = cut(distinct.join(root, "fp"))  # those alone are their own components
    lowest = cut(linked.groupBy("root").agg(F.min("first").alias("component_id")))
    of = joined(linked, lowest, "root", "inner", lowest.count()).select("fp", "root", "component_id")
    found = distinct.join(of, "fp", "left").withColumn("alone", F.col("root").isNull())
    return cut(found.select("fp", "first", F.coalesce("root", "fp").alias("root"), F.when(F.col("alone"), F.col("first")).otherwise(F.col("component_id")).alias("component_id")))


def near_duplicates(documents: DataFrame, most: int = MOST) -> DataFrame:
    """``doc_id``, ``fingerprint`` (16 hex digits), ``component_id`` (smallest linked doc_id) for every document."""
    known = cut(fingerprints(documents))
    of = fingerprint_components(known, most).select("fp", "component_id")
    return known.join(of, "fp", "left").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


class Overlaps:
    """Sets of hashes, and for each the texts that have it."""

    def __init__(self, sets: list[np.ndarray]):
        self.sizes = np.array([len(x) for x in sets], np.int64)
        self.starts = np.concatenate(([0], np.cumsum(self.sizes)))
        distinct, self.ids = np.unique(np.concatenate([np.zeros(0, np.uint64), *sets]), return_inverse=True)
        owner = np.repeat(np.arange(len(sets)), self.sizes)
        self.holders = owner[np.argsort(self.ids, kind="stable")]
        self.at = np.concatenate(([0], np.cumsum(np.bincount(self.ids, minlength=len(distinct)))))

    def similar(self, one: int, similarity: float = SIMILARITY) -> np.ndarray:
        """For every set whether it is similar to set ``one``."""
        ids = self.ids[self.starts[one] : self.starts[one + 1]]
        lengths = self.at[ids + 1] - self.at[ids]
        ends = np.cumsum(lengths)
        places = np.repeat(self.at[ids] - (ends - lengths), lengths) + np.arange(ends[-1] if len(ends) else 0)
        both = np.bincount(self.holders[places], minlength=len(self.sizes))
        return (both > 0) & (both >= similarity * (self.sizes + self.sizes[one] - both) - 1e-9)


def set_links(sets: list[np.ndarray], group: np.ndarray, ask: np.ndarray, similarity: float = SIMILARITY) -> list[tuple[int, int]]:
    """Links between sets of different ``group`` that join the groups which any set of ``ask`` is similar to.

    Sets that are reached are asked next, and groups once joined are one, so a dense group is asked for about once.
    """
    overlaps, group, links = Overlaps(sets), group.copy(), []
    waiting = ask.copy()
    for start in np.flatnonzero(ask).tolist():
        queue = [start]
        while queue:
            one = queue.pop()
            if not waiting[one]:
                continue
            waiting[one] = False
            if not (group != group[one]).any():
                return links
            hit = np.flatnonzero(overlaps.similar(one, similarity) & (group != group[one]))
            _, firsts = np.unique(group[hit], return_index=True)
            for other in hit[firsts].tolist():
                links.append((one, other))
                group[group == group[other]] = group[one]
            queue += hit[waiting[hit]].tolist()
    return links


def _compared(rows: DataFrame, similarity: float) -> DataFrame:
    """Links ``(a, b)`` within each (``root``, ``part``) of ``rows(root, part, cid, group, ask, set)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, at in groups(batches, ["root", "part"]):
            cid, packed = table.column("cid").to_numpy(), table.column("set")
            group, ask = table.column("group").to_numpy(), table.column("ask").to_numpy()
            found = []
            for start, end in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                own = [np.frombuffer(x.as_py(), np.uint64) for x in packed.slice(start, end - start)]
                found += [(int(cid[start + x]), int(cid[start + y])) for x, y in set_links(own, group[start:end], ask[start:end], similarity)]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found, strict=True)], ["a", "b"])

    return dealt(rows.select("root", "part", "cid", "group", "ask", "set"), "root", "part").mapInArrow(run, "a long, b long")


def near_groups(texts: DataFrame, together: int = TOGETHER, similarity: float = SIMILARITY) -> DataFrame:
    """``cid, group`` for the linked ones among ``texts(root, cid, text)``: those of a root that similar ones join share a group."""
    with plain_plans(texts.sparkSession):
        return _near_groups(texts, together, similarity)


def _near_groups(texts: DataFrame, together: int, similarity: float) -> DataFrame:
    bounded_batches(texts.sparkSession, 512)

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [distinct_hashes(x.as_py()) for x in batch.column("text")]
            sizes, packed = pa.array([len(x) for x in found], pa.int64()), pa.array([x.tobytes() for x in found], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("root"), batch.column("cid"), sizes, packed], ["root", "cid", "size", "set"])

    rows = cut(texts.select("root", "cid", "text").mapInArrow(sets, "root long, cid long, size long, set binary"))
    chunks = F.ceil(F.sum("size") / together).cast("int")
    roots = cut(rows.groupBy("root").agg(chunks.alias("k")).where("k > 1"))
    hot = roots.count()
    alone = rows.withColumn("group", F.col("cid")).withColumn("ask", F.lit(True))
    if not hot:
        return components(_compared(alone.withColumn("part", F.lit(0)), similarity)).select(F.col("id").alias("cid"), F.col("root").alias("group"))
    alone = joined(alone, roots, "root", "left", hot).withColumn("k", F.coalesce("k", F.lit(1)))
    found = cut(_compared(alone.withColumn("part", F.lit(0)).where("k = 1"), similarity))
    some = alone.where("k > 1")
    for turn in range(ROUNDS):
        part = F.pmod(F.xxhash64("cid", F.lit(turn)), F.col("k")).cast("int")
        found = cut(found.union(_compared(some.withColumn("part", part), similarity)))
    # what isn't in the largest group of its root meets all of it
    label = components(found).select(F.col("id").alias("cid"), F.col("root").alias("label"))
    some = some.join(label, "cid", "left").withColumn("group", F.coalesce("label", "cid")).drop("label")
    sizes = cut(some.groupBy("root", "group").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("size")))
    first = sizes.groupBy("root").agg(F.max(F.struct("n", "group")).alias("largest"), F.sum("size").alias("all"))
    rest = sizes.join(first, "root").where(F.col("group") != F.col("largest.group")).groupBy("root", F.col("largest.group").alias("largest"))
    rest = cut(rest.agg(F.ceil(F.sum("size") / together).cast("int").alias("m")))
    left = rest.count()
    if left:
        some = joined(some, rest, "root", "inner", left).withColumn("i", F.pmod(F.xxhash64("cid"), F.col("m")).cast("int")).withColumn("j", F.pmod(F.xxhash64("cid", F.lit(-1)), F.col("k")).cast("int"))
        asks, answers = some.where("group <> largest"), some.withColumn("ask", F.lit(False))
        asks = asks.withColumn("j", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
        answers = answers.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("m") - 1)))
        both = asks.unionByName(answers).withColumn("part", F.col("i") * F.col("k") + F.col("j"))
        found = found.union(_compared(both, similarity))
    return components(found).select(F.col("id").alias("cid"), F.col("root").alias("group"))


def features(texts: DataFrame) -> DataFrame:
    """Of ``texts(cid, text)``: rows ``(cid, size, s0, ...)``, the size and fingerprint of each set of shingles, and rows
    ``(at, counts)``, how many sets have a shingle of each bucket, by task and ``BUCKETS_A_ROW`` buckets."""
    turns = SKETCH // 64
    names = ["cid", "size", *(f"s{k}" for k in range(turns)), "at", "counts"]
    kinds = pa.schema([(n, pa.binary() if n == "counts" else pa.int64()) for n in names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int32)
        for batch in batches:
            size, sketch = np.zeros(batch.num_rows, np.int64), np.zeros((batch.num_rows, turns), np.uint64)
            for k, text in enumerate(batch.column("text")):
                found = distinct_hashes(text.as_py())
                np.add.at(total, bucket_of(found), 1)
                size[k], sketch[k] = len(found), majority((found[at : at + AT_ONCE] for at in range(0, len(found), AT_ONCE)), SKETCH)
            none = pa.nulls(batch.num_rows)
            own = [batch.column("cid"), pa.array(size), *(pa.array(np.ascontiguousarray(x).view(np.int64)) for x in sketch.T), none, none]
            yield pa.RecordBatch.from_arrays([x.cast(k) for x, k in zip(own, kinds.types, strict=True)], schema=kinds)
        rows = total.reshape(-1, BUCKETS_A_ROW)
        some = np.flatnonzero(rows.any(1))
        own = [*([pa.nulls(len(some))] * (len(names) - 2)), pa.array(some), pa.array([x.tobytes() for x in rows[some]], pa.binary())]
        yield pa.RecordBatch.from_arrays([x.cast(k) for x, k in zip(own, kinds.types, strict=True)], schema=kinds)

    return texts.select("cid", "text").mapInArrow(run, ", ".join(f"{n} {'binary' if n == 'counts' else 'long'}" for n in names))


def shingle_counts(found: DataFrame) -> np.ndarray:
    """How many sets have a shingle of each bucket, summed up from :func:`features`; 4 MB for any number of texts."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for at, counts in zip(batch.column("at").to_pylist(), batch.column("counts"), strict=True):
                total[at] = total.get(at, 0) + np.frombuffer(counts.as_py(), np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array([x.tobytes() for x in total.values()], pa.binary())], ["at", "counts"])

    often = np.zeros((BUCKETS // BUCKETS_A_ROW, BUCKETS_A_ROW), np.int32)
    parts = found.where("at IS NOT NULL").select("at", "counts")
    for at, counts in parts.repartition(partitions(found.sparkSession), "at").mapInArrow(add, "at long, counts binary").collect():
        often[at] = np.frombuffer(counts, np.int32)
    return often.ravel()


def candidates(texts: DataFrame, often: np.ndarray, similarity: float = SIMILARITY, listed: int = LISTED) -> DataFrame:
    """Pairs ``(a, b)`` of ``texts(cid, text)``, some more than once: any two whose shingles are similar are joined by them."""

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [distinct_hashes(x.as_py()) for x in batch.column("text")]
            found = [prefix(x, often, similarity) for x in sets]
            lengths = np.array([len(x) for x in found], np.int64)
            at = [(len(x) << 32) + np.arange(len(y)) for x, y in zip(sets, found, strict=True)]
            shingle = np.concatenate([np.zeros(0, np.uint64), *found]).view(np.int64)
            cid = np.repeat(batch.column("cid").to_numpy(), lengths)
            yield pa.RecordBatch.from_arrays([pa.array(shingle), pa.array(np.concatenate([np.zeros(0, np.int64), *at])), pa.array(cid)], ["shingle", "at", "cid"])

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, at in groups(batches, ["shingle"]):
            cid, place = table.column("cid").to_numpy(), table.column("at").to_numpy()
            size, sizes, starts = place >> 32, np.diff(at), at[:-1]
            rest = size - (place & 0xFFFFFFFF)  # the shingle and those after it, all that two share if it is the first
            a, b = [], []
            for many in np.unique(sizes[sizes <= listed]).tolist():
                i, j = np.triu_indices(many, 1)
                x, y = ((starts[sizes == many][:, None] + k).ravel() for k in (i, j))
                ok = np.minimum(rest[x], rest[y]) >= similarity / (1 + similarity) * (size[x] + size[y]) - 1e-6
                a.append(x[ok])
                b.append(y[ok])
            follows = np.repeat(sizes > listed, sizes)
            follows[starts] = False
            y = np.flatnonzero(follows)
            x, y, sure = np.concatenate([*a, y - 1]), np.concatenate([*b, y]), np.repeat([False, True], [sum(map(len, a)), len(y)])
            ok = size[x] >= similarity * size[y] - 1e-6
            if ok.any():
                yield pa.RecordBatch.from_arrays([pa.array(cid[x[ok]]), pa.array(cid[y[ok]]), pa.array(sure[ok])], ["a", "b", "step"])

    rows = texts.select("cid", "text").mapInArrow(prefixes, "shingle long, at long, cid long")
    rows = rows.repartition(partitions(texts.sparkSession), "shingle").sortWithinPartitions("shingle", "at")
    return rows.mapInArrow(pairs, "a long, b long, step boolean")


def plausible(pairs: DataFrame, sketches: DataFrame, apart: int = APART) -> DataFrame:
    """Distinct ``pairs(a, b, step)`` that the sketches don't rule out; steps between neighbours in size are not ruled out."""
    pairs = pairs.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.max("step").alias("step"))
    words = [f"s{k}" for k in range(SKETCH // 64)]
    side = lambda x: sketches.select(F.col("cid").alias(x), *(F.col(n).alias(f"{x}_{n}") for n in ("size", *words)))
    differ = sum((F.bit_count(F.col(f"a_{n}").bitwiseXOR(F.col(f"b_{n}"))) for n in words[1:]), F.bit_count(F.col("a_s0").bitwiseXOR(F.col("b_s0"))))
    found = pairs.join(side("a"), "a").join(side("b"), "b")
    return found.where(F.col("step") | (F.least("a_size", "b_size") < PLAIN) | (differ <= apart)).select("a", "b")


def fingerprint_links(sketches: DataFrame) -> DataFrame:
    """Links ``(a, b)`` of ``sketches(cid, s0, ...)`` whose first 64 bits differ in ``THRESHOLD`` or fewer, as :func:`links`."""
    distinct = cut(sketches.where("size > 0").groupBy(F.col("s0").alias("fp")).agg(F.min("cid").alias("first")))
    equal = sketches.join(distinct, F.col("s0") == F.col("fp")).select(F.col("first").alias("a"), F.col("cid").alias("b")).where("a <> b")
    one, other = (distinct.select(F.col("fp").alias(x), F.col("first").alias(f"{x}_first")) for x in ("a", "b"))
    near = links(distinct).join(one, "a").join(other, "b").select(F.col("a_first").alias("a"), F.col("b_first").alias("b"))
    return equal.union(near)


def deduplicated(documents: DataFrame, together: int = TOGETHER) -> DataFrame:
    """The documents without all but one of each group of near copies: the row with its smallest doc_id (nulls last) stays.

    Texts of the same words are one class; texts without words are one too. Rows are numbered once, in a table in the shared
    folder that every later scan reads, so no change of partitions between scans can mix rows up. The rows that go, not
    the texts that stay, are what the last scan is joined with.
    """
    bounded_batches(documents.sparkSession)
    row = fresh(documents, "_row")
    placed = stored(documents.withColumn(row, F.monotonically_increasing_id()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([words_hash(x.as_py()) for x in batch.column("text")], np.uint64).reshape(-1, 2).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("_row"), batch.column("doc_id"), pa.array(found[:, 0]), pa.array(found[:, 1])], ["_row", "doc_id", "words", "more"])

    slim = placed.select(F.col(row).alias("_row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    known = cut(slim.mapInArrow(run, "_row long, doc_id long, words long, more long"))
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_row")
    classes = cut(known.groupBy("words", "more").agg(F.min(order).alias("best")))
    classes = classes.select("best", F.col("best._row").alias("cid"))
    again = cut(known.join(classes.select(F.col("cid").alias("_row")), "_row", "left_anti").select("_row"))
    firsts = joined(slim.select("_row", "text"), again, "_row", "left_anti", again.count(), KEYS).withColumnRenamed("_row", "cid")
    found = cut(features(firsts))
    sketches = found.where("cid IS NOT NULL").drop("at", "counts")
    pairs = plausible(cut(candidates(firsts, shingle_counts(found))), sketches).union(fingerprint_links(sketches))
    asked = cut(components(pairs).select("root", F.col("id").alias("_row")))
    texts = joined(slim.select("_row", "text"), asked, "_row", "inner", asked.count(), KEYS).withColumnRenamed("_row", "cid")
    linked = near_groups(texts, together)
    grouped = classes.join(linked, "cid", "left").withColumn("group", F.coalesce("group", "cid"))
    kept = grouped.groupBy("group").agg(F.min("best").alias("best")).select(F.col("best._row").alias("_row"))
    gone = cut(known.select("_row").join(kept, "_row", "left_anti"))
    return joined(placed, gone.withColumnRenamed("_row", row), row, "left_anti", gone.count(), KEYS).drop(row)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
