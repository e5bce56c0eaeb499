"""Helpers that several operators of this subpackage share.

Arrow batches are bounded here, lineage is cut here, and components of a link graph are found here without any
single task, or the driver, holding more than a bounded share of the rows.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerloom.shipping import ship

#: Rows and bytes of one Arrow batch sent to a Python worker; texts of any length stay within a worker's memory.
BATCH_ROWS, BATCH_BYTES = 4096, 4 << 20
#: Bytes beyond which the estimated size of a table tells nothing.
LARGEST = 1 << 62


def bounded_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Bounds the Arrow batches of this session's Python operators by rows and by bytes, and gets the code to executors."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a local one where it is unset and the master is local."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir is unset: it must name a folder that driver and executors share")
        folder = getattr(shared_dir, "own", None) or tempfile.mkdtemp(prefix="checkpoints-")
        shared_dir.own = folder
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return folder.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """Writes ``df`` to the shared checkpoint folder and reads it from there from now on."""
    shared_dir(df.sparkSession)
    return plainly_sized(df.checkpoint(eager=True))


def plainly_sized(df: DataFrame) -> DataFrame:
    """A table just cut, with Spark's default in place of an estimated size beyond ``LARGEST``.

    Spark takes a join to be as large as the product of its sides, and a table that is cut keeps the estimate. In a loop its
    digits double at each step, until the driver has no memory for that one number.
    """
    spark, plan = df.sparkSession, df._jdf.queryExecution().logical()
    if plan.stats().sizeInBytes() <= LARGEST:
        return df
    option = spark._jvm.scala.Option
    rows = plan.copy(plan.output(), plan.rdd(), plan.outputPartitioning(), plan.outputOrdering(), plan.isStreaming(), plan.stream(), spark._jsparkSession, option.empty(), option.apply(plan.constraints()))
    return type(df)(spark._jvm.org.apache.spark.sql.classic.Dataset.ofRows(spark._jsparkSession, rows), spark)


def discard(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def scratch(spark: SparkSession, name: str):
    """A new folder in the shared one that is gone afterwards; what :func:`stored` writes meanwhile lies in it."""
    before, folder = getattr(scratch, "now", None), f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    scratch.now = folder
    try:
        yield folder
    finally:
        scratch.now = before
        discard(spark, folder)


def stored(df: DataFrame) -> DataFrame:
    """``df`` as a table in the shared folder: its rows are made once, and scans read only the columns that they ask for."""
    folder = f"{getattr(scratch, 'now', None) or shared_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def remainder(column: str, divisor: int) -> Column:
    """crc32 of the id as text, modulo ``divisor``; null for a null id."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % divisor


def joined(left: DataFrame, right: DataFrame, on, how: str, rows: int, most: int = 100_000) -> DataFrame:
    """A join that broadcasts ``right`` only if its counted ``rows`` are at most ``most``; else a shuffled join."""
    return left.join(F.broadcast(right) if rows <= most else right.hint("merge"), on, how)


def picked(df: DataFrame, *columns: tuple[str, str]) -> DataFrame:
    """The named columns cast to the types given; extra columns of any name are left behind."""
    return df.select(*(F.col(f"`{name}`").cast(kind).alias(name) for name, kind in columns))


def fresh(df: DataFrame, name: str) -> str:
    """``name``, with as many underscores in front as it takes to be no column of ``df``."""
    present = {c.lower() for c in df.columns}
    while name.lower() in present:
        name = f"_{name}"
    return name


def hash_sample(rows: DataFrame, by: str, key: str, most: int) -> DataFrame:
    """Of ``rows``, for each value of ``by``, the ``most`` with the smallest hash of ``key`` (or a few less, rarely).

    A first cut by the hash's size, from counts, leaves little more than ``most`` rows a value to be put in order.
    """
    sizes = cut(rows.groupBy(by).agg(F.count(F.lit(1)).alias("_n")))
    hashed = F.pmod(F.xxhash64(key), F.lit(1 << 40)) / float(1 << 40)
    some = joined(rows, sizes, by, "inner", sizes.count()).where(hashed < (1.25 * most + 64) / F.col("_n"))
    at = F.row_number().over(W.partitionBy(by).orderBy(hashed, key))
    return some.withColumn("_at", at).where(F.col("_at") <= most).drop("_n", "_at")


def _to_roots(up: DataFrame) -> DataFrame:
    """Pointers ``(id, up)`` followed to their ends; their length doubles with each step."""
    while True:
        top = up.select(F.col("id").alias("up"), F.col("up").alias("top"))
        far = cut(up.join(top, "up", "left").select("id", F.coalesce("top", "up").alias("top"), "up"))
        up = far.select("id", F.col("top").alias("up"))
        if far.where("top <> up").isEmpty():
            return up


@contextmanager
def plain_plans(spark: SparkSession):
    """Without inferred constraints, which tables cut in a loop would pass on and multiply."""
    name = "spark.sql.constraintPropagation.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def components(edges: DataFrame) -> DataFrame:
    """Connected components of undirected ``edges(a long, b long)``: one row ``(id, root)`` per id that has an edge.

    Every round points each id at its smallest neighbour, follows the pointers to their ends, and contracts the graph to
    those ends. A star or a chain is done in one or two rounds. The tables of each round are cut through the shared
    folder; nothing is collected. Hubs are only ever grouped by partial aggregation or joined, which adaptive
    execution can split. Self links and repeats are allowed; no edges give no rows.
    """
    with plain_plans(edges.sparkSession):
        edges = cut(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct())
        labels = None
        while not edges.isEmpty():
            both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
            up = _to_roots(both.groupBy("a").agg(F.min("b").alias("low")).select(F.col("a").alias("id"), F.least("a", "low").alias("up")))
            if labels is None:
                labels = up.select("id", F.col("up").alias("root"))
            else:
                step = up.select(F.col("id").alias("root"), "up")
                labels = cut(labels.join(step, "root", "left").select("id", F.coalesce("up", "root").alias("root")))
            a = up.select(F.col("id").alias("a"), F.col("up").alias("ua"))
            b = up.select(F.col("id").alias("b"), F.col("up").alias("ub"))
            moved = edges.join(a, "a").join(b, "b").where("ua <> ub")
            edges = cut(moved.select(F.least("ua", "ub").alias("a"), F.greatest("ua", "ub").alias("b")).distinct())
    return edges.select(F.col("a").alias("id"), F.col("b").alias("root")) if labels is None else labels


def split_hot(rows: DataFrame, key: str, member: str, most: int) -> DataFrame:
    """Adds ``part``, so that no group of (``key``, ``part``) has more than about twice ``most`` rows.

    The rows of a key that has k * most rows are dealt into k chunks by a hash of ``member`` and each is copied to the k
    pairs of chunks that its own is in, so any two rows of a key still meet in some part. Keys of up to ``most`` rows
    keep one part. Hot keys are found by an exact count with map-side partial sums. ``chunk`` is the row's own chunk,
    and ``inner`` tells parts that pair a chunk with itself: these list pairs inside a chunk once, the others pairs across.
    """
    hot = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most)
    hot = cut(hot.select(key, F.ceil(F.col("n") / most).cast("int").alias("k")))
    found = hot.count()
    if not found:
        return rows.select("*", F.lit(0).alias("chunk"), F.lit(0).alias("part"), F.lit(True).alias("inner"))
    rows = joined(rows, hot, key, "left", found).withColumn("k", F.coalesce("k", F.lit(1)))
    rows = rows.withColumn("chunk", F.pmod(F.xxhash64(F.col(member)), F.col("k")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
    part = F.least("other", "chunk") * F.col("k") + F.greatest("other", "chunk")
    return rows.withColumn("part", part).withColumn("inner", F.col("other") == F.col("chunk")).drop("k", "other")


def dealt(rows: DataFrame, *keys: str) -> DataFrame:
    """``rows`` with equal keys together and next to each other, for :func:`groups`."""
    return rows.repartition(partitions(rows.sparkSession), *keys).sortWithinPartitions(*keys)


def groups(batches: Iterator[pa.RecordBatch], keys: list[str], least: int = 2) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole groups of at least ``least`` rows, with the groups' offsets, out of batches sorted by ``keys``.

    Only the group that a batch ends in is carried over, so memory is one batch and one group.
    """
    kept: list[pa.Table] = []

    def whole(table: pa.Table, last: bool) -> tuple[pa.Table, np.ndarray, pa.Table]:
        new = np.zeros(table.num_rows, bool)
        new[:1] = True
        for key in keys:
            values = table.column(key).to_numpy()
            new[1:] |= values[1:] != values[:-1]
        starts = np.flatnonzero(new)
        end = table.num_rows if last else int(starts[-1])
        return table.slice(0, end), np.append(starts[starts < end], end), table.slice(end)

    def ready(table: pa.Table, at: np.ndarray):
        sizes = np.diff(at)
        big = sizes >= least
        if big.any():
            keep = np.repeat(big, sizes)
            yield table.filter(pa.array(keep)), np.concatenate(([0], np.cumsum(sizes[big])))

    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        if kept and all(kept[0].column(k)[0].as_py() == table.column(k)[-1].as_py() for k in keys):
            kept.append(table)  # one group goes on through the whole batch
            continue
        table, at, rest = whole(pa.concat_tables([*kept, table]), False)
        kept = [rest]
        yield from ready(table, at)
    if kept:
        table, at, _ = whole(pa.concat_tables(kept), True)
        yield from ready(table, at)


def spanning(n: int, near, frontier: int = 64) -> list[tuple[int, int]]:
    """Links (root, member) that span the components of items 0 to n - 1, without listing all pairs.

    ``near(some, others)`` tells for each of ``others`` whether it links with any of ``some``. A search starts at each
    item not yet reached and compares only with those not yet reached, so a dense group costs about one pass.
    """
    left, links = np.arange(n), []
    while len(left) > 1:
        root, left = left[0], left[1:]
        queue = [np.array([root])]
        while queue and len(left):
            some = queue.pop()
            if len(some) > frontier:
                queue.append(some[frontier:])
                some = some[:frontier]
            hit = near(some, left)
            if hit.any():
                reached, left = left[hit], left[~hit]
                links += [(int(root), int(x)) for x in reached]
                queue.append(reached)
    return links
