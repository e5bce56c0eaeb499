"""Mixing sources to target weights by Efraimidis-Spirakis sampling. DataFrame functions only.

A document's size is its number of words (runs other than space and tab to carriage return; null text: 0). The mix takes
``multiple`` times all words. Sources in code-point order, null last, have the ``weights`` in turn; a source's target
is its share by weight, at most ``cap`` times its size, and what a cap leaves over goes to the others by weight until
none is above (one level for all uncapped sources, found by sorting them by cap / weight).

Within a source every document has the exponential key -ln(u) / w: u is uniform, from an md5 of seed and doc_id, and w is
the document's quality weight, 0.05 to 1, from the share of characters that aren't digits or symbols. Complete epochs take
every document of a source; the rest of the target takes documents in ascending key order while at least half of the next
one still fits, so a source misses its target by half a document at most. Whole documents only.

No source is sorted in one task: keys fall into ``BUCKETS`` ranges, sums by source and range find the range in which a
source's budget ends, and only that range's distinct keys, with their counts, are put in order. The cut is then one row per
source, and applies to any document by itself. Rows equal in source, key, id, size and text are told apart only if the
budget ends among them: these rows are stored, numbered by partition, and as many are taken as fit. Windows without a
partition key see a row per source: sources are names such as sites or feeds, thousands, not one per document.

Edge cases: null or empty text: size 0, never over 0 taken. A null source is a source. A null doc_id counts as one id.
Ties go by id, size and text. Repeated rows are rows of their own. Texts of any length are read once, by expressions. No
rows give no rows. Other columns play no part; they come through :func:`repeated` whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerloom.llm.common import cut, joined, stored

MULTIPLE, CAP, WEIGHTS, SEED, BUCKETS = 1.5, 2.0, (3, 1, 2), "mix", 4096
#: The order of a source's documents.
PLACE = ("_key", "_id", "_size", "_tie")
WORD = r"[^\x20\x09-\x0D]+"
#: Characters that lower a document's quality weight.
SYMBOLS = "!#$%&*|{}[]<>=+_~^@0123456789"


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def weight(text: Column) -> Column:
    """Quality weight, 0.05 to 1."""
    plain = F.when(F.length(text) > 0, F.length(F.translate(text, SYMBOLS, "")) / F.length(text)).otherwise(F.lit(0.0))
    return F.lit(0.05) + F.lit(0.95) * plain * plain


def keyed(documents: DataFrame, seed: str = SEED) -> DataFrame:
    """The documents with ``_s``/``_none`` (source), ``_id``, ``_size``, ``_key``, ``_tie`` and ``_bucket`` beside their own columns."""
    text = F.col("text").cast("string")
    digits = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))).cast("binary")), 1, 13)
    uniform = (F.conv(digits, 16, 10).cast("double") + 0.5) / float(1 << 52)
    key = -F.log(uniform) / weight(text)
    return (
        documents.withColumn("_s", F.coalesce(F.col("source").cast("string"), F.lit("")))
        .withColumn("_none", F.col("source").isNull())
        .withColumn("_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)).cast("long")))
        .withColumn("_size", words(text))
        .withColumn("_key", key)
        .withColumn("_tie", F.xxhash64(text))
        .withColumn("_bucket", F.floor(F.col("_key") / (1 + F.col("_key")) * BUCKETS).cast("int"))
    )


def targets(sizes: DataFrame, multiple: float = MULTIPLE, cap: float = CAP, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """``_s, _none, source_size, target`` for ``sizes(_s, _none, source_size)``, a row per source."""
    order = W.orderBy("_none", "_s")  # one row per source
    turn = F.pmod(F.row_number().over(order) - 1, F.lit(len(weights)))
    w = F.element_at(F.array(*(F.lit(x).cast("long") for x in weights)), turn.cast("int") + 1)
    one = sizes.withColumn("w", w).withColumn("cap", F.lit(cap) * F.col("source_size"))
    least = W.orderBy(F.col("cap") / F.col("w"), "_none", "_s")
    before, after = least.rowsBetween(W.unboundedPreceding, -1), least.rowsBetween(W.currentRow, W.unboundedFollowing)
    everything = W.orderBy(F.lit(1)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    level = (F.lit(multiple) * F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("w").over(after)
    one = one.withColumn("level", level).withColumn("free", F.col("level") * F.col("w") < F.col("cap"))
    final = F.min(F.when(F.col("free"), F.struct(F.col("cap") / F.col("w"), "_none", "_s", "level"))).over(everything)["level"]
    return one.select("_s", "_none", "source_size", F.when(F.col("cap") <= F.coalesce(final * F.col("w"), "cap"), F.col("cap")).otherwise(final * F.col("w")).alias("target"))


def cuts(rows: DataFrame, **options) -> DataFrame:
    """A row per source of ``rows`` (from :func:`keyed`): source_size, target, epochs, and where its budget ends."""
    source = ["_s", "_none"]
    sums = cut(rows.groupBy(*source, "_bucket").agg(F.sum("_size").alias("n")))
    goal = targets(sums.groupBy(*source).agg(F.sum("n").alias("source_size")), **options)
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    goal = cut(goal.withColumn("epochs", epochs).withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size")))
    n = goal.count()
    passed = F.sum("n").over(W.partitionBy(*source).orderBy("_bucket"))  # at most BUCKETS rows a source
    ended = joined(sums.withColumn("passed", passed), goal, source, "inner", n).where(F.col("passed") >= F.col("rest"))
    ended = ended.groupBy(*source).agg(F.min(F.struct("_bucket", F.col("passed") - F.col("n"), "rest")).alias("e"))
    ended = cut(ended.select(*source, F.col("e._bucket").alias("_bucket"), F.col("e.col2").alias("base"), F.col("e.rest").alias("rest")))
    inside = joined(rows.select(*source, "_bucket", *PLACE), ended, [*source, "_bucket"], "inner", n)
    inside = inside.groupBy(*source, "base", "rest", *PLACE).agg(F.count(F.lit(1)).alias("_many"))
    upto = W.partitionBy(*source).orderBy(*PLACE).rowsBetween(W.unboundedPreceding, -1)
    left = F.col("rest") - F.col("base") - F.coalesce(F.sum(F.col("_size") * F.col("_many")).over(upto), F.lit(0))
    fit = F.when(F.col("_size") > 0, F.floor(left / F.col("_size") + F.lit(0.5))).when(left >= 0, F.col("_many")).otherwise(F.lit(0))
    last = inside.withColumn("_fit", F.least(fit.cast("long"), "_many")).where("_fit > 0")
    last = last.groupBy(*source).agg(F.max(F.struct(*PLACE, "_fit", "_many")).alias("_last"))
    last = last.select(*source, F.struct(*(F.col(f"_last.{x}").alias(x) for x in PLACE)).alias("_last"), F.col("_last._fit").alias("_fit"), F.col("_last._many").alias("_many"))
    return cut(goal.join(ended.select(*source, F.col("_bucket").alias("_end")), source, "left").join(last, source, "left").drop("rest"))


def _decided(rows: DataFrame, ends: DataFrame) -> DataFrame:
    """``rows`` (from :func:`keyed`) with ``_source_size, _target, _taken`` from their source's row of :func:`cuts`."""
    ends = ends.withColumnsRenamed({"source_size": "_source_size", "target": "_target"})
    out = joined(rows, ends, ["_s", "_none"], "left", ends.count())
    place, ending = F.struct(*PLACE), F.col("_bucket") == F.col("_end")
    first = (F.col("_bucket") < F.col("_end")) | (ending & (place < F.col("_last")))
    taken = lambda chosen: F.least(F.col("epochs") + F.coalesce(chosen, F.lit(False)).cast("long"), F.lit(2)) * F.col("_size")
    if ends.where("_fit < _many").isEmpty():
        return out.withColumn("_taken", taken(first | (ending & (place == F.col("_last")))))
    among = F.coalesce(ending & (place == F.col("_last")) & (F.col("_fit") < F.col("_many")), F.lit(False))
    whole = out.where(~among).withColumn("_taken", taken(first | (ending & (place == F.col("_last")))))
    # the rows that a budget ends among: numbered within their partition, behind those of the partitions before
    some = stored(out.where(among).withColumn("_at", F.monotonically_increasing_id())).withColumn("_part", F.shiftright("_at", 33))
    parts = some.groupBy("_s", "_none", "_part").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(W.partitionBy("_s", "_none").orderBy("_part")) - F.col("n")
    parts = cut(parts.select("_s", "_none", "_part", before.alias("_before")))
    some = joined(some, parts, ["_s", "_none", "_part"], "inner", parts.count())
    number = F.row_number().over(W.partitionBy("_s", "_none", "_part").orderBy("_at")) + F.col("_before")
    some = some.withColumn("_number", number).withColumn("_taken", taken(F.col("_number") <= F.col("_fit")))
    return whole.unionByName(some.drop("_at", "_part", "_before", "_number"))


def mix(documents: DataFrame, seed: str = SEED, **options) -> DataFrame:
    """``doc_id, size, source_size, target, taken`` for every document; reads the texts once."""
    slim = cut(keyed(documents.select("doc_id", "text", "source"), seed).drop("text", "source"))
    found = _decided(slim, cuts(slim, **options))
    return found.select("doc_id", F.col("_size").alias("size"), F.col("_source_size").alias("source_size"), F.col("_target").alias("target"), F.col("_taken").alias("taken"))


def repeated(documents: DataFrame, seed: str = SEED, **options) -> DataFrame:
    """The mix itself: every document, with its own columns, as often as it is taken; those that aren't go."""
    rows = keyed(documents.select("doc_id", "text", "source", F.struct("*").alias("_doc")), seed)
    slim = cut(rows.select("_s", "_none", "_bucket", *PLACE))
    found = _decided(rows, cuts(slim, **options)).where("_taken > 0")
    copies = F.explode(F.sequence(F.lit(1).cast("long"), F.expr("_taken div _size")))
    return found.select("_doc", copies).select("_doc.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE_SQL = r"""
WITH keyed AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
    -ln((('0x' || substr(md5('mix:' || doc_id::VARCHAR), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0)
      / (0.05 + 0.95 * plain * plain) AS k
  FROM (SELECT *, CASE WHEN length(text) > 0 THEN length(translate(text, '!#$%&*|{}[]<>=+_~^@0123456789', '')) / length(text) ELSE 0.0 END AS plain FROM documents)
), sizes AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM keyed GROUP BY source
), weighed AS (
  SELECT *, [3, 1, 2][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS w, 2.0 * source_size AS cap FROM sizes
), levels AS (
  SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(cap::DOUBLE) OVER (ORDER BY cap::DOUBLE / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(w) OVER (ORDER BY cap::DOUBLE / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM weighed
), final AS (
  SELECT arg_min(level, cap::DOUBLE / w) AS level FROM levels WHERE level * w < cap
), goals AS (
  SELECT source, source_size, CASE WHEN cap <= coalesce(final.level * w, cap) THEN cap::DOUBLE ELSE final.level * w END AS target FROM weighed, final
), placed AS (
  SELECT doc_id, size, source_size, target, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS epochs,
    sum(size) OVER (PARTITION BY keyed.source ORDER BY k, doc_id, size ROWS UNBOUNDED PRECEDING) AS through
  FROM keyed JOIN goals ON keyed.source IS NOT DISTINCT FROM goals.source
)
SELECT doc_id, size, source_size, target,
  (least(epochs + CASE WHEN 2 * through - size <= 2 * (target - epochs * source_size) THEN 1 ELSE 0 END, 2) * size)::BIGINT AS taken
FROM placed
"""
