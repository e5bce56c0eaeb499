"""The rules on streams. Categorising is row-local, so a stream needs no state; sums by window keep what watermarks allow."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ledgerloom.operators.categorise import categorise
from ledgerloom.plans.rules import Rule

LEDGER = T.StructType(
    [T.StructField("_row_id", T.LongType()), T.StructField("date", T.TimestampType()), T.StructField("counterparty", T.StringType()), T.StructField("amount", T.DoubleType()), T.StructField("memo", T.StringType())]
)


def read_ledger(spark: SparkSession, path: str, schema: T.StructType = LEDGER, files_per_batch: int = 100) -> DataFrame:
    """A folder of Parquet files as a stream; rows are known by a key of their own, as a stream has no row numbers."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def categorised(stream: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """The stream with the rules applied and the last rule that fired, exactly as :func:`categorise` does for a table."""
    return categorise(stream, rules, attribution=True)


def totals(stream: DataFrame, rules: Sequence[Rule], window: str = "1 day", late: str = "2 days") -> DataFrame:
    """Rows and amounts by window of ``date`` and category; rows later than ``late`` are left out."""
    out = categorised(stream.withWatermark("date", late), rules)
    sums = out.groupBy(F.window("date", window).alias("w"), "category").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("amount").cast("decimal(38,4)")).alias("total"))
    return sums.select(F.col("w.start").alias("start"), "category", "n", "total")


def write(stream: DataFrame, path: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Starts writing the stream as Parquet, exactly once, from where ``checkpoint`` left off."""
    writer = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def each_batch(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Starts handing each batch to ``sink`` with its number, by which a sink can drop what it already has."""
    return stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
