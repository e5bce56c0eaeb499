from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import common


def plain(edges):
    root = {}

    def find(k):
        root.setdefault(k, k)
        while root[k] != k:
            k = root[k]
        return k

    for a, b in edges:
        x, y = find(a), find(b)
        if x != y:
            root[max(x, y)] = min(x, y)
    return {k: find(k) for k in root}


@pytest.mark.parametrize("seed", range(3))
def test_components(spark, seed):
    rnd = random.Random(seed)
    edges = [(rnd.randrange(400), rnd.randrange(400)) for _ in range(220)]
    edges += [(1000 + k, 1001 + k) for k in range(60)] + [(2000, 2000 + k) for k in range(1, 50)] + [(5, 5)]
    rnd.shuffle(edges)
    found = {r["id"]: r["root"] for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == plain([e for e in edges if e[0] != e[1]])


def test_no_components(spark):
    assert common.components(spark.createDataFrame([], "a long, b long")).count() == 0
    assert common.components(spark.createDataFrame([(1, 1)], "a long, b long")).count() == 0


def test_split_hot_lets_every_pair_meet_once(spark):
    rows = spark.range(60).select(F.when(F.col("id") < 40, 1).otherwise(F.col("id")).alias("key"), "id")
    parts = common.split_hot(rows, "key", "id", 9).collect()
    met = {}
    for a in parts:
        for b in parts:
            if a["key"] == b["key"] and a["part"] == b["part"] and a["id"] < b["id"] and (a["chunk"] == b["chunk"]) == a["inner"]:
                met[a["id"], b["id"]] = met.get((a["id"], b["id"]), 0) + 1
    assert met == {(a, b): 1 for b in range(40) for a in range(b)}


def test_groups_over_batch_borders():
    import pyarrow as pa

    keys = [1, 1, 2, 3, 3, 3, 3, 3, 4, 5, 5]
    for size in range(1, 12):
        batches = [pa.RecordBatch.from_pydict({"k": keys[a : a + size], "v": list(range(a, min(a + size, 11)))}) for a in range(0, 11, size)]
        found = []
        for table, at in common.groups(iter(batches), ["k"]):
            found += [table.column("v").to_pylist()[a:b] for a, b in zip(at, at[1:], strict=False)]
        assert found == [[0, 1], [3, 4, 5, 6, 7], [9, 10]]
    assert list(common.groups(iter([]), ["k"])) == []


def test_hash_sample(spark):
    rows = spark.range(5000).select(F.col("id").alias("doc_id"), (F.col("id") % 3 == 0).cast("int").alias("by"))
    found = common.hash_sample(rows, "by", "doc_id", 100)
    assert [r["count"] for r in found.groupBy("by").count().collect()] == [100, 100]
    again = common.hash_sample(rows.repartition(5), "by", "doc_id", 100)
    assert sorted(r["doc_id"] for r in found.collect()) == sorted(r["doc_id"] for r in again.collect())
    assert common.hash_sample(rows.limit(7), "by", "doc_id", 100).count() == 7


def test_shared_dir(spark):
    assert common.shared_dir(spark)
    assert spark.sparkContext.getCheckpointDir()


def test_estimated_sizes_do_not_grow_with_the_steps_of_a_loop(spark):
    chain = spark.range(300).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    found = common.components(chain)
    assert found._jdf.queryExecution().optimizedPlan().stats().sizeInBytes() < 1 << 256
    again = common.components(found.select(F.col("id").alias("a"), F.col("root").alias("b")))
    assert again._jdf.queryExecution().optimizedPlan().stats().sizeInBytes() < 1 << 256
    assert {r["root"] for r in again.collect()} == {0}
