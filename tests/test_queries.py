"""Every query of the core against its SQL, over the smallest tables."""

from __future__ import annotations

import glob
import math

import duckdb
import pytest

import __spark_entry__ as entry
from ledgerloom import io_queries, queries

QUERIES, ORACLES = queries.QUERIES | io_queries.QUERIES, queries.ORACLES | io_queries.ORACLES
DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for path in glob.glob(f"{DATA}/*.parquet"):
        con.sql(f"CREATE VIEW {path.rsplit('/', 1)[1][:-8]} AS SELECT * FROM read_parquet('{path}')")
    return con


def plain(rows):
    tidy = lambda v: ("nan" if math.isnan(v) else round(v, 6)) if isinstance(v, float) else v
    return sorted((tuple(str(tidy(v)) for v in row) for row in rows))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, tables, name):
    found = QUERIES[name](spark, DATA)
    relation = tables.sql(ORACLES[name])
    names = sorted(found.columns)
    assert names == sorted(relation.columns)
    at = [relation.columns.index(c) for c in names]
    want = plain(tuple(row[k] for k in at) for row in relation.fetchall())
    assert plain(found.select(names).collect()) == want


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)
    assert set(ORACLES) <= set(entry.oracle_sql())
    assert set(QUERIES) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
