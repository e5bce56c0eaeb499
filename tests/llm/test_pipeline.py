from __future__ import annotations

import hashlib

import pyarrow.parquet as pq

import __spark_entry__ as entry
import corpus_pipeline
from helpers import awkward, documents, prose
from ledgerloom.llm import bpe, language_id, secret_scan
from ledgerloom.llm.queries import MODULES
from test_simhash import plain_kept
from test_source_mix import plain_mix


def corpus(spark, path):
    rows = [(k, prose(["en", "de", "fr"][k % 3], 30 + k % 20, k), ["en", "de", "fr"][k % 3] if k % 11 else None, f"s{k % 4}" if k % 7 else None) for k in range(120)]
    rows += [(200 + k, rows[k][1], "en", "s1") for k in range(0, 30, 3)]  # copies
    rows += [(300, f"{prose('en', 30, 500)} password=hunter2hunter2 end", "en", "s2"), (301, "12 34 !!", "en", "s0"), (302, None, "en", "s0"), (303, "", None, None)]
    documents(spark, rows).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{path}/documents.parquet")
    return rows


def test_stages_match_a_plain_pipeline(spark, tmp_path):
    rows = corpus(spark, tmp_path)
    kept = [r for r in rows if any(c.isalpha() for c in r[1] or "")]
    stay = plain_kept(kept)
    assert len(stay) < len(kept)
    kept = [r for r in kept if r[0] in stay]
    model = secret_scan.field()
    kept = [(i, secret_scan.redacted(t, secret_scan.scan(t, model)[1]), lang, s) for i, t, lang, s in kept]
    assert any("[assign]" in t for _, t, _, _ in kept)
    taken = {i: (size, n) for i, size, _, _, n in plain_mix(kept)}
    want = []
    for i, t, _, _ in kept:
        size, n = taken[i]
        ids = bpe.encode(t, bpe.public_tokenizers.path(bpe.RANKS), bpe.public_tokenizers.PATTERN)
        want += [(i, len(ids), hashlib.sha256(t.encode()).hexdigest())] * (n // size)
    found = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted((r["doc_id"], r["n_tokens"], r["decoded_sha256"]) for r in found) == sorted(want)


def test_stages_keep_the_columns(spark, tmp_path):
    corpus(spark, tmp_path)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    names, n = docs.columns, docs.count()
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        out = spark.read.parquet(f"{tmp_path}/{name}")
        assert out.columns == names
        assert out.count() == {0: n - 3, 2: docs.count()}.get(k, out.count())
        if name == "language_id":
            assert out.where("lang IS NULL").count() == 0
        docs = out
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language_id", "simhash_near_dedup", "secret_scan", "source_mix", "byte_bpe"]


def test_clashing_columns_come_through(spark, tmp_path):
    df, _ = awkward(spark)
    df.write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        assert docs.columns == df.columns
        assert docs.where("size <> 7 OR fp <> 7 OR _row <> 7 OR score <> 0.5 OR _key <> 0.5 OR key <> 'k'").count() == 0
    assert docs.count() > 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).count() == docs.count()


def test_an_empty_table(spark, tmp_path):
    documents(spark, []).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_registered():
    names = entry.queries()
    assert {f"op{k}" for k in range(1, 11)} == {n.split("_")[0] for n in MODULES}
    assert set(MODULES) | {"pipeline"} <= set(names)
    assert "op7_source_mix" in entry.oracle_sql()
    assert language_id.UNKNOWN == "und"


def test_sql_of_operators(spark):
    import duckdb

    con = duckdb.connect()
    for name in ("documents", "pages", "embeddings"):
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('/root/testdata/sf0.001/{name}.parquet')")
    for name, sql in entry.oracle_sql().items():
        if name in MODULES:
            found = entry.queries()[name](spark, "/root/testdata/sf0.001")
            columns = sorted(found.columns)
            relation = con.sql(sql)
            at = [relation.columns.index(c) for c in columns]
            tidy = lambda row: tuple(f"{v:.6f}" if isinstance(v, float) else str(v) for v in row)
            assert sorted(tidy(r) for r in found.select(columns).collect()) == sorted(tidy([row[k] for k in at]) for row in relation.fetchall())


def test_inputs_are_parquet():
    assert pq.read_schema("/root/testdata/sf0.001/documents.parquet").names == ["doc_id", "text", "lang", "source", "n_chars"]
