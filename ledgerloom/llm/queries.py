"""The queries of this subpackage by name, and SQL for those that SQL can express."""

from __future__ import annotations

from importlib import import_module

#: Query name and the module here whose ``query(spark, sf_dir)`` it is; ``ORACLE_SQL`` there, if any, is its SQL.
MODULES = {
    "op1_language_id": "language_id",
    "op2_simhash_near_dedup": "simhash",
    "op3_secret_scan": "secret_scan",
    "op4_byte_bpe": "bpe",
    "op5_token_counts": "token_counts",
    "op6_topk_search": "topk_search",
    "op7_source_mix": "source_mix",
    "op8_quality": "quality",
    "op9_embedding_near_dedup": "embedding_dedup",
    "op10_warc": "warc",
}


def _module(name: str):
    return import_module(f"ledgerloom.llm.{name}")


def queries() -> dict:
    return {name: _module(module).query for name, module in MODULES.items()}


def oracle_sql() -> dict[str, str]:
    found = {name: getattr(_module(module), "ORACLE_SQL", None) for name, module in MODULES.items()}
    return {name: sql for name, sql in found.items() if sql}
