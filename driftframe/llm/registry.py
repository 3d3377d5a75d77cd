"""The queries of this subpackage and their SQL."""

from __future__ import annotations

import importlib

#: Query, its module, its SQL there if DuckDB can express it.
QUERIES = {
    "op1_simhash": ("simhash", None),
    "op2_pieces": ("pieces", None),
    "op3_exact_topk": ("pivots", "OP3_SQL"),
    "op4_substrings": ("substrings", "OP4_SQL"),
    "op5_toxicity": ("toxicity", None),
    "op6_urls": ("urls", "OP6_SQL"),
    "op7_mixing": ("mixing", None),
    "op8_warc": ("warc", "OP8_SQL"),
    "op9_neighbours": ("collisions", None),
    "op10_hilbert_shards": ("sharding", None),
}


def queries() -> dict:
    return {name: getattr(importlib.import_module(f"driftframe.llm.{module}"), name) for name, (module, _) in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: getattr(importlib.import_module(f"driftframe.llm.{module}"), sql) for name, (module, sql) in QUERIES.items() if sql}
