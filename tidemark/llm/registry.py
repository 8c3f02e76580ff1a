"""Queries of the training-data operators and their DuckDB SQL."""

from __future__ import annotations

import importlib

#: One module per operator with ``QUERIES`` and ``ORACLE_SQL``.
MODULES = (
    "q01_packing",
    "q02_toxicity",
    "q03_media",
    "q04_simhash",
    "q05_html",
    "q06_licenses",
    "q07_warc",
    "q08_mixing",
    "q09_exact",
    "q10_sharding",
)


def _modules():
    return [importlib.import_module(f"tidemark.llm.{m}") for m in MODULES]


def queries():
    return {name: f for m in _modules() for name, f in m.QUERIES.items()}


def oracle_sql():
    return {name: sql for m in _modules() for name, sql in m.ORACLE_SQL.items()}
