"""Registry of named queries and their DuckDB twins.

Each query is a function ``(spark, sf_dir) -> DataFrame``; the optional SQL
twin runs on DuckDB views with the driver table names.
"""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def load_all() -> None:
    # importing the modules fills the registry
    from . import (eval_queries, example_queries, io_queries, similarity_queries,  # noqa: F401
                   sparse_queries, stream_queries, text_queries, train_queries,
                   vocab_queries, word_queries, infer_queries)
