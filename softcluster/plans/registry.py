"""Registry of named queries: Spark callable + optional DuckDB oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, Callable[[], str]] = {}


def query(name: str, oracle: Callable[[], str] | None = None):
    def deco(fn):
        if name in QUERIES:
            raise KeyError(f"duplicate query {name}")
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn
    return deco


def load_all() -> None:
    # Importing the modules registers their queries.
    from . import (bisect_queries, fuzzy_queries, gmm_queries, kmeans_queries,  # noqa: F401
                   lda_queries,
                   pic_queries, sparse_queries,
                   stream_queries)
