"""Registry of named queries: ``name -> (spark, sf_dir) -> DataFrame`` and, where the result is expressible
in SQL, the equivalent DuckDB SQL text over the same Parquet tables."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def register(name: str, oracle: str | None = None):
    def deco(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn
    return deco


def load_all() -> None:
    """Import every module that registers queries."""
    from . import (q_allowlist, q_crawl, q_citations, q_requests, q_store, q_fetch, q_search,  # noqa: F401
                   q_health, q_service, q_streaming)
