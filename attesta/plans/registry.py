"""Every named query of the library with the SQL that checks it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

MODULES = ("cohort_queries", "statistics_queries", "corpus_queries", "state_queries", "document_queries", "record_queries", "ledger_queries", "tex_queries", "validate_queries", "lineage_queries", "schema_queries", "resolve_queries", "markup_queries")

_QUERIES: dict[str, Query] = {}
_ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a function (spark, sf_dir) -> DataFrame, and the DuckDB SQL with the same rows if there is one."""

    def keep(f: Query) -> Query:
        if name in _QUERIES:
            raise ValueError(f"two queries named {name}")
        _QUERIES[name] = f
        if sql is not None:
            _ORACLES[name] = sql
        return f

    return keep


def _load() -> None:
    """Import the modules whose queries register themselves."""
    import importlib

    for name in MODULES:
        importlib.import_module(f"attesta.plans.{name}")


def queries() -> dict[str, Query]:
    _load()
    return dict(_QUERIES)


def oracles() -> dict[str, str]:
    _load()
    return dict(_ORACLES)


def FLAGSHIP(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queries()["venue_summary"](spark, sf_dir)
