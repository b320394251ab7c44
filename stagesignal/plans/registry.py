"""All registered queries of the library and the SQL they are held against."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}
MODULES = ("decisions", "profiles", "texts", "candidates", "events", "files")


def _counted(sql: str) -> str:
    """DuckDB's count_if gives a huge integer; Spark's a long."""
    out, at = "", 0
    while (k := sql.find("count_if(", at)) >= 0:
        depth, end = 1, k + len("count_if(")
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[end], 0)
            end += 1
        out, at = f"{out}{sql[at:k]}CAST({sql[k:end]} AS BIGINT)", end
    return out + sql[at:]


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under its own name, with the SQL that must give the same rows."""

    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql is not None:
            _SQL[f.__name__] = _counted(sql)
        return f

    return add


def _load() -> None:
    for name in MODULES:
        importlib.import_module(f"stagesignal.plans.{name}")


def queries() -> dict[str, Query]:
    _load()
    return dict(sorted(_QUERIES.items()))


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(sorted(_SQL.items()))
