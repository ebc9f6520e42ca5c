"""Registry that pairs each Spark query with the SQL that must give the same rows."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType

from ..sources.fact import Warehouse

DIGITS = 4
# Added before rounding so that exact decimal ties fall the same way in both engines.
NUDGE = 0.00000137
_QUERIES: dict[str, Callable] = {}
_SQL: dict[str, str] = {}
_CTES: dict[str, str] = {}


def cte(name: str, text: str) -> None:
    """Register a named sub-select that query texts can use by name."""
    _CTES[name] = text


@lru_cache(maxsize=None)
def _uses(name: str) -> tuple[str, ...]:
    return _names(_CTES[name], skip=name)


def _names(text: str, skip: str = "") -> tuple[str, ...]:
    words = set(re.findall(r"[a-z_][a-z0-9_]*", text))
    return tuple(n for n in _CTES if n in words and n != skip)


def _with(body: str) -> str:
    order: list[str] = []

    def visit(n: str) -> None:
        for m in _uses(n):
            visit(m)
        if n not in order:
            order.append(n)

    for n in _names(body):
        visit(n)
    return "WITH " + ",\n".join(f"{n} AS ({_CTES[n]})" for n in order) + "\n" if order else ""


def query(name: str, sql: str | None = None, doubles: str = "", ctes: dict[str, str] | None = None):
    """Register `fn(warehouse) -> DataFrame`. Doubles are rounded on both sides to DIGITS places."""

    def wrap(fn: Callable[[Warehouse], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            df = fn(Warehouse(spark, sf_dir))
            return df.select(
                *[
                    F.round(F.col(f"`{f.name}`").cast("double") + NUDGE, DIGITS).alias(f.name)
                    if isinstance(f.dataType, (DoubleType, FloatType))
                    else F.col(f"`{f.name}`")
                    for f in df.schema.fields
                ]
            )

        _QUERIES[name] = run
        if sql is not None:
            _SQL[name] = (sql, doubles)
        return fn

    return wrap


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    out = {}
    for name, (body, doubles) in _SQL.items():
        rounded = ", ".join(f"round(CAST({d} AS DOUBLE) + {NUDGE:.8f}, {DIGITS}) + 0.0 AS {d}" for d in doubles.split())
        out[name] = f"{_with(body)}SELECT * {f'REPLACE ({rounded}) ' if rounded else ''}FROM ({body})"
    return out
