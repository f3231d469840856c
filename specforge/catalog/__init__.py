"""Registered queries: name -> (Spark query, oracle SQL or None)."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from specforge.catalog.data import DERIVED, Tables, cte

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
OPERATORS: dict[str, str] = {}


def with_ctes(sql: str, ctes: dict[str, str] | None = None) -> str:
    """Prefix the derived tables that the text names."""
    own = dict(ctes or {})
    whole = " ".join([*own.values(), sql])
    parts = [cte(n) for n in DERIVED if re.search(rf"\b{n}\b", whole)]
    parts += [f"{n} AS ({body})" for n, body in own.items()]
    return ("WITH " + ", ".join(parts) + " " if parts else "") + sql


def query(name: str, operators: str, sql: str | None = None,
          ctes: dict[str, str] | None = None):
    """Register a function of `Tables` under a name."""
    def register(fn: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(name)
        QUERIES[name] = lambda spark, folder: fn(Tables(spark, folder))
        OPERATORS[name] = operators
        if sql is not None:
            ORACLES[name] = with_ctes(sql, ctes)
        return fn
    return register


def load() -> None:
    from importlib import import_module
    for part in ("scalars", "texts", "extraction", "relations", "reports", "sourcing"):
        import_module(f"specforge.catalog.{part}")
