"""Registry of runnable queries and the SQL each result can be checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from helpweave.sources.fixtures import derived_sql

QueryFn = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, QueryFn] = {}
ORACLES: dict[str, str] = {}


def with_tables(body: str, *names: str, extra: str = "") -> str:
    """Prefix ``body`` with the derived tables it reads and any further CTEs."""
    ctes = [f"{n} AS MATERIALIZED ({derived_sql(n)})" for n in names]
    if extra:
        ctes.append(extra.strip().rstrip(","))
    return ("WITH " + ",\n".join(ctes) + "\n" if ctes else "") + body


def query(name: str, sql: str | None = None) -> Callable[[QueryFn], QueryFn]:
    def register(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register
