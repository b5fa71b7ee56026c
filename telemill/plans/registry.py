"""Registered queries and their SQL oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from telemill.plans.adapters import Tables, oracle_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable:
    """Register a function of Tables under a name; sql may use the views attacks, devices and feeds."""

    def add(f: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        QUERIES[name] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql:
            body = sql.strip()
            recursive = "RECURSIVE " if body.startswith("WITH RECURSIVE ") else ""
            body = body.removeprefix("WITH ").removeprefix("RECURSIVE ") if body.startswith("WITH ") else f"\0{body}"
            ORACLES[name] = f"WITH {recursive}{oracle_views()}, {body}".replace(", \0", " ")
        return f

    return add
