"""Registered queries on the star-schema tables, each with the SQL that must agree with it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    def register(function: Query) -> Query:
        key = name or function.__name__
        if key in QUERIES:
            raise ValueError(f"Query registered twice: {key}")
        QUERIES[key] = function
        if sql is not None:
            ORACLE[key] = sql
        return function

    return register


def load() -> None:
    """Import every module that registers queries."""
    from marginloom.registry import (  # noqa: F401
        admission,
        audit,
        bundle,
        geography,
        publication,
        records,
        releases,
        synthesis,
    )
