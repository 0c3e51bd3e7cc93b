"""Registration of runnable queries, each with its reference SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.times import iso_utc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return register


def iso(name: str) -> Column:
    """Output form of an instant: ISO text in UTC."""
    return iso_utc(F.col(name)).alias(name)


def r6(name: str) -> Column:
    """Output form of a derived number: six decimals, no negative zero."""
    return (F.round(F.col(name), 6) + 0.0).alias(name)


def sql_iso(expr: str, alias: str | None = None) -> str:
    text = (f"(strftime({expr}, '%Y-%m-%dT%H:%M:%S') || CASE WHEN epoch_us({expr}) % 1000000 <> 0 "
            f"THEN strftime({expr}, '.%f') ELSE '' END || '+00:00')")
    return f"{text} AS {alias}" if alias else text


def sql_r6(expr: str, alias: str) -> str:
    return f"(round({expr}, 6) + 0.0) AS {alias}"
