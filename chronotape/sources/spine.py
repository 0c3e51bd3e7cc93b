"""Batch specs and candidate generation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import batch_id
from ..functions.times import EXCHANGE_ZONE

# Default candidate minutes, exchange-local.
DEFAULT_MINUTES = ((10, 0), (11, 0), (14, 30))


def batch_spine(symbols: DataFrame, start: str, end: str, weekdays_only: bool = True) -> DataFrame:
    """One (symbol, session) row per symbol and date, both ends included.

    The spine is the left side of every per-batch report, so empty batches are reported too.
    Dates are generated per symbol row; no join is needed.
    """
    days = F.explode(F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date")))
    out = symbols.select("symbol").distinct().select("symbol", days.alias("_d"))
    if weekdays_only:
        out = out.where(F.weekday("_d") < 5)
    return out.select("symbol", F.col("_d").cast("string").alias("session"))


def year_spine(symbols: DataFrame, rows: DataFrame) -> DataFrame:
    """Spine with calendar years as sessions: every year from the first to the last session of `rows`.

    The ends are one row, read from the data; no rows give an empty spine.
    """
    year = F.col("session").cast("int")
    ends = rows.agg(F.min(year).alias("_a"), F.max(year).alias("_b")).where("_a IS NOT NULL").select(
        F.explode(F.sequence("_a", "_b").cast("array<string>")).alias("session"), F.lit(1).alias("_one"))
    return symbols.select("symbol").distinct().withColumn("_one", F.lit(1)).join(ends, "_one").select("symbol", "session")


def outside_spine(spine: DataFrame, rows: DataFrame) -> DataFrame:
    """Rows per (symbol, session) that no batch of the spine covers: a report over the spine would miss them."""
    found = rows.groupBy("symbol", "session").agg(F.count("*").alias("n"))
    return found.join(spine, ["symbol", "session"], "left_anti")


def last_weekdays(symbols: DataFrame, end: str, n: int) -> DataFrame:
    """The last `n` weekdays up to `end` per symbol."""
    day = F.lit(end).cast("date")
    back = F.sequence(F.date_sub(day, 2 * n + 7), day)
    weekdays = F.filter(back, lambda d: F.weekday(d) < 5)
    kept = F.slice(weekdays, -n, n)
    return symbols.select("symbol").distinct().select("symbol", F.explode(kept).alias("_d")).select(
        "symbol", F.col("_d").cast("string").alias("session"))


def candidates_at(
    spine: DataFrame, minutes: Sequence[tuple[int, int]] = DEFAULT_MINUTES, *, setup_type: str = "GAP_GO",
    scanner_id: str = "SCAN_MOMENTUM", universe_id: str = "SMALL_CAP_US", zone: str = EXCHANGE_ZONE,
) -> DataFrame:
    """One LONG candidate per batch and fixed local minute, without score or rank."""
    clock = F.explode(F.array(*[F.lit(f"{h:02d}:{m:02d}:00") for h, m in minutes]))
    rows = spine.select("symbol", "session", clock.alias("_clock"))
    local = F.concat_ws(" ", "session", "_clock").cast("timestamp")
    return rows.select(
        "symbol", "session", F.to_utc_timestamp(local, zone).alias("signal_ts"), F.lit(setup_type).alias("setup_type"),
        F.lit("LONG").alias("direction"), F.lit(scanner_id).alias("scanner_id"), F.lit(universe_id).alias("universe_id"),
        F.lit(None).cast("double").alias("scanner_score"), F.lit(None).cast("int").alias("scanner_rank"),
        batch_id(F.col("symbol"), F.col("session")).alias("candidate_batch_id"))
