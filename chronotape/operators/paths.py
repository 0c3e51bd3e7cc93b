"""Sessions as ordered arrays with running extremes, searched per entry instead of paired with it.

A session's bars and entries meet once, in one row. The highs and the negated lows get a sparse table: level L holds, at
place i, the extreme of the 2^L bars from i on. "First bar that reaches a level" and "extreme between two bars" then take
a step per level, so an entry costs some dozens of look-ups whatever its horizon, and no (entry, bar) row exists.
A session is bounded by the calendar (at most one bar per unit), so its row is, too.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bars import SESSION
from .slices import count_while, steps_for

#: Longest session in bars that the halving searches allow for (one bar a minute for eleven days).
MAX_SESSION_BARS = (1 << 14) - 1


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with `value` computed once."""
    return F.get(F.transform(F.array(value), body), 0)


def with_session_arrays(entries: DataFrame, bars: DataFrame, fields: Sequence[str]) -> DataFrame:
    """One row per session with entries: _bars (u, t, high, fall, close; by time) and _entries (`fields` as structs).

    The close is NULL where `bars` has none.
    """
    close = F.col("close") if "close" in bars.columns else F.lit(None)
    bar = F.struct(F.unix_micros("ts").alias("u"), F.col("ts").alias("t"), F.col("high").cast("double").alias("high"),
                   (-F.col("low").cast("double")).alias("fall"), close.cast("double").alias("close"))
    rows = bars.select(*SESSION, bar.alias("_bar")).unionByName(
        entries.select(*SESSION, F.struct(*fields).alias("_entry")), allowMissingColumns=True)
    grouped = rows.groupBy(*SESSION).agg(F.array_sort(F.collect_list("_bar")).alias("_bars"),
                                         F.collect_set("_entry").alias("_entries"))
    return grouped.where((F.size("_entries") > 0) & (F.size("_bars") > 0))


def bars_until(bars: Column, micros: Column, *, inclusive: bool = True) -> Column:
    """Number of bars up to (or before) an instant."""
    steps = steps_for(MAX_SESSION_BARS)
    return count_while(bars, (lambda b: b["u"] <= micros) if inclusive else (lambda b: b["u"] < micros), steps)


def sparse_table(values: Column, reach: int) -> Column:
    """Array of (size, best), longest windows first, for windows of up to `reach` values."""
    def grow(table: Column, size: Column) -> Column:
        last = F.element_at(table, 1)
        # A window that passes the end holds what is left.
        wider = F.transform(last["best"], lambda x, i: F.greatest(x, F.get(last["best"], i + last["size"])))
        return F.concat(F.array(F.struct(size.alias("size"), wider.alias("best"))), table)
    sizes = [1 << i for i in range(1, max(1, reach).bit_length())]
    start = F.array(F.struct(F.lit(1).alias("size"), values.alias("best")))
    return F.aggregate(F.array(*map(F.lit, sizes)), start, grow) if sizes else start


def first_reaching(table: Column, start: Column, end: Column, misses: Callable[[Column], Column]) -> Column:
    """Place of the first value in [start, end) for which `misses` is false, or `end`; misses must be monotone."""
    return F.aggregate(table, start, lambda at, level: F.when(
        (at + level["size"] <= end) & misses(F.get(level["best"], at)), at + level["size"]).otherwise(at))


def extreme_between(table: Column, start: Column, end: Column) -> Column:
    """Largest value in [start, end), which must not be empty: two windows of one level that cover it."""
    return let(F.get(F.filter(table, lambda level: level["size"] <= end - start), 0), lambda level: F.greatest(
        F.get(level["best"], start), F.get(level["best"], end - level["size"])))
