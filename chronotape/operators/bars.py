"""Minute bars: session marks, entry sampling, resampling and point-in-time ATR.

A session (symbol, session) holds at most one bar per unit, so it is bounded by the
calendar (1,440 minute bars a day) and is the natural unit of parallel work.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions.rules import linear_spread
from ..functions.times import EXCHANGE_ZONE, RTH_CLOSE, RTH_OPEN, local_seconds, local_time, seconds_of

SESSION = ["symbol", "session"]


@dataclass(frozen=True)
class BarClock:
    """Durations in bars. `unit_seconds` is the bar length; the defaults are minute bars."""
    unit_seconds: int = 60
    atr_period: int = 14
    atr_bars: int = 5
    entry_every: int = 5

    @property
    def bucket_seconds(self) -> int:
        return self.unit_seconds * self.atr_bars


MINUTE = BarClock()


def mark_session(bars: DataFrame, zone: str = EXCHANGE_ZONE) -> DataFrame:
    """Add `rth` (09:30 <= local time < 16:00) and `session_close` to minute bars."""
    clock = local_seconds(F.col("ts"), zone)
    day = F.date_trunc("day", local_time(F.col("ts"), zone))
    close = F.to_utc_timestamp(day + F.make_dt_interval(secs=F.lit(seconds_of(RTH_CLOSE))), zone)
    return bars.withColumns({
        "rth": (clock >= seconds_of(RTH_OPEN)) & (clock < seconds_of(RTH_CLOSE)),
        "session_close": close,
    })


def with_spread(bars: DataFrame, model=linear_spread) -> DataFrame:
    """Derive bid/ask around the close from a spread model (a Column -> Column function)."""
    half = model(F.col("close")) / 2.0
    return bars.withColumns({"bid": F.col("close") - half, "ask": F.col("close") + half})


def in_order() -> WindowSpec:
    return Window.partitionBy(*SESSION).orderBy("ts")


def sample_entries(bars: DataFrame, clock: BarClock = MINUTE) -> DataFrame:
    """Every Nth regular-hours bar by position in its session."""
    rows = bars.where("rth").withColumn("_n", F.row_number().over(in_order()))
    return rows.where((F.col("_n") - 1) % clock.entry_every == 0).drop("_n")


def bucket_end(ts: Column, width: int) -> Column:
    """Right edge of the right-closed bucket that holds `ts`."""
    return F.timestamp_seconds(F.ceil(F.unix_micros(ts) / F.lit(width * 1_000_000)) * width)


def resample(bars: DataFrame, clock: BarClock = MINUTE) -> DataFrame:
    """Right-closed, right-labelled OHLC buckets; empty buckets do not exist.

    `open_high` / `open_low` leave out a bar exactly on the right edge: that is the bucket
    as seen by an entry on the edge, which may only use bars strictly before itself.
    """
    rows = bars.withColumn("bucket_end", bucket_end(F.col("ts"), clock.bucket_seconds))
    before_edge = F.col("ts") < F.col("bucket_end")
    return rows.groupBy(*SESSION, "bucket_end").agg(
        F.min_by("open", "ts").alias("open"),
        F.max("high").alias("high"), F.min("low").alias("low"),
        F.max_by("close", "ts").alias("close"),
        F.max(F.when(before_edge, F.col("high"))).alias("open_high"),
        F.min(F.when(before_edge, F.col("low"))).alias("open_low"),
    )


def _true_range(high: str, low: str) -> Column:
    h, l, pc = F.col(high), F.col(low), F.coalesce(F.col("_pc"), F.col("close"))
    return F.greatest(h - l, F.abs(h - pc), F.abs(l - pc))


def _wilder_buckets(bars: DataFrame, clock: BarClock) -> DataFrame:
    """One row per bucket: (symbol, session, bucket_end, full, before, edge).

    Wilder smoothing is a recursion, so the (few) buckets of a session are folded in order
    into the array of running values. `full` uses the whole bucket, `edge` the bucket without
    a bar on its right edge, `before` is the value at the preceding bucket. Values are NULL
    until `atr_period` ranges exist. All steps keep the (symbol, session) layout.
    """
    p = clock.atr_period
    w = Window.partitionBy(*SESSION).orderBy("bucket_end")
    ranges = resample(bars, clock).withColumn("_pc", F.lag("close").over(w)).select(
        *SESSION, "bucket_end", _true_range("high", "low").alias("tr"),
        F.when(F.col("open_high").isNotNull(), _true_range("open_high", "open_low")).alias("tr_edge"))
    ordered = ranges.groupBy(*SESSION).agg(
        F.sort_array(F.collect_list(F.struct("bucket_end", "tr", "tr_edge"))).alias("_b"))

    def step(prev: Column, n: Column, tr: Column) -> Column:
        """Value at bucket `n` (from 1): sum while warming up, then the smoothed range."""
        return (F.when(n == 1, F.lit(0.0)).when(n < p + 1, prev + tr)
                .when(n == p + 1, (prev + tr) / p).otherwise((prev * (p - 1) + tr) / p))

    nothing = F.expr("cast(array() as array<double>)")
    values = F.aggregate("_b", nothing, lambda acc, b: F.concat(acc, F.array(
        step(F.try_element_at(acc, F.lit(-1)), F.size(acc) + 1, b["tr"]))))
    rows = ordered.select(*SESSION, "_b", values.alias("_s")).select(
        *SESSION, F.posexplode(F.arrays_zip("_b", "_s")).alias("_i", "_x"), "_s").select(
        *SESSION, (F.col("_i") + 1).alias("_n"), F.col("_x")["_b"]["bucket_end"].alias("bucket_end"),
        F.col("_x")["_b"]["tr_edge"].alias("_tr_edge"), F.col("_x")["_s"].alias("_full"),
        F.when(F.col("_i") > 0, F.get("_s", F.col("_i") - 1)).alias("_prev"))
    n = F.col("_n")
    return rows.select(
        *SESSION, "bucket_end", F.when(n >= p + 1, F.col("_full")).alias("full"),
        F.when(n > p + 1, F.col("_prev")).alias("before"),
        F.when(n >= p + 1, step(F.col("_prev"), n, F.col("_tr_edge"))).alias("edge"))


def wilder_atr(bars: DataFrame, clock: BarClock = MINUTE) -> DataFrame:
    """ATR after each bucket: (symbol, session, bucket_end, atr)."""
    return _wilder_buckets(bars, clock).where(F.col("full").isNotNull()).select(
        *SESSION, "bucket_end", F.col("full").alias("atr"))


def atr_at(entries: DataFrame, bars: DataFrame, clock: BarClock = MINUTE) -> DataFrame:
    """Add `atr` to entries (which are bars): strictly earlier bars only, NULL if unknown or not positive.

    An entry on a bucket edge sees its bucket without itself, or the bucket before when it is
    alone in it; any other entry sees the bucket before its own. Its own bucket always
    exists, so the lookup is an equality join.
    """
    buckets = _wilder_buckets(bars, clock).select(*SESSION, "bucket_end", "before", "edge")
    keyed = entries.withColumn("bucket_end", bucket_end(F.col("ts"), clock.bucket_seconds))
    on_edge = F.col("bucket_end") == F.col("ts")
    value = F.when(on_edge, F.coalesce("edge", "before")).otherwise(F.col("before"))
    joined = keyed.join(buckets, [*SESSION, "bucket_end"], "left").withColumn("_a", value)
    return joined.select(*entries.columns, F.when(F.col("_a") > 0, F.col("_a")).alias("atr"))
