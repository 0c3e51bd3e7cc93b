"""Late, repeated and distinct bars of a stream, counted without losing a row to the watermark."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

PARTS = "window_start timestamp, symbol string, ts timestamp, arrivals bigint, late bigint"


def _window(ts: Column, seconds: int) -> Column:
    size = seconds * 1_000_000
    at = F.unix_micros(ts)
    return F.timestamp_micros(at - F.pmod(at, F.lit(size)))


def arrival_counts(bars: DataFrame, late_after_seconds: int, window_seconds: int) -> DataFrame:
    """Partial counts per (window, symbol, ts) of bars with `symbol`, `ts` and `arrival_ts`.

    A bar is late when it arrived more than `late_after_seconds` after its own time; without an arrival time it is
    not. Bars without `ts` are counted under NULL. The rule looks at the row alone, so it does not depend on micro-batches.
    """
    delay = F.unix_micros("arrival_ts") - F.unix_micros("ts")
    late = F.coalesce((delay > late_after_seconds * 1_000_000).cast("bigint"), F.lit(0).cast("bigint"))
    return bars.groupBy(_window(F.col("ts"), window_seconds).alias("window_start"), "symbol", "ts").agg(
        F.count(F.lit(1)).alias("arrivals"), F.sum(late).alias("late"))


def lateness_report(parts: DataFrame) -> DataFrame:
    """Partial counts of any number of micro-batches -> arrivals, distinct bars, repeats and late arrivals per window and symbol."""
    bars = parts.groupBy("window_start", "symbol", "ts").agg(F.sum("arrivals").alias("arrivals"), F.sum("late").alias("late"))
    return bars.groupBy("window_start", "symbol").agg(
        F.sum("arrivals").alias("arrivals"), F.count(F.lit(1)).alias("bars"),
        (F.sum("arrivals") - F.count(F.lit(1))).alias("repeats"), F.sum("late").alias("late"))


def count_late_stream(bars: DataFrame, path: str, run_id: str, checkpoint: str, late_after_seconds: int = 600,
                      window_seconds: int = 300) -> DataStreamWriter:
    """Store the partial counts of every micro-batch; `read_parts` and `lateness_report` give the totals.

    A replayed micro-batch replaces its own folder, so nothing is counted twice. `run_id` names the checkpoint: a
    stream that starts anew needs a new one, since its micro-batches are numbered from 0 again.
    """
    if not run_id:
        raise ValueError("a run id is required")

    def write(batch: DataFrame, number: int) -> None:
        counts = arrival_counts(batch, late_after_seconds, window_seconds)
        counts.write.mode("overwrite").parquet(f"{path}/run_id={run_id}/batch={number}")

    return bars.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


def read_parts(spark, path: str) -> DataFrame:
    """Partial counts of all runs under a path."""
    return spark.read.schema(PARTS + ", run_id string, batch bigint").parquet(path)
