"""Structured Streaming jobs with the semantics of the batch operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from .. import schemas as S
from ..operators.asof import asof_index
from ..operators.news import STORY_WINDOW_SECONDS, link_duplicates
from ..sources import tables as T


# -- bar quality ------------------------------------------------------------------------------
def bar_quality(bars: DataFrame, watermark: str = "10 minutes", window: str = "5 minutes") -> DataFrame:
    """Arrivals, distinct bars and repeats per symbol and window of bar time.

    Bars later than the watermark are dropped by Spark and show up in its progress metrics.
    """
    return (bars.withWatermark("ts", watermark)
            .groupBy(F.window("ts", window), "symbol", "ts").agg(F.count("*").alias("arrivals"))
            .select("window", "symbol", "arrivals", (F.col("arrivals") - 1).alias("repeats")))


def distinct_bars(bars: DataFrame, watermark: str = "10 minutes") -> DataFrame:
    """First arrival of each (symbol, ts); state is bounded by the watermark."""
    return bars.withWatermark("ts", watermark).dropDuplicatesWithinWatermark(["symbol", "ts"])


# -- idempotent appends -----------------------------------------------------------------------
def append_once_stream(rows: DataFrame, path: str, ddl: str, key: list[str], order: list[str], checkpoint: str,
                       partition_by: tuple[str, ...] = ()) -> DataStreamWriter:
    """Write-once sink: a replayed micro-batch finds its keys stored and adds nothing."""
    def write(batch: DataFrame, _epoch: int) -> None:
        T.append_once(batch.sparkSession, batch, path, ddl, key, order, partition_by)

    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


ARCHIVE = ("record_id string, article_id string, vendor string, source string, tickers array<string>, headline_hash string, "
           "publish_ts timestamp, available_ts timestamp, language string, market_session string, "
           "availability_delay_seconds double, content_hash string, seq bigint, duplicate_of string, dup_kind string")


def link_news_stream(records: DataFrame, path: str, checkpoint: str,
                     window_seconds: int = STORY_WINDOW_SECONDS) -> DataStreamWriter:
    """Link each micro-batch against the archive and append it; the archive is the state."""
    columns = [f.name for f in S.struct_of(ARCHIVE).fields]

    def write(batch: DataFrame, _epoch: int) -> None:
        archive = T.read_table(batch.sparkSession, path, ARCHIVE)
        fresh = batch.join(archive.select("record_id"), "record_id", "left_anti")
        T.append(link_duplicates(fresh, archive, window_seconds).select(*columns), path)

    return records.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


# -- as-of enrichment ---------------------------------------------------------------------------
def enrich_as_of(signals: DataFrame, versions: DataFrame, by: list[str], left_ts: str, right_ts: str,
                 columns: list[str], tie: Sequence[str] = ()) -> DataFrame:
    """Stream-static as-of by an index of the static versions: the stream joins on equal keys and slices only."""
    return asof_index(versions, by, right_ts, columns, tie=tie).lookup(signals, left_ts, columns)
