"""Typed readers. Column and partition filters reach the scan; nothing is inferred."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas as S
from ..functions.rules import linear_spread
from ..functions.times import EXCHANGE_ZONE, local_date
from ..operators.bars import with_spread


def _range(df: DataFrame, symbols: list[str] | None, start: str | None, end: str | None) -> DataFrame:
    if start is not None:
        df = df.where(F.col("session") >= start)
    if end is not None:
        df = df.where(F.col("session") <= end)
    if symbols is not None:
        df = df.where(F.col("symbol").isin(symbols))
    return df


def _typed(spark: SparkSession, path: str, ddl: str, form: str) -> DataFrame:
    return spark.read.schema(ddl).format(form).load(path)


def read_bars(spark: SparkSession, path: str, symbols: list[str] | None = None, start: str | None = None,
              end: str | None = None, form: str = "parquet") -> DataFrame:
    """Minute bars including the pre-market part; partitioned by `session` when written by `write_sessions`."""
    return _range(_typed(spark, path, S.BARS, form), symbols, start, end)


def read_quotes(spark, path, symbols=None, start=None, end=None, form="parquet") -> DataFrame:
    return _range(_typed(spark, path, S.QUOTES, form), symbols, start, end)


def read_trades(spark, path, symbols=None, start=None, end=None, form="parquet") -> DataFrame:
    return _range(_typed(spark, path, S.TRADES, form), symbols, start, end)


def read_raw_news(spark, path, start_utc: str | None = None, end_utc: str | None = None, form="parquet") -> DataFrame:
    """Raw news of a UTC range, both ends included, by availability."""
    df = _typed(spark, path, S.RAW_NEWS, form)
    if start_utc is not None:
        df = df.where(F.col("news_available_ts") >= F.lit(start_utc).cast("timestamp"))
    if end_utc is not None:
        df = df.where(F.col("news_available_ts") <= F.lit(end_utc).cast("timestamp"))
    return df


def read_articles(spark, path, start_utc=None, end_utc=None, form="parquet") -> DataFrame:
    df = _typed(spark, path, S.ARTICLES, form)
    if start_utc is not None:
        df = df.where(F.col("available_ts") >= F.lit(start_utc).cast("timestamp"))
    if end_utc is not None:
        df = df.where(F.col("available_ts") <= F.lit(end_utc).cast("timestamp"))
    return df


def read_reference(spark: SparkSession, path: str, kind: str, form: str = "parquet") -> DataFrame:
    """Reference records by kind: symbol refreshes, regimes, setups, universes, scanners, quality, news, halts."""
    shapes = {
        "symbols": S.SYMBOL_REFRESHES, "regimes": S.REGIMES, "setups": S.SETUPS, "universes": S.UNIVERSES,
        "scanners": S.SCANNERS, "quality": S.DATA_QUALITY, "news": S.NEWS, "halts": S.HALTS, "feeds": S.FEEDS,
        "short_interest": S.SHORT_INTEREST, "burned": S.BURNED,
    }
    return _typed(spark, path, shapes[kind], form)


def read_vendor_aggregates(spark: SparkSession, path: str, zone: str = EXCHANGE_ZONE, spread=linear_spread) -> DataFrame:
    """Vendor aggregate JSON (ticker, results[o,h,l,c,v,t in epoch ms]) as bars with a modelled spread."""
    ddl = "ticker string, results array<struct<o:double,h:double,l:double,c:double,v:double,t:bigint>>"
    raw = spark.read.schema(ddl).json(path)
    rows = raw.select(F.col("ticker").alias("symbol"), F.posexplode("results").alias("seq", "r"))
    ts = F.timestamp_millis(F.col("r")["t"])
    bars = rows.select(
        "symbol", local_date(ts, zone).cast("string").alias("session"), F.col("seq").cast("bigint").alias("seq"),
        ts.alias("ts"), F.col("r")["o"].alias("open"), F.col("r")["h"].alias("high"), F.col("r")["l"].alias("low"),
        F.col("r")["c"].alias("close"), F.col("r")["v"].cast("bigint").alias("volume"))
    return with_spread(bars, spread)


def write_sessions(df: DataFrame, path: str) -> None:
    """Append rows laid out by session, so that date filters prune files.

    Rows are spread over (session, symbol) first: a session writes several files by symbol,
    each file sorted, and a day holding most rows is not one task.
    """
    (df.repartition("session", "symbol").sortWithinPartitions("session", "symbol", "seq")
     .write.mode("append").partitionBy("session").parquet(path))


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)
