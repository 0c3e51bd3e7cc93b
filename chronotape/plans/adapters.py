"""Views of the given tables in the shape of the engine's own tables.

Shipments of a supplier become daily bars (session = calendar year), user events become
signals, versions, regimes, news, halts and quality records.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.times import instant
from ..operators.bars import BarClock, with_spread
from ..session import configure, cut_lineage

DAY_CLOCK = BarClock(unit_seconds=86_400)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    configure(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# -- bars from shipments --------------------------------------------------------------------
def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One bar per supplier and ship date; January plays the pre-market part of a session."""
    li = table(spark, sf_dir, "lineitem").select(
        "l_suppkey", instant(F.col("l_shipdate")).alias("ts"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"), "l_quantity",
        "l_orderkey", "l_linenumber", "l_partkey")
    # Order keys repeat, so the price itself is the last tie-break.
    ranked = F.struct("l_orderkey", "l_linenumber", "l_partkey", "price")
    daily = li.groupBy("l_suppkey", "ts").agg(
        F.min(ranked)["price"].alias("open"), F.max("price").alias("high"), F.min("price").alias("low"),
        F.max(ranked)["price"].alias("close"), F.sum("l_quantity").cast("bigint").alias("volume"))
    marked = daily.withColumns({
        "symbol": F.concat(F.lit("S"), F.col("l_suppkey")),
        "session": F.year("ts").cast("string"),
        "seq": F.dayofyear("ts").cast("bigint"),
        "rth": F.month("ts") >= 2,
        "session_close": F.make_date(F.year("ts"), F.lit(12), F.lit(31)).cast("timestamp"),
    })
    return with_spread(marked).select(
        "symbol", "session", "seq", "ts", "open", "high", "low", "close", "volume", "bid", "ask",
        "rth", "session_close")


def micros(rows: DataFrame, names: list[str]) -> DataFrame:
    """Add `<name>_u`: the value in millionths as a whole number, a form that every engine renders alike."""
    return rows.withColumns({f"{n}_u": F.round(F.col(n) * 1_000_000).cast("bigint") for n in names})


def stored_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bars written once, for plans that read them several times (a real bar table is stored)."""
    return cut_lineage(bars(spark, sf_dir))


def sql_years(symbols: str, day: str, source: str) -> str:
    """Spine of all symbols and of every year between the ends of a table."""
    return (f"spine AS (SELECT symbol, CAST(y AS VARCHAR) AS session FROM ({symbols}), (SELECT unnest(generate_series(min(year({day})), "
            f"max(year({day})))) AS y FROM {source}))")


SQL_BARS = """
bars AS (
  SELECT 'S' || l_suppkey AS symbol, strftime(l_shipdate, '%Y') AS session, l_shipdate AS ts,
         CAST(dayofyear(l_shipdate) AS BIGINT) AS seq,
         first(l_extendedprice / l_quantity ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice / l_quantity) AS open,
         max(l_extendedprice / l_quantity) AS high, min(l_extendedprice / l_quantity) AS low,
         last(l_extendedprice / l_quantity ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice / l_quantity) AS close,
         CAST(sum(l_quantity) AS BIGINT) AS volume,
         month(l_shipdate) >= 2 AS rth,
         make_timestamp(year(l_shipdate), 12, 31, 0, 0, 0.0) AS session_close
  FROM lineitem GROUP BY l_suppkey, l_shipdate),
quoted AS (
  SELECT *, close - greatest(close * 0.0008 + 0.01, 0.01) / 2.0 AS bid,
         close + greatest(close * 0.0008 + 0.01, 0.01) / 2.0 AS ask FROM bars)"""


# -- registries from events -----------------------------------------------------------------
def events(spark: SparkSession, sf_dir: str, kind: str | None = None) -> DataFrame:
    rows = table(spark, sf_dir, "events")
    if kind is not None:
        rows = rows.where(F.col("event_type") == kind)
    return rows.select(
        "event_id", F.concat(F.lit("U"), F.col("user_id")).alias("symbol"), instant(F.col("ts")).alias("ts"),
        "event_type", "value", F.get_json_object("props", "$.k").cast("int").alias("k"))


SQL_EVENTS = """
ev AS (SELECT event_id, 'U' || user_id AS symbol, ts, event_type, value,
              CAST(regexp_extract(props, '[0-9]+') AS INTEGER) AS k FROM events)"""


def _setup_type(k: Column) -> Column:
    return (F.when(k < 20, "ECONOMY").when(k < 40, "STANDARD").when(k < 60, "PROMO")
            .when(k < 80, "SMALL").when(k < 95, "LARGE").otherwise("GAP_AND_GO"))


def signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purchases as candidate signals."""
    e = events(spark, sf_dir, "purchase")
    k = F.col("k")
    return e.select(
        "event_id", "symbol", F.date_format("ts", "yyyy-MM-dd").alias("session"), F.col("ts").alias("signal_ts"),
        _setup_type(k).alias("setup_type"),
        F.when(k == 7, "SHORT").otherwise("LONG").alias("direction"),
        F.concat(F.lit("SCAN_"), F.floor(k / 4)).alias("scanner_id"),
        F.when(k < 50, "1-URGENT").when(k < 98, "3-MEDIUM").otherwise("NO_SUCH_UNIVERSE").alias("universe_id"),
        F.col("value").alias("scanner_score"), k.alias("scanner_rank"),
        F.concat_ws("|", "symbol", F.date_format("ts", "yyyy-MM-dd")).alias("candidate_batch_id"))


SQL_SIGNALS = """
signals AS (
  SELECT event_id, symbol, strftime(ts, '%Y-%m-%d') AS session, ts AS signal_ts,
         CASE WHEN k < 20 THEN 'ECONOMY' WHEN k < 40 THEN 'STANDARD' WHEN k < 60 THEN 'PROMO'
              WHEN k < 80 THEN 'SMALL' WHEN k < 95 THEN 'LARGE' ELSE 'GAP_AND_GO' END AS setup_type,
         CASE WHEN k = 7 THEN 'SHORT' ELSE 'LONG' END AS direction,
         'SCAN_' || CAST(floor(k / 4) AS BIGINT) AS scanner_id,
         CASE WHEN k < 50 THEN '1-URGENT' WHEN k < 98 THEN '3-MEDIUM' ELSE 'NO_SUCH_UNIVERSE' END AS universe_id,
         value AS scanner_score, k AS scanner_rank
  FROM ev WHERE event_type = 'purchase')"""


def symbol_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signups as symbol versions with an activity window and structural flags."""
    e = events(spark, sf_dir, "signup")
    day = F.to_date("ts")
    return e.select(
        F.concat(F.lit("SYM_"), F.col("event_id")).alias("symbol_registry_id"), "symbol",
        F.col("ts").alias("valid_from"), day.alias("active_from"),
        F.when(F.col("k") < 70, F.date_add(day, F.floor(F.col("value") / 5).cast("int"))).alias("active_to"),
        F.when(F.col("value") < 20, "MICRO").when(F.col("value") < 75, "SMALL").when(F.col("value") < 150, "MID")
         .otherwise("LARGE").alias("float_bucket"),
        F.col("k").between(10, 19).alias("is_etf"), F.col("k").between(20, 24).alias("is_adr"),
        F.col("k").between(25, 27).alias("is_spac"))


SQL_SYMBOLS = """
symver AS (
  SELECT 'SYM_' || event_id AS symbol_registry_id, symbol, ts AS valid_from, CAST(ts AS DATE) AS active_from,
         CASE WHEN k < 70 THEN CAST(ts AS DATE) + CAST(floor(value / 5) AS INTEGER) END AS active_to,
         CASE WHEN value < 20 THEN 'MICRO' WHEN value < 75 THEN 'SMALL' WHEN value < 150 THEN 'MID' ELSE 'LARGE' END AS float_bucket,
         k BETWEEN 10 AND 19 AS is_etf, k BETWEEN 20 AND 24 AS is_adr, k BETWEEN 25 AND 27 AS is_spac
  FROM ev WHERE event_type = 'signup')"""


def regimes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Views as market-wide regime snapshots: one global key."""
    return events(spark, sf_dir, "view").select(
        F.concat(F.lit("RGM_"), F.col("event_id")).alias("regime_snapshot_id"), F.col("ts").alias("regime_ts"),
        F.lit("1H").alias("cadence"), F.lit("v1").alias("regime_spec_version"),
        F.when(F.col("k") < 50, "ON").otherwise("OFF").alias("risk_state"))


SQL_REGIMES = """
regimes AS (
  SELECT 'RGM_' || event_id AS regime_snapshot_id, ts AS regime_ts, '1H' AS cadence, 'v1' AS regime_spec_version,
         CASE WHEN k < 50 THEN 'ON' ELSE 'OFF' END AS risk_state FROM ev WHERE event_type = 'view')"""


def setups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part types as setups; sizes are their (text-ordered) versions."""
    p = table(spark, sf_dir, "part")
    return p.select(
        F.col("p_type").alias("setup_id"), F.col("p_size").cast("string").alias("version"),
        F.concat_ws("@", "p_type", F.col("p_size").cast("string")).alias("setup_version_id"),
        F.when(F.col("p_brand") >= "Brand#2", "ACTIVE").otherwise("DEPRECATED").alias("status"))


SQL_SETUPS = """
setups AS (
  SELECT p_type AS setup_id, CAST(p_size AS VARCHAR) AS version, p_type || '@' || p_size AS setup_version_id,
         CASE WHEN p_brand >= 'Brand#2' THEN 'ACTIVE' ELSE 'DEPRECATED' END AS status FROM part)"""


def scanners(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier")
    return s.select(
        F.concat(F.lit("SCAN_"), F.col("s_nationkey")).alias("scanner_id"),
        F.col("s_suppkey").cast("string").alias("scanner_spec_version"),
        F.concat(F.lit("SCAN_"), F.col("s_nationkey"), F.lit("@"), F.col("s_suppkey")).alias("scanner_version_id"),
        F.when(F.col("s_acctbal") >= 0, "ACTIVE").otherwise("DEPRECATED").alias("status"))


SQL_SCANNERS = """
scanners AS (
  SELECT 'SCAN_' || s_nationkey AS scanner_id, CAST(s_suppkey AS VARCHAR) AS scanner_spec_version,
         'SCAN_' || s_nationkey || '@' || s_suppkey AS scanner_version_id,
         CASE WHEN s_acctbal >= 0 THEN 'ACTIVE' ELSE 'DEPRECATED' END AS status FROM supplier)"""


def universes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as universe versions: few keys, many versions, many equal start times."""
    o = table(spark, sf_dir, "orders")
    days = F.datediff(F.to_date("o_orderdate"), F.lit("1995-01-01").cast("date"))
    start = F.lit("2024-01-01 00:00:00").cast("timestamp")
    return o.select(
        F.col("o_orderpriority").alias("universe_id"), "o_orderkey",
        F.concat_ws("@", "o_orderpriority", "o_orderkey").alias("universe_version_id"),
        (start + F.make_dt_interval(secs=days * 1000)).alias("valid_from"),
        F.when(F.col("o_orderstatus") == "F", '{"float_buckets": ["MICRO", "SMALL"]}')
         .when(F.col("o_orderstatus") == "O", '{"exclude_is_etf": false, "exclude_is_adr": false}')
         .otherwise("{}").alias("membership_rule"))


SQL_UNIVERSES = """
universes AS (
  SELECT o_orderpriority AS universe_id, o_orderkey, o_orderpriority || '@' || o_orderkey AS universe_version_id,
         TIMESTAMP '2024-01-01 00:00:00' + to_seconds(1000 * date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE))) AS valid_from,
         o_orderstatus FROM orders)"""


def data_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir, "error").select(
        F.concat(F.lit("DQA_"), F.col("event_id")).alias("dq_id"), "symbol", F.lit("AS_OF").alias("pit_class"),
        F.col("ts").alias("as_of"), (F.col("value") > 100).alias("feed_outage_active"),
        (F.col("k") < 10).alias("stale_quote"))


def halts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors as halts lasting `value` minutes; some are still ongoing."""
    e = events(spark, sf_dir, "error")
    end = F.timestamp_micros(F.unix_micros("ts") + F.round(F.col("value") * 60_000_000).cast("bigint"))
    return e.select(F.concat(F.lit("H"), F.col("event_id")).alias("halt_id"), "symbol",
                    F.col("ts").alias("halt_start_ts"), F.when(F.col("k") < 97, end).alias("halt_end_ts"))


SQL_HALTS = """
halts AS (
  SELECT 'H' || event_id AS halt_id, symbol, ts AS halt_start_ts,
         CASE WHEN k < 97 THEN make_timestamp(epoch_us(ts) + CAST(round(value * 60000000) AS BIGINT)) END AS halt_end_ts
  FROM ev WHERE event_type = 'error')"""


def news(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clicks as news: available at the event, published `value` seconds earlier (sometimes unknown)."""
    e = events(spark, sf_dir, "click")
    pub = F.timestamp_micros(F.unix_micros("ts") - F.round(F.col("value") * 1_000_000).cast("bigint"))
    return e.select(F.concat(F.lit("N"), F.col("event_id")).alias("news_id"), "symbol",
                    F.col("ts").alias("news_available_ts"), F.when(F.col("k") >= 5, pub).alias("publish_ts"))


SQL_NEWS = """
news AS (
  SELECT 'N' || event_id AS news_id, symbol, ts AS news_available_ts,
         CASE WHEN k >= 5 THEN make_timestamp(epoch_us(ts) - CAST(round(value * 1000000) AS BIGINT)) END AS publish_ts
  FROM ev WHERE event_type = 'click')"""
