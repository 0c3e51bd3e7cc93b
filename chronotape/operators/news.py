"""News archive: record building, duplicate linking, availability by ticker."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import content_hash, digest, headline_hash
from ..functions.times import market_session, seconds_between, slot_of

STORY_WINDOW_SECONDS = 3600


def build_records(articles: DataFrame) -> DataFrame:
    """Raw articles as archive records: facts, hashes and times only; nothing is interpreted."""
    vendor = F.upper("vendor")
    return articles.select(
        digest([vendor, F.col("article_id"), F.col("seq")], 32).alias("record_id"),
        F.col("article_id").cast("string").alias("article_id"), vendor.alias("vendor"), "source",
        F.sort_array(F.array_distinct(F.transform("tickers", F.upper))).alias("tickers"),
        headline_hash(F.col("headline")).alias("headline_hash"), "publish_ts", "available_ts", "language",
        market_session(F.col("available_ts")).alias("market_session"),
        seconds_between(F.col("available_ts"), F.col("publish_ts")).alias("availability_delay_seconds"),
        content_hash(F.col("raw")).alias("content_hash"), "seq")


def _first_by(records: DataFrame, keys: list[str], name: str) -> DataFrame:
    """First record per key, only for keys that repeat."""
    return records.groupBy(*keys).agg(
        F.min(F.struct("seq", "record_id")).alias(name), F.count("*").alias("_n")
    ).where(F.col("_n") > 1).drop("_n")


def _first_story(records: DataFrame, window_seconds: int) -> DataFrame:
    """Per record with a repeated headline: first record of the same headline that shares a
    ticker and lies within the window on either side of its availability.

    No pairs are formed. Equal (headline, ticker, time) rows collapse first. Time is cut into
    blocks of one window width, so a window is: all of its own block, the tail of the block
    before and the head of the block after. Tail and head minima are running minima inside a
    block, read off by probe rows placed at the window's two ends. A headline repeated over
    a long time is spread over its blocks.
    """
    repeated = records.groupBy("headline_hash").agg(F.count("*").alias("_n")).where(F.col("_n") > 1).select("headline_hash")
    tagged = records.join(repeated, "headline_hash", "left_semi").select(
        "headline_hash", F.explode("tickers").alias("_ticker"), "available_ts", "seq", "record_id")
    width = window_seconds * 1_000_000
    point = ["headline_hash", "_ticker", "_at"]
    points = tagged.groupBy("headline_hash", "_ticker", F.unix_micros("available_ts").alias("_at")).agg(
        F.min(F.struct("seq", "record_id")).alias("_first"))
    here = slot_of(F.timestamp_micros("_at"), window_seconds)
    # Each point appears as itself and as two probes: (block, time, role).
    roles = F.array(
        F.struct(here.alias("_block"), F.col("_at").alias("_t"), F.lit(0).alias("_role")),
        F.struct((here - 1).alias("_block"), (F.col("_at") - width).alias("_t"), F.lit(1).alias("_role")),
        F.struct((here + 1).alias("_block"), (F.col("_at") + width).alias("_t"), F.lit(2).alias("_role")))
    rows = points.select(*point, "_first", F.inline(roles)).withColumn(
        "_value", F.when(F.col("_role") == 0, F.col("_first")))
    block = Window.partitionBy("headline_hash", "_ticker", "_block")
    upward = block.orderBy("_t", "_role").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    downward = block.orderBy(F.desc("_t"), "_role").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    read: Column = (F.when(F.col("_role") == 0, F.min("_value").over(block))
                    .when(F.col("_role") == 1, F.min("_value").over(downward))
                    .otherwise(F.min("_value").over(upward)))
    near = rows.select(*point, read.alias("_near")).groupBy(*point).agg(F.min("_near").alias("_near"))
    return (tagged.withColumn("_at", F.unix_micros("available_ts")).join(near, point)
            .groupBy("record_id").agg(F.min("_near").alias("_story")))


def link_duplicates(records: DataFrame, archive: DataFrame | None = None,
                    window_seconds: int = STORY_WINDOW_SECONDS) -> DataFrame:
    """Add `duplicate_of` and `dup_kind` to the records, looking only at earlier ones (by seq).

    Precedence: EXACT (vendor and article id), CONTENT (equal non-empty content hash), STORY
    (same headline, shared ticker, within the window). Nothing is dropped. `archive` holds
    records linked before; its seq values are lower.
    """
    pool = records if archive is None else archive.select(*records.columns).unionByName(records)
    exact = _first_by(pool, ["vendor", "article_id"], "_exact")
    content = _first_by(pool.where(F.col("content_hash") != ""), ["content_hash"], "_content")
    story = _first_story(pool, window_seconds)
    joined = (records.join(exact, ["vendor", "article_id"], "left").join(content, ["content_hash"], "left")
              .join(story, "record_id", "left"))

    def earlier(name: str) -> Column:
        return F.when(F.col(name)["seq"] < F.col("seq"), F.col(name)["record_id"])

    e, c, s = earlier("_exact"), earlier("_content"), earlier("_story")
    return joined.select(
        *records.columns, F.coalesce(e, c, s).alias("duplicate_of"),
        F.when(e.isNotNull(), "EXACT").when(c.isNotNull(), "CONTENT").when(s.isNotNull(), "STORY").alias("dup_kind"))


def duplicates(archive: DataFrame) -> DataFrame:
    return archive.where(F.col("duplicate_of").isNotNull())


def archive_as_of(archive: DataFrame, ticker: str, as_of: str) -> DataFrame:
    """Records of a ticker available at the instant, oldest first."""
    return archive.where(F.array_contains("tickers", ticker.upper())
                         & (F.col("available_ts") <= F.lit(as_of).cast("timestamp"))).orderBy("available_ts", "seq")
