"""Checks of raw batches: findings are facts in a long table, data passes through unchanged.

A batch is (symbol, session); streams carry their arrival ordinal `seq`. Every check is
anchored on the batch spine, so a batch without rows still gets a result. Order-dependent
checks work on ordinal chunks, because a raw stream of one batch has no size bound.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import digest
from ..functions.rules import bar_fault, quote_fault
from ..functions.times import iso_utc, seconds_between
from ..session import cut_lineage
from .bars import SESSION
from .slots import CHUNK_ROWS, first_rows, with_number, with_previous_by

# Thresholds of the batch checks.
MIN_BARS = 300
GAP_WARN_SECONDS = 60
GAP_FAIL_SECONDS = 300
HASH_CHUNK_ROWS = 4096

_RESULT = [*SESSION, "check", "status", "n", "examples"]
_RANK = {"SKIP": 0, "PASS": 1, "WARN": 2, "FAIL": 3}


def _examples(found: DataFrame, n: int = 3) -> DataFrame:
    """First three findings per batch in arrival order, as (symbol, session, examples)."""
    top = first_rows(found.select(*SESSION, "seq", "note"), SESSION, ["seq", "note"], n)
    return top.groupBy(*SESSION).agg(
        F.transform(F.sort_array(F.collect_list(F.struct("seq", "note"))), lambda x: x["note"]).alias("examples"))


def _result(spine: DataFrame, found: DataFrame, check: str, status: Column, counts: DataFrame | None = None) -> DataFrame:
    """`found` holds one row per finding (symbol, session, seq, note); `status` sees `n` and `worst`."""
    tally = counts if counts is not None else found.groupBy(*SESSION).agg(F.count("*").alias("n"))
    out = spine.join(tally, SESSION, "left").join(_examples(found), SESSION, "left")
    return out.withColumn("n", F.coalesce("n", F.lit(0)).cast("bigint")).select(
        *SESSION, F.lit(check).alias("check"), status.alias("status"), "n",
        F.coalesce("examples", F.array().cast("array<string>")).alias("examples"))


def _with_previous_ts(rows: DataFrame, chunk_rows: int) -> DataFrame:
    return with_previous_by(rows.select(*SESSION, "seq", "ts"), SESSION, "seq", ["ts"], chunk_rows)


def chronology(spine: DataFrame, rows: DataFrame, check: str, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Times strictly increase in arrival order and are all readable; the first offender is reported."""
    seen = _with_previous_ts(rows, chunk_rows)
    note = F.when(F.col("ts").isNull(), "unparseable ts").when(F.col("ts") <= F.col("prev_ts"), "non-increasing")
    bad = seen.withColumn("note", note).where(F.col("note").isNotNull())
    first = first_rows(bad, SESSION, ["seq"], 1).withColumn(
        "note", F.concat_ws(" ", "note", F.coalesce(iso_utc(F.col("ts")), F.lit(""))))
    return _result(spine, first, check, F.when(F.col("n") > 0, "FAIL").otherwise("PASS"))


def duplication(spine: DataFrame, rows: DataFrame, check: str = "bars_duplication") -> DataFrame:
    """Rows whose time already occurred earlier in the batch."""
    keyed = rows.where(F.col("ts").isNotNull())
    per_time = keyed.groupBy(*SESSION, "ts").agg(F.count("*").alias("_n"))
    counts = per_time.groupBy(*SESSION).agg(F.sum(F.col("_n") - 1).alias("n"))
    # Four arrivals per time are enough to know the first three repeats.
    order = Window.partitionBy(*SESSION, "ts").orderBy("seq")
    repeats = (keyed.select(*SESSION, "seq", "ts", F.row_number().over(order).alias("_rn"))
               .where(F.col("_rn") <= 4).where(F.col("_rn") > 1).select(*SESSION, "seq", iso_utc(F.col("ts")).alias("note")))
    return _result(spine, repeats, check, F.when(F.col("n") > 0, "FAIL").otherwise("PASS"), counts)


def sizes(rows: DataFrame) -> DataFrame:
    """Rows per batch: (symbol, session, n)."""
    return rows.groupBy(*SESSION).agg(F.count("*").alias("n"))


def completeness(spine: DataFrame, bars: DataFrame, min_rows: int = MIN_BARS, counts: DataFrame | None = None) -> DataFrame:
    counts = sizes(bars) if counts is None else counts
    status = F.when(F.col("n") == 0, "FAIL").when(F.col("n") < min_rows, "WARN").otherwise("PASS")
    out = spine.join(counts, SESSION, "left").withColumn("n", F.coalesce("n", F.lit(0)).cast("bigint"))
    return out.select(*SESSION, F.lit("completeness").alias("check"), status.alias("status"), "n",
                      F.array().cast("array<string>").alias("examples"))


def coverage(spine: DataFrame, bars: DataFrame, warn_seconds: int = GAP_WARN_SECONDS,
             fail_seconds: int = GAP_FAIL_SECONDS, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Gaps between consecutive arrivals; backward steps are the chronology check's business."""
    gaps = stream_gaps(bars, warn_seconds, chunk_rows)
    counts = gaps.groupBy(*SESSION).agg(F.count("*").alias("n"), F.max("gap_seconds").alias("worst"))
    notes = gaps.select(*SESSION, "seq", F.concat_ws(
        " ", iso_utc(F.col("gap_from")), iso_utc(F.col("gap_to")), F.col("gap_seconds").cast("bigint")).alias("note"))
    status = F.when(F.col("n") == 0, "PASS").when(F.col("worst") > fail_seconds, "FAIL").otherwise("WARN")
    return _result(spine, notes, "coverage", status, counts)


def stream_gaps(rows: DataFrame, over_seconds: int, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """(symbol, session, seq, gap_from, gap_to, gap_seconds) for steps longer than the limit."""
    seen = _with_previous_ts(rows, chunk_rows)
    return seen.select(*SESSION, "seq", F.col("prev_ts").alias("gap_from"), F.col("ts").alias("gap_to"),
                       seconds_between(F.col("ts"), F.col("prev_ts")).alias("gap_seconds")).where(
        F.col("gap_seconds") > over_seconds)


def _sanity(spine: DataFrame, rows: DataFrame, fault: Column, check: str) -> DataFrame:
    bad = rows.withColumn("_fault", fault).where(F.col("_fault").isNotNull()).select(
        *SESSION, "seq", F.concat_ws(" ", iso_utc(F.col("ts")), "_fault").alias("note"))
    return _result(spine, bad, check, F.when(F.col("n") > 0, "FAIL").otherwise("PASS"))


def sane_bars(spine: DataFrame, bars: DataFrame) -> DataFrame:
    return _sanity(spine, bars, bar_fault(), "sane_bars")


def sane_quotes(spine: DataFrame, quotes: DataFrame) -> DataFrame:
    return _sanity(spine, quotes, quote_fault(), "sane_quotes")


def news_provenance(spine: DataFrame, news: DataFrame) -> DataFrame:
    """Missing availability fails; availability before the claimed publication is a warning."""
    missing = F.col("news_available_ts").isNull()
    early = ~missing & (F.col("news_available_ts") < F.col("publish_ts"))
    counts = news.groupBy(*SESSION).agg(
        F.count("*").alias("_items"), F.sum(missing.cast("bigint")).alias("_missing"),
        F.sum(F.coalesce(early, F.lit(False)).cast("bigint")).alias("_early"))
    out = spine.join(counts, SESSION, "left")
    m, e = (F.coalesce(F.col(c), F.lit(0)) for c in ("_missing", "_early"))
    return out.select(
        *SESSION, F.lit("news_provenance").alias("check"),
        F.when(m > 0, "FAIL").when(e > 0, "WARN").otherwise("PASS").alias("status"),
        F.when(m > 0, m).when(e > 0, e).otherwise(F.coalesce("_items", F.lit(0))).cast("bigint").alias("n"),
        F.array().cast("array<string>").alias("examples"))


def consolidation(spine: DataFrame, consolidated: bool) -> DataFrame:
    """A single-venue feed distorts volume and spread."""
    return _constant(spine, "consolidation", "PASS" if consolidated else "FAIL")


def feed_is_consolidated(feeds: DataFrame, vendor: str) -> bool:
    """Capability lookup of one vendor (a feeds table has one row per vendor)."""
    row = feeds.where(F.col("vendor") == vendor).select("consolidated").head()
    return bool(row and row[0])


def consolidation_by_feed(spine: DataFrame, served: DataFrame, feeds: DataFrame) -> DataFrame:
    """The same check from a feeds table: `served` names the vendors (symbol, session, vendor) behind each batch.

    `n` counts vendors that aren't known as consolidated; one is enough to fail, and so is a batch without a vendor.
    """
    known = feeds.groupBy("vendor").agg(F.bool_and(F.coalesce("consolidated", F.lit(False))).alias("_ok"))
    per = served.select(*SESSION, "vendor").distinct().join(known, "vendor", "left").groupBy(*SESSION).agg(
        F.count(F.when(~F.coalesce("_ok", F.lit(False)), 1)).alias("_bad"))
    return spine.join(per, SESSION, "left").select(
        *SESSION, F.lit("consolidation").alias("check"), F.when(F.col("_bad") == 0, "PASS").otherwise("FAIL").alias("status"),
        F.coalesce("_bad", F.lit(0)).alias("n"), F.array().cast("array<string>").alias("examples"))


def _constant(spine: DataFrame, check: str, status: str) -> DataFrame:
    return spine.select(*SESSION, F.lit(check).alias("check"), F.lit(status).alias("status"),
                        F.lit(0).cast("bigint").alias("n"), F.array().cast("array<string>").alias("examples"))


def corporate_actions(spine: DataFrame, supplied: bool = False) -> DataFrame:
    return _constant(spine, "corporate_action_sanity", "PASS" if supplied else "SKIP")


def halt_consistency(spine: DataFrame, bars: DataFrame, halts: DataFrame | None,
                     over_seconds: int = GAP_FAIL_SECONDS) -> DataFrame:
    """SKIP without halts; otherwise long gaps that no halt of the symbol overlaps are a warning.

    A gap (from, to) is explained when a halt started before `to` ends after `from`; the
    largest end among halts started before `to` decides that.
    """
    if halts is None:
        return _constant(spine, "halt_consistency", "SKIP")
    from .asof import Highest, asof_fold
    gaps = stream_gaps(bars, over_seconds)
    end = F.coalesce(F.col("halt_end_ts"), F.lit("9999-12-31 00:00:00").cast("timestamp"))
    seen = asof_fold(gaps, halts, ["symbol"], "gap_to", "halt_start_ts", {"_end": Highest(end)})
    open_gaps = seen.where(F.coalesce(F.col("_end") <= F.col("gap_from"), F.lit(True))).select(
        *SESSION, "seq", F.concat_ws(" ", iso_utc(F.col("gap_from")), iso_utc(F.col("gap_to"))).alias("note"))
    return _result(spine, open_gaps, "halt_consistency", F.when(F.col("n") > 0, "WARN").otherwise("PASS"))


# -- verdict and hash -------------------------------------------------------------------------
def verdict(checks: DataFrame) -> DataFrame:
    """Worst status per batch; skipped checks do not count."""
    rank = F.lit(0)
    for name, value in _RANK.items():
        rank = F.when(F.col("status") == name, value).otherwise(rank)
    worst = checks.groupBy(*SESSION).agg(F.max(rank).alias("_r"))
    return worst.select(*SESSION, F.when(F.col("_r") == 3, "FAIL").when(F.col("_r") == 2, "WARN").otherwise("PASS").alias("verdict"))


def stream_hash(rows: DataFrame, columns: Sequence[str], stream: str, longest: int | None = None) -> DataFrame:
    """Order-sensitive hash of one stream per batch: rows -> fixed-size chunks -> batch.

    Rows are numbered densely in arrival order, whatever the gaps between ordinals. A chunk lists at most HASH_CHUNK_ROWS
    row hashes and a batch one hash per full chunk. Where no batch is longer than a chunk, no number is needed.
    """
    parts = [F.when(F.col(c).isNull(), F.lit("null")).otherwise(F.col(c).cast("string")) for c in columns]
    hashed = rows.select(*SESSION, "seq", digest(parts).alias("_h"))

    def joined(order: str) -> Column:
        items = F.sort_array(F.collect_list(F.struct(order, "_h")))
        return F.sha2(F.array_join(F.transform(items, lambda x: x["_h"]), "\n"), 256)

    if longest is None:
        longest = _longest(sizes(rows))
    if longest <= HASH_CHUNK_ROWS:
        return hashed.repartition(*SESSION).groupBy(*SESSION).agg(
            F.lit(stream).alias("stream"), F.sha2(joined("seq"), 256).alias("stream_hash"), F.count("*").alias("rows"))
    hashed = with_number(hashed, SESSION, ["seq", "_h"], "_number")
    hashed = hashed.withColumn("_chunk", F.floor(F.col("_number") / HASH_CHUNK_ROWS))
    chunks = hashed.groupBy(*SESSION, "_chunk").agg(joined("seq").alias("_h"), F.count("*").alias("_n"))
    return chunks.groupBy(*SESSION).agg(
        F.lit(stream).alias("stream"), joined("_chunk").alias("stream_hash"), F.sum("_n").alias("rows"))


def _longest(counts: DataFrame) -> int:
    return counts.agg(F.max("n")).first()[0] or 0


def batch_hash(spine: DataFrame, streams: dict[str, tuple[DataFrame, Sequence[str]]],
               longest: dict[str, int] | None = None) -> DataFrame:
    """(symbol, session, content_hash, row_count) over the streams of a batch, by stream name."""
    per_stream = None
    for name in sorted(streams):
        rows, columns = streams[name]
        one = stream_hash(rows, columns, name, (longest or {}).get(name))
        per_stream = one if per_stream is None else per_stream.unionByName(one)
    text = F.concat_ws("=", "stream", "stream_hash")
    total = per_stream.groupBy(*SESSION).agg(
        F.sha2(F.array_join(F.sort_array(F.collect_list(text)), "\n"), 256).alias("content_hash"),
        F.sum("rows").alias("row_count"))
    return spine.join(total, SESSION, "left").select(
        *SESSION, F.coalesce("content_hash", F.sha2(F.lit(""), 256)).alias("content_hash"),
        F.coalesce("row_count", F.lit(0)).cast("bigint").alias("row_count"))


@dataclass
class Streams:
    bars: DataFrame | None = None
    quotes: DataFrame | None = None
    trades: DataFrame | None = None
    news: DataFrame | None = None
    columns: dict[str, Sequence[str]] = field(default_factory=lambda: {
        "bars": ("ts", "open", "high", "low", "close", "volume"), "quotes": ("ts", "bid", "ask"),
        "trades": ("ts", "price", "size"), "news": ("article_id", "news_available_ts", "publish_ts", "vendor", "source")})
    _sizes: dict[str, DataFrame] = field(default_factory=dict, init=False, repr=False)

    # Fixed columns the checks read, whatever part of a stream is hashed.
    _CHECKED = {"bars": ("ts", "open", "high", "low", "close", "volume"), "quotes": ("ts", "bid", "ask"), "trades": ("ts",)}

    def columns_for(self, stream: str) -> Sequence[str]:
        return self._CHECKED[stream]

    def present(self) -> dict[str, tuple[DataFrame, Sequence[str]]]:
        return {n: (df, self.columns[n]) for n in ("bars", "quotes", "trades", "news")
                if (df := getattr(self, n)) is not None}

    def sizes(self, stream: str) -> DataFrame:
        """Rows per batch of a stream, counted once."""
        if stream not in self._sizes:
            self._sizes[stream] = cut_lineage(sizes(getattr(self, stream)))
        return self._sizes[stream]

    def longest(self) -> dict[str, int]:
        """Rows of the largest batch, per stream."""
        return {n: _longest(self.sizes(n)) for n in self.present()}


@dataclass(frozen=True)
class Limits:
    min_rows: int = MIN_BARS
    warn_seconds: int = GAP_WARN_SECONDS
    fail_seconds: int = GAP_FAIL_SECONDS


def _stream_findings(rows: DataFrame, names: dict[str, str], fault: Column | None, warn_seconds: int | None,
                     longest: int | None = None) -> DataFrame:
    """All row-level findings of one stream from a single ordered pass.

    (symbol, session, check, seq, note, size): `names` maps chronology / coverage / sanity to
    the check names wanted.
    """
    # Faults are judged before the exchange: their columns stay behind.
    own = [] if fault is None else [fault.alias("_fault")]
    seen = with_previous_by(rows.select(*SESSION, "seq", "ts", *own), SESSION, "seq", ["ts"], longest=longest)
    gap = seconds_between(F.col("ts"), F.col("prev_ts"))
    stamp = F.coalesce(iso_utc(F.col("ts")), F.lit(""))

    def found(when: Column, check: str, note: Column, size: Column) -> Column:
        return F.when(when, F.struct(F.lit(check).alias("check"), note.alias("note"), size.cast("double").alias("size")))

    zero = F.lit(0.0)
    disorder = F.when(F.col("ts").isNull(), "unparseable ts").when(F.col("ts") <= F.col("prev_ts"), "non-increasing")
    parts = [found(disorder.isNotNull(), names["chronology"], F.concat_ws(" ", disorder, stamp), zero)]
    if "coverage" in names:
        text = F.concat_ws(" ", iso_utc(F.col("prev_ts")), stamp, gap.cast("bigint"))
        parts.append(found(gap > warn_seconds, names["coverage"], text, gap))
    if fault is not None:
        parts.append(found(F.col("_fault").isNotNull(), names["sanity"], F.concat_ws(" ", stamp, "_fault"), zero))
    return seen.select(*SESSION, "seq", F.inline(F.array(*parts))).where(F.col("check").isNotNull())


def _from_findings(spine: DataFrame, findings: DataFrame, names: Sequence[str], limits: Limits) -> DataFrame:
    """One row per batch and named check. Chronology reports its first offender only."""
    first_only = F.col("check").endswith("_chronology")
    tally = findings.groupBy(*SESSION, "check").agg(F.count("*").alias("_n"), F.max("size").alias("_worst"))
    top = first_rows(findings.select(*SESSION, "check", "seq", "note"), [*SESSION, "check"], ["seq", "note"], 3)
    notes = top.groupBy(*SESSION, "check").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("seq", "note"))), lambda x: x["note"]).alias("_notes"))
    wanted = spine.select(*SESSION, F.explode(F.array(*[F.lit(n) for n in names])).alias("check"))
    joined = wanted.join(tally, [*SESSION, "check"], "left").join(notes, [*SESSION, "check"], "left")
    n = F.coalesce("_n", F.lit(0)).cast("bigint")
    status = (F.when(n == 0, "PASS")
              .when((F.col("check") == "coverage") & (F.col("_worst") <= limits.fail_seconds), "WARN").otherwise("FAIL"))
    empty = F.array().cast("array<string>")
    return joined.select(
        *SESSION, "check", status.alias("status"), F.when(first_only, F.least(n, F.lit(1))).otherwise(n).alias("n"),
        F.when(first_only, F.slice(F.coalesce("_notes", empty), 1, 1)).otherwise(F.coalesce("_notes", empty)).alias("examples"))


def run_checks(spine: DataFrame, streams: Streams, *, consolidated: bool = True, symbols_supplied: bool = False,
               halts: DataFrame | None = None, limits: Limits = Limits()) -> DataFrame:
    """All checks of the present streams in one long table.

    Same results as the single checks above, but each stream is ordered once: its chronology,
    gap and sanity findings come from one pass and are stored before they are summarised. Times that
    only increase do not repeat, so duplicates are sought in the batches that fail the chronology.
    """
    plans = (("bars", streams.bars, {"chronology": "bars_chronology", "coverage": "coverage", "sanity": "sane_bars"}, bar_fault),
             ("quotes", streams.quotes, {"chronology": "quotes_chronology", "sanity": "sane_quotes"}, quote_fault),
             ("trades", streams.trades, {"chronology": "trades_chronology"}, None))
    found, names, longest = None, [], streams.longest()
    for stream, rows, checks, fault in plans:
        if rows is None:
            continue
        wanted = [*SESSION, "seq", *streams.columns_for(stream)]
        part = _stream_findings(rows.select(*dict.fromkeys(wanted)), checks, fault() if fault else None, limits.warn_seconds,
                                longest[stream])
        found = part if found is None else found.unionByName(part)
        names += list(checks.values())
    out = [consolidation(spine, consolidated)]
    if found is not None:
        found = cut_lineage(found)
        out.append(_from_findings(spine, found, names, limits))
    if streams.bars is not None:
        disordered = found.where(F.col("check") == "bars_chronology").select(*SESSION).distinct()
        out += [duplication(spine, streams.bars.join(cut_lineage(disordered), SESSION, "left_semi")),
                completeness(spine, streams.bars, limits.min_rows, streams.sizes("bars")),
                corporate_actions(spine, symbols_supplied),
                halt_consistency(spine, streams.bars, halts, limits.fail_seconds)]
    if streams.news is not None:
        out.append(news_provenance(spine, streams.news))
    total = out[0]
    for one in out[1:]:
        total = total.unionByName(one)
    return total.select(*_RESULT)
