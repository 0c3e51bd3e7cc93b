"""Run statistics, outcome labels, stability by session, dataset selection and index reads."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.rules import label_of
from ..operators import barriers as B
from ..operators.bars import mark_session
from ..operators import observations as O
from ..operators import timelines as T
from ..operators.detectors import halt_facts
from ..session import cut_lineage
from ..sources.tables import same_content
from ..streaming.lateness import arrival_counts, lateness_report
from . import adapters as D
from .dataset import dataset_version, select_observations
from .queries_bars import _TO_OUTCOME, GRID
from .queries_quality import SQL_BAR_SPINE, SQL_BOTH_HASHES, SQL_GAPS, SQL_VERDICT, bar_spine, validated_again
from .queries_registries import SQL_TO_BUILT, built
from .queries_tape import _TL, _timeline_events
from .registry import iso, query, r6, sql_iso, sql_r6


def _touched(spark, d):
    bars = D.stored_bars(spark, d)
    entries = B.entries_with_atr(bars, D.DAY_CLOCK)
    return bars, entries, B.first_touches(entries, bars, GRID, D.DAY_CLOCK)


@query("grid_stats", f"""{_TO_OUTCOME}, {SQL_BAR_SPINE}
SELECT (SELECT count(DISTINCT (symbol, session, entry_ts)) FROM outcome) AS entries, (SELECT count(*) FROM warm WHERE atr IS NULL OR atr <= 0) AS skipped_atr,
       (SELECT count(*) FROM warm WHERE atr > 0) - (SELECT count(DISTINCT (symbol, session, entry_ts)) FROM outcome) AS skipped_path,
       (SELECT count(*) FROM spine) AS symbol_days, (SELECT count(*) FROM spine WHERE (symbol, session) NOT IN (SELECT (symbol, session) FROM bars)) AS empty_days""")
def grid_stats(spark, d):
    bars = D.stored_bars(spark, d)
    # Entries are counted and searched; the ATR behind them is made once.
    entries = cut_lineage(B.entries_with_atr(bars, D.DAY_CLOCK))
    return B.run_stats(bar_spine(spark, d), bars, entries, B.first_touches(entries, bars, GRID, D.DAY_CLOCK))


@query("rth_marks", f"""WITH local AS (SELECT event_id, timezone('America/New_York', timezone('UTC', ts)) AS l FROM events)
SELECT event_id, CAST(l AS TIME) >= TIME '09:30:00' AND CAST(l AS TIME) < TIME '16:00:00' AS rth,
       {sql_iso("timezone('UTC', timezone('America/New_York', date_trunc('day', l) + INTERVAL 16 HOUR))", 'session_close')} FROM local""")
def rth_marks(spark, d):
    """Regular hours by the exchange's clock for every event."""
    return mark_session(D.events(spark, d)).select("event_id", "rth", iso("session_close"))


@query("outcome_labels", f"""{_TO_OUTCOME},
coded AS (SELECT k, CAST(h AS BIGINT) AS h, CASE barrier WHEN 'PROFIT' THEN 1 WHEN 'STOP' THEN -1 ELSE 0 END AS ternary,
                 CASE barrier WHEN 'PROFIT' THEN 1 WHEN 'STOP' THEN -1 ELSE CAST(sign(ret) AS INTEGER) END AS signed FROM outcome)
SELECT k, h, CAST(ternary AS BIGINT) AS ternary, CAST(signed AS BIGINT) AS signed, count(*) AS n FROM coded GROUP BY ALL""")
def outcome_labels(spark, d):
    rows = B.outcomes(_touched(spark, d)[2], D.DAY_CLOCK)
    return rows.groupBy(
        "k", F.col("h").cast("bigint").alias("h"),
        label_of(F.col("barrier"), F.col("realized_return"), "TERNARY_ZERO").cast("bigint").alias("ternary"),
        label_of(F.col("barrier"), F.col("realized_return"), "SIGN_RETURN").cast("bigint").alias("signed"),
    ).agg(F.count("*").alias("n"))


@query("grid_stability", f"""{_TO_OUTCOME},
ratio AS (SELECT session, median(atr / spread) AS m FROM (SELECT DISTINCT symbol, session, entry_ts, atr, spread FROM outcome WHERE spread > 0) GROUP BY 1),
g AS (SELECT session, k, CAST(h AS BIGINT) AS h, count(*) AS n, count(*) FILTER (WHERE barrier = 'TIME') / count(*) AS t,
             coalesce(median(ttr) FILTER (WHERE barrier <> 'TIME'), h) AS ttr FROM outcome GROUP BY session, k, h)
SELECT session, k, h, n, {sql_r6('t', 'time_pct')}, {sql_r6('ttr', 'median_ttr')}, {sql_r6('k * m', 'barrier_spread_ratio')} FROM g JOIN ratio USING (session)""")
def grid_stability(spark, d):
    """Cells per session: does a cell behave the same in every period?"""
    cells = B.cell_metrics(cut_lineage(_touched(spark, d)[2]), GRID, D.DAY_CLOCK, by=["session"])
    return cells.select("session", "k", F.col("h").cast("bigint").alias("h"), "n", r6("time_pct"), r6("median_ttr"), r6("barrier_spread_ratio"))


@query("halt_facts", f"""WITH {D.SQL_EVENTS}, {D.SQL_HALTS}
SELECT symbol, {sql_iso('halt_start_ts', 'ts')}, 'HALT_START' AS kind FROM halts
UNION ALL SELECT symbol, {sql_iso('halt_end_ts')}, 'HALT_RESUME' FROM halts WHERE halt_end_ts IS NOT NULL""")
def halt_events(spark, d):
    return halt_facts(D.halts(spark, d), F.date_format("halt_start_ts", "yyyy-MM-dd")).select("symbol", iso("ts"), "kind")


@query("same_content", f"""WITH {D.SQL_BARS}, {SQL_BAR_SPINE}, {SQL_GAPS}, {SQL_VERDICT}, {SQL_BOTH_HASHES},
runs AS (SELECT content_hash FROM hashed UNION ALL SELECT content_hash FROM hashed JOIN verdicts USING (symbol, session) WHERE verdict <> 'PASS')
SELECT content_hash, count(*) AS n FROM runs GROUP BY content_hash HAVING count(*) > 1""")
def same_content_batches(spark, d):
    """Contents with more than one provenance row: batches validated again, and empty ones."""
    return same_content(validated_again(spark, d)).select("content_hash", "n")


_WORDS = " || '|' || ".join(f"coalesce(CAST(sum(CAST('0x' || substring(h, {1 + 8 * i}, 8) AS BIGINT)) AS VARCHAR), '')" for i in range(8))


@query("dataset_selection", f"""{SQL_TO_BUILT}, picked AS (SELECT sha256('{{"candidate_key":"' || candidate_key || '"}}') AS h FROM built
WHERE reason_code IS NULL AND dataset_role IN ('TRAIN', 'VALIDATION') AND session BETWEEN '2024-01-05' AND '2024-01-25')
SELECT count(*) AS n_rows, sha256(count(*) || '|' || {_WORDS}) AS dataset_version FROM picked""")
def dataset_selection(spark, d):
    rows = select_observations(O.accepted(built(spark, d)), roles=["TRAIN", "VALIDATION"], start="2024-01-05", end="2024-01-25")
    return dataset_version(rows, ["candidate_key"])


@query("archetype_index", f"""{_TL} SELECT timeline_id, symbol, {sql_iso('anchor_ts', 'anchor_ts')}, 'post_kind_set' AS scheme,
  coalesce(string_agg(DISTINCT kind, '|' ORDER BY kind) FILTER (WHERE phase = 'POST'), '') AS archetype, count(*) AS n_events FROM tl GROUP BY timeline_id, symbol, anchor_ts""")
def archetype_index(spark, d):
    return T.index_rows(cut_lineage(_timeline_events(spark, d)), "post_kind_set").select(
        "timeline_id", "symbol", iso("anchor_ts"), "scheme", "archetype", "n_events")


@query("late_bars", f"""WITH {D.SQL_EVENTS}, arrived AS (
  SELECT symbol, date_trunc('minute', ts) AS bar, ts + to_seconds(CAST(k * 12 AS INTEGER)) AS arrival FROM ev),
counted AS (SELECT make_timestamp(CAST(floor(epoch_us(bar) / 3600000000) AS BIGINT) * 3600000000) AS w, symbol, bar, count(*) AS n,
                   count(*) FILTER (WHERE arrival > bar + INTERVAL 600 SECOND) AS late FROM arrived GROUP BY ALL)
SELECT {sql_iso('w', 'window_start')}, symbol, CAST(sum(n) AS BIGINT) AS arrivals, count(*) AS bars, CAST(sum(n) - count(*) AS BIGINT) AS repeats,
       CAST(sum(late) AS BIGINT) AS late FROM counted GROUP BY w, symbol""")
def late_bars(spark, d):
    """Events as minute bars that arrive up to 20 minutes later: late, repeated and distinct bars per hour."""
    bars = D.events(spark, d).select("symbol", F.date_trunc("minute", "ts").alias("ts"), F.timestamp_micros(
        F.unix_micros("ts") + F.col("k").cast("bigint") * 12_000_000).alias("arrival_ts"))
    return lateness_report(arrival_counts(bars, 600, 3600)).select(iso("window_start"), "symbol", "arrivals", "bars", "repeats", "late")
