"""Detectors on supplier-year bars, timelines around news, reports over timelines."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import detectors as X
from ..operators import timelines as T
from ..session import cut_lineage
from . import adapters as D
from .reconstruction import reconstruct_sessions
from .registry import iso, query, r6, sql_iso, sql_r6

_WITH = f"WITH RECURSIVE {D.SQL_BARS}"

SQL_OPENED = """
opened AS (SELECT *, min(ts) FILTER (WHERE rth) OVER (PARTITION BY symbol, session) AS open_ts FROM bars)"""

SQL_OR = """
orr AS (
  SELECT symbol, session, open_ts, max(high) AS or_high, min(low) AS or_low, max(ts) AS last_ts
  FROM opened WHERE rth AND ts < open_ts + INTERVAL 15 DAY GROUP BY ALL),
or_up AS (SELECT o.symbol, o.session, min(b.ts) AS ts, o.or_high AS lvl FROM orr o JOIN bars b USING (symbol, session)
          WHERE b.rth AND b.ts >= o.open_ts + INTERVAL 15 DAY AND b.high > o.or_high GROUP BY ALL),
or_dn AS (SELECT o.symbol, o.session, min(b.ts) AS ts, o.or_low AS lvl FROM orr o JOIN bars b USING (symbol, session)
          WHERE b.rth AND b.ts >= o.open_ts + INTERVAL 15 DAY AND b.low < o.or_low GROUP BY ALL),
f_or AS (
  SELECT symbol, session, last_ts AS ts, 'OPENING_RANGE_SET' AS kind, or_high AS a, or_low AS b FROM orr
  UNION ALL SELECT symbol, session, ts, 'OR_BREAK_UP', lvl, NULL FROM or_up
  UNION ALL SELECT symbol, session, ts, 'OR_BREAK_DOWN', lvl, NULL FROM or_dn)"""

SQL_VOL = """
volw AS (SELECT *, count(*) OVER w AS n, quantile_cont(volume, 0.5) OVER w AS med FROM bars
         WINDOW w AS (PARTITION BY symbol, session ORDER BY ts ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)),
f_vol AS (SELECT symbol, session, ts, 'VOLUME_EXPANSION' AS kind, med AS a, volume / med AS b FROM volw
          WHERE n = 20 AND med > 0 AND volume >= 3 * med)"""

SQL_SWEEP = """
sww AS (SELECT *, count(*) OVER w AS n, max(high) OVER w AS ph, min(low) OVER w AS pl FROM bars
        WINDOW w AS (PARTITION BY symbol, session ORDER BY ts ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING)),
f_sweep AS (SELECT symbol, session, ts, 'SWEEP_OF_HIGHS' AS kind, ph AS a, CAST(NULL AS DOUBLE) AS b FROM sww WHERE n = 10 AND high > ph AND close <= ph
            UNION ALL SELECT symbol, session, ts, 'SWEEP_OF_LOWS', pl, NULL FROM sww WHERE n = 10 AND low < pl AND close >= pl)"""

SQL_EXTREME = """
exw AS (SELECT *, max(high) FILTER (WHERE rth) OVER w AS rh, min(low) FILTER (WHERE rth) OVER w AS rl FROM opened
        WINDOW w AS (PARTITION BY symbol, session ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f_ext AS (SELECT symbol, session, ts, 'NEW_SESSION_HIGH' AS kind, high AS a, CAST(NULL AS DOUBLE) AS b FROM exw
          WHERE rth AND ts >= open_ts + INTERVAL 15 DAY AND high > rh
          UNION ALL SELECT symbol, session, ts, 'NEW_SESSION_LOW', low, NULL FROM exw
          WHERE rth AND ts >= open_ts + INTERVAL 15 DAY AND low < rl)"""

SQL_VWAP = """
vw0 AS (SELECT symbol, session, ts, close, sum((high + low + close) / 3.0 * volume) OVER w / sum(volume) OVER w AS vwap
        FROM bars WHERE rth WINDOW w AS (PARTITION BY symbol, session ORDER BY ts ROWS UNBOUNDED PRECEDING)),
vw1 AS (SELECT *, close - vwap AS diff, lag(close - vwap) OVER (PARTITION BY symbol, session ORDER BY ts) AS prev FROM vw0 WHERE vwap IS NOT NULL),
f_vwap AS (SELECT symbol, session, ts, CASE WHEN diff > 0 THEN 'VWAP_CROSS_UP' ELSE 'VWAP_CROSS_DOWN' END AS kind, vwap AS a, CAST(NULL AS DOUBLE) AS b
           FROM vw1 WHERE prev <> 0 AND diff <> 0 AND (prev > 0) <> (diff > 0))"""

SQL_CLUSTER = """
f_all AS (SELECT * FROM f_or UNION ALL SELECT * FROM f_vol UNION ALL SELECT * FROM f_sweep
          UNION ALL SELECT * FROM f_ext UNION ALL SELECT * FROM f_vwap),
starts AS (
  SELECT x.symbol, x.session, x.ts, count(*) AS n FROM (SELECT DISTINCT symbol, session, ts FROM f_all) x
  JOIN f_all y ON y.symbol = x.symbol AND y.session = x.session AND y.ts >= x.ts AND y.ts <= x.ts + INTERVAL 5 DAY
  GROUP BY ALL HAVING count(*) >= 3),
greedy AS (
  SELECT symbol, session, min(ts) AS ts FROM starts GROUP BY ALL
  UNION ALL
  SELECT g.symbol, g.session, (SELECT min(s.ts) FROM starts s WHERE s.symbol = g.symbol AND s.session = g.session AND s.ts > g.ts + INTERVAL 5 DAY)
  FROM greedy g WHERE g.ts IS NOT NULL),
f_cluster AS (SELECT s.symbol, s.session, s.ts, 'CLUSTER' AS kind, CAST(s.n AS DOUBLE) AS a, 5.0 AS b
              FROM greedy g JOIN starts s USING (symbol, session, ts))"""

_FACT_CTES = ", ".join([D.SQL_BARS, SQL_OPENED, SQL_OR, SQL_VOL, SQL_SWEEP, SQL_EXTREME, SQL_VWAP, SQL_CLUSTER])
_FACT_OUT = f"symbol, session, {sql_iso('ts', 'ts')}, kind, {sql_r6('coalesce(a, -1)', 'a')}, {sql_r6('coalesce(b, -1)', 'b')}"


def _out(rows, a: str, b: str | None = None):
    def part(key):
        return F.coalesce(F.try_element_at("detail", F.lit(key)) if key else F.lit(None).cast("double"), F.lit(-1.0))
    made = rows.withColumn("a", part(a)).withColumn("b", part(b))
    return made.select("symbol", "session", iso("ts"), "kind", r6("a"), r6("b"))


def _detect(spark, d, *detectors):
    return X.facts(D.bars(spark, d), detectors or X.ALL_DETECTORS, clock=D.DAY_CLOCK)


@query("opening_range", f"{_WITH}, {SQL_OPENED}, {SQL_OR} SELECT {_FACT_OUT} FROM f_or")
def opening_range(spark, d):
    rows = _detect(spark, d, X.opening_range)
    level = F.coalesce(F.try_element_at("detail", F.lit("or_high")), F.try_element_at("detail", F.lit("level")))
    low = F.try_element_at("detail", F.lit("or_low"))
    made = rows.withColumn("a", level).withColumn("b", F.coalesce(low, F.lit(-1.0)))
    return made.select("symbol", "session", iso("ts"), "kind", r6("a"), r6("b"))


@query("volume_expansion", f"{_WITH}, {SQL_VOL} SELECT {_FACT_OUT} FROM f_vol")
def volume_expansion(spark, d):
    return _out(_detect(spark, d, X.volume_expansion), "median", "ratio")


@query("sweeps", f"{_WITH}, {SQL_SWEEP} SELECT {_FACT_OUT} FROM f_sweep")
def sweeps(spark, d):
    return _out(_detect(spark, d, X.sweeps), "level")


@query("session_extremes", f"{_WITH}, {SQL_OPENED}, {SQL_EXTREME} SELECT {_FACT_OUT} FROM f_ext")
def session_extremes(spark, d):
    rows = _detect(spark, d, X.session_extremes)
    a = F.coalesce(F.try_element_at("detail", F.lit("high")), F.try_element_at("detail", F.lit("low")))
    return rows.select("symbol", "session", iso("ts"), "kind", (F.round(a, 6) + 0.0).alias("a"), F.lit(-1.0).alias("b"))


@query("vwap_cross", f"{_WITH}, {SQL_VWAP} SELECT {_FACT_OUT} FROM f_vwap")
def vwap_cross(spark, d):
    return _out(_detect(spark, d, X.vwap_crosses), "vwap")


@query("clusters", f"WITH RECURSIVE {_FACT_CTES} SELECT {_FACT_OUT} FROM f_cluster")
def clusters(spark, d):
    return _out(X.clusters(_detect(spark, d), clock=D.DAY_CLOCK), "count", "span_minutes")


# -- timelines ------------------------------------------------------------------------------
@query("timelines", f"""WITH RECURSIVE {_FACT_CTES},
anchors AS (SELECT symbol, session, min(ts) AS anchor_ts FROM bars GROUP BY symbol, session, month(ts)),
rows0 AS (
  SELECT a.symbol, a.anchor_ts, f.ts, f.kind,
         CASE WHEN f.ts < a.anchor_ts THEN 'PRE' WHEN f.ts = a.anchor_ts THEN 'AT' ELSE 'POST' END AS phase
  FROM anchors a JOIN (SELECT * FROM f_all UNION ALL SELECT * FROM f_cluster) f USING (symbol, session)
  WHERE f.ts BETWEEN a.anchor_ts - INTERVAL 15 DAY AND a.anchor_ts + INTERVAL 30 DAY
  UNION ALL SELECT symbol, anchor_ts, anchor_ts, 'NEWS', 'AT' FROM anchors)
SELECT symbol || '@' || {sql_iso('anchor_ts')} AS timeline_id,
       row_number() OVER (PARTITION BY symbol, anchor_ts ORDER BY ts, kind) - 1 AS idx, {sql_iso('ts', 'ts')}, kind, phase
FROM rows0""")
def timelines(spark, d):
    """Reconstruction around the first bar of each month of a session."""
    bars = D.stored_bars(spark, d)
    anchors = bars.groupBy("symbol", "session", F.month("ts").alias("_m")).agg(F.min("ts").alias("anchor_ts"))
    events = reconstruct_sessions(anchors, bars, pre_bars=15, post_bars=30, clock=D.DAY_CLOCK)
    return events.select("timeline_id", F.col("idx").cast("bigint").alias("idx"), iso("ts"), "kind", "phase")


# -- reports over timelines of user events ------------------------------------------------------
PRE, POST = 12 * 3600, 24 * 3600

SQL_TL = f"""
anchors AS (SELECT symbol, 'TL' || news_id AS timeline_id, news_available_ts AS anchor_ts FROM news),
tl0 AS (
  SELECT a.timeline_id, a.symbol, a.anchor_ts, e.ts, upper(e.event_type) AS kind, e.value,
         CASE WHEN date_trunc('minute', e.ts) < date_trunc('minute', a.anchor_ts) THEN 'PRE'
              WHEN date_trunc('minute', e.ts) = date_trunc('minute', a.anchor_ts) THEN 'AT' ELSE 'POST' END AS phase
  FROM anchors a JOIN ev e ON e.symbol = a.symbol AND e.event_type <> 'click'
   AND e.ts BETWEEN a.anchor_ts - INTERVAL {PRE} SECOND AND a.anchor_ts + INTERVAL {POST} SECOND
  UNION ALL SELECT timeline_id, symbol, anchor_ts, anchor_ts, 'NEWS', NULL, 'AT' FROM anchors),
tl AS (SELECT *, row_number() OVER (PARTITION BY timeline_id ORDER BY ts, kind) - 1 AS idx FROM tl0)"""

_TL = f"WITH {D.SQL_EVENTS}, {D.SQL_NEWS}, {SQL_TL}"


def _timeline_events(spark, d):
    news = D.news(spark, d).select(
        "symbol", F.concat(F.lit("TL"), "news_id").alias("timeline_id"),
        F.col("news_available_ts").alias("anchor_ts"), F.lit("NEWS").alias("anchor_kind"))
    facts = D.events(spark, d).where(F.col("event_type") != "click").select(
        "symbol", "ts", F.upper("event_type").alias("kind"), F.create_map(F.lit("value"), F.col("value")).alias("detail"))
    return T.reconstruct(news, facts, ["symbol"], pre_seconds=PRE, post_seconds=POST)


@query("timeline_events", f"{_TL} SELECT timeline_id, idx, {sql_iso('ts', 'ts')}, kind, phase FROM tl")
def timeline_events(spark, d):
    e = T.guard_details(_timeline_events(spark, d))
    return e.select("timeline_id", F.col("idx").cast("bigint").alias("idx"), iso("ts"), "kind", "phase")


@query("kind_frequency", f"{_TL} SELECT kind, count(*) AS n FROM tl GROUP BY kind")
def kind_frequency(spark, d):
    return T.kind_frequency(_timeline_events(spark, d))


@query("phase_distribution", f"{_TL} SELECT phase, count(*) AS n FROM tl GROUP BY phase")
def phase_distribution(spark, d):
    return T.phase_distribution(_timeline_events(spark, d))


def _sql_describe(source: str) -> str:
    return (f"SELECT count(v) AS count, {sql_r6('min(v)', 'min')}, {sql_r6('median(v)', 'median')}, "
            f"{sql_r6('max(v)', 'max')}, round(avg(v), 3) AS mean FROM ({source})")


def _described(df):
    return df.select("count", r6("min"), r6("median"), r6("max"), "mean")


@query("events_per_timeline", f"{_TL} " + _sql_describe(
    "SELECT CAST(count(*) AS DOUBLE) AS v FROM tl GROUP BY timeline_id"))
def events_per_timeline(spark, d):
    return _described(T.events_per_timeline(_timeline_events(spark, d)))


@query("inter_event_gap", f"{_TL} " + _sql_describe(
    "SELECT (epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY timeline_id ORDER BY idx))) / 1000000.0 AS v FROM tl"))
def inter_event_gap(spark, d):
    return _described(T.inter_event_gap(_timeline_events(spark, d)))


@query("time_to_first_kind", f"{_TL} " + _sql_describe(
    "SELECT min(epoch_us(ts) - epoch_us(anchor_ts)) / 1000000.0 / 60.0 AS v FROM tl "
    "WHERE kind = 'PURCHASE' AND phase = 'POST' GROUP BY timeline_id"))
def time_to_first_kind(spark, d):
    return _described(T.time_to_first_kind(_timeline_events(spark, d), "PURCHASE"))


@query("kind_pairs", f"""{_TL} SELECT kind || '->' || nxt AS pair, count(*) AS n FROM (
  SELECT kind, lead(kind) OVER (PARTITION BY timeline_id ORDER BY idx) AS nxt FROM tl) WHERE nxt IS NOT NULL GROUP BY 1""")
def kind_pairs(spark, d):
    return T.kind_pairs(_timeline_events(spark, d))


@query("archetype_families", f"""{_TL} SELECT archetype, count(*) AS n FROM (
  SELECT string_agg(DISTINCT kind, '|' ORDER BY kind) AS archetype FROM tl GROUP BY timeline_id) GROUP BY 1""")
def archetype_families(spark, d):
    return T.family_sizes(_timeline_events(spark, d), "kind_set")


@query("archetype_sequences", f"""{_TL} SELECT timeline_id, count(*) AS n_events,
  string_agg(phase || ':' || kind, '>' ORDER BY idx) AS archetype FROM tl GROUP BY timeline_id""")
def archetype_sequences(spark, d):
    return T.archetypes(_timeline_events(spark, d), "phase_kind_seq")


@query("graph_edges", f"""{_TL},
follows AS (SELECT timeline_id, idx AS src, lead(idx) OVER w AS dst, 'FOLLOWS' AS relation,
                   (epoch_us(lead(ts) OVER w) - epoch_us(ts)) / 1000000.0 AS delta_seconds
            FROM tl WINDOW w AS (PARTITION BY timeline_id ORDER BY idx)),
near AS (SELECT a.timeline_id, a.idx AS src, b.idx AS dst,
                CASE WHEN date_trunc('minute', a.ts) = date_trunc('minute', b.ts) THEN 'SAME_MINUTE' ELSE 'WITHIN_360M' END AS relation,
                (epoch_us(b.ts) - epoch_us(a.ts)) / 1000000.0 AS delta_seconds
         FROM tl a JOIN tl b ON a.timeline_id = b.timeline_id AND b.idx > a.idx
         WHERE date_trunc('minute', a.ts) = date_trunc('minute', b.ts) OR (b.ts > a.ts AND b.ts <= a.ts + INTERVAL 6 HOUR))
SELECT timeline_id, src, dst, relation, delta_seconds FROM follows WHERE dst IS NOT NULL
UNION ALL SELECT * FROM near""")
def graph_edges(spark, d):
    e = T.graph_edges(cut_lineage(_timeline_events(spark, d)), within_seconds=6 * 3600)
    return e.select("timeline_id", F.col("src").cast("bigint").alias("src"), F.col("dst").cast("bigint").alias("dst"),
                    "relation", "delta_seconds")


@query("heatmap", f"""{_TL},
cells AS (SELECT kind, CAST(floor((epoch_us(ts) - epoch_us(anchor_ts)) / 60000000.0 / 60) * 60 AS BIGINT) AS bucket, count(*) AS n FROM tl GROUP BY ALL)
SELECT k.kind, b.bucket, coalesce(c.n, 0) AS n FROM (SELECT DISTINCT kind FROM cells) k CROSS JOIN (SELECT DISTINCT bucket FROM cells) b
LEFT JOIN cells c ON c.kind = k.kind AND c.bucket = b.bucket""")
def heatmap(spark, d):
    return T.heatmap(_timeline_events(spark, d), 60)


@query("event_tree", f"""{_TL} SELECT timeline_id, phase, kind, count(*) AS n,
  string_agg(strftime(ts, '%H:%M:%S'), ',' ORDER BY strftime(ts, '%H:%M:%S')) AS times FROM tl GROUP BY ALL""")
def event_tree(spark, d):
    e = T.event_tree(_timeline_events(spark, d))
    return e.withColumn("times", F.array_join("times", ","))


@query("event_query", f"""{_TL} SELECT timeline_id, idx, kind, value FROM tl
WHERE kind IN ('PURCHASE', 'VIEW') AND phase = 'POST' AND value >= 40 AND ts <= TIMESTAMP '2024-01-20 00:00:00'""")
def event_query(spark, d):
    until = F.lit("2024-01-20T00:00:00+00:00").cast("timestamp")
    hit = _timeline_events(spark, d).where(
        F.col("kind").isin("PURCHASE", "VIEW") & (F.col("phase") == "POST") & (F.col("ts") <= until) & (T.fact("value") >= 40))
    return hit.select("timeline_id", F.col("idx").cast("bigint").alias("idx"), "kind",
                      T.fact("value").alias("value"))


@query("timeline_select", f"""{_TL} SELECT timeline_id FROM tl GROUP BY timeline_id
HAVING bool_or(kind = 'ERROR') AND count(*) >= 4 AND string_agg(DISTINCT kind, '|' ORDER BY kind) = 'ERROR|NEWS|VIEW'""")
def timeline_select(spark, d):
    return T.timelines_where(_timeline_events(spark, d), F.bool_or(F.col("kind") == "ERROR"), F.count("*") >= 4,
                             T.archetype_key("kind_set") == "ERROR|NEWS|VIEW")


@query("knowledge_summary", f"""{_TL},
sizes AS (SELECT CAST(count(*) AS DOUBLE) AS v FROM tl GROUP BY timeline_id),
gaps AS (SELECT (epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY timeline_id ORDER BY idx))) / 1000000.0 AS v FROM tl),
d1 AS (SELECT 'events_per_timeline' AS section, count(v) AS c, min(v) AS mn, median(v) AS md, max(v) AS mx, round(avg(v), 3) AS av FROM sizes
       UNION ALL SELECT 'inter_event_gap_seconds', count(v), min(v), median(v), max(v), round(avg(v), 3) FROM gaps)
SELECT 'timelines' AS section, 'count' AS metric, CAST(count(DISTINCT timeline_id) AS DOUBLE) AS value FROM tl
UNION ALL SELECT 'kind_frequency', kind, count(*) FROM tl GROUP BY kind
UNION ALL SELECT 'phase_distribution', phase, count(*) FROM tl GROUP BY phase
UNION ALL SELECT section, 'count', c FROM d1 UNION ALL SELECT section, 'min', mn FROM d1
UNION ALL SELECT section, 'median', round(md, 6) FROM d1 UNION ALL SELECT section, 'max', mx FROM d1
UNION ALL SELECT section, 'mean', av FROM d1""")
def knowledge_summary(spark, d):
    return T.summary(_timeline_events(spark, d)).select("section", "metric", r6("value"))
