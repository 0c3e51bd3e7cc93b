"""Bars, ATR, barriers and grid cells over supplier-year sessions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import bars as A
from ..operators import barriers as B
from . import adapters as D
from .calibration import run_grid
from .registry import iso, query, r6, sql_iso, sql_r6

GRID = B.Grid(k=(0.5, 1.0, 2.0), h=(15, 60, 240))
_K = ", ".join(f"({k})" for k in GRID.k)
_H = ", ".join(f"({h})" for h in GRID.h)

SQL_BUCKETS = f"""
binned AS (
  SELECT *, make_timestamp(CAST(ceil(epoch_us(ts) / 432000000000.0) AS BIGINT) * 432000000000) AS bucket_end FROM quoted),
buckets AS (
  SELECT symbol, session, bucket_end, max(high) AS high, min(low) AS low,
         first(open ORDER BY ts) AS open, last(close ORDER BY ts) AS close,
         max(high) FILTER (WHERE ts < bucket_end) AS open_high, min(low) FILTER (WHERE ts < bucket_end) AS open_low
  FROM binned GROUP BY ALL),
ranges AS (
  SELECT symbol, session, bucket_end, row_number() OVER w AS n,
         greatest(high - low, abs(high - coalesce(lag(close) OVER w, close)), abs(low - coalesce(lag(close) OVER w, close))) AS tr,
         greatest(open_high - open_low, abs(open_high - coalesce(lag(close) OVER w, close)),
                  abs(open_low - coalesce(lag(close) OVER w, close))) AS tr_edge, open_high IS NOT NULL AS has_edge
  FROM buckets WINDOW w AS (PARTITION BY symbol, session ORDER BY bucket_end))"""

SQL_ATR = """
atr AS (
  SELECT symbol, session, bucket_end, n, tr_edge, has_edge, 0.0::DOUBLE AS s, CAST(NULL AS DOUBLE) AS prev
  FROM ranges WHERE n = 1
  UNION ALL
  SELECT r.symbol, r.session, r.bucket_end, r.n, r.tr_edge, r.has_edge,
         CASE WHEN r.n < 15 THEN a.s + r.tr WHEN r.n = 15 THEN (a.s + r.tr) / 14 ELSE (a.s * 13 + r.tr) / 14 END, a.s
  FROM atr a JOIN ranges r ON r.symbol = a.symbol AND r.session = a.session AND r.n = a.n + 1)"""

SQL_ENTRIES = """
numbered AS (
  SELECT *, row_number() OVER (PARTITION BY symbol, session ORDER BY ts) AS rn FROM binned WHERE rth),
sampled AS (SELECT * FROM numbered WHERE (rn - 1) % 5 = 0),
warm AS (
  SELECT e.symbol, e.session, e.ts AS entry_ts, e.session_close, e.close AS ref, e.ask - e.bid AS spread,
         CASE WHEN e.ts = e.bucket_end AND a.has_edge THEN
                CASE WHEN a.n < 15 THEN NULL WHEN a.n = 15 THEN (a.prev + a.tr_edge) / 14 ELSE (a.prev * 13 + a.tr_edge) / 14 END
              WHEN a.n > 15 THEN a.prev END AS atr
  FROM sampled e LEFT JOIN atr a ON a.symbol = e.symbol AND a.session = e.session AND a.bucket_end = e.bucket_end)"""

SQL_TOUCH = f"""
paths AS (
  SELECT w.symbol, w.session, w.entry_ts, w.ref, w.spread, w.atr, b.ts,
         date_diff('day', w.entry_ts, b.ts) AS age, (b.high - w.ref) / w.atr AS up, (b.low - w.ref) / w.atr AS dn,
         (b.close - w.ref) / w.ref AS ret
  FROM warm w JOIN quoted b ON b.symbol = w.symbol AND b.session = w.session AND b.ts > w.entry_ts
   AND b.ts <= least(w.entry_ts + INTERVAL {max(GRID.h)} DAY, w.session_close)
  WHERE w.atr > 0),
touched AS (
  SELECT p.symbol, p.session, p.entry_ts, p.ref, p.spread, p.atr, k.k, h.h,
         min(age) FILTER (WHERE up >= k.k AND age <= h.h) AS up_age,
         min(age) FILTER (WHERE -dn >= k.k AND age <= h.h) AS dn_age,
         max(age) FILTER (WHERE age <= h.h) AS last_age,
         arg_max(ret, age) FILTER (WHERE age <= h.h) AS end_ret
  FROM paths p, (VALUES {_K}) k(k), (VALUES {_H}) h(h) GROUP BY ALL),
outcome AS (
  SELECT symbol, session, entry_ts, CAST(k AS DOUBLE) AS k, h, atr, spread,
         CASE WHEN up_age IS NULL AND dn_age IS NULL THEN 'TIME' WHEN dn_age IS NULL OR up_age < dn_age THEN 'PROFIT' ELSE 'STOP' END AS barrier,
         CAST(CASE WHEN last_age IS NULL THEN h WHEN up_age IS NULL AND dn_age IS NULL THEN last_age
              WHEN dn_age IS NULL OR up_age < dn_age THEN up_age ELSE dn_age END AS DOUBLE) AS ttr,
         CASE WHEN last_age IS NULL THEN 0 WHEN up_age IS NULL AND dn_age IS NULL THEN end_ret
              WHEN dn_age IS NULL OR up_age < dn_age THEN k * atr / ref ELSE -k * atr / ref END AS ret
  FROM touched)"""

_TO_OUTCOME = f"WITH RECURSIVE {D.SQL_BARS}, {SQL_BUCKETS}, {SQL_ATR}, {SQL_ENTRIES}, {SQL_TOUCH}"


def _touches(spark, d):
    bars = D.stored_bars(spark, d)
    return B.first_touches(B.entries_with_atr(bars, D.DAY_CLOCK), bars, GRID, D.DAY_CLOCK)


@query("session_bars", f"""WITH {D.SQL_BARS}
SELECT symbol, session, {sql_iso('ts', 'ts')}, open, high, low, close, volume, bid, ask, rth FROM quoted""")
def session_bars(spark, d):
    return D.bars(spark, d).select("symbol", "session", iso("ts"), "open", "high", "low", "close", "volume",
                                   "bid", "ask", "rth")


@query("rth_entry_sample", f"""WITH {D.SQL_BARS}, numbered AS (
  SELECT *, row_number() OVER (PARTITION BY symbol, session ORDER BY ts) AS rn FROM quoted WHERE rth)
SELECT symbol, session, {sql_iso('ts', 'ts')}, close FROM numbered WHERE (rn - 1) % 5 = 0""")
def rth_entry_sample(spark, d):
    return A.sample_entries(D.bars(spark, d), D.DAY_CLOCK).select("symbol", "session", iso("ts"), "close")


@query("ohlc_resample", f"""WITH {D.SQL_BARS}, {SQL_BUCKETS}
SELECT symbol, session, {sql_iso('bucket_end', 'bucket_end')}, open, high, low, close,
       coalesce(open_high, -1) AS open_high, coalesce(open_low, -1) AS open_low FROM buckets""")
def ohlc_resample(spark, d):
    out = A.resample(D.bars(spark, d), D.DAY_CLOCK).fillna({"open_high": -1.0, "open_low": -1.0})
    return out.select("symbol", "session", iso("bucket_end"), "open", "high", "low", "close", "open_high", "open_low")


@query("atr_wilder", f"""WITH RECURSIVE {D.SQL_BARS}, {SQL_BUCKETS}, {SQL_ATR}
SELECT symbol, session, {sql_iso('bucket_end', 'bucket_end')}, {sql_r6('s', 'atr')} FROM atr WHERE n >= 15""")
def atr_wilder(spark, d):
    return A.wilder_atr(D.bars(spark, d), D.DAY_CLOCK).select("symbol", "session", iso("bucket_end"), r6("atr"))


@query("entry_atr", f"""WITH RECURSIVE {D.SQL_BARS}, {SQL_BUCKETS}, {SQL_ATR}, {SQL_ENTRIES}
SELECT symbol, session, {sql_iso('entry_ts', 'entry_ts')}, ref, spread,
       {sql_r6('coalesce(atr, -1)', 'atr')} FROM warm""")
def entry_atr(spark, d):
    out = B.entries_with_atr(D.stored_bars(spark, d), D.DAY_CLOCK).fillna({"atr": -1.0})
    return out.select("symbol", "session", iso("entry_ts"), "ref", "spread", r6("atr"))


@query("first_touch", f"""{_TO_OUTCOME}
SELECT symbol, session, {sql_iso('entry_ts', 'entry_ts')}, CAST(k AS DOUBLE) AS k,
       CAST(coalesce(min(up_age), -1) AS BIGINT) AS up_days, CAST(coalesce(min(dn_age), -1) AS BIGINT) AS dn_days
FROM touched WHERE h = {max(GRID.h)} GROUP BY ALL""")
def first_touch(spark, d):
    rows = _touches(spark, d).select("symbol", "session", "entry_ts", F.inline("touches"))
    return rows.select("symbol", "session", iso("entry_ts"), "k",
                       F.coalesce(F.datediff("up_ts", "entry_ts"), F.lit(-1)).cast("bigint").alias("up_days"),
                       F.coalesce(F.datediff("dn_ts", "entry_ts"), F.lit(-1)).cast("bigint").alias("dn_days"))


@query("barrier_outcomes", f"""{_TO_OUTCOME}
SELECT symbol, session, {sql_iso('entry_ts', 'entry_ts')}, k, CAST(h AS BIGINT) AS h, barrier, ttr,
       {sql_r6('ret', 'realized_return')}, {sql_r6('k * atr', 'barrier_distance')} FROM outcome""")
def barrier_outcomes(spark, d):
    rows = B.outcomes(_touches(spark, d), D.DAY_CLOCK)
    return rows.select("symbol", "session", iso("entry_ts"), "k", F.col("h").cast("bigint").alias("h"), "barrier",
                       "ttr", r6("realized_return"), r6("barrier_distance"))


SQL_CELLS = f"""
ratio AS (SELECT median(atr / spread) AS m FROM (SELECT DISTINCT symbol, session, entry_ts, atr, spread FROM outcome WHERE spread > 0)),
shares AS (
  SELECT k, CAST(h AS BIGINT) AS h, count(*) AS n, count(*) FILTER (WHERE barrier = 'PROFIT') / count(*) AS p,
         count(*) FILTER (WHERE barrier = 'STOP') / count(*) AS s, count(*) FILTER (WHERE barrier = 'TIME') / count(*) AS t,
         coalesce(median(ttr) FILTER (WHERE barrier <> 'TIME'), h) AS median_ttr,
         coalesce(avg(CASE WHEN ret > 0 THEN 1.0 ELSE 0.0 END) FILTER (WHERE barrier = 'TIME'), 0) AS tp,
         coalesce(avg(CASE WHEN ret < 0 THEN 1.0 ELSE 0.0 END) FILTER (WHERE barrier = 'TIME'), 0) AS tn
  FROM outcome GROUP BY k, h),
cells AS (
  SELECT *, coalesce(k * (SELECT m FROM ratio), 0) AS ratio, least(p, s, t) AS min_class,
         -(CASE WHEN p > 0 THEN p * ln(p) ELSE 0 END + CASE WHEN s > 0 THEN s * ln(s) ELSE 0 END
           + CASE WHEN t > 0 THEN t * ln(t) ELSE 0 END) / ln(3) AS entropy,
         concat_ws(',', CASE WHEN t > 0.7 THEN 'time%>70%' END, CASE WHEN least(p, s, t) < 0.1 THEN 'min_class<10%' END,
                   CASE WHEN coalesce(k * (SELECT m FROM ratio), 0) < 3 THEN 'barrier/spread<3' END) AS reasons
  FROM shares)"""

_CELL_COLUMNS = f"""k, h, n, {sql_r6('p', 'profit_pct')}, {sql_r6('s', 'stop_pct')}, {sql_r6('t', 'time_pct')},
       {sql_r6('median_ttr', 'median_ttr')}, {sql_r6('ratio', 'barrier_spread_ratio')},
       {sql_r6('min_class', 'min_class_fraction')}, {sql_r6('entropy', 'class_entropy')},
       {sql_r6('tp', 'time_pos_pct')}, {sql_r6('tn', 'time_neg_pct')}, reasons AS degenerate_reasons"""


def _cell_output(cells):
    return cells.select(
        "k", F.col("h").cast("bigint").alias("h"), "n",
        *[r6(c) for c in ("profit_pct", "stop_pct", "time_pct", "median_ttr", "barrier_spread_ratio",
                          "min_class_fraction", "class_entropy", "time_pos_pct", "time_neg_pct")],
        F.concat_ws(",", "degenerate_reasons").alias("degenerate_reasons"))


@query("grid_cells", f"{_TO_OUTCOME}, {SQL_CELLS} SELECT {_CELL_COLUMNS} FROM cells")
def grid_cells(spark, d):
    return _cell_output(run_grid(D.stored_bars(spark, d), GRID, D.DAY_CLOCK).cells)


@query("grid_candidates", f"""{_TO_OUTCOME}, {SQL_CELLS}
SELECT {_CELL_COLUMNS} FROM cells WHERE reasons = '' ORDER BY entropy DESC, k, h LIMIT 12""")
def grid_candidates(spark, d):
    return _cell_output(run_grid(D.stored_bars(spark, d), GRID, D.DAY_CLOCK).candidates)


@query("forward_excursions", f"""{_TO_OUTCOME}
SELECT symbol, session, {sql_iso('entry_ts', 'entry_ts')}, count(*) AS path_bars, {sql_r6('max(up)', 'mfe')}, {sql_r6('min(dn)', 'mae')}
FROM paths WHERE age <= 60 GROUP BY symbol, session, entry_ts""")
def forward_excursions(spark, d):
    bars = D.stored_bars(spark, d)
    out = B.excursions(B.entries_with_atr(bars, D.DAY_CLOCK), bars, 60, D.DAY_CLOCK)
    return out.select("symbol", "session", iso("entry_ts"), "path_bars", r6("mfe"), r6("mae"))


def supplier_halts(spark, d):
    """Large returned shipments halt their supplier for as many days as the line's number; the last lines for good."""
    rows = D.table(spark, d, "lineitem").where((F.col("l_returnflag") == "R") & (F.col("l_quantity") > 48))
    start = F.col("l_shipdate").cast("timestamp")
    end = F.timestamp_micros(F.unix_micros(start) + F.col("l_linenumber").cast("bigint") * 86_400_000_000)
    return rows.select(F.concat(F.lit("S"), F.col("l_suppkey")).alias("symbol"), start.alias("halt_start_ts"),
                       F.when((F.col("l_linenumber") < 7) | (F.col("l_quantity") < 50), end).alias("halt_end_ts"))


@query("outcome_primitives", f"""{_TO_OUTCOME},
limits AS (SELECT symbol, session, entry_ts, ref, atr, min(age) FILTER (WHERE up >= 1.0) AS up_age, min(age) FILTER (WHERE -dn >= 1.0) AS dn_age,
                  max(age) AS last_age FROM paths WHERE age <= 60 GROUP BY ALL),
exits AS (SELECT *, CASE WHEN up_age IS NOT NULL AND (dn_age IS NULL OR up_age < dn_age) THEN 'PROFIT' WHEN dn_age IS NOT NULL THEN 'STOP' ELSE 'TIME' END AS barrier,
                 least(coalesce(up_age, last_age), coalesce(dn_age, last_age)) AS exit_age FROM limits),
walked AS (SELECT e.symbol, e.session, e.entry_ts, e.ref, e.atr, e.barrier, count(*) AS bars_to_exit, max(p.ts) AS exit_ts, max(p.up) AS mfe, min(p.dn) AS mae,
                  arg_max(p.ret, p.ts) AS end_ret FROM exits e JOIN paths p USING (symbol, session, entry_ts) WHERE p.age <= e.exit_age GROUP BY ALL),
halts AS (SELECT 'S' || l_suppkey AS symbol, CAST(l_shipdate AS TIMESTAMP) AS a,
          CASE WHEN l_linenumber < 7 OR l_quantity < 50 THEN CAST(l_shipdate AS TIMESTAMP) + to_days(CAST(l_linenumber AS INTEGER)) END AS b
          FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 48),
hit AS (SELECT DISTINCT w.symbol, w.session, w.entry_ts, TRUE AS halted FROM walked w JOIN halts h ON h.symbol = w.symbol AND h.a <= w.exit_ts AND (h.b IS NULL OR h.b > w.entry_ts))
SELECT symbol, session, {sql_iso('entry_ts', 'entry_ts')}, barrier, {sql_iso('exit_ts', 'exit_ts')}, bars_to_exit, {sql_r6('mfe', 'mfe')}, {sql_r6('mae', 'mae')},
  {sql_r6("CASE barrier WHEN 'PROFIT' THEN atr / ref WHEN 'STOP' THEN -atr / ref ELSE end_ret END", 'realized_return')}, coalesce(halted, FALSE) AS halt_affected
FROM walked LEFT JOIN hit USING (symbol, session, entry_ts)""")
def outcome_primitives(spark, d):
    """Exit, bars to exit, excursions up to the exit and halts on the way, for k = 1 and H = 60."""
    bars = D.stored_bars(spark, d)
    out = B.outcome_primitives(B.entries_with_atr(bars, D.DAY_CLOCK), bars, 1.0, 60, D.DAY_CLOCK, supplier_halts(spark, d))
    return out.select("symbol", "session", iso("entry_ts"), "barrier", iso("exit_ts"), "bars_to_exit", r6("mfe"), r6("mae"),
                      r6("realized_return"), "halt_affected")
