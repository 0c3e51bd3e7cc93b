"""Choice of a label cell over regime episodes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import barriers as B
from ..operators import rubric as R
from . import adapters as D
from .queries_bars import _TO_OUTCOME, GRID
from .registry import iso, query, r6, sql_iso, sql_r6

#: Daily bars of few suppliers lean to one side: bands widened by hand on this data, so that the selection is exercised.
DAILY = R.Rubric(min_class=0.10, min_entropy=0.70, time_band=(0.10, 0.65), min_ttr=3.0, max_side_gap=0.5, min_events=50,
                 max_entropy_range=0.3, max_time_range=0.3)


def order_regimes(spark, d):
    """One snapshot per order day; risk is ON in quarters where more than two of five orders are urgent or high."""
    o = D.table(spark, d, "orders").select(F.col("o_orderdate").cast("timestamp").alias("regime_ts"),
                                           F.col("o_orderpriority").isin("1-URGENT", "2-HIGH").cast("int").alias("up"))
    days = o.groupBy("regime_ts").agg(F.sum("up").alias("up"), F.count("*").alias("n")).withColumn(
        "quarter", F.date_trunc("quarter", "regime_ts"))
    quarters = days.groupBy("quarter").agg(F.when(F.sum("up") * 5 > F.sum("n") * 2, "ON").otherwise("OFF").alias("risk_state"))
    return days.join(quarters, "quarter").select("regime_ts", "risk_state")


def yearly_regimes(spark, d):
    """Long phases: one snapshot per order day, ON in even years."""
    days = D.table(spark, d, "orders").select(F.col("o_orderdate").cast("timestamp").alias("regime_ts")).distinct()
    return days.withColumn("risk_state", F.when(F.year("regime_ts") % 2 == 0, "ON").otherwise("OFF"))


_TURNS = """
turns AS (SELECT ts, state FROM (SELECT *, lag(state) OVER (ORDER BY ts) AS prev FROM snaps) WHERE state IS DISTINCT FROM prev),
episodes AS (SELECT row_number() OVER (ORDER BY ts) AS episode, state, ts AS start_ts, lead(ts) OVER (ORDER BY ts) AS end_ts FROM turns)"""
SQL_YEARS = f"""
snaps AS (SELECT DISTINCT CAST(o_orderdate AS TIMESTAMP) AS ts, CASE WHEN year(o_orderdate) % 2 = 0 THEN 'ON' ELSE 'OFF' END AS state FROM orders),{_TURNS}"""
SQL_EPISODES = f"""
quarters AS (SELECT date_trunc('quarter', o_orderdate) AS q,
                    CASE WHEN count(*) FILTER (WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')) * 5 > count(*) * 2 THEN 'ON' ELSE 'OFF' END AS state
             FROM orders GROUP BY 1),
snaps AS (SELECT DISTINCT CAST(o_orderdate AS TIMESTAMP) AS ts, state FROM orders JOIN quarters ON q = date_trunc('quarter', o_orderdate)),{_TURNS}"""


def _metrics(name: str, scope: str) -> str:
    """SQL of the rounded metrics per (scope, k, h)."""
    return f"""
{name}_ratio AS (SELECT {scope} AS scope, median(atr / spread) AS m
  FROM (SELECT DISTINCT symbol, session, entry_ts, atr, spread, episode FROM placed WHERE spread > 0) GROUP BY 1),
{name}_shares AS (SELECT {scope} AS scope, k, CAST(h AS BIGINT) AS h, count(*) AS n, count(*) FILTER (WHERE barrier = 'PROFIT') / count(*) AS p,
    count(*) FILTER (WHERE barrier = 'STOP') / count(*) AS s, count(*) FILTER (WHERE barrier = 'TIME') / count(*) AS t,
    coalesce(median(ttr) FILTER (WHERE barrier <> 'TIME'), h) AS ttr FROM placed WHERE {scope} IS NOT NULL GROUP BY {scope}, k, h),
{name} AS (SELECT scope, k, h, n, p, s, t, round(ttr, 6) AS ttr, coalesce(k * m, 0) AS spread_ratio, least(p, s, t) AS low,
    -(CASE WHEN p > 0 THEN p * ln(p) ELSE 0 END + CASE WHEN s > 0 THEN s * ln(s) ELSE 0 END + CASE WHEN t > 0 THEN t * ln(t) ELSE 0 END) / ln(3) AS entropy
  FROM {name}_shares LEFT JOIN {name}_ratio USING (scope))"""


def _flags(r: R.Rubric, ratio: float) -> dict[str, str]:
    return {"events": f"n < {r.min_events}", "degenerate": "(t > 0.7 OR low < 0.1 OR spread_ratio < 3)",
            "min_class": f"round(low, 6) < {r.min_class}", "entropy": f"round(entropy, 6) < {r.min_entropy}",
            "time_band": f"round(t, 6) NOT BETWEEN {r.time_band[0]} AND {r.time_band[1]}", "spread_ratio": f"round(spread_ratio, 6) < {ratio}",
            "ttr": f"(ttr < {r.min_ttr} OR ttr > round({r.max_ttr_share} * h, 6))", "side_gap": f"round(abs(p - s), 6) > {r.max_side_gap}"}


def _rubric_sql(r: R.Rubric, episodes: str = SQL_EPISODES) -> str:
    whole, inside = _flags(r, r.min_spread_ratio), _flags(r, r.episode_spread_ratio)
    names = ", ".join(f"CASE WHEN {c} THEN '{n}' END" for n, c in whole.items())
    counts = ", ".join(f"CASE WHEN count(*) FILTER (WHERE {c}) > 0 THEN 'episodes.{n}=' || count(*) FILTER (WHERE {c}) END" for n, c in inside.items())
    grid_k = ", ".join(f"({i}, CAST({k} AS DOUBLE))" for i, k in enumerate(sorted(GRID.k)))
    grid_h = ", ".join(f"({i}, {h})" for i, h in enumerate(sorted(GRID.h)))
    return f"""{_TO_OUTCOME}, {episodes},
placed AS (SELECT o.*, e.episode FROM outcome o ASOF LEFT JOIN episodes e ON o.entry_ts >= e.start_ts), {_metrics('w', '1')}, {_metrics('e', 'episode')},
over AS (SELECT k, h, count(*) AS episodes, round(max(entropy) - min(entropy), 6) AS er, round(max(t) - min(t), 6) AS tr, concat_ws(',', {counts}) AS failed FROM e GROUP BY k, h),
joined AS (SELECT w.*, coalesce(episodes, 0) AS episodes, er, tr, coalesce(failed, '') AS failed, concat_ws(',', {names}) AS names,
    concat_ws(',', CASE WHEN er > {r.max_entropy_range} THEN 'entropy_range' END, CASE WHEN tr > {r.max_time_range} THEN 'time_range' END) AS ranges,
    CASE WHEN coalesce(episodes, 0) < {r.min_episodes} THEN 'regime_diversity' ELSE '' END AS few FROM w LEFT JOIN over USING (k, h)),
staged AS (SELECT *, CASE WHEN {whole['events']} OR {whole['degenerate']} THEN 'DEGENERATE' WHEN names <> '' THEN 'BANDS'
    WHEN failed <> '' OR few <> '' THEN 'EPISODES' WHEN ranges <> '' THEN 'STABILITY' ELSE 'ACCEPTED' END AS stage FROM joined),
located AS (SELECT s.*, i, j FROM staged s JOIN (VALUES {grid_k}) a(i, gk) ON gk = k JOIN (VALUES {grid_h}) b(j, gh) ON gh = h),
near AS (SELECT x.k, x.h, round(avg(CASE WHEN y.stage = 'ACCEPTED' THEN 1.0 ELSE 0.0 END), 6) AS plateau
         FROM located x JOIN located y ON abs(x.i - y.i) + abs(x.j - y.j) = 1 GROUP BY 1, 2),
ranked AS (SELECT s.*, coalesce(plateau, 0) AS plateau, row_number() OVER (PARTITION BY stage = 'ACCEPTED'
    ORDER BY er, tr, round(entropy, 6) DESC, round(spread_ratio, 6) DESC, coalesce(plateau, 0) DESC, h, k) AS place FROM staged s LEFT JOIN near USING (k, h))
SELECT k, h, n, episodes, {sql_r6('coalesce(er, -1)', 'entropy_range')}, {sql_r6('coalesce(tr, -1)', 'time_range')}, {sql_r6('plateau', 'plateau')}, stage,
  concat_ws(',', nullif(names, ''), nullif(failed, ''), nullif(ranges, ''), nullif(few, '')) AS refusals, CASE WHEN stage = 'ACCEPTED' THEN place ELSE 0 END AS rank,
  CASE WHEN max(episodes) OVER () < {r.min_episodes} THEN 'REGIME_DIVERSITY' WHEN bool_or(stage = 'ACCEPTED') OVER () THEN 'SELECTED'
       WHEN bool_or(stage = 'STABILITY') OVER () THEN 'NO_STABLE_CELL' ELSE 'NO_CELL_PASSES' END AS outcome, stage = 'ACCEPTED' AND place = 1 AS selected
FROM ranked"""


def _chosen(spark, d, rubric: R.Rubric, regimes):
    bars = D.stored_bars(spark, d)
    touches = B.first_touches(B.entries_with_atr(bars, D.DAY_CLOCK), bars, GRID, D.DAY_CLOCK)
    out = R.choose_cell(touches, regimes, "regime_ts", "risk_state", GRID, rubric, D.DAY_CLOCK)
    out = out.fillna({"entropy_range": -1.0, "time_range": -1.0, "rank": 0})
    return out.select("k", F.col("h").cast("bigint").alias("h"), "n", "episodes", r6("entropy_range"), r6("time_range"), r6("plateau"), "stage",
                      F.concat_ws(",", "refusals").alias("refusals"), F.col("rank").cast("bigint").alias("rank"), "outcome", "selected")


@query("regime_episodes", f"""WITH {SQL_EPISODES}
SELECT episode, state, {sql_iso('start_ts', 'start_ts')}, coalesce({sql_iso('end_ts')}, '') AS end_ts FROM episodes""")
def regime_episodes(spark, d):
    out = R.regime_episodes(order_regimes(spark, d), "regime_ts", "risk_state")
    return out.select("episode", "state", iso("start_ts"), F.coalesce(iso("end_ts"), F.lit("")).alias("end_ts"))


@query("grid_rubric", _rubric_sql(R.Rubric()))
def grid_rubric(spark, d):
    """The standing limits: every cell with its refusals, and at most one selected."""
    return _chosen(spark, d, R.Rubric(), order_regimes(spark, d))


@query("grid_rubric_daily", _rubric_sql(DAILY, SQL_YEARS))
def grid_rubric_daily(spark, d):
    """Bands for daily bars over yearly phases."""
    return _chosen(spark, d, DAILY, yearly_regimes(spark, d))
