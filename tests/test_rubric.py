import random
from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from chronotape.operators import rubric as R
from chronotape.operators.barriers import Grid
from conftest import utc

T0 = utc("2025-03-03T00:00:00")
GRID = Grid((1.0, 2.0), (30, 60))
METRICS = ("k double, h int, n bigint, profit_pct double, stop_pct double, time_pct double, median_ttr double, "
           "barrier_spread_ratio double, min_class_fraction double, class_entropy double, degenerate boolean")
GOOD = dict(n=1000, profit_pct=0.35, stop_pct=0.35, time_pct=0.3, median_ttr=15.0, barrier_spread_ratio=5.0,
            min_class_fraction=0.3, class_entropy=0.95, degenerate=False)


def cells(spark, changes=None, episodes=None):
    """All four cells with good metrics, but for `changes` by (k, h) or, with episodes, by (k, h, episode)."""
    rows, changes = [], changes or {}
    for k in GRID.k:
        for h in GRID.h:
            for e in episodes or [None]:
                key = (k, h) if episodes is None else (k, h, e)
                m = {**GOOD, **changes.get(key, {})}
                rows.append((k, h, *m.values()) + (() if episodes is None else (e,)))
    return spark.createDataFrame(rows, METRICS + ("" if episodes is None else ", episode bigint"))


def verdict(spark, whole=None, inside=None, episodes=(1, 2, 3)):
    out = R.judge(cells(spark, whole), cells(spark, inside, list(episodes)), GRID)
    return {(r.k, r.h): r for r in out.collect()}


def brute_episodes(snaps):
    at = {}
    for ts, state, tie in snaps:
        if ts is not None and (ts not in at or at[ts][0] < (tie, state)):
            at[ts] = ((tie, state), state)
    out, last = [], object()
    for ts in sorted(at):
        if at[ts][1] != last:
            last = at[ts][1]
            out.append([len(out) + 1, last, ts, None])
            if len(out) > 1:
                out[-2][3] = ts
    return [tuple(x) for x in out]


@pytest.mark.parametrize("max_rows", [5, 500])
def test_episodes_against_brute_force(spark, max_rows):
    rnd = random.Random(max_rows)
    snaps = [(T0 + timedelta(minutes=rnd.randrange(120)), rnd.choice("AAAB"), i) for i in range(150)] + [(None, "A", 999)]
    df = spark.createDataFrame(snaps, "ts timestamp, state string, id int")
    got = R.regime_episodes(df, "ts", "state", tie=["id"], max_rows=max_rows).orderBy("episode")
    stamp = [F.unix_micros(c).alias(c) for c in ("start_ts", "end_ts")]
    micros = lambda t: None if t is None else round(t.timestamp() * 1e6)
    assert [tuple(r) for r in got.select("episode", "state", *stamp).collect()] == [
        (n, s, micros(a), micros(b)) for n, s, a, b in brute_episodes(snaps)]


def test_episodes_null_state_and_empty(spark):
    schema = "ts timestamp, state string"
    df = spark.createDataFrame([(T0, None), (T0 + timedelta(1), None), (T0 + timedelta(2), "A"), (T0 + timedelta(3), None)], schema)
    assert [(r.episode, r.state) for r in R.regime_episodes(df, "ts", "state").orderBy("episode").collect()] == [(1, None), (2, "A"), (3, None)]
    assert R.regime_episodes(spark.createDataFrame([], schema), "ts", "state").count() == 0


def test_entries_get_their_episode(spark):
    eps = R.regime_episodes(spark.createDataFrame([(T0, "A"), (T0 + timedelta(2), "B")], "ts timestamp, state string"), "ts", "state")
    rows = spark.createDataFrame([(i, T0 + timedelta(d)) for i, d in enumerate((-1, 0, 1, 2, 9))], "id int, at timestamp")
    assert [r.episode for r in R.in_episodes(rows, eps, "at").orderBy("id").collect()] == [None, 1, 1, 2, 2]


def test_parsimony_breaks_ties(spark):
    got = verdict(spark)
    assert {c: r.rank for c, r in got.items()} == {(1.0, 30): 1, (2.0, 30): 2, (1.0, 60): 3, (2.0, 60): 4}
    assert [c for c, r in got.items() if r.selected] == [(1.0, 30)] and got[(1.0, 30)].outcome == "SELECTED"
    assert all(r.plateau == 1.0 and not r.refusals for r in got.values())


def test_stability_before_balance_before_spread(spark):
    got = verdict(spark, {(2.0, 60): dict(barrier_spread_ratio=9.0), (1.0, 60): dict(class_entropy=0.99), (2.0, 30): dict(class_entropy=0.90)},
                  {(1.0, 30, 2): dict(class_entropy=0.91)})
    assert {c: r.rank for c, r in got.items()} == {(1.0, 60): 1, (2.0, 60): 2, (2.0, 30): 3, (1.0, 30): 4}


def test_every_refusal_is_named(spark):
    got = verdict(spark, {(1.0, 30): dict(n=99), (1.0, 60): dict(time_pct=0.46, stop_pct=0.2)},
                  {(2.0, 30, 1): dict(median_ttr=24.5), (2.0, 30, 3): dict(median_ttr=4.0), (2.0, 60, 2): dict(time_pct=0.45),
                   (2.0, 60, 3): dict(time_pct=0.29)})
    assert (got[(1.0, 30)].stage, got[(1.0, 30)].refusals) == ("DEGENERATE", ["events"])
    assert (got[(1.0, 60)].stage, got[(1.0, 60)].refusals) == ("BANDS", ["time_band", "side_gap"])
    assert (got[(2.0, 30)].stage, got[(2.0, 30)].refusals) == ("EPISODES", ["episodes.ttr=2"])
    assert (got[(2.0, 60)].stage, got[(2.0, 60)].refusals) == ("STABILITY", ["time_range"])
    assert {r.outcome for r in got.values()} == {"NO_STABLE_CELL"} and not any(r.selected for r in got.values())


def test_limits_are_inclusive_and_episodes_use_the_floor(spark):
    edge = dict(median_ttr=24.0, time_pct=0.45, class_entropy=0.85, min_class_fraction=0.15, barrier_spread_ratio=4.0, n=100)
    got = verdict(spark, {(1.0, 30): edge}, {(1.0, 30, e): {**edge, "barrier_spread_ratio": 3.0} for e in (1, 2, 3)})
    assert got[(1.0, 30)].stage == "ACCEPTED"


def test_diversity_and_nothing_passes(spark):
    few = verdict(spark, episodes=(1, 2))
    assert {r.outcome for r in few.values()} == {"REGIME_DIVERSITY"} and {r.stage for r in few.values()} == {"EPISODES"}
    bad = {(k, h): dict(degenerate=True) for k in GRID.k for h in GRID.h}
    assert {r.outcome for r in verdict(spark, bad).values()} == {"NO_CELL_PASSES"}


def test_plateau_counts_accepted_neighbours(spark):
    got = verdict(spark, {(2.0, 60): dict(degenerate=True)})
    assert {c: r.plateau for c, r in got.items()} == {(1.0, 30): 1.0, (2.0, 30): 0.5, (1.0, 60): 0.5, (2.0, 60): 1.0}
    assert got[(1.0, 30)].rank == 1 and got[(2.0, 60)].rank is None


def counted(df):
    """The same rows, and a number that grows with each row whenever the frame is computed."""
    seen = df.sparkSession.sparkContext.accumulator(0)

    def run(batches):
        for b in batches:
            seen.add(len(b))
            yield b
    return df.mapInArrow(run, df.schema), seen


def test_touches_and_entries_are_computed_once(spark):
    """The search for touches is costly: what reads its rows several times must read stored ones."""
    from conftest import minute_bars
    from chronotape.operators import barriers as B
    from chronotape.operators import rubric as R
    rnd = random.Random(4)
    closes = [100 + rnd.random() for _ in range(390)]
    bars = minute_bars(spark, closes, highs=[c + rnd.random() for c in closes], lows=[c - rnd.random() for c in closes])
    entries = B.entries_with_atr(bars).where("atr IS NOT NULL").persist()
    grid = B.Grid(k=(0.5, 1.0), h=(15, 30))
    touches, seen = counted(B.first_touches(entries, bars, grid).persist())
    snapshots = bars.select(F.col("ts").alias("at"), F.when(F.col("seq") < 200, "ON").otherwise("OFF").alias("state"))
    assert R.choose_cell(touches, snapshots, "at", "state", grid).count() == 4 and seen.value == B.first_touches(entries, bars, grid).count() > 50
    again, seen = counted(entries)
    halts = bars.where("seq = 100").select("symbol", F.col("ts").alias("halt_start_ts"), F.col("ts").alias("halt_end_ts"))
    B.outcome_primitives(again, bars, 1.0, 30, halts=halts).collect()
    assert seen.value == entries.count()
