import random
from datetime import timedelta

from pyspark.sql import functions as F

from chronotape.operators import bars as A
from chronotape.operators import barriers as B
from conftest import minute_bars, utc

T0 = utc("2025-03-03T15:00:00")


def resolve(spark, minutes, ups, downs, rets, k=1.0, h=15):
    """An entry with ref 10 and ATR 1; ups / downs are per-bar excursions in ATR units."""
    entries = spark.createDataFrame(
        [("A", "d", T0, T0 + timedelta(hours=5), 10.0, 0.02, 1.0)],
        "symbol string, session string, entry_ts timestamp, session_close timestamp, ref double, spread double, atr double")
    bars = spark.createDataFrame(
        [("A", "d", T0 + timedelta(minutes=m), 10.0 + u, 10.0 + dn, 10.0 * (1 + r)) for m, u, dn, r in zip(minutes, ups, downs, rets)],
        "symbol string, session string, ts timestamp, high double, low double, close double")
    return B.outcomes(B.first_touches(entries, bars, B.Grid((k,), (h, 240)))).where(F.col("h") == h).head()


def test_same_bar_is_stop(spark):
    assert resolve(spark, [1], [2], [-2], [0]).barrier == "STOP"


def test_profit_first(spark):
    out = resolve(spark, [1, 2, 3], [.5, 1, 1], [-.2, -.5, -1], [0, 0, 0])
    assert (out.barrier, out.ttr) == ("PROFIT", 2.0)


def test_horizon_cap(spark):
    out = resolve(spark, [10, 20, 30], [.3, .6, 5], [-.1, -.2, -.3], [.01, .02, .5])
    assert (out.barrier, out.ttr, round(out.realized_return, 9)) == ("TIME", 10.0, 0.01)


def test_no_bar_inside_horizon(spark):
    out = resolve(spark, [20], [5], [0], [.1])
    assert (out.barrier, out.ttr, out.realized_return) == ("TIME", 15.0, 0.0)


def walk(seed, n=300, missing=0.1):
    rnd = random.Random(seed)
    price, rows = 10.0, []
    for i in range(n):
        o = price
        price = max(1.0, price + rnd.gauss(0, 0.03))
        hi, lo = max(o, price) + rnd.random() * 0.02, min(o, price) - rnd.random() * 0.02
        if rnd.random() >= missing:
            rows.append((i, o, hi, lo, price))
    return rows


def frame(spark, rows, session="2025-03-03"):
    # 12:30 UTC is 08:30 in New York: an hour of pre-market, then regular hours.
    t0 = utc("2025-03-03T13:30:00")
    data = [("A", session, i, t0 + timedelta(minutes=i), o, h, lo, c, 100, c - 0.01, c + 0.01) for i, o, h, lo, c in rows]
    return A.mark_session(spark.createDataFrame(data, "symbol string, session string, seq bigint, ts timestamp, open double, "
                                                      "high double, low double, close double, volume bigint, bid double, ask double"))


def naive_atr(rows, entry):
    """ATR from first principles: only bars before the entry, 5-minute right-closed buckets."""
    buckets = {}
    for i, _, h, lo, c in rows:
        if i < entry:
            end = -(-i // 5) * 5
            b = buckets.setdefault(end, [h, lo, c])
            b[0], b[1], b[2] = max(b[0], h), min(b[1], lo), c
    bars = [buckets[e] for e in sorted(buckets) if e <= entry]
    if len(bars) < 15:
        return None
    tr = [max(h - lo, abs(h - p[2]), abs(lo - p[2])) for p, (h, lo, _) in zip(bars, bars[1:])]
    atr = sum(tr[:14]) / 14
    for x in tr[14:]:
        atr = (atr * 13 + x) / 14
    return atr


def test_atr_and_outcomes_match_naive(spark):
    rows = walk(5)
    bars = frame(spark, rows)
    grid = B.Grid((0.5, 1.0, 2.0), (15, 60, 120))
    entries = B.entries_with_atr(bars).collect()
    t0 = bars.agg(F.min("ts")).head()[0].timestamp() - rows[0][0] * 60
    minute = lambda ts: round((ts.timestamp() - t0) / 60)
    positions = [r for r in rows if r[0] >= 60][::5]
    assert [minute(e.entry_ts) for e in sorted(entries, key=lambda e: e.entry_ts)] == [r[0] for r in positions]
    atrs = {}
    for e in entries:
        want = naive_atr(rows, minute(e.entry_ts))
        assert (e.atr is None) == (want is None)
        if want is not None:
            assert abs(e.atr - want) < 1e-12
            atrs[minute(e.entry_ts)] = want
    assert atrs
    got = {(minute(o.entry_ts), o.k, o.h): (o.barrier, o.ttr) for o in B.outcomes(
        B.first_touches(B.entries_with_atr(bars), bars, grid)).collect()}
    price = {r[0]: r for r in rows}
    checked = 0
    for e, atr in atrs.items():
        ref = price[e][4]
        path = [r for r in rows if e < r[0] <= e + 120]
        for k in grid.k:
            for h in grid.h:
                seen = [r for r in path if r[0] - e <= h]
                if not path:
                    continue
                want = ("TIME", float(seen[-1][0] - e) if seen else float(h))
                for r in seen:
                    if (r[3] - ref) / atr <= -k:
                        want = ("STOP", float(r[0] - e))
                        break
                    if (r[2] - ref) / atr >= k:
                        want = ("PROFIT", float(r[0] - e))
                        break
                assert got[(e, k, h)] == want
                checked += 1
    assert checked > 100 and {b for b, _ in got.values()} == {"TIME", "STOP", "PROFIT"}


def test_atr_ignores_entry_bar_and_future(spark):
    rows = walk(7, missing=0)
    cut = 200
    wild = [(i, o, h * 100, lo * 100, c * 100) if i >= cut else (i, o, h, lo, c) for i, o, h, lo, c in rows]
    pick = lambda bars: B.entries_with_atr(bars).where(F.col("entry_ts") == F.lit(utc("2025-03-03T13:30:00") + timedelta(minutes=cut))).head().atr
    assert abs(pick(frame(spark, rows)) - pick(frame(spark, wild))) < 1e-9


def test_wider_barrier_times_out_more_and_empty_cells(spark):
    bars = frame(spark, walk(9))
    grid = B.Grid((0.5, 2.0), (60,))
    cells = {c.k: c for c in B.cell_metrics(B.first_touches(B.entries_with_atr(bars), bars, grid), grid).collect()}
    assert cells[2.0].time_pct >= cells[0.5].time_pct
    none = B.cell_metrics(B.first_touches(B.entries_with_atr(bars), bars.where("false"), grid), grid).collect()
    assert [(c.n, c.degenerate_reasons) for c in none] == [(0, ["no_samples"])] * 2


def test_run_stats(spark):
    bars = frame(spark, walk(5))
    spine = spark.createDataFrame([("A", "2025-03-03"), ("A", "2025-03-04")], "symbol string, session string")
    e = B.entries_with_atr(bars)
    s = B.run_stats(spine, bars, e, B.first_touches(e, bars)).head()
    assert (s.symbol_days, s.empty_days) == (2, 1)
    assert s.entries + s.skipped_atr + s.skipped_path == e.count()


def test_resample_edges(spark):
    bars = minute_bars(spark, [10, 11, 12, 13, 14, 15], start="2025-03-03T15:00:00")
    out = {r.bucket_end.minute: (r.high, r.open_high) for r in A.resample(bars).collect()}
    assert out == {0: (10.0, None), 5: (15.0, 14.0)}


def test_primitives_match_naive_path(spark):
    rows = walk(13)
    bars = frame(spark, rows)
    entries = B.entries_with_atr(bars)
    t0 = utc("2025-03-03T13:30:00")
    minute = lambda ts: round((ts.timestamp() - t0.timestamp()) / 60)
    rnd = random.Random(3)
    halts = [(rnd.randrange(60, 290), rnd.choice([None, 1, 2, 5]) if i else 1) for i in range(6)]
    halts = [(a, None if n is None and a < 250 else a + (n or 1)) for a, n in halts if n or a > 250]
    frame_of = lambda hs: spark.createDataFrame(
        [("A", t0 + timedelta(minutes=a), b and t0 + timedelta(minutes=b)) for a, b in hs],
        "symbol string, halt_start_ts timestamp, halt_end_ts timestamp")
    out = B.outcome_primitives(entries, bars, 1.0, 30, halts=frame_of(halts)).collect()
    known = {minute(e.entry_ts): (e.ref, e.atr) for e in entries.collect() if e.atr is not None}
    assert out and {minute(o.entry_ts) for o in out} <= set(known)
    affected = set()
    for o in out:
        e = minute(o.entry_ts)
        ref, atr = known[e]
        path, seen, barrier = [r for r in rows if e < r[0] <= e + 30], [], "TIME"
        for r in path:
            seen.append(r)
            if (r[3] - ref) / atr <= -1:
                barrier = "STOP"
                break
            if (r[2] - ref) / atr >= 1:
                barrier = "PROFIT"
                break
        price = {"PROFIT": ref + atr, "STOP": ref - atr, "TIME": seen[-1][4]}[barrier]
        exit_minute = seen[-1][0]
        halted = any(a <= exit_minute and (b is None or b > e) for a, b in halts)
        affected.add(halted)
        assert (o.barrier, minute(o.exit_ts), o.bars_to_exit, o.halt_affected) == (barrier, exit_minute, len(seen), halted)
        assert (o.exit_price, o.path_max, o.path_min) == (price, max(r[2] for r in seen), min(r[3] for r in seen))
    assert affected == {True, False}
    assert B.outcome_primitives(entries, bars.where("false"), 1.0, 30).count() == 0


def test_no_rows_of_entries_and_bars(spark):
    bars = frame(spark, walk(5))
    for df in (B.first_touches(B.entries_with_atr(bars), bars), B.excursions(B.entries_with_atr(bars), bars, 60)):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        # The only joins belong to the ATR of the entries; paths meet them by grouping.
        assert "_t#" not in plan and "collect_list(_bar" in plan


def test_grid_stats_make_the_atr_once(spark):
    """The counts read stored entries; nothing resamples bars again for them."""
    from chronotape.plans import catalog
    out = catalog.QUERIES["grid_stats"](spark, "/root/testdata/sf0.001")
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "max_by" not in plan and out.count() == 1
