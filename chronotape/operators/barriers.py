"""Triple-barrier outcomes on a (k, H) grid and the label properties of each cell."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.times import seconds_between
from ..session import cut_lineage
from .asof import Highest, asof_fold
from .bars import MINUTE, SESSION, BarClock, atr_at, sample_entries
from .paths import bars_until, extreme_between, first_reaching, let, sparse_table, with_session_arrays
from .stats import exact_median

# Barrier multiples, horizons (in bars) and the guards of a usable cell.
K_GRID = (0.5, 0.75, 1.0, 1.25, 1.5, 2.0)
H_GRID = (15, 30, 60, 90, 120, 240)
MAX_TIME_FRACTION = 0.70
MIN_CLASS_FRACTION = 0.10
MIN_BARRIER_SPREAD_RATIO = 3.0
TOP_CELLS = 12


@dataclass(frozen=True)
class Grid:
    k: tuple[float, ...] = K_GRID
    h: tuple[int, ...] = H_GRID


def entries_with_atr(bars: DataFrame, clock: BarClock = MINUTE) -> DataFrame:
    """Sampled entries with reference price, spread and point-in-time ATR (NULL when not warm)."""
    sampled = sample_entries(bars, clock)
    return atr_at(sampled, bars, clock).select(
        *SESSION, F.col("ts").alias("entry_ts"), "session_close",
        F.col("close").alias("ref"), (F.col("ask") - F.col("bid")).alias("spread"), "atr")


def _path_limits(bars: Column, entry: Column, horizon: int, clock: BarClock) -> Column:
    """Struct of the bars up to the entry (a) and up to the end of its path (b), as counts."""
    reach = F.least(F.unix_micros(entry["entry_ts"]) + horizon * clock.unit_seconds * 1_000_000,
                    F.unix_micros(entry["session_close"]))
    return F.struct(bars_until(bars, F.unix_micros(entry["entry_ts"])).alias("a"), bars_until(bars, reach).alias("b"))


def _tables(bars: Column, reach: int) -> Column:
    """Sparse tables of the highs and of the negated lows."""
    return F.struct(sparse_table(F.transform(bars, lambda x: x["high"]), reach).alias("up"),
                    sparse_table(F.transform(bars, lambda x: x["fall"]), reach).alias("down"))


def _searched(entries: DataFrame, bars: DataFrame, reach: int, clock: BarClock,
              result: Callable[[Column, Column, Column, Column, Column], Column]) -> DataFrame:
    """Per session and entry with a path of at most `reach` bars: `result`(bars, tables, entry, a, b)."""
    fields = ["entry_ts", "session_close", *[c for c in ("ref", "spread", "atr") if c in entries.columns]]
    rows = with_session_arrays(entries.where(F.col("atr").isNotNull()), bars, fields)
    path = F.col("_bars")

    def per_entry(tables: Column) -> Column:
        found = F.transform("_entries", lambda e: let(_path_limits(path, e, reach, clock), lambda w: F.when(
            w["b"] > w["a"], result(path, tables, e, w["a"], w["b"]))))
        return F.array_compact(found)
    return rows.select(*SESSION, F.inline(let(_tables(path, reach), per_entry)))


def _reaches(tables: Column, side: str, entry: Column, k: Column, a: Column, b: Column) -> Column:
    """Place of the first bar whose high (or low) is k ATR away from the reference, or b."""
    ref = entry["ref"] if side == "up" else -entry["ref"]
    return first_reaching(tables[side], a, b, lambda x: (x - ref) / entry["atr"] < k)


def first_touches(entries: DataFrame, bars: DataFrame, grid: Grid = Grid(), clock: BarClock = MINUTE) -> DataFrame:
    """One row per entry that has a forward path.

    Per k: time of the first bar touching the upper / lower barrier, found in sparse tables of the
    session's highs and lows. Per H: last bar within the horizon. Bars and entries of a session meet
    in one row (`paths`); no pairs of entries and bars are formed.
    """
    unit = clock.unit_seconds * 1_000_000

    def result(path: Column, tables: Column, e: Column, a: Column, b: Column) -> Column:
        def touch(k: Column) -> Column:
            up, down = _reaches(tables, "up", e, k, a, b), _reaches(tables, "down", e, k, a, b)
            return F.struct(k.alias("k"), F.when(up < b, F.get(path, up)["t"]).alias("up_ts"),
                            F.when(down < b, F.get(path, down)["t"]).alias("dn_ts"))

        def horizon(h: Column) -> Column:
            upto = bars_until(path, F.unix_micros(e["entry_ts"]) + h.cast("bigint") * unit)
            last = let(F.least(upto, b), lambda n: F.when(n > a, F.get(path, n - 1)))
            return let(last, lambda x: F.struct(h.alias("h"), x["t"].alias("last_ts"), x["close"].alias("end_close")))
        return F.struct(*[e[c].alias(c) for c in ("entry_ts", "ref", "spread", "atr")],
                        F.transform(F.array(*[F.lit(float(k)) for k in grid.k]), touch).alias("touches"),
                        F.transform(F.array(*[F.lit(int(h)) for h in grid.h]), horizon).alias("horizons"))
    return _searched(entries, bars, max(grid.h), clock, result)


def decide(clock: BarClock = MINUTE) -> dict[str, Column]:
    """Outcome columns of one (k, h) row with up_ts, dn_ts, last_ts, end_close, entry_ts, ref, atr."""
    last = F.col("last_ts")
    up = F.when(F.col("up_ts") <= last, F.col("up_ts"))
    dn = F.when(F.col("dn_ts") <= last, F.col("dn_ts"))
    # The same bar touching both sides is a stop.
    profit = up.isNotNull() & (dn.isNull() | (up < dn))
    stop = dn.isNotNull() & (up.isNull() | (dn <= up))
    move = F.col("k") * F.col("atr") / F.col("ref")

    def age(ts: Column) -> Column:
        return seconds_between(ts, F.col("entry_ts")) / float(clock.unit_seconds)

    return {
        "barrier": F.when(profit, "PROFIT").when(stop, "STOP").otherwise("TIME"),
        "ttr": F.when(profit, age(up)).when(stop, age(dn)).when(last.isNotNull(), age(last))
                .otherwise(F.col("h").cast("double")),
        "realized_return": F.when(profit, move).when(stop, -move)
                            .when(last.isNotNull(), (F.col("end_close") - F.col("ref")) / F.col("ref"))
                            .otherwise(0.0),
        "barrier_distance": F.col("k") * F.col("atr"),
    }


def outcomes(touches: DataFrame, clock: BarClock = MINUTE) -> DataFrame:
    """One row per (entry, k, h) with barrier, time to resolution, return and distance."""
    rows = (touches
            .select(*[c for c in touches.columns if c != "touches"], F.inline("touches"))
            .select(*[c for c in touches.columns if c not in ("touches", "horizons")],
                    "k", "up_ts", "dn_ts", F.inline("horizons")))
    made = decide(clock)
    return rows.select(*SESSION, "entry_ts", "k", "h", *[c.alias(n) for n, c in made.items()], "spread", "atr", "ref")


def _entropy(*shares: Column) -> Column:
    total = F.lit(0.0)
    for s in shares:
        total = total + F.when(s > 0, s * F.log(s)).otherwise(0.0)
    return -total / F.log(F.lit(3.0))


def cell_metrics(touches: DataFrame, grid: Grid = Grid(), clock: BarClock = MINUTE,
                 by: Sequence[str] = ()) -> DataFrame:
    """Label properties per (k, h): class shares, medians, balance and guard flags.

    Class counts use partial aggregation. Resolution time is counted per distinct value
    (whole bars up to the horizon) before its median. The median of k*ATR/spread is k times
    the median of ATR/spread over entries, so it is found once, not once per cell. `by` adds
    grouping columns of `touches`; without it empty cells are kept with `no_samples`.
    """
    by = list(by)
    spread_ratio = exact_median(touches.where(F.col("spread") > 0), by, F.col("atr") / F.col("spread")).select(
        *by, F.col("median").alias("_ratio"))
    made = decide(clock)
    cell = [*by, "k", "h"]
    rows = (touches.select(*by, "entry_ts", "ref", "atr", F.col("horizons"), F.inline("touches"))
            .select(*by, "entry_ts", "ref", "atr", "k", "up_ts", "dn_ts", F.inline("horizons"))
            .select(*cell, *[made[n].alias(n) for n in ("barrier", "ttr", "realized_return")]))
    # (cell, barrier, ttr, sign) is a small domain: everything below works on counts.
    counts = rows.groupBy(*cell, "barrier", "ttr", F.signum("realized_return").alias("sign")).agg(
        F.count("*").alias("n"))
    barrier, n = F.col("barrier"), F.col("n")

    def total(cond: Column) -> Column:
        return F.sum(F.when(cond, n).otherwise(0))

    base = counts.groupBy(*cell).agg(
        F.sum("n").alias("n"),
        total(barrier == "PROFIT").alias("_p"), total(barrier == "STOP").alias("_s"),
        total(barrier == "TIME").alias("_t"),
        total((barrier == "TIME") & (F.col("sign") > 0)).alias("_tp"),
        total((barrier == "TIME") & (F.col("sign") < 0)).alias("_tn"),
        F.expr("percentile(case when barrier <> 'TIME' then ttr end, 0.5, "
               "case when barrier <> 'TIME' then n else 0 end)").alias("_ttr"))
    if by:
        joined = base.join(spread_ratio, by, "left")
    else:
        joined = (base.withColumn("_one", F.lit(1))
                  .join(F.broadcast(spread_ratio.withColumn("_one", F.lit(1))), "_one", "left").drop("_one"))
        cells = touches.sparkSession.createDataFrame([(float(k), h) for k in grid.k for h in grid.h], "k double, h int")
        joined = cells.join(joined, ["k", "h"], "left")
    n_all = F.coalesce(F.col("n"), F.lit(0))
    joined = joined.withColumn("n", n_all)

    def share(name: str, of: str = "n") -> Column:
        return F.when(F.col(of) > 0, F.col(name) / F.col(of)).otherwise(0.0)

    shares = joined.select(
        *cell, "n", share("_p").alias("profit_pct"), share("_s").alias("stop_pct"), share("_t").alias("time_pct"),
        F.when(F.col("n") == 0, 0.0).otherwise(F.coalesce(F.col("_ttr"), F.col("h").cast("double"))).alias("median_ttr"),
        F.when(F.col("n") == 0, 0.0).otherwise(F.coalesce(F.col("_ratio") * F.col("k"), F.lit(0.0)))
         .alias("barrier_spread_ratio"),
        share("_tp", "_t").alias("time_pos_pct"), share("_tn", "_t").alias("time_neg_pct"),
        F.when(F.col("_t") > 0, (F.col("_t") - F.col("_tp") - F.col("_tn")) / F.col("_t")).otherwise(0.0)
         .alias("time_flat_pct"))
    p, s, t = F.col("profit_pct"), F.col("stop_pct"), F.col("time_pct")
    reasons = F.when(F.col("n") == 0, F.array(F.lit("no_samples"))).otherwise(F.array_compact(F.array(
        F.when(t > MAX_TIME_FRACTION, f"time%>{MAX_TIME_FRACTION:.0%}"),
        F.when(F.least(p, s, t) < MIN_CLASS_FRACTION, f"min_class<{MIN_CLASS_FRACTION:.0%}"),
        F.when(F.col("barrier_spread_ratio") < MIN_BARRIER_SPREAD_RATIO,
               f"barrier/spread<{MIN_BARRIER_SPREAD_RATIO:g}"))))
    return shares.withColumns({
        "min_class_fraction": F.least(p, s, t),
        "class_entropy": F.when(F.col("n") > 0, _entropy(p, s, t)).otherwise(0.0),
        "degenerate_reasons": reasons,
    }).withColumn("degenerate", F.size("degenerate_reasons") > 0)


def usable_cells(cells: DataFrame, top: int = TOP_CELLS) -> DataFrame:
    """Non-degenerate cells, most balanced first; grid order breaks ties."""
    return cells.where(~F.col("degenerate")).orderBy(F.desc("class_entropy"), "k", "h").limit(top)


def run_stats(spine: DataFrame, bars: DataFrame, entries: DataFrame, touches: DataFrame) -> DataFrame:
    """One row: sampled sessions, empty ones, resolved entries, entries without ATR, without a path."""
    days = spine.select(*SESSION).distinct().join(
        bars.select(*SESSION).distinct().withColumn("_has", F.lit(1)), SESSION, "left")
    d = days.agg(F.count("*").alias("symbol_days"), F.sum(F.when(F.col("_has").isNull(), 1).otherwise(0)).alias("empty_days"))
    e = entries.agg(F.count("*").alias("_all"), F.count("atr").alias("_warm"))
    o = touches.agg(F.count("*").alias("entries"))
    one = F.lit(1).alias("_one")
    joined = (d.select("*", one).join(F.broadcast(e.select("*", one)), "_one")
              .join(F.broadcast(o.select("*", one)), "_one"))
    return joined.select(
        "entries", (F.col("_all") - F.col("_warm")).alias("skipped_atr"),
        (F.col("_warm") - F.col("entries")).alias("skipped_path"), "symbol_days", "empty_days")


def excursions(entries: DataFrame, bars: DataFrame, horizon: int, clock: BarClock = MINUTE) -> DataFrame:
    """Largest favourable / adverse excursion within the horizon, in ATR units, and bars seen."""
    def result(path: Column, tables: Column, e: Column, a: Column, b: Column) -> Column:
        return F.struct(e["entry_ts"].alias("entry_ts"), e["ref"].alias("ref"), e["atr"].alias("atr"),
                        extreme_between(tables["up"], a, b).alias("path_max"),
                        (-extreme_between(tables["down"], a, b)).alias("path_min"), (b - a).cast("bigint").alias("path_bars"))
    return _searched(entries, bars, horizon, clock, result).withColumns(
        {"mfe": (F.col("path_max") - F.col("ref")) / F.col("atr"), "mae": (F.col("path_min") - F.col("ref")) / F.col("atr")})


def outcome_primitives(entries: DataFrame, bars: DataFrame, k: float, horizon: int, clock: BarClock = MINUTE,
                       halts: DataFrame | None = None) -> DataFrame:
    """What happened to each entry under one (k, H): barrier, exit, bars to exit and the path up to the exit.

    barrier, exit_ts, exit_price, bars_to_exit, realized_return, path_max, path_min, mfe and mae (ATR units). With
    `halts` (symbol, halt_start_ts, halt_end_ts; NULL end: ongoing) also `halt_affected`: some halt overlaps the time
    from entry to exit. That holds exactly when the latest end among the halts started by the exit is after the
    entry, so outcomes and halts are not paired.
    """
    def result(path: Column, tables: Column, e: Column, a: Column, b: Column) -> Column:
        def judged(at: Column) -> Column:
            up, down = at["up"], at["down"]
            # The same bar touching both sides is a stop.
            profit, stop = (up < b) & (up < down), (down < b) & (down <= up)
            move = F.lit(float(k)) * e["atr"]
            end = F.when(profit, up).when(stop, down).otherwise(b - 1)
            return let(end, lambda x: let(F.get(path, x), lambda bar: F.struct(
                e["entry_ts"].alias("entry_ts"), e["ref"].alias("ref"), e["atr"].alias("atr"),
                F.when(profit, "PROFIT").when(stop, "STOP").otherwise("TIME").alias("barrier"), bar["t"].alias("exit_ts"),
                F.when(profit, e["ref"] + move).when(stop, e["ref"] - move).otherwise(bar["close"]).alias("exit_price"),
                (x - a + 1).cast("bigint").alias("bars_to_exit"),
                extreme_between(tables["up"], a, x + 1).alias("path_max"),
                (-extreme_between(tables["down"], a, x + 1)).alias("path_min"))))
        return let(F.struct(_reaches(tables, "up", e, F.lit(float(k)), a, b).alias("up"),
                            _reaches(tables, "down", e, F.lit(float(k)), a, b).alias("down")), judged)
    ref, atr = F.col("ref"), F.col("atr")
    out = _searched(entries, bars, horizon, clock, result).withColumns({
        "realized_return": (F.col("exit_price") - ref) / ref, "mfe": (F.col("path_max") - ref) / atr,
        "mae": (F.col("path_min") - ref) / atr})
    if halts is None:
        return out
    end = F.coalesce(F.col("halt_end_ts"), F.lit("9999-12-31 00:00:00").cast("timestamp"))
    # The as-of scan reads its rows several times; the search behind them runs once.
    seen = asof_fold(cut_lineage(out), halts, ["symbol"], "exit_ts", "halt_start_ts", {"_end": Highest(end)})
    return seen.withColumn("halt_affected", F.coalesce(F.col("_end") > F.col("entry_ts"), F.lit(False))).drop("_end")
