"""Choice of one label cell (k, H) by a rubric over regime episodes; only label properties enter, never a predictive metric."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .asof import MAX_ROWS, Latest, Total, asof_fold, asof_join
from .bars import MINUTE, BarClock
from .barriers import Grid, cell_metrics

#: Orders the refusals of a cell; a cell is named after the first one it fails.
STAGES = ("DEGENERATE", "BANDS", "EPISODES", "STABILITY")


@dataclass(frozen=True)
class Rubric:
    """Limits of the rubric. Shares are of 1; times are in bar units; all limits are inclusive."""
    min_class: float = 0.15
    min_entropy: float = 0.85
    time_band: tuple[float, float] = (0.15, 0.45)
    min_spread_ratio: float = 4.0
    episode_spread_ratio: float = 3.0
    min_ttr: float = 5.0
    max_ttr_share: float = 0.8
    max_side_gap: float = 0.10
    min_events: int = 100
    max_entropy_range: float = 0.10
    max_time_range: float = 0.15
    min_episodes: int = 3


def regime_episodes(snapshots: DataFrame, ts: str, state: str, *, tie: Sequence[str] = (),
                    max_rows: int = MAX_ROWS) -> DataFrame:
    """Maximal stretches of one state: episode (from 1, in time order), state, start_ts, end_ts (NULL: still going on).

    Snapshots of one instant count as one, the largest by `tie` and then by state; those without an instant take no part,
    a NULL state is a state of its own. Changes and numbers are as-of scans over slices of equal depth, so one
    market-wide history is no single task.
    """
    last = F.max_by(state, F.struct(*[F.col(c) for c in tie], F.col(state)))
    instants = cut_lineage(snapshots.where(F.col(ts).isNotNull()).groupBy(F.col(ts).alias("start_ts")).agg(last.alias("state")))
    earlier = instants.select(F.col("start_ts").alias("_ts"), F.col("state").alias("_state"))
    seen = asof_fold(instants, earlier, [], "start_ts", "_ts", {"_prev": Latest(("_state",))}, strict=True, max_rows=max_rows)
    changed = F.col("_prev").isNull() | ~F.col("_prev")["_state"].eqNullSafe(F.col("state"))
    starts = cut_lineage(seen.where(changed).select("start_ts", "state"))
    counted = asof_fold(starts, starts.select(F.col("start_ts").alias("_ts")), [], "start_ts", "_ts",
                        {"episode": Total(F.lit(1))}, max_rows=max_rows)
    numbered = cut_lineage(counted.select(F.col("episode").cast("bigint").alias("episode"), "state", "start_ts"))
    following = numbered.select((F.col("episode") - 1).alias("episode"), F.col("start_ts").alias("end_ts"))
    return numbered.join(following, "episode", "left")


def in_episodes(rows: DataFrame, episodes: DataFrame, ts: str) -> DataFrame:
    """Add the `episode` that holds each row's instant; NULL before the first.

    Only the distinct instants are scanned; rows get theirs by an equality join. `rows` is read twice.
    """
    starts = episodes.select("episode", F.col("start_ts").alias("_start"))
    instants = cut_lineage(rows.select(F.col(ts).alias("_at")).distinct())
    found = asof_join(instants, starts, [], "_at", "_start", ["episode"], tie=["episode"])
    return rows.join(found, F.col(ts) == F.col("_at"), "left").drop("_at")


def _six(name: str) -> Column:
    return F.round(F.col(name), 6)


def _refusals(rubric: Rubric, ratio: float) -> dict[str, Column]:
    """Named conditions a cell's metrics fail; compared at six decimals, so that equal shares compare equal anywhere."""
    time, ttr = _six("time_pct"), _six("median_ttr")
    return {
        "events": F.col("n") < rubric.min_events,
        "degenerate": F.col("degenerate"),
        "min_class": _six("min_class_fraction") < rubric.min_class,
        "entropy": _six("class_entropy") < rubric.min_entropy,
        "time_band": (time < rubric.time_band[0]) | (time > rubric.time_band[1]),
        "spread_ratio": _six("barrier_spread_ratio") < ratio,
        "ttr": (ttr < rubric.min_ttr) | (ttr > F.round(rubric.max_ttr_share * F.col("h"), 6)),
        "side_gap": F.round(F.abs(F.col("profit_pct") - F.col("stop_pct")), 6) > rubric.max_side_gap,
    }


def _named(conditions: dict[str, Column], prefix: str = "") -> Column:
    return F.array_compact(F.array(*[F.when(c, prefix + name) for name, c in conditions.items()]))


def judge(cells: DataFrame, by_episode: DataFrame, grid: Grid, rubric: Rubric = Rubric()) -> DataFrame:
    """One row per cell of the grid: verdict, refusals, ranges over episodes, plateau, rank among the accepted, selection.

    `cells` and `by_episode` (with a column `episode`) are results of `cell_metrics`. A refusal is a condition's name, for
    the cell over everything, or `episodes.<name>=<count>` with the number of episodes that fail it. `stage` is the
    first of DEGENERATE, BANDS, EPISODES, STABILITY that a cell fails, else ACCEPTED. Accepted cells are ordered by
    stability (entropy range, then TIME range), balance, barrier / spread, plateau (share of the neighbouring cells
    that are accepted) and parsimony (shorter H, then smaller k). `outcome` is the same in all rows: SELECTED, or why
    nothing is: REGIME_DIVERSITY (too few episodes with entries), NO_CELL_PASSES, NO_STABLE_CELL. Limits are never
    relaxed. Everything here has at most as many rows as the grid has cells times episodes.
    """
    cell = ["k", "h"]
    whole = _refusals(rubric, rubric.min_spread_ratio)
    judged = cells.select(*cell, "n", "class_entropy", "barrier_spread_ratio", _named(whole).alias("_whole"),
                          (whole["events"] | whole["degenerate"]).alias("_degenerate"))
    flags = _refusals(rubric, rubric.episode_spread_ratio)
    failed = by_episode.where(F.col("episode").isNotNull()).select(
        *cell, "episode", "class_entropy", "time_pct", *[c.cast("int").alias(name) for name, c in flags.items()])
    counts = F.array_compact(F.array(*[F.when(F.col(n) > 0, F.concat(F.lit(f"episodes.{n}="), F.col(n))) for n in flags]))
    over = failed.groupBy(*cell).agg(
        F.count("*").alias("episodes"), F.round(F.max("class_entropy") - F.min("class_entropy"), 6).alias("entropy_range"),
        F.round(F.max("time_pct") - F.min("time_pct"), 6).alias("time_range"), *[F.sum(n).alias(n) for n in flags],
    ).select(*cell, "episodes", "entropy_range", "time_range", counts.alias("_episodes"))
    joined = judged.join(over, cell, "left").withColumn("episodes", F.coalesce("episodes", F.lit(0).cast("bigint")))
    unstable = {"entropy_range": F.col("entropy_range") > rubric.max_entropy_range,
                "time_range": F.col("time_range") > rubric.max_time_range}
    few = F.when(F.col("episodes") < rubric.min_episodes, F.array(F.lit("regime_diversity"))).otherwise(F.array().cast("array<string>"))
    in_each = F.coalesce("_episodes", F.array().cast("array<string>"))
    ranges = _named(unstable)
    staged = cut_lineage(joined.select(
        *cell, "n", "episodes", "entropy_range", "time_range", "class_entropy", "barrier_spread_ratio",
        F.concat("_whole", in_each, ranges, few).alias("refusals"),
        F.when(F.col("_degenerate"), STAGES[0]).when(F.size("_whole") > 0, STAGES[1])
         .when((F.size(in_each) > 0) | (F.size(few) > 0), STAGES[2]).when(F.size(ranges) > 0, STAGES[3]).otherwise("ACCEPTED").alias("stage")))

    # Neighbours differ by one step in k or in H; the grid is a parameter, so its pairs are listed here.
    ks, hs = sorted(grid.k), sorted(grid.h)
    pairs = [(float(ks[i]), hs[j], float(ks[a]), hs[b]) for i in range(len(ks)) for j in range(len(hs))
             for a, b in ((i - 1, j), (i + 1, j), (i, j - 1), (i, j + 1)) if 0 <= a < len(ks) and 0 <= b < len(hs)]
    near = staged.sparkSession.createDataFrame(pairs, "k double, h int, _k double, _h int")
    of = staged.select(F.col("k").alias("_k"), F.col("h").alias("_h"), (F.col("stage") == "ACCEPTED").cast("double").alias("_ok"))
    plateau = near.join(of, ["_k", "_h"]).groupBy(*cell).agg(F.round(F.avg("_ok"), 6).alias("plateau"))
    scored = staged.join(plateau, cell, "left").withColumn("plateau", F.coalesce("plateau", F.lit(0.0)))

    accepted = F.col("stage") == "ACCEPTED"
    order = Window.partitionBy(accepted).orderBy("entropy_range", "time_range", _six("class_entropy").desc(),
                                                 _six("barrier_spread_ratio").desc(), F.desc("plateau"), "h", "k")
    everything = Window.partitionBy(F.lit(1))
    passes = F.max(F.col("stage").isin("ACCEPTED", "STABILITY")).over(everything)
    outcome = (F.when(F.max("episodes").over(everything) < rubric.min_episodes, "REGIME_DIVERSITY")
               .when(F.max(accepted).over(everything), "SELECTED").when(passes, "NO_STABLE_CELL").otherwise("NO_CELL_PASSES"))
    return scored.select(
        *cell, "n", "episodes", "entropy_range", "time_range", "plateau", "stage", "refusals",
        F.when(accepted, F.row_number().over(order)).alias("rank"), outcome.alias("outcome"),
    ).withColumn("selected", F.coalesce(F.col("rank") == 1, F.lit(False)))


def choose_cell(touches: DataFrame, snapshots: DataFrame, ts: str, state: str, grid: Grid = Grid(), rubric: Rubric = Rubric(),
                clock: BarClock = MINUTE, *, tie: Sequence[str] = ()) -> DataFrame:
    """The rubric over first touches and regime snapshots: episodes, metrics per cell and per (cell, episode), verdicts.

    Entries before the first snapshot count for the cells, but in no episode; an episode without entries is not judged.
    """
    # The search for touches is the costly part: its rows are stored before they are read several times.
    touches = cut_lineage(touches)
    placed = cut_lineage(in_episodes(touches, regime_episodes(snapshots, ts, state, tie=tie), "entry_ts"))
    inside = placed.where(F.col("episode").isNotNull())
    return judge(cell_metrics(placed, grid, clock), cell_metrics(inside, grid, clock, by=["episode"]), grid, rubric)
