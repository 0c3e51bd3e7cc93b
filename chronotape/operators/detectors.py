"""Tape-event detectors over session bars.

Every detector is a set of window columns over the same (symbol, session) layout ordered by
time, so all of them share one exchange and one sort. A detection at time t uses bars up to
t only. `facts` returns (symbol, session, ts, kind, detail).
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions.rules import typical_price
from ..session import cut_lineage
from .bars import MINUTE, SESSION, BarClock, in_order

DETAIL = "map<string,double>"


@dataclass(frozen=True)
class DetectorSettings:
    or_minutes: int = 15
    volume_k: float = 3.0
    volume_lookback: int = 20
    sweep_lookback: int = 10
    cluster_minutes: int = 5
    cluster_min: int = 3


DEFAULTS = DetectorSettings()


def _whole() -> WindowSpec:
    # Ordered although the frame is the whole session: all windows then share one sort.
    return in_order().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)


def _prior(n: int) -> WindowSpec:
    return in_order().rowsBetween(-n, -1)


def _earlier() -> WindowSpec:
    return in_order().rowsBetween(Window.unboundedPreceding, -1)


def _so_far() -> WindowSpec:
    return in_order().rowsBetween(Window.unboundedPreceding, Window.currentRow)


def _bars_later(ts: Column, bars: int, clock: BarClock) -> Column:
    return ts + F.make_dt_interval(secs=F.lit(bars * clock.unit_seconds))


def _fact(when: Column, kind: str, **detail: Column) -> tuple[Column, Column]:
    pairs = [x for k, v in detail.items() for x in (F.lit(k), v.cast("double"))]
    return when, F.when(when, F.struct(F.lit(kind).alias("kind"), F.create_map(*pairs).alias("detail")))


Facts = list[tuple[Column, Column]]
Detector = Callable[[DataFrame, DetectorSettings, BarClock], tuple[DataFrame, Facts]]


def _rth(value: Column) -> Column:
    return F.when(F.col("rth"), value)


def _opened(bars: DataFrame) -> DataFrame:
    if "_open_ts" in bars.columns:
        return bars
    return bars.withColumn("_open_ts", F.min(_rth(F.col("ts"))).over(_whole()))


def opening_range(bars: DataFrame, s: DetectorSettings = DEFAULTS, clock: BarClock = MINUTE):
    """High/low of the first minutes of regular hours, then the first break of each level."""
    end = _bars_later(F.col("_open_ts"), s.or_minutes, clock)
    inside = F.col("rth") & (F.col("ts") < end)
    after = F.col("rth") & (F.col("ts") >= end)
    out = _opened(bars).withColumns({
        "_or_high": F.max(F.when(inside, F.col("high"))).over(_whole()),
        "_or_low": F.min(F.when(inside, F.col("low"))).over(_whole()),
        "_or_last": F.max(F.when(inside, F.col("ts"))).over(_whole()),
    }).withColumns({
        "_or_up": F.min(F.when(after & (F.col("high") > F.col("_or_high")), F.col("ts"))).over(_whole()),
        "_or_dn": F.min(F.when(after & (F.col("low") < F.col("_or_low")), F.col("ts"))).over(_whole()),
    })
    return out, [
        _fact(F.col("ts") == F.col("_or_last"), "OPENING_RANGE_SET", or_high=F.col("_or_high"),
              or_low=F.col("_or_low"), or_minutes=F.lit(s.or_minutes)),
        _fact(F.col("ts") == F.col("_or_up"), "OR_BREAK_UP", level=F.col("_or_high")),
        _fact(F.col("ts") == F.col("_or_dn"), "OR_BREAK_DOWN", level=F.col("_or_low")),
    ]


def _median(ordered: str) -> Column:
    """Middle of an ordered array (mean of the two middle values), NULL when it is empty."""
    last = F.size(ordered) - 1
    return (F.get(ordered, F.floor(last / 2).cast("int")) + F.get(ordered, F.ceil(last / 2).cast("int"))) * 0.5


def volume_expansion(bars: DataFrame, s: DetectorSettings = DEFAULTS, clock: BarClock = MINUTE):
    """Volume of at least k times the median of the prior bars (a full lookback is required)."""
    n = s.volume_lookback
    # A moving frame is aggregated anew for every row; a sorted array of the few values is cheaper than a percentile of it.
    out = bars.withColumns({
        "_vol_n": F.count("*").over(_prior(n)),
        "_vol_prior": F.sort_array(F.array_compact(F.array(
            *[F.lag(F.col("volume").cast("double"), i).over(in_order()) for i in range(1, n + 1)]))),
    }).withColumn("_vol_med", _median("_vol_prior"))
    med, vol = F.col("_vol_med"), F.col("volume")
    hit = (F.col("_vol_n") == n) & (med > 0) & (vol >= s.volume_k * med)
    return out, [_fact(hit, "VOLUME_EXPANSION", volume=vol, median=med, ratio=vol / med)]


def sweeps(bars: DataFrame, s: DetectorSettings = DEFAULTS, clock: BarClock = MINUTE):
    """A bar beyond the prior extreme that closes back inside it."""
    n = s.sweep_lookback
    out = bars.withColumns({
        "_sw_n": F.count("*").over(_prior(n)),
        "_sw_high": F.max("high").over(_prior(n)),
        "_sw_low": F.min("low").over(_prior(n)),
    })
    full = F.col("_sw_n") == n
    return out, [
        _fact(full & (F.col("high") > F.col("_sw_high")) & (F.col("close") <= F.col("_sw_high")),
              "SWEEP_OF_HIGHS", level=F.col("_sw_high")),
        _fact(full & (F.col("low") < F.col("_sw_low")) & (F.col("close") >= F.col("_sw_low")),
              "SWEEP_OF_LOWS", level=F.col("_sw_low")),
    ]


def session_extremes(bars: DataFrame, s: DetectorSettings = DEFAULTS, clock: BarClock = MINUTE):
    """New regular-hours high / low once the opening range is over."""
    out = _opened(bars).withColumns({
        "_run_high": F.max(_rth(F.col("high"))).over(_earlier()),
        "_run_low": F.min(_rth(F.col("low"))).over(_earlier()),
    })
    late = F.col("rth") & (F.col("ts") >= _bars_later(F.col("_open_ts"), s.or_minutes, clock))
    return out, [
        _fact(late & (F.col("high") > F.col("_run_high")), "NEW_SESSION_HIGH", high=F.col("high")),
        _fact(late & (F.col("low") < F.col("_run_low")), "NEW_SESSION_LOW", low=F.col("low")),
    ]


def vwap_crosses(bars: DataFrame, s: DetectorSettings = DEFAULTS, clock: BarClock = MINUTE):
    """Sign flips of close minus cumulative VWAP; a touch at exactly zero suppresses the next flip."""
    volume = F.sum(_rth(F.col("volume"))).over(_so_far())
    value = F.sum(_rth(typical_price() * F.col("volume"))).over(_so_far())
    out = bars.withColumn("_vwap", F.when(F.col("rth") & (volume > 0), value / volume))
    out = out.withColumn("_diff", F.col("close") - F.col("_vwap"))
    out = out.withColumn("_pdiff", F.last("_diff", ignorenulls=True).over(_earlier()))
    diff, prev = F.col("_diff"), F.col("_pdiff")
    return out, [
        _fact((diff > 0) & (prev < 0), "VWAP_CROSS_UP", vwap=F.col("_vwap")),
        _fact((diff < 0) & (prev > 0), "VWAP_CROSS_DOWN", vwap=F.col("_vwap")),
    ]


ALL_DETECTORS: tuple[Detector, ...] = (
    opening_range, volume_expansion, sweeps, session_extremes, vwap_crosses)


def facts(bars: DataFrame, detectors: Sequence[Detector] = ALL_DETECTORS,
          settings: DetectorSettings = DEFAULTS, clock: BarClock = MINUTE) -> DataFrame:
    """Run detectors in one pass. `bars` needs the session marks (`rth`)."""
    wanted = [*SESSION, "ts", "high", "low", "close", "volume", "rth"]
    frame, found = bars.select(*wanted), []
    for detector in detectors:
        frame, new = detector(frame, settings, clock)
        found += new
    any_hit = reduce(lambda a, b: a | b, [F.coalesce(when, F.lit(False)) for when, _ in found])
    return frame.where(any_hit).select(*SESSION, "ts", F.inline(F.array(*[fact for _, fact in found]))).where(
        F.col("kind").isNotNull())


def halt_facts(halts: DataFrame, session: Column) -> DataFrame:
    """Start and resume facts of halt episodes; an ongoing halt has no resume."""
    sides = F.array(F.struct(F.col("halt_start_ts").alias("ts"), F.lit("HALT_START").alias("kind")),
                    F.struct(F.col("halt_end_ts").alias("ts"), F.lit("HALT_RESUME").alias("kind")))
    return halts.select("symbol", session.alias("session"), F.inline(sides)).where(F.col("ts").isNotNull()).select(
        "symbol", "session", "ts", "kind", F.create_map().cast(DETAIL).alias("detail"))


def clusters(events: DataFrame, settings: DetectorSettings = DEFAULTS, clock: BarClock = MINUTE) -> DataFrame:
    """Greedy, non-overlapping CLUSTER facts: enough events within the window from a start event.

    A range window counts the events ahead of each start; only starts that reach the minimum
    enter the fold, which walks them in order and skips what the last cluster covers. One
    session holds a bounded number of facts.
    """
    width = settings.cluster_minutes * clock.unit_seconds * 1_000_000
    ahead = Window.partitionBy(*SESSION).orderBy("_us").rangeBetween(0, width)
    starts = (
        events.select(*SESSION, F.unix_micros("ts").alias("_us"))
        .groupBy(*SESSION, "_us").agg(F.count("*").alias("_n"))
        .withColumn("n", F.sum("_n").over(ahead))
        .where(F.col("n") >= settings.cluster_min)
    )
    nothing = F.expr("cast(array() as array<struct<us:bigint,n:bigint>>)")

    def merge(picked: Column, e: Column) -> Column:
        """Take a start unless the last picked cluster still covers it."""
        covered = e["us"] <= F.try_element_at(picked, F.lit(-1))["us"] + width
        return F.when(F.coalesce(covered, F.lit(False)), picked).otherwise(F.concat(picked, F.array(e)))

    picked = starts.groupBy(*SESSION).agg(
        F.sort_array(F.collect_list(F.struct(F.col("_us").alias("us"), "n"))).alias("_s"))
    return picked.select(*SESSION, F.inline(F.aggregate("_s", nothing, merge))).select(
        *SESSION, F.timestamp_micros("us").alias("ts"), F.lit("CLUSTER").alias("kind"),
        F.create_map(F.lit("count"), F.col("n").cast("double"),
                     F.lit("span_minutes"), F.lit(float(settings.cluster_minutes))).alias("detail"))


def all_facts(bars: DataFrame, halts: DataFrame | None = None,
              settings: DetectorSettings = DEFAULTS, clock: BarClock = MINUTE) -> DataFrame:
    """Detector facts, halt facts (symbol, session, halt_start_ts, halt_end_ts) and clusters over both.

    The facts feed the clusters and the result, so they are written once; they are few next
    to the bars they come from.
    """
    found = facts(bars, settings=settings, clock=clock)
    if halts is not None:
        sessions = bars.select(*SESSION).distinct()
        found = found.unionByName(halt_facts(halts, F.col("session")).join(sessions, SESSION, "left_semi"))
    found = cut_lineage(found)
    return found.unionByName(clusters(found, settings, clock))
