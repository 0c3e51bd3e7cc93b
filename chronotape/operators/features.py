"""Point-in-time proof of feature functions.

A feature is a function of a case frame (case_id, signal_ts and the bars of the case) that
returns (case_id, value). It is run once on bars up to the signal and once on all bars of
the session; any difference means that it looks ahead. A feature that is an aggregate over
the bars is a `Fold`: any number of them share one pass, in the gate and at collection.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import digest
from ..functions.rules import same_map, same_value
from .bars import SESSION

FeatureFn = Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class Fold:
    """A feature as one aggregate over the bars of a case."""
    value: Callable[[], Column]

    def __call__(self, case_frame: DataFrame) -> DataFrame:
        return case_frame.groupBy("case_id").agg(self.value().alias("value"))


def case_bars(cases: DataFrame, bars: DataFrame) -> DataFrame:
    """Every case with the bars of its own session."""
    return cases.select("case_id", *SESSION, "signal_ts").join(bars, SESSION)


def pit_compare(fn: FeatureFn, cases: DataFrame, bars: DataFrame) -> DataFrame:
    """(case_id, pit_value, full_value, same) for one feature; values are doubles or string->double maps."""
    joined = case_bars(cases, bars)
    known = fn(joined.where(F.col("ts") <= F.col("signal_ts"))).select("case_id", F.col("value").alias("pit_value"))
    full = fn(joined).select("case_id", F.col("value").alias("full_value"))
    both = cases.select("case_id").join(known, "case_id", "left").join(full, "case_id", "left")
    is_map = dict(both.dtypes)["pit_value"].startswith("map")
    rule = same_map if is_map else same_value
    return both.withColumn("same", rule(F.col("pit_value"), F.col("full_value")))


def _both_scopes(folds: dict[str, Fold], cases: DataFrame, bars: DataFrame) -> DataFrame:
    """One row per case with bars: _past, _future and, per fold i, _p<i> (bars up to the signal) and _f<i> (all bars).

    Each bar is tagged with the scopes it belongs to; all folds are aggregated by (case, scope) in one pass.
    """
    known = F.col("ts") <= F.col("signal_ts")
    scopes = F.array_compact(F.array(F.lit("FULL"), F.when(known, "PIT")))
    tagged = case_bars(cases, bars).withColumn("_scope", F.explode(scopes)).repartition("case_id")
    parts = tagged.groupBy("case_id", "_scope").agg(
        F.count(F.lit(1)).alias("_n"), *[f.value().alias(f"_v{i}") for i, f in enumerate(folds.values())])

    def of(scope: str, name: str) -> Column:
        return F.max_by(name, F.when(F.col("_scope") == scope, 1))

    past = F.coalesce(of("PIT", "_n"), F.lit(0))
    return parts.groupBy("case_id").agg(
        past.alias("_past"), (of("FULL", "_n") > past).alias("_future"),
        *[of("PIT", f"_v{i}").alias(f"_p{i}") for i in range(len(folds))],
        *[of("FULL", f"_v{i}").alias(f"_f{i}") for i in range(len(folds))])


def _judgement(pit: Column, full: Column, is_map: bool, is_double: bool) -> Column:
    """Struct of the number of differing cases and whether any case has a value."""
    held = pit.isNotNull() & ~F.isnan(pit) if is_double else pit.isNotNull()
    same = (same_map if is_map else same_value)(pit, full)
    return F.struct(F.sum((~same).cast("bigint")).alias("failures"), F.coalesce(F.max(held), F.lit(False)).alias("not_all_null"))


def gate(features: dict[str, tuple[str, FeatureFn, int]], cases: DataFrame, bars: DataFrame) -> DataFrame:
    """Verdict per feature: PASS, FAIL (values differ) or UNKNOWN (the cases prove nothing).

    `features`: name -> (version, function, lookback bars). A proof needs bars after a
    signal, at least two distinct signal times, a value that is not NULL / NaN, and a case
    with as many known bars as the lookback. Folds are judged together in one pass over the
    bars; other functions take two passes each.
    """
    folds = {n: f for n, (_, f, _) in features.items() if isinstance(f, Fold)}
    per_case = cases.select("case_id", "signal_ts").join(_both_scopes(folds, cases, bars), "case_id", "left")
    kinds = dict(per_case.dtypes)
    judged = [_judgement(F.col(f"_p{i}"), F.col(f"_f{i}"), kinds[f"_p{i}"].startswith("map"), kinds[f"_p{i}"] == "double")
              .alias(f"_j{i}") for i in range(len(folds))]
    facts = per_case.agg(
        F.count(F.lit(1)).alias("n_cases"), F.coalesce(F.max("_future"), F.lit(False)).alias("has_future_bars"),
        F.coalesce(F.max("_past"), F.lit(0)).alias("_longest"), *judged)
    one = F.lit(1).alias("_one")
    # One row each.
    positions = cases.select("signal_ts").distinct().agg(F.count("*").alias("n_positions"))
    whole = facts.select("*", one).join(F.broadcast(positions.select("*", one)), "_one")
    order = {name: i for i, name in enumerate(folds)}
    for name, (_, fn, _) in features.items():
        if name not in folds:
            compared = pit_compare(fn, cases, bars)
            kind = dict(compared.dtypes)["pit_value"]
            order[name] = len(order)
            row = compared.agg(_judgement(F.col("pit_value"), F.col("full_value"), kind.startswith("map"), kind == "double")
                               .alias(f"_j{order[name]}"))
            whole = whole.join(F.broadcast(row.select("*", one)), "_one")
    results = F.array(*[F.struct(
        digest([F.lit(name), F.lit(version)], 16).alias("pit_run_id"), F.lit(name).alias("feature_name"),
        F.lit(version).alias("feature_version"), F.col(f"_j{order[name]}")["failures"].alias("failures"),
        F.col(f"_j{order[name]}")["not_all_null"].alias("not_all_null"),
        ((F.lit(lookback) == 0) | (F.col("_longest") >= lookback)).alias("lookback_exercised"))
        for name, (version, _, lookback) in features.items()])
    total = whole.select("n_cases", "has_future_bars", "n_positions", F.inline(results)).select(
        "pit_run_id", "feature_name", "feature_version", "n_cases", "failures", "has_future_bars", "n_positions", "not_all_null",
        "lookback_exercised")
    proven = (F.col("has_future_bars") & (F.col("n_positions") >= 2) & F.col("not_all_null") & F.col("lookback_exercised"))
    verdict = F.when(F.col("failures") > 0, "FAIL").when(~proven, "UNKNOWN").otherwise("PASS")
    return total.withColumn("verdict", verdict).withColumn(
        "remediation", F.when(F.col("verdict") == "FAIL", "NEW_VERSION")
                        .when(F.col("verdict") == "UNKNOWN", "NEW_TEST_PACK").otherwise(""))


def from_bars(folds: dict[str, Fold]) -> Callable[[DataFrame, DataFrame], DataFrame]:
    """Feature port of a collection: (candidates, bars) -> candidates plus `bar_features`, a map of name to value.

    A candidate's features see the bars of its session up to its signal and nothing later. Signals are distinct
    (symbol, session, signal_ts), so copies of a candidate share one computation; NULL values are left out.
    """
    def port(candidates: DataFrame, bars: DataFrame) -> DataFrame:
        signals = candidates.select(*SESSION, "signal_ts").distinct()
        known = signals.join(bars, SESSION).where(F.col("ts") <= F.col("signal_ts"))
        values = known.groupBy(*SESSION, "signal_ts").agg(*[f.value().cast("double").alias(f"_v{i}") for i, f in enumerate(folds.values())])
        pairs = F.array(*[F.struct(F.lit(n).alias("key"), F.col(f"_v{i}").alias("value")) for i, n in enumerate(folds)])
        made = values.select(*SESSION, "signal_ts", F.map_from_entries(F.filter(pairs, lambda p: p["value"].isNotNull())).alias("bar_features"))
        return candidates.join(made, [*SESSION, "signal_ts"], "left")
    return port


def verdict_of(runs: DataFrame, pit_run_id: str) -> DataFrame:
    return runs.where(F.col("pit_run_id") == pit_run_id).select("pit_run_id", "verdict")


# -- small features used as examples and in checks ----------------------------------------------
def _trailing_return() -> Column:
    """Last known close over first known close, minus one; uses no bar after the signal."""
    known = F.col("ts") <= F.col("signal_ts")
    return F.max_by("close", F.when(known, F.col("ts"))) / F.min_by("close", F.when(known, F.col("ts"))) - 1


trailing_return = Fold(_trailing_return)
#: Close of the newest bar it is given: looks ahead when given later bars.
last_close = Fold(lambda: F.max_by("close", "ts"))
bars_known = Fold(lambda: F.count(F.lit(1)))
