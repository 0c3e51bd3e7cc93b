"""Integrity assertions over the tables at hand, as (check, passed, checked, violations)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.rules import CALIBRATION_ROLE
from ..functions.times import EXCHANGE_ZONE
from ..operators import observations as O
from ..operators.registries import active_symbols, resolve_symbol
from ..session import cut_lineage

_IDS = ["symbol_registry_id", "regime_snapshot_id", "setup_version", "universe_version_id", "scanner_version_id",
        "label_spec_id", "registry_signature_hash", "candidate_key", "reason_code"]


def _check(name: str, rows: DataFrame, bad) -> DataFrame:
    return rows.agg(F.count("*").alias("checked"), F.coalesce(F.sum(bad.cast("bigint")), F.lit(0)).alias("violations")).select(
        F.lit(name).alias("check"), (F.col("violations") == 0).alias("passed"), "checked", "violations")


def run_suite(candidates: DataFrame, rebuild, symbols: DataFrame, *, as_of_date: str, zone: str = EXCHANGE_ZONE) -> DataFrame:
    """Six checks. `rebuild(candidates)` builds observations; it is run twice, independently."""
    first, second = cut_lineage(rebuild(candidates)), cut_lineage(rebuild(candidates))
    return judge(candidates, first, second, active_symbols(symbols, as_of_date), symbols, as_of_date=as_of_date, zone=zone)


def judge(candidates: DataFrame, first: DataFrame, second: DataFrame, active: DataFrame, symbols: DataFrame, *,
          as_of_date: str, zone: str = EXCHANGE_ZONE) -> DataFrame:
    """The checks on given tables: observations, the same built again, and the symbols listed as active on a date."""
    kept = O.accepted(first)
    key = ["symbol", "signal_ts", "candidate_batch_id", "setup_type", "scanner_rank"]

    # 1: no signed row refers to a version that starts after its signal, or to an older one than due.
    again = resolve_symbol(kept.withColumnRenamed("symbol_registry_id", "_held"), symbols, zone=zone)
    starts = symbols.select("symbol_registry_id", F.col("valid_from").alias("_from"))
    pit = again.join(starts, "symbol_registry_id", "left")
    c1 = _check("version_in_force", pit, ~F.coalesce(
        (F.col("_held") == F.col("symbol_registry_id")) & (F.col("_from") <= F.col("signal_ts")), F.lit(False)))
    # 2: nothing burned is accepted.
    c2 = _check("nothing_burned", kept, F.col("dataset_role") == CALIBRATION_ROLE)
    # 3: all ids present, signature recomputes, data not newer than the signal.
    c3 = _check("signed_and_known", O.evaluate(kept), ~F.col("passed"))
    # 4: the listed symbols are those with more starts than ends up to the date; that some left later doesn't matter.
    day = F.lit(as_of_date).cast("date")
    begun, ended = F.col("active_from") <= day, (F.col("active_from") <= day) & (F.col("active_to") <= day)
    open_ = symbols.groupBy("symbol").agg((F.count(F.when(begun, 1)) - F.count(F.when(ended, 1))).alias("_open"))
    both = open_.join(active.select("symbol", F.lit(True).alias("_listed")).distinct(), "symbol", "full_outer")
    c4 = _check("active_set", both, F.coalesce(F.col("_open") > 0, F.lit(False)) != F.coalesce("_listed", F.lit(False)))
    # 5: the same inputs give the same rows.
    a, b = (df.select(*key, *_IDS) for df in (first, second))
    diff = a.exceptAll(b).unionAll(b.exceptAll(a))
    c5 = _check("same_when_rebuilt", diff, F.lit(True))
    # 6: every candidate became an observation or a reasoned refusal.
    ins = candidates.groupBy("candidate_batch_id").agg(F.count("*").alias("_in"))
    outs = first.groupBy("candidate_batch_id").agg(F.count("*").alias("_out"))
    c6 = _check("all_accounted", ins.join(outs, "candidate_batch_id", "full_outer"),
                ~F.col("_in").eqNullSafe(F.col("_out")))
    out = c1
    for c in (c2, c3, c4, c5, c6):
        out = out.unionByName(c)
    return out
