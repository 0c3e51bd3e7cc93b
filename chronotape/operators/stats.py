"""Exact descriptive statistics that do not hold a whole group in one task."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .slices import count_while, steps_for

#: Distinct values of a group that one row may hold.
SMALL = 65_536
_MARKS = 63
_ROUNDS = 16


def _pick(ordered: Column, rank: Column) -> Column:
    """Value at a rank (from 1) of an ordered array of (v, n)."""
    zero = F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(None).cast("double").alias("v"))
    return F.aggregate(ordered, zero, lambda acc, x: F.struct(
        (acc["n"] + x["n"]).alias("n"),
        F.when(acc["v"].isNull() & (acc["n"] + x["n"] >= rank), x["v"]).otherwise(acc["v"]).alias("v")))["v"]


def exact_median(df: DataFrame, by: Sequence[str], value: Column, *, small: int = SMALL) -> DataFrame:
    """Exact median per group as (by..., n, median), by selection on counted values.

    Values are counted first, so repeats cost nothing. A group with more than `small` distinct values is narrowed: quantiles
    of the distinct values cut it into bins, the bins' counts tell which of them hold the middle ranks, and only these go
    on. A round leaves a few of some 64 bins of every group at once, whatever the distribution, until all are small;
    then the middle values of a group are one short array. The quantiles steer the work, the counts decide. No window
    and no sort runs over a whole group.
    """
    keys = list(by) or ["_all"]
    rows = df.where(value.isNotNull()).select(
        *([F.col(c) for c in by] or [F.lit(1).alias("_all")]), value.cast("double").alias("_v"))
    # NULL is a group of its own, as in any grouping.
    same = lambda left, right: reduce(lambda a, b: a & b, [left[k].eqNullSafe(right[k]) for k in keys])
    counted = cut_lineage(rows.groupBy(*keys, "_v").agg(F.count(F.lit(1)).alias("_n")))
    groups = cut_lineage(counted.groupBy(*keys).agg(F.sum("_n").alias("n"), F.count(F.lit(1)).alias("_m")).select(
        *keys, "n", "_m", F.lit(0).cast("bigint").alias("_below"), F.floor((F.col("n") + 1) / 2).alias("_r1"),
        F.floor((F.col("n") + 2) / 2).alias("_r2")))
    inside = counted
    for _ in range(_ROUNDS):
        wide = groups.where(F.col("_m") > small)
        if not wide.limit(1).count():
            break
        marks = [i / (_MARKS + 1) for i in range(1, _MARKS + 1)]
        cuts = wide.alias("g").join(inside.alias("i"), same(_of("g"), _of("i"))).groupBy(*[F.col(f"g.{k}").alias(k) for k in keys]).agg(
            F.percentile_approx("_v", marks, 10_000).alias("_cuts"))
        cuts = cut_lineage(cuts.withColumn("_cuts", F.array_distinct("_cuts")))
        binned = inside.alias("i").join(cuts.alias("c"), same(_of("i"), _of("c")), "left").select(
            "i.*", F.coalesce(count_while(F.col("_cuts"), lambda c: c < F.col("_v"), steps_for(_MARKS)), F.lit(0)).alias("_bin"))
        binned = cut_lineage(binned)
        bins = binned.groupBy(*keys, "_bin").agg(F.sum("_n").alias("_s"), F.count(F.lit(1)).alias("_d"))
        bins = bins.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_bin", "_s", "_d"))).alias("_bins"))
        joined = groups.alias("g").join(bins.alias("b"), same(_of("g"), _of("b"))).select("g.*", "_bins")
        # Kept bins are consecutive: from the one that holds the first middle rank to the one that holds the second.
        start = F.struct(F.col("_below").alias("at"), F.lit(None).cast("bigint").alias("below"), F.lit(0).cast("bigint").alias("m"),
                         F.array().cast("array<int>").alias("kept"))

        def walk(acc: Column, x: Column) -> Column:
            end = acc["at"] + x["_s"]
            hit = (end >= F.col("_r1")) & (acc["at"] < F.col("_r2"))
            return F.struct(end.alias("at"), F.when(hit, F.coalesce(acc["below"], acc["at"])).otherwise(acc["below"]).alias("below"),
                            (acc["m"] + F.when(hit, x["_d"]).otherwise(0)).alias("m"),
                            F.when(hit, F.concat(acc["kept"], F.array(x["_bin"]))).otherwise(acc["kept"]).alias("kept"))
        walked = cut_lineage(joined.withColumn("_w", F.aggregate("_bins", start, walk)).select(
            *keys, "n", F.col("_w")["m"].alias("_m"), F.col("_w")["below"].alias("_below"), "_r1", "_r2",
            F.col("_w")["kept"].alias("_kept")))
        inside = cut_lineage(binned.alias("i").join(walked.alias("w"), same(_of("i"), _of("w"))).where(
            F.array_contains("_kept", F.col("_bin"))).select(*[F.col(f"i.{k}").alias(k) for k in keys], "_v", "_n"))
        groups = walked.drop("_kept")
    arrays = inside.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col("_v").alias("v"), F.col("_n").alias("n")))).alias("_a"))
    done = groups.alias("g").join(arrays.alias("a"), same(_of("g"), _of("a"))).select("g.*", "_a")
    middle = (_pick(F.col("_a"), F.col("_r1") - F.col("_below")) + _pick(F.col("_a"), F.col("_r2") - F.col("_below"))) / 2.0
    return done.select(*by, "n", middle.alias("median"))


class _of:
    """Columns of an aliased frame by name."""

    def __init__(self, alias: str):
        self.alias = alias

    def __getitem__(self, name: str) -> Column:
        return F.col(f"{self.alias}.{name}")


def describe(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """count, min, exact median, max and mean (3 decimals) of a column per group.

    Reads `df` several times: pass a stored frame when it is costly to compute.
    Without groups an empty input still gives one row, with count 0 and NULL elsewhere.
    """
    v = F.col(value).cast("double")
    basic = df.groupBy(*by).agg(
        F.count(v).alias("count"), F.min(v).alias("min"), F.max(v).alias("max"),
        F.round(F.avg(v), 3).alias("mean"))
    middle = exact_median(df, by, F.col(value)).drop("n")
    if by:
        joined = basic.join(middle, list(by), "left")
    else:
        joined = (basic.withColumn("_k", F.lit(1))
                  .join(F.broadcast(middle.withColumn("_k", F.lit(1))), "_k", "left").drop("_k"))
    return joined.select(*by, "count", "min", "median", "max", "mean")
