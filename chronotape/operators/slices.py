"""Equal-depth slices: cut points that divide the rows of a key along an ordered position.

A key with at most `max_rows` rows is one slice. A heavier key gets cut points at quantiles of its rows, and slices that
are still too deep are cut again, so a slice's depth follows the rows and not the calendar: one global key, one busy day
and one busy instant are spread alike. Cut points may repeat: the slices between equal ones share the rows of that
instant. Only heavy keys have cut points; their number is at most twice the rows divided by `max_rows`.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut_lineage

MAX_ROWS = 500_000
_PER_ROUND = 1_000
_ROUNDS = 8
#: Rows without a key or position match nothing; they are dealt over so many slices of their own.
_LOST = 4_096


def count_while(items: Column, holds: Callable[[Column], Column], steps: int) -> Column:
    """Length of the longest prefix of an ordered array whose last item `holds` (at most 2^steps - 1 items)."""
    jumps = F.array(*[F.lit(1 << i) for i in reversed(range(max(1, steps)))])
    return F.aggregate(jumps, F.lit(0), lambda n, jump: F.when(holds(F.get(items, n + jump - 1)), n + jump).otherwise(n))


def steps_for(size: int | None) -> int:
    return max(1, (size or 0).bit_length())


def spread_hash(df: DataFrame) -> Column:
    """A hash of the row; map columns cannot be hashed and are left out."""
    names = [f.name for f in df.schema.fields if "map<" not in f.dataType.simpleString()
             and not isinstance(f.dataType, T.VariantType)]
    return F.xxhash64(*names) if names else F.lit(0).cast("bigint")


@dataclass(frozen=True)
class Slices:
    """Cut points (keys..., _cuts) of the heavy keys; `cuts` is None where no key is heavy.

    Without keys there is one row of cut points; `alone` holds it as a constant, since a join would have no key.
    """
    by: tuple[str, ...]
    cuts: DataFrame | None = None
    steps: int = 1
    alone: Column | None = None

    def _with_cuts(self, df: DataFrame) -> DataFrame:
        if self.by:
            return df.join(self.cuts, list(self.by), "left").select(*df.columns, "_cuts")
        return df.withColumn("_cuts", self.alone)

    def place(self, df: DataFrame, position: Column, *, side: str = "spread") -> DataFrame:
        """df plus `_slice`. Rows at a repeated cut go to one of its slices ("spread"), to the "first" or the "last"."""
        lost = reduce(lambda a, b: a | b, [F.col(c).isNull() for c in self.by], position.isNull())
        here, own = F.lit(0), F.col("_hash") if side == "spread" else F.lit(0).cast("bigint")
        out = df.withColumn("_hash", spread_hash(df)) if side == "spread" else df
        if self.cuts is not None:
            out = self._with_cuts(out.withColumn("_at", position))
            below = count_while(F.col("_cuts"), lambda c: c < F.col("_at"), self.steps)
            upto = count_while(F.col("_cuts"), lambda c: c <= F.col("_at"), self.steps)
            out = out.withColumn("_below", below).withColumn("_upto", upto)
            a, b = F.col("_below"), F.col("_upto")
            first = F.least(a + 1, b)
            here = {"first": first, "last": b, "spread": F.when(
                b - a > 1, first + F.pmod(own, F.greatest(b - a, F.lit(1))).cast("int")).otherwise(b)}[side]
            # A key without cut points is one slice.
            here = F.coalesce(here, F.lit(0))
        lost_slice = (-1 - F.pmod(own, F.lit(_LOST))).cast("int")
        return out.withColumn("_slice", F.when(lost, lost_slice).otherwise(here.cast("int"))).select(*df.columns, "_slice")

    def all_slices(self) -> DataFrame:
        """(by..., _slice): every slice of the heavy keys."""
        return self.cuts.select(*self.by, F.explode(F.sequence(F.lit(0), F.size("_cuts"))).alias("_slice"))


def equal_depth(frames: Sequence[tuple[DataFrame, Column]], by: Sequence[str], *, max_rows: int | None = MAX_ROWS) -> Slices:
    """Slices of at most about `max_rows` rows of all frames together; `frames` are (frame, position) pairs.

    Positions are bigints. None for `max_rows` means that the caller knows its groups to be bounded.
    """
    by = tuple(by)
    if max_rows is None:
        return Slices(by)
    keys = list(by) or ["_k"]
    parts = [df.select(*by, *([] if by else [F.lit(0).alias("_k")]), at.cast("bigint").alias("_at")) for df, at in frames]
    rows = reduce(DataFrame.unionByName, parts).dropna()
    heavy = cut_lineage(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > max_rows))
    most = heavy.agg(F.max("_n")).first()[0]
    if most is None:
        return Slices(by)
    rows = cut_lineage(rows.join(heavy.select(*keys), keys, "left_semi"))
    slices = Slices(tuple(keys))
    deep, wanted = rows.withColumn("_slice", F.lit(0)), -(-int(most) // max_rows)
    for _ in range(_ROUNDS):
        n = min(_PER_ROUND, wanted)
        marks = [i / n for i in range(1, n)] or [0.5]
        found = F.percentile_approx("_at", marks, max(10_000, 10 * n))
        size = F.least(F.lit(n), F.ceil(F.col("_n") / max_rows)).cast("int")
        pick = F.transform(F.sequence(F.lit(1), size - 1), lambda i: F.get("_found", F.floor(i * n / size).cast("int") - 1))
        new = (deep.groupBy(*keys, "_slice").agg(found.alias("_found"), F.count(F.lit(1)).alias("_n"))
               .select(*keys, F.when(size > 1, pick).otherwise(F.array().cast("array<bigint>")).alias("_new"))
               .groupBy(*keys).agg(F.flatten(F.collect_list("_new")).alias("_new")))
        if slices.cuts is not None:
            new = slices.cuts.join(new, keys, "left").select(
                *keys, F.concat("_cuts", F.coalesce("_new", F.array().cast("array<bigint>"))).alias("_new"))
        cuts = cut_lineage(new.select(*keys, F.array_sort("_new").alias("_cuts")))
        longest = cuts.agg(F.max(F.size("_cuts"))).first()[0]
        slices = Slices(tuple(keys), cuts, steps_for(longest))
        dealt = slices.place(rows.withColumn("_id", F.monotonically_increasing_id()), F.col("_at")).drop("_id")
        over = cut_lineage(dealt.groupBy(*keys, "_slice").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > 2 * max_rows))
        most = over.agg(F.max("_n")).first()[0]
        if most is None:
            break
        deep = dealt.join(over.select(*keys, "_slice"), [*keys, "_slice"], "left_semi")
        wanted = -(-int(most) // max_rows)
    if by:
        return Slices(by, slices.cuts, slices.steps)
    marks = slices.cuts.first()["_cuts"]
    alone = F.split(F.lit(",".join(map(str, marks))), ",").cast("array<bigint>")
    return Slices(by, slices.cuts, slices.steps, alone)
