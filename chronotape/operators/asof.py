"""Backward as-of joins that stay parallel when one key holds most of the rows.

A key with more rows than the goal is cut into slices of equal depth (`slices`). Each
(key, slice) is one unit of work: a single ordered window folds the right rows into the
left rows of that slice. What earlier slices contribute enters the slice as one extra row,
taken from summaries that are aggregated map-side first, so the only per-key window runs
over slices, not over data. A busy instant is several slices: its right rows are reduced
to one, its left rows are dealt among them. No match stays NULL; there is no fallback.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .slices import MAX_ROWS, Slices, count_while, equal_depth, steps_for


@dataclass(frozen=True)
class Latest:
    """Columns of the newest right row at or before the left time."""
    columns: tuple[str, ...]


@dataclass(frozen=True)
class Highest:
    """Largest value over all right rows at or before the left time."""
    value: Column


@dataclass(frozen=True)
class Total:
    """Sum of a value over all right rows at or before the left time."""
    value: Column


def asof_fold(
    left: DataFrame,
    right: DataFrame,
    by: Sequence[str],
    left_ts: str,
    right_ts: str,
    folds: dict[str, Latest | Highest | Total],
    *,
    tie: Sequence[str] = (),
    strict: bool = False,
    max_rows: int | None = MAX_ROWS,
    asked: DataFrame | None = None,
) -> DataFrame:
    """Add one column per fold to `left`. A `Latest` fold gives a struct (NULL when nothing matches).

    `tie` orders right rows of equal time (last wins). `strict` uses `<` instead of `<=`.
    `max_rows` is the row goal of a slice, None where groups are known to be bounded.
    Depths are counted on `asked` (by default `left`): when `left` is itself the result of a
    chain of joins, pass the frame the chain started from, so that the chain is computed once.
    """
    by = list(by)
    keys = [F.col(c) for c in by]
    names = list(folds)

    # The left time travels in the struct; right rows carry the fold inputs.
    rank = F.struct(F.col(right_ts).alias("t"), *[F.col(c) for c in tie])
    inputs = []
    for name, fold in folds.items():
        if isinstance(fold, Latest):
            body = F.struct(*[F.col(c) for c in fold.columns])
        else:
            body = fold.value
        inputs.append(body.alias(name))
    known = right.dropna(subset=[*by, right_ts]).select(
        *keys, F.col(right_ts).alias("_ts"), rank.alias("_rank"), *inputs)
    slices = equal_depth([(left if asked is None else asked, F.unix_micros(left_ts)), (known, F.unix_micros("_ts"))], by,
                         max_rows=max_rows)

    def combine(name: str, *, over=None) -> Column:
        fold = folds[name]
        if isinstance(fold, Latest):
            agg = F.max_by(F.col(name), F.col("_rank"))
        elif isinstance(fold, Highest):
            agg = F.max(name)
        else:
            agg = F.sum(name)
        return (agg.over(over) if over is not None else agg).alias(name)

    carry = None
    if slices.cuts is not None:
        # One right row per instant, at the first slice of that instant (the last one for <).
        known = known.groupBy(*by, "_ts").agg(F.max("_rank").alias("_rank"), *[combine(n) for n in names])
        known = slices.place(known, F.unix_micros("_ts"), side="last" if strict else "first")
        summary = known.groupBy(*by, "_slice").agg(F.max("_rank").alias("_rank"), *[combine(n) for n in names])
        summary = summary.unionByName(slices.all_slices(), allowMissingColumns=True).groupBy(*by, "_slice").agg(
            F.max("_rank").alias("_rank"), *[combine(n) for n in names])
        # Slices advance in time, so the newest row so far is the last non-NULL summary.
        before = Window.partitionBy(*by).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
        carry = summary.select(*by, "_slice", *[
            F.last(n, ignorenulls=True).over(before).alias(n) if isinstance(folds[n], Latest) else combine(n, over=before)
            for n in names]).where(F.greatest(*[F.col(n).isNotNull() for n in names], F.lit(False)))
    else:
        known = known.withColumn("_slice", F.lit(0))

    # Side order inside a slice: carry, then right before left for <=, left before right for <.
    side_right = 2 if strict else 0
    asking = slices.place(left, F.unix_micros(left_ts)).select(
        *keys, "_slice", F.col(left_ts).alias("_ts"),
        F.lit(1).alias("_side"), F.struct(*[F.col(c) for c in left.columns]).alias("_left"))
    stream = asking.unionByName(known.withColumn("_side", F.lit(side_right)), allowMissingColumns=True)
    if carry is not None:
        stream = stream.unionByName(carry.withColumn("_side", F.lit(-1)), allowMissingColumns=True)
    in_slice = (
        Window.partitionBy(*by, "_slice")
        .orderBy(F.col("_ts").asc_nulls_first(), "_side", F.col("_rank").asc_nulls_first())
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )

    def folded(name: str) -> Column:
        fold = folds[name]
        if isinstance(fold, Latest):
            return F.last(name, ignorenulls=True).over(in_slice).alias(name)
        if isinstance(fold, Highest):
            return F.max(name).over(in_slice).alias(name)
        return F.coalesce(F.sum(name).over(in_slice), F.lit(0)).alias(name)

    return (
        stream.select("_side", "_left", *[folded(n) for n in names])
        .where(F.col("_side") == 1)
        .select("_left.*", *names)
    )


def asof_join(
    left: DataFrame,
    right: DataFrame,
    by: Sequence[str],
    left_ts: str,
    right_ts: str,
    columns: Sequence[str] | dict[str, str],
    *,
    tie: Sequence[str] = (),
    strict: bool = False,
    max_rows: int | None = MAX_ROWS,
    asked: DataFrame | None = None,
) -> DataFrame:
    """Latest right row per left row; `columns` lists (or renames) the right columns to add."""
    renames = dict(columns) if isinstance(columns, dict) else {c: c for c in columns}
    out = asof_fold(left, right, by, left_ts, right_ts, {"_hit": Latest(tuple(renames))},
                    tie=tie, strict=strict, max_rows=max_rows, asked=asked)
    return out.select(*left.columns, *[F.col("_hit")[c].alias(n) for c, n in renames.items()])


def with_validity(versions: DataFrame, by: Sequence[str], valid_from: str) -> DataFrame:
    """Derived half-open validity: `valid_to` is the next version's start, NULL while open."""
    order = Window.partitionBy(*by).orderBy(valid_from)
    return versions.withColumn("valid_to", F.lead(valid_from).over(order))


@dataclass(frozen=True)
class AsofIndex:
    """A versioned table cut into short ordered arrays, one per (key, slice), for lookups by equality joins only.

    The left side is neither sorted nor shuffled by time, so it may be a stream: a row finds its slice among its key's
    cut points, then its version in that slice's array, both by halving.
    """
    by: tuple[str, ...]
    right_ts: str
    slices: Slices
    pieces: DataFrame
    steps: int

    def lookup(self, left: DataFrame, left_ts: str, columns: Sequence[str], *, strict: bool = False) -> DataFrame:
        placed = self.slices.place(left, F.unix_micros(left_ts), side="last")
        hit = placed.join(self.pieces, [*self.by, "_slice"], "left")
        when = F.col(left_ts)
        n = count_while(F.col("_items"), (lambda i: i["t"] < when) if strict else (lambda i: i["t"] <= when), self.steps)
        return hit.withColumn("_hit", F.get("_items", n - 1)).select(*left.columns, *[F.col("_hit")[c].alias(c) for c in columns])


def asof_index(right: DataFrame, by: Sequence[str], right_ts: str, columns: Sequence[str], *, tie: Sequence[str] = (),
               max_rows: int = 1_000) -> AsofIndex:
    """Index of `right` with about `max_rows` versions per array (each with the last earlier version in front)."""
    by = list(by)
    item = F.struct(F.col(right_ts).alias("t"), *[F.col(c) for c in columns])
    known = cut_lineage(right.dropna(subset=[*by, right_ts]).groupBy(*by, right_ts).agg(
        F.max_by(item, F.struct(right_ts, *tie)).alias("_item")))
    slices = equal_depth([(known, F.unix_micros(right_ts))], by, max_rows=max_rows)
    placed = slices.place(known, F.unix_micros(right_ts), side="last")
    pieces = placed.groupBy(*by, "_slice").agg(F.array_sort(F.collect_list("_item")).alias("_items"))
    if slices.cuts is not None:
        pieces = pieces.unionByName(slices.all_slices(), allowMissingColumns=True).groupBy(*by, "_slice").agg(
            F.max("_items").alias("_items"))
        before = Window.partitionBy(*by).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
        earlier = F.last(F.element_at("_items", -1), ignorenulls=True).over(before)
        pieces = pieces.withColumn("_items", F.array_compact(F.concat(F.array(earlier), F.coalesce("_items", F.array()))))
    pieces = cut_lineage(pieces)
    return AsofIndex(tuple(by), right_ts, slices, pieces, steps_for(pieces.agg(F.max(F.size("_items"))).first()[0]))
