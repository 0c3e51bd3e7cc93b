"""Ordered operations over a group that may be too big for one task.

`chunk` is any column that only grows along the order (`with_chunk`, a time slot). Work is
done per (group, chunk); one summary row per chunk links them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .slices import equal_depth

CHUNK_ROWS = 65_536


def with_chunk(df: DataFrame, by: Sequence[str], order: str, rows: int = CHUNK_ROWS, name: str = "_chunk") -> DataFrame:
    """Add a chunk number that grows with `order` (an integer): about `rows` rows per chunk, however sparse the numbers are.

    Groups of at most `rows` rows are one chunk; equal numbers share a chunk.
    """
    slices = equal_depth([(df, F.col(order))], by, max_rows=rows)
    return slices.place(df, F.col(order), side="last").withColumnRenamed("_slice", name)


def with_number(df: DataFrame, by: Sequence[str], order: Sequence[str], name: str, rows: int = CHUNK_ROWS) -> DataFrame:
    """Add the dense number (from 0) of a row in its group, by `order`, whose first column is an integer.

    Two steps: counts per chunk give each chunk's offset, rows are numbered inside their chunk. Groups of at most
    `rows` rows are numbered directly.
    """
    by = list(by)
    slices = equal_depth([(df, F.col(order[0]))], by, max_rows=rows)
    if slices.cuts is None:
        return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)).cast("bigint") - 1)
    placed = slices.place(df, F.col(order[0]), side="last")
    before = Window.partitionBy(*by).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = cut_lineage(placed.groupBy(*by, "_slice").agg(F.count(F.lit(1)).alias("_n")).select(
        *by, "_slice", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset")))
    inside = F.row_number().over(Window.partitionBy(*by, "_slice").orderBy(*order)).cast("bigint") - 1
    return placed.withColumn("_inside", inside).join(offsets, [*by, "_slice"]).select(
        *df.columns, (F.col("_inside") + F.col("_offset")).alias(name))


def with_previous(
    df: DataFrame, by: Sequence[str], chunk: Column, order: Sequence[str], values: Sequence[str],
    prefix: str = "prev_",
) -> DataFrame:
    """Add `prev_<value>`: the value on the preceding row of the group (NULL on the first row).

    The last row of each chunk is repeated as a lead-in row of the next non-empty chunk, so
    `lag` never has to see more than one chunk.
    """
    by = list(by)
    rows = df.withColumn("_chunk", chunk)
    rank = F.struct(*order)
    body = F.struct(*values)
    ends = rows.groupBy(*by, "_chunk").agg(F.max_by(body, rank).alias("_body"))
    leads = ends.select(
        *by, "_chunk", F.lag("_body").over(Window.partitionBy(*by).orderBy("_chunk")).alias("_body"),
    ).where(F.col("_body").isNotNull())
    stream = rows.select(
        *by, "_chunk", rank.alias("_rank"), body.alias("_body"),
        F.struct(*df.columns).alias("_row"),
    ).unionByName(leads, allowMissingColumns=True)
    w = Window.partitionBy(*by, "_chunk").orderBy(F.col("_rank").asc_nulls_first())
    return (
        stream.withColumn("_prev", F.lag("_body").over(w))
        .where(F.col("_row").isNotNull())
        .select("_row.*", *[F.col("_prev")[v].alias(prefix + v) for v in values])
    )


def with_previous_by(df: DataFrame, by: Sequence[str], order: str, values: Sequence[str], rows: int = CHUNK_ROWS,
                     prefix: str = "prev_", longest: int | None = None) -> DataFrame:
    """`with_previous` along an integer ordinal. Groups of at most `rows` rows are read in one window, without chunks.

    `longest`: rows of the largest group, where the caller has counted them.
    """
    short = longest is not None and longest <= rows
    slices = None if short else equal_depth([(df, F.col(order))], by, max_rows=rows)
    if slices is None or slices.cuts is None:
        w = Window.partitionBy(*by).orderBy(F.col(order).asc_nulls_first())
        return df.withColumns({prefix + v: F.lag(v).over(w) for v in values})
    chunked = slices.place(df, F.col(order), side="last").withColumnRenamed("_slice", "_part")
    return with_previous(chunked, by, F.col("_part"), [order], values, prefix).drop("_part")


def with_running_count(
    df: DataFrame, by: Sequence[str], chunk: Column, order: Sequence[str], flag: Column, name: str,
) -> DataFrame:
    """Add the running count of rows where `flag` holds, in order, this row included."""
    by = list(by)
    rows = df.withColumn("_chunk", chunk).withColumn("_hit", F.when(flag, 1).otherwise(0).cast("bigint"))
    before = Window.partitionBy(*by).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    leads = rows.groupBy(*by, "_chunk").agg(F.sum("_hit").alias("_hit")).select(
        *by, "_chunk", F.coalesce(F.sum("_hit").over(before), F.lit(0)).alias("_hit"))
    stream = rows.select(
        *by, "_chunk", F.struct(*order).alias("_rank"), "_hit", F.struct(*df.columns).alias("_row"),
    ).unionByName(leads, allowMissingColumns=True)
    w = (Window.partitionBy(*by, "_chunk").orderBy(F.col("_rank").asc_nulls_first())
         .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return (
        stream.withColumn("_n", F.sum("_hit").over(w))
        .where(F.col("_row").isNotNull())
        .select("_row.*", F.col("_n").alias(name))
    )


def first_rows(df: DataFrame, by: Sequence[str], order: Sequence[str], n: int) -> DataFrame:
    """The first `n` rows of each group. Spark limits each map task to `n` rows per group
    before the shuffle, so a hot group ships only a few rows."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn")
