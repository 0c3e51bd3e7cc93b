"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut_lineage


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One step: link the larger (or not larger) neighbours of each vertex to its smallest neighbour."""
    if large:
        sides = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        sides = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    # The smallest neighbour is a partial aggregate; the join back has both sides exchanged, so a hub can be split.
    least = cut_lineage(sides.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")))
    joined = sides.join(least, "u")
    if large:
        out = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return out.where("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(u, root): the smallest vertex reachable from each vertex u that is not such a root itself. edges: (u, v) bigint."""
    edges = cut_lineage(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct())
    state = None
    while True:
        edges = cut_lineage(_star(_star(edges, large=True), large=False))
        row = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(row) == state or row[0] == 0:
            return edges.select("u", F.col("v").alias("root"))
        state = tuple(row)
