"""Datasets cut from stored observations: selection, optional labels, features in long form."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.hashing import digest
from ..operators.roles import pipeline_rows


def select_observations(
    observations: DataFrame, *, roles: list[str] | None = None, start: str | None = None, end: str | None = None,
    regimes: list[str] | None = None, universes: list[str] | None = None, label_spec_id: str | None = None,
    labels: DataFrame | None = None,
) -> DataFrame:
    """Pipeline rows within the limits; `labels` (candidate_key, label) are attached when given."""
    rows = pipeline_rows(observations)
    for column, wanted in (("dataset_role", roles), ("regime_snapshot_id", regimes), ("universe_version_id", universes)):
        if wanted is not None:
            rows = rows.where(F.col(column).isin(wanted))
    if start is not None:
        rows = rows.where(F.col("session") >= start)
    if end is not None:
        rows = rows.where(F.col("session") <= end)
    if label_spec_id is not None:
        rows = rows.where(F.col("label_spec_id") == label_spec_id)
    return rows if labels is None else rows.join(labels, "candidate_key", "left")


def dataset_version(rows: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """One row (n_rows, dataset_version): an order-free hash of the content of `columns` (all, if not given).

    Each row gives a full sha-256 digest; the sums of its eight 32-bit words and the row count make the version. Sums are
    partial aggregates, so no list grows with the data set, and repeated rows count.
    """
    kinds = {f.name: f.dataType for f in rows.schema.fields}
    parts = [F.array_sort(F.map_entries(c)).alias(c) if isinstance(kinds[c], T.MapType) else F.col(c)
             for c in sorted(columns or rows.columns)]
    hashed = rows.select(F.sha2(F.to_json(F.struct(*parts), {"ignoreNullFields": "false"}), 256).alias("_h"))
    words = [F.sum(F.conv(F.substring("_h", 1 + 8 * i, 8), 16, 10).cast("decimal(20,0)")).alias(f"_w{i}") for i in range(8)]
    total = hashed.agg(F.count("*").alias("n_rows"), *words)
    return total.select("n_rows", digest([F.col("n_rows"), *[F.col(f"_w{i}") for i in range(8)]]).alias("dataset_version"))


def features_long(observations: DataFrame) -> DataFrame:
    """Feature namespace: one (observation_id, feature, value) row per map entry."""
    return observations.select("observation_id", F.explode("features").alias("feature", "value"))
