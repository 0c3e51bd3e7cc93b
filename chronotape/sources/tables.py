"""Append-only tables on shared storage, write-once by key.

Files are the store; status is always derived from appended events. Data is written before
the manifest event that declares it, so a run that dies in between is simply repeated and
the key check turns the repeat into a no-op. One writer per table at a time.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.slots import first_rows
from ..schemas import struct_of


def read_table(spark: SparkSession, path: str, ddl: str) -> DataFrame:
    """Rows of a table, or none when nothing was written yet."""
    try:
        return spark.read.schema(ddl).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], struct_of(ddl))


def append(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    writer = df.write.mode("append")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def new_rows(incoming: DataFrame, store: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Rows to append under keep-first semantics: one per key, unknown to the store."""
    return first_rows(incoming, key, order, 1).join(store.select(*key), list(key), "left_anti")


def append_once(spark: SparkSession, incoming: DataFrame, path: str, ddl: str, key: Sequence[str],
                order: Sequence[str], partition_by: Sequence[str] = ()) -> None:
    """Append the unknown keys of `incoming`; repeating the call adds nothing."""
    store = read_table(spark, path, ddl)
    append(new_rows(incoming, store, key, order).select(*[f.name for f in struct_of(ddl).fields]), path, partition_by)


def conflicts(incoming: DataFrame, store: DataFrame, key: str, content: str, order: Sequence[str]) -> DataFrame:
    """Verdict per incoming definition: NEW, SAME (equal content, idempotent) or CONFLICT.

    The governing content of an id is the stored one, else the first incoming one.
    """
    first = first_rows(incoming, [key], order, 1).select(key, F.col(content).alias("_first"), F.struct(*order).alias("_rank"))
    held = store.groupBy(key).agg(F.min(content).alias("_held"))
    joined = incoming.join(first, key, "left").join(held, key, "left")
    governing = F.coalesce("_held", "_first")
    verdict = (F.when(F.col(content) != governing, "CONFLICT")
               .when(F.col("_held").isNull() & (F.struct(*order) == F.col("_rank")), "NEW").otherwise("SAME"))
    return joined.withColumn("verdict", verdict).drop("_first", "_held", "_rank")


# -- manifest -----------------------------------------------------------------------------
STARTED, COMMITTED, QUARANTINED, NONE = "STARTED", "COMMITTED", "QUARANTINED", "NONE"
_COUNTS = ("candidate_count", "stored_count", "duplicate_count", "rejected_count", "burned_count")


def manifest_events(rows: DataFrame, event_type: str | Column, run_id: str, step: int, detail: str = "") -> DataFrame:
    """Manifest rows for a set of batches. Events of a run are ordered by (run_id, step)."""
    have = set(rows.columns)
    kind = F.lit(event_type) if isinstance(event_type, str) else event_type
    return rows.select(
        F.lit(run_id).alias("run_id"), F.lit(step).cast("bigint").alias("seq"), "symbol", "session",
        kind.alias("event_type"), *[
            (F.col(c) if c in have else F.lit(None)).cast("string").alias(c) for c in ("content_hash", "verdict")],
        *[(F.col(c) if c in have else F.lit(None)).cast("bigint").alias(c) for c in _COUNTS],
        F.lit(detail).alias("detail"))


def batch_status(manifest: DataFrame) -> DataFrame:
    """Latest event type per batch."""
    return manifest.groupBy("symbol", "session").agg(F.max_by("event_type", F.struct("run_id", "seq")).alias("status"))


def history(manifest: DataFrame) -> DataFrame:
    """All events of each batch, numbered from 1 in the order in which they were written."""
    order = Window.partitionBy("symbol", "session").orderBy("run_id", "seq", "event_type")
    return manifest.withColumn("step", F.row_number().over(order).cast("bigint"))


def status_of(specs: DataFrame, manifest: DataFrame) -> DataFrame:
    return specs.join(batch_status(manifest), ["symbol", "session"], "left").withColumn(
        "status", F.coalesce("status", F.lit(NONE)))


def pending(specs: DataFrame, manifest: DataFrame) -> DataFrame:
    """Specs whose latest event is not COMMITTED."""
    done = batch_status(manifest).where(F.col("status") == COMMITTED)
    return specs.join(done, ["symbol", "session"], "left_anti")


# -- provenance ---------------------------------------------------------------------------
def same_content(provenance: DataFrame) -> DataFrame:
    """Content hashes validated more than once, with their number of records."""
    return provenance.groupBy("content_hash").agg(F.count("*").alias("n")).where(F.col("n") > 1)


def provenance_by_hash(provenance: DataFrame, content_hash: str) -> DataFrame:
    return provenance.where(F.col("content_hash") == content_hash)
