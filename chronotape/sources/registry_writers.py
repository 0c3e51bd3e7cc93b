"""Rows of the reference registries and their write-once tables.

Each `*_rows` function derives ids and row hashes; `write_registry` appends the rows whose
key is not stored yet. Regimes, setups, universes and scanners keep the first row of a key; quality,
news and halt records are all kept, and only a repeated run (`run_id`) stores nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.hashing import regime_id, row_hash, versioned_id
from ..functions.times import seconds_between
from .tables import append_once

# Key and arrival order of each table.
KEYS = {
    "regimes": ["regime_ts", "cadence", "regime_spec_version"], "setups": ["setup_version_id"],
    "universes": ["universe_version_id"], "scanners": ["scanner_version_id"], "quality": ["dq_id"],
    "news": ["news_id"], "halts": ["halt_id"], "symbols": ["symbol", "valid_from"],
}

# Tables that keep every record, equal ones too.
EVERY_RECORD = ("quality", "news", "halts")


def regime_rows(snapshots: DataFrame) -> DataFrame:
    c = F.col
    return snapshots.withColumn("regime_snapshot_id", regime_id(c("regime_spec_version"), c("cadence"), c("regime_ts"))).withColumn(
        "row_hash", row_hash(c("regime_ts"), c("cadence"), c("regime_spec_version"), c("risk_state")))


def setup_rows(setups: DataFrame) -> DataFrame:
    c = F.col
    return setups.withColumn("setup_version_id", versioned_id(c("setup_id"), c("version"))).withColumn(
        "status", F.coalesce(c("status"), F.lit("ACTIVE"))).withColumn(
        "row_hash", row_hash(c("setup_id"), c("version"), c("detector_ref"), c("params")))


def universe_rows(universes: DataFrame) -> DataFrame:
    """`version` names the version; the rule stays JSON text."""
    c = F.col
    return universes.withColumn("universe_version_id", versioned_id(c("universe_id"), c("version"))).withColumn(
        "row_hash", row_hash(c("universe_id"), c("version"), c("membership_rule"), c("valid_from")))


def scanner_rows(scanners: DataFrame) -> DataFrame:
    c = F.col
    return scanners.withColumn("scanner_version_id", versioned_id(c("scanner_id"), c("scanner_spec_version"))).withColumn(
        "status", F.coalesce(c("status"), F.lit("ACTIVE"))).withColumn(
        "row_hash", row_hash(c("scanner_id"), c("scanner_spec_version")))


def _recorded(records: DataFrame, id_column: str, prefix: str, run_id: str) -> DataFrame:
    """The id is a full digest over the run and all columns; `write_registry` numbers equal records."""
    whole = F.to_json(F.struct(*[F.col(f"`{c}`") for c in records.columns]), {"ignoreNullFields": "false"})
    return records.withColumn(id_column, F.concat(F.lit(prefix), F.sha2(F.concat_ws("|", F.lit(run_id), whole), 256)))


def _numbered(rows: DataFrame, id_column: str) -> DataFrame:
    """Equal records are counted (a partial aggregate) and written out again with a number each, so none is dropped."""
    counted = (rows.select(F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("r"), F.col(id_column).alias("id"))
               .groupBy("id").agg(F.first("r").alias("r"), F.count(F.lit(1)).alias("n")))
    numbered = counted.select("r", "id", F.explode(F.expr("sequence(1L, n)")).alias("k"))
    return numbered.select(*[F.concat_ws("#", "id", "k").alias(c) if c == id_column else F.col("r").getField(c).alias(c)
                             for c in rows.columns])


def quality_as_of_rows(records: DataFrame, run_id: str) -> DataFrame:
    c = F.col
    hashed = records.withColumn("pit_class", F.lit("AS_OF")).withColumn(
        "row_hash", row_hash(c("symbol"), c("as_of"), c("feed_outage_active"), c("stale_quote")))
    return _recorded(hashed, "dq_id", "DQA_", run_id)


def quality_retrospective_rows(records: DataFrame, run_id: str) -> DataFrame:
    c = F.col
    hashed = records.withColumn("pit_class", F.lit("RETROSPECTIVE")).withColumn(
        "row_hash", row_hash(c("symbol"), c("session_date"), c("missing_bars_pct")))
    return _recorded(hashed, "dq_id", "DQR_", run_id)


def news_rows(items: DataFrame, run_id: str) -> DataFrame:
    """Adds the publication delay (NULL when the publication time is unknown)."""
    c = F.col
    delayed = items.withColumn("publication_delay_sec", seconds_between(c("news_available_ts"), c("publish_ts")))
    return _recorded(delayed, "news_id", "NEWS_", run_id)


def halt_rows(halts: DataFrame, run_id: str) -> DataFrame:
    """A halt recorded open and again with its end gives two records."""
    return _recorded(halts, "halt_id", "HALT_", run_id)


def write_registry(spark: SparkSession, rows: DataFrame, path: str, kind: str, order: list[str]) -> None:
    """Append unknown keys; `order` decides which of several new rows with one key is kept."""
    if kind in EVERY_RECORD:
        rows = _numbered(rows, KEYS[kind][0])
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    append_once(spark, rows, path, ddl, KEYS[kind], order)
