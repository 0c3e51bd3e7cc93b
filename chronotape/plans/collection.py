"""Collection: validated batches -> observed candidates -> write-once store with full accounting."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schemas as S
from ..functions.rules import CALIBRATION_ROLE
from ..functions.times import EXCHANGE_ZONE
from ..operators import observations as O
from ..operators.bars import SESSION
from ..operators.quality import Streams
from ..operators.roles import assert_no_calibration_leak
from ..session import cut_lineage
from ..sources import tables as T
from .validation import validate

_STORE_DDL = "candidate_key string, " + S.OBSERVATIONS + ", session string"
_COUNTS = ["candidate_count", "stored_count", "duplicate_count", "rejected_count", "burned_count"]


def _store_columns() -> list[str]:
    return [f.name for f in S.struct_of(_STORE_DDL).fields]


@dataclass
class StorePaths:
    root: str

    @property
    def observations(self) -> str:
        return f"{self.root}/observations"

    @property
    def rejections(self) -> str:
        return f"{self.root}/rejections"

    @property
    def manifest(self) -> str:
        return f"{self.root}/manifest"

    @property
    def provenance(self) -> str:
        return f"{self.root}/provenance"


def fresh_rows(built: DataFrame, store: DataFrame) -> DataFrame:
    """Rows to store: the first accepted row of each key the store does not hold."""
    order = ["signal_ts", "candidate_batch_id", "scanner_rank"]
    return T.new_rows(O.accepted(built), store, ["candidate_key"], order)


def unrecorded(refusals: DataFrame, store: DataFrame) -> DataFrame:
    """Refusals the store lacks. A broken run has written all copies of a refusal or none, so copies stay together."""
    held = store.select(*refusals.columns).distinct().alias("s")
    equal = reduce(lambda a, b: a & b, [F.col(f"r.{c}").eqNullSafe(F.col(f"s.{c}")) for c in refusals.columns])
    return refusals.alias("r").join(held, equal, "left_anti")


def account(spine: DataFrame, built: DataFrame, store: DataFrame) -> DataFrame:
    """Counts per batch of the spine; batches without candidates count zero.

    Copies of a key collapse to one counted row before the store is consulted.
    """
    burned = F.col("reason_code") == O.BURNED
    seen = built.groupBy(*SESSION, "candidate_key", burned.alias("_burned"), F.col("reason_code").isNull().alias("_signed")).agg(
        F.count("*").alias("_n"))
    known = store.select("candidate_key").distinct().withColumn("_known", F.lit(True))
    rows = seen.join(known, "candidate_key", "left")
    new = (F.col("_signed") & F.col("_known").isNull()).cast("bigint")
    counts = rows.groupBy(*SESSION).agg(
        F.sum("_n").alias("candidate_count"), F.sum(new).alias("stored_count"),
        F.sum(F.when(F.col("_signed"), F.col("_n") - new).otherwise(0)).alias("duplicate_count"),
        F.sum(F.when(~F.col("_signed") & ~F.col("_burned"), F.col("_n")).otherwise(0)).alias("rejected_count"),
        F.sum(F.when(F.coalesce("_burned", F.lit(False)), F.col("_n")).otherwise(0)).alias("burned_count"))
    return spine.join(counts, SESSION, "left").fillna(0, subset=_COUNTS)


def assert_accounted(counts: DataFrame, fresh: DataFrame) -> None:
    """Every candidate has exactly one fate, and as many rows are written as are counted as stored."""
    written = fresh.groupBy(*SESSION).agg(F.count("*").alias("_written"))
    total = F.col("stored_count") + F.col("duplicate_count") + F.col("rejected_count") + F.col("burned_count")
    off = (F.col("candidate_count") != total) | (F.col("stored_count") != F.coalesce("_written", F.lit(0)))
    bad = counts.join(written, SESSION, "left").where(off).limit(1).collect()
    if bad:
        raise AssertionError(f"candidates are not fully accounted for: {bad[0].asDict()}")


def collect(
    specs: DataFrame, streams: Streams, candidates: Callable[[DataFrame], DataFrame] | DataFrame, refs: O.References,
    burned: DataFrame, paths: StorePaths, run_id: str, *, quarantine_on_warn: bool = False, zone: str = EXCHANGE_ZONE,
    features: Callable[[DataFrame], Column] = O.no_features,
    bar_features: Callable[[DataFrame, DataFrame], DataFrame] | None = None, boundaries: dict[str, str] | None = None,
    validation: dict | None = None,
) -> DataFrame:
    """Collect all pending batches; returns one row per spec with status, verdict and counts.

    `candidates` is a frame, or a function of the passing batches. `run_id` must sort after
    earlier runs (a timestamp text does). Committed batches are skipped. Order of writes:
    observations, rejections, then the COMMITTED events; a run that dies earlier is repeated
    and stores nothing twice. `features` computes from the observation rows, `bar_features` (`features.from_bars`) from
    the bars known at the signal; both end up in the stored map.
    """
    spark = specs.sparkSession
    specs = specs.select(*SESSION).distinct()
    manifest = T.read_table(spark, paths.manifest, S.MANIFEST)
    # Later manifest appends must not change what this run considers pending.
    todo = cut_lineage(T.pending(specs, manifest))
    skipped = specs.join(todo, SESSION, "left_anti").withColumn("status", F.lit("SKIPPED"))

    checked = validate(todo, streams, run_id=run_id, **(validation or {}))
    provenance = cut_lineage(checked.provenance)
    T.append_once(spark, provenance, paths.provenance, S.PROVENANCE, ["provenance_id"], ["fetch_ts"])
    batches = provenance.select("symbol", F.col("range_start").alias("session"), "content_hash", "verdict")
    T.append(T.manifest_events(batches, T.STARTED, run_id, 0), paths.manifest)
    withheld = F.col("verdict") == "FAIL"
    if quarantine_on_warn:
        withheld = withheld | (F.col("verdict") == "WARN")
    quarantined = batches.where(withheld)
    T.append(T.manifest_events(quarantined, T.QUARANTINED, run_id, 1, "verdict gate"), paths.manifest)

    passing = batches.where(~withheld)
    found = candidates(passing.select(*SESSION)) if callable(candidates) else candidates.join(
        passing.select(*SESSION), SESSION, "left_semi")
    make = features
    if bar_features is not None:
        found = bar_features(found, streams.bars)

        def make(rows: DataFrame) -> Column:
            return F.map_concat(F.coalesce("bar_features", F.create_map().cast("map<string,double>")), features(rows))
    seen = O.with_data_as_of(found, streams.bars)
    built = O.build_observations(seen, refs, burned, zone=zone, features=make, **(boundaries or {}))
    store = T.read_table(spark, paths.observations, _STORE_DDL)
    # Keys contain the signal time, so only the sessions of this run can hold duplicates.
    low, high = passing.agg(F.min("session"), F.max("session")).head()
    if low is not None:
        store = store.where(F.col("session").between(low, high))
    built = cut_lineage(built)
    # Both read the store as it was before this run appends to it.
    counts = cut_lineage(account(passing.select(*SESSION), built, store))
    fresh = cut_lineage(fresh_rows(built, store).withColumn("ingestion_ts", F.current_timestamp()))
    assert_accounted(counts, fresh)
    assert_no_calibration_leak(fresh)
    T.append(fresh.select(*_store_columns()), paths.observations, ["session"])
    T.append(unrecorded(O.refused(built), T.read_table(spark, paths.rejections, S.REJECTIONS)), paths.rejections)
    done = counts.join(passing, SESSION)
    T.append(T.manifest_events(done, T.COMMITTED, run_id, 2), paths.manifest)

    columns = [*SESSION, "status", "verdict", *_COUNTS]
    return (done.withColumn("status", F.lit(T.COMMITTED)).select(*columns)
            .unionByName(quarantined.withColumn("status", F.lit(T.QUARANTINED)).select(*SESSION, "status", "verdict"),
                         allowMissingColumns=True)
            .unionByName(skipped, allowMissingColumns=True).fillna(0, subset=_COUNTS))


def read_observations(spark, paths: StorePaths) -> DataFrame:
    return T.read_table(spark, paths.observations, _STORE_DDL)


def burned_in_store(observations: DataFrame) -> DataFrame:
    return observations.where(F.col("dataset_role") == CALIBRATION_ROLE)
