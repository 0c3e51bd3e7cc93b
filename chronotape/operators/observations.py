"""Candidates -> signed observations or reasoned rejections."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import SIGNATURE_FIELDS, candidate_key, digest, registry_signature
from ..functions.times import EXCHANGE_ZONE, iso_utc, local_date
from ..session import cut_lineage
from .asof import MAX_ROWS, Highest, asof_fold
from .registries import resolve_regime, resolve_scanner, resolve_setup, resolve_symbol, resolve_universe
from .roles import assign_roles

SCHEMA_VERSION = "obs-1"
LONG_ONLY = "LONG_ONLY_VIOLATION"
BURNED = "BURNED_CALIBRATION_SLICE"

# Reason codes in the order in which they are checked.
MISSING_REFERENCE = (
    ("symbol_registry_id", "MISSING_SYMBOL_VERSION"),
    ("regime_snapshot_id", "MISSING_REGIME_SNAPSHOT"),
    ("setup_version", "UNKNOWN_SETUP"),
    ("universe_version_id", "MISSING_UNIVERSE_VERSION"),
    ("scanner_version_id", "UNKNOWN_SCANNER"),
)
REJECTION_CODES = (*[code for _, code in MISSING_REFERENCE], LONG_ONLY, "UNEXPECTED_ERROR")
EXCLUSION_CODES = (BURNED,)


@dataclass
class References:
    symbols: DataFrame
    regimes: DataFrame
    setups: DataFrame
    universes: DataFrame
    scanners: DataFrame
    label_spec_id: str
    regime_spec: str = "v1"
    cadence: str = "1H"


def with_data_as_of(candidates: DataFrame, bars: DataFrame, by: Sequence[str] = ("symbol", "session")) -> DataFrame:
    """Add `data_as_of_ts`: the newest bar at or before the signal, else the signal time itself.

    Sessions are bounded by the calendar, so they are not cut further.
    """
    out = asof_fold(candidates, bars, by, "signal_ts", "ts", {"_bar": Highest(F.col("ts"))}, max_rows=None)
    return out.withColumn("data_as_of_ts", F.coalesce("_bar", "signal_ts")).drop("_bar")


def resolve_references(candidates: DataFrame, refs: References, *, zone: str = EXCHANGE_ZONE,
                       max_rows: int | None = MAX_ROWS) -> DataFrame:
    """Resolve all references as of the signal and set `reason_code` (NULL when complete).

    Only row number, keys and time go through the as-of joins; the ids are joined back once.
    """
    rows = cut_lineage(candidates.withColumn("_row", F.monotonically_increasing_id()))
    thin = rows.select("_row", "symbol", "universe_id", "signal_ts")
    ids = resolve_symbol(thin, refs.symbols, zone=zone, max_rows=max_rows, asked=thin)
    ids = resolve_regime(ids, refs.regimes, spec=refs.regime_spec, cadence=refs.cadence, max_rows=max_rows, asked=thin)
    ids = resolve_universe(ids, refs.universes, max_rows=max_rows, asked=thin).drop("symbol", "universe_id", "signal_ts")
    out = resolve_scanner(resolve_setup(rows.join(ids, "_row").drop("_row"), refs.setups), refs.scanners)
    reason = F.when(F.col("direction") != "LONG", LONG_ONLY)
    for column, code in MISSING_REFERENCE:
        reason = reason.when(F.col(column).isNull(), code)
    return out.withColumn("label_spec_id", F.lit(refs.label_spec_id)).withColumn("reason_code", reason)


def no_features(observations: DataFrame) -> Column:
    """Default feature computer: an empty map."""
    return F.create_map().cast("map<string,double>")


def build_observations(
    candidates: DataFrame, refs: References, burned: DataFrame, *, zone: str = EXCHANGE_ZONE,
    features: Callable[[DataFrame], Column] = no_features,
    **boundaries: str | None,
) -> DataFrame:
    """All candidates with their observation fields, `candidate_key` and final `reason_code`.

    Signature and key exist only for complete rows. A complete but burned row keeps its key
    and gets the exclusion code. `candidates` needs `data_as_of_ts`.
    """
    rows = resolve_references(candidates, refs, zone=zone)
    rows = assign_roles(rows, burned, local_date(F.col("signal_ts"), zone), **boundaries)
    signed = F.col("reason_code").isNull()
    rows = rows.withColumn("registry_signature_hash", F.when(signed, registry_signature()))
    rows = rows.withColumn("candidate_key", F.when(signed, candidate_key(
        F.col("symbol"), F.col("signal_ts"), F.col("setup_type"), F.col("scanner_id"),
        F.col("registry_signature_hash"))).otherwise(""))
    rows = rows.withColumn("reason_code", F.when(signed & F.col("burned"), BURNED).otherwise(F.col("reason_code")))
    return rows.withColumns({
        "observation_id": F.when(signed, digest([F.lit("obs"), F.col("candidate_key")], 32)),
        "schema_version": F.lit(SCHEMA_VERSION),
        "features": features(rows),
    })


def accepted(built: DataFrame) -> DataFrame:
    return built.where(F.col("reason_code").isNull())


def refused(built: DataFrame) -> DataFrame:
    """Rejections and exclusions; the key is empty when the row was refused before signing."""
    return built.where(F.col("reason_code").isNotNull()).select(
        "candidate_key", "reason_code", F.concat_ws(" ", "reason_code", "symbol", iso_utc(F.col("signal_ts"))).alias("message"),
        "symbol", "signal_ts", "setup_type", "scanner_id")


def rejections_only(refusals: DataFrame) -> DataFrame:
    return refusals.where(F.col("reason_code").isin(*REJECTION_CODES))


def exclusions_only(refusals: DataFrame) -> DataFrame:
    return refusals.where(F.col("reason_code").isin(*EXCLUSION_CODES))


def by_code(refusals: DataFrame) -> DataFrame:
    return refusals.groupBy("reason_code").agg(F.count("*").alias("n"))


def evaluate(observations: DataFrame) -> DataFrame:
    """Non-raising checks of stored rows: fully signed, signature match, PIT, long-only, passed."""
    ids = [*SIGNATURE_FIELDS, "registry_signature_hash"]
    signed = F.lit(True)
    for c in ids:
        signed = signed & (F.coalesce(F.col(c), F.lit("")) != "")
    checks = {
        "fully_signed": signed,
        "signature_match": F.coalesce(F.col("registry_signature_hash") == registry_signature(), F.lit(False)),
        "pit_ok": F.coalesce(F.col("data_as_of_ts") <= F.col("signal_ts"), F.lit(False)),
        "long_only": F.coalesce(F.col("direction") == "LONG", F.lit(False)),
    }
    out = observations.withColumns(checks)
    return out.withColumn("passed", F.col("fully_signed") & F.col("signature_match") & F.col("pit_ok") & F.col("long_only"))


def assert_signed(observations: DataFrame) -> None:
    bad = evaluate(observations).where(~F.col("passed")).select("observation_id").limit(5).collect()
    if bad:
        raise AssertionError(f"unsigned or inconsistent observations: {[r[0] for r in bad]}")
