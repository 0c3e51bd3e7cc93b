"""Versioned reference data: writing versions and resolving them as of a time.

Resolvers never fall back: when nothing is valid at the time the id stays NULL.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.hashing import numbered_id, row_hash
from ..functions.rules import MATERIAL_CHANGE, float_bucket, relative_change
from ..functions.times import local_date, seconds_between, slot_of
from ..session import cut_lineage
from .asof import Highest, Latest, Total, asof_fold, asof_join
from .slots import with_previous, with_running_count

CATEGORICAL = ("exchange", "sector", "listing_status", "country", "is_etf", "is_adr", "is_spac", "borrowable_flag")
RULE_SCHEMA = "float_buckets array<string>, exclude_is_etf boolean, exclude_is_adr boolean, exclude_is_spac boolean"
_FAR_FUTURE = "9999-12-31 00:00:00"


# -- writing symbol versions --------------------------------------------------------------
def version_refreshes(
    refreshes: DataFrame, *, categorical: Sequence[str] = CATEGORICAL, shares: str = "shares_outstanding",
    free_float: str = "free_float", tie: Sequence[str] = (), slot_seconds: int = 30 * 86_400,
    current: DataFrame | None = None,
) -> DataFrame:
    """Turn vendor refreshes into versions: one row per refresh that triggers a version.

    A refresh is compared with the last accepted version, so small drifts add up. A change of
    a category or of the float bucket is always accepted, hence the accepted version always
    agrees with the preceding refresh on those fields: such changes are found with a plain
    look-back and cut each symbol into independent segments. Refreshes equal to their
    predecessor can never trigger and are dropped. Only the numeric thresholds need the
    ordered fold, and it runs per segment.

    `current` holds the latest stored version per symbol (refresh columns and `version_no`);
    new refreshes continue from there. A long history is written slice by slice this way,
    which bounds what one symbol contributes to a task by the slice.
    """
    order = ["valid_from", *tie]
    rows = refreshes.withColumn("float_bucket", float_bucket(F.col(free_float))).withColumn("_held", F.lit(False))
    if current is not None:
        held = current.select(*refreshes.columns).withColumn("float_bucket", float_bucket(F.col(free_float)))
        rows = rows.unionByName(held.withColumn("_held", F.lit(True)))
    strict = [*categorical, "float_bucket"]
    compared = [*strict, shares, free_float]
    slot = slot_of(F.col("valid_from"), slot_seconds)
    seen = with_previous(rows.withColumn("_one", F.lit(1)), ["symbol"], slot, order, [*compared, "_one"])

    def changed(names: Sequence[str]) -> Column:
        cond = F.lit(False)
        for n in names:
            cond = cond | ~F.col(n).eqNullSafe(F.col(f"prev_{n}"))
        return cond

    certain = (F.when(F.col("_held"), "HELD").when(F.col("prev__one").isNull(), "INITIAL")
               .when(changed(categorical), "CATEGORICAL")
               .when(changed(["float_bucket"]), "BUCKET_CROSS"))
    moving = seen.withColumn("_certain", certain).where(
        F.col("_certain").isNotNull() | changed([shares, free_float]))
    keep = [c for c in rows.columns] + ["_certain"]
    # Each ordered step reads its input twice, so every step starts from written rows.
    moving = cut_lineage(moving.select(*keep))
    cut = with_running_count(moving, ["symbol"], slot, order, F.col("_certain").isNotNull(), "_segment")

    item = F.struct(*order, F.col(shares).alias("_shares"), F.col(free_float).alias("_float"),
                    F.struct(*keep).alias("_row"))
    segments = cut.groupBy("symbol", "_segment").agg(
        F.sort_array(F.collect_list(item)).alias("_items"))
    zero = F.expr("named_struct('shares', cast(null as double), 'ffloat', cast(null as double), "
                  "'reasons', cast(array() as array<string>))")

    def merge(acc: Column, it: Column) -> Column:
        reason = (
            F.when(it["_row"]["_certain"].isNotNull(), it["_row"]["_certain"])
            .when(relative_change(it["_shares"], acc["shares"]) >= MATERIAL_CHANGE, "SHARES_THRESHOLD")
            .when(relative_change(it["_float"], acc["ffloat"]) >= MATERIAL_CHANGE, "FLOAT_THRESHOLD"))
        taken = reason.isNotNull()
        return F.struct(
            F.when(taken, it["_shares"]).otherwise(acc["shares"]).cast("double").alias("shares"),
            F.when(taken, it["_float"]).otherwise(acc["ffloat"]).cast("double").alias("ffloat"),
            F.concat(acc["reasons"], F.array(reason)).alias("reasons"))

    judged = segments.select(F.inline(F.arrays_zip(
        F.col("_items").alias("item"), F.aggregate("_items", zero, merge)["reasons"].alias("version_reason"))))
    versions = judged.where(F.col("version_reason").isNotNull()).select(
        *[F.col("item")["_row"][c].alias(c) for c in rows.columns], "version_reason")
    counted = with_running_count(cut_lineage(versions), ["symbol"], slot, order, F.lit(True), "version_no")
    if current is not None:
        before = current.select("symbol", (F.col("version_no") - 1).alias("_before"))
        counted = counted.join(before, "symbol", "left").withColumn(
            "version_no", F.col("version_no") + F.coalesce("_before", F.lit(0))).drop("_before")
    return counted.where(~F.col("_held")).drop("_held").withColumn("symbol_registry_id", numbered_id(F.col("symbol"), F.col("version_no"))).withColumn(
        "row_hash", row_hash(F.col("symbol"), *[F.col(c) for c in compared], F.col("valid_from")))


def latest_versions(versions: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Latest stored version per symbol, as `current` for the next slice."""
    return versions.groupBy("symbol").agg(
        F.max_by(F.struct(*[c for c in columns if c != "symbol"], "version_no"), F.col("version_no")).alias("_v")).select(
        "symbol", "_v.*")


# -- resolving ------------------------------------------------------------------------------
def resolve_symbol(signals: DataFrame, versions: DataFrame, ts: str = "signal_ts", *, zone: str = "America/New_York",
                   **kw) -> DataFrame:
    """Add `symbol_registry_id`: the latest version, provided the symbol is active on the local date.

    A latest version outside its active window rejects; older versions are not tried.
    """
    hit = asof_fold(signals, versions, ["symbol"], ts, "valid_from",
                    {"_v": Latest(("symbol_registry_id", "active_from", "active_to"))}, **kw)
    day = local_date(F.col(ts), zone)
    v = F.col("_v")
    active = (v["active_from"] <= day) & (v["active_to"].isNull() | (day < v["active_to"]))
    return hit.withColumn("symbol_registry_id", F.when(active, v["symbol_registry_id"])).drop("_v")


def resolve_regime(signals: DataFrame, regimes: DataFrame, ts: str = "signal_ts", *, spec: str = "v1",
                   cadence: str = "1H", **kw) -> DataFrame:
    """Add the market-wide `regime_snapshot_id`; its one global key is spread over slices of equal depth."""
    own = regimes.where((F.col("regime_spec_version") == spec) & (F.col("cadence") == cadence))
    return asof_join(signals, own, [], ts, "regime_ts", ["regime_snapshot_id"], tie=["regime_snapshot_id"],
                     **kw)


def latest_active(versions: DataFrame, name: str, version: str, version_id: str) -> DataFrame:
    """Highest ACTIVE version per name; versions compare as text, so "9" beats "10"."""
    return versions.where(F.col("status") == "ACTIVE").groupBy(name).agg(
        F.max_by(version_id, F.struct(version, version_id)).alias(version_id))


def resolve_setup(signals: DataFrame, setups: DataFrame) -> DataFrame:
    best = latest_active(setups, "setup_id", "version", "setup_version_id").select(
        F.col("setup_id").alias("setup_type"), F.col("setup_version_id").alias("setup_version"))
    return signals.join(best, "setup_type", "left").select(*signals.columns, "setup_version")


def resolve_scanner(signals: DataFrame, scanners: DataFrame) -> DataFrame:
    best = latest_active(scanners, "scanner_id", "scanner_spec_version", "scanner_version_id")
    return signals.join(best, "scanner_id", "left").select(*signals.columns, "scanner_version_id")


def resolve_universe(signals: DataFrame, universes: DataFrame, ts: str = "signal_ts", *,
                     tie: Sequence[str] = ("universe_version_id",), **kw) -> DataFrame:
    return asof_join(signals, universes, ["universe_id"], ts, "valid_from", ["universe_version_id"], tie=tie,
                     **kw)


# -- membership -------------------------------------------------------------------------------
def parse_rule(rule: Column) -> Column:
    """Membership rule JSON; missing exclusion flags mean exclude."""
    parsed = F.from_json(rule, T.StructType.fromDDL(RULE_SCHEMA))
    return F.struct(
        F.coalesce(parsed["float_buckets"], F.array().cast("array<string>")).alias("float_buckets"),
        *[F.coalesce(parsed[f], F.lit(True)).alias(f) for f in ("exclude_is_etf", "exclude_is_adr", "exclude_is_spac")])


def universe_members(versions: DataFrame, universes: DataFrame, universe_id: str, as_of: str, *,
                     tie: Sequence[str] = ("universe_version_id",)) -> DataFrame:
    """Symbols of a universe as of an instant (ISO text): latest version, active, passing the rule."""
    when = F.lit(as_of).cast("timestamp")
    day = local_date(when)
    rule = universes.where((F.col("universe_id") == universe_id) & (F.col("valid_from") <= when)).groupBy("universe_id").agg(
        F.max_by("membership_rule", F.struct("valid_from", *tie)).alias("_rule")).select(
        "universe_id", parse_rule(F.col("_rule")).alias("rule"))
    fields = ("active_from", "active_to", "float_bucket", "is_etf", "is_adr", "is_spac")
    latest = versions.where(F.col("valid_from") <= when).groupBy("symbol").agg(
        F.max_by(F.struct(*fields), F.struct("valid_from", "symbol_registry_id")).alias("v"))
    v, r = F.col("v"), F.col("rule")
    active = (v["active_from"] <= day) & (v["active_to"].isNull() | (day < v["active_to"]))
    kept = (
        ~(r["exclude_is_etf"] & v["is_etf"]) & ~(r["exclude_is_adr"] & v["is_adr"]) & ~(r["exclude_is_spac"] & v["is_spac"])
        & ((F.size(r["float_buckets"]) == 0) | F.array_contains(r["float_buckets"], v["float_bucket"])))
    # The rule side is a single row: one universe id, aggregated.
    return (latest.where(active).withColumn("universe_id", F.lit(universe_id))
            .join(F.broadcast(rule), "universe_id").where(kept).select("symbol").orderBy("symbol"))


def active_symbols(versions: DataFrame, as_of_date: str) -> DataFrame:
    """Symbols with any version active on the date, whatever its valid_from."""
    day = F.lit(as_of_date).cast("date")
    return versions.where((F.col("active_from") <= day) & (F.col("active_to").isNull() | (day < F.col("active_to")))
                          ).select("symbol").distinct().orderBy("symbol")


# -- data quality, news, halts ------------------------------------------------------------------
def quality_as_of(signals: DataFrame, quality: DataFrame, ts: str = "signal_ts", **kw) -> DataFrame:
    """Add the AS_OF quality record and `quarantined`; no record means not quarantined."""
    own = quality.where(F.col("pit_class") == "AS_OF")
    out = asof_join(signals, own, ["symbol"], ts, "as_of", ["dq_id", "feed_outage_active", "stale_quote"],
                    tie=["dq_id"], **kw)
    return out.withColumn("quarantined", F.coalesce(F.col("feed_outage_active") | F.col("stale_quote"), F.lit(False)))


def retrospective_quality(sessions: DataFrame, quality: DataFrame, order: Sequence[str] = ()) -> DataFrame:
    """Attach the RETROSPECTIVE record of (symbol, session_date). For analysis only.

    Of several records of a day the last by `order` (an arrival time, a run id) wins, then the greatest by content,
    so the choice never depends on the layout of the data.
    """
    own = quality.where(F.col("pit_class") == "RETROSPECTIVE").drop("pit_class")
    body = [c for c in own.columns if c not in ("symbol", "session_date")]
    content = F.to_json(F.struct(*[F.col(f"`{c}`") for c in body]), {"ignoreNullFields": "false"})
    last = own.groupBy("symbol", "session_date").agg(
        F.max_by(F.struct(*[F.col(f"`{c}`") for c in body]), F.struct(*order, content.alias("_content"))).alias("_r"))
    return sessions.join(last.select("symbol", "session_date", "_r.*"), ["symbol", "session_date"], "left")


def news_available(news: DataFrame, as_of: str, symbol: str | None = None) -> DataFrame:
    """All items available at an instant, newest first. Availability, never publication, is the key."""
    rows = news.where(F.col("news_available_ts") <= F.lit(as_of).cast("timestamp"))
    if symbol is not None:
        rows = rows.where(F.col("symbol") == symbol)
    return rows.orderBy(F.desc("news_available_ts"), "news_id")


def news_as_of(signals: DataFrame, news: DataFrame, ts: str = "signal_ts", **kw) -> DataFrame:
    """Add the latest available item and the number of available items per signal."""
    out = asof_fold(signals, news, ["symbol"], ts, "news_available_ts",
                    {"_latest": Latest(("news_id",)), "news_count": Total(F.lit(1).cast("bigint"))}, tie=["news_id"], **kw)
    return out.select(*signals.columns, F.col("_latest")["news_id"].alias("news_id"), "news_count")


def with_publication_delay(news: DataFrame) -> DataFrame:
    return news.withColumn("publication_delay_sec", seconds_between(F.col("news_available_ts"), F.col("publish_ts")))


def halt_status(signals: DataFrame, halts: DataFrame, ts: str = "signal_ts", **kw) -> DataFrame:
    """Add `halted` and the number of halts started so far.

    Halted means some halt started at or before t ends after t. That holds exactly when the
    largest end among started halts is after t, so overlapping halts need no pairwise join.
    """
    end = F.coalesce(F.col("halt_end_ts"), F.lit(_FAR_FUTURE).cast("timestamp"))
    out = asof_fold(signals, halts, ["symbol"], ts, "halt_start_ts",
                    {"_end": Highest(end), "halts_started": Total(F.lit(1).cast("bigint"))}, **kw)
    return out.withColumn("halted", F.coalesce(F.col("_end") > F.col(ts), F.lit(False))).drop("_end")


def halts_started_before(halts: DataFrame, as_of: str, symbol: str | None = None) -> DataFrame:
    rows = halts.where(F.col("halt_start_ts") <= F.lit(as_of).cast("timestamp"))
    if symbol is not None:
        rows = rows.where(F.col("symbol") == symbol)
    return rows.orderBy(F.desc("halt_start_ts"), "halt_id")


def halt_episodes(halts: DataFrame, symbol: str) -> DataFrame:
    return halts.where(F.col("symbol") == symbol).orderBy("halt_start_ts", "halt_id")
