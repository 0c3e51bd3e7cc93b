"""Counts, coverage and integrity audit of stored observations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import registry_signature

_MONTH = "month"
_DIMENSIONS = {
    "regime": "regime_snapshot_id", "setup": "setup_type", "symbol": "symbol", "universe": "universe_version_id",
    "label": "label_spec_id", "month": _MONTH, "role": "dataset_role"}
_REFERENCES = {
    "symbol": "symbol_registry_id", "regime": "regime_snapshot_id", "setup": "setup_version",
    "label": "label_spec_id", "universe": "universe_version_id", "scanner": "scanner_version_id"}


def month_of(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM")


def dataset_counts(observations: DataFrame) -> DataFrame:
    """(dimension, value, n) for every dimension and the total, in one pass over grouping sets."""
    rows = observations.withColumn(_MONTH, month_of(F.col("signal_ts"))).select(*_DIMENSIONS.values())
    columns = list(_DIMENSIONS.values())
    grouped = rows.groupingSets([[c] for c in columns] + [[]], *columns).agg(
        F.count("*").alias("n"), F.grouping_id().alias("_g"))
    every = (1 << len(columns)) - 1
    dimension, value = F.when(F.col("_g") == every, "total"), F.when(F.col("_g") == every, "")
    for i, (name, column) in enumerate(_DIMENSIONS.items()):
        own = every ^ (1 << (len(columns) - 1 - i))
        dimension = dimension.when(F.col("_g") == own, name)
        value = value.when(F.col("_g") == own, F.col(column))
    return grouped.select(dimension.alias("dimension"), value.alias("value"), "n").orderBy("dimension", "value")


def coverage(observations: DataFrame) -> DataFrame:
    """Row count and exact distinct counts, as (metric, value).

    Values are made distinct per dimension first, so the count itself sees few rows.
    """
    wanted = {"distinct_regimes": F.col("regime_snapshot_id"), "distinct_symbols": F.col("symbol"),
              "distinct_labels": F.col("label_spec_id"), "distinct_months": month_of(F.col("signal_ts")),
              "distinct_universes": F.col("universe_version_id")}
    pairs = F.array(*[F.struct(F.lit(k).alias("metric"), v.alias("v")) for k, v in wanted.items()])
    seen = observations.select(F.inline(pairs)).groupBy("metric", "v").agg(F.count("*").alias("_n"))
    per = seen.groupBy("metric").agg(F.count("*").alias("value"))
    total = observations.agg(F.count("*").alias("value")).select(F.lit("observations").alias("metric"), "value")
    return total.unionByName(per)


def duplicate_observations(observations: DataFrame) -> DataFrame:
    return observations.groupBy("symbol", "signal_ts", "setup_type").agg(F.count("*").alias("n")).where(F.col("n") > 1)


def bad_signatures(observations: DataFrame) -> DataFrame:
    same = F.coalesce(F.col("registry_signature_hash") == registry_signature(), F.lit(False))
    return observations.where(~same).select("observation_id")


def pit_violations(observations: DataFrame) -> DataFrame:
    return observations.where(F.col("data_as_of_ts") > F.col("signal_ts")).select("observation_id")


def long_only_violations(observations: DataFrame) -> DataFrame:
    return observations.where(F.col("direction") != "LONG").select("observation_id")


def orphans(observations: DataFrame, known: dict[str, DataFrame]) -> DataFrame:
    """(dimension, observation_id) of references missing from the known one-column id sets.

    Dimensions without a set are skipped. References are made distinct before they are
    checked; only missing ids go back to the rows.
    """
    total = None
    for name, ids in known.items():
        column = _REFERENCES[name]
        have = ids.select(F.col(ids.columns[0]).alias(column)).distinct()
        missing = observations.select(column).distinct().join(have, column, "left_anti").select(
            F.col(column).alias("_missing"))
        found = observations.join(missing, F.col(column).eqNullSafe(F.col("_missing")), "left_semi").select(
            F.lit(name).alias("dimension"), "observation_id")
        total = found if total is None else total.unionByName(found)
    return total


def with_news_flag(observations: DataFrame, archive: DataFrame) -> DataFrame:
    """Add `has_news`: some archived item of the symbol was available by the signal.

    The earliest availability per ticker answers that; no item-level join is needed.
    """
    earliest = archive.select(F.explode("tickers").alias("symbol"), "available_ts").groupBy("symbol").agg(
        F.min("available_ts").alias("_first"))
    return observations.join(earliest, "symbol", "left").withColumn(
        "has_news", F.coalesce(F.col("_first") <= F.col("signal_ts"), F.lit(False))).drop("_first")


def news_coverage(observations: DataFrame, archive: DataFrame) -> DataFrame:
    flags = with_news_flag(observations, archive).agg(
        F.count("*").alias("observations"), F.coalesce(F.sum(F.col("has_news").cast("bigint")), F.lit(0)).alias("with_available_news"))
    n, w = F.col("observations"), F.col("with_available_news")
    return flags.select(n, w, (n - w).alias("without_news"),
                        F.when(n > 0, F.round(F.lit(100.0) * w / n, 1)).otherwise(0.0).alias("coverage_pct"))


def audit(observations: DataFrame, known: dict[str, DataFrame] | None = None, archive: DataFrame | None = None, *,
          quality_supplied: bool = False, halts_supplied: bool = False, actions_supplied: bool = False) -> DataFrame:
    """The audit as (metric, value, status). Absent feeds are named, not guessed."""
    def line(df: DataFrame, metric: str) -> DataFrame:
        return df.agg(F.count("*").cast("double").alias("value")).select(
            F.lit(metric).alias("metric"), "value", F.lit("").alias("status"))

    spark = observations.sparkSession
    out = coverage(observations).select("metric", F.col("value").cast("double").alias("value"), F.lit("").alias("status"))
    for metric, rows in (("duplicate_observations", duplicate_observations(observations)),
                         ("signature_integrity_failures", bad_signatures(observations)),
                         ("pit_violations", pit_violations(observations)),
                         ("long_only_violations", long_only_violations(observations))):
        out = out.unionByName(line(rows, metric))
    if known is not None:
        lost = orphans(observations, known)
        per = lost.groupBy("dimension").agg(F.count("*").cast("double").alias("value")).select(
            F.concat(F.lit("orphans_"), "dimension").alias("metric"), "value", F.lit("").alias("status"))
        out = out.unionByName(line(lost, "orphan_observations")).unionByName(per)
    if archive is not None:
        out = out.unionByName(news_coverage(observations, archive).select(
            F.lit("news_coverage_pct").alias("metric"), F.col("coverage_pct").alias("value"), F.lit("").alias("status")))
    feeds = [
        ("missing_bars", "SEE_RETROSPECTIVE_RECORDS" if quality_supplied else "REQUIRES_DATA_QUALITY_FEED"),
        ("halt_coverage", "AVAILABLE" if halts_supplied else "REQUIRES_HALT_REGISTRY"),
        ("corporate_action_coverage", "AVAILABLE" if actions_supplied else "REQUIRES_SYMBOL_REGISTRY_CA")]
    return out.unionByName(spark.createDataFrame([(m, None, s) for m, s in feeds], "metric string, value double, status string"))
