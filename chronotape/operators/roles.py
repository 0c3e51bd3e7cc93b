"""Dataset roles: burned calibration slices and chronological partitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.rules import CALIBRATION_ROLE, PIPELINE_ROLES


def burned_days(burned: DataFrame) -> DataFrame:
    """Burned slices as distinct (symbol, day) rows; symbol NULL stands for every symbol."""
    symbols = F.coalesce(F.col("symbols"), F.array(F.lit(None).cast("string")))
    return burned.select(F.explode(symbols).alias("symbol"), F.sequence("start_date", "end_date").alias("_days")).select(
        "symbol", F.explode("_days").alias("day")).distinct()


def with_burned(rows: DataFrame, burned: DataFrame, day: Column) -> DataFrame:
    """Add `burned`. Slices become days first, so both lookups are equality joins."""
    days = burned_days(burned)
    own = days.where(F.col("symbol").isNotNull()).select("symbol", F.col("day").alias("_day"), F.lit(True).alias("_own"))
    everyone = days.where(F.col("symbol").isNull()).select(F.col("day").alias("_day"), F.lit(True).alias("_any"))
    return (rows.withColumn("_day", day).join(own, ["symbol", "_day"], "left").join(everyone, "_day", "left")
            .select(*rows.columns, (F.col("_own").isNotNull() | F.col("_any").isNotNull()).alias("burned")))


def role_of(burned: Column, day: Column, train_end: str | None = None, val_end: str | None = None,
            oos_end: str | None = None) -> Column:
    """Burned first; without boundaries everything else is TRAIN; a missing later boundary is skipped."""
    role = F.when(burned, CALIBRATION_ROLE)
    if train_end is None:
        return role.otherwise("TRAIN")
    for end, name in ((train_end, "TRAIN"), (val_end, "VALIDATION"), (oos_end, "OOS")):
        if end is not None:
            role = role.when(day <= F.lit(end).cast("date"), name)
    return role.otherwise("VAULT")


def assign_roles(rows: DataFrame, burned: DataFrame, day: Column, **boundaries: str | None) -> DataFrame:
    marked = with_burned(rows, burned, day)
    return marked.withColumn("dataset_role", role_of(F.col("burned"), day, **boundaries))


def pipeline_rows(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("dataset_role").isin(*PIPELINE_ROLES))


def assert_no_calibration_leak(rows: DataFrame) -> None:
    """Raise when a calibration row is present; looks at six ids at most."""
    leaked = [r[0] for r in rows.where(F.col("dataset_role") == CALIBRATION_ROLE).select("observation_id").limit(6).collect()]
    if leaked:
        more = " ..." if len(leaked) > 5 else ""
        raise AssertionError(f"{CALIBRATION_ROLE} rows leaked: {leaked[:5]}{more}")


def outside_embargo(rows: DataFrame, day: Column, boundaries: list[str], embargo_days: int) -> DataFrame:
    """Drop rows within the embargo after a partition boundary."""
    kept = F.lit(True)
    for b in boundaries:
        end = F.lit(b).cast("date")
        kept = kept & ~((day > end) & (day <= F.date_add(end, embargo_days)))
    return rows.where(kept)


def burn_fingerprint(burned: DataFrame) -> DataFrame:
    """One row: 16 hex digits over the sorted slice texts (a ledger holds few slices)."""
    who = F.when(F.col("symbols").isNull(), "ALL").otherwise(F.array_join(F.sort_array("symbols"), ","))
    text = F.concat_ws("|", F.col("start_date").cast("string"), F.col("end_date").cast("string"), who)
    joined = F.array_join(F.sort_array(F.collect_list(text)), "\n")
    return burned.agg(F.substring(F.sha2(joined, 256), 1, 16).alias("fingerprint"))
