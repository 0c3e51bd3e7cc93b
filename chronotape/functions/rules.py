"""Scalar decision rules: sanity classes, buckets, barrier decisions, equality."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Upper bound (exclusive) of each free-float bucket, smallest first.
FLOAT_BUCKETS = ((20e6, "MICRO"), (75e6, "SMALL"), (300e6, "MID"))
TOP_FLOAT_BUCKET = "LARGE"
MATERIAL_CHANGE = 0.01
PIPELINE_ROLES = ("TRAIN", "VALIDATION", "OOS", "VAULT")
CALIBRATION_ROLE = "CALIBRATION_ONLY"
TIME_ENCODINGS = ("TERNARY_ZERO", "SIGN_RETURN")


def typical_price() -> Column:
    return (F.col("high") + F.col("low") + F.col("close")) / 3.0


def linear_spread(close: Column, slope: float = 0.0008, base: float = 0.01, floor: float = 0.01) -> Column:
    return F.greatest(close * slope + base, F.lit(floor))


def _finite(x: Column) -> Column:
    x = x.cast("double")
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))


def bar_fault() -> Column:
    """First matching fault of a bar, NULL when it is sane."""
    o, h, l, c, v = (F.col(n) for n in ("open", "high", "low", "close", "volume"))
    finite = _finite(o) & _finite(h) & _finite(l) & _finite(c) & _finite(v)
    return (
        F.when(~finite, "non-finite")
        .when((l > h) | (l > F.least(o, c)) | (h < F.greatest(o, c)), "ohlc-order")
        .when(F.least(o, h, l, c) <= 0, "non-positive-price")
        .when(v < 0, "negative-volume")
    )


def quote_fault() -> Column:
    """First matching fault of a quote; equal bid and ask are fine."""
    b, a = F.col("bid"), F.col("ask")
    return (
        F.when(~(_finite(b) & _finite(a)), "non-finite")
        .when((b <= 0) | (a <= 0), "non-positive")
        .when(b > a, "crossed")
    )


def float_bucket(free_float: Column) -> Column:
    out = F.when(free_float.isNull(), F.lit(None).cast("string"))
    for bound, name in FLOAT_BUCKETS:
        out = out.when(free_float < bound, name)
    return out.otherwise(TOP_FLOAT_BUCKET)


def relative_change(new: Column, base: Column) -> Column:
    """|new - base| / |base|; a missing side or zero base is infinite when the values differ, else 0."""
    undefined = new.isNull() | base.isNull() | (base == 0)
    return (
        F.when(undefined, F.when(new.eqNullSafe(base), F.lit(0.0)).otherwise(F.lit(float("inf"))))
        .otherwise(F.abs(new - base) / F.abs(base))
    )


def same_value(a: Column, b: Column, tolerance: float = 1e-9) -> Column:
    """NULL equals only NULL, NaN equals NaN, numbers agree within the tolerance."""
    return (
        F.when(a.isNull() | b.isNull(), a.isNull() & b.isNull())
        .when(F.isnan(a) | F.isnan(b), F.isnan(a) & F.isnan(b))
        .otherwise((a == b) | (F.abs(a - b) <= tolerance))
    )


def same_map(a: Column, b: Column, tolerance: float = 1e-9) -> Column:
    """Same keys, and `same_value` for every key."""
    pair = T.StructType([T.StructField("a", T.DoubleType()), T.StructField("b", T.DoubleType())])
    keys_match = F.sort_array(F.map_keys(a)).eqNullSafe(F.sort_array(F.map_keys(b)))
    zipped = F.map_zip_with(a, b, lambda _k, x, y: F.struct(x.alias("a"), y.alias("b")).cast(pair))
    values_match = F.forall(F.map_values(zipped), lambda p: same_value(p["a"], p["b"], tolerance))
    return F.when(a.isNull() | b.isNull(), a.isNull() & b.isNull()).otherwise(keys_match & values_match)


def label_of(barrier: Column, realized_return: Column, encoding: str) -> Column:
    """+1 / -1 for barrier hits; time exits are 0 or the sign of their return."""
    if encoding not in TIME_ENCODINGS:
        raise ValueError(f"unknown time encoding {encoding}")
    at_time = F.lit(0) if encoding == "TERNARY_ZERO" else F.signum(realized_return).cast("int")
    return F.when(barrier == "PROFIT", 1).when(barrier == "STOP", -1).otherwise(at_time)


def bucket_from_anchor(minutes: Column, width: int) -> Column:
    """Floor to a multiple of `width`; negative minutes go down, not towards zero."""
    return (F.floor(minutes / width) * width).cast("bigint")


def phase_of(ts: Column, anchor: Column, unit: str = "minute") -> Column:
    at, when = F.date_trunc(unit, anchor), F.date_trunc(unit, ts)
    return F.when(when < at, "PRE").when(when == at, "AT").otherwise("POST")
