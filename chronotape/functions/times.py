"""Instants, exchange-local views and market sessions. The session time zone must be UTC."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EXCHANGE_ZONE = "America/New_York"

# Session boundaries as exchange-local clock times.
PREMARKET_OPEN = "04:00"
RTH_OPEN = "09:30"
RTH_CLOSE = "16:00"
AFTERHOURS_CLOSE = "20:00"


def seconds_of(clock: str) -> int:
    hours, minutes = clock.split(":")
    return int(hours) * 3600 + int(minutes) * 60


def instant(naive: Column, zone: str = "UTC") -> Column:
    """A zone-less timestamp read as wall-clock time of `zone`."""
    stamped = naive.cast("timestamp")
    return stamped if zone == "UTC" else F.to_utc_timestamp(stamped, zone)


def iso_utc(ts: Column) -> Column:
    """ISO text with an explicit +00:00; microseconds only when there are any."""
    micros = F.when(F.unix_micros(ts) % 1_000_000 != 0, F.date_format(ts, ".SSSSSS")).otherwise("")
    return F.concat(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"), micros, F.lit("+00:00"))


def parse_instant(text: Column) -> Column:
    """ISO text to an instant. Text without a zone, or not a time at all, gives NULL."""
    has_zone = text.rlike(r"(Z|[+-]\d{2}:?\d{2})$")
    return F.when(has_zone, text.try_cast("timestamp"))


def local_time(ts: Column, zone: str = EXCHANGE_ZONE) -> Column:
    return F.from_utc_timestamp(ts, zone)


def local_date(ts: Column, zone: str = EXCHANGE_ZONE) -> Column:
    return F.to_date(local_time(ts, zone))


def local_seconds(ts: Column, zone: str = EXCHANGE_ZONE) -> Column:
    """Seconds since local midnight."""
    wall = local_time(ts, zone)
    return F.hour(wall) * 3600 + F.minute(wall) * 60 + F.second(wall)


def market_session(ts: Column, zone: str = EXCHANGE_ZONE) -> Column:
    clock = local_seconds(ts, zone)
    return (
        F.when(F.weekday(local_time(ts, zone)) >= 5, "CLOSED")
        .when((clock >= seconds_of(PREMARKET_OPEN)) & (clock < seconds_of(RTH_OPEN)), "PREMARKET")
        .when((clock >= seconds_of(RTH_OPEN)) & (clock < seconds_of(RTH_CLOSE)), "RTH")
        .when((clock >= seconds_of(RTH_CLOSE)) & (clock < seconds_of(AFTERHOURS_CLOSE)), "AFTERHOURS")
        .otherwise("CLOSED")
    )


def seconds_between(later: Column, earlier: Column) -> Column:
    """Signed seconds, never corrected when negative."""
    return (F.unix_micros(later) - F.unix_micros(earlier)) / F.lit(1_000_000.0)


def slot_of(ts: Column, width_seconds: int) -> Column:
    """Index of the fixed-width time slot that holds `ts`."""
    return F.floor(F.unix_micros(ts) / F.lit(width_seconds * 1_000_000)).cast("bigint")
