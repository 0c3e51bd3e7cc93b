"""Deterministic ids, signatures and content hashes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .times import iso_utc

# Fixed order of the six reference ids inside a signature.
SIGNATURE_FIELDS = (
    "symbol_registry_id", "regime_snapshot_id", "setup_version",
    "label_spec_id", "universe_version_id", "scanner_version_id",
)


def digest(parts: Sequence[Column], length: int = 64, sep: str = "|") -> Column:
    """sha-256 over the parts; a NULL part counts as empty text, so positions never shift."""
    texts = [F.coalesce(p.cast("string"), F.lit("")) for p in parts]
    return F.substring(F.sha2(F.concat_ws(sep, *texts), 256), 1, length)


def registry_signature(*ids: Column) -> Column:
    """16 hex digits over the six reference ids, in SIGNATURE_FIELDS order."""
    columns = ids or tuple(F.col(c) for c in SIGNATURE_FIELDS)
    return digest(columns, 16)


def candidate_key(symbol: Column, signal_ts: Column, setup: Column, scanner: Column, signature: Column) -> Column:
    return digest([symbol, iso_utc(signal_ts), setup, scanner, signature], 32)


def row_hash(*fields: Column) -> Column:
    """Row hash of a registry row; NULL is rendered as the text None."""
    return digest([F.coalesce(f.cast("string"), F.lit("None")) for f in fields], 16)


def canonical_hash(fields: dict[str, Column], length: int = 64) -> Column:
    """Hash of compact JSON with sorted keys. Leave out the hash itself and creation times."""
    body = F.struct(*[fields[k].alias(k) for k in sorted(fields)])
    return F.substring(F.sha2(F.to_json(body, {"ignoreNullFields": "false"}), 256), 1, length)


def normal_headline(headline: Column) -> Column:
    trimmed = F.regexp_replace(F.coalesce(headline, F.lit("")), r"(?U)^\s+|\s+$", "")
    return F.regexp_replace(F.lower(trimmed), r"(?U)\s+", " ")


def headline_hash(headline: Column) -> Column:
    return F.sha2(normal_headline(headline), 256)


def content_hash(raw: Column) -> Column:
    """Hash of the raw text; no text gives empty text, which never matches anything."""
    return F.when(raw.isNull(), F.lit("")).otherwise(F.sha2(raw, 256))


def numbered_id(prefix: Column, n: Column) -> Column:
    return F.format_string("%s#%04d", prefix, n)


def versioned_id(name: Column, version: Column) -> Column:
    return F.concat_ws("@", name, version)


def regime_id(spec: Column, cadence: Column, ts: Column) -> Column:
    stamp = F.translate(iso_utc(ts), ":-", "")
    return F.concat_ws("_", F.lit("RGM"), spec, cadence, stamp)


def timeline_id(symbol: Column, anchor_ts: Column) -> Column:
    return F.concat_ws("@", symbol, iso_utc(anchor_ts))


def batch_id(symbol: Column, session: Column) -> Column:
    return F.concat_ws("|", symbol, session)
