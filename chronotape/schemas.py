"""Table schemas. Times are instants; the session zone is UTC everywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

# `session` is the trading date for minute bars (any session key works), `seq` the
# arrival ordinal of a row inside its batch.
BARS = """symbol string, session string, seq bigint, ts timestamp, open double, high double,
low double, close double, volume bigint, bid double, ask double"""
QUOTES = "symbol string, session string, seq bigint, ts timestamp, bid double, ask double"
TRADES = "symbol string, session string, seq bigint, ts timestamp, price double, size bigint"
RAW_NEWS = """symbol string, session string, seq bigint, article_id string, news_available_ts timestamp,
publish_ts timestamp, vendor string, source string"""
FEEDS = "vendor string, streams array<string>, consolidated boolean, history_days int"
CANDIDATES = """symbol string, session string, signal_ts timestamp, setup_type string, direction string,
scanner_id string, universe_id string, scanner_score double, scanner_rank int, candidate_batch_id string"""
OBSERVATIONS = """observation_id string, schema_version string, symbol string, symbol_registry_id string,
setup_type string, setup_version string, direction string, signal_ts timestamp,
regime_snapshot_id string, label_spec_id string, universe_version_id string,
scanner_version_id string, registry_signature_hash string, data_as_of_ts timestamp,
dataset_role string, features map<string,double>, ingestion_ts timestamp, scanner_score double,
scanner_rank int, candidate_batch_id string"""
SYMBOL_REFRESHES = """symbol string, valid_from timestamp, exchange string, sector string,
shares_outstanding double, free_float double, listing_status string, country string, is_etf boolean,
is_adr boolean, is_spac boolean, borrowable_flag boolean, active_from date, active_to date"""
REGIMES = """regime_snapshot_id string, regime_ts timestamp, cadence string, regime_spec_version string,
risk_state string, spy_trend double, qqq_trend double, iwm_trend double, vix_level double,
breadth_ratio double"""
SETUPS = """setup_version_id string, setup_id string, version string, name string, description string,
detector_ref string, params string, status string"""
UNIVERSES = "universe_version_id string, universe_id string, valid_from timestamp, membership_rule string"
SCANNERS = "scanner_version_id string, scanner_id string, scanner_spec_version string, status string"
DATA_QUALITY = """dq_id string, symbol string, pit_class string, as_of timestamp,
feed_outage_active boolean, missing_prints_in_lookback int, stale_quote boolean, session_date date,
missing_bars_pct double, n_bad_ticks bigint, n_outlier_trades bigint, halt_seconds double,
feed_outage_seconds double, ca_anomaly_flag boolean, quality_score double"""
NEWS = """news_id string, symbol string, news_available_ts timestamp, publish_ts timestamp,
publication_delay_sec double, source string"""
HALTS = "halt_id string, symbol string, halt_start_ts timestamp, halt_end_ts timestamp, reason string"
SHORT_INTEREST = "symbol string, as_of timestamp, short_interest double, days_to_cover double"
BURNED = "start_date date, end_date date, symbols array<string>"
MANIFEST = """run_id string, seq bigint, symbol string, session string, event_type string,
content_hash string, verdict string, candidate_count bigint, stored_count bigint,
duplicate_count bigint, rejected_count bigint, burned_count bigint, detail string"""
REJECTIONS = """candidate_key string, reason_code string, message string, symbol string,
signal_ts timestamp, setup_type string, scanner_id string"""
PROVENANCE = """provenance_id string, vendor string, adapter_version string, streams string,
symbol string, range_start string, range_end string, feed_type string, row_count bigint,
content_hash string, fetch_ts timestamp, verdict string"""
ARTICLES = """article_id string, vendor string, source string, tickers array<string>, headline string,
publish_ts timestamp, available_ts timestamp, language string, raw string, seq bigint"""
TIMELINE_EVENTS = """timeline_id string, symbol string, anchor_ts timestamp, idx int, ts timestamp,
kind string, phase string, detail map<string,double>, detail_text map<string,string>"""
FACTS = "symbol string, session string, ts timestamp, kind string, detail map<string,double>"
PIT_CASES = "case_id string, symbol string, session string, signal_ts timestamp"
FEATURE_DEFS = """feature_id string, name string, version string, formula_ref string, pit_proof string,
economic_rationale string, feature_class string, lookback_window int, cross_row_dependent boolean,
seq bigint"""
EXPERIMENTS = "experiment_id string, hypothesis_id string, feature string, dataset string, sample_size bigint, result string"
LABEL_SPECS = """label_spec_id string, k double, horizon_min int, time_encoding string, atr_period int,
atr_timeframe_min int, tie_break string, path_resolution_min int, calibration_ref string, seq bigint"""

# Keys that must never appear as a fact, check or filter name.
FORBIDDEN_KEYS = (
    "score", "signal", "sentiment", "bullish", "bearish", "label",
    "prediction", "probability", "feature", "rank", "edge",
)
FORBIDDEN_CHECK_KEYS = FORBIDDEN_KEYS + ("grade",)


def struct_of(ddl: str) -> T.StructType:
    return T.StructType.fromDDL(ddl)


def require_columns(df: DataFrame, ddl: str, *names: str) -> DataFrame:
    """Fail early if `df` lacks columns of a contract, or has a zone-less time where an instant is due."""
    want = {f.name: f.dataType for f in struct_of(ddl).fields}
    have = {f.name: f.dataType for f in df.schema.fields}
    for name in names or want:
        if name not in have:
            raise ValueError(f"missing column {name}")
        if isinstance(want[name], T.TimestampType) and isinstance(have[name], T.TimestampNTZType):
            raise ValueError(f"{name} has no time zone; convert it with an explicit zone first")
    return df


def guard_keys(names, forbidden=FORBIDDEN_KEYS) -> None:
    """Refuse names that would carry an opinion rather than a fact."""
    bad = sorted(set(names) & set(forbidden))
    if bad:
        raise ValueError(f"only facts are allowed, not {bad}")
