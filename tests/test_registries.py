from datetime import date

import pytest
from pyspark.sql import functions as F

from chronotape import schemas as S
from chronotape.functions import hashing as H
from chronotape.functions.times import iso_utc, market_session, parse_instant
from chronotape.operators import observations as O
from chronotape.operators import registries as R
from chronotape.operators import roles as P
from conftest import utc


def refreshes(spark, rows):
    full = [(s, utc(t), "NASDAQ", sector, shares, ff, "LISTED", "US", False, False, False, True, date.fromisoformat(a),
             date.fromisoformat(b) if b else None) for s, t, sector, shares, ff, a, b in rows]
    return spark.createDataFrame(full, S.SYMBOL_REFRESHES)


def signal(spark, *rows):
    return spark.createDataFrame([(s, utc(t)) for s, t in rows], "symbol string, signal_ts timestamp")


def test_trigger_policy(spark):
    r = refreshes(spark, [("MGNI", "2025-01-02T15:00:00", "TECH", 140e6, 130e6, "2020-01-01", None),
                          ("MGNI", "2025-02-01T15:00:00", "TECH", 140.28e6, 130e6, "2020-01-01", None),
                          ("MGNI", "2025-03-01T15:00:00", "TECH", 154e6, 130e6, "2020-01-01", None)])
    versions = R.version_refreshes(r)
    got = {v.symbol_registry_id: v.version_reason for v in versions.collect()}
    assert got == {"MGNI#0001": "INITIAL", "MGNI#0002": "SHARES_THRESHOLD"}
    out = R.resolve_symbol(signal(spark, ("MGNI", "2025-02-15T15:00:00"), ("MGNI", "2025-04-15T15:00:00")), versions)
    assert [x.symbol_registry_id for x in out.orderBy("signal_ts").collect()] == ["MGNI#0001", "MGNI#0002"]


def test_drift_adds_up_and_every_reason(spark):
    base = [("A", f"2025-01-{d:02d}T00:00:00", "TECH", 100e6 * (1 + 0.004 * i), 50e6, "2020-01-01", None)
            for i, d in enumerate(range(1, 8))]
    more = [("A", "2025-01-10T00:00:00", "BIO", 102.4e6, 50e6, "2020-01-01", None),       # category
            ("A", "2025-01-11T00:00:00", "BIO", 102.4e6, 80e6, "2020-01-01", None),       # bucket
            ("A", "2025-01-12T00:00:00", "BIO", 102.4e6, 80.9e6, "2020-01-01", None),     # float 1.1 %
            ("A", "2025-01-13T00:00:00", "BIO", 102.4e6, 81.0e6, "2020-01-01", None),
            ("A", "2025-01-14T00:00:00", "BIO", None, 81.0e6, "2020-01-01", None)]        # undefined change
    rows = base + more
    # plain sequential rule
    want, last = [], None
    rel = lambda n, b: (0 if n == b else float("inf")) if n is None or b is None or b == 0 else abs(n - b) / abs(b)
    bucket = lambda f: "MICRO" if f < 20e6 else "SMALL" if f < 75e6 else "MID" if f < 300e6 else "LARGE"
    for r in rows:
        if last is None:
            reason = "INITIAL"
        elif r[2] != last[2]:
            reason = "CATEGORICAL"
        elif bucket(r[4]) != bucket(last[4]):
            reason = "BUCKET_CROSS"
        elif rel(r[3], last[3]) >= 0.01:
            reason = "SHARES_THRESHOLD"
        elif rel(r[4], last[4]) >= 0.01:
            reason = "FLOAT_THRESHOLD"
        else:
            continue
        want.append((r[1], reason))
        last = r
    versions = R.version_refreshes(refreshes(spark, rows), slot_seconds=3 * 86400)
    got = [(v.valid_from.strftime("%Y-%m-%dT%H:%M:%S"), v.version_reason) for v in versions.orderBy("valid_from").collect()]
    assert got == want and {r for _, r in want} == {"INITIAL", "CATEGORICAL", "BUCKET_CROSS", "SHARES_THRESHOLD", "FLOAT_THRESHOLD"}
    # Two slices, the second continuing from the stored versions of the first, give the same.
    every = refreshes(spark, rows)
    head = R.version_refreshes(every.where("valid_from < '2025-01-06'"))
    tail = R.version_refreshes(every.where("valid_from >= '2025-01-06'"), current=R.latest_versions(head, every.columns))
    cols = ("symbol_registry_id", "version_reason", "row_hash")
    assert sorted(map(tuple, head.select(*cols).unionByName(tail.select(*cols)).collect())) == sorted(map(tuple, versions.select(*cols).collect()))
    assert sorted(v.symbol_registry_id for v in versions.collect()) == [f"A#{i:04d}" for i in range(1, len(want) + 1)]


def test_no_fallback_and_survivorship(spark):
    v = R.version_refreshes(refreshes(spark, [
        ("CRDO", "2025-01-02T15:00:00", "TECH", 1e8, 5e7, "2025-01-02", None),
        ("PTON", "2024-01-02T15:00:00", "TECH", 1e8, 5e7, "2020-09-01", "2025-06-01"),
        ("NEWCO", "2024-01-02T15:00:00", "TECH", 1e8, 5e7, "2025-07-01", None)]))
    out = R.resolve_symbol(signal(spark, ("CRDO", "2024-06-01T15:00:00"), ("PTON", "2025-07-01T15:00:00")), v).collect()
    assert [x.symbol_registry_id for x in out] == [None, None]
    universes = spark.createDataFrame([("U@1", "U", utc("2024-01-01T00:00:00"), '{"float_buckets": ["SMALL"]}')], S.UNIVERSES)
    members = [r[0] for r in R.universe_members(v, universes, "U", "2025-03-01T15:00:00+00:00").collect()]
    assert members == ["CRDO", "PTON"]
    assert [r[0] for r in R.active_symbols(v, "2025-03-01").collect()] == ["CRDO", "PTON"]


def test_setup_text_order(spark):
    s = spark.createDataFrame([("ORB@9", "ORB", "9", "ACTIVE"), ("ORB@10", "ORB", "10", "ACTIVE"), ("X@1", "X", "1", "DEPRECATED")],
                              "setup_version_id string, setup_id string, version string, status string")
    assert {r.setup_id: r.setup_version_id for r in R.latest_active(s, "setup_id", "version", "setup_version_id").collect()} == {"ORB": "ORB@9"}


def test_regime_quality_news_halt(spark):
    regimes = spark.createDataFrame([(f"R{h}", utc(f"2025-03-03T{h}:00:00"), "1H", "v1") for h in (14, 15, 16)],
                                    "regime_snapshot_id string, regime_ts timestamp, cadence string, regime_spec_version string")
    out = R.resolve_regime(signal(spark, ("K", "2025-03-03T15:45:00"), ("K", "2025-03-03T13:00:00")), regimes)
    assert {r.signal_ts.hour: r.regime_snapshot_id for r in out.collect()} == {15: "R15", 13: None}
    dq = spark.createDataFrame([("1", "K", "AS_OF", utc("2025-03-03T15:00:00"), False, False),
                                ("2", "K", "AS_OF", utc("2025-03-03T15:30:00"), True, False)],
                               "dq_id string, symbol string, pit_class string, as_of timestamp, feed_outage_active boolean, stale_quote boolean")
    q = R.quality_as_of(signal(spark, ("K", "2025-03-03T15:15:00"), ("K", "2025-03-03T15:45:00"), ("Z", "2025-03-03T15:45:00")), dq)
    assert {(r.symbol, r.signal_ts.minute): r.quarantined for r in q.collect()} == {("K", 15): False, ("K", 45): True, ("Z", 45): False}
    news = spark.createDataFrame([("N", "K", utc("2025-03-03T14:34:00"), utc("2025-03-03T14:31:00"))],
                                 "news_id string, symbol string, news_available_ts timestamp, publish_ts timestamp")
    n = R.news_as_of(signal(spark, ("K", "2025-03-03T14:32:00"), ("K", "2025-03-03T14:35:00")), news)
    assert {r.signal_ts.minute: (r.news_id, r.news_count) for r in n.collect()} == {32: (None, 0), 35: ("N", 1)}
    assert R.with_publication_delay(news).head().publication_delay_sec == 180.0
    halts = spark.createDataFrame([("H", "K", utc("2025-03-03T15:00:00"), utc("2025-03-03T15:05:00"))],
                                  "halt_id string, symbol string, halt_start_ts timestamp, halt_end_ts timestamp")
    h = R.halt_status(signal(spark, *[("K", f"2025-03-03T{t}:00") for t in ("14:59", "15:02", "15:05", "15:06")]), halts)
    assert {r.signal_ts.minute: r.halted for r in h.collect()} == {59: False, 2: True, 5: False, 6: False}


def test_roles(spark):
    burned = spark.createDataFrame([(date(2026, 1, 5), date(2026, 1, 9), ["MGNI", "CRDO"])], S.BURNED)
    rows = spark.createDataFrame([("1", "MGNI", date(2026, 1, 6)), ("2", "MGNI", date(2026, 3, 2)), ("3", "X", date(2026, 1, 6))],
                                 "observation_id string, symbol string, day date")
    out = P.assign_roles(rows, burned, F.col("day"), train_end="2026-02-01", oos_end="2026-04-01")
    assert {r.observation_id: r.dataset_role for r in out.collect()} == {"1": "CALIBRATION_ONLY", "2": "OOS", "3": "TRAIN"}
    with pytest.raises(AssertionError, match="leaked"):
        P.assert_no_calibration_leak(out)
    P.assert_no_calibration_leak(P.pipeline_rows(out))
    assert len(P.burn_fingerprint(burned).head().fingerprint) == 16


def test_hashes_and_times(spark):
    import hashlib
    row = spark.range(1).select(
        H.registry_signature(*[F.lit(x) for x in "abcdef"]).alias("sig"), H.headline_hash(F.lit(" ABCD   Up\tdate ")).alias("hh"),
        iso_utc(F.lit(utc("2025-03-03T15:00:00"))).alias("iso"), parse_instant(F.lit("2025-03-03T15:00:00Z")).alias("z"),
        parse_instant(F.lit("2025-03-03T15:00:00")).alias("naive"), parse_instant(F.lit("nonsense")).alias("bad")).head()
    assert row.sig == hashlib.sha256(b"a|b|c|d|e|f").hexdigest()[:16]
    assert row.hh == hashlib.sha256(b"abcd up date").hexdigest()
    assert row.iso == "2025-03-03T15:00:00+00:00" and row.z is not None and row.naive is None and row.bad is None
    t = spark.createDataFrame([(utc(x),) for x in ("2025-03-03T12:00:00", "2025-03-03T15:00:00", "2025-03-03T22:00:00", "2025-03-01T15:00:00")], "t timestamp")
    assert [r[0] for r in t.select(market_session(F.col("t"))).collect()] == ["PREMARKET", "RTH", "AFTERHOURS", "CLOSED"]


def test_naive_times_are_refused(spark):
    naive = spark.sql("select 'A' symbol, timestamp_ntz'2025-01-01 00:00:00' signal_ts")
    with pytest.raises(ValueError, match="no time zone"):
        S.require_columns(naive, S.PIT_CASES, "symbol", "signal_ts")


def test_evaluate_rows(spark):
    ids = ["S#0001", "R", "ORB@1", "L", "U@1", "P@1"]
    good = spark.createDataFrame([("1", *ids, utc("2025-03-03T15:00:00"), utc("2025-03-03T14:59:00"), "LONG")],
                                 "observation_id string, symbol_registry_id string, regime_snapshot_id string, setup_version string, label_spec_id string, "
                                 "universe_version_id string, scanner_version_id string, signal_ts timestamp, data_as_of_ts timestamp, direction string")
    good = good.withColumn("registry_signature_hash", H.registry_signature())
    assert O.evaluate(good).head().passed
    O.assert_signed(good)
    bad = good.withColumn("regime_snapshot_id", F.lit("")).withColumn("direction", F.lit("SHORT"))
    r = O.evaluate(bad).head()
    assert (r.fully_signed, r.signature_match, r.long_only, r.passed) == (False, False, False, False)
    with pytest.raises(AssertionError):
        O.assert_signed(bad)
