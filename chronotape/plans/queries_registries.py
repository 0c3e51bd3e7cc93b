"""As-of resolution, membership, roles, signing and versioning queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import observations as O
from ..operators import registries as R
from ..operators import roles as P
from ..functions.times import iso_utc
from ..operators.asof import asof_index, with_validity
from . import adapters as D
from .registry import iso, query, r6, sql_iso, sql_r6

_EV = f"WITH {D.SQL_EVENTS}, {D.SQL_SIGNALS}"
ZONE = "UTC"


def text(name: str):
    return F.coalesce(F.col(name), F.lit("")).alias(name)


@query("asof_symbol_version", f"""{_EV}, {D.SQL_SYMBOLS}
SELECT s.event_id, CASE WHEN v.active_from <= CAST(s.signal_ts AS DATE) AND (v.active_to IS NULL OR CAST(s.signal_ts AS DATE) < v.active_to)
       THEN v.symbol_registry_id ELSE '' END AS symbol_registry_id
FROM signals s ASOF LEFT JOIN symver v ON s.symbol = v.symbol AND s.signal_ts >= v.valid_from""")
def asof_symbol_version(spark, d):
    out = R.resolve_symbol(D.signals(spark, d), D.symbol_versions(spark, d), zone=ZONE)
    return out.select("event_id", text("symbol_registry_id"))


@query("asof_regime", f"""{_EV}, {D.SQL_REGIMES}
SELECT s.event_id, coalesce(r.regime_snapshot_id, '') AS regime_snapshot_id
FROM signals s ASOF LEFT JOIN regimes r ON s.signal_ts >= r.regime_ts""")
def asof_regime(spark, d):
    return R.resolve_regime(D.signals(spark, d), D.regimes(spark, d)).select("event_id", text("regime_snapshot_id"))


@query("asof_regime_interval", f"""{_EV}, {D.SQL_REGIMES}
SELECT s.event_id, coalesce(r.regime_snapshot_id, '') AS regime_snapshot_id
FROM signals s ASOF LEFT JOIN regimes r ON s.signal_ts >= r.regime_ts""")
def asof_regime_interval(spark, d):
    """Same result by the index of short version arrays."""
    index = asof_index(D.regimes(spark, d), [], "regime_ts", ["regime_snapshot_id"], tie=["regime_snapshot_id"])
    out = index.lookup(D.signals(spark, d), "signal_ts", ["regime_snapshot_id"])
    return out.select("event_id", text("regime_snapshot_id"))


@query("asof_setup_active", f"""{_EV}, {D.SQL_SETUPS},
best AS (SELECT setup_id, arg_max(setup_version_id, version) AS setup_version FROM setups WHERE status = 'ACTIVE' GROUP BY setup_id)
SELECT s.event_id, coalesce(b.setup_version, '') AS setup_version FROM signals s LEFT JOIN best b ON b.setup_id = s.setup_type""")
def asof_setup_active(spark, d):
    return R.resolve_setup(D.signals(spark, d), D.setups(spark, d)).select("event_id", text("setup_version"))


@query("asof_scanner_active", f"""{_EV}, {D.SQL_SCANNERS},
best AS (SELECT scanner_id, arg_max(scanner_version_id, scanner_spec_version) AS scanner_version_id FROM scanners WHERE status = 'ACTIVE' GROUP BY scanner_id)
SELECT s.event_id, coalesce(b.scanner_version_id, '') AS scanner_version_id FROM signals s LEFT JOIN best b USING (scanner_id)""")
def asof_scanner_active(spark, d):
    return R.resolve_scanner(D.signals(spark, d), D.scanners(spark, d)).select("event_id", text("scanner_version_id"))


@query("asof_universe", f"""{_EV}, {D.SQL_UNIVERSES},
starts AS (SELECT universe_id, valid_from, max(universe_version_id) AS universe_version_id FROM universes GROUP BY ALL)
SELECT s.event_id, coalesce(u.universe_version_id, '') AS universe_version_id
FROM signals s ASOF LEFT JOIN starts u ON s.universe_id = u.universe_id AND s.signal_ts >= u.valid_from""")
def asof_universe(spark, d):
    out = R.resolve_universe(D.signals(spark, d), D.universes(spark, d))
    return out.select("event_id", text("universe_version_id"))


@query("dq_asof", f"""{_EV}, dq AS (SELECT 'DQA_' || event_id AS dq_id, symbol, ts, value > 100 AS outage, k < 10 AS stale FROM ev WHERE event_type = 'error')
SELECT s.event_id, coalesce(q.dq_id, '') AS dq_id, coalesce(q.outage OR q.stale, FALSE) AS quarantined
FROM signals s ASOF LEFT JOIN dq q ON s.symbol = q.symbol AND s.signal_ts >= q.ts""")
def dq_asof(spark, d):
    out = R.quality_as_of(D.signals(spark, d), D.data_quality(spark, d))
    return out.select("event_id", text("dq_id"), "quarantined")


@query("dq_retrospective", """WITH q AS (
  SELECT user_id, CAST(ts AS DATE) AS day, count(*) AS n_bad_ticks, round(sum(value), 6) AS halt_seconds FROM events WHERE event_type = 'error' GROUP BY ALL),
s AS (SELECT DISTINCT user_id, CAST(ts AS DATE) AS day FROM events WHERE event_type = 'purchase')
SELECT 'U' || s.user_id AS symbol, strftime(s.day, '%Y-%m-%d') AS session_date, coalesce(n_bad_ticks, 0) AS n_bad_ticks,
       coalesce(halt_seconds, 0) AS halt_seconds FROM s LEFT JOIN q USING (user_id, day)""")
def dq_retrospective(spark, d):
    day = F.to_date("ts")
    quality = D.events(spark, d, "error").groupBy("symbol", day.alias("session_date")).agg(
        F.count("*").alias("n_bad_ticks"), F.sum("value").alias("halt_seconds")).withColumn(
        "pit_class", F.lit("RETROSPECTIVE"))
    sessions = D.events(spark, d, "purchase").select("symbol", day.alias("session_date")).distinct()
    out = R.retrospective_quality(sessions, quality).fillna({"n_bad_ticks": 0, "halt_seconds": 0.0})
    return out.select("symbol", F.col("session_date").cast("string").alias("session_date"), "n_bad_ticks", r6("halt_seconds"))


@query("asof_news_latest", f"""{_EV}, {D.SQL_NEWS},
latest AS (SELECT s.event_id, n.news_id FROM signals s ASOF LEFT JOIN news n ON s.symbol = n.symbol AND s.signal_ts >= n.news_available_ts),
counts AS (SELECT s.event_id, count(n.news_id) AS news_count FROM signals s LEFT JOIN news n ON s.symbol = n.symbol AND n.news_available_ts <= s.signal_ts GROUP BY 1)
SELECT event_id, coalesce(news_id, '') AS news_id, news_count FROM latest JOIN counts USING (event_id)""")
def asof_news_latest(spark, d):
    return R.news_as_of(D.signals(spark, d), D.news(spark, d)).select("event_id", text("news_id"), "news_count")


@query("news_available_all", f"""WITH {D.SQL_EVENTS}, {D.SQL_NEWS}
SELECT news_id, symbol, {sql_iso('news_available_ts', 'news_available_ts')},
       {sql_r6('coalesce((epoch_us(news_available_ts) - epoch_us(publish_ts)) / 1000000.0, -1)', 'publication_delay_sec')}
FROM news WHERE news_available_ts <= TIMESTAMP '2024-01-15 12:00:00'""")
def news_available_all(spark, d):
    rows = R.news_available(R.with_publication_delay(D.news(spark, d)), "2024-01-15T12:00:00+00:00")
    return rows.fillna({"publication_delay_sec": -1.0}).select("news_id", "symbol", iso("news_available_ts"), r6("publication_delay_sec"))


@query("halt_status", f"""{_EV}, {D.SQL_HALTS}
SELECT s.event_id, coalesce(bool_or(h.halt_end_ts IS NULL OR h.halt_end_ts > s.signal_ts) FILTER (WHERE h.halt_id IS NOT NULL), FALSE) AS halted,
       count(h.halt_id) AS halts_started
FROM signals s LEFT JOIN halts h ON h.symbol = s.symbol AND h.halt_start_ts <= s.signal_ts GROUP BY s.event_id""")
def halt_status(spark, d):
    return R.halt_status(D.signals(spark, d), D.halts(spark, d)).select("event_id", "halted", "halts_started")


@query("halts_started", f"""WITH {D.SQL_EVENTS}, {D.SQL_HALTS}
SELECT halt_id, symbol, {sql_iso('halt_start_ts', 'halt_start_ts')} FROM halts WHERE halt_start_ts <= TIMESTAMP '2024-01-20 00:00:00'""")
def halts_started(spark, d):
    return R.halts_started_before(D.halts(spark, d), "2024-01-20T00:00:00+00:00").select("halt_id", "symbol", iso("halt_start_ts"))


@query("universe_members", f"""WITH {D.SQL_EVENTS}, {D.SQL_SYMBOLS}, {D.SQL_UNIVERSES},
rule AS (SELECT o_orderstatus FROM universes WHERE universe_id = '2-HIGH' AND valid_from <= TIMESTAMP '2024-01-20 15:00:00'
         ORDER BY valid_from DESC, universe_version_id DESC LIMIT 1),
latest AS (SELECT * FROM symver WHERE valid_from <= TIMESTAMP '2024-01-20 15:00:00'
           QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY valid_from DESC) = 1)
SELECT symbol FROM latest, rule WHERE active_from <= DATE '2024-01-20' AND (active_to IS NULL OR DATE '2024-01-20' < active_to)
  AND NOT is_spac AND (o_orderstatus = 'O' OR (NOT is_etf AND NOT is_adr))
  AND (o_orderstatus <> 'F' OR float_bucket IN ('MICRO', 'SMALL'))""")
def universe_members(spark, d):
    return R.universe_members(D.symbol_versions(spark, d), D.universes(spark, d), "2-HIGH", "2024-01-20T15:00:00+00:00")


@query("universe_active", f"""WITH {D.SQL_EVENTS}, {D.SQL_SYMBOLS}
SELECT DISTINCT symbol FROM symver WHERE active_from <= DATE '2024-01-10' AND (active_to IS NULL OR DATE '2024-01-10' < active_to)""")
def universe_active(spark, d):
    return R.active_symbols(D.symbol_versions(spark, d), "2024-01-10")


# -- burned slices and roles --------------------------------------------------------------------
def burned(spark, d):
    """A burned quarter for suppliers in debt, and one burned week for everyone."""
    s = D.table(spark, d, "supplier")
    debt = s.where(F.col("s_acctbal") < 0).select(
        F.lit("1996-01-01").cast("date").alias("start_date"), F.lit("1996-03-31").cast("date").alias("end_date"),
        F.array(F.concat(F.lit("S"), F.col("s_suppkey"))).alias("symbols"))
    week = s.groupBy().agg(F.lit("1998-06-01").cast("date").alias("start_date"), F.lit("1998-06-07").cast("date").alias("end_date"),
                           F.lit(None).cast("array<string>").alias("symbols"))
    return debt.unionByName(week)


SQL_ROLES = """
roles AS (
  SELECT b.symbol, b.session, b.ts,
         CASE WHEN (b.ts BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '1996-03-31' AND s.s_acctbal < 0)
                OR b.ts BETWEEN TIMESTAMP '1998-06-01' AND TIMESTAMP '1998-06-07' THEN 'CALIBRATION_ONLY'
              WHEN b.ts <= TIMESTAMP '1998-12-31' THEN 'TRAIN' WHEN b.ts <= TIMESTAMP '1999-12-31' THEN 'VALIDATION'
              WHEN b.ts <= TIMESTAMP '2000-12-31' THEN 'OOS' ELSE 'VAULT' END AS dataset_role
  FROM bars b JOIN supplier s ON b.symbol = 'S' || s.s_suppkey)"""
BOUNDARIES = {"train_end": "1998-12-31", "val_end": "1999-12-31", "oos_end": "2000-12-31"}


def _roles(spark, d):
    return P.assign_roles(D.bars(spark, d), burned(spark, d), F.to_date("ts"), **BOUNDARIES)


@query("burn_roles", f"WITH {D.SQL_BARS}, {SQL_ROLES} SELECT symbol, {sql_iso('ts', 'ts')}, dataset_role FROM roles")
def burn_roles(spark, d):
    return _roles(spark, d).select("symbol", iso("ts"), "dataset_role")


@query("pipeline_rows", f"""WITH {D.SQL_BARS}, {SQL_ROLES}
SELECT dataset_role, count(*) AS n FROM roles WHERE dataset_role <> 'CALIBRATION_ONLY' GROUP BY ALL""")
def pipeline_rows(spark, d):
    return P.pipeline_rows(_roles(spark, d)).groupBy("dataset_role").agg(F.count("*").alias("n"))


@query("embargo", f"""WITH {D.SQL_BARS} SELECT session, count(*) AS n FROM bars
WHERE NOT (ts > TIMESTAMP '1998-12-31' AND ts <= TIMESTAMP '1999-01-31') AND NOT (ts > TIMESTAMP '1999-12-31' AND ts <= TIMESTAMP '2000-01-31') GROUP BY ALL""")
def embargo(spark, d):
    rows = P.outside_embargo(D.bars(spark, d), F.to_date("ts"), ["1998-12-31", "1999-12-31"], 31)
    return rows.groupBy("session").agg(F.count("*").alias("n"))


@query("burn_fingerprint", """WITH slices AS (
  SELECT '1996-01-01|1996-03-31|S' || s_suppkey AS t FROM supplier WHERE s_acctbal < 0
  UNION ALL SELECT '1998-06-01|1998-06-07|ALL')
SELECT substr(sha256(string_agg(t, chr(10) ORDER BY t)), 1, 16) AS fingerprint FROM slices""")
def burn_fingerprint(spark, d):
    return P.burn_fingerprint(burned(spark, d))


# -- observations ---------------------------------------------------------------------------------
def references(spark, d) -> O.References:
    return O.References(D.symbol_versions(spark, d), D.regimes(spark, d), D.setups(spark, d), D.universes(spark, d),
                        D.scanners(spark, d), "LBL_V1")


def signal_burn(spark, d):
    """Burned days of the signal period: two days for everyone, a week for market users."""
    c = D.table(spark, d, "customer")
    some = c.where(F.col("c_mktsegment") == "MACHINERY").select(
        F.lit("2024-01-08").cast("date").alias("start_date"), F.lit("2024-01-14").cast("date").alias("end_date"),
        F.array(F.concat(F.lit("U"), F.col("c_custkey"))).alias("symbols"))
    every = c.groupBy().agg(F.lit("2024-01-20").cast("date").alias("start_date"), F.lit("2024-01-21").cast("date").alias("end_date"),
                            F.lit(None).cast("array<string>").alias("symbols"))
    return some.unionByName(every)


def built(spark, d):
    bars = D.events(spark, d).select("symbol", F.date_format("ts", "yyyy-MM-dd").alias("session"), "ts", "event_type")
    signals = D.signals(spark, d)
    candidates = O.with_data_as_of(signals, bars.where(F.col("event_type") == "view"))
    return O.build_observations(candidates, references(spark, d), signal_burn(spark, d), zone=ZONE,
                                train_end="2024-01-15", val_end="2024-01-22")


SQL_BUILT = f"""
usv AS (SELECT universe_id, valid_from, max(universe_version_id) AS universe_version_id FROM universes GROUP BY ALL),
b1 AS (SELECT s.*, CASE WHEN v.active_from <= CAST(s.signal_ts AS DATE) AND (v.active_to IS NULL OR CAST(s.signal_ts AS DATE) < v.active_to)
              THEN v.symbol_registry_id END AS symbol_registry_id
       FROM signals s ASOF LEFT JOIN symver v ON s.symbol = v.symbol AND s.signal_ts >= v.valid_from),
b2 AS (SELECT b1.*, r.regime_snapshot_id FROM b1 ASOF LEFT JOIN regimes r ON b1.signal_ts >= r.regime_ts),
b3 AS (SELECT b2.*, u.universe_version_id FROM b2 ASOF LEFT JOIN usv u ON b2.universe_id = u.universe_id AND b2.signal_ts >= u.valid_from),
bsetup AS (SELECT setup_id, arg_max(setup_version_id, version) AS setup_version FROM setups WHERE status = 'ACTIVE' GROUP BY 1),
bscan AS (SELECT scanner_id, arg_max(scanner_version_id, scanner_spec_version) AS scanner_version_id FROM scanners WHERE status = 'ACTIVE' GROUP BY 1),
b4 AS (SELECT b3.*, setup_version, scanner_version_id, 'LBL_V1' AS label_spec_id
       FROM b3 LEFT JOIN bsetup ON setup_id = setup_type LEFT JOIN bscan USING (scanner_id)),
b5 AS (SELECT *, CASE WHEN direction <> 'LONG' THEN 'LONG_ONLY_VIOLATION' WHEN symbol_registry_id IS NULL THEN 'MISSING_SYMBOL_VERSION'
                      WHEN regime_snapshot_id IS NULL THEN 'MISSING_REGIME_SNAPSHOT' WHEN setup_version IS NULL THEN 'UNKNOWN_SETUP'
                      WHEN universe_version_id IS NULL THEN 'MISSING_UNIVERSE_VERSION' WHEN scanner_version_id IS NULL THEN 'UNKNOWN_SCANNER' END AS reason0,
              CAST(signal_ts AS DATE) IN (DATE '2024-01-20', DATE '2024-01-21')
              OR (CAST(signal_ts AS DATE) BETWEEN DATE '2024-01-08' AND DATE '2024-01-14'
                  AND symbol IN (SELECT 'U' || c_custkey FROM customer WHERE c_mktsegment = 'MACHINERY')) AS burned FROM b4),
b6 AS (SELECT *, CASE WHEN reason0 IS NULL THEN substr(sha256(symbol_registry_id || '|' || regime_snapshot_id || '|' || setup_version || '|' || label_spec_id
              || '|' || universe_version_id || '|' || scanner_version_id), 1, 16) END AS sig FROM b5),
b7 AS (SELECT *, CASE WHEN reason0 IS NULL THEN substr(sha256(symbol || '|' || {sql_iso('signal_ts')} || '|' || setup_type || '|' || scanner_id || '|' || sig), 1, 32) ELSE '' END AS candidate_key,
              CASE WHEN reason0 IS NULL AND burned THEN 'BURNED_CALIBRATION_SLICE' ELSE reason0 END AS reason_code,
              CASE WHEN burned THEN 'CALIBRATION_ONLY' WHEN CAST(signal_ts AS DATE) <= DATE '2024-01-15' THEN 'TRAIN'
                   WHEN CAST(signal_ts AS DATE) <= DATE '2024-01-22' THEN 'VALIDATION' ELSE 'VAULT' END AS dataset_role FROM b6),
asof_bars AS (SELECT symbol, strftime(ts, '%Y-%m-%d') AS session, ts FROM ev WHERE event_type = 'view'),
built AS (SELECT b7.*, coalesce(x.ts, signal_ts) AS data_as_of_ts FROM b7 ASOF LEFT JOIN asof_bars x
          ON b7.symbol = x.symbol AND b7.session = x.session AND b7.signal_ts >= x.ts)"""

SQL_TO_BUILT = f"{_EV}, {D.SQL_SYMBOLS}, {D.SQL_REGIMES}, {D.SQL_SETUPS}, {D.SQL_SCANNERS}, {D.SQL_UNIVERSES}, {SQL_BUILT}"


@query("data_as_of", f"{SQL_TO_BUILT} SELECT event_id, {sql_iso('data_as_of_ts', 'data_as_of_ts')} FROM built")
def data_as_of(spark, d):
    bars = D.events(spark, d, "view").withColumn("session", F.date_format("ts", "yyyy-MM-dd"))
    return O.with_data_as_of(D.signals(spark, d), bars).select("event_id", iso("data_as_of_ts"))


@query("reference_resolution", f"""{SQL_TO_BUILT} SELECT event_id, coalesce(symbol_registry_id, '') AS symbol_registry_id,
  coalesce(regime_snapshot_id, '') AS regime_snapshot_id, coalesce(setup_version, '') AS setup_version,
  coalesce(universe_version_id, '') AS universe_version_id, coalesce(scanner_version_id, '') AS scanner_version_id,
  coalesce(reason0, '') AS reason_code FROM built""")
def reference_resolution(spark, d):
    out = O.resolve_references(D.signals(spark, d), references(spark, d), zone=ZONE)
    return out.select("event_id", *[text(c) for c in (
        "symbol_registry_id", "regime_snapshot_id", "setup_version", "universe_version_id", "scanner_version_id", "reason_code")])


@query("registry_signature", f"{SQL_TO_BUILT} SELECT event_id, sig AS registry_signature_hash FROM built WHERE sig IS NOT NULL")
def registry_signature(spark, d):
    return built(spark, d).where(F.col("registry_signature_hash").isNotNull()).select("event_id", "registry_signature_hash")


@query("candidate_key", f"{SQL_TO_BUILT} SELECT event_id, candidate_key, dataset_role, coalesce(reason_code, '') AS reason_code FROM built")
def candidate_key(spark, d):
    return built(spark, d).select("event_id", "candidate_key", "dataset_role", text("reason_code"))


@query("rejections_by_code", f"{SQL_TO_BUILT} SELECT reason_code, count(*) AS n FROM built WHERE reason_code IS NOT NULL GROUP BY 1")
def rejections_by_code(spark, d):
    return O.by_code(O.refused(built(spark, d)))


@query("observation_checks", f"""{SQL_TO_BUILT} SELECT event_id, sig IS NOT NULL AS fully_signed, sig IS NOT NULL AS signature_match,
  data_as_of_ts <= signal_ts AS pit_ok, direction = 'LONG' AS long_only, sig IS NOT NULL AND data_as_of_ts <= signal_ts AND direction = 'LONG' AS passed FROM built""")
def observation_checks(spark, d):
    return O.evaluate(built(spark, d)).select("event_id", "fully_signed", "signature_match", "pit_ok", "long_only", "passed")


# -- versioning -----------------------------------------------------------------------------------
SQL_SCD2 = """
refresh AS (SELECT 'C' || o_custkey AS symbol, o_orderdate, o_orderkey, o_orderstatus AS sector,
                   floor(o_totalprice / 100000) * 1000 AS shares, 60e6 + floor(o_totalprice / 50000) * 400000 AS ff,
                   CASE WHEN 60e6 + floor(o_totalprice / 50000) * 400000 < 20e6 THEN 'MICRO'
                        WHEN 60e6 + floor(o_totalprice / 50000) * 400000 < 75e6 THEN 'SMALL'
                        WHEN 60e6 + floor(o_totalprice / 50000) * 400000 < 300e6 THEN 'MID' ELSE 'LARGE' END AS bucket,
                   row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS n FROM orders),
fold AS (
  SELECT symbol, n, o_orderkey, 'INITIAL' AS reason, sector, bucket, shares, ff FROM refresh WHERE n = 1
  UNION ALL
  SELECT symbol, n, o_orderkey, reason, CASE WHEN reason <> '' THEN s ELSE ps END,
         CASE WHEN reason <> '' THEN b ELSE pb END, CASE WHEN reason <> '' THEN sh ELSE psh END, CASE WHEN reason <> '' THEN f ELSE pf END
  FROM (SELECT r.symbol, r.n, r.o_orderkey, r.sector AS s, r.bucket AS b, r.shares AS sh, r.ff AS f,
               p.sector AS ps, p.bucket AS pb, p.shares AS psh, p.ff AS pf,
               CASE WHEN r.sector <> p.sector THEN 'CATEGORICAL' WHEN r.bucket <> p.bucket THEN 'BUCKET_CROSS'
                    WHEN (CASE WHEN p.shares = 0 THEN CASE WHEN r.shares = 0 THEN 0 ELSE 1 END ELSE abs(r.shares - p.shares) / abs(p.shares) END) >= 0.01 THEN 'SHARES_THRESHOLD'
                    WHEN abs(r.ff - p.ff) / abs(p.ff) >= 0.01 THEN 'FLOAT_THRESHOLD' ELSE '' END AS reason
        FROM fold p JOIN refresh r ON r.symbol = p.symbol AND r.n = p.n + 1))"""


@query("scd2_versions", f"""WITH RECURSIVE {SQL_SCD2}
SELECT symbol || '#' || lpad(CAST(row_number() OVER (PARTITION BY symbol ORDER BY n) AS VARCHAR), 4, '0') AS symbol_registry_id,
       o_orderkey, reason AS version_reason FROM fold WHERE reason <> ''""")
def scd2_versions(spark, d):
    o = D.table(spark, d, "orders").select(
        F.concat(F.lit("C"), F.col("o_custkey")).alias("symbol"), F.col("o_orderdate").cast("timestamp").alias("valid_from"),
        "o_orderkey", F.col("o_orderstatus").alias("sector"),
        (F.floor(F.col("o_totalprice") / 100000) * 1000).cast("double").alias("shares_outstanding"),
        (60e6 + F.floor(F.col("o_totalprice") / 50000) * 400000).alias("free_float"))
    out = R.version_refreshes(o, categorical=("sector",), tie=["o_orderkey"])
    return out.select("symbol_registry_id", "o_orderkey", "version_reason")


@query("version_validity", f"""WITH {D.SQL_EVENTS}, {D.SQL_SYMBOLS}
SELECT symbol_registry_id, {sql_iso('valid_from', 'valid_from')},
       CASE WHEN lead(valid_from) OVER w IS NULL THEN '' ELSE {sql_iso('lead(valid_from) OVER w')} END AS valid_to
FROM symver WINDOW w AS (PARTITION BY symbol ORDER BY valid_from)""")
def version_validity(spark, d):
    v = with_validity(D.symbol_versions(spark, d), ["symbol"], "valid_from")
    return v.select("symbol_registry_id", iso("valid_from"), F.coalesce(iso_utc(F.col("valid_to")), F.lit("")).alias("valid_to"))
