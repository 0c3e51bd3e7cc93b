"""News archive, audit, lifecycles, feature gate, collection and integrity queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.hashing import canonical_hash
from ..functions.rules import CALIBRATION_ROLE
from ..functions.times import market_session
from ..operators import audit as U
from ..operators import features as E
from ..operators import lifecycle as L
from ..operators import news as N
from ..operators import observations as O
from ..operators.registries import active_symbols
from ..session import cut_lineage
from ..sources import spine as P
from ..sources import tables as T
from . import adapters as D
from .collection import account
from .integrity import judge, run_suite
from .queries_registries import SQL_TO_BUILT, ZONE, built, references, signal_burn, text
from .registry import iso, query, sql_iso


# -- news archive -----------------------------------------------------------------------------
def articles(spark, d):
    doc = D.table(spark, d, "documents")
    base = F.lit("2024-01-01 00:00:00").cast("timestamp")
    available = base + F.make_dt_interval(mins=F.col("doc_id").cast("int"))
    return doc.select(
        F.concat(F.lit("A"), F.col("n_chars")).alias("article_id"), F.col("source").alias("vendor"), "source",
        F.array("lang", F.lit("all")).alias("tickers"), F.substring_index("text", "\n", 1).alias("headline"),
        (available - F.make_dt_interval(secs=F.col("n_chars").cast("int"))).alias("publish_ts"), available.alias("available_ts"),
        F.col("lang").alias("language"), F.col("text").alias("raw"), F.col("doc_id").alias("seq"))


SQL_ARTICLES = """
articles AS (SELECT doc_id AS seq, upper(source) AS vendor, 'A' || n_chars AS article_id, upper(lang) AS lang, n_chars, text,
                    regexp_replace(lower(regexp_replace(split_part(text, chr(10), 1), '^\\s+|\\s+$', '', 'g')), '\\s+', ' ', 'g') AS headline,
                    TIMESTAMP '2024-01-01 00:00:00' + to_minutes(doc_id) AS avail FROM documents),
records AS (SELECT *, sha256(headline) AS headline_hash, sha256(text) AS content_hash FROM articles)"""

SQL_LINKS = """
e AS (SELECT a.seq, min(b.seq) AS link FROM records a JOIN records b ON a.vendor = b.vendor AND a.article_id = b.article_id AND b.seq < a.seq GROUP BY 1),
c AS (SELECT a.seq, min(b.seq) AS link FROM records a JOIN records b ON a.content_hash = b.content_hash AND b.seq < a.seq GROUP BY 1),
s AS (SELECT a.seq, min(b.seq) AS link FROM records a JOIN records b ON a.headline_hash = b.headline_hash AND b.seq < a.seq
      AND abs(epoch(a.avail) - epoch(b.avail)) <= 3600 GROUP BY 1),
linked AS (SELECT r.*, coalesce(e.link, c.link, s.link) AS link,
                  CASE WHEN e.link IS NOT NULL THEN 'EXACT' WHEN c.link IS NOT NULL THEN 'CONTENT' WHEN s.link IS NOT NULL THEN 'STORY' ELSE '' END AS dup_kind
           FROM records r LEFT JOIN e USING (seq) LEFT JOIN c USING (seq) LEFT JOIN s USING (seq))"""


@query("news_records", f"""WITH {SQL_ARTICLES}
SELECT seq, vendor, article_id, CASE WHEN lang < 'ALL' THEN lang || ',ALL' ELSE 'ALL,' || lang END AS tickers, headline_hash, content_hash,
       CAST(n_chars AS DOUBLE) AS availability_delay_seconds, {sql_iso('avail', 'available_ts')} FROM records""")
def news_records(spark, d):
    r = N.build_records(articles(spark, d))
    return r.select("seq", "vendor", "article_id", F.array_join("tickers", ",").alias("tickers"), "headline_hash", "content_hash",
                    "availability_delay_seconds", iso("available_ts"))


def _linked(spark, d):
    return N.link_duplicates(cut_lineage(N.build_records(articles(spark, d))))


@query("news_dedup", f"""WITH {SQL_ARTICLES}, {SQL_LINKS}
SELECT l.seq, l.dup_kind, CASE WHEN l.link IS NULL THEN '' ELSE substr(sha256(o.vendor || '|' || o.article_id || '|' || o.seq), 1, 32) END AS duplicate_of
FROM linked l LEFT JOIN records o ON o.seq = l.link""")
def news_dedup(spark, d):
    return _linked(spark, d).select("seq", text("dup_kind"), text("duplicate_of"))


@query("news_duplicates", f"WITH {SQL_ARTICLES}, {SQL_LINKS} SELECT dup_kind, count(*) AS n FROM linked WHERE dup_kind <> '' GROUP BY 1")
def news_duplicates(spark, d):
    return N.duplicates(_linked(spark, d)).groupBy("dup_kind").agg(F.count("*").alias("n"))


@query("archive_as_of", f"""WITH {SQL_ARTICLES} SELECT seq, vendor, {sql_iso('avail', 'available_ts')} FROM records
WHERE lang = 'EN' AND avail <= TIMESTAMP '2024-01-01 08:00:00'""")
def archive_as_of(spark, d):
    return N.archive_as_of(N.build_records(articles(spark, d)), "en", "2024-01-01T08:00:00+00:00").select("seq", "vendor", iso("available_ts"))


_NY = "timezone('America/New_York', timezone('UTC', ts))"


@query("market_session", f"""SELECT event_id, CASE WHEN isodow({_NY}) >= 6 THEN 'CLOSED' WHEN CAST({_NY} AS TIME) < TIME '04:00:00' THEN 'CLOSED'
  WHEN CAST({_NY} AS TIME) < TIME '09:30:00' THEN 'PREMARKET' WHEN CAST({_NY} AS TIME) < TIME '16:00:00' THEN 'RTH'
  WHEN CAST({_NY} AS TIME) < TIME '20:00:00' THEN 'AFTERHOURS' ELSE 'CLOSED' END AS market_session FROM events""")
def market_session_of_events(spark, d):
    return D.events(spark, d).select("event_id", market_session(F.col("ts")).alias("market_session"))


# -- counts and audit ---------------------------------------------------------------------------
_OBS = f"{SQL_TO_BUILT}, obs AS (SELECT * FROM built WHERE reason_code IS NULL)"


def observations(spark, d):
    return O.accepted(built(spark, d))


_COUNT_DIMS = (("regime", "regime_snapshot_id"), ("setup", "setup_type"), ("symbol", "symbol"), ("universe", "universe_version_id"),
               ("label", "label_spec_id"), ("month", "strftime(signal_ts, '%Y-%m')"), ("role", "dataset_role"))


@query("dataset_counts", f"{_OBS} SELECT 'total' AS dimension, '' AS value, count(*) AS n FROM obs" + "".join(
    f" UNION ALL SELECT '{n}', {c}, count(*) FROM obs GROUP BY {c}" for n, c in _COUNT_DIMS))
def dataset_counts(spark, d):
    return U.dataset_counts(observations(spark, d))


@query("coverage_summary", f"""{_OBS} SELECT 'observations' AS metric, count(*) AS value FROM obs
UNION ALL SELECT 'distinct_regimes', count(DISTINCT regime_snapshot_id) FROM obs UNION ALL SELECT 'distinct_symbols', count(DISTINCT symbol) FROM obs
UNION ALL SELECT 'distinct_labels', count(DISTINCT label_spec_id) FROM obs UNION ALL SELECT 'distinct_months', count(DISTINCT strftime(signal_ts, '%Y-%m')) FROM obs
UNION ALL SELECT 'distinct_universes', count(DISTINCT universe_version_id) FROM obs""")
def coverage_summary(spark, d):
    return U.coverage(cut_lineage(observations(spark, d)))


@query("duplicate_observations", f"""{_OBS} SELECT symbol, strftime(signal_ts, '%Y-%m-%d') AS day, setup_type, count(*) AS n
FROM obs GROUP BY ALL HAVING count(*) > 1""")
def duplicate_observations(spark, d):
    """At day precision, so that the same setup firing twice a day counts as a repeat."""
    daily = observations(spark, d).withColumn("signal_ts", F.date_trunc("day", "signal_ts"))
    return U.duplicate_observations(daily).select("symbol", F.date_format("signal_ts", "yyyy-MM-dd").alias("day"), "setup_type", "n")


def _known(spark, d):
    setups = D.setups(spark, d).where(F.col("setup_id") != "PROMO").select("setup_version_id")
    symbols = D.symbol_versions(spark, d).where(F.col("float_bucket") != "LARGE").select("symbol_registry_id")
    return {"setup": setups, "symbol": symbols, "regime": D.regimes(spark, d).select("regime_snapshot_id")}


SQL_ORPHANS = """
orphan AS (SELECT 'setup' AS dimension, candidate_key FROM obs WHERE setup_version NOT IN (SELECT setup_version_id FROM setups WHERE setup_id <> 'PROMO')
  UNION ALL SELECT 'symbol', candidate_key FROM obs WHERE symbol_registry_id NOT IN (SELECT symbol_registry_id FROM symver WHERE float_bucket <> 'LARGE'))"""


@query("orphans", f"{_OBS}, {SQL_ORPHANS} SELECT dimension, substr(sha256('obs|' || candidate_key), 1, 32) AS observation_id FROM orphan")
def orphans(spark, d):
    return U.orphans(cut_lineage(observations(spark, d)), _known(spark, d))


def _archive(spark, d):
    return D.news(spark, d).select(F.array("symbol").alias("tickers"), F.col("news_available_ts").alias("available_ts"))


@query("news_coverage", f"""{_OBS}, {D.SQL_NEWS}, f AS (SELECT count(*) AS n, count(*) FILTER (WHERE EXISTS (
  SELECT 1 FROM news x WHERE x.symbol = obs.symbol AND x.news_available_ts <= obs.signal_ts)) AS w FROM obs)
SELECT n AS observations, w AS with_available_news, n - w AS without_news, round(100.0 * w / n, 1)::DOUBLE AS coverage_pct FROM f""")
def news_coverage(spark, d):
    return U.news_coverage(observations(spark, d), _archive(spark, d))


def _tampered(spark, d):
    """Accepted rows plus all refused ones; some signatures are damaged on purpose."""
    rows = built(spark, d)
    damaged = F.when(F.col("scanner_rank").between(10, 14), "damaged").otherwise(F.col("registry_signature_hash"))
    return rows.withColumn("registry_signature_hash", damaged)


@query("signature_integrity", f"{_OBS} SELECT substr(sha256('obs|' || candidate_key), 1, 32) AS observation_id FROM obs WHERE scanner_rank BETWEEN 10 AND 14")
def signature_integrity(spark, d):
    return U.bad_signatures(_tampered(spark, d).where(F.col("reason_code").isNull()))


@query("long_only_violations", f"{SQL_TO_BUILT} SELECT event_id FROM built WHERE direction <> 'LONG'")
def long_only_violations(spark, d):
    return U.long_only_violations(built(spark, d).withColumn("observation_id", F.col("event_id"))).select(
        F.col("observation_id").alias("event_id"))


@query("audit_report", f"""{_OBS}, {D.SQL_NEWS}, {SQL_ORPHANS},
f AS (SELECT count(*) AS n, count(*) FILTER (WHERE EXISTS (SELECT 1 FROM news x WHERE x.symbol = obs.symbol AND x.news_available_ts <= obs.signal_ts)) AS w FROM obs)
SELECT 'observations' AS metric, CAST(count(*) AS DOUBLE) AS value, '' AS status FROM obs
UNION ALL SELECT 'distinct_regimes', count(DISTINCT regime_snapshot_id), '' FROM obs UNION ALL SELECT 'distinct_symbols', count(DISTINCT symbol), '' FROM obs
UNION ALL SELECT 'distinct_labels', count(DISTINCT label_spec_id), '' FROM obs UNION ALL SELECT 'distinct_months', count(DISTINCT strftime(signal_ts, '%Y-%m')), '' FROM obs
UNION ALL SELECT 'distinct_universes', count(DISTINCT universe_version_id), '' FROM obs
UNION ALL SELECT m, 0, '' FROM (VALUES ('duplicate_observations'), ('signature_integrity_failures'), ('pit_violations'), ('long_only_violations')) v(m)
UNION ALL SELECT 'orphan_observations', count(*), '' FROM orphan UNION ALL SELECT 'orphans_' || dimension, count(*), '' FROM orphan GROUP BY dimension
UNION ALL SELECT 'news_coverage_pct', round(100.0 * w / n, 1), '' FROM f
UNION ALL SELECT m, -1, s FROM (VALUES ('missing_bars', 'REQUIRES_DATA_QUALITY_FEED'), ('halt_coverage', 'AVAILABLE'), ('corporate_action_coverage', 'REQUIRES_SYMBOL_REGISTRY_CA')) v(m, s)""")
def audit_report(spark, d):
    obs = cut_lineage(observations(spark, d))
    return U.audit(obs, _known(spark, d), _archive(spark, d), halts_supplied=True).fillna({"value": -1.0})


# -- lifecycles, admission, registration ----------------------------------------------------------
_TO_STATE = {"view": "TESTING", "click": "OOS_PASS", "purchase": "VAULT_PASS", "signup": "CONFIRMED", "error": "OOS_FAIL"}


_TO_FEATURE = {"view": "TESTING", "click": "PROVISIONAL", "purchase": "CONFIRMED", "signup": "OBSERVATION", "error": "TESTING"}


def _moves_of(spark, d, states=None):
    to = F.create_map(*[F.lit(x) for pair in (states or _TO_STATE).items() for x in pair])
    return D.events(spark, d).select("symbol", F.col("event_id").alias("seq"), to[F.col("event_type")].alias("to_state"))


def _sql_life(states: dict, initial: str, moves: str) -> str:
    """Replay of the event log, one step per level; `moves` lists the allowed pairs."""
    cases = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in states.items())
    state = "CASE WHEN l.legal THEN l.to_state ELSE l.from_state END"
    return f"""
moves AS (SELECT * FROM (VALUES {moves}) m(a, b)),
steps AS (SELECT 'U' || user_id AS symbol, event_id AS seq, CASE event_type {cases} END AS to_state, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events),
life AS (
  SELECT symbol, n, seq, to_state, '{initial}' AS from_state, ('{initial}', to_state) IN (SELECT (a, b) FROM moves) AS legal FROM steps WHERE n = 1
  UNION ALL
  SELECT s.symbol, s.n, s.seq, s.to_state, {state}, ({state}, s.to_state) IN (SELECT (a, b) FROM moves)
  FROM life l JOIN steps s ON s.symbol = l.symbol AND s.n = l.n + 1)"""


SQL_LIFE = _sql_life(_TO_STATE, "REGISTERED", """('REGISTERED','TESTING'), ('REGISTERED','REJECTED'), ('TESTING','OOS_PASS'), ('TESTING','OOS_FAIL'),
  ('TESTING','REJECTED'), ('OOS_PASS','VAULT_PASS'), ('OOS_PASS','VAULT_FAIL'), ('OOS_PASS','REJECTED'), ('OOS_FAIL','REJECTED'), ('VAULT_PASS','CONFIRMED'),
  ('VAULT_PASS','REJECTED'), ('VAULT_FAIL','REJECTED')""")
SQL_FEATURE_LIFE = _sql_life(_TO_FEATURE, "OBSERVATION", """('OBSERVATION','TESTING'), ('OBSERVATION','REJECTED'), ('TESTING','PROVISIONAL'), ('TESTING','REJECTED'),
  ('PROVISIONAL','CONFIRMED'), ('PROVISIONAL','REJECTED')""")


@query("feature_lifecycle", f"""WITH RECURSIVE {SQL_FEATURE_LIFE} SELECT symbol, arg_max(CASE WHEN legal THEN to_state ELSE from_state END, n) AS state,
  count(*) FILTER (WHERE NOT legal) AS refused FROM life GROUP BY symbol""")
def feature_lifecycle(spark, d):
    return L.current_states(_moves_of(spark, d, _TO_FEATURE), ["symbol"], L.FEATURE_MOVES, "OBSERVATION")


@query("lifecycle_fold", f"WITH RECURSIVE {SQL_LIFE} SELECT symbol, seq, from_state, to_state, legal FROM life")
def lifecycle_fold(spark, d):
    return L.replay(_moves_of(spark, d), ["symbol"], L.HYPOTHESIS_MOVES, "REGISTERED", chunk_events=2000).select(
        "symbol", "seq", "from_state", "to_state", "legal")


@query("lifecycle_states", f"""WITH RECURSIVE {SQL_LIFE} SELECT symbol, arg_max(CASE WHEN legal THEN to_state ELSE from_state END, n) AS state,
  count(*) FILTER (WHERE NOT legal) AS refused FROM life GROUP BY symbol""")
def lifecycle_states(spark, d):
    return L.current_states(_moves_of(spark, d), ["symbol"], L.HYPOTHESIS_MOVES, "REGISTERED")


@query("feature_admission", """WITH defs AS (
  SELECT p_partkey AS seq, p_type AS feature_id, p_brand AS version, p_name AS name, CASE WHEN p_size = 50 THEN '' ELSE 'f' END AS formula_ref,
         CASE WHEN p_size % 11 = 0 THEN 'none' ELSE 'R' || (p_size - 1) END AS pit_proof, CASE WHEN p_size = 49 THEN '' ELSE 'why' END AS economic_rationale,
         CASE WHEN p_size < 10 THEN 'PRICE_STATE' WHEN p_size < 15 THEN 'EXECUTION_STATE' WHEN p_size < 20 THEN 'SEQUENCE_STATE' WHEN p_size < 23 THEN 'MOOD' ELSE 'CUSTOM' END AS feature_class,
         CASE WHEN p_size = 30 THEN -1 ELSE p_size END AS lookback_window, p_name LIKE 'small%' AS cross_row FROM part),
runs AS (SELECT 'R' || s_suppkey AS pit_run_id, CASE WHEN s_acctbal < 0 THEN 'FAIL' WHEN s_acctbal < 1000 THEN 'UNKNOWN' ELSE 'PASS' END AS verdict FROM supplier),
judged AS (SELECT d.*, CASE WHEN formula_ref = '' THEN ['EMPTY_FIELD', 'formula_ref'] WHEN economic_rationale = '' THEN ['EMPTY_FIELD', 'economic_rationale']
    WHEN feature_class = 'MOOD' THEN ['CLASS', 'MOOD'] WHEN lookback_window < 0 THEN ['LOOKBACK', CAST(lookback_window AS VARCHAR)] WHEN verdict IS NULL THEN ['NO_PROOF', pit_proof]
    WHEN verdict <> 'PASS' THEN ['PROOF', verdict] WHEN feature_class = 'EXECUTION_STATE' THEN ['OUTCOME_SIDE', feature_class]
    WHEN feature_class = 'SEQUENCE_STATE' AND NOT cross_row THEN ['NOT_CROSS_ROW', feature_class] END AS r
  FROM defs d LEFT JOIN runs ON pit_run_id = pit_proof),
final AS (SELECT seq, coalesce(r, CASE WHEN seq <> min(seq) FILTER (WHERE r IS NULL) OVER (PARTITION BY feature_id, version) THEN ['TAKEN', version] END) AS r FROM judged)
SELECT seq, coalesce(r[1], '') AS reject_code, coalesce(r[2], '') AS reject_about FROM final""")
def feature_admission(spark, d):
    size = F.col("p_size")
    defs = D.table(spark, d, "part").select(
        F.col("p_partkey").alias("seq"), F.col("p_type").alias("feature_id"), F.col("p_brand").alias("version"), F.col("p_name").alias("name"),
        F.when(size == 50, "").otherwise("f").alias("formula_ref"), F.when(size % 11 == 0, "none").otherwise(F.concat(F.lit("R"), size - 1)).alias("pit_proof"),
        F.when(size == 49, "").otherwise("why").alias("economic_rationale"),
        F.when(size < 10, "PRICE_STATE").when(size < 15, "EXECUTION_STATE").when(size < 20, "SEQUENCE_STATE").when(size < 23, "MOOD")
         .otherwise("CUSTOM").alias("feature_class"),
        F.when(size == 30, -1).otherwise(size).alias("lookback_window"), F.col("p_name").startswith("small").alias("cross_row_dependent"))
    bal = F.col("s_acctbal")
    runs = D.table(spark, d, "supplier").select(
        F.concat(F.lit("R"), F.col("s_suppkey")).alias("pit_run_id"),
        F.when(bal < 0, "FAIL").when(bal < 1000, "UNKNOWN").otherwise("PASS").alias("verdict"))
    return L.admit_features(defs, runs).select("seq", text("reject_code"), text("reject_about"))


def _experiments(spark, d):
    o = D.table(spark, d, "orders")
    return o.select(F.concat(F.lit("EXP"), F.col("o_orderkey")).alias("experiment_id"), F.concat(F.lit("H"), F.col("o_custkey")).alias("hypothesis_id"),
                    F.when(F.col("o_orderstatus") == "O", "oos").when(F.col("o_orderstatus") == "F", "Vault").otherwise("train").alias("dataset"))


@query("family_size", "SELECT count(DISTINCT o_custkey) AS family_size FROM orders WHERE o_orderstatus IN ('O', 'F')")
def family_size(spark, d):
    return L.family_size(_experiments(spark, d))


@query("hypothesis_registration", """WITH h AS (SELECT c_custkey AS seq, 'H' || c_nationkey AS hypothesis_id, c_acctbal < 0 AS incomplete FROM customer)
SELECT seq, CASE WHEN incomplete THEN 'INCOMPLETE' WHEN seq <> min(seq) FILTER (WHERE NOT incomplete) OVER (PARTITION BY hypothesis_id)
  THEN 'TAKEN' ELSE '' END AS reject_code FROM h""")
def hypothesis_registration(spark, d):
    c = D.table(spark, d, "customer").select(
        F.col("c_custkey").alias("seq"), F.concat(F.lit("H"), F.col("c_nationkey")).alias("hypothesis_id"), F.col("c_name").alias("statement"),
        F.when(F.col("c_acctbal") >= 0, "up").alias("predicted_effect"), F.lit("{}").alias("frozen_test_spec"))
    return L.register_hypotheses(c).select("seq", text("reject_code"))


@query("experiment_orphans", """SELECT 'EXP' || o_orderkey AS experiment_id FROM orders
WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal >= 0)""")
def experiment_orphans(spark, d):
    hypotheses = D.table(spark, d, "customer").where(F.col("c_acctbal") >= 0).select(F.concat(F.lit("H"), F.col("c_custkey")).alias("hypothesis_id"))
    return L.orphan_experiments(_experiments(spark, d), hypotheses).select("experiment_id")


@query("definition_conflicts", """WITH i AS (SELECT p_partkey AS seq, p_name AS id, p_brand AS content FROM part),
held AS (SELECT p_name AS id, min(p_brand) AS content FROM part WHERE p_size = 1 GROUP BY 1),
g AS (SELECT i.*, held.content AS held, first_value(i.content) OVER w AS first_c, min(seq) OVER (PARTITION BY i.id) AS first_s
      FROM i LEFT JOIN held USING (id) WINDOW w AS (PARTITION BY i.id ORDER BY seq))
SELECT seq, CASE WHEN content <> coalesce(held, first_c) THEN 'CONFLICT' WHEN held IS NULL AND seq = first_s THEN 'NEW' ELSE 'SAME' END AS verdict FROM g""")
def definition_conflicts(spark, d):
    p = D.table(spark, d, "part")
    shape = [F.col("p_partkey").alias("seq"), F.col("p_name").alias("id"), F.col("p_brand").alias("content")]
    incoming = p.select(*shape)
    # The store keeps one content per id.
    held = p.where(F.col("p_size") == 1).groupBy(F.col("p_name").alias("id")).agg(F.min("p_brand").alias("content"))
    return T.conflicts(incoming, held, "id", "content", ["seq"]).select("seq", "verdict")


@query("label_hash", """SELECT p_partkey AS seq, sha256('{"brand":"' || p_brand || '","horizon_min":' || p_size || ',"type":"' || p_type || '"}') AS label_spec_hash FROM part""")
def label_hash(spark, d):
    h = canonical_hash({"type": F.col("p_type"), "horizon_min": F.col("p_size"), "brand": F.col("p_brand")})
    return D.table(spark, d, "part").select(F.col("p_partkey").alias("seq"), h.alias("label_spec_hash"))


# -- feature gate -----------------------------------------------------------------------------------
SQL_GATE = f"""WITH {D.SQL_BARS},
cases AS (SELECT symbol, session, max(ts) AS signal_ts FROM bars WHERE month(ts) <= 6 GROUP BY ALL),
v AS (SELECT c.symbol, c.session, arg_max(close, ts) FILTER (WHERE ts <= signal_ts) AS pit, arg_max(close, ts) AS full_value FROM cases c JOIN bars USING (symbol, session) GROUP BY ALL)
SELECT f AS feature_name, (SELECT count(*) FROM cases) AS n_cases, CASE WHEN f = 'last_close' THEN (SELECT count(*) FROM v WHERE pit <> full_value) ELSE 0 END AS failures,
       CASE WHEN f = 'last_close' THEN 'FAIL' WHEN f = 'long_lookback' THEN 'UNKNOWN' ELSE 'PASS' END AS verdict,
       CASE WHEN f = 'last_close' THEN 'NEW_VERSION' WHEN f = 'long_lookback' THEN 'NEW_TEST_PACK' ELSE '' END AS remediation
FROM (VALUES ('trailing_return'), ('last_close'), ('long_lookback')) x(f)"""


@query("pit_gate", SQL_GATE)
def pit_gate(spark, d):
    bars = D.stored_bars(spark, d)
    cases = bars.where(F.month("ts") <= 6).groupBy("symbol", "session").agg(F.max("ts").alias("signal_ts")).withColumn(
        "case_id", F.concat_ws("|", "symbol", "session"))
    runs = E.gate({"trailing_return": ("1", E.trailing_return, 5), "last_close": ("1", E.last_close, 0),
                   "long_lookback": ("1", E.trailing_return, 100_000)}, cut_lineage(cases), bars)
    return runs.select("feature_name", "n_cases", "failures", "verdict", "remediation")


# -- spine, manifest, collection, integrity -----------------------------------------------------------
@query("batch_spine", """SELECT 'S' || s_suppkey AS symbol, strftime(g, '%Y-%m-%d') AS session
FROM supplier, generate_series(TIMESTAMP '2024-01-01', TIMESTAMP '2024-02-15', INTERVAL 1 DAY) t(g) WHERE isodow(g) < 6""")
def batch_spine(spark, d):
    s = D.table(spark, d, "supplier").select(F.concat(F.lit("S"), F.col("s_suppkey")).alias("symbol"))
    return P.batch_spine(s, "2024-01-01", "2024-02-15")


@query("session_candidates", f"""WITH spine AS (SELECT 'S' || s_suppkey AS symbol, g FROM supplier,
  generate_series(TIMESTAMP '2024-03-06', TIMESTAMP '2024-03-13', INTERVAL 1 DAY) t(g) WHERE isodow(g) < 6)
SELECT symbol, {sql_iso("timezone('UTC', timezone('America/New_York', g + to_minutes(m)))", 'signal_ts')}, symbol || '|' || strftime(g, '%Y-%m-%d') AS candidate_batch_id
FROM spine, (VALUES (600), (660), (870)) v(m)""")
def session_candidates(spark, d):
    s = D.table(spark, d, "supplier").select(F.concat(F.lit("S"), F.col("s_suppkey")).alias("symbol"))
    return P.candidates_at(P.batch_spine(s, "2024-03-06", "2024-03-13")).select("symbol", iso("signal_ts"), "candidate_batch_id")


def _manifest(spark, d):
    status = F.col("o_orderstatus")
    return D.table(spark, d, "orders").select(
        F.date_format("o_orderdate", "yyyy-MM").alias("run_id"), F.col("o_orderkey").alias("seq"),
        F.concat(F.lit("C"), F.col("o_custkey")).alias("symbol"), F.date_format("o_orderdate", "yyyy").alias("session"),
        F.when(status == "O", "STARTED").when(status == "F", "COMMITTED").otherwise("QUARANTINED").alias("event_type"))


SQL_MANIFEST = f"""
m AS (SELECT 'C' || o_custkey AS symbol, strftime(o_orderdate, '%Y') AS session, strftime(o_orderdate, '%Y-%m') AS run_id, o_orderkey AS seq,
             CASE o_orderstatus WHEN 'O' THEN 'STARTED' WHEN 'F' THEN 'COMMITTED' ELSE 'QUARANTINED' END AS event_type FROM orders),
latest AS (SELECT symbol, session, last(event_type ORDER BY run_id, seq) AS status FROM m GROUP BY ALL),
{D.sql_years("SELECT 'C' || c_custkey AS symbol FROM customer", "o_orderdate", "orders")}"""


def _customer_years(spark, d):
    c = D.table(spark, d, "customer").select(F.concat(F.lit("C"), F.col("c_custkey")).alias("symbol"))
    return P.year_spine(c, _manifest(spark, d))


@query("manifest_status", f"WITH {SQL_MANIFEST} SELECT symbol, session, coalesce(status, 'NONE') AS status FROM spine LEFT JOIN latest USING (symbol, session)")
def manifest_status(spark, d):
    return T.status_of(_customer_years(spark, d), _manifest(spark, d)).select("symbol", "session", "status")


@query("manifest_history", f"""WITH {SQL_MANIFEST}
SELECT symbol, session, row_number() OVER (PARTITION BY symbol, session ORDER BY run_id, seq) AS step, run_id, seq, event_type FROM m""")
def manifest_history(spark, d):
    return T.history(_manifest(spark, d)).select("symbol", "session", "step", "run_id", "seq", "event_type")


@query("pending_batches", f"WITH {SQL_MANIFEST} SELECT symbol, session FROM spine LEFT JOIN latest USING (symbol, session) WHERE status IS DISTINCT FROM 'COMMITTED'")
def pending_batches(spark, d):
    return T.pending(_customer_years(spark, d), _manifest(spark, d)).select("symbol", "session")


@query("collection_accounting", f"""{SQL_TO_BUILT}, store AS (SELECT DISTINCT candidate_key FROM built WHERE reason_code IS NULL AND scanner_rank < 30),
fate AS (SELECT symbol, session, CASE WHEN reason_code = 'BURNED_CALIBRATION_SLICE' THEN 'burned' WHEN reason_code IS NOT NULL THEN 'rejected'
                WHEN candidate_key IN (SELECT candidate_key FROM store) THEN 'duplicate' ELSE 'stored' END AS f FROM built)
SELECT symbol, session, count(*) AS candidate_count, count(*) FILTER (WHERE f = 'stored') AS stored_count, count(*) FILTER (WHERE f = 'duplicate') AS duplicate_count,
       count(*) FILTER (WHERE f = 'rejected') AS rejected_count, count(*) FILTER (WHERE f = 'burned') AS burned_count FROM fate GROUP BY ALL""")
def collection_accounting(spark, d):
    """Fate of every candidate against a store that already holds the low-ranked ones."""
    rows = cut_lineage(built(spark, d))
    store = O.accepted(rows).where(F.col("scanner_rank") < 30).select("candidate_key")
    spine = D.signals(spark, d).select("symbol", "session").distinct()
    return account(spine, rows, store)


def _rebuild(spark, d):
    views = D.events(spark, d, "view").withColumn("session", F.date_format("ts", "yyyy-MM-dd"))

    def rebuild(candidates):
        seen = O.with_data_as_of(candidates, views)
        return O.build_observations(seen, references(spark, d), signal_burn(spark, d), zone=ZONE,
                                    train_end="2024-01-15", val_end="2024-01-22")
    return rebuild


@query("integrity_checks", f"""{_OBS},
checks AS (SELECT 'version_in_force' AS "check", count(*) AS checked FROM obs UNION ALL SELECT 'nothing_burned', count(*) FROM obs
  UNION ALL SELECT 'signed_and_known', count(*) FROM obs UNION ALL SELECT 'active_set', count(DISTINCT symbol) FROM symver
  UNION ALL SELECT 'same_when_rebuilt', 0 UNION ALL SELECT 'all_accounted', count(DISTINCT (symbol, session)) FROM signals)
SELECT "check", TRUE AS passed, checked, 0 AS violations FROM checks""")
def integrity_checks(spark, d):
    return run_suite(D.signals(spark, d), _rebuild(spark, d), D.symbol_versions(spark, d), as_of_date="2024-01-15", zone=ZONE)


@query("integrity_faults", f"""{_OBS},
kept AS (SELECT * FROM obs WHERE scanner_rank <> 14),
act AS (SELECT DISTINCT symbol FROM symver WHERE active_from <= DATE '2024-01-15' AND (active_to IS NULL OR DATE '2024-01-15' < active_to)),
checks AS (
  SELECT 'version_in_force' AS "check", count(*) AS checked, count(*) FILTER (WHERE scanner_rank = 11) AS violations FROM kept
  UNION ALL SELECT 'nothing_burned', count(*), count(*) FILTER (WHERE scanner_rank = 12) FROM kept
  UNION ALL SELECT 'signed_and_known', count(*), count(*) FILTER (WHERE scanner_rank IN (11, 13)) FROM kept
  UNION ALL SELECT 'active_set', (SELECT count(DISTINCT symbol) FROM symver) + 1, count(*) + 1 FROM act WHERE symbol LIKE '%7'
  UNION ALL SELECT 'same_when_rebuilt', n, n FROM (SELECT count(*) FILTER (WHERE scanner_rank = 14)
    + 2 * count(*) FILTER (WHERE scanner_rank = 11 AND reason_code IS NULL) AS n FROM built)
  UNION ALL SELECT 'all_accounted', count(DISTINCT (symbol, session)), count(DISTINCT (symbol, session)) FILTER (WHERE scanner_rank = 14) FROM signals)
SELECT "check", violations = 0 AS passed, checked, violations FROM checks""")
def integrity_faults(spark, d):
    """The same checks on tables with planted faults: each must find just these."""
    signals, symbols = D.signals(spark, d), D.symbol_versions(spark, d)
    good = cut_lineage(_rebuild(spark, d)(signals))
    rank, kept = F.col("scanner_rank"), F.col("reason_code").isNull()
    bad = good.where(rank != 14).withColumns({
        "symbol_registry_id": F.when(kept & (rank == 11), "NO_SUCH_VERSION").otherwise(F.col("symbol_registry_id")),
        "dataset_role": F.when(kept & (rank == 12), CALIBRATION_ROLE).otherwise(F.col("dataset_role")),
        "direction": F.when(kept & (rank == 13), "SHORT").otherwise(F.col("direction"))})
    listed = active_symbols(symbols, "2024-01-15").where(~F.col("symbol").endswith("7"))
    ghost = symbols.agg(F.lit("GHOST").alias("symbol"))
    return judge(signals, bad, good, listed.unionByName(ghost), symbols, as_of_date="2024-01-15", zone=ZONE)
