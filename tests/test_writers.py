from datetime import timedelta

from pyspark.sql import functions as F

from chronotape import schemas as S
from chronotape.operators import barriers as B
from chronotape.operators import observations as O
from chronotape.operators import timelines as T
from chronotape.plans import dataset as DS
from chronotape.sources import readers
from chronotape.sources import registry_writers as W
from conftest import utc

T0 = utc("2025-03-03T15:00:00")


def test_registry_rows_and_write_once(spark, folder):
    regimes = spark.createDataFrame([(T0, "1H", "v1", "ON"), (T0, "1H", "v1", "OFF"), (T0 + timedelta(hours=1), "1H", "v1", "ON")],
                                    "regime_ts timestamp, cadence string, regime_spec_version string, risk_state string")
    rows = W.regime_rows(regimes)
    for _ in range(2):
        W.write_registry(spark, rows, folder + "/regimes", "regimes", ["risk_state"])
    stored = spark.read.parquet(folder + "/regimes").collect()
    assert sorted(r.regime_snapshot_id for r in stored) == ["RGM_v1_1H_20250303T150000+0000", "RGM_v1_1H_20250303T160000+0000"]
    assert {r.risk_state for r in stored if r.regime_ts.hour == 15} == {"OFF"}

    setups = W.setup_rows(spark.createDataFrame([("ORB", "1", "mod:f", "{}", None)],
                                                "setup_id string, version string, detector_ref string, params string, status string"))
    assert tuple(setups.select("setup_version_id", "status").head()) == ("ORB@1", "ACTIVE")
    scanners = W.scanner_rows(spark.createDataFrame([("P", "2", "ACTIVE")], "scanner_id string, scanner_spec_version string, status string"))
    assert scanners.head().scanner_version_id == "P@2"
    universes = W.universe_rows(spark.createDataFrame([("U", "1", T0, "{}")], "universe_id string, version string, valid_from timestamp, membership_rule string"))
    assert universes.head().universe_version_id == "U@1"
    news = W.news_rows(spark.createDataFrame([("K", T0, T0 - timedelta(seconds=180), "s"), ("K", T0, None, "s")],
                                             "symbol string, news_available_ts timestamp, publish_ts timestamp, source string"), "r").collect()
    assert [r.publication_delay_sec for r in news] == [180.0, None] and news[0].news_id != news[1].news_id
    dq = W.quality_as_of_rows(spark.createDataFrame([("K", T0, True, False)], "symbol string, as_of timestamp, feed_outage_active boolean, stale_quote boolean"), "r")
    assert dq.head().pit_class == "AS_OF" and dq.head().dq_id.startswith("DQA_")
    retro = W.quality_retrospective_rows(spark.sql("select 'K' symbol, date'2025-03-03' session_date, 0.5D missing_bars_pct"), "r")
    assert retro.head().dq_id.startswith("DQR_")
    halts = W.halt_rows(spark.createDataFrame([("K", T0, None, "LULD")], "symbol string, halt_start_ts timestamp, halt_end_ts timestamp, reason string"), "r")
    W.write_registry(spark, halts, folder + "/halts", "halts", ["halt_start_ts"])
    assert readers.read_reference(spark, folder + "/halts", "halts").head().reason == "LULD"


def test_every_record_is_stored_once_per_run(spark, folder):
    news = spark.createDataFrame([("K", T0, None, "wire", "first"), ("K", T0, None, "wire", "second"), ("K", T0, None, "wire", "second")],
                                 "symbol string, news_available_ts timestamp, publish_ts timestamp, source string, headline string")
    for run in ("a", "a", "b"):
        W.write_registry(spark, W.news_rows(news, run), folder + "/news", "news", ["news_available_ts"])
    stored = spark.read.parquet(folder + "/news")
    assert stored.count() == 6 and stored.select("news_id").distinct().count() == 6
    halts = "symbol string, halt_start_ts timestamp, halt_end_ts timestamp, reason string"
    for end in (None, T0 + timedelta(minutes=5)):
        W.write_registry(spark, W.halt_rows(spark.createDataFrame([("K", T0, end, "LULD")], halts), "r"), folder + "/halts", "halts", ["halt_start_ts"])
    assert spark.read.parquet(folder + "/halts").count() == 2


def test_refusal_partition(spark):
    r = spark.createDataFrame([("UNKNOWN_SETUP",), ("LONG_ONLY_VIOLATION",), ("BURNED_CALIBRATION_SLICE",)], "reason_code string")
    assert (O.rejections_only(r).count(), O.exclusions_only(r).count(), O.by_code(r).count()) == (2, 1, 3)


def test_dataset(spark):
    rows = spark.createDataFrame([("k%031d" % i, f"o{i}", "TRAIN" if i % 2 else "CALIBRATION_ONLY", f"2025-03-{i + 1:02d}", {"f": float(i)}) for i in range(10)],
                                 "candidate_key string, observation_id string, dataset_role string, session string, features map<string,double>")
    rows = rows.withColumn("candidate_key", F.sha2("candidate_key", 256).substr(1, 32))
    picked = DS.select_observations(rows, start="2025-03-04")
    a, b = DS.dataset_version(picked).head(), DS.dataset_version(picked.orderBy(F.desc("session")).repartition(7)).head()
    assert a == b and a.n_rows == 4
    assert DS.dataset_version(picked.where("session > '2025-03-05'")).head().dataset_version != a.dataset_version
    labels = picked.limit(1).select("candidate_key", F.lit(1).alias("label"))
    assert DS.select_observations(rows, start="2025-03-04", labels=labels).where("label is not null").count() == 1
    assert DS.features_long(picked).select("feature").distinct().count() == 1


def test_excursions_and_json(spark, folder):
    entries = spark.createDataFrame([("A", "d", T0, T0 + timedelta(hours=5), 10.0, 0.02, 2.0)],
                                    "symbol string, session string, entry_ts timestamp, session_close timestamp, ref double, spread double, atr double")
    bars = spark.createDataFrame([("A", "d", T0 + timedelta(minutes=m), h, lo) for m, h, lo in ((0, 99.0, 1.0), (1, 11.0, 9.5), (2, 12.0, 8.0), (50, 20.0, 1.0))],
                                 "symbol string, session string, ts timestamp, high double, low double")
    r = B.excursions(entries, bars, 15).head()
    assert (r.mfe, r.mae, r.path_bars) == (1.0, -1.0, 2)
    events = spark.createDataFrame([("t", "A", T0, i, T0, "NEWS", "AT", {}, {}) for i in range(2)], S.TIMELINE_EVENTS)
    readers.write_json(T.nested(events), folder + "/json")
    assert len(spark.read.json(folder + "/json").head().events) == 2


def test_archetype_index(spark):
    events = spark.createDataFrame([(t, t, T0, i, T0, k, "POST", {}, {}) for t, ks in (("a", "XY"), ("b", "YX"), ("c", "X")) for i, k in enumerate(ks)],
                                   S.TIMELINE_EVENTS)
    index = T.index_rows(events, "kind_set")
    assert [(r.archetype, r.n) for r in T.index_families(index, "kind_set").collect()] == [("X|Y", 2), ("X", 1)]
    assert [r.timeline_id for r in T.index_members(index, "kind_set", "X|Y").collect()] == ["a", "b"]


def test_equal_halts_of_two_runs_are_both_kept(spark, folder):
    halts = spark.createDataFrame([("K", T0, None, "LULD")] * 2, "symbol string, halt_start_ts timestamp, halt_end_ts timestamp, reason string")
    for run in ("a", "a", "b"):
        W.write_registry(spark, W.halt_rows(halts, run), folder + "/halts", "halts", ["halt_start_ts"])
    assert spark.read.parquet(folder + "/halts").count() == 4


def test_retrospective_choice_does_not_depend_on_layout(spark):
    from chronotape.operators.registries import retrospective_quality
    rows = [("K", "2025-03-03", "RETROSPECTIVE", run, n, None) for run, n in (("r1", 9), ("r3", 1), ("r2", 5), ("r3", 2))]
    quality = spark.createDataFrame(rows, "symbol string, session_date string, pit_class string, run_id string, n_bad_ticks int, note string")
    sessions = spark.createDataFrame([("K", "2025-03-03"), ("L", "2025-03-03")], "symbol string, session_date string")
    for parts in (1, 4):
        got = retrospective_quality(sessions, quality.repartition(parts), order=["run_id"]).collect()
        assert {r.symbol: (r.run_id, r.n_bad_ticks) for r in got} == {"K": ("r3", 2), "L": (None, None)}
