from datetime import date

import pytest
from pyspark.sql import functions as F

from chronotape import schemas as S
from chronotape.functions.hashing import SIGNATURE_FIELDS, registry_signature
from chronotape.operators import audit as U
from chronotape.operators import features
from chronotape.operators.observations import References
from chronotape.operators.quality import Streams
from chronotape.plans.collection import StorePaths, burned_in_store, collect, read_observations
from chronotape.sources import readers, spine, tables
from conftest import minute_bars, utc


def references(spark):
    symbols = spark.createDataFrame(
        [(f"{s}#0001", s, utc("2023-01-01T00:00:00"), date(2020, 1, 1), None) for s in ("KTOS", "CRDO")],
        "symbol_registry_id string, symbol string, valid_from timestamp, active_from date, active_to date")
    regimes = spark.createDataFrame([("RGM1", utc("2024-01-01T00:00:00"), "1H", "v1")],
                                    "regime_snapshot_id string, regime_ts timestamp, cadence string, regime_spec_version string")
    setups = spark.createDataFrame([("GAP_GO@1", "GAP_GO", "1", "ACTIVE")], "setup_version_id string, setup_id string, version string, status string")
    universes = spark.createDataFrame([("SMALL_CAP_US@1", "SMALL_CAP_US", utc("2023-01-01T00:00:00"), "{}")], S.UNIVERSES)
    scanners = spark.createDataFrame([("SCAN_MOMENTUM@1", "SCAN_MOMENTUM", "1", "ACTIVE")], S.SCANNERS)
    return References(symbols, regimes, setups, universes, scanners, "LBL_V1")


def batch(spark, symbol, session):
    # 09:30 New York is 14:30 UTC in winter.
    return minute_bars(spark, [10 + (i % 5) * 0.01 for i in range(390)], symbol=symbol, session=session, start=f"{session}T14:30:00")


def specs(spark, *pairs):
    return spark.createDataFrame(list(pairs), "symbol string, session string")


def streams(*frames):
    bars = frames[0]
    for f in frames[1:]:
        bars = bars.unionByName(f)
    return Streams(bars=bars, quotes=bars.select("symbol", "session", "seq", "ts", "bid", "ask"))


@pytest.fixture
def nothing_burned(spark):
    return spark.createDataFrame([], S.BURNED)


def run(spark, sp, st, burned, folder, run_id="1", candidates=spine.candidates_at, **kw):
    out = collect(sp, st, candidates, references(spark), burned, StorePaths(folder), run_id, **kw)
    return {(r.symbol, r.session): r for r in out.collect()}


def test_store_duplicate_and_resume(spark, folder, nothing_burned):
    d1, d2 = "2024-03-01", "2024-03-04"
    st = streams(batch(spark, "KTOS", d1), batch(spark, "KTOS", d2))
    first = run(spark, specs(spark, ("KTOS", d1)), st, nothing_burned, folder)[("KTOS", d1)]
    assert (first.status, first.candidate_count, first.stored_count) == ("COMMITTED", 3, 3)
    store = read_observations(spark, StorePaths(folder))
    assert store.count() == 3 and U.bad_signatures(store).count() == 0 and U.pit_violations(store).count() == 0
    assert {r.data_as_of_ts.strftime("%H:%M") for r in store.collect()} == {"15:00", "16:00", "19:30"}

    again = run(spark, specs(spark, ("KTOS", d1), ("KTOS", d2)), st, nothing_burned, folder, "2")
    assert again[("KTOS", d1)].status == "SKIPPED" and again[("KTOS", d2)].stored_count == 3
    assert read_observations(spark, StorePaths(folder)).count() == 6
    manifest = tables.read_table(spark, StorePaths(folder).manifest, S.MANIFEST)
    assert {r.status for r in tables.batch_status(manifest).collect()} == {"COMMITTED"}

    # A run that lost its manifest stores nothing twice.
    manifest.limit(0).write.mode("overwrite").parquet(folder + "/empty")
    class Lost(StorePaths):
        manifest = folder + "/other_manifest"
    lost = collect(specs(spark, ("KTOS", d1)), st, spine.candidates_at, references(spark), nothing_burned, Lost(folder), "3").head()
    assert (lost.stored_count, lost.duplicate_count) == (0, 3)
    assert read_observations(spark, StorePaths(folder)).count() == 6


def test_rejections_quarantine_and_burn(spark, folder, nothing_burned):
    d = "2024-03-01"
    bad = batch(spark, "CRDO", d).withColumn("close", F.when(F.col("seq") == 5, -1.0).otherwise(F.col("close")))
    st = streams(batch(spark, "KTOS", d), bad, batch(spark, "ZZZZ", d))

    def shorts(passing):
        made = spine.candidates_at(passing)
        return made.unionByName(made.where("symbol = 'KTOS'").limit(1).withColumn("direction", F.lit("SHORT")))

    got = run(spark, specs(spark, ("KTOS", d), ("CRDO", d), ("ZZZZ", d)), st, nothing_burned, folder, candidates=shorts)
    assert got[("CRDO", d)].status == "QUARANTINED" and got[("CRDO", d)].candidate_count == 0
    assert (got[("KTOS", d)].stored_count, got[("KTOS", d)].rejected_count) == (3, 1)
    assert (got[("ZZZZ", d)].stored_count, got[("ZZZZ", d)].rejected_count) == (0, 3)
    codes = {r.reason_code: r.n for r in spark.read.parquet(StorePaths(folder).rejections).groupBy("reason_code").agg(F.count("*").alias("n")).collect()}
    assert codes == {"LONG_ONLY_VIOLATION": 1, "MISSING_SYMBOL_VERSION": 3}

    burned = spark.createDataFrame([(date(2024, 3, 1), date(2024, 3, 1), None)], S.BURNED)
    other = folder + "/b"
    days = [("KTOS", d), ("KTOS", "2024-03-04")]
    out = run(spark, specs(spark, *days), streams(batch(spark, *days[0]), batch(spark, *days[1])), burned, other)
    assert (out[days[0]].burned_count, out[days[0]].stored_count, out[days[1]].stored_count) == (3, 0, 3)
    assert burned_in_store(read_observations(spark, StorePaths(other))).count() == 0


def test_a_broken_run_is_repeated_without_doubles(spark, folder, nothing_burned, monkeypatch):
    """A run that dies between its last rows and its COMMITTED events."""
    d = "2024-03-01"
    st = streams(batch(spark, "KTOS", d), batch(spark, "ZZZZ", d))
    sp = specs(spark, ("KTOS", d), ("ZZZZ", d))
    twice = lambda passing: spine.candidates_at(passing).unionAll(spine.candidates_at(passing).where("symbol = 'ZZZZ'"))
    real = tables.manifest_events

    def dies(rows, event_type, *args):
        if event_type == tables.COMMITTED:
            raise RuntimeError("lost")
        return real(rows, event_type, *args)

    monkeypatch.setattr(tables, "manifest_events", dies)
    with pytest.raises(RuntimeError):
        run(spark, sp, st, nothing_burned, folder, "1", candidates=twice)
    monkeypatch.setattr(tables, "manifest_events", real)
    paths = StorePaths(folder)
    sizes = lambda: [spark.read.parquet(p).count() for p in (paths.observations, paths.rejections, paths.provenance)]
    assert sizes() == [3, 6, 2]
    again = run(spark, sp, st, nothing_burned, folder, "1", candidates=twice)
    assert {r.status for r in again.values()} == {"COMMITTED"} and sizes() == [3, 6, 2]
    assert {r.status for r in run(spark, sp, st, nothing_burned, folder, "2", candidates=twice).values()} == {"SKIPPED"}
    assert sizes() == [3, 6, 2]


def test_features_come_from_bars_known_at_the_signal(spark, folder, nothing_burned):
    d = "2024-03-01"
    one = batch(spark, "KTOS", d)
    st = streams(one)
    port = features.from_bars({"last_close": features.last_close, "trailing_return": features.trailing_return, "bars": features.bars_known,
                               "never": features.Fold(lambda: F.max(F.when(F.col("close") < 0, F.col("close"))))})
    extra = lambda rows: F.create_map(F.lit("rank"), F.col("scanner_rank").cast("double"))
    run(spark, specs(spark, ("KTOS", d)), st, nothing_burned, folder, bar_features=port, features=extra)
    bars = sorted((b.ts, b.close) for b in one.collect())
    stored = read_observations(spark, StorePaths(folder)).collect()
    assert len(stored) == 3
    for o in stored:
        known = [c for t, c in bars if t <= o.signal_ts]
        assert len(known) < len(bars)
        want = {"last_close": known[-1], "trailing_return": known[-1] / known[0] - 1, "bars": float(len(known))}
        assert {k: v for k, v in o.features.items() if k != "rank"} == want and "never" not in o.features


def test_spines(spark):
    one = spark.createDataFrame([("A",)], "symbol string")
    assert [r.session for r in spine.batch_spine(one, "2025-03-07", "2025-03-10").orderBy("session").collect()] == ["2025-03-07", "2025-03-10"]
    assert [r.session for r in spine.last_weekdays(one, "2025-03-10", 3).orderBy("session").collect()] == ["2025-03-06", "2025-03-07", "2025-03-10"]
    # Clocks change on 2025-03-09: 10:00 in New York is 15:00 UTC before and 14:00 UTC after.
    made = spine.candidates_at(spine.batch_spine(one, "2025-03-07", "2025-03-10"), [(10, 0)])
    assert [r.signal_ts.hour for r in made.orderBy("session").collect()] == [15, 14]


def test_tables_and_readers(spark, folder):
    rows = spark.createDataFrame([("a", 2), ("a", 1), ("b", 3)], "k string, v int")
    for _ in range(2):
        tables.append_once(spark, rows, folder + "/t", "k string, v int", ["k"], ["v"])
    assert sorted(map(tuple, spark.read.parquet(folder + "/t").collect())) == [("a", 1), ("b", 3)]
    incoming = spark.createDataFrame([(1, "L1", "x"), (2, "L1", "y"), (3, "L2", "z"), (4, "L3", "w"), (5, "L2", "z")], "seq int, id string, c string")
    store = spark.createDataFrame([("L3", "old")], "id string, c string")
    assert {r.seq: r.verdict for r in tables.conflicts(incoming, store, "id", "c", ["seq"]).collect()} == {
        1: "NEW", 2: "CONFLICT", 3: "NEW", 4: "CONFLICT", 5: "SAME"}
    bars = batch(spark, "KTOS", "2024-03-01")
    readers.write_sessions(bars.select(*[f.name for f in S.struct_of(S.BARS).fields]), folder + "/bars")
    back = readers.read_bars(spark, folder + "/bars", ["KTOS"], "2024-03-01", "2024-03-01")
    assert back.count() == 390 and "PartitionFilters: [isnotnull(session" in back._jdf.queryExecution().executedPlan().toString()
    with open(folder + "/agg.json", "w") as f:
        f.write('{"ticker":"A","results":[{"o":1,"h":2,"l":0.5,"c":1.5,"v":10,"t":1741012200000}]}')
    r = readers.read_vendor_aggregates(spark, folder + "/agg.json").head()
    assert (r.symbol, r.session, r.close) == ("A", "2025-03-03", 1.5) and abs((r.ask - r.bid) - (0.0008 * 1.5 + 0.01)) < 1e-12


def test_audit_names_each_problem(spark):
    ids = dict(zip(SIGNATURE_FIELDS, ["S#1", "REG-1", "GAP@1", "LBL", "U@1", "P@1"]))
    rows = [("1", "ABCD", "REG-1", "GAP_AND_GO", "2025-03-03T15:00:00"), ("2", "WXYZ", "REG-2", "OPENING_RANGE", "2025-04-07T15:00:00"),
            ("3", "ABCD", "REG-1", "GAP_AND_GO", "2025-03-10T15:00:00")]
    base = spark.createDataFrame([(i, s, r, k, utc(t), utc(t), "LONG", "TRAIN") for i, s, r, k, t in rows],
                                 "observation_id string, symbol string, regime_snapshot_id string, setup_type string, signal_ts timestamp, "
                                 "data_as_of_ts timestamp, direction string, dataset_role string")
    for c, v in ids.items():
        if c != "regime_snapshot_id":
            base = base.withColumn(c, F.lit(v))
    base = base.withColumn("registry_signature_hash", registry_signature())
    counts = {(r.dimension, r.value): r.n for r in U.dataset_counts(base).collect()}
    assert counts[("symbol", "ABCD")] == 2 and counts[("regime", "REG-2")] == 1 and counts[("month", "2025-03")] == 2
    assert counts[("role", "TRAIN")] == counts[("total", "")] == 3
    dirty = (base.unionByName(base.where("observation_id = '1'").withColumn("observation_id", F.lit("4")))
             .unionByName(base.where("observation_id = '2'").withColumn("observation_id", F.lit("5")).withColumn("setup_type", F.lit("X"))
                          .withColumn("registry_signature_hash", F.lit("bad")))
             .unionByName(base.where("observation_id = '2'").withColumn("observation_id", F.lit("6")).withColumn("setup_type", F.lit("Y"))
                          .withColumn("direction", F.lit("SHORT"))))
    assert U.duplicate_observations(dirty).count() == 1
    assert [r[0] for r in U.bad_signatures(dirty).collect()] == ["5"]
    assert [r[0] for r in U.long_only_violations(dirty).collect()] == ["6"]
    known = {"symbol": spark.createDataFrame([("OTHER",)], "id string")}
    assert U.orphans(base, known).count() == 3
    report = {r.metric: (r.value, r.status) for r in U.audit(dirty, known).collect()}
    assert report["duplicate_observations"][0] == 1 and report["orphans_symbol"][0] == 6
    assert report["halt_coverage"] == (None, "REQUIRES_HALT_REGISTRY")
