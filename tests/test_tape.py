from datetime import timedelta

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from chronotape.operators import detectors as X
from chronotape.operators import timelines as T
from chronotape.plans.reconstruction import reconstruct_sessions
from conftest import minute_bars, utc


def kinds(df):
    return [r.kind for r in df.orderBy("ts", "kind").collect()]


def test_vwap_cross(spark):
    bars = minute_bars(spark, [10.1, 10.1, 9.8, 9.8, 10.3])
    assert "VWAP_CROSS_UP" in kinds(X.facts(bars, [X.vwap_crosses]))


def test_volume_expansion(spark):
    bars = minute_bars(spark, [10] * 4, volumes=[100, 100, 100, 400])
    hit = X.facts(bars, [X.volume_expansion], X.DetectorSettings(volume_lookback=2)).collect()
    assert [h.kind for h in hit] == ["VOLUME_EXPANSION"] and hit[0].detail["ratio"] >= 3


def test_opening_range(spark):
    bars = minute_bars(spark, [10, 10.5, 11.5], highs=[10, 11, 12])
    found = kinds(X.facts(bars, [X.opening_range], X.DetectorSettings(or_minutes=1)))
    assert found == ["OPENING_RANGE_SET", "OR_BREAK_UP"]


def test_sweep(spark):
    bars = minute_bars(spark, [9.9, 9.9, 9.9, 9.5], highs=[10, 10, 10, 11])
    assert "SWEEP_OF_HIGHS" in kinds(X.facts(bars, [X.sweeps], X.DetectorSettings(sweep_lookback=2)))


def test_session_extremes_strict(spark):
    bars = minute_bars(spark, [10, 11, 11, 12, 9])
    found = kinds(X.facts(bars, [X.session_extremes], X.DetectorSettings(or_minutes=1)))
    assert found == ["NEW_SESSION_HIGH", "NEW_SESSION_HIGH", "NEW_SESSION_LOW"]


def test_clusters_greedy(spark):
    t0 = utc("2025-03-03T10:00:00")
    ev = spark.createDataFrame([("A", "d", t0 + timedelta(minutes=m)) for m in (0, 1, 2, 5, 6, 7, 8, 30)],
                               "symbol string, session string, ts timestamp")
    got = [(r.ts.minute, r.detail["count"]) for r in X.clusters(ev).orderBy("ts").collect()]
    assert got == [(0, 4.0), (6, 3.0)]


def test_empty_bars_keep_anchor(spark):
    anchors = spark.createDataFrame([("ABCD", "2025-03-03", utc("2025-03-03T15:00:00"))],
                                    "symbol string, session string, anchor_ts timestamp")
    events = reconstruct_sessions(anchors, minute_bars(spark, [10]).where("false")).collect()
    assert [(e.kind, e.phase, e.idx) for e in events] == [("NEWS", "AT", 0)]


def test_halts_and_window(spark):
    bars = minute_bars(spark, [10 + (i % 7) * 0.1 for i in range(60)])
    anchors = spark.createDataFrame([("ABCD", "2025-03-03", utc("2025-03-03T14:40:00"))],
                                    "symbol string, session string, anchor_ts timestamp")
    halts = spark.createDataFrame([("ABCD", "2025-03-03", utc("2025-03-03T14:45:00"), utc("2025-03-03T16:59:00"))],
                                  "symbol string, session string, halt_start_ts timestamp, halt_end_ts timestamp")
    events = reconstruct_sessions(anchors, bars, halts, pre_bars=5, post_bars=10).collect()
    found = {e.kind for e in events}
    assert "HALT_START" in found and "HALT_RESUME" not in found
    assert all((e.phase == "PRE") == (e.ts < e.anchor_ts) or e.phase == "AT" for e in events)
    assert [e.idx for e in sorted(events, key=lambda e: e.idx)] == list(range(len(events)))


@pytest.fixture(scope="module")
def events(spark):
    anchor = utc("2025-03-03T15:00:00")
    raw = {
        "ABCD": [(-5, "VOLUME_EXPANSION", "PRE", {"ratio": 3.4}), (0, "NEWS", "AT", {}),
                 (2, "VWAP_CROSS_UP", "POST", {"vwap": 10.0}), (3, "OR_BREAK_UP", "POST", {"level": 10.5})],
        "WXYZ": [(-2, "VOLUME_EXPANSION", "PRE", {"ratio": 5.0}), (0, "NEWS", "AT", {}),
                 (2, "VWAP_CROSS_UP", "POST", {"vwap": 20.0}), (3, "OR_BREAK_UP", "POST", {"level": 21.0})],
        "QQQQ": [(0, "NEWS", "AT", {}), (10, "SWEEP_OF_LOWS", "POST", {"level": 5.0})]}
    rows = [(s, s, anchor, i, anchor + timedelta(minutes=m), k, p, d, {})
            for s, evs in raw.items() for i, (m, k, p, d) in enumerate(evs)]
    from chronotape.schemas import TIMELINE_EVENTS
    return spark.createDataFrame(rows, TIMELINE_EVENTS)


def test_counts_and_descriptions(events):
    assert {r.kind: r.n for r in T.kind_frequency(events).collect()}["NEWS"] == 3
    assert {r.phase: r.n for r in T.phase_distribution(events).collect()}["AT"] == 3
    d = T.events_per_timeline(events).head()
    assert (d["count"], d["max"]) == (3, 4.0)
    first = T.time_to_first_kind(events, "VWAP_CROSS_UP").head()
    assert (first["count"], first["min"]) == (2, 2.0)
    assert "VWAP_CROSS_UP->OR_BREAK_UP" in {r.pair for r in T.kind_pairs(events).collect()}


def test_families(events):
    assert sorted(r.n for r in T.family_sizes(events, "kind_set").collect()) == [1, 2]
    assert T.family_sizes(events, "kind_seq").head().n == 2
    assert {r.archetype for r in T.archetypes(events, "post_kind_set").collect()} == {"OR_BREAK_UP|VWAP_CROSS_UP", "SWEEP_OF_LOWS"}
    with pytest.raises(ValueError):
        T.archetypes(events, "nearest")


def test_search(events):
    assert events.where((F.col("kind") == "VWAP_CROSS_UP") & (F.col("phase") == "POST")).count() == 2
    assert events.where((F.col("kind") == "VOLUME_EXPANSION") & (T.fact("ratio") >= 4)).count() == 1
    assert events.where(T.fact("no such key") != 1).count() == 0
    assert [r[0] for r in T.timelines_where(events, F.bool_or(F.col("kind") == "SWEEP_OF_LOWS")).collect()] == ["QQQQ"]
    some = events.where(F.col("symbol").isin("ABCD", "QQQQ"))
    assert T.timelines_where(some, F.count("*") >= 4, T.archetype_key("kind_set").isNotNull()).count() == 1
    with pytest.raises(ValueError):
        T.fact("score")


def test_graph(events):
    edges = T.graph_edges(events.where("timeline_id = 'ABCD'")).collect()
    relations = {(e.src, e.dst): e.relation for e in edges if e.relation != "FOLLOWS"}
    assert relations == {(0, 1): "WITHIN_5M", (1, 2): "WITHIN_5M", (1, 3): "WITHIN_5M", (2, 3): "WITHIN_5M"}
    assert sum(e.relation == "FOLLOWS" for e in edges) == 3


def test_heatmap_tree_nested(events):
    cells = {(r.kind, r.bucket): r.n for r in T.heatmap(events).collect()}
    assert cells[("VOLUME_EXPANSION", -5)] == 2 and cells[("NEWS", 10)] == 0
    assert T.event_tree(events).where("timeline_id = 'QQQQ' and phase = 'POST'").head().times == ["15:10:00"]
    assert len(T.nested(events).where("timeline_id = 'ABCD'").head().events) == 4


def test_forbidden_detail(spark, events):
    bad = events.withColumn("detail", F.create_map(F.lit("score"), F.lit(1.0)))
    assert T.guard_details(events).count() == events.count()
    with pytest.raises(Exception, match="forbidden"):
        T.guard_details(bad).collect()


def test_volume_median_reads_lagged_values_as_a_percentile_would(spark):
    """Even and odd numbers of values, repeats, gaps in the volume and short lookbacks; no percentile is aggregated per frame."""
    from chronotape.operators.detectors import DetectorSettings
    volumes = [5, None, 7, 7, 1, 9, 40, None, None, 3, 8, 2, 100, 4, 4, None, 30, 6]
    rows = [("A", "d", utc(f"2025-03-03T15:{i:02d}:00"), 1.0, 1.0, 1.0, v, True) for i, v in enumerate(volumes)]
    bars = spark.createDataFrame(rows, "symbol string, session string, ts timestamp, high double, low double, close double, volume bigint, rth boolean")
    for n in (1, 2, 3, 6):
        frame, _ = X.volume_expansion(bars, DetectorSettings(volume_lookback=n))
        assert "percentile" not in frame._jdf.queryExecution().analyzed().toString()
        want = F.percentile("volume", F.lit(0.5)).over(Window.partitionBy("symbol").orderBy("ts").rowsBetween(-n, -1))
        assert all(r._vol_med == r.want for r in frame.withColumn("want", want).collect())
