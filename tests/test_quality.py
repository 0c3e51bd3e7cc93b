import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from chronotape.operators import quality as Q
from chronotape.operators.slots import with_number, with_previous_by
from chronotape.plans.validation import validate, with_second_run
from chronotape.sources.spine import outside_spine, year_spine
from chronotape.sources.tables import history
from conftest import minute_bars, utc


@pytest.fixture(scope="module")
def clean(spark):
    return minute_bars(spark, [10 + (i % 5) * 0.01 for i in range(390)])


def spine_of(spark):
    return spark.createDataFrame([("ABCD", "2025-03-03"), ("NONE", "2025-03-03")], "symbol string, session string")


def streams(bars, **kw):
    return Q.Streams(bars=bars, quotes=kw.pop("quotes", bars.select("symbol", "session", "seq", "ts", "bid", "ask")), **kw)


def statuses(spark, s, symbol="ABCD", **kw):
    return {r.check: r.status for r in Q.run_checks(spine_of(spark), s, **kw).where(F.col("symbol") == symbol).collect()}


def test_clean_batch(spark, clean):
    got = statuses(spark, streams(clean))
    assert got.pop("corporate_action_sanity") == got.pop("halt_consistency") == "SKIP"
    assert set(got.values()) == {"PASS"} and len(got) == 8
    empty = statuses(spark, streams(clean), "NONE")
    assert empty["completeness"] == "FAIL" and empty["bars_chronology"] == "PASS"


@pytest.mark.parametrize("damage, check", [
    (lambda b: b.withColumn("seq", F.when(F.col("seq") == 10, 11).when(F.col("seq") == 11, 10).otherwise(F.col("seq")).cast("bigint")), "bars_chronology"),
    (lambda b: b.unionByName(b.where("seq = 20").withColumn("seq", F.lit(500).cast("bigint"))), "bars_duplication"),
    (lambda b: b.withColumn("low", F.when(F.col("seq") == 5, 99.0).otherwise(F.col("low"))), "sane_bars"),
    (lambda b: b.withColumn("close", F.when(F.col("seq") == 5, -1.0).otherwise(F.col("close"))), "sane_bars"),
    (lambda b: b.where("seq not between 100 and 104"), "coverage"),
    (lambda b: b.withColumn("ts", F.when(F.col("seq") != 7, F.col("ts"))), "bars_chronology"),
])
def test_faults(spark, clean, damage, check):
    bad = damage(clean)
    assert statuses(spark, streams(bad, quotes=clean))[check] == "FAIL"


def test_quote_faults_and_single_venue(spark, clean):
    crossed = clean.select("symbol", "session", "seq", "ts", F.col("ask").alias("bid"), F.col("bid").alias("ask"))
    assert statuses(spark, streams(clean, quotes=crossed))["sane_quotes"] == "FAIL"
    v = validate(spine_of(spark), streams(clean), consolidated=False)
    assert {r.feed_type for r in v.provenance.collect()} == {"SINGLE_VENUE"}
    assert {r.verdict for r in v.verdicts.collect()} == {"FAIL"}


def test_trades_and_news(spark, clean):
    trades = clean.select("symbol", "session", "seq", "ts", F.col("close").alias("price"), F.col("volume").alias("size"))
    news = spark.createDataFrame([("ABCD", "2025-03-03", 0, "A1", None, None, "v", "s")],
                                 "symbol string, session string, seq bigint, article_id string, news_available_ts timestamp, publish_ts timestamp, vendor string, source string")
    got = statuses(spark, streams(clean, trades=trades, news=news))
    assert got["trades_chronology"] == "PASS" and got["news_provenance"] == "FAIL"


def test_fused_equals_single_checks(spark, clean):
    messy = clean.where("seq % 7 <> 3").withColumn("low", F.when(F.col("seq") % 50 == 0, 99.0).otherwise(F.col("low")))
    messy = messy.unionByName(messy.where("seq in (20, 41)").withColumn("seq", F.col("seq") + 1000))
    spine = spine_of(spark)
    fused = {(r.symbol, r.check): (r.status, r.n, tuple(r.examples)) for r in Q.run_checks(spine, streams(messy)).collect()}
    for single in (Q.chronology(spine, messy, "bars_chronology", chunk_rows=16), Q.coverage(spine, messy), Q.sane_bars(spine, messy)):
        for r in single.collect():
            assert fused[(r.symbol, r.check)] == (r.status, r.n, tuple(r.examples))


def test_same_batch_same_hash(spark, clean):
    a, b = (validate(spine_of(spark), streams(clean), run_id=i).provenance.where("symbol = 'ABCD'").head() for i in ("1", "2"))
    assert a.content_hash == b.content_hash and a.provenance_id != b.provenance_id and a.row_count == 780
    other = clean.withColumn("close", F.when(F.col("seq") == 5, F.col("close") + 1e-6).otherwise(F.col("close")))
    assert validate(spine_of(spark), streams(other)).provenance.where("symbol = 'ABCD'").head().content_hash != a.content_hash


def test_halts_explain_gaps(spark, clean):
    gap = clean.where("seq not between 100 and 110")
    def halts(end):
        return spark.createDataFrame([("ABCD", utc("2025-03-03T16:09:30"), utc(end))], "symbol string, halt_start_ts timestamp, halt_end_ts timestamp")
    ok = Q.halt_consistency(spine_of(spark), gap, halts("2025-03-03T16:20:00")).where("symbol = 'ABCD'").head()
    late = Q.halt_consistency(spine_of(spark), gap, halts("2025-03-03T16:09:00").withColumn("halt_start_ts", F.lit(utc("2025-03-03T16:00:00")))).where("symbol = 'ABCD'").head()
    assert (ok.status, late.status) == ("PASS", "WARN")


def test_year_spine_follows_the_rows(spark):
    rows = spark.createDataFrame([("A", "2019"), ("B", "2021"), ("C", "2030"), ("A", "2019")], "symbol string, session string")
    symbols = rows.where("symbol <> 'C'")
    spine = year_spine(symbols, symbols)
    assert {tuple(r) for r in spine.collect()} == {(s, y) for s in "AB" for y in ("2019", "2020", "2021")}
    assert [tuple(r) for r in outside_spine(spine, rows).collect()] == [("C", "2030", 1)]
    assert year_spine(symbols, rows.limit(0)).count() == 0


def test_manifest_history(spark):
    log = spark.createDataFrame([("r2", 1, "A", "d", "COMMITTED"), ("r1", 9, "A", "d", "STARTED"), ("r1", 1, "B", "d", "STARTED")],
                                "run_id string, seq long, symbol string, session string, event_type string")
    got = {(r.symbol, r.step): r.event_type for r in history(log).collect()}
    assert got == {("A", 1): "STARTED", ("A", 2): "COMMITTED", ("B", 1): "STARTED"}


def test_feeds_decide_consolidation(spark, clean):
    feeds = spark.createDataFrame([("SIP", True), ("VENUE", False)], "vendor string, consolidated boolean")
    run = validate(spine_of(spark), streams(clean), vendor="VENUE", feeds=feeds)
    assert run.provenance.where("symbol = 'ABCD'").head().feed_type == "SINGLE_VENUE"
    served = spark.createDataFrame([("ABCD", "2025-03-03", v) for v in ("SIP", "SIP", "VENUE", "OTHER")],
                                   "symbol string, session string, vendor string")
    both = {r.symbol: (r.status, r.n) for r in Q.consolidation_by_feed(spine_of(spark), served, feeds).collect()}
    assert both == {"ABCD": ("FAIL", 2), "NONE": ("FAIL", 0)}
    good = Q.consolidation_by_feed(spine_of(spark), served.where("vendor = 'SIP'"), feeds).where("symbol = 'ABCD'").head()
    assert (good.status, good.n) == ("PASS", 0)


def test_second_run_shares_the_work_of_the_first(spark, clean):
    twice = clean.unionByName(clean.withColumn("symbol", F.lit("HOLE")).where("seq not between 100 and 104"))
    spine = spine_of(spark).unionByName(spine_of(spark).where("symbol = 'ABCD'").withColumn("symbol", F.lit("HOLE")))
    first = validate(spine, streams(twice), run_id="run")
    apart = first.provenance.unionByName(
        validate(first.verdicts.where("verdict <> 'PASS'").select("symbol", "session"), streams(twice), run_id="again").provenance)
    together = with_second_run(validate(spine, streams(twice), run_id="run"), "again", F.col("verdict") != "PASS")
    rows = lambda df: sorted(tuple(r) for r in df.drop("fetch_ts").collect())
    assert rows(together) == rows(apart) and len(rows(apart)) > first.verdicts.count()


def test_short_batches_need_no_numbers(spark, clean, monkeypatch):
    """A batch within one hash chunk is neither numbered nor chunked; a longer one gives the hashes it always gave."""
    rows = clean.where("symbol = 'ABCD'")
    short = Q.stream_hash(rows, ["ts", "close"], "bars").head()
    numbered = []
    monkeypatch.setattr(Q, "with_number", lambda *a: numbered.append(1) or with_number(*a))
    assert Q.stream_hash(rows, ["ts", "close"], "bars", longest=Q.HASH_CHUNK_ROWS + 1).head() == short and numbered
    numbered.clear()
    assert Q.stream_hash(rows, ["ts", "close"], "bars").head() == short and not numbered


def test_previous_by_is_the_same_with_and_without_chunks(spark):
    df = spark.range(500).selectExpr("concat('k', id % 3) k", "(id * 37) % 500 seq", "id v")
    order = Window.partitionBy("k").orderBy("seq")
    want = sorted(map(tuple, df.withColumn("p", F.lag("v").over(order)).collect()), key=str)
    for rows in (1000, 16):
        got = with_previous_by(df, ["k"], "seq", ["v"], rows)
        assert sorted(map(tuple, got.collect()), key=str) == want
