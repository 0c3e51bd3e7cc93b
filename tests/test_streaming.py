import random
from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from chronotape.operators import barriers as B
from chronotape.operators import news as N
from chronotape.operators.asof import asof_join
from chronotape.streaming import jobs as J
from chronotape.streaming.outcomes import forward_outcomes
from conftest import utc
from test_news_features import articles

T0 = utc("2025-03-03T15:00:00")


def stream_of(spark, df, folder, files):
    """A file stream over `df`, one micro-batch per value of `_file` in order."""
    for i in range(files):
        df.where(F.col("_file") == i).drop("_file").coalesce(1).write.mode("append").parquet(folder + "/in")
    return spark.readStream.schema(df.drop("_file").schema).option("maxFilesPerTrigger", 1).parquet(folder + "/in")


def finish(writer, checkpoint=None):
    q = writer.start()
    q.processAllAvailable()
    q.stop()


def test_bar_quality_and_distinct(spark, folder):
    rows = [("A", T0 + timedelta(minutes=m), f) for m, f in ((0, 0), (0, 0), (1, 0), (2, 1), (40, 1), (41, 1))]
    df = spark.createDataFrame(rows, "symbol string, ts timestamp, _file int")
    s = stream_of(spark, df, folder, 2)
    finish(J.distinct_bars(s).writeStream.format("memory").queryName("d1").outputMode("append"))
    assert spark.table("d1").count() == 5
    finish(J.bar_quality(s).writeStream.format("memory").queryName("q1").outputMode("complete"))
    assert spark.table("q1").agg(F.sum("repeats")).head()[0] == 1


def test_append_once(spark, folder):
    df = spark.createDataFrame([("a", 1, 0), ("b", 2, 0), ("a", 3, 1), ("c", 4, 1)], "k string, v int, _file int")
    for run in ("1", "2"):
        finish(J.append_once_stream(stream_of(spark, df, folder, 2) if run == "1" else spark.readStream.schema("k string, v int").parquet(folder + "/in"),
                                    folder + "/out", "k string, v int", ["k"], ["v"], folder + "/cp" + run))
    assert sorted(r.k for r in spark.read.parquet(folder + "/out").collect()) == ["a", "b", "c"]


def test_news_links_equal_batch(spark, folder):
    a = articles(spark, [("A1", "v1", ["abcd"], "ABCD update", T0, "x"), ("A1", "v1", ["abcd"], "ABCD update", T0, "x"),
                         ("A2", "v1", ["abcd"], "other", T0, "x"), ("B9", "v2", ["abcd"], "ABCD update", T0 + timedelta(minutes=12), "y")])
    records = N.build_records(a)
    s = stream_of(spark, records.withColumn("_file", (F.col("seq") >= 2).cast("int")), folder, 2)
    finish(J.link_news_stream(s, folder + "/archive", folder + "/cp"))
    got = {r.seq: (r.dup_kind, r.duplicate_of) for r in spark.read.parquet(folder + "/archive").collect()}
    assert got == {r.seq: (r.dup_kind, r.duplicate_of) for r in N.link_duplicates(records).collect()}


def test_enrichment_equals_batch(spark, folder):
    sig = spark.createDataFrame([("A", T0 + timedelta(minutes=m), int(m > 5)) for m in range(10)], "symbol string, ts timestamp, _file int")
    ver = spark.createDataFrame([("A", T0 + timedelta(minutes=m), f"v{m}") for m in (2, 6)], "symbol string, valid_from timestamp, vid string")
    out = J.enrich_as_of(stream_of(spark, sig, folder, 2), ver, ["symbol"], "ts", "valid_from", ["vid"])
    finish(out.writeStream.format("memory").queryName("e1").outputMode("append"))
    want = asof_join(sig.drop("_file"), ver, ["symbol"], "ts", "valid_from", ["vid"])
    assert sorted(map(tuple, spark.table("e1").collect()), key=str) == sorted(map(tuple, want.collect()), key=str)


@pytest.mark.parametrize("cuts", [1, 4])
def test_forward_outcomes_equal_batch_for_any_cut(spark, folder, cuts):
    """Rows out of order inside the watermark, several sessions, a close before the horizon and an entry without a path."""
    rnd = random.Random(cuts)
    rows = []
    for symbol, session, start, minutes in (("A", "d1", 0, 60), ("A", "d2", 24 * 60, 40), ("B", "d1", 0, 60)):
        price, close_at = 10.0, T0 + timedelta(minutes=start + minutes - 8)
        for m in range(start, start + minutes):
            price += rnd.gauss(0, 0.25)
            entry = rnd.random() < 0.3 or m == start + minutes - 8
            rows.append((symbol, session, close_at, T0 + timedelta(minutes=m), price, price + 0.1, price - 0.1, 1.0 if entry else None))
    order = sorted(range(len(rows)), key=lambda i: (rows[i][3], rnd.random()))
    shuffled = sorted(order, key=lambda i: rows[i][3].timestamp() + rnd.uniform(0, 280))
    size = -(-len(rows) // cuts)
    data = [(*rows[i], n // size) for n, i in enumerate(shuffled)]
    # Later rows of another symbol move the watermark past every session.
    data += [("Z", "d9", T0 + timedelta(days=9), T0 + timedelta(days=5, minutes=n), 9.0, 9.0, 9.0, None, cuts + n) for n in range(2)]
    df = spark.createDataFrame(data, "symbol string, session string, session_close timestamp, ts timestamp, close double, high double, "
                                     "low double, atr double, _file int")
    out = forward_outcomes(stream_of(spark, df, folder, cuts + 2), 1.0, 15)
    finish(out.writeStream.format("memory").queryName(f"f{cuts}").outputMode("append"))
    got = sorted((r.symbol, r.session, r.entry_ts, r.barrier, r.ttr, round(r.realized_return, 9)) for r in spark.table(f"f{cuts}").collect())
    entries = df.where("atr is not null").select("symbol", "session", F.col("ts").alias("entry_ts"), "session_close",
                                                 F.col("close").alias("ref"), F.lit(0.1).alias("spread"), "atr")
    want = B.outcomes(B.first_touches(entries, df.drop("_file"), B.Grid((1.0,), (15,)))).collect()
    assert got == sorted((r.symbol, r.session, r.entry_ts, r.barrier, r.ttr, round(r.realized_return, 9)) for r in want)
    assert {r[3] for r in got} == {"PROFIT", "STOP", "TIME"} and len({r[:2] for r in got}) == 3
