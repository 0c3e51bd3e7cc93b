import random
from datetime import timedelta

import pytest

from chronotape.streaming import lateness as L
from test_streaming import T0, finish, stream_of

SCHEMA = "symbol string, ts timestamp, arrival_ts timestamp, _file int"


def brute(rows, late_after, window):
    seen = {}
    for symbol, ts, arrival, _ in rows:
        start = None if ts is None else int(ts.timestamp()) // window * window
        n = seen.setdefault((start, symbol), [0, set(), 0])
        n[0] += 1
        n[1].add(ts)
        n[2] += bool(ts and arrival and arrival - ts > timedelta(seconds=late_after))
    return {k: (n, len(bars), n - len(bars), late) for k, (n, bars, late) in seen.items()}


def result(report):
    return {(None if r.window_start is None else int(r.window_start.timestamp()), r.symbol): (r.arrivals, r.bars, r.repeats, r.late)
            for r in report.collect()}


@pytest.mark.parametrize("cuts", [1, 4])
def test_counts_do_not_depend_on_micro_batches(spark, folder, cuts):
    """Days-late bars, repeats across batches, NULL times and NULL symbols; a second start of the stream adds nothing."""
    rnd = random.Random(cuts)
    rows = []
    for i in range(120):
        ts = T0 + timedelta(minutes=rnd.randrange(30))
        delay = rnd.choice([0, 60, 600, 601, 3 * 86_400])
        rows.append((rnd.choice(["A", "A", "B", None]), ts, ts + timedelta(seconds=delay), rnd.randrange(cuts)))
    rows += [("A", None, T0, 0), ("A", T0, None, 0)]
    stream = stream_of(spark, spark.createDataFrame(rows, SCHEMA), folder, cuts)
    for _ in range(2):
        finish(L.count_late_stream(stream, folder + "/out", "r1", folder + "/cp"))
    want = brute(rows, 600, 300)
    assert result(L.lateness_report(L.read_parts(spark, folder + "/out"))) == want
    batch = L.arrival_counts(spark.createDataFrame(rows, SCHEMA), 600, 300)
    assert result(L.lateness_report(batch)) == want


def test_run_id_is_required_and_empty_is_empty(spark, folder):
    empty = spark.createDataFrame([], SCHEMA)
    with pytest.raises(ValueError):
        L.count_late_stream(empty, folder, "", folder)
    assert L.lateness_report(L.arrival_counts(empty, 600, 300)).count() == 0
