import random
from datetime import timedelta

from pyspark.sql import functions as F

import pytest

from chronotape.operators.asof import Highest, Latest, Total, asof_fold, asof_index, asof_join
from chronotape.operators.slices import equal_depth
from chronotape.operators import lifecycle
from chronotape.operators.slots import with_chunk, with_number, with_previous, with_running_count
from chronotape.operators.stats import describe, exact_median
from conftest import utc

T0 = utc("2025-01-01T00:00:00")


def make(spark, seed=1, n=400):
    rnd = random.Random(seed)
    key = lambda: "HOT" if rnd.random() < 0.5 else rnd.choice("ABC")
    left = [(i, key(), T0 + timedelta(hours=rnd.randrange(0, 24 * 40))) for i in range(n)]
    right, seen = [], set()
    for i in range(n):
        k, t = key(), T0 + timedelta(hours=rnd.choice([rnd.randrange(0, 240), rnd.randrange(700, 960)]))
        if (k, t) not in seen:
            seen.add((k, t))
            right.append((k, t, i))
    return left, right, (spark.createDataFrame(left, "id int, k string, t timestamp"),
                         spark.createDataFrame(right, "k string, rt timestamp, v int"))


def brute(left, right, strict=False):
    out = {}
    for i, k, t in left:
        hits = [(rt, v) for rk, rt, v in right if rk == k and (rt < t if strict else rt <= t)]
        out[i] = (max(hits)[1] if hits else None, max((v for _, v in hits), default=None), len(hits))
    return out


@pytest.mark.parametrize("goal", [None, 7, 40])
def test_folds_match_brute_force_at_any_depth(spark, goal):
    left, right, (l, r) = make(spark)
    for strict in (False, True):
        got = asof_fold(l, r, ["k"], "t", "rt", {"a": Latest(("v",)), "b": Highest(F.col("v")),
                                                 "c": Total(F.lit(1).cast("bigint"))}, strict=strict, max_rows=goal)
        rows = {x.id: (x.a.v if x.a else None, x.b, x.c) for x in got.collect()}
        assert rows == brute(left, right, strict)


def test_forms_agree(spark):
    _, _, (l, r) = make(spark, 2)
    a = asof_join(l, r, ["k"], "t", "rt", ["v"]).collect()
    b = asof_index(r, ["k"], "rt", ["v"]).lookup(l, "t", ["v"]).collect()
    c = asof_index(r, ["k"], "rt", ["v"], max_rows=5).lookup(l, "t", ["v"]).collect()
    l.createOrReplaceTempView("l")
    r.createOrReplaceTempView("r")
    d = spark.sql("select l.*, x.v from l left join lateral (select v from r where r.k = l.k and r.rt <= l.t "
                  "order by rt desc limit 1) x").collect()
    assert sorted(map(tuple, a), key=str) == sorted(map(tuple, b), key=str) == sorted(map(tuple, c), key=str) \
        == sorted(map(tuple, d), key=str)


def test_no_keys_ties_and_nulls(spark):
    l = spark.createDataFrame([(1, None, T0), (2, "A", T0), (3, "A", T0 - timedelta(days=9))], "id int, k string, t timestamp")
    r = spark.createDataFrame([("A", T0, 1), ("A", T0, 2), (None, T0, 7)], "k string, rt timestamp, v int")
    got = {x.id: x.v for x in asof_join(l, r, ["k"], "t", "rt", ["v"], tie=["v"]).collect()}
    assert got == {1: None, 2: 2, 3: None}
    for goal in (None, 1):
        everyone = asof_join(l, r.where("k = 'A'"), [], "t", "rt", ["v"], tie=["v"], max_rows=goal).collect()
        assert {x.id: x.v for x in everyone} == {1: 2, 2: 2, 3: None}
    index = asof_index(r.where("k = 'A'"), [], "rt", ["v"], tie=["v"], max_rows=1)
    assert {x.id: x.v for x in index.lookup(l, "t", ["v"]).collect()} == {1: 2, 2: 2, 3: None}


def test_chunked_previous_and_count(spark):
    """Sparse and negative ordinals; chunks follow the rows."""
    rnd = random.Random(8)
    at = sorted(rnd.sample(range(-10 ** 12, 10 ** 15), 300))
    df = spark.createDataFrame([("A", t, i * i) for i, t in enumerate(at)] + [("B", 7, 1)], "k string, seq bigint, v bigint")
    chunked = with_chunk(df, ["k"], "seq", 20, "c")
    per_chunk = chunked.where("k = 'A'").groupBy("c").count().collect()
    assert len(per_chunk) >= 300 // 40 and max(r["count"] for r in per_chunk) <= 40
    seen = with_previous(chunked, ["k"], F.col("c"), ["seq"], ["v"])
    assert {(x.k, x.seq): x.prev_v for x in seen.collect()} == {
        **{("A", t): (None if i == 0 else (i - 1) ** 2) for i, t in enumerate(at)}, ("B", 7): None}
    counted = with_running_count(chunked, ["k"], F.col("c"), ["seq"], F.col("v") % 2 == 0, "n")
    assert {x.seq: x.n for x in counted.where("k = 'A'").collect()} == {t: i // 2 + 1 for i, t in enumerate(at)}
    for rows in (20, 65_536):
        got = with_number(df, ["k"], ["seq"], "n", rows).collect()
        assert {(x.k, x.seq): x.n for x in got} == {**{("A", t): i for i, t in enumerate(at)}, ("B", 7): 0}


def test_replay_of_a_long_sparse_log(spark, monkeypatch):
    """Maps over several levels, against a plain fold."""
    monkeypatch.setattr(lifecycle, "FAN", 3)
    rnd = random.Random(12)
    moves = {"a": ("b", "c"), "b": ("a", "c"), "c": ("a",)}
    log = {"HOT": sorted(rnd.sample(range(10 ** 14), 400)), "x": [5]}
    events = [(k, t, rnd.choice("abc")) for k, ts in log.items() for t in ts]
    want, state = {}, {}
    for k, t, to in events:
        now = state.get(k, "a")
        state[k] = to if to in moves[now] else now
        want[k, t] = (now, state[k] != now)
    df = spark.createDataFrame(events, "k string, seq bigint, to_state string")
    got = lifecycle.replay(df, ["k"], moves, "a", chunk_events=10).collect()
    assert {(r.k, r.seq): (r.from_state, r.legal) for r in got} == want and len(got) == len(events)


def test_exact_median(spark):
    rnd = random.Random(3)
    rows = [("x", rnd.random()) for _ in range(3001)] + [("y", float(rnd.randrange(3))) for _ in range(1000)] + [("z", 4.0)]
    df = spark.createDataFrame(rows, "k string, v double")
    import statistics
    want = {k: statistics.median(v for kk, v in rows if kk == k) for k in "xyz"}
    for small in (65_536, 100):
        assert {r.k: r.median for r in exact_median(df, ["k"], F.col("v"), small=small).collect()} == want
    assert exact_median(df, [], F.col("v"), small=50).head().median == statistics.median(v for _, v in rows)
    # Weights far from the middle of the distinct values, infinities and a NULL group.
    odd = [(None, float(i)) for i in range(400)] + [(None, -5.0)] * 5000 + [("q", 1e300), ("q", -1e300), ("q", 0.0), ("q", 5e-324)]
    got = {r.k: r.median for r in exact_median(spark.createDataFrame(odd, "k string, v double"), ["k"], F.col("v"), small=3).collect()}
    assert got == {None: -5.0, "q": statistics.median([1e300, -1e300, 0.0, 5e-324])}
    assert describe(df, [], "v").head().median == statistics.median(v for _, v in rows)
    empty = describe(df.where("v > 99"), [], "v").head()
    assert (empty["count"], empty.median) == (0, None)


def test_no_slice_is_deeper_than_the_goal(spark):
    """One key, one day and one instant that hold nearly all rows; a rare key stays whole."""
    rnd = random.Random(6)
    minute = lambda m: T0 + timedelta(minutes=m)
    left = ([(i, "HOT", minute(500)) for i in range(3000)] + [(3000 + i, "HOT", minute(rnd.randrange(1440))) for i in range(1500)]
            + [(5000 + i, "HOT", minute(rnd.randrange(1440 * 300))) for i in range(100)] + [(6000 + i, "B", minute(i)) for i in range(20)]
            + [(7000, None, minute(1)), (7001, "HOT", None)])
    right = [("HOT", minute(rnd.randrange(1440)), i) for i in range(900)] + [("HOT", minute(500), 1000 + i) for i in range(900)] + [("B", minute(3), 9)]
    l = spark.createDataFrame(left, "id int, k string, t timestamp")
    r = spark.createDataFrame(right, "k string, rt timestamp, v int")
    goal = 200
    for by in (["k"], []):
        slices = equal_depth([(l, F.unix_micros("t")), (r, F.unix_micros("rt"))], by, max_rows=goal)
        depth = slices.place(l, F.unix_micros("t")).groupBy(*by, "_slice").count().agg(F.max("count")).head()[0]
        assert depth <= 2.5 * goal
    for strict in (False, True):
        out = asof_join(l, r, ["k"], "t", "rt", ["v"], tie=["v"], strict=strict, max_rows=goal).collect()
        by_key = {}
        for k, t, v in right:
            by_key.setdefault(k, []).append((t, v))
        want = {i: max(((rt, v) for rt, v in by_key.get(k, []) if t is not None and (rt < t if strict else rt <= t)),
                       default=(None, None))[1] for i, k, t in left}
        assert {x.id: x.v for x in out} == want and len(out) == len(left)
        index = asof_index(r, ["k"], "rt", ["v"], tie=["v"], max_rows=50)
        assert {x.id: x.v for x in index.lookup(l, "t", ["v"], strict=strict).collect()} == want


def test_plans_have_no_nested_loop(spark):
    _, _, (l, r) = make(spark)
    plans = [asof_join(l, r, [], "t", "rt", ["v"], max_rows=50), asof_index(r, [], "rt", ["v"], max_rows=50).lookup(l, "t", ["v"])]
    for df in plans:
        text = df._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in text and "CartesianProduct" not in text
