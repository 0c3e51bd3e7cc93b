import random
from datetime import timedelta

from pyspark.sql import functions as F

from chronotape import schemas as S
from chronotape.functions.rules import label_of, same_map
from chronotape.operators import features as E
from chronotape.operators import lifecycle as L
from chronotape.operators import news as N
from conftest import minute_bars, utc

T0 = utc("2025-03-03T15:00:00")


def articles(spark, rows):
    full = [(a, v, v, t, h, when, when, "en", raw, i) for i, (a, v, t, h, when, raw) in enumerate(rows)]
    return spark.createDataFrame(full, S.ARTICLES)


def test_duplicate_kinds(spark):
    a = articles(spark, [("A1", "v1", ["abcd"], "ABCD update", T0, "x"), ("A1", "v1", ["abcd"], "ABCD update", T0, "x"),
                         ("A2", "v1", ["abcd"], "other", T0, "x"),
                         ("B9", "v2", ["abcd"], "ABCD  Update", T0 + timedelta(minutes=12), "y")])
    records = N.build_records(a)
    got = {r.seq: (r.dup_kind, r.duplicate_of) for r in N.link_duplicates(records).collect()}
    first = {r.seq: r.record_id for r in records.collect()}[0]
    assert got == {0: (None, None), 1: ("EXACT", first), 2: ("CONTENT", first), 3: ("STORY", first)}
    # Linking in two steps, the second against the stored archive, gives the same links.
    head = N.link_duplicates(records.where("seq < 2"))
    tail = N.link_duplicates(records.where("seq >= 2"), head)
    assert {r.seq: (r.dup_kind, r.duplicate_of) for r in head.unionByName(tail).collect()} == got
    assert N.archive_as_of(head, "ABCD", "2025-03-03T14:00:00+00:00").count() == 0


def test_story_links_match_brute_force(spark):
    rnd = random.Random(11)
    rows = [(f"N{i}", f"v{i}", rnd.sample(["a", "b", "c", "d"], rnd.choice([1, 2])), rnd.choice(["hot", "hot", "h1", "h2"]),
             T0 + timedelta(seconds=rnd.randrange(0, 6 * 3600, 300)), f"raw{i}") for i in range(250)]
    got = {r.seq: r.duplicate_of for r in N.link_duplicates(N.build_records(articles(spark, rows))).collect()}
    ids = {r.seq: r.record_id for r in N.build_records(articles(spark, rows)).collect()}
    for i, (_, _, t, h, when, _) in enumerate(rows):
        want = next((j for j in range(i) if rows[j][3] == h and set(rows[j][2]) & set(t)
                     and abs((rows[j][4] - when).total_seconds()) <= 3600), None)
        assert got[i] == (None if want is None else ids[want])


def test_gate(spark):
    bars = minute_bars(spark, [10 + 0.1 * i for i in range(30)])
    cases = bars.where("seq in (10, 15, 20)").select(F.col("seq").cast("string").alias("case_id"), "symbol", "session", F.col("ts").alias("signal_ts"))
    runs = {r.feature_name: r for r in E.gate({"ok": ("1", E.trailing_return, 5), "peek": ("1", E.last_close, 0)}, cases, bars).collect()}
    assert (runs["ok"].verdict, runs["peek"].verdict, runs["peek"].failures) == ("PASS", "FAIL", 3)
    last = bars.where("seq = 29").select(F.lit("z").alias("case_id"), "symbol", "session", F.col("ts").alias("signal_ts"))
    only = E.gate({"ok": ("1", E.trailing_return, 0)}, last, bars).head()
    assert (only.verdict, only.remediation) == ("UNKNOWN", "NEW_TEST_PACK")


def test_map_features_compare(spark):
    df = spark.sql("select map('a', 1.0D) x, map('a', 1.0D + 1e-12) y, map('a', 2.0D) z, map('b', 1.0D) w")
    r = df.select(same_map(F.col("x"), F.col("y")), same_map(F.col("x"), F.col("z")), same_map(F.col("x"), F.col("w"))).head()
    assert tuple(r) == (True, False, False)


def test_admission(spark):
    gate = spark.createDataFrame([("R1", "PASS"), ("R2", "FAIL"), ("R3", "UNKNOWN")], "pit_run_id string, verdict string")
    rows = [("f", "n", "1", "ref", "R1", "why", "PRICE_STATE", 5, False), ("f", "n", "1", "ref", "R1", "why", "PRICE_STATE", 5, False),
            ("g", "n", "1", "ref", "R1", "", "PRICE_STATE", 5, False), ("h", "n", "1", "ref", "R2", "why", "PRICE_STATE", 5, False),
            ("i", "n", "1", "ref", "R3", "why", "PRICE_STATE", 5, False), ("j", "n", "1", "ref", "R1", "why", "EXECUTION_STATE", 5, False),
            ("k", "n", "1", "ref", "R1", "why", "SEQUENCE_STATE", 5, False), ("l", "n", "1", "ref", "R1", "why", "SEQUENCE_STATE", 5, True),
            ("m", "n", "1", "ref", "R9", "why", "CUSTOM", -1, True)]
    defs = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], S.FEATURE_DEFS)
    got = {r.seq: (r.reject_code, r.reject_about) for r in L.admit_features(defs, gate).collect()}
    assert got[0] == got[7] == (None, None)
    assert [got[i] for i in (1, 2, 3, 4)] == [
        ("TAKEN", "1"), ("EMPTY_FIELD", "economic_rationale"), ("PROOF", "FAIL"), ("PROOF", "UNKNOWN")]
    assert [got[i][0] for i in (5, 6, 8)] == ["OUTCOME_SIDE", "NOT_CROSS_ROW", "LOOKBACK"]


def test_lifecycle_chunks_agree(spark):
    rows = [("H", i, s) for i, s in enumerate(["TESTING", "OOS_FAIL", "REJECTED", "TESTING"])]
    rnd = random.Random(5)
    rows += [("X", i, rnd.choice(list(L.HYPOTHESIS_MOVES))) for i in range(40)]
    df = spark.createDataFrame(rows, "id string, seq bigint, to_state string")
    frames = [sorted(map(tuple, L.replay(df, ["id"], L.HYPOTHESIS_MOVES, "REGISTERED", n).collect())) for n in (2, 7, 1024)]
    assert frames[0] == frames[1] == frames[2]
    assert [r[-1] for r in frames[0] if r[0] == "H"] == [True, True, True, False]
    final = {r.id: (r.state, r.refused) for r in L.current_states(df, ["id"], L.HYPOTHESIS_MOVES, "REGISTERED").collect()}
    assert final["H"] == ("REJECTED", 1)
    exp = spark.createDataFrame([("e1", "H", "oos"), ("e2", "H", "VAULT"), ("e3", "X", "train")], "experiment_id string, hypothesis_id string, dataset string")
    assert L.family_size(exp).head()[0] == 1


def test_labels(spark):
    df = spark.createDataFrame([("PROFIT", 0.1), ("STOP", -0.1), ("TIME", -0.02)], "b string, r double")
    get = lambda enc: [x[0] for x in df.select(label_of(F.col("b"), F.col("r"), enc)).collect()]
    assert get("TERNARY_ZERO") == [1, -1, 0] and get("SIGN_RETURN") == [1, -1, -1]


def test_gate_reads_the_bars_once_for_all_folds(spark, folder):
    bars = minute_bars(spark, [10 + i % 7 for i in range(60)])
    bars.write.parquet(folder + "/bars")
    bars = spark.read.parquet(folder + "/bars")
    cases = spark.createDataFrame([(str(i), "ABCD", "2025-03-03", utc("2025-03-03T14:45:00") + timedelta(minutes=i)) for i in (0, 9)], S.PIT_CASES)
    many = {f"f{i}": ("1", E.Fold(lambda i=i: F.max(F.col("close") + i)), 0) for i in range(6)}
    plan = E.gate(many, cases, bars)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 1
    # A frame function and a fold of the same meaning agree; a case without bars counts as a case.
    more = cases.unionByName(spark.createDataFrame([("none", "ZZ", "2025-03-03", utc("2025-03-03T14:45:00"))], S.PIT_CASES))
    runs = {r.feature_name: r for r in E.gate({"a": ("1", E.last_close, 0), "b": ("1", lambda f: E.last_close(f), 0),
                                               "c": ("1", E.trailing_return, 3)}, more, bars).collect()}
    assert (runs["a"].verdict, runs["a"].failures, runs["a"].n_cases) == (runs["b"].verdict, runs["b"].failures, runs["b"].n_cases)
    assert (runs["a"].verdict, runs["c"].verdict, runs["c"].n_cases) == ("FAIL", "PASS", 3)
