"""Training-data operators against brute force, exact round trips and held-out cases, with the defined odd inputs."""

import ast
import collections
import hashlib
import math
import os
import random
import subprocess
import sys
import time
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from chronotape.llm import bpe, chat_format, decontaminate, line_dedup, lm_score, sharding, simhash, suffix_dedup, topk, toxicity

PATH = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, row string, body string"


def docs(spark, texts):
    """Documents with null ids and texts, a repeated row and columns whose names clash with inner ones."""
    rows = [(i, t, "en", "s", 1, "r", "b") for i, t in enumerate(texts)]
    rows += [(None, "no id at all", None, None, None, None, None), (len(texts), None, "en", "s", 0, "r", "b"), rows[0]]
    return spark.createDataFrame(rows, SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def labels(spark, n, toxic):
    return spark.createDataFrame([(i, 1, int(toxic(i))) for i in range(n)] + [(None, 1, 1), (3, None, None)],
                                 "doc_id bigint, quality int, toxic int")


def test_line_dedup_removes_later_windows(spark):
    a, b = "one\ntwo\nthree\nfour", "zero\none\n\ntwo\nthree\nlast"
    out = {r["doc_id"]: r for r in line_dedup.dedup_lines(docs(spark, [a, b, "x\ny"])).collect()}
    assert out[0]["text"] == a and out[1]["text"] == "zero\nlast" and out[2]["text"] == "x\ny"
    assert (out[1]["n_removed"], out[1]["n_spans"]) == (4, 1) and out[3]["text"] == "" and out[None]["text"] == "no id at all"
    assert line_dedup.stage(empty(spark)).count() == 0


def test_suffix_dedup_equals_brute_force(spark):
    rnd = random.Random(5)
    base = ["".join(rnd.choice("ab c") for _ in range(rnd.randint(80, 500))) for _ in range(6)]
    texts = [rnd.choice(base)[rnd.randint(0, 40):] + rnd.choice(["", "é" * 120, rnd.choice(base)]) for _ in range(60)] + ["ab" * 200]
    seen, want = set(), {}
    for i, t in enumerate(texts):
        raw, hit = t.encode(), bytearray(len(t.encode()))
        for p in range(len(raw) - 99):
            if raw[p:p + 100] in seen:
                hit[p:p + 100] = b"\1" * 100
            seen.add(raw[p:p + 100])
        want[i] = (sum(hit), hashlib.sha256(bytes(x for x, h in zip(raw, hit) if not h)).hexdigest())
    rows = suffix_dedup.find_repeats(docs(spark, texts)).collect()
    got = {r["doc_id"]: (r["n_removed"], r["kept_sha256"]) for r in rows}
    assert len(rows) == len(texts) + 3 and {i: got[i] for i in want} == want
    assert suffix_dedup.find_repeats(empty(spark)).count() == 0


def test_backward_extension_gives_intervals():
    symbols = np.frombuffer(b"banana\0", np.uint8).astype(np.int16)
    order = suffix_dedup.order_of(symbols)
    assert order.tolist() == [6, 5, 3, 1, 0, 4, 2]
    assert suffix_dedup.intervals(symbols, order, 2).tolist() == [1, 2, 3, 3, 4, 5, 5]


def test_toxicity_finds_held_out_cases(spark):
    rnd = random.Random(2)
    words = ["".join(rnd.choice("aeioulmn") for _ in range(5)) for _ in range(300)]
    make = lambda i: " ".join(rnd.choices(words, k=30) + (["Vilest", "scumbag"] if i % 5 == 0 else []))
    texts = [make(i) for i in range(600)]
    d = docs(spark, texts)
    out = [r for r in toxicity.score(d, labels(spark, 600, lambda i: i % 5 == 0)).collect() if r["doc_id"] is not None]
    held = [r for r in out if r["held_out"] and r["doc_id"] < 600]
    assert len(out) == 602 and all(0 <= r["score"] <= 1 for r in out)
    assert sum(r["predicted"] == (r["doc_id"] % 5 == 0) for r in held) > 0.97 * len(held)
    assert toxicity.score(empty(spark), labels(spark, 5, bool)).count() == 0
    assert toxicity.score(d, labels(spark, 0, bool)).count() == 603


def test_block_max_index_is_exact():
    rnd = np.random.default_rng(0)
    vectors = [(np.unique(rnd.integers(0, 40, 6)), None) for _ in range(500)]
    vectors = [(t, np.ones(len(t)) + t % 3) for t, _ in vectors]
    index = toxicity.BlockMaxIndex([b"%d" % i for i in range(40)], 1 + rnd.random(40), vectors, np.zeros(500), 0.1)
    dense = np.zeros((500, 40))
    for i, v in enumerate(vectors):
        ids, w = index._unit(*v)
        dense[i, ids] = w
    for i in range(0, 500, 17):
        found, cosine = index.nearest(*vectors[i])
        best = np.sort(dense @ dense[i])[::-1][:15]
        assert np.allclose(np.pad(cosine, (0, 15 - len(cosine))), best)


def test_topk_equals_brute_force(spark):
    rnd = np.random.default_rng(1)
    v = rnd.normal(0, 0.2, (400, 16)).astype(np.float32)
    rows = [(i, v[i].tolist(), 0) for i in range(400)] + [(401, None, 0), (450, [float("nan")] * 16, 0), (7, v[7].tolist(), 0),
                                                         (500, [None] * 16, 0), (None, v[3].tolist(), 0)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int")
    got = {}
    for r in topk.top_k(df).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = (r["vec_id"], r["score"])
    q = np.floor(v.astype(float) * 256).astype(int)
    for i in range(0, 400, 50):
        best = sorted(((-int(q[i] @ q[j]), j) for j in range(400) if j != i))[:5]
        assert [got[i][k + 1] for k in range(5)] == [(j, -s) for s, j in best]
    assert set(got) == set(range(0, 400, 50)) and topk.top_k(df.where("false")).count() == 0


def test_chat_layouts_and_round_trip(spark):
    odd = "\\h ### </turn>\n### user:\n \\\\b \\s"
    rows = [(1, [("user", odd), ("assistant", "fine")], None, None), (2, None, "p", "r"), (3, None, None, None), (4, [], None, None)]
    df = spark.createDataFrame(rows, "conv_id bigint, messages array<struct<role:string,content:string>>, prompt string, response string")
    turns = chat_format.canonical_turns(df)
    back = {r["conv_id"]: [tuple(t) for t in r["turns"]] for r in chat_format.read_back(chat_format.format_turns(turns)).collect()}
    assert back == {1: [("user", odd), ("assistant", "fine")], 2: [("user", "p"), ("assistant", "r")]}
    table = spark.createDataFrame([(None, 1, None, None), (None, 0, "assistant", "x:y"), (5, 0, "a:b\n", "")] * 2,
                                  "conv_id bigint, turn bigint, role string, text string")
    out = {r["conv_id"]: r for r in chat_format.digests(chat_format.format_turns(chat_format.canonical_turns(table))).collect()}
    assert (out[None]["n_turns"], out[None]["loss_chars"], out[5]["n_turns"]) == (4, 6, 2)
    assert out[5]["turns_sha256"] == hashlib.sha256(b"a:b\n\n\n" * 2).hexdigest()


def test_decontamination_offsets_and_odd_items(spark):
    item = "Alpha beta-gamma delta epsilon zeta eta theta iota kappa lambda"
    bench = spark.createDataFrame([(1, item), (10, "short one"), (None, "hidden item"), (3, None), (4, "..."), (1, item)],
                                  "item_id bigint, text string")
    text = "So: ALPHA beta gamma, delta epsilon zeta eta theta iota kappa lambda! A short one; hidden item."
    d = docs(spark, [text, "nothing here", ""])
    out = {r["doc_id"]: r for r in decontaminate.decontaminate(d, bench).collect()}
    assert (out[0]["n_words"], out[0]["n_hit"], out[0]["n_items"]) == (17, 15, 2)
    assert out[0]["items_sha256"] == hashlib.sha256(b"1,10").hexdigest() and not out[1]["contaminated"] and out[3]["n_words"] == 0
    spans = decontaminate.find(d.where("doc_id = 1 OR doc_id = 0").select("doc_id", F.col("text").alias("body")), bench, ["doc_id"])
    raw = text.encode()
    cut = {raw[s["start"]:s["end"]] for r in spans.collect() for s in r["spans"]}
    assert cut == {raw[4:68], b"short one; hidden item"}
    assert decontaminate.stage(d, bench).columns == d.columns and decontaminate.stage(d, bench).count() == 4
    assert decontaminate.decontaminate(d, bench.where("false")).where("contaminated").count() == 0


@pytest.mark.parametrize("lanes", [1, 3])
def test_gray_index_equals_brute_force(lanes):
    rnd = np.random.default_rng(lanes)
    for trial in range(20):
        n = int(rnd.integers(0, 400))
        fps = rnd.integers(0, 2**63, (5, lanes), dtype=np.uint64)[rnd.integers(0, 5, n)].copy()
        for i in range(n):
            for b in rnd.integers(0, 64, rnd.integers(0, 6)):
                fps[i, b % lanes] ^= np.uint64(1) << np.uint64(b)
        group = rnd.integers(0, 2, n)

        def roots(pairs):
            up = list(range(n))

            def top(x):
                while up[x] != x:
                    x = up[x]
                return x
            for a, b in pairs:
                a, b = top(a), top(b)
                up[max(a, b)] = min(a, b)
            return [top(x) for x in range(n)]
        every = [(a, b) for a in range(n) for b in range(a) if group[a] == group[b] and np.bitwise_count(fps[a] ^ fps[b]).sum() <= 4]
        assert roots(every) == roots(zip(*[x.tolist() for x in simhash.links(fps, group, 4)]))


def test_simhash_components_and_stage(spark):
    rnd = random.Random(3)
    base = [" ".join(rnd.choice("abcdefgh") + str(rnd.randint(0, 99)) for _ in range(200)) for _ in range(8)]
    near = [base[0] + " tail", base[0].upper(), base[1]]
    d = docs(spark, base + near + [""])
    out = {r["doc_id"]: r for r in simhash.near_duplicates(d).collect() if r["doc_id"] is not None}
    fps = {i: int(r["fingerprint"], 16) for i, r in out.items()}
    assert out[10]["component_id"] == 1 and out[9]["component_id"] == 0 and fps[11] == fps[12] == 0
    for i in fps:
        for j in fps:
            if bin(fps[i] ^ fps[j]).count("1") <= 4:
                assert out[i]["component_id"] == out[j]["component_id"]
    kept = simhash.stage(d)
    assert kept.columns == d.columns
    assert sorted(r["doc_id"] for r in kept.collect() if r["doc_id"] is not None) == [*range(8), 11]
    assert simhash.near_duplicates(empty(spark)).count() == 0
    # A bucket cut into slices finds the same links.
    prints = simhash.cut_lineage(simhash.fingerprints(simhash.documents(d), 4, ["id"]))
    vertices = prints.groupBy("f0").agg(F.coalesce(F.min("id"), F.lit(-1)).alias("rep"))
    one, many = (set(map(tuple, simhash.components(simhash.near_links(vertices, 4, 5, n)).collect())) for n in (20_000, 2))
    assert one == many


@pytest.mark.parametrize("limit", [1 << 20, 300])
def test_simhash_stage_keeps_exact_jaccard_classes(spark, monkeypatch, limit):
    monkeypatch.setattr(simhash, "GROUP_SHINGLES", limit)  # the smaller limit cuts groups into slices
    rnd = random.Random(11)
    texts = []
    for _ in range(40):
        base = [f"w{rnd.randint(0, 5000)}" for _ in range(rnd.randint(60, 200))]
        texts.append(" ".join(base))
        for _ in range(4):
            copy = list(base)
            for at in rnd.sample(range(len(copy)), max(1, len(copy) * rnd.randint(1, 6) // 100)):
                copy[at] = f"x{rnd.randint(0, 5000)}"
            texts.append(" ".join(copy))
    sets = [{tuple(w[k:k + 5]) for k in range(len(w) - 4)} for w in map(str.split, texts)]
    jaccard = {(i, j): len(sets[i] & sets[j]) / len(sets[i] | sets[j]) for i in range(len(sets)) for j in range(i)}
    assert all(sum(low <= x < low + 0.1 for x in jaccard.values()) > 20 for low in (0.6, 0.7, 0.8))
    first = list(range(len(texts)))
    for (i, j), x in jaccard.items():
        if x >= 0.8 and first[i] != first[j]:
            a, b = sorted((first[i], first[j]))
            first = [a if f == b else f for f in first]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    assert sorted(r["doc_id"] for r in simhash.stage(d).collect()) == sorted(set(first))
    assert simhash.stage(empty(spark)).count() == 0


def test_bpe_equals_the_library(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    texts = ["the thing the thing", "", "<|endoftext|>a<|endoftext|>", "é" * 700 + "  \n\n x", "日本語 ok's", "ab" * 3000]
    out = {r["doc_id"]: r for r in bpe.encode_digests(docs(spark, texts), path).collect()}
    for i, x in enumerate(texts):
        ids = t.encode(x, add_special_tokens=False).ids
        assert out[i]["n_tokens"] == len(ids) and out[i]["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert out[i]["decoded_sha256"] == hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    assert out[len(texts)]["n_tokens"] == 0 and bpe.encode_digests(empty(spark), path).count() == 0


def test_sharding_is_even_and_gapless(spark):
    rnd = random.Random(4)
    d = docs(spark, ["w" * rnd.randint(0, 300) + str(rnd.randint(0, 500)) for _ in range(3000)])
    rows = sharding.shard(d).collect()
    by = {}
    for r in rows:
        by.setdefault(r["shard"], []).append(r)
    size = [sum(r["size"] for r in x) for x in by.values()]
    assert len(rows) == 3003 and len(by) == 24 and max(size) < 1.03 * min(size)
    assert all(sorted(r["slot"] for r in x) == list(range(len(x))) for x in by.values())
    assert sharding.shard(empty(spark)).count() == 0


def brute_scores(rows, min_count, gain):
    """Log10 probabilities of all texts by dictionaries, context by context."""
    toks = [(["\n", *(t or "").lower().split(), "\n"], held) for t, held in rows]
    tree, base = {}, collections.Counter(w for x, held in toks if not held for w in x[1:])
    size = sum(base.values()) + len(base) + 1

    def give(ctx, w):  # ctx: nearest word first
        if not ctx:
            return (base[w] + 1) / size
        own, t, u = tree[ctx]
        return (own[w] + u * give(ctx[:-1], w)) / (t + u)

    depth = 0
    while True:
        depth += 1
        new = {}
        for x, held in toks:
            for i in range(depth, 0 if held else len(x)):
                ctx = tuple(x[i - 1 - k] for k in range(depth))
                far = ctx[-1]
                if depth == 1 and base[far] >= min_count or depth > 1 and ctx[:-1] in tree and (far,) in tree \
                        and tree[far,][0][ctx[-2]] >= min_count:
                    new.setdefault(ctx, collections.Counter())[x[i]] += 1
        kept = {}
        for ctx, own in new.items():
            t, u = sum(own.values()), len(own)
            if t >= min_count and u < t:
                up = {w: give(ctx[:-1], w) for w in own}
                won = sum(n * math.log((n - 1 + u * up[w]) / (t - 1 + u) / up[w]) if n > 1 else math.log((u - 1) / (t + u - 2))
                          for w, n in own.items())
                if won > gain:
                    kept[ctx] = own, t, u
        tree |= kept
        if not kept:
            break
    out = []
    for x, _ in toks:
        total = 0.0
        for i in range(1, len(x)):
            ctx = ()
            while len(ctx) < i and (longer := (*ctx, x[i - 1 - len(ctx)])) in tree:
                ctx = longer
            total += math.log10(give(ctx, x[i]))
        out.append(total)
    return out, max(map(len, tree), default=0), base


@pytest.mark.parametrize("batch_bytes,rest", [(8 << 20, 0), (300, 0), (300, 2_000_000)])
def test_lm_equals_brute_force(spark, monkeypatch, batch_bytes, rest):
    """Counts, base and score of every text, several levels deep, for one batch and for many, with and without a last task."""
    monkeypatch.setattr(lm_score, "REST_PLACES", rest)
    monkeypatch.setattr(lm_score, "BATCH_BYTES", batch_bytes)
    monkeypatch.setattr(lm_score, "PART_ROWS", batch_bytes // 10)
    rnd = random.Random(3)
    phrases = ["the cat sat on the mat", "a dog ran to the cat", "on the hill a dog sat", "to the sea ran Rare{}"]
    texts = [" ".join(rnd.choice(phrases).format(rnd.randint(0, 40)) for _ in range(rnd.randint(1, 9))) for _ in range(150)]
    table = docs(spark, [*texts, "zzz qqq", " \n "])
    got = lm_score.score(table).collect()
    rows = sorted((r["doc_id"] is not None, r["doc_id"] or 0, r["text"] or "") for r in table.collect())
    held = [known and zlib.crc32(str(i).encode()) % 7 == 2 for known, i, _ in rows]
    want, depth, base = brute_scores([(t, h) for (_, _, t), h in zip(rows, held)], lm_score.MIN_COUNT, lm_score.GAIN)
    got.sort(key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0))
    assert depth >= 2 and len(got) == len(rows) and [r["held_out"] for r in got] == held
    total, size = sum(base.values()), sum(base.values()) + len(base) + 1
    for r, (_, _, t), w in zip(got, rows, want):
        words = [*t.lower().split(), "\n"]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(words), sum(base[x] > 0 for x in words), total)
        assert math.isclose(r["base_score"], sum(math.log10((base[x] + 1) / size) for x in words), rel_tol=1e-9)
        assert math.isclose(r["score"], w, rel_tol=1e-9)
    free = [(r["score"], r["base_score"]) for r, h in zip(got, held) if h]
    assert free and sum(s for s, _ in free) > sum(b for _, b in free)


def test_simhash_stage_signatures():
    """The stage's fingerprints are those of `fingerprint`, each distinct shingle counted once."""
    rnd = random.Random(5)
    for n in (1, 3, 5, 254, 260, 2_000):
        text = " ".join(f"w{rnd.randint(0, 9**6)}" for _ in range(n)).encode()
        sets = [simhash.shingles(t, 5) for t in (text, b"a b c", text)]
        got = simhash.signatures(sets, 3)
        assert got[0].tolist() == got[2].tolist() == simhash.fingerprint(text, 5, 3) and got[1].tolist() == simhash.fingerprint(b"a b c", 5, 3)


@pytest.mark.parametrize("bucket", [20_000, 4])
def test_simhash_stage_groups_hold_all_near_pairs(spark, bucket):
    """Against all pairs: each that agrees in a block and is within the limit shares a group, also of a bucket cut into slices."""
    rnd = random.Random(6)
    base = [[rnd.getrandbits(64) for _ in range(3)] for _ in range(12)]
    rows = [[f ^ sum(1 << b for b in rnd.sample(range(64), rnd.randint(0, 12))) for f in rnd.choice(base)] for _ in range(80)]
    vertices = spark.createDataFrame([(*np.array(f, np.uint64).view(np.int64).tolist(), i) for i, f in enumerate(rows)],
                                     "f0 bigint, f1 bigint, f2 bigint, rep bigint")
    met = collections.defaultdict(set)
    for r in simhash.near_groups(vertices, 20, 8, 2, bucket).collect():
        met[r["v"]].add(r["k"])
    pairs = [(i, j) for i in range(len(rows)) for j in range(i) if sum((rows[i][x] ^ rows[j][x]).bit_count() for x in (0, 1)) <= 20
             and any((rows[i][x] ^ rows[j][x]) >> 8 * b & 255 == 0 for x in range(3) for b in range(8))]
    assert len(pairs) > 30 and all(met[i] & met[j] for i, j in pairs)


def test_simhash_stage_names_each_text_once(spark):
    """Many near copies meet in most of the buckets; still a group lists each of them once, and a large group's buckets connect them too."""
    monkeypatch.setattr(lm_score, "COUNT_STEP", 4)
    rnd = random.Random(7)
    base = [rnd.getrandbits(64) for _ in range(4)]
    rows = [[f ^ sum(1 << b for b in rnd.sample(range(64), 3)) for f in base] for _ in range(120)]
    vertices = spark.createDataFrame([(*np.array(f, np.uint64).view(np.int64).tolist(), i) for i, f in enumerate(rows)],
                                     "f0 bigint, f1 bigint, f2 bigint, f3 bigint, rep bigint")
    found = simhash.near_groups(vertices, 24, 8, 4).collect()
    assert sorted(r["v"] for r in found) == list(range(120)) and len({r["k"] for r in found}) == 1
    assert simhash.bucket_groups(vertices, 24, 8, 4).count() > 5 * 120


def test_simhash_links_of_what_is_connected():
    """With some rows connected before, the links are those that are missing."""
    rnd = random.Random(8)
    for _ in range(20):
        n = rnd.randint(1, 60)
        base = [rnd.getrandbits(64) for _ in range(4)]
        fps = np.array([[rnd.choice(base) ^ sum(1 << b for b in rnd.sample(range(64), rnd.randint(0, 5)))] for _ in range(n)], np.uint64)
        group, same = (np.array([rnd.randint(0, m) for _ in range(n)]) for m in (1, 12))
        i, j = simhash.links(fps, group, 4, same)
        got = np.array([(g, s) for g, s in zip(group, same)])

        def classes(pairs):
            name = list(range(n))
            for a, b in [*pairs, *((a, b) for a in range(n) for b in range(a) if (got[a] == got[b]).all())]:
                a, b = sorted((name[a], name[b]))
                name = [a if x == b else x for x in name]
            return name
        near = [(a, b) for a in range(n) for b in range(a) if group[a] == group[b] and int(fps[a, 0] ^ fps[b, 0]).bit_count() <= 4]
        assert classes(zip(i.tolist(), j.tolist())) == classes(near)
        assert len(i) < max(1, len({tuple(x) for x in got.tolist()}))


def test_simhash_stage_takes_candidates_from_the_index(spark, monkeypatch):
    """Without the index's groups nothing is linked: no other path makes candidates."""
    words = [f"w{i}" for i in range(200)]
    rows = [(i, " ".join([*words, str(i)]), None, None, 1, "r", "b") for i in range(3)]
    d = spark.createDataFrame(rows, SCHEMA)
    assert [r["doc_id"] for r in simhash.stage(d).collect()] == [0]
    monkeypatch.setattr(simhash, "near_groups", lambda *a: spark.createDataFrame([], "k bigint, v bigint"))
    assert sorted(r["doc_id"] for r in simhash.stage(d).collect()) == [0, 1, 2]


def test_lm_counts_without_a_session():
    """Workers have no session: counting needs none."""
    code = """
import numpy as np
from chronotape.llm.lm_score import MIN_COUNT, counted
keys, ones = np.array([[0, 5, 0], [0, 5, 0]]), np.array([True, True])
out = counted(keys, ones, np.array([1, 2]), np.array([2, 1]), np.array([7, 8, 7]), np.array([MIN_COUNT, 1, 2]), np.array([.1, .2, .1]))
print(out.to_pylist())
"""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    done = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, cwd=root)
    assert done.returncode == 0, done.stderr
    sums, *answers = ast.literal_eval(done.stdout)
    assert (sums["t"], sums["u"], sums["once"], sums["n"], sums["batch"]) == (lm_score.MIN_COUNT + 3, 2, 1, [lm_score.MIN_COUNT + 2], None)
    assert [(r["batch"], r["next"], r["n"], r["t"]) for r in answers] == [(b, [7], [lm_score.MIN_COUNT + 2], None) for b in (1, 2)]


def test_lm_stored_frames_leave_no_exchanged_files(spark):
    """Only the stored rows stay on disk, not what was exchanged to make them."""
    def exchanged():
        env = spark._jvm.org.apache.spark.SparkEnv.get()
        return {x for x in env.blockManager().diskBlockManager().getAllFiles().mkString("|").split("|") if "/shuffle_" in x}
    before = exchanged()
    out = lm_score.stored(spark.range(10_000).repartition(4, "id"))
    for _ in range(50):
        if not (left := exchanged() - before):
            break
        time.sleep(0.2)
    assert not left and out.count() == 10_000 and spark.conf.get(lm_score.CLEANUP) == "false"


def test_lm_deals_words_and_contexts_in_few_rows(spark):
    """A batch sends its words and contexts as one row per bucket, and numbers and counts come back the same way."""
    texts = [" ".join(f"w{i * 7 % 50_000}" for i in range(k, k + 400)) for k in range(0, 40_000, 50)]
    table = docs(spark, texts).coalesce(1)
    parts = lm_score.pack(table)
    words = parts.select("batch", "words", "n").mapInArrow(lm_score.deal_words, lm_score.WORDS).repartition("bucket").sortWithinPartitions("bucket")
    known = words.mapInArrow(lm_score.number_words, lm_score.KNOWN).collect()
    count = collections.Counter(w for r in table.collect() if r["doc_id"] is None or zlib.crc32(str(r["doc_id"]).encode()) % 7 != 2
                                for w in [*(r["text"] or "").split(), "\n"])
    own = [w.decode() for w in parts.first()["words"]]
    got = {own[a]: (node, c) for r in known for a, node, c in zip(r["at"], r["node"], r["c"])}
    assert len(known) <= lm_score.WORD_BUCKETS < len(own) == len(got) == len({node for node, _ in got.values()})
    assert all(c == count[w] for w, (_, c) in got.items()) and sum(r["total"] for r in known) == sum(count.values())


def test_lm_blocks_hold_all_numbers():
    """Columns of lists come back from their blocks as they were, and so do arrays."""
    columns = [np.array([3, 1 << 62, 0, 5]), np.array([-1, 70_000, -300, 2]), np.array([0.5, 1e-9, 2.0, 3.5], np.float32)]
    edges = np.array([0, 1, 1, 4])
    got, many = lm_score.opened(pa.array(lm_score.blocks([(x, edges) for x in columns])))
    assert many.tolist() == [1, 0, 3] and all(g.tolist() == x.tolist() for g, x in zip(got, columns))
    state = {"a": np.array([], np.int64), "b": np.array([True, False, True]), "c": np.array([.1, 7e300]), "d": np.array([-5, 9], np.int32), "e": [None, 3]}
    again = lm_score.loose(lm_score.tight(state))
    assert all(again[k].dtype == x.dtype and again[k].tolist() == x.tolist() for k, x in state.items() if k != "e") and again["e"] == [None, 3]


def test_lm_batch_goes_on_from_what_is_stored(monkeypatch):
    """A batch is read back as it was, and a rare context of a frequent word is not dealt into parts."""
    monkeypatch.setattr(lm_score, "COUNT_STEP", 4)
    rnd = random.Random(7)
    texts = [" ".join(f"often x{rnd.randint(0, 9)} y{rnd.randint(0, 2)} z{rnd.randint(0, 99)}" for _ in range(20)).encode() for _ in range(60)]
    body, words, n = lm_score.packed(list(range(60)), [i % 7 == 2 for i in range(60)], texts)
    size = float(sum(n) + len(n) + 1)
    batch = lm_score.Batch(body)
    batch.start({"at": np.arange(len(n)), "node": rnd.sample(range(10_000), len(n)), "c": n}, size)
    batch.send(1, 500, 256)
    batch.leave_root()
    batch = lm_score.Batch(batch.body())
    batch.at_root(size)
    batch.alone(1)
    sent, again = batch.send(2, 500, 256), lm_score.Batch(batch.body())
    assert len(batch.at) > 100 and max(n) > 1_000
    for name in ("stream", "word", "c", "at", "p", "parent", "nodes", "t", "doc", "train", "grows", "begins", "held"):
        assert getattr(again, name).tolist() == getattr(batch, name).tolist(), name
    (_, _, _, parts, *_), _ = lm_score.opened(pa.array(sent["lists"]))
    assert len(parts) > 5 and set(parts.tolist()) == {1}


def test_lm_odd_inputs(spark):
    assert lm_score.score(empty(spark)).count() == 0
    held = [i for i in range(200) if zlib.crc32(str(i).encode()) % 7 == 2][:3]
    rows = [(held[0], "x y", None, None, 1, "r", "b"), (held[1], None, None, None, 1, "r", "b"), (held[2], "w" * 3_000_000, None, None, 1, "r", "b")]
    out = lm_score.score(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(out) == 3 and all((r["n_known"], r["train_tokens"], r["base_score"], r["score"]) == (0, 0, 0.0, 0.0) for r in out)


def test_pipeline_keeps_one_of_each(spark):
    import corpus_pipeline
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    ids = [r["doc_id"] for r in out.select("doc_id").collect()]
    assert len(ids) == len(set(ids)) > 100 and {"doc_id", "text", "lang", "source", "n_chars"} <= set(out.columns)
    assert out.where("size(bpe_ids) <> bpe_length").count() == 0


def test_bpe_without_frequent_words(spark):
    """No word occurs often enough for the lexicon: everything is merged, nothing is looked up."""
    tokenizer = Tokenizer.from_file(PATH)
    texts = ["one two", "three", "supercalifragilisticexpialidocious " + "x" * 70, "aaaaaaaaaaaaaaa", ""]
    out = {r["doc_id"]: r for r in bpe.encode_digests(docs(spark, texts), PATH).collect()}
    for i, t in enumerate(texts):
        ids = tokenizer.encode(t, add_special_tokens=False).ids
        assert out[i]["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
    staged = {r["doc_id"]: r for r in bpe.stage(docs(spark, texts), PATH).collect()}
    assert staged[2]["text"] == texts[2] and staged[2]["body"] == "b" and staged[len(texts)]["bpe_length"] == 0
    assert bpe.stage(empty(spark), PATH).columns[:2] == ["doc_id", "text"] and bpe.stage(empty(spark), PATH).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_short_and_long_merges_agree(seed):
    tokenizer = bpe.Tokenizer(open(PATH, encoding="utf-8").read())
    library, rnd = Tokenizer.from_file(PATH), random.Random(seed)
    for _ in range(300):
        word = "".join(rnd.choice("aaabbe nrstionghé") for _ in range(rnd.choice([1, 2, 5, 9, 20, 39, 60]))).replace(" ", "")
        if word:
            ids = library.encode(word, add_special_tokens=False).ids
            assert [i for w in bpe.regex.findall(bpe.PATTERN, word) for i in tokenizer.merge(w.encode())] == ids


def test_bpe_short_merge_builds_no_pairs():
    """Words below 40 bytes look up neither rank nor result by a tuple, and get the ids of the long form."""
    tokenizer = bpe.Tokenizer(open(PATH, encoding="utf-8").read())
    words = ["a", "zqxjkv", "aaaaaaaaaaa", "hello", "2718281828459045", "naïveté", "你好", "x" * 39, " the"]
    want = []
    for word in words:
        ids = [tokenizer.single[b] for b in word.encode()]
        while pairs := [(tokenizer.rank[p], i) for i, p in enumerate(zip(ids, ids[1:])) if p in tokenizer.rank]:
            i = min(pairs)[1]
            ids[i:i + 2] = [tokenizer.merged[ids[i], ids[i + 1]]]
        want.append(ids)
    tokenizer.rank = tokenizer.merged = None
    assert [tokenizer.merge(w.encode()) for w in words] == want
