"""Periodic runs, the Merkle manifest and token counts against brute force, with the defined odd inputs."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from chronotape.llm import merkle, periodic_runs, token_counts

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, row string, body string, tree long, place long"
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def frame(spark, rows):
    return spark.createDataFrame([(*r, "r", "b", 7, 7) for r in rows], SCHEMA)


def odd_rows():
    """Null in any column, equal rows, equal ids with other texts, empty and blank texts."""
    return [(0, "a b", "en", "s", 3), (0, "a b", "en", "s", 3), (0, "a c", "en", "s", 3), (None, "x\ny", None, None, None),
            (1, None, "en", None, 4), (2, "", None, "é", 5), (3, " \n\t ", "en", "z", None), (None, None, None, None, None)]


def brute_runs(words):
    x, best = np.array([hash(w) for w in words], np.int64), {}
    for q in range(1, len(x) // 4 + 1):
        equal = np.concatenate(([0], (x[:-q] == x[q:]).view(np.int8), [0]))
        edges = np.flatnonzero(np.diff(equal))
        for a, b in zip(edges[::2], edges[1::2]):
            if b - a + q >= max(6, 4 * q):
                best.setdefault((int(a), int(b - a + q)), q)
    return sorted(((a, n, q) for (a, n), q in best.items()), key=lambda r: (r[0], r[2]))


def expected_runs(doc_id, text):
    words = (text or "").encode().split()
    h = None if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h is not None and h % 10 == 0 and words:
        a = h // 10 % len(words)
        p = 1 + (len(words) - a) // (3 + h // 10 % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = brute_runs(words)
    gone = {k for a, n, q in runs for k in range(a + q, a + n)}
    best = max(runs, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=None)
    sha = lambda b: hashlib.sha256(b).hexdigest()
    return (len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None,
            sha("".join(f"{a},{n},{q}\n" for a, n, q in runs).encode()),
            sha(b" ".join(w for k, w in enumerate(words) if k not in gone)))


def random_words(rnd):
    out, k = [], rnd.choice([1, 2, 3, 5, 40])
    for _ in range(rnd.randint(0, 6)):
        u = [f"w{rnd.randrange(k)}" for _ in range(rnd.randint(1, 14))]
        out += u * rnd.choice([1, 1, 3, 4, 5, 9]) + u[:rnd.randint(0, len(u))]
        if rnd.random() < 0.3:
            out += out[-rnd.randint(1, 40):] * rnd.randint(1, 4)
    return " ".join(out)


def test_runs_equal_brute_force(spark):
    rnd = random.Random(4)
    rows = [(i, random_words(rnd), "en", "s", 1) for i in range(300)] + odd_rows()
    rows += [(1000 + i, rows[5][1], "en", "s", 1) for i in range(20)]
    got = periodic_runs.find_runs(frame(spark, rows), periodic_runs.planted()).collect()
    want = Counter((r[0], *expected_runs(r[0], r[1])) for r in rows)
    assert Counter(tuple(r) for r in got) == want
    assert periodic_runs.find_runs(frame(spark, []), periodic_runs.planted()).count() == 0


def test_runs_on_given_documents(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    got = periodic_runs.find_runs(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"), periodic_runs.planted())
    assert sorted(map(tuple, got.collect())) == sorted((r[0], *expected_runs(r[0], r[1])) for r in rows)


def test_runs_keep_text_without_plant(spark):
    rows = [(i, "la " * 7 + "end", "en", "s", 1) for i in range(30)]
    got = periodic_runs.find_runs(frame(spark, rows)).collect()
    assert {(r["start"], r["length"], r["period"]) for r in got} == {(0, 7, 1)} and len(got) == 30


@pytest.mark.parametrize("seed", range(4))
def test_array_runs_equal_brute_force(seed):
    rnd = random.Random(seed)
    for _ in range(150):
        texts = [random_words(rnd).split() for _ in range(rnd.randint(1, 5))]
        texts.append(list(texts[0]))
        names = {}
        ids = np.array([names.setdefault(w, len(names)) for t in texts for w in t], np.int64)
        sizes = [len(t) for t in texts]
        got, base = [[] for _ in texts], np.cumsum([0, *sizes])
        for d, a, b, q in periodic_runs.all_runs(ids, np.repeat(np.arange(len(texts)), sizes)).tolist():
            got[d].append((a - int(base[d]), b - a, q))
        assert got == [brute_runs(t) for t in texts]


def test_runs_of_long_texts_take_no_pairs():
    zeros = np.zeros(300_000, np.int64)
    assert periodic_runs.all_runs(zeros, zeros).tolist() == [[0, 0, 300_000, 1]]
    word = np.random.default_rng(1).integers(0, 500, 40_000)
    assert periodic_runs.all_runs(np.tile(word, 5), np.zeros(200_000, np.int64)).tolist() == [[0, 0, 200_000, 40_000]]


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(row):
    doc_id, text, lang, source, n_chars = row
    return digest(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)])


def tree_of(leaves):
    """Root and, per leaf, the list of (left, right) siblings."""
    level, paths, at = list(leaves), [[] for _ in leaves], list(range(len(leaves)))
    while len(level) > 1:
        for i, k in enumerate(at):
            run = level[k // 3 * 3:k // 3 * 3 + 3]
            paths[i].append(("".join(run[:k % 3]), "".join(run[k % 3 + 1:])))
            at[i] = k // 3
        level = [digest(*level[i:i + 3]) for i in range(0, len(level), 3)]
    return level[0], paths


def expected_manifest(rows):
    null_first = lambda v, least: (v is not None, least if v is None else v)
    by_source = {}
    for r in rows:
        by_source.setdefault(r[3], []).append(r)
    sources = sorted(by_source, key=lambda s: null_first(s and s.encode(), b""))
    trees = {}
    for s in sources:
        trees[s] = sorted(by_source[s], key=lambda r: (null_first(r[0], 0), leaf_of(r)))
    lower = {s: tree_of([leaf_of(r) for r in trees[s]]) for s in sources}
    root, upper = tree_of([lower[s][0] for s in sources])
    out = []
    for k, s in enumerate(sources):
        for r, path in zip(trees[s], lower[s][1]):
            path = path + upper[k]
            change = r[0] is not None and r[1] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0
            folded = leaf_of((r[0], r[1].replace("\n", ""), *r[2:]) if change else r)
            for x, y in path:
                folded = digest(x, folded, y)
            out.append((r[0], leaf_of(r), lower[s][0], root, digest(*[x + y for x, y in path]), folded, folded == root))
    return out


def manifest_rows(spark, rows):
    got = merkle.verify(frame(spark, rows), merkle.tampered())
    return Counter(tuple(r) for r in got.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect())


def test_manifest_equals_brute_force(spark):
    rnd = random.Random(9)
    rows = odd_rows() + [(i, rnd.choice(["plain", "two\nlines", "", None]), "en", rnd.choice(["hot", "hot", "b", "é", "lone" + str(i)]), i)
                         for i in range(120)]
    assert manifest_rows(spark, rows) == Counter(expected_manifest(rows))


def test_manifest_of_few_rows(spark):
    assert manifest_rows(spark, []) == Counter()
    one = [(5, "only", "en", "s", 4)]
    assert manifest_rows(spark, one) == Counter(expected_manifest(one))
    same = [(5, "same\n", "en", "s", 4)] * 28
    assert manifest_rows(spark, same) == Counter(expected_manifest(same))


def test_height_counts_levels(spark):
    sizes = [1, 2, 3, 4, 9, 10, 27, 28, 3 ** 20, 3 ** 20 + 1]
    df = spark.createDataFrame([(s,) for s in sizes], "size bigint").select(merkle.height_of(F.col("size")).alias("h"))
    assert [r["h"] for r in df.collect()] == [0, 1, 1, 2, 2, 3, 3, 4, 20, 21]


def counted(texts):
    t = Tokenizer.from_file(TOKENIZER)
    return [len(t.encode(x or "", add_special_tokens=False).ids) for x in texts]


def test_token_counts_equal_the_library(spark, folder):
    texts = ["a b  c\n\td", "<|endoftext|>a <|END b<|ENDOFTEXT|>", "ΣΑΣ σΣ", "é ́a", "a b　c", "日本語。" * 900, "x" * 5000,
             "'s it's'LL", "a\x0bb\x0cc\x1cd\u0085e", "word " * 3000, "word\n" * 3000, "same", "same", " same ", "ẞİ"]
    rows = [(i, t, "en", "s", 1) for i, t in enumerate(texts)] + odd_rows()
    cache = f"{folder}/counts"
    got = token_counts.count_tokens(frame(spark, rows), TOKENIZER, cache).collect()
    want = Counter((r[0], len((r[1] or "").encode()), n, n > 2048) for r, n in zip(rows, counted([r[1] for r in rows])))
    assert Counter(tuple(r) for r in got) == want
    stored = spark.read.parquet(cache)
    # Equal and equally normalised texts are encoded once.
    normal = {" ".join(x for x in re.split("[ \t\n\r]+", r[1] or "") if x) for r in rows}
    assert stored.count() == stored.select("content").distinct().count() == len(normal)


def test_token_counts_only_encode_misses(spark, folder):
    cache, first = f"{folder}/counts", [(1, "one two", "en", "s", 1), (2, "three", "en", "s", 1)]
    assert token_counts.fill(frame(spark, first), TOKENIZER, cache) == 2
    assert token_counts.fill(frame(spark, first + [(3, "one\ntwo ", "en", "s", 1)]), TOKENIZER, cache) == 0
    assert token_counts.fill(frame(spark, [(9, "four", "en", "s", 1)] + first), TOKENIZER, cache) == 1
    # Another tokenizer doesn't see these counts.
    assert spark.read.parquet(cache).count() == 3
    other = public_tokenizers.path("byte_bpe_50k.json")
    assert token_counts.fill(frame(spark, first), other, cache) == 2
    # A run that was repeated after a crash leaves equal rows; every document still gets one count.
    spark.read.parquet(cache).write.mode("append").parquet(f"{folder}/twice")
    spark.read.parquet(cache).write.mode("append").parquet(f"{folder}/twice")
    got = token_counts.count_tokens(frame(spark, first), TOKENIZER, f"{folder}/twice").collect()
    assert sorted((r["doc_id"], r["n_tokens"]) for r in got) == [(1, counted(["one two"])[0]), (2, counted(["three"])[0])]
    assert token_counts.count_tokens(frame(spark, []), TOKENIZER, cache).count() == 0


def test_token_counts_without_broadcast(spark, monkeypatch):
    monkeypatch.setattr(token_counts, "MISS_BYTES", 0)
    rows = [(i, f"text number {i % 5}", "en", "s", 1) for i in range(20)]
    got = token_counts.count_tokens(frame(spark, rows), TOKENIZER).collect()
    assert sorted((r["doc_id"], r["n_tokens"]) for r in got) == list(zip(range(20), counted([r[1] for r in rows])))
