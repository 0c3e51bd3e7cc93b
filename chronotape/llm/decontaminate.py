"""Benchmark decontamination: one Aho-Corasick automaton over the normalised benchmark, one scan of each text.

Normalisation works on bytes and keeps lengths: A-Z become a-z, every byte that is not part of a word becomes a space.
Single-spaced words then feed the automaton; as word k of the single-spaced text is word k of the original, hits map to
byte offsets of the original. Windows are ten consecutive words of an item (a shorter item is one window).

The benchmark is cut into blocks of about BLOCK_BYTES by a count of its bytes; each block becomes one broadcast
automaton, and a batch of documents is scanned by one block's automaton after the other. A benchmark of usual size is
one block. Documents are not shuffled at all, so no key can be hot.

Defined cases: a null text has no words; an item without words has no window; an item whose item_id is null marks
words but is not listed; repeated items count once; repeated documents get equal results.
"""

from __future__ import annotations

import hashlib
import re
import uuid

import ahocorasick
import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cached, documents, map_texts, rows_of, with_text

WINDOW = 10
BLOCK_BYTES = 16 << 20

_WORD = set(range(0x30, 0x3A)) | set(range(0x41, 0x5B)) | set(range(0x61, 0x7B)) | set(range(0x80, 0x100))
TABLE = bytes((c + 32 if 0x41 <= c <= 0x5A else c) if c in _WORD else 32 for c in range(256))
FIELDS = ("n_words bigint, n_hit bigint, items array<bigint>, "
          "spans array<struct<first_word:bigint,last_word:bigint,start:bigint,end:bigint>>")


def build_automaton(items, window: int = WINDOW):
    """Automaton whose payload is (words in the window, item ids); items are (id, text) pairs."""
    found: dict[bytes, tuple[int, set]] = {}
    for item, text in items:
        words = (text or "").encode().translate(TABLE).split()
        for i in range(max(1, len(words) - window + 1) if words else 0):
            part = words[i:i + window]
            found.setdefault(b" " + b" ".join(part) + b" ", (len(part), set()))[1].add(item)
    automaton = ahocorasick.Automaton()
    for window_text, payload in found.items():
        automaton.add_word(window_text.decode("latin-1"), payload)
    if found:
        automaton.make_automaton()
    return automaton if found else None


def scan(texts: list[bytes], automata) -> list[list]:
    counts, hits, items, spans = [], [], [], []
    flat = [t.translate(TABLE) for t in texts]
    words = [t.split() for t in flat]
    marks: list[list] = [[] for _ in texts]
    listed: list[set] = [set() for _ in texts]
    single = [(" " + b" ".join(w).decode("latin-1") + " ") if w else "" for w in words]
    for automaton in automata:
        if automaton is None:
            continue
        for i, t in enumerate(single):
            for end, (n, ids) in automaton.iter(t):
                marks[i].append((end, n))
                listed[i] |= ids
    for i, w in enumerate(words):
        counts.append(len(w))
        merged = []
        if marks[i]:
            spaces = np.flatnonzero(np.frombuffer(single[i].encode("latin-1"), np.uint8) == 32)
            # The space at `end` closes the last word of the window: it is space number last + 1.
            ends = np.searchsorted(spaces, [e for e, _ in marks[i]])
            runs = sorted((int(e) - n, int(e) - 1) for e, (_, n) in zip(ends, marks[i], strict=True))
            for a, b in runs:
                if merged and a <= merged[-1][1] + 1:
                    merged[-1][1] = max(merged[-1][1], b)
                else:
                    merged.append([a, b])
            places = [m.span() for m in re.finditer(rb"[^ ]+", flat[i])]
            merged = [(a, b, places[a][0], places[b][1]) for a, b in merged]
        hits.append(sum(b - a + 1 for a, b, *_ in merged))
        items.append(sorted(x for x in listed[i] if x is not None))
        spans.append([{"first_word": a, "last_word": b, "start": s, "end": e} for a, b, s, e in merged])
    return [counts, hits, items, spans]


def item_blocks(benchmark: DataFrame):
    """Broadcasts of (item_id, text) lists, each about BLOCK_BYTES at most."""
    spark = benchmark.sparkSession
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").distinct()
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = 1 + int(size) // BLOCK_BYTES
    for b in range(n):
        part = rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == b).collect()
        yield f"items-{uuid.uuid4().hex}", spark.sparkContext.broadcast([(r["item_id"], r["text"]) for r in part])


def find(df: DataFrame, benchmark: DataFrame, keep: list[str], window: int = WINDOW) -> DataFrame:
    """Columns `keep` of df plus FIELDS for its column `body`; spans hold word numbers and byte offsets (end excluded)."""
    blocks = list(item_blocks(benchmark))

    def make():
        def automata():
            for key, items in blocks:
                yield cached(key, items, lambda rows: build_automaton(rows, window))
        return lambda texts: scan(texts, automata())

    return map_texts(df, make, FIELDS, keep)


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Digest per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    found = find(documents(docs), benchmark, ["id"])
    listed = F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ",")
    return found.select(F.col("id").alias("doc_id"), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                        F.sha2(listed, 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def stage(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents without any benchmark window, unchanged."""
    found = find(rows_of(docs).select("row", "body"), benchmark, ["row"])
    return with_text(found.where("n_hit = 0").withColumn("body", F.col("row.text")), docs.columns)


ORACLE = r"""
WITH i AS (SELECT DISTINCT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
      'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
      'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
g AS (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS k FROM i WHERE len(w) > 0),
win AS (SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[k:k + 9], ' ') AS t FROM g),
sizes AS (SELECT DISTINCT n FROM win),
p AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM d, sizes WHERE len(w) >= n),
h AS (SELECT p.doc_id, p.k, p.n, win.item_id FROM p JOIN win ON win.n = p.n
      AND array_to_string(p.w[p.k:p.k + p.n - 1], ' ') = win.t),
c AS (SELECT doc_id, count(DISTINCT x) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS x FROM h) GROUP BY doc_id),
s AS (SELECT doc_id, count(*) AS n_items, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS l
      FROM (SELECT DISTINCT doc_id, item_id FROM h WHERE item_id IS NOT NULL) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(l, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c ON c.doc_id = d.doc_id LEFT JOIN s ON s.doc_id = d.doc_id
"""
