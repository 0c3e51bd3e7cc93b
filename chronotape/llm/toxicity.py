"""Toxicity: votes of the nearest labelled examples by exact TF-IDF cosine, found in a block-max inverted index.

Features are lower-cased words and their beginnings of 4, 5 and 6 bytes. From the training examples (at most EXAMPLES
labelled rows, in hash order: the documented bound of what is fitted) the terms that tell labels apart are chosen: those
whose share of toxic examples is above FAR_ABOVE times the base rate even at the lower end of its error bar, at most TERMS
of them. Examples are TF-IDF vectors of unit length over these terms. The index holds, per term, the postings in blocks
of BLOCK examples with the largest weight of each block. A document adds up the block maxima of its terms, visits blocks
from the highest bound down, and stops when the next bound can't reach its k-th cosine; so the neighbours are exact.

raw = (sum of cosine x label + PRIOR x base) / (sum of cosine + PRIOR) over the NEIGHBOURS nearest. Scores are raw values
calibrated by a logistic curve which is fitted on the examples that have terms, each scored without itself. A document
that shares no term with any example has no neighbour and gets the rate of toxic examples among such examples.
Labels, language, source and ids never enter a score (a hash of the id picks folds and examples).

All documents are scored in one pass without a shuffle; the index is a broadcast bounded by EXAMPLES and TERMS.

Defined cases: null or empty text has no terms; labels that are null are no examples; a document labelled twice counts as
toxic if any label says so; repeated rows get equal scores; without examples of both kinds every score is the base rate
(0.5 without any example).
"""

from __future__ import annotations

import math
import uuid
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cached, cut_lineage, documents, map_texts, rows_of, ship, with_text

EXAMPLES = 20_000
TERMS = 4_096
FAR_ABOVE = 3.0
MIN_EXAMPLES = 2
NEIGHBOURS = 15
PRIOR = 0.25
BLOCK = 64
THRESHOLD = 0.7
REMEMBERED = 500_000
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_EDGE = b".,;:!?\"'()[]{}<>*_-"


def features(word: bytes) -> list[bytes]:
    word = word.strip(_EDGE)
    return [word, *[word[:k] + b"*" for k in (4, 5, 6) if len(word) > k]] if word else []


def examples(docs: DataFrame, labels: DataFrame, limit: int = EXAMPLES) -> DataFrame:
    """(id, body, toxic) of the training fold, in hash order up to `limit` rows."""
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy(
        F.col("doc_id").cast("long").alias("id")).agg(F.max("toxic").cast("int").alias("toxic"))
    known = known.where(~held_out(F.col("id"))).orderBy(F.xxhash64("id"), "id").limit(limit)
    # At most `limit` ids: a bounded broadcast, so texts stay where they are.
    return documents(docs).join(F.broadcast(known), "id").dropDuplicates(["id"])


def held_out(doc_id):
    return F.pmod(F.crc32(doc_id.cast("string")), F.lit(3)) == 1


def choose_terms(train: DataFrame, base: float, limit: int = TERMS) -> list[tuple[bytes, int, int]]:
    """(term, examples with it, toxic ones among them) of the terms that speak for a label."""
    def run(batches):
        seen, toxic = Counter(), Counter()
        for batch in batches:
            for text, label in zip(batch.column("body").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
                words = set(text.encode().translate(_LOWER).split())
                terms = {f for w in words for f in features(w)}
                seen.update(terms)
                if label == 1:
                    toxic.update(terms)
        yield pa.RecordBatch.from_arrays([pa.array(seen.keys(), pa.binary()), pa.array(seen.values(), pa.int64()),
                                          pa.array([toxic[t] for t in seen], pa.int64())], names=["term", "n", "toxic"])

    ship(train.sparkSession)
    counts = (train.select("body", "toxic").mapInArrow(run, "term binary, n bigint, toxic bigint")
              .groupBy("term").agg(F.sum("n").alias("n"), F.sum("toxic").alias("toxic")).where(F.col("n") >= MIN_EXAMPLES))
    share = F.col("toxic") / F.col("n")
    low = share - F.sqrt((share * (1 - share) + 0.25 / F.col("n")) / F.col("n"))
    chosen = (counts.withColumn("low", low).where(F.col("low") > min(FAR_ABOVE * base, 0.5 + base / 2))
              .orderBy((F.col("low") * F.log(F.col("toxic") + 1)).desc(), "term").limit(limit))
    return [(bytes(r["term"]), r["n"], r["toxic"]) for r in chosen.collect()]


class TermReader:
    """Texts to (term number, count) vectors; remembers which words carry terms."""

    def __init__(self, terms: list[bytes]):
        self.number = {t: i for i, t in enumerate(terms)}
        self.hits: dict[bytes, list[int]] = {}
        self.seen: set[bytes] = set()

    def read(self, texts: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
        if len(self.seen) > REMEMBERED:
            self.seen.clear()
            self.hits.clear()
        out, number = [], self.number
        for text in texts:
            words = text.translate(_LOWER).split()
            new = set(words) - self.seen
            for w in new:
                found = [number[f] for f in features(w) if f in number]
                if found:
                    self.hits[w] = found
            self.seen |= new
            count: Counter = Counter()
            for w in filter(self.hits.__contains__, words):
                count.update(self.hits[w])
            keys = sorted(count)
            out.append((np.array(keys, np.int64), np.array([count[t] for t in keys], float)))
        return out


class BlockMaxIndex:
    """Unit TF-IDF vectors of the examples, per term in blocks with their largest weight."""

    def __init__(self, terms, idf, vectors, labels, empty_rate, curve=None):
        self.reader, self.idf = TermReader(terms), np.asarray(idf)
        self.labels, self.empty_rate, self.curve = np.asarray(labels, float), empty_rate, curve
        rows = [(t, e, w) for e, (ids, counts) in enumerate(vectors) for t, w in zip(*self._unit(ids, counts), strict=True)]
        rows.sort(key=lambda x: (x[0], x[1]))
        term = np.array([r[0] for r in rows], np.int64)
        self.example = np.array([r[1] for r in rows], np.int64)
        self.weight = np.array([r[2] for r in rows], float)
        block = self.example // BLOCK
        first = np.flatnonzero(np.concatenate([[True], (np.diff(term) != 0) | (np.diff(block) != 0)])) if rows else np.zeros(0, int)
        self.start, self.end = first, np.concatenate([first[1:], [len(rows)]]).astype(np.int64) if rows else first
        self.block = block[first]
        self.peak = np.maximum.reduceat(self.weight, first) if rows else np.zeros(0)
        edges = np.searchsorted(term[first], np.arange(len(terms) + 1))
        self.blocks_of = list(zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True))
        self.n_blocks = len(vectors) // BLOCK + 1

    def _unit(self, ids, counts):
        w = (1 + np.log(counts)) * self.idf[ids] if len(ids) else np.zeros(0)
        norm = math.sqrt(float(w @ w))
        return ids, w / norm if norm else w

    def nearest(self, ids, counts, k=NEIGHBOURS, without=-1):
        """(examples, cosines) of the k nearest with a positive cosine; ties go to the smaller example number."""
        ids, w = self._unit(ids, counts)
        if not len(ids):
            return np.zeros(0, int), np.zeros(0)
        pieces = [np.arange(*self.blocks_of[t]) for t in ids]
        at = np.concatenate(pieces)
        q = np.repeat(w, [len(p) for p in pieces])
        bound = np.bincount(self.block[at], q * self.peak[at], self.n_blocks)
        order = np.argsort(-bound, kind="stable")
        order = order[bound[order] > 0]
        by_block = np.argsort(self.block[at], kind="stable")
        places = np.searchsorted(self.block[at][by_block], np.arange(self.n_blocks + 1))
        best: list[tuple[float, int]] = []
        for b in order.tolist():
            if len(best) == k and bound[b] < best[-1][0] - 1e-12:
                break
            mine = by_block[places[b]:places[b + 1]]
            got = np.zeros(BLOCK)
            for j in mine.tolist():
                s, e = self.start[at[j]], self.end[at[j]]
                got[self.example[s:e] - b * BLOCK] += q[j] * self.weight[s:e]
            if b * BLOCK <= without < (b + 1) * BLOCK:
                got[without - b * BLOCK] = 0
            hit = np.flatnonzero(got > 0)
            best = sorted([*best, *[(float(got[i]), int(i) + b * BLOCK) for i in hit]], key=lambda x: (-x[0], x[1]))[:k]
        return np.array([e for _, e in best], int), np.array([c for c, _ in best])

    def raw(self, vector, without=-1):
        found, cosine = self.nearest(*vector, without=without)
        if not len(found):
            return self.empty_rate, found, cosine
        base = self.labels.mean()
        return min(1.0, float((cosine @ self.labels[found] + PRIOR * base) / (cosine.sum() + PRIOR))), found, cosine

    def score(self, vector, without=-1):
        raw, found, cosine = self.raw(vector, without)
        if self.curve is None or not len(found):
            return raw, found, cosine
        a, b = self.curve
        x = math.log(max(raw, 1e-6) / max(1 - raw, 1e-6))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, a * x + b)))), found, cosine


def logistic(raw: np.ndarray, labels: np.ndarray) -> tuple[float, float] | None:
    """Curve a * logit(raw) + b by Newton steps, with a small ridge towards the identity."""
    if len(raw) < 200 or labels.min() == labels.max():
        return None
    x = np.log(np.clip(raw, 1e-6, 1) / np.clip(1 - raw, 1e-6, 1))
    design, beta, pull = np.stack([x, np.ones_like(x)], 1), np.array([1.0, 0.0]), np.array([1.0, 0.0])
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        slope = design.T @ (labels - p) - (beta - pull)
        curve = (design * (p * (1 - p))[:, None]).T @ design + np.eye(2)
        beta = beta + np.clip(np.linalg.solve(curve, slope), -1, 1)
    return (float(beta[0]), float(beta[1])) if beta[0] > 0 else None


def fit(docs: DataFrame, labels: DataFrame):
    """(key, broadcast) of the parts from which workers build the index."""
    train = cut_lineage(examples(docs, labels))
    n, toxic = train.agg(F.count(F.lit(1)), F.sum("toxic")).first()
    base = (toxic or 0) / n if n else 0.5
    chosen = choose_terms(train, base) if 0 < base < 1 else []
    terms = [t for t, *_ in chosen]
    idf = [math.log(1 + n / (1 + df)) for _, df, _ in chosen]

    def make():
        reader = TermReader(terms)

        def step(texts):
            vectors = reader.read(texts)
            return [[v[0].tolist() for v in vectors], [v[1].tolist() for v in vectors]]
        return step

    # Only examples with a chosen term have postings; at most EXAMPLES short vectors come to the driver.
    rows = map_texts(train, make, "terms array<bigint>, counts array<double>", ["id", "toxic"]).orderBy(F.xxhash64("id"), "id").collect()
    empty = [r["toxic"] for r in rows if not r["terms"]]
    some = [r for r in rows if r["terms"]]
    # Toxic and clean examples lie together in blocks, so that block maxima differ.
    some.sort(key=lambda r: (tuple(r["terms"][:4]), r["id"]))
    vectors = [(np.array(r["terms"], np.int64), np.array(r["counts"])) for r in some]
    rate = (sum(empty) + base) / (len(empty) + 1)
    parts = (terms, idf, vectors, [r["toxic"] for r in some], rate)
    index = BlockMaxIndex(*parts)
    curve = None
    if vectors and 0 < base < 1:
        curve = logistic(np.array([index.raw(v, without=i)[0] for i, v in enumerate(vectors)]), index.labels)
    return f"toxic-{uuid.uuid4().hex}", docs.sparkSession.sparkContext.broadcast((*parts, curve))


def score_texts(df: DataFrame, docs: DataFrame, labels: DataFrame, keep: list[str]) -> DataFrame:
    """Columns `keep` of df and, for its column `body`: score, votes (toxic ones among the neighbours), nearest, cosine."""
    key, sent = fit(docs, labels)

    def make():
        def step(texts):
            index = cached(key, sent, lambda parts: BlockMaxIndex(*parts))
            scores, votes, found, cosines = [], [], [], []
            for vector in index.reader.read(texts):
                s, near, cosine = index.score(vector)
                scores.append(s)
                votes.append(int(index.labels[near].sum()) if len(near) else 0)
                found.append(len(near))
                cosines.append(float(cosine[0]) if len(near) else 0.0)
            return [scores, votes, found, cosines]
        return step
    return map_texts(df, make, "score double, toxic_votes bigint, neighbours bigint, nearest_cosine double", keep)


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted and the evidence behind the score."""
    out = score_texts(documents(docs), docs, labels, ["id"])
    return out.select(F.col("id").alias("doc_id"), F.coalesce(held_out(F.col("id")), F.lit(False)).alias("held_out"), "score",
                      (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "toxic_votes", "neighbours",
                      "nearest_cosine")


def stage(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents below the threshold, unchanged."""
    out = score_texts(rows_of(docs).select("row", "body"), docs, labels, ["row"])
    return with_text(out.where(F.col("score") < THRESHOLD).withColumn("body", F.col("row.text")), docs.columns)
