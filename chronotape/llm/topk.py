"""Exact top-k search by inner product: an impact-ordered index read score at a time.

Vectors become integers floor(256 * x). Candidates are dealt into blocks by hash; a block's index has, for each
dimension, posting segments of candidates with one quantised value (steps of STEP). A query orders the segments by the
largest gain that they can bring over the dimension's smallest one and reads them in rounds. After each round a candidate
lies between what it has gained and that plus the best that unread segments and quantisation could add; a candidate
whose upper bound is below the k-th lower bound is out. When few possible members are left (or all segments are read)
they are rescored exactly. Nothing is dropped without that proof.

Queries and candidates meet block by block (each query block with each candidate block); a block's answer is at most k
rows a query, merged with a partial top-k before the last exchange. Block counts follow row counts, so no task grows.

Defined cases: a null vector, or one with a null or non-finite component, takes no part; rows repeated as a whole count
once; rows of the query's own vec_id are no candidates; of vectors with different lengths the missing components count
as zero; sums are exact while they stay below 2**63; ties go to the smaller vec_id; an empty table gives an empty
result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import ship

STEP = 32
CANDIDATES, QUERIES = 8_192, 1_024
ROUNDS = 8
SCHEMA = "query_id bigint, vec_id bigint, score bigint"


class ImpactIndex:
    """Posting segments of one block: per dimension, candidates in order of their quantised value."""

    def __init__(self, vectors: np.ndarray):
        self.vectors, (n, dims) = vectors, vectors.shape
        starts, sizes, dim, low, high, posts = [], [], [], [], [], []
        for d in range(dims):
            column = vectors[:, d]
            order = np.argsort(column, kind="stable").astype(np.int32)
            value = column[order]
            cut = np.flatnonzero(np.diff(value // STEP)) + 1
            first = np.concatenate([[0], cut]).astype(np.int64)
            last = np.concatenate([cut, [n]]).astype(np.int64)
            starts.append(first + d * n)
            sizes.append(last - first)
            dim.append(np.full(len(first), d))
            low.append(value[first])
            high.append(value[last - 1])
            posts.append(order)
        join = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
        self.starts, self.sizes, self.dim, self.low, self.high, self.posts = map(join, (starts, sizes, dim, low, high, posts))
        self.dims, self.n = dims, n

    def search(self, query: np.ndarray, k: int, out: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The members of the top k by exact score (and all ties with the last), `out` marking rows that don't count."""
        q = query[self.dim]
        best, least = np.where(q > 0, q * self.high, q * self.low), np.where(q > 0, q * self.low, q * self.high)
        base = np.full(self.dims, np.iinfo(np.int64).max)
        np.minimum.at(base, self.dim, least)
        gain, sure = best - base[self.dim], least - base[self.dim]
        order = np.argsort(-gain, kind="stable")
        rounds = np.searchsorted(np.cumsum(self.sizes[order]), np.arange(1, ROUNDS) * self.n * self.dims / ROUNDS)
        slack = np.zeros(self.dims)
        np.maximum.at(slack, self.dim, (gain - sure).astype(float))
        slack, got = slack.sum(), np.zeros(self.n)
        got[out] = -np.inf
        members = np.flatnonzero(~out)
        for a, b in zip([0, *rounds], [*rounds, len(order)], strict=True):
            segments = order[a:b]
            if len(segments):
                size = self.sizes[segments]
                ids = np.concatenate([self.posts[s:s + m] for s, m in zip(self.starts[segments], size, strict=True)])
                got += np.bincount(ids, np.repeat(sure[segments].astype(float), size), self.n)
            if len(members) <= k:
                break
            rest = np.zeros(self.dims)
            np.maximum.at(rest, self.dim[order[b:]], gain[order[b:]].astype(float))
            floor = np.partition(got[members], -k)[-k]
            members = np.flatnonzero((got + slack + rest.sum() >= floor) & ~out)
            if len(members) <= max(4 * k, self.n // 64):
                break
        scores = self.vectors[members] @ query
        if len(members) > k:
            top = scores >= np.partition(scores, -k)[-k]
            members, scores = members[top], scores[top]
        return members, scores


def _matrix(column, width: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lengths = np.diff(np.asarray(column.offsets))
    out = np.zeros((len(column), width), np.int64)
    out[np.repeat(np.arange(len(column)), lengths), np.concatenate([np.arange(n) for n in lengths] or [[]]).astype(int)] = \
        column.flatten().to_numpy()
    return out


def search_block(k: int):
    def run(_, queries: pa.Table, candidates: pa.Table) -> pa.Table:
        width = max([0, *[len(x) for t in (queries, candidates) for x in t.column("v").to_pylist()]])
        q, c = _matrix(queries.column("v"), width), _matrix(candidates.column("v"), width)
        ids, index = candidates.column("vec_id").to_numpy(), ImpactIndex(c)
        found = [[], [], []]
        if len(c) and len(q):
            for own, vector in zip(queries.column("vec_id").to_numpy(), q, strict=True):
                members, scores = index.search(vector, k, ids == own)
                best = np.lexsort((ids[members], -scores))[:k]
                for x, y in zip(found, (np.full(len(best), own), ids[members][best], scores[best]), strict=True):
                    x.append(y)
        flat = [np.concatenate(x).astype(np.int64) if x else np.zeros(0, np.int64) for x in found]
        return pa.table(flat, names=["query_id", "vec_id", "score"])
    return run


def quantised(embeddings: DataFrame) -> DataFrame:
    good = F.col("embedding").isNotNull() & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x.cast("double"))
                                                     & (F.abs(x.cast("double")) < float("inf")))
    whole = F.transform("embedding", lambda x: F.floor(x.cast("double") * 256).cast("bigint"))
    return embeddings.where(good & F.col("vec_id").isNotNull()).select(F.col("vec_id").cast("bigint").alias("vec_id"),
                                                                       whole.alias("v")).distinct()


def top_k(embeddings: DataFrame, k: int = 5, every: int = 50) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best rows for each row whose vec_id is divisible by `every`."""
    ship(embeddings.sparkSession)
    rows = quantised(embeddings)
    asked = F.pmod("vec_id", F.lit(every)) == 0
    n, m = rows.select(F.count(F.lit(1)), F.count(F.when(asked, 1))).first()
    n_c, n_q = 1 + n // CANDIDATES, 1 + m // QUERIES
    deal = lambda blocks: F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int")
    every_block = lambda blocks: F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    queries = rows.where(asked).select("vec_id", "v", deal(n_q).alias("qb"), every_block(n_c).alias("cb"))
    candidates = rows.select("vec_id", "v", deal(n_c).alias("cb"), every_block(n_q).alias("qb"))
    found = queries.groupBy("cb", "qb").cogroup(candidates.groupBy("cb", "qb")).applyInArrow(search_block(k), SCHEMA)
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return (found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
            .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"))


ORACLE = """
WITH v AS (SELECT DISTINCT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
  AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
e AS (SELECT vec_id, unnest(v) AS x, unnest(range(len(v))) AS d FROM v),
p AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(sum(q.x * c.x) AS BIGINT) AS score FROM e q JOIN e c ON c.d = q.d
  AND q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id GROUP BY q.vec_id, c.vec_id)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (SELECT *, row_number() OVER
  (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM p) WHERE rank <= 5
"""
