"""Periodic runs of words by grammar compression (Re-Pair), and texts with their repetitions collapsed.

A run is a maximal stretch of words with smallest period q whose length is at least max(6, 4 q). A task takes a slice of
documents, numbers the words and works on arrays:

1. A pair of neighbouring words inside a run occurs at least three times in its document, so texts are cut at rarer
   pairs, again and again until nothing changes; only stretches of six words and more go on.
2. Re-Pair in rounds: a round counts the pairs of symbols of each document and replaces, most frequent first, every
   occurrence of a repeated pair that does not overlap one of a more frequent pair. A pair gets one nonterminal in the
   whole slice, so copies share their rules. The rounds end when no document repeats a pair; the symbols left are
   joined by a balanced tree, whose nodes are the rest of the grammar.
3. A run lies in the expansion of a lowest nonterminal and so crosses the boundary between its two halves. Each
   boundary is searched once, at the first place of its nonterminal: for every period up to a quarter of the expansion,
   two periods of the run lie on one side of the boundary, where words a period apart must agree.
4. Runs whose period is no power of a shorter one are translated to all places at which their nonterminal was made, and
   pieces of one period that share a period's length are merged to maximal intervals.

Documents are not shuffled, so no key can be hot; memory follows a slice or the longest text. Every run is found.

Defined cases: null and blank texts have no words, no runs and the digest of nothing; equal rows get equal results; ties
of the greatest exponent go to the smaller start, then the smaller period; an empty table gives no rows; other columns
are ignored.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from itertools import count

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import documents, map_texts

LEAST = 6
TIMES = 4
PROBE = 8
CHUNK = 1 << 21
RUNS = ("n_runs bigint, start bigint, length bigint, period bigint, exponent_milli bigint, runs_sha256 string, "
        "collapsed_sha256 string")


def heavy_stretches(ids: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Mask of the positions whose pair with the next word may lie in a run (never wrong about one that does)."""
    n = len(ids)
    ok = np.zeros(n, bool)
    if n < LEAST:
        return ok
    ok[:-1] = doc[1:] == doc[:-1]
    key = ((ids[:-1] * np.int64(0x9E3779B1) + ids[1:]) * np.int64(0x85EBCA6B) + doc[:-1] * np.int64(0xC2B2AE35))
    key = (key ^ (key >> 29)) & ((1 << 23) - 1)
    key = np.append(key, 0)
    left = int(ok.sum())
    while left:
        at = np.flatnonzero(ok)
        # Buckets may be shared, which only keeps more; the rounds shrink the table's load.
        counts = np.bincount(key[at], minlength=1 << 23) if len(at) > 1 << 16 else None
        if counts is not None:
            times = counts[key[at]]
        else:
            _, where, counts = np.unique(key[at], return_inverse=True, return_counts=True)
            times = counts[where]
        ok[at[times < 3]] = False
        edges = np.flatnonzero(np.diff(np.concatenate(([0], ok.view(np.int8), [0]))))
        starts, ends = edges[::2], edges[1::2]
        short = ends - starts < LEAST - 1
        delta = np.zeros(n + 1, np.int32)
        delta[starts[short]] = 1
        delta[ends[short]] -= 1
        ok &= np.cumsum(delta[:-1]) == 0
        now = int(ok.sum())
        if now == left:
            break
        left = now
    return ok


class Grammar:
    """Boundaries (lo, mid, hi) on the word array and the places of each nonterminal."""

    def __init__(self, ids: np.ndarray, doc: np.ndarray, part: np.ndarray):
        """ids, doc and part (the stretch) of each word; symbols never span two stretches."""
        self.lo, self.mid, self.hi, self.rule, self.start = [], [], [], [], []
        self.rules = 0
        self._compress(ids.astype(np.int64), doc.astype(np.int64), part)

    def _note(self, first: np.ndarray, middle: np.ndarray, end: np.ndarray, rule: np.ndarray, start: np.ndarray) -> None:
        self.lo.append(first)
        self.mid.append(middle)
        self.hi.append(end)
        self.rule.append(rule)
        self.start.append(start)

    def _compress(self, symbol: np.ndarray, doc: np.ndarray, part: np.ndarray) -> None:
        begin = np.arange(len(symbol), dtype=np.int64)
        end = begin + 1
        fresh = int(symbol.max(initial=0)) + 1
        while len(symbol) > 1:
            joined = part[1:] == part[:-1]
            same = np.append(joined & (symbol[1:] == symbol[:-1]), False)
            # In a row of one symbol, pairs start at every second place, so they don't overlap each other.
            head = np.concatenate(([True], ~same[:-1]))
            place = np.arange(len(symbol))
            odd = (place - np.maximum.accumulate(np.where(head, place, 0))) % 2 == 1
            usable = joined & ~(same[:-1] & odd[:-1])
            at = np.flatnonzero(usable)
            if not len(at):
                break
            pair = symbol[at] << 32 | symbol[at + 1]
            _, code = np.unique(pair, return_inverse=True)
            _, where, counts = np.unique(doc[at] << 32 | code, return_inverse=True, return_counts=True)
            times = counts[where]
            again = times > 1
            if not again.any():
                break
            # Rank: more frequent first, then by pair; an occurrence is replaced if no neighbour ranks above it.
            rank = np.full(len(symbol) + 1, -1, np.int64)
            rank[at[again]] = times[again] << 32 | code[again]
            here = rank[at[again]]
            before, after = rank[at[again] - 1], rank[at[again] + 1]
            chosen = at[again][(here > before) & (here > after)]
            names, first, rule = np.unique(symbol[chosen] << 32 | symbol[chosen + 1], return_index=True, return_inverse=True)
            self._note(begin[chosen[first]], begin[chosen[first] + 1], end[chosen[first] + 1], self.rules + rule, begin[chosen])
            self.rules += len(names)
            symbol[chosen] = fresh + rule
            fresh += len(names)
            end[chosen] = end[chosen + 1]
            keep = np.ones(len(symbol), bool)
            keep[chosen + 1] = False
            symbol, doc, part, begin, end = symbol[keep], doc[keep], part[keep], begin[keep], end[keep]
        # The symbols left: a balanced tree over each stretch, every node at one place.
        while len(part) > 1:
            first = np.concatenate(([True], part[1:] != part[:-1]))
            place = np.arange(len(part))
            odd = (place - np.maximum.accumulate(np.where(first, place, 0))) % 2 == 1
            right = np.flatnonzero(odd)
            if not len(right):
                break
            rule = self.rules + np.arange(len(right))
            self._note(begin[right - 1], begin[right], end[right], rule, begin[right - 1])
            self.rules += len(right)
            end[right - 1] = end[right]
            keep = ~odd
            part, begin, end = part[keep], begin[keep], end[keep]


def _forward(w: np.ndarray, a: int, b: int, stop: int) -> int:
    """Number of equal words from a and b on, b < stop."""
    n, size = 0, 64
    while b + n < stop:
        size = min(size, stop - b - n)
        differ = np.flatnonzero(w[a + n:a + n + size] != w[b + n:b + n + size])
        if len(differ):
            return n + int(differ[0])
        n, size = n + size, size * 4
    return n


def _backward(w: np.ndarray, a: int, b: int, stop: int) -> int:
    """Number of equal words before a and b, a > stop."""
    n, size = 0, 64
    while a - n > stop:
        size = min(size, a - n - stop)
        differ = np.flatnonzero(w[a - n - size:a - n] != w[b - n - size:b - n])
        if len(differ):
            return n + size - 1 - int(differ[-1])
        n, size = n + size, size * 4
    return n


def _candidates(w: np.ndarray, lo: np.ndarray, mid: np.ndarray, hi: np.ndarray):
    """(boundary, period) pairs with a probe of equal words on one side, boundary by boundary, periods ascending."""
    periods = (hi - lo) // TIMES
    ends = np.cumsum(periods)
    at = 0
    while at < len(lo):
        upto = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + CHUNK, "right")))
        total = int(ends[upto - 1] - (ends[at - 1] if at else 0))
        # A single boundary may have more periods than a chunk; it is cut, too.
        for low in range(0, total, CHUNK) if upto == at + 1 else (0,):
            size = min(CHUNK, total - low) if upto == at + 1 else total
            which = np.full(size, at) if upto == at + 1 else np.repeat(np.arange(at, upto), periods[at:upto])
            q = (low + 1 + np.arange(size) if upto == at + 1 else
                 np.arange(size) - np.repeat(ends[at:upto] - periods[at:upto] - (ends[at - 1] if at else 0), periods[at:upto]) + 1)
            right, left = np.arange(size), np.arange(size)
            for k in range(PROBE):
                m, p = mid[which[right]], q[right]
                fits = m + p + np.minimum(k, p - 1) < hi[which[right]]
                right, m, p = right[fits], m[fits], p[fits]
                step = np.minimum(k, p - 1)
                right = right[w[m + step] == w[m + p + step]]
                m, p = mid[which[left]], q[left]
                fits = m - 1 - p - np.minimum(k, p - 1) >= lo[which[left]]
                left, m, p = left[fits], m[fits], p[fits]
                step = np.minimum(k, p - 1)
                left = left[w[m - 1 - step] == w[m - 1 - p - step]]
            found = np.union1d(right, left)
            yield which[found], q[found], np.isin(found, right, assume_unique=True), np.isin(found, left, assume_unique=True)
        at = upto


def primitive(word: np.ndarray) -> bool:
    """Whether the word is no power of a shorter one."""
    n = rest = len(word)
    f = 2
    while rest > 1:
        if f * f > rest:
            f = rest
        if rest % f == 0:
            d = n // f
            if np.array_equal(word[d:], word[:n - d]):
                return False
            while rest % f == 0:
                rest //= f
        f += 1
    return True


def boundary_runs(w: np.ndarray, lo: np.ndarray, mid: np.ndarray, hi: np.ndarray) -> list[tuple[int, int, int, int]]:
    """(boundary, start, end, period): runs inside [lo, hi) that cross mid; an end at lo or hi may be a cut."""
    out: list[tuple[int, int, int, int]] = []
    seen: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
    for which, q, right, left in _candidates(w, lo, mid, hi):
        for i in np.unique(which).tolist():
            mine = np.flatnonzero(which == i) if len(which) < 64 else np.arange(*np.searchsorted(which, [i, i + 1]))
            m, a, b = int(mid[i]), int(lo[i]), int(hi[i])
            p, r, l = q[mine], right[mine].copy(), left[mine].copy()
            # A multiple of a known run's period gives nothing new while it stays within that run.
            for s, e, t in seen[i]:
                r &= ~((p % t == 0) & (m + p <= e))
                l &= ~((p % t == 0) & (m - p >= s))
            k = 0
            while len(todo := np.flatnonzero((r | l)[k:])):
                k += int(todo[0])
                x = int(p[k])
                hits = set()
                if r[k] and m + 2 * x <= b and _forward(w, m, m + x, m + 2 * x) == x:
                    hits.add((m - _backward(w, m, m + x, a), m + 2 * x + _forward(w, m + x, m + 2 * x, b)))
                # Two runs of one period may meet here, each with its two periods on another side.
                if l[k] and m - 2 * x >= a and _backward(w, m - x, m, m - 2 * x) == x:
                    hits.add((m - 2 * x - _backward(w, m - 2 * x, m - x, a), m + _forward(w, m - x, m, b)))
                k += 1
                for s, e in hits:
                    if e - s >= max(LEAST, TIMES * x):
                        if primitive(w[s:s + x]):
                            out.append((i, s, e, x))
                        seen[i].append((s, e, x))
                        r[k:] &= ~((p[k:] % x == 0) & (m + p[k:] <= e))
                        l[k:] &= ~((p[k:] % x == 0) & (m - p[k:] >= s))
    return out


def all_runs(ids: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Rows (document, start, end, period) of all runs, positions in the whole array, sorted by start, then period."""
    empty = np.zeros((0, 4), np.int64)
    ok = heavy_stretches(ids, doc)
    if not ok.any():
        return empty
    inside = ok.copy()
    inside[1:] |= ok[:-1]
    origin = np.flatnonzero(inside)
    # A stretch ends where the pair with the next word is not kept.
    part = np.cumsum(np.concatenate(([0], ~ok[origin[:-1]]))).astype(np.int64)
    w = ids[origin].astype(np.int64)
    g = Grammar(w.copy(), doc[origin], part)
    if not g.rules:
        return empty
    lo, mid, hi = (np.concatenate(x) for x in (g.lo, g.mid, g.hi))
    rule, start = np.concatenate(g.rule), np.concatenate(g.start)
    large = np.flatnonzero(hi - lo >= LEAST)
    found = boundary_runs(w, lo[large], mid[large], hi[large])
    if not found:
        return empty
    found = np.array(found, np.int64)
    found[:, 0] = large[found[:, 0]]
    order = np.argsort(rule, kind="stable")
    first, last = (np.searchsorted(rule[order], found[:, 0], side) for side in ("left", "right"))
    times = last - first
    take = np.repeat(np.arange(len(found)), times)
    where = start[order[np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times) + np.repeat(first, times)]]
    shift = where - lo[found[take, 0]]
    rows = np.stack([part[where], found[take, 3], found[take, 1] + shift, found[take, 2] + shift], 1)
    rows = rows[np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))]
    merged: list[list[int]] = []
    for s, q, a, b in rows.tolist():
        if merged and merged[-1][:2] == [s, q] and a <= merged[-1][3] - q:
            merged[-1][3] = max(merged[-1][3], b)
        else:
            merged.append([s, q, a, b])
    out = [(int(doc[origin[a]]), int(origin[a]), int(origin[a]) + b - a, q) for _, q, a, b in merged]
    return np.array(sorted(out, key=lambda r: (r[1], r[3])), np.int64).reshape(-1, 4)


def report(texts: list[bytes], plants: list) -> list[list]:
    """The columns of RUNS; a plant (h, or None) makes the words periodic from a place on as the query's contract says."""
    names: dict[bytes, int] = defaultdict(count().__next__)
    words, arrays = [], []
    for t, h in zip(texts, plants, strict=True):
        w = t.split()
        x = np.fromiter(map(names.__getitem__, w), np.int64, len(w))
        if h is not None and w:
            a = h // 10 % len(w)
            p = 1 + (len(w) - a) // (3 + h // 10 % 8)
            index = np.concatenate((np.arange(a), a + np.arange(len(w) - a) % p))
            x, w = x[index], [w[i] for i in index]
        words.append(w)
        arrays.append(x)
    sizes = np.array([len(w) for w in words], np.int64)
    doc, base = np.repeat(np.arange(len(texts)), sizes), np.cumsum(sizes) - sizes
    runs = defaultdict(list)
    for d, a, b, q in all_runs(np.concatenate(arrays) if arrays else np.zeros(0, np.int64), doc).tolist():
        runs[d].append((a - int(base[d]), b - a, q))
    out: list[list] = [[] for _ in range(7)]
    for i, w in enumerate(words):
        mine, best = runs.get(i, []), None
        for r in mine:
            # Exact comparison of length / period; earlier rows win ties.
            if best is None or r[1] * best[2] > best[1] * r[2]:
                best = r
        kept = w
        if mine:
            gone = np.zeros(len(w) + 1, np.int64)
            for a, n, q in mine:
                gone[a + q] += 1
                gone[a + n] -= 1
            kept = [w[k] for k in np.flatnonzero(np.cumsum(gone[:-1]) == 0)]
        lines = "".join(f"{a},{n},{q}\n" for a, n, q in mine)
        row = [len(mine), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None,
               hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(b" ".join(kept)).hexdigest()]
        for column, value in zip(out, row, strict=True):
            column.append(value)
    return out


def planted() -> Column:
    """CRC-32 of the decimal doc_id where it is a multiple of ten, null elsewhere."""
    h = F.crc32(F.col("id").cast("string"))
    return F.when(h % 10 == 0, h)


def find_runs(docs: DataFrame, plant: Column | None = None) -> DataFrame:
    """Per row: doc_id and RUNS. `plant` is an expression over id and body, null where a text is taken as it is."""
    rows = documents(docs).withColumn("plant", F.lit(None).cast("long") if plant is None else plant)

    def make():
        return lambda texts, plants: report(texts, plants.to_pylist())
    return map_texts(rows, make, RUNS, ["id"], also=["plant"]).withColumnRenamed("id", "doc_id")
