"""Suffix-array dedup: bytes covered by a 100-byte string that also starts earlier are removed.

Method: a Burrows-Wheeler transform of the repeated regions and breadth-first backward extension. Starting with the
interval of the empty string, every interval of rows with a common prefix w gives, for each symbol c before it, the end of
the interval of c + w; so ends are found by increasing common prefix. After LENGTH rounds the rows between two
ends share exactly LENGTH symbols, and the extension stops there: longer common prefixes are never looked at.

Distribution: every 100-byte string owns one anchor, the smallest hash among its 32-byte grams (leftmost on ties), so equal
strings have equal anchors. Neighbouring starts with one anchor form a run of at most 69 starts, whose context is
run + 99 bytes. Runs meet by anchor in hashed buckets, as packed arrays. Equal contexts collapse to their first run
(all starts of the others are repeats); an anchor with one context left is unique and drops out. What remains (the edges
of repeated regions) sends its contexts to the bucket of its anchor for the transform. Bucket counts follow the bytes of
the input; texts travel compressed.

Order: (doc_id, start); documents with one doc_id but different texts are ordered by a hash of the text.

Defined cases: null text is empty; texts under 100 bytes stay whole; repeated rows (same doc_id and text) are one document
and get equal results; a null doc_id comes first; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut_lineage, keyed, ship

LENGTH, GRAM = 100, 32
SPAN = LENGTH - GRAM + 1
BUCKET_BYTES = 4 << 20
SLICE = 4 << 20
#: A run: low bits of its anchor's hash (the bucket has more), hash of its context, its text (id, mark), first start, starts.
RUN = np.dtype([("anchor", "<u4"), ("context", "<u8"), ("id", "<i8"), ("mark", "<u4"), ("start", "<i4"), ("n", "u1")])
EDGE = np.dtype([("id", "<i8"), ("mark", "<u4"), ("start", "<i4"), ("n", "<i4")])
TEXT = np.dtype([("id", "<i8"), ("mark", "<u4")])
NO_ID = -2**63
PLACES = np.uint64((1 << 24) - 1)
STRETCH = 1 << 22
_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _ODD[0]
    return x ^ (x >> np.uint64(29))


def gram_hashes(text: np.ndarray) -> np.ndarray:
    """Hash of the GRAM bytes from each place, by doubling."""
    h, size = _mix(text.astype(np.uint64) + np.uint64(1)), 1
    while size < GRAM:
        h = _mix(h[:-size] * _ODD[1] + h[size:])
        size *= 2
    return h


def runs(h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first starts, numbers of starts, anchor places) of the runs of starts that own one anchor; h: gram hashes.

    The place in its lowest bits makes the leftmost of equal hashes the smallest.
    """
    starts = len(h) - SPAN + 1
    best, size = (h & ~PLACES) | np.arange(len(h), dtype=np.uint64), 1
    while 2 * size <= SPAN:
        best = np.minimum(best[:-size], best[size:])
        size *= 2
    best = np.minimum(best[:starts], best[SPAN - size:SPAN - size + starts])
    first = np.concatenate([[0], np.flatnonzero(np.diff(best)) + 1])
    return first, np.diff([*first, starts]), (best[first] & PLACES).astype(np.int64)


def runs_of(body: bytes, number: int, mark: int) -> tuple[np.ndarray, np.ndarray]:
    """RUN records of one text and the whole hashes of their anchors; long texts go in stretches."""
    text, records, anchors = np.frombuffer(body, np.uint8), [], []
    for at in range(0, len(text) - LENGTH + 1, STRETCH):
        h = gram_hashes(text[at:at + STRETCH + LENGTH - 1])
        first, count, anchor = runs(h)
        own = np.zeros(len(first), RUN)
        own["anchor"], own["id"], own["mark"], own["start"], own["n"] = h[anchor], number, mark, first + at, count
        # A context is known by the grams that cover it: every 32nd one, and the last.
        mixed, last = count.astype(np.uint64) * _ODD[3] + (anchor - first).astype(np.uint64), first + count - 1 + LENGTH - GRAM
        for k in range(0, SPAN + LENGTH, GRAM):
            mixed = _mix(mixed * _ODD[2] + h[np.minimum(first + k, last)])
        own["context"] = mixed
        records.append(own)
        anchors.append(h[anchor])
    return np.concatenate(records), np.concatenate(anchors)


def order_of(symbols: np.ndarray) -> np.ndarray:
    """Places sorted by their next 112 symbols (at least LENGTH); beyond the end there are zeros."""
    n = len(symbols)
    padded = np.concatenate([symbols.astype(np.int64), np.zeros(7, np.int64)])
    key = np.zeros(n, np.int64)
    for k in range(7):
        key = key << 9 | padded[k:k + n]
    order = np.argsort(key, kind="stable")
    fresh = np.concatenate([[True], np.diff(key[order]) != 0])
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
    h = 7
    while h < LENGTH:
        size = np.diff(np.append(np.flatnonzero(fresh), n))
        tied = np.flatnonzero(np.repeat(size > 1, size))
        if not len(tied):
            break
        places = order[tied]
        after = places + h
        second = np.where(after < n, rank[np.minimum(after, n - 1)] + 1, 0)
        inner = np.argsort(rank[places] * (n + 1) + second, kind="stable")
        places, second = places[inner], second[inner]
        old = rank[places]
        order[tied] = places
        new = np.concatenate([[True], (np.diff(old) != 0) | (np.diff(second) != 0)])
        fresh[tied] = new
        rank[places] = np.maximum.accumulate(np.where(new, tied, 0))
        h *= 2
    return order


def intervals(symbols: np.ndarray, order: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """Number of each row's interval of rows that share their next `length` symbols, by backward extension."""
    n = len(symbols)
    bwt = symbols[order - 1]  # the symbol before the first place is the last one, a separator
    by_symbol = np.argsort(bwt, kind="stable")
    to = np.empty(n, np.int64)
    to[by_symbol] = np.arange(n)
    same = np.full(n, n, np.int64)  # next row with the same symbol before it
    pairs = bwt[by_symbol][1:] == bwt[by_symbol][:-1]
    same[by_symbol[:-1][pairs]] = by_symbol[1:][pairs]
    is_end = np.zeros(n + 1, bool)
    is_end[[0, n]] = True
    new = np.array([n])
    for _ in range(length):
        ends = np.flatnonzero(is_end)
        begin = ends[np.searchsorted(ends, new) - 1]
        size = new - begin
        rows = np.repeat(begin, size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        last = rows[same[rows] >= np.repeat(new, size)]  # the last row of its symbol in the interval
        found = to[last] + 1
        new = np.unique(found[~is_end[found]])
        if not len(new):
            break
        is_end[new] = True
    return np.cumsum(is_end[:-1])


def repeated_starts(contexts: list[bytes], counts: np.ndarray, owner: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Flags per start (run after run): does its string also start earlier in (owner, place) order? owner: rank of the text."""
    if not contexts:
        return np.zeros(0, bool)
    raw = np.frombuffer(b"".join(c + b"\0" for c in contexts), np.uint8)
    size = np.fromiter(map(len, contexts), np.int64, len(contexts))
    ends = np.cumsum(size + 1) - 1
    symbols = raw.astype(np.int16) + 1
    symbols[ends] = 0
    base = ends - size
    order = order_of(symbols)
    group = np.empty(len(symbols), np.int64)
    group[order] = intervals(symbols, order)
    inner = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    place, text, start = np.repeat(base, counts) + inner, np.repeat(owner, counts), np.repeat(first, counts) + inner
    by = np.lexsort((start, text, group[place]))
    again = np.zeros(len(by), bool)
    again[by[1:]] = group[place][by][1:] == group[place][by][:-1]
    return again


def _rows(kind: int, parts: dict[int, np.ndarray]) -> list[tuple[int, int, bytes]]:
    return [(place, kind, a.tobytes()) for place, a in parts.items()]


ROWS = pa.schema([("part", pa.int32()), ("kind", pa.int32()), ("blob", pa.binary())])
DDL = "part int, kind int, blob binary"
#: What a blob holds.
TEXTS, RUNS, EDGES, CONTEXTS = range(4)


def _table(rows) -> pa.Table:
    rows = list(rows)
    return pa.table([pa.array([r[i] for r in rows], t) for i, t in enumerate(ROWS.types)], schema=ROWS)


def _blobs(table: pa.Table, kind: int) -> list[bytes]:
    return [b for k, b in zip(table.column("kind").to_pylist(), table.column("blob").to_pylist()) if k == kind]


def _split(records: np.ndarray, place: np.ndarray) -> dict[int, np.ndarray]:
    if not len(records):
        return {}
    by = np.argsort(place, kind="stable")
    cuts = np.flatnonzero(np.diff(place[by])) + 1
    return {int(place[p[0]]): records[p] for p in np.split(by, cuts)}


def _home(records: np.ndarray, parts: int) -> np.ndarray:
    """Part of a text: decided by its id and mark."""
    return (_mix(records["id"].astype(np.int64).view(np.uint64) + records["mark"].astype(np.uint64)) % np.uint64(parts)).astype(np.int64)


def _texts(batches):
    """Slices of (TEXT records, bodies) from record batches of (id, mark, body)."""
    keys, bodies, size = [], [], 0
    for b in batches:
        body = b.column("body")
        body = body.cast(pa.large_binary() if pa.types.is_large_string(body.type) else pa.binary())
        marks = b.column("mark").to_numpy().view(np.uint64) & np.uint64(0xFFFFFFFF)
        for key, t in zip(zip(b.column("id").to_pylist(), marks.tolist(), strict=True), body, strict=True):
            keys.append(key)
            bodies.append(t.as_py())
            size += len(bodies[-1])
            if size > SLICE:
                yield np.array(keys, TEXT), bodies
                keys, bodies, size = [], [], 0
    if keys:
        yield np.array(keys, TEXT), bodies


def pack_texts(texts: DataFrame, parts: int) -> DataFrame:
    """Whole texts, compressed and dealt by id and mark."""
    def run(batches):
        press = zstandard.ZstdCompressor().compress
        for keys, bodies in _texts(batches):
            rows = []
            for place, at in _split(np.arange(len(keys)), _home(keys, parts)).items():
                own = [bodies[i] for i in at]
                head = keys[at].tobytes() + np.array([len(x) for x in own], "<i8").tobytes()
                rows.append((place, TEXTS, len(own).to_bytes(8, "little") + head + press(b"".join(own))))
            yield from _table(rows).to_batches()

    return texts.mapInArrow(run, DDL)


def _unpack(blobs: list[bytes]):
    """(id, mark, body) of every packed text."""
    for blob in blobs:
        n = int.from_bytes(blob[:8], "little")
        edge = 8 + n * TEXT.itemsize
        keys, lengths = np.frombuffer(blob[8:edge], TEXT), np.frombuffer(blob[edge:edge + 8 * n], "<i8")
        body, at = zstandard.ZstdDecompressor().decompress(blob[edge + 8 * n:]), 0
        for (number, mark), size in zip(keys.tolist(), lengths.tolist(), strict=True):
            yield number, mark, body[at:at + size]
            at += size


def collect_runs(texts: DataFrame, buckets: int) -> DataFrame:
    """The runs of all texts, dealt by anchor."""
    def run(batches):
        for keys, bodies in _texts(batches):
            found = [runs_of(body, *key) for key, body in zip(keys.tolist(), bodies, strict=True) if len(body) >= LENGTH]
            if found:
                records, anchors = (np.concatenate(x) for x in zip(*found, strict=True))
                place = ((anchors >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)
                yield from _table(_rows(RUNS, _split(records, place))).to_batches()

    return texts.mapInArrow(run, DDL)


def sift(packed: DataFrame, parts: int) -> DataFrame:
    """Runs that repeat an earlier context (EDGES), and runs left to the transform (RUNS), dealt by text."""
    def run(key, table):
        r = np.frombuffer(b"".join(_blobs(table, RUNS)), RUN)
        r = r[np.lexsort((r["start"], r["mark"], r["id"], r["context"], r["anchor"]))]
        alike = (r["anchor"][1:] == r["anchor"][:-1]) & (r["context"][1:] == r["context"][:-1])
        # A repeated row of the same document is that document: only its first record counts.
        alone = np.ones(len(r), bool)
        alone[1:] = ~(alike & (r["id"][1:] == r["id"][:-1]) & (r["mark"][1:] == r["mark"][:-1]) & (r["start"][1:] == r["start"][:-1]))
        r = r[alone]
        same = np.zeros(len(r), bool)
        same[1:] = (r["anchor"][1:] == r["anchor"][:-1]) & (r["context"][1:] == r["context"][:-1])
        edges = np.zeros(int(same.sum()), EDGE)
        for c in EDGE.names:
            edges[c] = r[c][same]
        rest = r[~same]
        size = np.diff([0, *np.flatnonzero(np.diff(rest["anchor"]) != 0) + 1, len(rest)]) if len(rest) else np.zeros(0, int)
        rest = rest[np.repeat(size > 1, size)] if len(rest) else rest
        bucket = int(key[0].as_py())
        left = [(place, RUNS, bucket.to_bytes(4, "little") + a.tobytes()) for place, a in _split(rest, _home(rest, parts)).items()]
        return _table([*_rows(EDGES, _split(edges, _home(edges, parts))), *left])

    return packed.groupBy("part").applyInArrow(run, DDL)


def contexts_of(packed: DataFrame) -> DataFrame:
    """The runs left with their contexts, dealt by anchor again. packed: texts and sifted runs of each part."""
    def run(_, table):
        left = [(int.from_bytes(b[:4], "little"), np.frombuffer(b[4:], RUN)) for b in _blobs(table, RUNS)]
        if not left:
            return _table([])
        wanted = {(i, m) for _, r in left for i, m in zip(r["id"].tolist(), r["mark"].tolist(), strict=True)}
        body = {(i, m): t for i, m, t in _unpack(_blobs(table, TEXTS)) if (i, m) in wanted}
        press = zstandard.ZstdCompressor().compress
        return _table((bucket, CONTEXTS, len(r).to_bytes(8, "little") + r.tobytes() + press(b"".join(
            body[i, m][s:s + n + LENGTH - 1] for i, m, s, n in zip(*[r[c].tolist() for c in ("id", "mark", "start", "n")],
                                                                   strict=True)))) for bucket, r in left)

    return packed.groupBy("part").applyInArrow(run, DDL)


def transform(packed: DataFrame, parts: int) -> DataFrame:
    """Repeated stretches of starts found by backward extension, dealt by text."""
    def run(_, table):
        records, contexts = [], []
        for blob in _blobs(table, CONTEXTS):
            edge = 8 + int.from_bytes(blob[:8], "little") * RUN.itemsize
            r, body, at = np.frombuffer(blob[8:edge], RUN), zstandard.ZstdDecompressor().decompress(blob[edge:]), 0
            for n in r["n"].tolist():
                contexts.append(body[at:at + n + LENGTH - 1])
                at += n + LENGTH - 1
            records.append(r)
        if not records:
            return _table([])
        r = np.concatenate(records)
        keys = np.zeros(len(r), TEXT)
        keys["id"], keys["mark"] = r["id"], r["mark"]
        counts, first = r["n"].astype(np.int64), r["start"].astype(np.int64)
        again = repeated_starts(contexts, counts, np.unique(keys, return_inverse=True)[1], first)
        opens = np.cumsum(counts) - counts
        before = np.concatenate([[False], again[:-1]])
        before[opens] = False
        after = np.concatenate([again[1:], [False]])
        after[opens + counts - 1] = False
        a, b = np.flatnonzero(again & ~before), np.flatnonzero(again & ~after)
        owner = np.searchsorted(opens, a, side="right") - 1
        found = np.zeros(len(a), EDGE)
        found["id"], found["mark"] = r["id"][owner], r["mark"][owner]
        found["start"], found["n"] = first[owner] + a - opens[owner], b - a + 1
        return _table(_rows(EDGES, _split(found, _home(found, parts))))

    return packed.groupBy("part").applyInArrow(run, DDL)


def merge_spans(start: np.ndarray, n: np.ndarray) -> list[tuple[int, int]]:
    """Byte spans covered by the strings of repeated stretches, merged where they touch."""
    by = np.argsort(start, kind="stable")
    a, b = start[by].astype(np.int64), start[by].astype(np.int64) + n[by] + LENGTH - 1
    reach = np.maximum.accumulate(b)
    first = np.concatenate([[0], np.flatnonzero(a[1:] > reach[:-1]) + 1])
    return list(zip(a[first].tolist(), reach[np.append(first[1:], len(a)) - 1].tolist(), strict=True))


RESULT = ("doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, "
          "spans array<struct<start:bigint,end:bigint>>")


def cut(packed: DataFrame) -> DataFrame:
    """RESULT per text: what its repeated stretches remove. packed: texts and edges of each part."""
    def run(_, table):
        edges = np.frombuffer(b"".join(_blobs(table, EDGES)), EDGE)
        by = np.lexsort((edges["mark"], edges["id"]))
        edges = edges[by]
        new = np.flatnonzero((np.diff(edges["id"]) != 0) | (np.diff(edges["mark"].astype(np.int64)) != 0)) + 1
        own = {(int(e["id"][0]), int(e["mark"][0])): e for e in np.split(edges, new) if len(e)}
        out: list[list] = [[], [], [], [], [], []]
        for number, mark, body in _unpack(_blobs(table, TEXTS)):
            e = own.get((number, mark))
            spans = merge_spans(e["start"], e["n"]) if e is not None else []
            digest, at = hashlib.sha256(), 0
            for a, b in spans:
                digest.update(body[at:a])
                at = b
            digest.update(body[at:])
            for x, v in zip(out, (None if number == NO_ID else number, len(body), sum(b - a for a, b in spans), len(spans),
                                  digest.hexdigest(), [{"start": a, "end": b} for a, b in spans]), strict=True):
                x.append(v)
        kinds = [pa.int64()] * 4 + [pa.string(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))]
        names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"]
        return pa.table([pa.array(x, k) for x, k in zip(out, kinds, strict=True)], names=names)

    return packed.groupBy("part").applyInArrow(run, RESULT)


def find_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and the removed byte spans (end excluded)."""
    ship(docs.sparkSession)
    texts = keyed(docs).select(F.coalesce("id", F.lit(NO_ID)).alias("id"), "mark", "body")
    parts = 8 + int((texts.agg(F.sum(F.octet_length("body"))).first()[0] or 0) // BUCKET_BYTES)
    sifted = cut_lineage(sift(collect_runs(texts, parts), parts))
    left = sifted.where(F.col("kind") == RUNS)
    found = cut_lineage(transform(contexts_of(pack_texts(texts, parts).unionByName(left)), parts))
    return cut(pack_texts(texts, parts).unionByName(sifted.where(F.col("kind") == EDGES)).unionByName(found))
