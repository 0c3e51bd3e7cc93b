"""SimHash near-duplicates: a Gray-ordered hierarchical index in each bucket of a pigeonhole scheme.

Each text gets a 64-bit fingerprint of its word shingles. Equal fingerprints collapse to one vertex, the smallest doc_id.
Two fingerprints that differ in at most `bits` bits agree in at least one of bits + 1 blocks, so every distinct
fingerprint goes to that many buckets (block, value). In a bucket, fingerprints are sorted by Gray rank and packed into a
tree: a node keeps the bits on which all its members agree and that its parent doesn't have yet. A search carries the
differences found so far down the tree, drops a whole group when they exceed the limit, accepts a whole group when even
its free bits can't exceed it, and skips a group that is already in the searcher's component. A bucket gives a spanning
forest (fewer links than fingerprints), never all pairs. A bucket of more than BUCKET fingerprints is cut into slices;
each pair of slices is a task of its own, so no task holds an unbounded bucket. The links of all buckets are joined
into components by distributed star steps.

The pipeline's stage asks for Jaccard similarity, which no bit limit decides. It uses the same index for candidates only: wider
fingerprints over distinct shingles, a wider limit and more blocks. What the trees of all buckets connect is a group; its members
are compared once, with their texts, and only pairs whose exact shingle sets reach the similarity are linked.

Defined cases: null or empty text has no words and fingerprint zero, linked like any other; repeated rows share a
component; a null doc_id never names a component unless no other id is reachable (then null); an empty table gives an
empty result.
"""

from __future__ import annotations

from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut_lineage, documents, map_texts, rows_of, ship, with_text
from .components import components

BUCKET = 20_000
FAN = 8
#: Searches run in chunks that double; what the first ones link, later ones skip.
FIRST, CHUNK = 64, 4_096
NO_ID = 2**63 - 1
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)
#: The bits of a byte as the eight bytes of a number, and how many of them a byte can count.
_SPREAD, _PIECE = _BITS.astype(np.uint8).view(np.uint64).ravel(), 255


def _next_lane(hashes: np.ndarray) -> np.ndarray:
    hashes = (hashes ^ (hashes >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)
    return hashes ^ (hashes >> np.uint64(32))


def fingerprint(text: bytes, width: int, lanes: int = 1) -> list[int]:
    """Majority of the XXH64 (seed 42) bits over all word shingles; bytes.split takes just the six ASCII white spaces.

    Lane 0 is the plain fingerprint; further lanes take the bits of the same hashes after odd multiplications.
    """
    words = text.translate(_LOWER).split()
    if not words:
        return [0] * lanes
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    ends = list(accumulate(map(len, words), lambda a, n: a + 1 + n))
    starts = [0, *[e + 1 for e in ends]]
    hashes = np.array([digest(joined[a:b], 42) for a, b in zip(starts, ends[width - 1:] or ends[-1:])], np.uint64)
    out = []
    for lane in range(lanes):
        if lane:
            hashes = _next_lane(hashes)
        parts = hashes.view(np.uint8).reshape(-1, 8)
        ones = np.concatenate([np.bincount(parts[:, i], minlength=256) @ _BITS for i in range(8)])
        out.append(sum(1 << i for i in np.flatnonzero(2 * ones > len(hashes)).tolist()))
    return out


def fingerprints(df: DataFrame, width: int, keep: list[str], lanes: int = 1) -> DataFrame:
    """Columns `keep` of df and the fingerprint of its column `body`: signed 64-bit numbers f0, f1, ..."""
    def make():
        def step(texts):
            found = np.array([fingerprint(t, width, lanes) for t in texts], np.uint64).reshape(-1, lanes).view(np.int64)
            return [pa.array(np.ascontiguousarray(found[:, i])) for i in range(lanes)]
        return step
    return map_texts(df, make, ", ".join(f"f{i} bigint" for i in range(lanes)), keep)


def gray_rank(x: np.ndarray) -> np.ndarray:
    """Place of a bit pattern in the Gray sequence."""
    for s in (1, 2, 4, 8, 16, 32):
        x = x ^ (x >> np.uint64(s))
    return x


def _ones(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x).sum(axis=1, dtype=np.int64)


def links(fps: np.ndarray, group: np.ndarray, bits: int, same: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Spanning forest, as (row, root row), of rows of one group whose fingerprints differ in at most `bits` bits.

    fps: (rows, lanes) of unsigned 64-bit numbers. Rows of a group with equal `same` are connected already: only what connects
    more is returned.
    """
    n, lanes = fps.shape
    if not n:
        return np.zeros(0, int), np.zeros(0, int)
    order = np.lexsort((*[gray_rank(fps[:, i]) for i in range(lanes)][::-1], group))
    fps, group = fps[order], group[order]
    # Levels from the leaves up: AND and OR of the members, first child, first member, group.
    own = np.concatenate([[0], np.flatnonzero(np.diff(group)) + 1])
    levels = [(fps, fps, None, np.arange(n), group)]
    while len(levels[-1][0]) > len(own):
        low, high, _, first, g = levels[-1]
        m = len(low)
        begin = np.concatenate([[0], np.flatnonzero(np.diff(g)) + 1])
        place = np.arange(m) - np.repeat(begin, np.diff([*begin, m]))
        starts = np.flatnonzero(place % FAN == 0)
        levels.append((np.bitwise_and.reduceat(low, starts), np.bitwise_or.reduceat(high, starts), starts, first[starts],
                       g[starts]))
    label = np.arange(n)
    if same is not None:
        same = same[order]
        by = np.lexsort((same, group))
        new = np.flatnonzero(np.r_[True, (np.diff(group[by]) != 0) | (np.diff(same[by]) != 0)])
        label[by] = np.repeat(by[new], np.diff([*new, n]))
    alone = label == np.arange(n)
    root_of = np.repeat(np.arange(len(levels[-1][0])), np.diff([*levels[-1][3], n]))
    a, size = 0, FIRST
    while a < n:
        q = np.arange(a, min(n, a + size))
        a, size = a + size, min(2 * size, CHUNK)
        spans = [(np.minimum.reduceat(label, lv[3]), np.maximum.reduceat(label, lv[3])) for lv in levels]
        node, above, diff, left, right = root_of[q], np.zeros((len(q), lanes), np.uint64), np.zeros(len(q), np.int64), [], []
        for depth in range(len(levels) - 1, -1, -1):
            low, high, starts, first, _ = levels[depth]
            mask = ~(low[node] ^ high[node])
            diff = diff + _ones((fps[q] ^ low[node]) & mask & ~above)
            end = np.concatenate([first[1:], [n]])[node]
            least, most = spans[depth]
            keep = (diff <= bits) & (end > q + 1) & ~((least[node] == most[node]) & (least[node] == label[q]))
            whole = keep & (diff + 64 * lanes - _ones(mask) <= bits)
            left.append(q[whole])
            right.append(np.where(first[node] == q, end - 1, first[node])[whole])
            keep &= ~whole
            q, node, mask, diff = q[keep], node[keep], mask[keep], diff[keep]
            if not depth or not len(q):
                break
            many = np.diff([*starts, len(levels[depth - 1][0])])[node]
            step = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
            node = np.repeat(starts[node], many) + step
            q, above, diff = np.repeat(q, many), np.repeat(mask, many, axis=0), np.repeat(diff, many)
        x, y = np.concatenate(left), np.concatenate(right)
        while len(x):
            lx, ly = label[x], label[y]
            differ = lx != ly
            x, y, lx, ly = x[differ], y[differ], lx[differ], ly[differ]
            np.minimum.at(label, np.maximum(lx, ly), np.minimum(lx, ly))
            while (label[label] != label).any():
                label = label[label]
    moved = np.flatnonzero(alone & (label != np.arange(n)))
    return order[moved], order[label[moved]]


def _lanes(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c[0] == "f" and c[1:].isdigit()]


def _bucketed(vertices: DataFrame, blocks: int, bucket: int, carried: int | None = None, by: slice = slice(None)) -> DataFrame:
    """(f0.., rep, k): vertices (f0.., rep) in a task key k for each of `blocks` parts of the lanes `by`; the first `carried` lanes only."""
    ship(vertices.sparkSession)
    lanes = _lanes(vertices)
    edges = [round(64 * i / blocks) for i in range(blocks + 1)]
    keys = F.array(*[F.struct(F.lit(i * blocks + b).alias("block"), F.shiftrightunsigned(lane, edges[b]).bitwiseAND(
        F.lit(2**(edges[b + 1] - edges[b]) - 1)).alias("value")) for i, lane in list(enumerate(lanes))[by] for b in range(blocks)])
    kept = lanes[:carried]
    rows = vertices.select(*kept, "rep", F.explode(keys).alias("k")).select(*kept, "rep", "k.*")
    hot = rows.groupBy("block", "value").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > bucket)
    hot = cut_lineage(hot.select("block", "value", F.ceil(F.col("n") * 2 / bucket).cast("int").alias("slices")))
    rows = (rows.join(hot, ["block", "value"], "left").withColumn("slices", F.coalesce("slices", F.lit(1)))
            .withColumn("own", F.pmod(F.xxhash64(*kept), F.col("slices")).cast("int"))
            .withColumn("other", F.explode(F.expr("sequence(0, slices - 1)"))))
    # A task key is a hash of its bucket: two buckets that share it are only compared needlessly, never missed.
    return rows.select(*kept, "rep", F.xxhash64("block", "value", F.least("own", "other"), F.greatest("own", "other")).alias("k"))


def _forests(keyed: DataFrame, bits: int, merged: bool = False) -> DataFrame:
    """(k, u, v): the spanning forest of each task key, as links of a row to its root. `merged`: rows of one rep are connected."""
    lanes = _lanes(keyed)

    def run(batches):
        parts = list(batches)
        if not parts:
            return
        table = pa.Table.from_batches(parts)
        fps = np.stack([table.column(c).to_numpy() for c in lanes], 1).view(np.uint64)
        rep, key = table.column("rep").to_numpy(), table.column("k").to_numpy()
        i, j = links(fps, np.unique(key, return_inverse=True)[1], bits, rep if merged else None)
        yield pa.RecordBatch.from_arrays([pa.array(key[i]), pa.array(rep[i]), pa.array(rep[j])], names=["k", "u", "v"])

    return keyed.repartition("k").mapInArrow(run, "k bigint, u bigint, v bigint")


def near_links(vertices: DataFrame, bits: int, blocks: int, bucket: int = BUCKET) -> DataFrame:
    """(u, v) links that connect all vertices (f0.., rep) within `bits` bits that agree in one of `blocks` parts of a lane."""
    return _forests(_bucketed(vertices, blocks, bucket), bits).select("u", "v")


def near_groups(vertices: DataFrame, bits: int, blocks: int, carried: int, bucket: int = BUCKET) -> DataFrame:
    """(k, v): groups of vertices (f0.., rep) that hold, among others, each pair that agrees in one of `blocks` parts of a lane
    and differs in at most `bits` bits of the first `carried` lanes. No vertex is in two groups.

    The first lane's buckets connect nearly all; the others then give only the links between what is not connected yet, so many
    texts that are nearly alike don't come back from each bucket.
    """
    roots = components(_forests(_bucketed(vertices, blocks, bucket, carried, slice(0, 1)), bits).select("u", "v"))
    named = cut_lineage(vertices.join(roots, vertices["rep"] == roots["u"], "left").select(
        *_lanes(vertices), vertices["rep"].alias("member"), F.coalesce("root", "rep").alias("rep")))
    if len(_lanes(vertices)) > 1:
        found = _forests(_bucketed(named.drop("member"), blocks, bucket, carried, slice(1, None)), bits, merged=True)
        more = components(found.select("u", "v"))
        named = named.join(more, named["rep"] == more["u"], "left").select("member", F.coalesce("root", "rep").alias("rep"))
    named = cut_lineage(named.select(F.col("rep").alias("k"), F.col("member").alias("v")))
    return named.join(named.groupBy("k").agg(F.count(F.lit(1)).alias("m")).where("m > 1").select("k"), "k", "left_semi")


def bucket_groups(vertices: DataFrame, bits: int, blocks: int, carried: int, bucket: int = BUCKET) -> DataFrame:
    """Like `near_groups`, with smaller groups: those of each bucket, so a vertex is in up to as many as there are blocks."""
    found = _forests(_bucketed(vertices, blocks, bucket, carried), bits).withColumn("g", F.xxhash64("k", "v"))
    return found.select(F.col("g").alias("k"), F.explode(F.array("u", "v")).alias("v")).distinct()


def clusters(prints: DataFrame, bits: int, blocks: int) -> DataFrame:
    """Stored fingerprints (id, f0..) with their component."""
    lanes = _lanes(prints)
    vertices = cut_lineage(prints.groupBy(*lanes).agg(F.coalesce(F.min("id"), F.lit(NO_ID)).alias("rep")))
    roots = components(near_links(vertices, bits, blocks))
    named = cut_lineage(vertices.join(roots, vertices["rep"] == roots["u"], "left").select(
        *lanes, F.coalesce("root", "rep").alias("component")))
    return prints.join(named, lanes).withColumn("component", F.nullif("component", F.lit(NO_ID)))


def near_duplicates(docs: DataFrame, width: int = 4, bits: int = 4) -> DataFrame:
    """Digest per document: doc_id, fingerprint (16 hex digits), component_id; bits + 1 blocks miss no pair."""
    prints = cut_lineage(fingerprints(documents(docs), width, ["id"]))
    return clusters(prints, bits, bits + 1).select(
        F.col("id").alias("doc_id"), F.lpad(F.lower(F.hex("f0")), 16, "0").alias("fingerprint"),
        F.col("component").alias("component_id"))


#: Of the stage: word shingles and least Jaccard similarity (a fraction); lanes of a fingerprint, blocks per lane, bits that may
#: differ in the lanes a task gets. A pair of large sets at 0.8 differs in 15 % of the bits (the angle of its vectors): in 39 of
#: 256 +- 6, while unrelated pairs differ in 128 +- 8; it agrees in none of the 80 blocks with probability 3e-5.
STAGE_WIDTH, STAGE_NUM, STAGE_DEN, STAGE_LANES, STAGE_BLOCKS, STAGE_CARRIED, STAGE_BITS = 5, 4, 5, 16, 5, 4, 76
#: Shingles in one comparing task; a larger group is cut into slices that meet in pairs.
GROUP_SHINGLES = 1 << 20


def shingles(text: bytes, width: int) -> np.ndarray:
    """Distinct XXH64 (seed 42) hashes of the word shingles that `fingerprint` counts, in order."""
    words = text.translate(_LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    ends = list(accumulate(map(len, words), lambda a, n: a + 1 + n))
    starts = [0, *[e + 1 for e in ends]]
    return np.unique(np.array([digest(joined[a:b], 42) for a, b in zip(starts, ends[width - 1:] or ends[-1:])], np.uint64))


def signatures(sets: list[np.ndarray], lanes: int) -> np.ndarray:
    """(sets, lanes): fingerprints of sets of shingle hashes, each hash counted once. No set is empty."""
    hashes, sizes = np.concatenate(sets), np.array([len(s) for s in sets])
    # Bits are counted eight at a time in the bytes of one number, in pieces that no byte overflows.
    pieces = -(-sizes // _PIECE)
    first = np.cumsum(pieces) - pieces
    starts = np.repeat(np.cumsum(sizes) - sizes, pieces) + _PIECE * (np.arange(pieces.sum()) - np.repeat(first, pieces))
    out = np.zeros((len(sets), lanes), np.uint64)
    for lane in range(lanes):
        if lane:
            hashes = _next_lane(hashes)
        parts = hashes.view(np.uint8).reshape(-1, 8)
        ones = [np.add.reduceat(np.add.reduceat(_SPREAD[parts[:, i]], starts).view(np.uint8).reshape(-1, 8), first, axis=0, dtype=np.int64)
                for i in range(8)]
        major = 2 * np.concatenate(ones, axis=1) > sizes[:, None]
        out[:, lane] = np.packbits(major, axis=1, bitorder="little").view(np.uint64).ravel()
    return out


def similar(sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Spanning forest of the pairs whose exact Jaccard similarity is at least STAGE_NUM / STAGE_DEN."""
    sizes = np.array([len(s) for s in sets], np.int64)
    order = np.argsort(sizes, kind="stable")
    sizes, n = sizes[order], len(sets)
    # A partner has at most STAGE_DEN / STAGE_NUM times the shingles, so the partners after a row end here.
    ends = np.searchsorted(sizes * STAGE_NUM, sizes * STAGE_DEN, side="right")
    token, count = np.unique(np.concatenate([sets[i] for i in order]), return_inverse=True, return_counts=True)[1:]
    owner, known = np.repeat(np.arange(n), sizes), count[token] > 1
    token, owner = token[known], owner[known]
    edge = np.searchsorted(owner, np.arange(n + 1))
    by = np.argsort(token, kind="stable")
    posting, begin = owner[by], np.concatenate([[0], np.cumsum(np.bincount(token, minlength=len(count)))])
    label, out = np.arange(n), []
    for i in range(n):
        end = ends[i]
        if end <= i + 1 or (label[i + 1:end] == label[i]).all():
            continue
        mine = token[edge[i]:edge[i + 1]]
        many = begin[mine + 1] - begin[mine]
        at = np.arange(many.sum()) + np.repeat(begin[mine] - np.cumsum(many) + many, many)
        common = np.bincount(posting[at], minlength=n)[i + 1:end]
        near = common * STAGE_DEN >= (sizes[i] + sizes[i + 1:end] - common) * STAGE_NUM
        for j in (np.flatnonzero(near & (label[i + 1:end] != label[i])) + i + 1).tolist():
            if label[j] != label[i]:
                label[label == label[j]] = label[i]
                out.append((int(order[i]), int(order[j])))
    return out


def _sliced(groups: DataFrame) -> DataFrame:
    """Groups with n shingles: in how many slices each is compared, and how many shingles its tasks read."""
    return groups.withColumn("slices", F.when(F.col("n") > GROUP_SHINGLES, F.ceil(F.col("n") * 2 / GROUP_SHINGLES)).otherwise(1).cast("int")
                             ).withColumn("cost", F.col("n") * F.col("slices"))


def _members(vertices: DataFrame) -> DataFrame:
    """(task, v): vertices of one group of the index. A group too large for one task goes by the groups of its buckets, or is cut
    into slices that meet in pairs, whichever reads less."""
    named = vertices.where("n > 0").select(*_lanes(vertices), F.col("v").alias("rep"))
    how = STAGE_BITS, STAGE_BLOCKS, STAGE_CARRIED
    rows = cut_lineage(near_groups(named, *how).join(vertices.select("v", "n"), "v").select("k", "v", "n"))
    groups = cut_lineage(_sliced(rows.groupBy("k").agg(F.sum("n").alias("n"))))
    large = groups.where("slices > 1")
    if not large.isEmpty():
        part = cut_lineage(rows.join(large.select("k"), "k", "left_semi").withColumnRenamed("k", "whole"))
        inner = cut_lineage(bucket_groups(named.join(part.select(F.col("v").alias("rep")), "rep", "left_semi"), *how).join(part, "v"))
        # Groups with the same vertices are one.
        small = inner.groupBy("whole", "k").agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("n"),
                                                *[F.bit_xor(F.xxhash64("v", F.lit(i))).alias(f"x{i}") for i in range(2)]).where("m > 1")
        small = cut_lineage(_sliced(small.groupBy("whole", "m", "n", "x0", "x1").agg(F.min("k").alias("k"))))
        split = cut_lineage(small.groupBy("whole").agg(F.sum("cost").alias("parts")).join(
            large.select(F.col("k").alias("whole"), "cost"), "whole").where("parts < cost").select("whole"))
        kept = "k", "slices"
        groups = groups.join(split, groups["k"] == split["whole"], "left_anti").select(*kept).unionByName(
            small.join(split, "whole", "left_semi").select(*kept))
        rows = rows.join(split, rows["k"] == split["whole"], "left_anti").select("k", "v").unionByName(
            inner.join(split, "whole", "left_semi").select("k", "v"))
    dealt = (rows.select("k", "v").join(groups.select("k", "slices"), "k").withColumn("own", F.pmod(F.xxhash64("v"), F.col("slices")).cast("int"))
             .withColumn("other", F.explode(F.expr("sequence(0, slices - 1)"))))
    return dealt.select(F.xxhash64("k", F.least("own", "other"), F.greatest("own", "other")).alias("task"), "v")


def similar_links(vertices: DataFrame, rows: DataFrame) -> DataFrame:
    """(u, v) links of exact similarity that connect all vertices (v, n, f0.., id, mark) of a group; rows hold the texts."""
    members = cut_lineage(_members(vertices))
    asked = vertices.select("v", "id", "mark").join(members.select("v").distinct(), "v", "left_semi")
    texts = rows.select("id", "mark", "body").join(asked, ["id", "mark"]).groupBy("v").agg(F.first("body").alias("body"))

    def run(batches):
        task, names, sets = None, [], []

        def flush():
            pairs = similar(sets) if len(sets) > 1 else []
            return pa.RecordBatch.from_arrays([pa.array([names[i] for i, _ in pairs], pa.int64()),
                                               pa.array([names[j] for _, j in pairs], pa.int64())], names=["u", "v"])
        for batch in batches:
            body = batch.column("body")
            body = body.cast(pa.large_binary() if pa.types.is_large_string(body.type) else pa.binary())
            for t, v, x in zip(batch.column("task").to_pylist(), batch.column("v").to_pylist(), body, strict=True):
                if t != task:
                    yield flush()
                    task, names, sets = t, [], []
                names.append(v)
                sets.append(shingles(x.as_py(), STAGE_WIDTH))
        yield flush()

    met = members.join(texts, "v").select("task", "v", "body").repartition("task").sortWithinPartitions("task")
    return met.mapInArrow(run, "u bigint, v bigint")


def similar_classes(rows: DataFrame) -> DataFrame:
    """(v, id, mark, component) of the distinct shingle sets of rows (id, mark, body): id and mark of the first row."""
    def make():
        def step(texts):
            sets = [shingles(t, STAGE_WIDTH) for t in texts]
            some = np.array([len(s) > 0 for s in sets], bool)
            found = np.zeros((len(sets), STAGE_LANES), np.uint64)
            if some.any():
                found[some] = signatures([s for s in sets if len(s)], STAGE_LANES)
            found = found.view(np.int64)
            return [pa.array(np.array([xxhash.xxh3_64_intdigest(s.tobytes()) for s in sets], np.uint64).view(np.int64)),
                    pa.array(np.array([len(s) for s in sets], np.int64)),
                    *[pa.array(np.ascontiguousarray(found[:, i])) for i in range(STAGE_LANES)]]
        return step

    lanes = [f"f{i}" for i in range(STAGE_LANES)]
    prints = map_texts(rows, make, "v bigint, n bigint, " + ", ".join(f"{c} bigint" for c in lanes), ["id", "mark"])
    # Equal sets have equal fingerprints.
    vertices = cut_lineage(prints.groupBy("v", "n", *lanes).agg(F.min(F.struct("id", "mark")).alias("k")).select(
        "v", "k.*", "n", *lanes))
    roots = components(similar_links(vertices, rows))
    return vertices.select("v", "id", "mark").join(roots.withColumnRenamed("u", "v"), "v", "left").select(
        "v", "id", "mark", F.coalesce("root", "v").alias("component"))


def stage(docs: DataFrame) -> DataFrame:
    """One document of each group of near-duplicates, the one with the smallest doc_id (null only if there is no other).

    Groups are connected by pairs of Jaccard similarity 0.8 or more, found by SimHash fingerprints in the Gray-ordered index and
    each checked on the exact sets of shingle hashes.
    Rows that share this doc_id and text are repeated rows, of which one stays. Columns are those of `docs`.
    """
    rows = rows_of(docs).withColumn("id", F.coalesce("id", F.lit(NO_ID)))
    found = similar_classes(rows.select("id", "mark", "body"))
    stay = found.groupBy("component").agg(F.min(F.struct("id", "mark")).alias("k")).select("k.*")
    # Join and grouping share their keys, so texts are exchanged once.
    one = rows.join(stay, ["id", "mark"], "left_semi").groupBy("id", "mark").agg(F.first("row").alias("row"))
    return with_text(one.withColumn("body", F.col("row.text")), docs.columns)
