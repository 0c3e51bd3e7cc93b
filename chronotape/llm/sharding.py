"""Sharding: a k-d tree over document metadata whose leaves hold (nearly) equal bytes.

Documents with equal texts form one group and stay together. A group is a weighted point (size in bytes) with four
metadata coordinates: size, source, language and smallest doc_id. The root holds all shards; a node with several
shards is split along its widest dimension at the weighted quantile that gives each side the bytes of its shards, until
a leaf is one shard. Quantiles are distributed: a coordinate is 48 bits (16 of metadata, 32 of the text's hash, which
only breaks ties), and each pass sums bytes in 4,096 bins of the next 12 bits of the straddling bin. The driver
sees at most (shards x 4,096) sums per pass.

Groups heavier than 1/200 of a shard (so fewer than 200 x shards of them) are placed first, largest to the emptiest
shard, and the tree shares out the rest so that shards fill up to one level. A group larger than a shard can't be
split: it has a shard of its own.

Defined cases: null text counts as empty (size 8) and equals it; null source, lang or doc_id have fixed coordinates;
repeated rows are documents of one group, each with its own slot; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut_lineage

DIMENSIONS = ("c_size", "c_source", "c_lang", "c_doc")
PASS_BITS, PASSES = 12, 4
SLOT_ROWS = 2_000


def sized(docs: DataFrame) -> DataFrame:
    body = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"),
                       F.col("source").cast("string").alias("source"),
                       (F.octet_length(body) + 8).cast("long").alias("size"), F.crc32(body).alias("text_crc32"),
                       F.md5(body).alias("grp"))


def groups_of(rows: DataFrame) -> DataFrame:
    """One weighted point per distinct text."""
    g = rows.groupBy("grp").agg(F.sum("size").alias("w"), F.first("size").alias("size"), F.min("source").alias("source"),
                                F.min("lang").alias("lang"), F.min("doc_id").alias("doc_id"))
    tie = F.conv(F.substring("grp", 1, 8), 16, 10).cast("long")
    point = lambda c: (F.greatest(F.lit(0), F.least(F.lit(65535), c)).cast("long") * 2**32 + tie)
    doc = F.coalesce("doc_id", F.lit(0))
    return g.select("grp", "w", point(F.log2(F.col("size").cast("double")) * 2048).alias("c_size"),
                    point(F.pmod(F.xxhash64(F.coalesce("source", F.lit(""))), F.lit(65536))).alias("c_source"),
                    point(F.pmod(F.xxhash64(F.coalesce("lang", F.lit(""))), F.lit(65536))).alias("c_lang"),
                    point(F.log2(F.abs(doc).cast("double") + 1) * 1040).alias("c_doc"))


def _assign(tree) -> str:
    """SQL expression that gives a point its node; a leaf is its number, a split is (dimension, cut, left, right)."""
    if isinstance(tree, int):
        return str(tree)
    d, cut, left, right = tree
    return f"CASE WHEN {d} < {cut}L THEN {_assign(left)} ELSE {_assign(right)} END"


def _replace(tree, new):
    if isinstance(tree, int):
        return new.get(tree, tree)
    d, cut, left, right = tree
    return (d, cut, _replace(left, new), _replace(right, new))


def _cuts(points: DataFrame, tree, wide: dict[int, str], want: dict[int, float], slack: float) -> dict[int, int]:
    """For each node, the coordinate that leaves about want[node] bytes below it."""
    prefix = {n: 0 for n in wide}     # the straddling bin so far
    below = {n: 0.0 for n in wide}    # bytes under that bin
    cuts: dict[int, int] = {}
    node = F.expr(_assign(tree))
    coordinate = F.expr("CASE " + " ".join(f"WHEN node = {n} THEN {d}" for n, d in wide.items()) + " END")
    base = points.withColumn("node", node).where(F.col("node").isin(list(wide))).select("node", coordinate.alias("c"), "w")
    for k in range(PASSES):
        shift = PASS_BITS * (PASSES - 1 - k)
        open_nodes = [n for n in wide if n not in cuts]
        if not open_nodes:
            break
        inside = F.expr(" OR ".join(f"(node = {n} AND shiftright(c, {shift + PASS_BITS}) = {prefix[n]}L)" for n in open_nodes))
        sums = (base.where(inside).groupBy("node", F.shiftright("c", shift).alias("bin")).agg(F.sum("w").alias("w"))
                .collect())
        bins: dict[int, list] = {n: [] for n in open_nodes}
        for r in sums:
            bins[r["node"]].append((r["bin"], float(r["w"])))
        for n in open_nodes:
            seen = below[n]
            for b, w in sorted(bins[n]):
                if seen + w >= want[n]:
                    if w <= slack or k == PASSES - 1:
                        cuts[n] = (b if want[n] - seen <= seen + w - want[n] else b + 1) << shift
                    else:
                        prefix[n], below[n] = b, seen
                    break
                seen += w
            else:
                cuts[n] = (max((b for b, _ in bins[n]), default=0) + 1) << shift
    return cuts


def build_tree(points: DataFrame, room: dict[int, float], slack: float):
    """Tree over the points; leaves are shards, room[shard] the bytes each should get."""
    shards = {1: [s for s in sorted(room) if room[s] > 0]}
    tree, next_node = 1, 2
    while any(len(s) > 1 for s in shards.values()):
        node = F.expr(_assign(tree))
        stats = {r["node"]: r for r in points.withColumn("node", node).groupBy("node").agg(
            *[(F.max(d) - F.min(d)).alias(d) for d in DIMENSIONS]).collect()}
        wide, want, half = {}, {}, {}
        for n, own in shards.items():
            if len(own) > 1:
                wide[n] = max(DIMENSIONS, key=lambda d: stats[n][d] if n in stats else 0)
                half[n] = len(own) // 2
                want[n] = sum(room[s] for s in own[:half[n]])
        cuts = _cuts(points, tree, wide, want, slack)
        new, split = {}, {n: s for n, s in shards.items() if len(s) == 1}
        for n in wide:
            left, right = next_node, next_node + 1
            next_node += 2
            new[n] = (wide[n], cuts.get(n, 0), left, right)
            split[left], split[right] = shards[n][:half[n]], shards[n][half[n]:]
        tree, shards = _replace(tree, new), split
    return _replace(tree, {n: s[0] for n, s in shards.items() if s})


def assign_groups(groups: DataFrame, n_shards: int) -> DataFrame:
    """(grp, shard) for stored groups."""
    total = groups.agg(F.sum("w")).first()[0] or 0
    target = total / n_shards
    limit = max(target / 200, 1)
    heavy = sorted(((r["w"], r["grp"]) for r in groups.where(F.col("w") > limit).select("w", "grp").collect()),
                   key=lambda x: (-x[0], x[1]))
    load, placed = [0.0] * n_shards, []
    for w, g in heavy:
        s = min(range(n_shards), key=lambda i: (load[i], i))
        load[s] += w
        placed.append((g, s))
    # One level to which the light groups fill all shards that lie below it.
    light, level = total - sum(load), 0.0
    for k in range(1, n_shards + 1):
        low = sorted(load)[:k]
        level = (light + sum(low)) / k
        if k == n_shards or level <= sorted(load)[k]:
            break
    room = {s: max(0.0, level - load[s]) for s in range(n_shards)}
    rest = groups.where(F.col("w") <= limit)
    tree = build_tree(rest, room, limit) if light > 0 else 0
    out = rest.select("grp", F.expr(_assign(tree)).cast("int").alias("shard"))
    if placed:
        out = out.unionByName(groups.sparkSession.createDataFrame(placed, "grp string, shard int"))
    return out


def numbered(rows: DataFrame, n_shards: int) -> DataFrame:
    """Adds `slot`, gapless from 0 in each shard: numbers within chunks of bounded size, plus the rows of earlier chunks."""
    chunks = max(1, rows.count() // (n_shards * SLOT_ROWS))
    rows = rows.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "grp"), F.lit(chunks)))
    counts = rows.groupBy("shard", "chunk").agg(F.count(F.lit(1)).alias("n"))
    before = counts.select("shard", "chunk", (F.sum("n").over(Window.partitionBy("shard").orderBy("chunk")) - F.col("n"))
                           .alias("before"))
    own = rows.withColumn("k", F.row_number().over(Window.partitionBy("shard", "chunk").orderBy("doc_id", "grp")))
    return (own.join(before, ["shard", "chunk"])
            .withColumn("slot", (F.col("before") + F.col("k") - 1).cast("long")).drop("before", "k", "chunk"))


def shard(docs: DataFrame, n_shards: int = 24) -> DataFrame:
    """One row per row of `docs`: doc_id, size, text_crc32, law, shard, slot, grown_shard."""
    rows = cut_lineage(sized(docs))
    groups = cut_lineage(groups_of(rows))
    placed = cut_lineage(rows.select("doc_id", "size", "text_crc32", "grp").join(assign_groups(groups, n_shards), "grp"))
    return numbered(placed, n_shards).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                                             F.lit(None).cast("int").alias("grown_shard"))
