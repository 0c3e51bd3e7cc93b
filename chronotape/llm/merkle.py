"""Merkle dataset manifest: one leaf per row, a tree of runs of three per source, one tree over the sources' roots.

Numbering. Rows are sorted by range partitions on (source, doc_id, leaf); a partition's rows of one source are
consecutive, so the source's offset at each partition (a sum over one row per partition and source) turns the place in
the partition into the place in the source. No source passes through one task.
Levels. A parent groups its three children by floor(place / 3); a level is a third of the one below.
Proofs by pointer jumping. A node whose ancestor is d = 2^k levels above holds the siblings on the way there as one
segment. A self-join with the node at that ancestor doubles the distance and concatenates both segments. Only levels
that are multiples of the distance go on, so a round joins the leaves with about n / 3^d nodes, and log2(height) rounds
reach the root. The segments of a source's root in the tree of sources come in at that root, so no leaf is joined by
its source alone; a segment is two digests (64 bytes) a level.

Defined cases: nulls in any column count as `-` in the leaf; null doc_ids come first, rows of one doc_id follow by leaf
digest; repeated rows are leaves of their own with one digest; a null doc_id is never tampered with; an empty table
gives no rows; with a single row the leaf is the root; other columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut_lineage

ARITY = 3
DIGEST = 32
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
SEGMENT = "array<struct<left:binary,right:binary>>"


def framed(c: Column) -> Column:
    """A value with its UTF-8 byte count in front, or `-` for null."""
    text = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(changed: dict[str, Column] | None = None) -> Column:
    """Digest of a row; `changed` gives other expressions for some of its columns."""
    values = {name: F.col(name) for name in FIELDS} | (changed or {})
    return F.unhex(F.sha2(F.concat(*[framed(values[name]) for name in FIELDS]), 256))


def hexed(c: Column) -> Column:
    return F.lower(F.hex(c))


def numbered(df: DataFrame, group: list[str], order: list[Column]) -> DataFrame:
    """df plus `tree` (rank of the group, from 0), `place` (rank of the row in it) and `size` (rows of the group).

    `order` sorts the group's columns first and tells all rows apart but for repeated ones.
    """
    rows = cut_lineage(df.repartitionByRange(*order).sortWithinPartitions(*order)
                       .withColumn("at", F.monotonically_increasing_id()).withColumn("part", F.shiftright("at", 33)))
    whole = Window.partitionBy(*group)
    before = whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy("part", *group).agg(F.min("at").alias("first_at"), F.count(F.lit(1)).alias("n"))
    counts = cut_lineage(counts.select("part", *group, F.sum("n").over(whole).alias("size"), (
        F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first_at")).alias("shift")))
    if group:
        groups = numbered(counts.select(*group).distinct(), [], [F.col(c).asc_nulls_first() for c in group])
        counts = _same(counts, groups.select(*group, F.col("place").alias("tree")), group).select("l.*", "r.tree")
    else:
        counts = counts.withColumn("tree", F.lit(0).cast("long"))
    return (_same(rows, counts, ["part", *group])
            .select("l.*", "r.tree", (F.col("at") + F.col("shift")).alias("place"), "r.size").drop("at", "part"))


def _same(left: DataFrame, right: DataFrame, columns: list[str]) -> DataFrame:
    equal = [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in columns]
    return left.alias("l").join(right.alias("r"), reduce(lambda a, b: a & b, equal))


def height_of(size: Column) -> Column:
    """Levels above the leaves of a tree with `size` leaves."""
    steps = F.sequence(F.lit(0), F.lit(39))
    powers = [ARITY ** i for i in range(40)]
    return F.size(F.filter(steps, lambda i: F.element_at(F.array(*map(F.lit, powers)), i + 1) < size))


def levels(leaves: DataFrame) -> DataFrame:
    """All nodes above the leaves: tree, height, level, place, digest and kids (the children's digests, concatenated).

    `leaves` has tree, height, place and digest; the number of rounds is the greatest height.
    """
    current = leaves.select("tree", "height", "place", "digest")
    grown = [current.limit(0).select("tree", "height", F.lit(1).alias("level"), "place", "digest",
                                     F.col("digest").alias("kids"))]
    for level in range(1, (current.agg(F.max("height")).first()[0] or 0) + 1):
        run = F.array_sort(F.collect_list(F.struct("place", "digest")))
        parents = (current.where(F.col("height") >= level)
                   .groupBy("tree", "height", F.floor(F.col("place") / ARITY).alias("parent")).agg(run.alias("run"))
                   .withColumn("kids", F.array_join(F.transform("run", lambda k: hexed(k["digest"])), "")))
        current = cut_lineage(parents.select("tree", "height", F.lit(level).alias("level"), F.col("parent").alias("place"),
                                             F.unhex(F.sha2("kids", 256)).alias("digest"), F.unhex("kids").alias("kids")))
        grown.append(current)
    return reduce(DataFrame.unionByName, grown)


def _first_segment(df: DataFrame, parents: DataFrame) -> DataFrame:
    """df plus `segment`, the siblings of each node; none where it has no parent."""
    at = (F.col("x.place") % ARITY).cast("int") * DIGEST
    siblings = F.array(F.struct(F.col("kids").substr(F.lit(1), at).alias("left"),
                                F.col("kids").substr(at + DIGEST + 1, F.lit(DIGEST * ARITY)).alias("right")))
    return (df.alias("x").join(parents.alias("p"), (F.col("x.tree") == F.col("p.tree")) & (F.col("x.level") == F.col("p.level"))
                               & (F.floor(F.col("x.place") / ARITY) == F.col("p.parent")), "left")
            .select("x.*", F.when(F.col("kids").isNull(), F.array().cast(SEGMENT)).otherwise(siblings).alias("segment")))


def _jump(df: DataFrame, ahead: DataFrame, distance: int) -> DataFrame:
    """Concatenate each node's segment with that of its ancestor `distance` levels above, where there is one."""
    up = ahead.select("tree", (F.col("level") - distance).alias("level"), F.col("place").alias("ancestor"),
                      F.col("segment").alias("rest"))
    return (df.withColumn("ancestor", F.floor(F.col("place") / F.lit(ARITY ** distance).cast("long")))
            .join(up, ["tree", "level", "ancestor"], "left")
            .withColumn("segment", F.concat("segment", F.coalesce("rest", F.array().cast(SEGMENT)))).drop("ancestor", "rest"))


def proofs(leaves: DataFrame, nodes: DataFrame, tops: DataFrame | None = None) -> DataFrame:
    """leaves plus `segment`, the siblings from the leaf's own level up to the root.

    `tops` (tree, segment) is what follows at the root of each tree; without it the segment ends there.
    """
    height = nodes.agg(F.max("height")).first()[0] or 0
    parents = nodes.select("tree", (F.col("level") - 1).alias("level"), F.col("place").alias("parent"), "kids")
    inner = _first_segment(nodes.select("tree", "height", "level", "place"), parents)
    out = _first_segment(leaves.withColumn("level", F.lit(0)), parents.where("level = 0"))
    if tops is not None:
        inner = inner.where("level < height").unionByName(
            inner.where("level = height").drop("segment").join(tops, "tree"))
        out = out.where("height > 0").unionByName(out.where("height = 0").drop("segment").join(tops, "tree"))
    inner, distance = cut_lineage(inner), 1
    while distance <= height:
        ahead = inner.where(F.col("level") % (2 * distance) == distance)
        out = _jump(out, ahead.where(F.col("level") == distance), distance)
        if 2 * distance <= height:
            inner = cut_lineage(_jump(inner.where(F.col("level") % (2 * distance) == 0), ahead, distance))
        distance *= 2
    return out.drop("level")


def fold(digest: Column, segment: Column) -> Column:
    """The root that a leaf's digest and its siblings lead to."""
    return F.aggregate(segment, digest, lambda low, step: F.unhex(
        F.sha2(F.concat(hexed(step["left"]), hexed(low), hexed(step["right"])), 256)))


def proof_digest(segment: Column) -> Column:
    parts = F.transform(segment, lambda s: F.concat(hexed(s["left"]), hexed(s["right"])))
    return F.sha2(F.array_join(parts, ""), 256)


def manifest(docs: DataFrame, found: dict[str, Column] | None = None) -> DataFrame:
    """Per row of docs: doc_id, source, leaf, tree, place, size, height, segment, root and `now`, the leaf of the row as
    it is found later (`found` gives the expressions of changed columns). Digests are binaries.
    """
    leaves = docs.select("doc_id", "source", leaf_digest().alias("digest"), leaf_digest(found).alias("now"))
    order = [F.col("source").asc_nulls_first(), F.col("doc_id").asc_nulls_first(), F.col("digest"), F.col("now")]
    leaves = cut_lineage(numbered(leaves, ["source"], order).withColumn("height", height_of(F.col("size"))))
    nodes = levels(leaves)
    subroots = nodes.where("level = height").select("tree", "digest").unionByName(
        leaves.where("height = 0").select("tree", "digest"))
    n_trees = subroots.count()
    upper = cut_lineage(subroots.select(F.lit(0).cast("long").alias("tree"), height_of(F.lit(n_trees)).alias("height"),
                                        F.col("tree").alias("place"), "digest"))
    upper_nodes = levels(upper)
    root = (upper_nodes.where("level = height").select("digest").first() if n_trees > 1 else upper.select("digest").first())
    tops = proofs(upper, upper_nodes).select(F.col("place").alias("tree"), "segment")
    return (proofs(leaves, nodes, tops).withColumnRenamed("digest", "leaf")
            .withColumn("root", F.lit(bytes(root[0]) if root else None).cast("binary")))


def verify(docs: DataFrame, found: dict[str, Column] | None = None) -> DataFrame:
    """Digest per row: doc_id, leaf, subroot, root, proof_sha256, folded_root and verified (hex text)."""
    rows = manifest(docs, found)
    rows = rows.select(F.col("doc_id").cast("long").alias("doc_id"), hexed(F.col("leaf")).alias("leaf"),
                       hexed(fold(F.col("leaf"), F.slice("segment", F.lit(1), F.col("height")))).alias("subroot"),
                       hexed(F.col("root")).alias("root"), proof_digest(F.col("segment")).alias("proof_sha256"),
                       hexed(fold(F.col("now"), F.col("segment"))).alias("folded_root"))
    return rows.withColumn("verified", F.col("folded_root") == F.col("root"))


def tampered() -> dict[str, Column]:
    """Rows whose doc_id has an even CRC-32 (of its decimal text) lose their line feeds."""
    even = F.crc32(F.col("doc_id").cast("string")) % 2 == 0
    return {"text": F.when(even, F.replace(F.col("text"), F.lit("\n"), F.lit(""))).otherwise(F.col("text"))}


ORACLE = r"""
WITH RECURSIVE t AS (SELECT doc_id, source, lang, n_chars, text,
  list_reduce([4294967295::BIGINT] || list_transform(range(8 * length(CAST(doc_id AS VARCHAR))), lambda k:
    ((ascii(CAST(doc_id AS VARCHAR)[CAST(k // 8 + 1 AS INT)]) >> CAST(k % 8 AS INT)) & 1)::BIGINT),
    lambda c, b: xor(c >> 1, 3988292384 * xor(c & 1, b))) AS crc FROM documents),
f AS (SELECT doc_id, source, text, crc, coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-')
    || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-')
    || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') AS head,
  CASE WHEN xor(crc, 4294967295) % 2 = 0 THEN replace(text, chr(10), '') ELSE text END AS seen FROM t),
l AS (SELECT doc_id, source, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
  sha256(head || coalesce(strlen(seen) || ':' || seen, '-')) AS now FROM f),
n AS (SELECT doc_id, source, leaf, now, row_number() OVER (PARTITION BY source ORDER BY doc_id, leaf) - 1 AS place,
  count(*) OVER (PARTITION BY source) AS size FROM l),
lower_tree AS (SELECT source, 0 AS level, place, size, leaf AS digest FROM n
  UNION ALL SELECT source, level + 1, place // 3, (max(size) + 2) // 3, sha256(string_agg(digest, '' ORDER BY place))
  FROM lower_tree WHERE size > 1 GROUP BY source, level, place // 3),
subs AS (SELECT source, digest, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS place, count(*) OVER () AS size
  FROM lower_tree WHERE size = 1),
upper_tree AS (SELECT 0 AS level, place, size, digest FROM subs
  UNION ALL SELECT level + 1, place // 3, (max(size) + 2) // 3, sha256(string_agg(digest, '' ORDER BY place))
  FROM upper_tree WHERE size > 1 GROUP BY level, place // 3),
r AS (SELECT digest AS root FROM upper_tree WHERE size = 1),
lower_side AS (SELECT a.source, a.level, a.place,
  coalesce(string_agg(b.digest, '' ORDER BY b.place) FILTER (WHERE b.place < a.place), '') AS x,
  coalesce(string_agg(b.digest, '' ORDER BY b.place) FILTER (WHERE b.place > a.place), '') AS y
  FROM lower_tree a JOIN lower_tree b ON b.source IS NOT DISTINCT FROM a.source AND b.level = a.level
    AND b.place // 3 = a.place // 3 WHERE a.size > 1 GROUP BY ALL),
upper_side AS (SELECT a.level, a.place,
  coalesce(string_agg(b.digest, '' ORDER BY b.place) FILTER (WHERE b.place < a.place), '') AS x,
  coalesce(string_agg(b.digest, '' ORDER BY b.place) FILTER (WHERE b.place > a.place), '') AS y
  FROM upper_tree a JOIN upper_tree b ON b.level = a.level AND b.place // 3 = a.place // 3 WHERE a.size > 1 GROUP BY ALL),
lower_path AS (SELECT doc_id, source, leaf, place AS first_place, 0 AS level, place, '' AS proof, now AS folded FROM n
  UNION ALL SELECT p.doc_id, p.source, p.leaf, p.first_place, p.level + 1, p.place // 3, p.proof || s.x || s.y,
  sha256(s.x || p.folded || s.y) FROM lower_path p JOIN lower_side s
    ON s.source IS NOT DISTINCT FROM p.source AND s.level = p.level AND s.place = p.place),
half AS (SELECT p.*, s.digest AS subroot, s.place AS tree FROM lower_path p JOIN lower_tree t
  ON t.source IS NOT DISTINCT FROM p.source AND t.level = p.level AND t.place = p.place AND t.size = 1
  JOIN subs s ON s.source IS NOT DISTINCT FROM p.source),
upper_path AS (SELECT doc_id, leaf, subroot, tree, first_place, 0 AS level, tree AS place, proof, folded FROM half
  UNION ALL SELECT p.doc_id, p.leaf, p.subroot, p.tree, p.first_place, p.level + 1, p.place // 3, p.proof || s.x || s.y,
  sha256(s.x || p.folded || s.y) FROM upper_path p JOIN upper_side s ON s.level = p.level AND s.place = p.place)
SELECT p.doc_id, p.leaf, p.subroot, r.root, sha256(p.proof) AS proof_sha256, p.folded AS folded_root,
  p.folded = r.root AS verified
FROM upper_path p JOIN upper_tree t ON t.level = p.level AND t.place = p.place AND t.size = 1 CROSS JOIN r
"""
