"""Line dedup: overlapping windows of three lines that also occur earlier are removed.

The non-blank lines of a document are hashed to 128 bits, three consecutive ones make a window. A window is
removed wherever its first occurrence (smallest doc_id, then smallest position) lies elsewhere; covered lines are
merged into spans and blank lines inside a span go with it. Everything is a DataFrame expression.

Skew: the first occurrence of a window is a partial aggregate, so a window in a third of all documents reaches its
reducer as one row per task. The repeated windows are stored, then joined back, so that adaptive execution may
split a hot hash. The lists built per document hold that document's own lines.

Defined cases: null text is empty and stays so; a document with fewer than three non-blank lines has no window and
is kept; a null doc_id sorts first; rows with one doc_id and equal text count as one document and get one
result each; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut_lineage, keyed, rows_of, with_text

WIDTH = 3


def _lines(df: DataFrame) -> DataFrame:
    """Adds `lines` and `at`, the line numbers of the non-blank lines."""
    return (df.withColumn("lines", F.expr("split(body, '\\n', -1)"))
            .withColumn("at", F.expr("filter(sequence(0, size(lines) - 1), i -> trim(lines[i]) <> '')")))


def windows(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """(id, mark, pos, h1, h2): one row per window; pos counts non-blank lines."""
    parts = lambda name: ", ".join(f"{name}[i + {k}]" for k in range(width))
    hashed = (_lines(keyed(docs)).where(F.size("at") >= width)
              .select("id", "mark", F.expr("transform(at, i -> xxhash64(lines[i]))").alias("a"),
                      F.expr("transform(at, i -> xxhash64('second', lines[i]))").alias("b")))
    return (hashed.select("id", "mark", F.explode(F.expr(
        f"transform(sequence(0, size(a) - {width}), i -> struct(i AS pos, xxhash64({parts('a')}) AS h1, "
        f"xxhash64({parts('b')}) AS h2))")).alias("w")).select("id", "mark", "w.*"))


def repeated_spans(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """(id, mark, covered): non-blank line positions of each document inside a window that occurs earlier."""
    found = cut_lineage(windows(docs, width))
    repeats = cut_lineage(found.groupBy("h1", "h2").agg(F.min(F.struct("id", "mark", "pos")).alias("first"),
                                                        F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"))
    # Rows of one document that are repeated as a whole share id, mark and pos, so neither copy is "later".
    later = found.join(repeats, ["h1", "h2"]).where(F.struct("id", "mark", "pos") > F.col("first"))
    return later.groupBy("id", "mark").agg(F.collect_set("pos").alias("starts"))


def dedup(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """(row, id, body, n_lines, n_removed, n_spans, spans): `body` holds the kept lines; spans are [first, last] lines."""
    marks = repeated_spans(docs, width)
    left, right = rows_of(docs).alias("d"), marks.alias("m")
    joined = left.join(right, F.col("d.id").eqNullSafe(F.col("m.id")) & (F.col("d.mark") == F.col("m.mark")), "left")
    out = _lines(joined.select("d.row", "d.id", "d.body", F.coalesce("m.starts", F.expr("array()").cast("array<int>"))
                               .alias("starts")))
    covered = f"array_sort(array_distinct(flatten(transform(starts, p -> sequence(p, p + {width - 1})))))"
    out = (out.withColumn("covered", F.expr(covered))
           .withColumn("opens", F.expr("array_sort(array_except(covered, transform(covered, c -> c + 1)))"))
           .withColumn("closes", F.expr("array_sort(array_except(covered, transform(covered, c -> c - 1)))"))
           .withColumn("spans", F.expr("transform(opens, (c, i) -> struct(at[c] AS first, at[closes[i]] AS last))"))
           .withColumn("gone", F.expr("flatten(transform(spans, s -> sequence(s.first, s.last)))"))
           .withColumn("kept", F.expr("array_except(sequence(0, size(lines) - 1), gone)")))
    return out.select("row", "id", F.expr("CASE WHEN size(starts) = 0 THEN body ELSE "
                                          "array_join(transform(kept, i -> lines[i]), '\\n') END").alias("body"),
                      F.size("lines").cast("long").alias("n_lines"), F.size("gone").cast("long").alias("n_removed"),
                      F.size("spans").cast("long").alias("n_spans"), "spans")


def dedup_lines(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """Digest per document: doc_id, n_lines, n_removed, n_spans, text (what is left)."""
    return dedup(docs, width).select(F.col("id").alias("doc_id"), "n_lines", "n_removed", "n_spans",
                                     F.col("body").alias("text"))


def stage(docs: DataFrame) -> DataFrame:
    """The columns of `docs` with the kept lines as text; a document that lost all its content goes."""
    out = dedup(docs).where("n_removed = 0 OR trim(body) <> ''")
    return with_text(out, docs.columns)


ORACLE = r"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT doc_id, unnest(range(len(lines))) AS ln, unnest(lines) AS line FROM d),
c AS (SELECT doc_id, ln, line, row_number() OVER (PARTITION BY doc_id ORDER BY ln) - 1 AS pos FROM l
      WHERE trim(line, ' ') <> ''),
w AS (SELECT * FROM (SELECT doc_id, pos, md5(line) || md5(lead(line) OVER p) || md5(lead(line, 2) OVER p) AS h FROM c
      WINDOW p AS (PARTITION BY doc_id ORDER BY pos)) WHERE h IS NOT NULL),
r AS (SELECT doc_id, pos FROM (SELECT doc_id, pos, row_number() OVER (PARTITION BY h ORDER BY doc_id, pos) AS n FROM w)
      WHERE n > 1),
g AS (SELECT DISTINCT doc_id, pos + k AS pos FROM r, (SELECT unnest([0, 1, 2]) AS k)),
s AS (SELECT doc_id, min(pos) AS a, max(pos) AS b FROM (SELECT doc_id, pos,
      pos - row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS grp FROM g) GROUP BY doc_id, grp),
e AS (SELECT s.doc_id, x.ln AS a, y.ln AS b FROM s JOIN c x ON x.doc_id = s.doc_id AND x.pos = s.a
      JOIN c y ON y.doc_id = s.doc_id AND y.pos = s.b),
k AS (SELECT l.doc_id, count(*) FILTER (WHERE e.doc_id IS NULL) AS n_kept, count(*) AS n,
      string_agg(line, chr(10) ORDER BY ln) FILTER (WHERE e.doc_id IS NULL) AS t
      FROM l LEFT JOIN e ON e.doc_id = l.doc_id AND l.ln BETWEEN e.a AND e.b GROUP BY l.doc_id),
sp AS (SELECT doc_id, count(*) AS n_spans FROM s GROUP BY doc_id)
SELECT k.doc_id, k.n AS n_lines, k.n - k.n_kept AS n_removed, coalesce(n_spans, 0) AS n_spans, coalesce(t, '') AS text
FROM k LEFT JOIN sp ON sp.doc_id = k.doc_id
"""
