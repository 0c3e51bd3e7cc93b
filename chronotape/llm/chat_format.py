"""Chat formatting: the nested field paths of a record select a declarative mapping to canonical turns.

A record's layout is the sorted list of the nested field paths that it fills; its fingerprint is the hash of that list.
LAYOUTS maps fingerprints to expressions that give an array of (turn, role, text). The paths of a table's schema are
known when the plan is built, so the choice is one CASE expression per row, native throughout.

Template: one turn is `### role:` NEWLINE text `</turn>` NEWLINE. Inside roles and texts backslash, `###` and `</`
(in roles also `:`) are written as two-character escapes that start with a backslash; as every backslash of an
escaped string opens an escape, replacing them back (backslash last) restores any string.

Skew: turns are formatted before the exchange and gathered in two steps, 32 turns at a time, then the pieces; only the
finished text of one conversation, which is one output value, meets in one row.

Defined cases: null role or text is empty; null conv_id is one conversation of its own; turns are ordered by turn, then
role, then text, repeated rows stay; a record whose layout is unknown has no turns; extra columns are ignored; an empty
table gives an empty result (plus the added conversation in the query).
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import read

TURN = "struct<turn:bigint,role:string,text:string>"


def _turn(at, role, text):
    return f"struct(CAST({at} AS BIGINT) AS turn, CAST({role} AS STRING) AS role, CAST({text} AS STRING) AS text)"


def _list(column, role, text):
    return f"transform({column}, (m, i) -> {_turn('i', f'm.{role}', f'm.{text}')})"


#: Layouts: the nested paths that a record fills, and its turns.
LAYOUTS = {
    ("role", "text", "turn"): f"array({_turn('turn', 'role', 'text')})",
    ("prompt", "response"): f"array({_turn(0, chr(39) + 'user' + chr(39), 'prompt')}, "
                            f"{_turn(1, chr(39) + 'assistant' + chr(39), 'response')})",
    ("completion", "prompt"): f"array({_turn(0, chr(39) + 'user' + chr(39), 'prompt')}, "
                              f"{_turn(1, chr(39) + 'assistant' + chr(39), 'completion')})",
    ("instruction", "output"): f"array({_turn(0, chr(39) + 'user' + chr(39), 'instruction')}, "
                               f"{_turn(1, chr(39) + 'assistant' + chr(39), 'output')})",
    ("input", "instruction", "output"): "array(" + _turn(0, "'user'", "concat(instruction, '\\n\\n', input)") + ", "
                                        + _turn(1, "'assistant'", "output") + ")",
    ("messages[].content", "messages[].role"): _list("messages", "role", "content"),
    ("messages[].content", "messages[].role", "system"): "concat(array(" + _turn(-1, "'system'", "system") + "), "
                                                         + _list("messages", "role", "content") + ")",
    ("conversations[].from", "conversations[].value"): _list("conversations", "from", "value"),
}
#: Of a turn table, these columns count as filled even where they are null.
ALWAYS = {"turn", "role", "text"}


def fingerprint(paths) -> str:
    return hashlib.md5("\n".join(sorted(paths)).encode()).hexdigest()


def nested_paths(kind: T.DataType, at: str = "") -> list[str]:
    """Leaf paths below `at`; [] stands for the elements of a list."""
    if isinstance(kind, T.ArrayType):
        return nested_paths(kind.elementType, f"{at}[]")
    if isinstance(kind, T.StructType):
        return [p for f in kind.fields for p in nested_paths(f.dataType, f"{at}.{f.name}" if at else f.name)]
    return [at]


def with_fingerprint(df: DataFrame) -> DataFrame:
    """Adds `layout`: hash of the sorted known paths that the row fills."""
    known = {p for paths in LAYOUTS for p in paths}
    filled = []
    for field in df.schema.fields:
        paths = [p for p in nested_paths(field.dataType, field.name) if p in known]
        filled += [(p, F.lit(p) if field.name in ALWAYS else F.when(F.col(f"`{field.name}`").isNotNull(), F.lit(p)))
                   for p in paths]
    listed = [c for _, c in sorted(filled, key=lambda x: x[0])]
    return df.withColumn("layout", F.md5(F.concat_ws("\n", *listed)) if listed else F.lit(fingerprint([])))


def canonical_turns(df: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) of records in any known layout."""
    have = {p for f in df.schema.fields for p in nested_paths(f.dataType, f.name)}
    choice = None
    for paths, expression in LAYOUTS.items():
        if set(paths) <= have:
            hit = F.col("layout") == F.lit(fingerprint(paths))
            choice = F.when(hit, F.expr(expression)) if choice is None else choice.when(hit, F.expr(expression))
    if choice is None:
        choice = F.lit(None).cast(f"array<{TURN}>")
    mapped = with_fingerprint(df).select("conv_id", F.explode(choice).alias("t"))
    return mapped.select("conv_id", "t.turn", F.coalesce("t.role", F.lit("")).alias("role"),
                         F.coalesce("t.text", F.lit("")).alias("text"))


def escape(c):
    c = F.replace(c, F.lit("\\"), F.lit("\\b"))
    return F.replace(F.replace(c, F.lit("###"), F.lit("\\h")), F.lit("</"), F.lit("\\s"))


def unescape(c):
    c = F.replace(F.replace(c, F.lit("\\h"), F.lit("###")), F.lit("\\s"), F.lit("</"))
    return F.replace(c, F.lit("\\b"), F.lit("\\"))


def format_turns(turns: DataFrame, piece: int = 32) -> DataFrame:
    """(conv_id, formatted): the template applied to canonical turns."""
    role = F.replace(escape(F.col("role")), F.lit(":"), F.lit("\\c"))
    rows = turns.select("conv_id", "turn", "role", "text", F.concat(
        F.lit("### "), role, F.lit(":\n"), escape(F.col("text")), F.lit("</turn>\n")).alias("said"))
    order = F.array_sort(F.collect_list(F.struct(F.coalesce("turn", F.lit(-2**62)).alias("turn"), "role", "text", "said")))
    pieces = (rows.groupBy("conv_id", F.floor(F.coalesce("turn", F.lit(-2**62)) / piece).alias("piece"))
              .agg(order.alias("x")).select("conv_id", "piece", F.expr("array_join(transform(x, s -> s.said), '')").alias("said")))
    return (pieces.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("piece", "said"))).alias("x"))
            .select("conv_id", F.expr("array_join(transform(x, s -> s.said), '')").alias("formatted")))


def _colon(p):
    return F.position(F.lit(":\n"), p)


def read_back(formatted: DataFrame) -> DataFrame:
    """(conv_id, formatted, turns): the turns parsed out of the formatted text, roles and texts unescaped."""
    parts = F.expr("filter(split(formatted, '</turn>\\n', -1), p -> p <> '')")
    return formatted.select("conv_id", "formatted", F.transform(parts, lambda p: F.struct(
        _role(p).alias("role"), _text(p).alias("text"))).alias("turns"))


def _role(p):
    raw = F.substr(p, F.lit(5), _colon(p) - F.lit(5))
    return unescape(F.replace(raw, F.lit("\\c"), F.lit(":")))


def _text(p):
    return unescape(F.substr(p, _colon(p) + F.lit(2)))


def digests(formatted: DataFrame) -> DataFrame:
    """What the formatted text says when it is read back; the loss mask covers the assistant's texts."""
    loss = F.expr("array_join(transform(filter(turns, t -> t.role = 'assistant'), t -> t.text), '')")
    said = F.expr("array_join(transform(turns, t -> concat(t.role, '\\n', t.text, '\\n')), '')")
    return (read_back(formatted).withColumn("loss", loss)
            .select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
                    F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"),
                    F.length("formatted").cast("long").alias("formatted_chars")))


def format_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = "\\### Assistant: </turn> ok"
    probe = spark.createDataFrame([(-7, 0, "user", text), (-7, 1, "assistant", text)],
                                  "conv_id bigint, turn bigint, role string, text string")
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(probe)
    return digests(format_turns(canonical_turns(rows)))


ORACLE = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations UNION ALL
  SELECT -7, i, ['user', 'assistant'][i + 1], '\### Assistant: </turn> ok' FROM (SELECT unnest([0, 1]) AS i)),
e AS (SELECT *, replace(replace(replace(replace(role, '\', '\b'), '###', '\h'), '</', '\s'), ':', '\c') AS r,
      replace(replace(replace(text, '\', '\b'), '###', '\h'), '</', '\s') AS t FROM c),
g AS (SELECT conv_id, count(*) AS n_turns,
  string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS said,
  coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '') AS loss,
  sum(length(r) + length(t) + 14) AS f FROM e GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(said) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256,
  CAST(f AS BIGINT) AS formatted_chars FROM g
"""
