"""Shared helpers of the training-data operators."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from chronotape.session import cut_lineage

__all__ = ["cached", "cut_lineage", "documents", "keyed", "map_texts", "read", "rows_of", "ship", "with_text"]


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def documents(docs: DataFrame) -> DataFrame:
    """Only the id and the whole text of each row (null: empty), whatever other columns there are."""
    return docs.select(F.col("doc_id").cast("long").alias("id"), F.coalesce(F.col("text"), F.lit("")).alias("body"))


def keyed(docs: DataFrame) -> DataFrame:
    """`documents` plus `mark`, which tells rows of one id but different texts apart (repeated rows share it)."""
    return documents(docs).withColumn("mark", F.xxhash64("body"))


def rows_of(docs: DataFrame) -> DataFrame:
    """Each row whole, as one struct column `row`, next to id, body and mark: no extra column can clash."""
    return docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("id"),
                       F.coalesce(F.col("text"), F.lit("")).alias("body")).withColumn("mark", F.xxhash64("body"))


def with_text(out: DataFrame, columns: list[str], text: str = "body") -> DataFrame:
    """Unpack `row` into its old columns, with `text` as the new text."""
    return out.select(*[F.col(text).alias(c) if c == "text" else F.col("row").getField(c).alias(c) for c in columns])


SLICE_BYTES = 8 << 20
_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this library to the Python workers, once per application."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    root = Path(__file__).resolve().parents[1]
    target = Path(tempfile.mkdtemp(prefix="spark-")) / f"{root.name}.zip"
    with zipfile.ZipFile(target, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    spark.sparkContext.addPyFile(str(target))
    _SHIPPED.add(app)


def map_texts(df: DataFrame, make, fields: str, keep: list[str] | None = None, also: list[str] | None = None) -> DataFrame:
    """Apply a function on whole texts: columns `keep` pass through, `fields` (DDL) are new.

    `make()` runs once per task and gives a function from a list of UTF-8 bytes to one list or Arrow array per field.
    The columns `also` are handed to it as further arguments (Arrow arrays) and don't pass through.
    Texts are handed over in slices of about SLICE_BYTES, so memory follows the longest text, not the batch.
    """
    ship(df.sparkSession)
    keep, also = keep if keep is not None else [c for c in df.columns if c != "body"], also or []
    added = T.StructType.fromDDL(fields)
    schema = T.StructType([*[df.schema[c] for c in keep], *added.fields])
    types = to_arrow_schema(added).types

    def run(batches):
        step = make()
        for batch in batches:
            body = batch.column(batch.schema.get_field_index("body"))
            body = body.cast(pa.large_binary()) if pa.types.is_large_string(body.type) else body.cast(pa.binary())
            lengths, at = pc.binary_length(body).to_pylist(), 0
            while at < len(body):
                size, end = 0, at
                while end < len(body) and (end == at or size < SLICE_BYTES):
                    size += lengths[end] or 0
                    end += 1
                part = batch.slice(at, end - at)
                got = step([t or b"" for t in body.slice(at, end - at).to_pylist()],
                           *[part.column(part.schema.get_field_index(c)) for c in also])
                yield pa.RecordBatch.from_arrays(
                    [*[part.column(part.schema.get_field_index(c)) for c in keep],
                     *[x if isinstance(x, pa.Array) else pa.array(x, t) for x, t in zip(got, types, strict=True)]],
                    names=[f.name for f in schema.fields])
                at = end

    return df.select(*keep, *also, "body").mapInArrow(run, schema)


_CACHE: dict = {}


def cached(key: str, broadcast, build):
    """build(broadcast.value), once per Python worker and key; only the latest is kept."""
    if key not in _CACHE:
        _CACHE.clear()
        _CACHE[key] = build(broadcast.value)
    return _CACHE[key]
