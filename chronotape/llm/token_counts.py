"""Token counts with a digest cache: only contents that no earlier run has counted are encoded.

The cache is a Parquet folder of (tokenizer, content, n_tokens): `tokenizer` is the digest of the tokenizer file, which
is its version, `content` the digest of the normalised text. Normalised means that runs of spaces, tabs and line ends
are one space, without any at the ends: the tokenizer drops white space and no token spans it, so the count is the same.
A call takes the distinct contents, keeps those without a stored count, encodes one text of each, appends the counts and
reads every row's count back from the cache.

Skew: contents are pre-aggregated in the map tasks before they are exchanged, so a group of copies with a third of all
rows arrives as one row per task. Texts of misses are picked the same way; if the digests of all misses fit
MISS_BYTES by count (a later run over mostly known texts), they are broadcast first and known texts are not exchanged at
all. The last join carries ids and digests only, its hot digests are split by adaptive execution.

Inside a task, chunks between white space are encoded once (the counts of chunks add up, since no token and no special
string spans white space); those of the last slices are kept, REMEMBERED of them and a slice. That memo decides speed only.

A lost executor repeats its task; rows are appended once by the commit of the write. Two runs that append one content at
once, or a run repeated after a crash, leave equal rows, which are reduced to one on reading.

Defined cases: null text is empty and has no bytes and no tokens; special strings inside a text become special tokens as
the library does by default; repeated rows get equal results; an empty table leaves the cache as it is.
"""

from __future__ import annotations

import hashlib
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronotape.session import ensure_checkpoint_dir

from .common import cached, cut_lineage, documents, map_texts

LIMIT = 2048
MISS_BYTES = 8 << 20
REMEMBERED = 50_000
#: Chunks handed to the library as one text.
BATCH = 500
#: Longer chunks are not remembered.
MAX_CHUNK = 64
#: Fixed: the white space that is normalised.
BLANK = " \t\n\r"
CACHE = "tokenizer binary, content binary, n_tokens bigint"


def hashed(docs: DataFrame) -> DataFrame:
    """(id, body, n_bytes, content): `content` is the digest of the normalised text."""
    normal = F.trim(F.regexp_replace("body", f"[{BLANK}]+", " "))
    return documents(docs).withColumn("n_bytes", F.octet_length("body").cast("long")).withColumn(
        "content", F.unhex(F.sha2(normal, 256)))


class Counter:
    """Per worker: the library's tokenizer and the counts of chunks met before."""

    def __init__(self, content: str):
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_str(content)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.known: dict[str, int] = {}
        self.older: dict[str, int] = {}

    def sizes(self, chunks: list[str]) -> list[int]:
        """Tokens per chunk: chunks are encoded BATCH at a time as one text, a token belongs to the chunk it starts in."""
        out: list[int] = []
        for i in range(0, len(chunks), BATCH):
            part = chunks[i:i + BATCH]
            starts = np.cumsum([0, *(len(c) + 1 for c in part)])
            at = np.array([o[0] for o in self.tokenizer.encode(" ".join(part), add_special_tokens=False).offsets], np.int64)
            out += np.bincount(np.searchsorted(starts, at, "right") - 1, minlength=len(part)).tolist()
        return out

    def count(self, texts: list[bytes]) -> list[int]:
        split = [t.decode().translate(SPACES).split(" ") for t in texts]
        # Chunks of the last slices stay known, so frequent ones are encoded once per worker.
        if len(self.known) > REMEMBERED:
            self.known, self.older = {}, self.known
        new = {c for chunks in split for c in chunks if len(c) <= MAX_CHUNK} - self.known.keys()
        self.known.update((c, self.older[c]) for c in new & self.older.keys())
        fresh = list(new - self.known.keys())
        self.known.update(zip(fresh, self.sizes(fresh), strict=True))
        long = [c for chunks in split for c in chunks if len(c) > MAX_CHUNK]
        extra = iter([len(self.tokenizer.encode(c, add_special_tokens=False).ids) for c in long])
        get = self.known.get
        return [sum(next(extra) if (n := get(c)) is None else n for c in chunks) for chunks in split]


SPACES = str.maketrans(dict.fromkeys(BLANK, " "))


def encode_counts(texts: DataFrame, content: str) -> DataFrame:
    """(content, n_tokens) of the column `body`."""
    sent, key = texts.sparkSession.sparkContext.broadcast(content), f"counter-{uuid.uuid4().hex}"

    def make():
        return lambda batch: [cached(key, sent, Counter).count(batch)]
    return map_texts(texts, make, "n_tokens bigint", ["content"])


def stored(spark: SparkSession, cache: str, version: bytes) -> DataFrame:
    """(content, n_tokens) that the cache holds for one tokenizer, each content once."""
    rows = spark.read.schema(CACHE).parquet(cache).where(F.col("tokenizer") == F.lit(version))
    return rows.groupBy("content").agg(F.max("n_tokens").alias("n_tokens"))


def open_cache(spark: SparkSession, cache: str) -> None:
    """Make the folder a readable (empty) table; an existing one stays as it is."""
    spark.createDataFrame([], CACHE).write.mode("append").parquet(cache)


def missing(rows: DataFrame, known: DataFrame) -> DataFrame:
    """Distinct contents of `rows` that `known` has no count for."""
    return cut_lineage(rows.select("content").distinct().join(known, "content", "left_anti"))


def texts_of(rows: DataFrame, misses: DataFrame, n_misses: int) -> DataFrame:
    """One text (content, body) of each miss."""
    small = n_misses * 64 <= MISS_BYTES
    if small:
        rows = rows.join(F.broadcast(misses), "content", "left_semi")
    one = rows.groupBy("content").agg(F.first("body").alias("body"))
    return one if small else one.join(misses, "content", "left_semi")


def fill(docs: DataFrame, path: str, cache: str) -> int:
    """Encode what the cache lacks and append it; gives the number of contents encoded."""
    spark = docs.sparkSession
    with open(path, encoding="utf-8") as f:
        content = f.read()
    version = hashlib.sha256(content.encode()).digest()
    open_cache(spark, cache)
    rows = hashed(docs)
    misses = missing(rows, stored(spark, cache, version))
    n_misses = misses.count()
    if n_misses:
        new = encode_counts(texts_of(rows, misses, n_misses), content)
        new.select(F.lit(version).alias("tokenizer"), "content", "n_tokens").write.mode("append").parquet(cache)
    return n_misses


def count_tokens(docs: DataFrame, path: str, cache: str | None = None, limit: int = LIMIT) -> DataFrame:
    """Per row: doc_id, n_bytes, n_tokens, over_limit. Without `cache` a new folder in the shared place is used."""
    spark = docs.sparkSession
    cache = cache or f"{ensure_checkpoint_dir(spark)}/counts-{uuid.uuid4().hex}"
    fill(docs, path, cache)
    with open(path, encoding="utf-8") as f:
        version = hashlib.sha256(f.read().encode()).digest()
    counts = stored(spark, cache, version)
    return (hashed(docs).select("id", "n_bytes", "content").join(counts, "content")
            .select(F.col("id").alias("doc_id"), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit")))
