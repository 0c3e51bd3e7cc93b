"""LM scoring with a probabilistic suffix tree over words.

Symbols are the tokens of the base score: lower-cased words and one end per text. A context is the words before a token, the
nearest first; the end of the text before stands for the start, and nothing beyond it is seen. The root is the base
distribution itself, (c + 1) / (N + V + 1), in which all unknown words share one symbol.

The tree grows level by level. A context becomes a candidate if its suffix (one word shorter) was retained, its farthest word
is retained as a context of its own, and that word was followed by the next one at least MIN_COUNT times. It is retained if
it occurs at least MIN_COUNT times and predicts its own next words, each judged with that occurrence left out, by more than
GAIN nats better than its suffix does: the divergence test. Growth ends with the first level on which nothing passes, so depth and
number of contexts follow the training texts. A retained context that was followed t times by u different words, n times by
this one, gives it (n + u q) / (t + u), where q is what its suffix gives; the sum over all symbols stays one. The longest
retained context of a token scores it.

Texts stay in batches of about BATCH_BYTES, packed as word numbers by the task that read them. On each level a batch sends its
candidates with their next words (0 times for held-out texts), and gets back the retained ones among them and the counts of
what other batches hold too. So neither the vocabulary nor the tree, which grow with the corpus, is ever whole in one place.
Words and contexts are sent as lists, one row per batch and bucket, and are numbered, judged and answered a bucket at a time. Contexts
and answers travel as blocks of narrow numbers (`blocks`), and a batch is stored without what the rest of it tells. A batch
forgets the words that no place of it can still reach, and a level's tables are deleted as soon as all that follows is stored.
What remains gets small long before the last level (a passage that repeats is followed word by word): as soon as all batches
together hold at most REST_PLACES words, one task takes them as a single batch and grows the levels that are left by the same
rules. Words and contexts are known by number, not by hash, so nothing is mixed up.

Defined cases: null or empty text has one token, the end; a null doc_id counts as training; repeated rows count and score as
often as they occur; without training texts every token is unknown and has probability one; an empty table gives an empty
result.
"""

from __future__ import annotations

import math
import pickle
import struct
import uuid
import zlib
from functools import reduce
from itertools import count as numbers

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from chronotape.session import ensure_checkpoint_dir

from .common import documents, ship

MIN_COUNT = 24
GAIN = 8.0
BATCH_BYTES = 8 << 20
#: The words after a context are dealt into one more part for each so many occurrences it can have: those of its word or, with
#: several words, of its two farthest words in a row (in steps of 1 << COUNT_STEP), and of the context without its farthest word.
PART_ROWS = 1_000_000
COUNT_STEP = 16
#: One task takes over when no more words than this (about those of one batch) are still in reach of a longer context.
REST_PLACES = 2_000_000
#: A bucket of words is numbered, and one of contexts judged, by one task at a time.
WORD_BUCKETS = 1_024
#: At most so many buckets of contexts, fewer if they would have less than BUCKET_TOKENS training tokens each, but FEW_BUCKETS at least.
CONTEXT_BUCKETS = 4_096
FEW_BUCKETS = 256
BUCKET_TOKENS = 1 << 18
#: Answers are gathered over the buckets of a task until they hold so many numbers.
ANSWER_NUMBERS = 8_000_000
#: Contexts in several parts have numbers from here on.
IN_PARTS = 1 << 62
#: No white space can be part of a word, so this one can stand for the end.
END = b"\n"
PARTS = "batch bigint, body binary, words array<binary>, n array<bigint>"
#: Words of a batch in one bucket (joined by line feeds), where the batch has them and how often its training texts hold them.
WORDS = "bucket int, batch bigint, at array<int>, words binary, n array<bigint>"
#: The same with the words' numbers and counts in all training texts; `total` and `distinct` are sums over a bucket, told once.
KNOWN = "batch bigint, at array<int>, node array<bigint>, c array<bigint>, total bigint, distinct bigint"
LEVEL = ("batch bigint, bucket int, lists binary, body binary, places bigint, doc array<bigint>, delta array<double>, id array<bigint>, "
         "held array<boolean>, tokens array<bigint>, found array<bigint>, base array<double>")
COUNTS = ("parent bigint, word bigint, t bigint, u bigint, once bigint, n array<bigint>, up array<double>, "
          "batch bigint, next array<bigint>")
#: The same for the tasks: a worker has no session that could parse DDL.
COUNTS_ARROW = pa.schema([(name, pa.list_(pa.field("element", {"bigint": pa.int64(), "double": pa.float64()}[kind[6:-1]]))
                           if kind.startswith("array") else pa.int64())
                          for name, kind in (column.split() for column in COUNTS.split(", "))])
#: What a batch gets back of a level, a block of the columns KNOWN_OF in one row, or rows of `counted` (contexts in several parts).
ANSWERS = f"{COUNTS}, answer binary"
ANSWERS_ARROW = pa.schema([*COUNTS_ARROW, ("answer", pa.binary())])
KNOWN_OF = ("parent", "word", "node", "t", "u", "long", "next", "more")
TEXTS = ("doc", "delta", "id", "held", "tokens", "found", "base")
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_PACK = zstandard.ZstdCompressor(level=3)


#: Exchanged files go with the query that made them, not when the driver happens to collect garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame) -> DataFrame:
    """Like `cut_lineage`, packed more tightly; what was exchanged for it is deleted."""
    path = f"{ensure_checkpoint_dir(df.sparkSession)}/{uuid.uuid4().hex}"
    conf = df.sparkSession.conf
    before = conf.get(CLEANUP, "false")
    conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        conf.set(CLEANUP, before)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(frames: list[DataFrame]) -> None:
    """Delete stored frames that nothing reads any more, since all that follows from them is stored itself."""
    for df in frames:
        files = df.inputFiles()
        if files:
            folder = df.sparkSession._jvm.org.apache.hadoop.fs.Path(files[0]).getParent()
            folder.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(folder, True)


def narrow(x: np.ndarray) -> np.ndarray:
    """Whole numbers in the fewest bytes that hold all of them."""
    if x.dtype.kind not in "iu":
        return x
    low, high = (int(x.min()), int(x.max())) if len(x) else (0, 0)
    return x.astype(next(k for k in (np.dtype(f"{'i' if low < 0 else 'u'}{n}") for n in (1, 2, 4, 8))
                         if np.iinfo(k).min <= low and high <= np.iinfo(k).max))


def planes(x: np.ndarray) -> np.ndarray:
    """The first bytes of all numbers, then the second ones, and so on: a row per byte."""
    return np.ascontiguousarray(np.ascontiguousarray(x).view(np.uint8).reshape(len(x), x.dtype.itemsize).T)


def whole(kind: str, block: bytes) -> np.ndarray:
    """The numbers behind `planes`; whole ones are wide again."""
    kind = np.dtype(kind)
    x = np.ascontiguousarray(np.frombuffer(block, np.uint8).reshape(kind.itemsize, -1).T).view(kind).reshape(-1)
    return x.astype(np.int64) if kind.kind in "iu" else x


def blocks(columns: list[tuple[np.ndarray, np.ndarray]]) -> list[bytes]:
    """One block per row, of columns of lists (values, edges)."""
    narrowed = [(narrow(x), edges) for x, edges in columns]
    kinds = "".join(x.dtype.char for x, _ in narrowed)
    split = [(planes(x), edges.tolist()) for x, edges in narrowed]
    out = []
    for row in range(len(columns[0][1]) - 1):
        parts = [x[:, edges[row]:edges[row + 1]].tobytes() for x, edges in split]
        out.append(_PACK.compress(b"".join([struct.pack(f"<B{len(parts)}q", len(parts), *map(len, parts)), kinds.encode(), *parts])))
    return out


def opened(column) -> tuple[list[np.ndarray], np.ndarray]:
    """The columns of all blocks of an Arrow column, one after another, and how long the first one is in each block."""
    rows = []
    for block in column:
        block = zstandard.decompress(block.as_py())
        many = block[0]
        sizes, at = struct.unpack_from(f"<{many}q", block, 1), 1 + 9 * many
        edges = [at + sum(sizes[:i]) for i in range(many + 1)]
        rows.append([whole(chr(kind), block[i:j]) for kind, i, j in zip(block[1 + 8 * many:at], edges, edges[1:])])
    return [np.concatenate(x) for x in zip(*rows)], np.array([len(x[0]) for x in rows], np.int64)


def tight(state: dict) -> bytes:
    """A batch's arrays, in few bytes."""
    def one(x):
        if not isinstance(x, np.ndarray):
            return x
        if x.dtype == bool:
            return "?", len(x), np.packbits(x).tobytes()
        if x.dtype.kind == "f":
            return "f", x.dtype.char, x.tobytes()
        return x.dtype.char, narrow(x).dtype.char, planes(narrow(x)).tobytes()
    return _PACK.compress(pickle.dumps({name: one(x) for name, x in state.items()}, protocol=5))


def loose(body: bytes) -> dict:
    """The arrays of `tight`."""
    def one(x):
        if not isinstance(x, tuple):
            return x
        kind, more, block = x
        if kind == "?":
            return np.unpackbits(np.frombuffer(block, np.uint8), count=more).astype(bool)
        return np.frombuffer(block, more).copy() if kind == "f" else whole(more, block).astype(kind)
    return {name: one(x) for name, x in pickle.loads(zstandard.decompress(body)).items()}


def words_of(text: bytes) -> list[bytes]:
    """Lower-cased words between the six ASCII white spaces."""
    return text.translate(_LOWER).split()


def packed(ids: list, held: list[bool], texts: list[bytes]) -> tuple[bytes, list[bytes], list[int]]:
    """A batch: its texts as numbers of its own words (0: the end), these words, and how often training texts hold them."""
    place, stream, ends = {END: 0}, [0], []
    for t in texts:
        stream += [place.setdefault(w, len(place)) for w in words_of(t)]
        stream.append(0)
        ends.append(len(stream))
    # Frequent words get small numbers.
    stream, words = np.array(stream, np.int32), list(place)
    often = np.bincount(stream, minlength=len(words))
    often[0] = len(stream) + 1
    order = np.argsort(-often, kind="stable")
    rank = np.empty(len(words), np.int32)
    rank[order] = np.arange(len(words))
    stream, words = rank[stream], [words[i] for i in order.tolist()]
    train = np.repeat(~np.array(held, bool), np.diff([1, *ends]))
    body = {"ids": ids, "held": np.array(held, bool), "ends": np.array(ends), "stream": stream}
    return tight(body), words, np.bincount(stream[1:][train], minlength=len(words)).tolist()


def pack(docs: DataFrame) -> DataFrame:
    """One row per batch."""
    def run(batches):
        number = numbers(TaskContext.get().partitionId() << 12)
        ids, held, texts, size = [], [], [], 0

        def row():
            body, words, n = packed(ids, held, texts)
            return pa.RecordBatch.from_arrays([pa.array([next(number)]), pa.array([body], pa.binary()),
                                               pa.array([words], pa.list_(pa.binary())), pa.array([n], pa.list_(pa.int64()))],
                                              names=["batch", "body", "words", "n"])

        for b in batches:
            body = b.column("body")
            body = body.cast(pa.large_binary() if pa.types.is_large_string(body.type) else pa.binary())
            for i, h, t in zip(b.column("id").to_pylist(), b.column("held").to_pylist(), body):
                t = t.as_py()
                if texts and size + len(t) > BATCH_BYTES:
                    yield row()
                    ids, held, texts, size = [], [], [], 0
                ids.append(i)
                held.append(h)
                texts.append(t)
                size += len(t)
        if texts:
            yield row()

    held = F.coalesce(F.pmod(F.crc32(F.col("id").cast("string")), F.lit(7)) == 2, F.lit(False))
    return documents(docs).select("id", held.alias("held"), "body").mapInArrow(run, PARTS)


def deal_words(batches):
    """One row per batch and bucket of words, of rows (batch, words, n)."""
    for b in batches:
        for batch, words, n in zip(b.column("batch").to_pylist(), b.column("words"), b.column("n")):
            words = words.as_py()
            n = n.values.to_numpy(zero_copy_only=False)
            bucket = np.fromiter(map(zlib.crc32, words), np.int64, len(words)) % WORD_BUCKETS
            order = np.argsort(bucket, kind="stable")
            starts = np.flatnonzero(np.diff(bucket[order], prepend=-1))
            edges = pa.array(np.append(starts, len(words)).astype(np.int32))
            dealt = [words[i] for i in order.tolist()]
            joined = [b"\n".join(b"" if w == END else w for w in dealt[i:j]) for i, j in zip(starts.tolist(), [*starts.tolist()[1:], len(dealt)])]
            yield pa.RecordBatch.from_arrays(
                [pa.array(bucket[order][starts].astype(np.int32)), pa.array(np.full(len(starts), batch)),
                 pa.ListArray.from_arrays(edges, pa.array(order.astype(np.int32))), pa.array(joined, pa.binary()),
                 pa.ListArray.from_arrays(edges, pa.array(n[order]))], names=["bucket", "batch", "at", "words", "n"])


def number_words(batches):
    """Rows of `deal_words`, sorted by bucket: the words of each bucket are numbered from the most frequent on, and counted."""
    def done(rows: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(rows).combine_chunks()
        words = [w for x in table.column("words") for w in x.as_py().split(b"\n")]
        code = pa.array(words, pa.binary()).dictionary_encode().indices.to_numpy()
        n = pc.list_flatten(table.column("n")).to_numpy()
        total = np.zeros(code.max() + 1, np.int64)
        np.add.at(total, code, n)
        rank = np.empty(len(total), np.int64)
        rank[np.argsort(-total, kind="stable")] = np.arange(len(total))
        node = rank * WORD_BUCKETS + table.column("bucket")[0].as_py()
        edges = pa.array(np.r_[0, np.cumsum(pc.list_value_length(table.column("n")).to_numpy())].astype(np.int32))
        lists = lambda x: pa.ListArray.from_arrays(edges, pa.array(x))
        once = lambda x: pa.array(np.r_[x, np.zeros(len(table) - 1, np.int64)])
        return pa.RecordBatch.from_arrays([pa.array(table.column("batch").to_numpy()), lists(pc.list_flatten(table.column("at")).to_numpy()),
                                           lists(node[code]), lists(total[code]), once(total.sum()), once((total > 0).sum())], names=["batch", "at", "node", "c", "total", "distinct"])

    kept, last = [], None
    for b in batches:
        bucket = b.column("bucket").to_numpy()
        starts = np.flatnonzero(np.diff(bucket, prepend=-1)).tolist()
        for i, j in zip(starts, [*starts[1:], len(bucket)]):
            if kept and bucket[i] != last:
                yield done(kept)
                kept = []
            kept.append(b.slice(i, j - i))
            last = bucket[i]
    if kept:
        yield done(kept)


def _mixed(parent: np.ndarray, word: np.ndarray) -> np.ndarray:
    """A hash of contexts."""
    x = (parent.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)) ^ (word.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)


class Batch:
    """The tokens of a batch on their way down the tree: `at` are the places that may still find a longer context."""

    #: After level 1: how often the word of each place follows its context, and how many different words do (`u`).
    counts = None

    def __init__(self, body: bytes):
        state = loose(body)
        if "word" in state:
            state["word"] = np.cumsum(state["word"])
        if "at" in state:
            state["at"], state["doc"] = np.flatnonzero(state["at"]), np.repeat(np.arange(-1, len(state["held"]), dtype=np.int32), state["doc"])
            state["train"] = ~state["held"][state["doc"]]
        n, u = (state.pop(x, None) for x in ("n", "u"))
        self.__dict__.update(state)
        if n is not None:
            self.parent = self.parent[self.stream[self.at - 1]]
            n = n[self.followed()[1]]
            self.counts = n, u
            u = u[self.parent]
            self.p = (n + u * ((self.c[self.stream[self.at]] + 1.0) / self.size)) / (self.t[self.parent] + u)
        elif "at" in state:
            self.p = self.p[self.followed()[1]]

    def body(self) -> bytes:
        """All that is needed to go on. Places and texts are told by marks and lengths. After level 1 the word before tells the
        context, and p follows from counts; later p is told once for each context and next word."""
        state = dict(self.__dict__)
        state.pop("counts", None)
        state["word"] = np.diff(self.word, prepend=0)
        if "at" in state:
            del state["train"]
            state.pop("ends", None)
            state["at"] = np.zeros(len(self.stream), bool)
            state["at"][self.at] = True
            state["doc"] = np.bincount(self.doc + 1, minlength=len(self.held) + 1)
            if self.counts is not None:
                state["parent"] = np.full(len(self.word), -1)
                state["parent"][self.stream[self.at - 1]] = self.parent
                n, state["u"] = self.counts
                state["n"] = n[self.followed()[0]]
                del state["p"]
            else:
                state["p"] = self.p[self.followed()[0]]
        return tight(state)

    def followed(self) -> tuple[np.ndarray, np.ndarray]:
        """Of the different pairs (context, word of the place): a place of each, and the pair of each place."""
        code = self.parent * len(self.word) + self.stream[self.at]
        order = np.argsort(code)
        new = np.diff(code[order], prepend=-1) > 0
        pair = np.empty(len(code), np.int64)
        pair[order] = np.cumsum(new) - 1
        return order[new], pair

    def start(self, known: dict, size: float) -> dict:
        """At the root, with numbers and counts of the words. Gives the columns of each text."""
        self.word, self.c = np.empty(len(known["c"]), np.int64), np.empty(len(known["c"]), np.int64)
        self.word[known["at"]], self.c[known["at"]] = known["node"], known["c"]
        order = np.argsort(self.word)  # from here on own numbers ascend with the numbers of the words
        own = np.empty(len(order), np.int32)
        own[order] = np.arange(len(order))
        self.stream, self.word, self.c, self.size = own[self.stream], self.word[order], self.c[order], size
        c = self.c[self.stream]
        starts = np.concatenate([[1], self.ends[:-1]])
        self.begins = starts
        self.at_root(size)
        total = lambda x: np.add.reduceat(x, starts)
        found, tokens, base = total((c > 0).astype(np.int64)), self.ends - starts, total(np.log10(c + 1.0))
        out = {"doc": np.arange(len(starts)), "delta": total(np.concatenate([[0], np.log10(self.p)])), "id": self.ids,
               "held": self.held, "tokens": tokens, "found": found, "base": base - tokens * math.log10(size)}
        del self.ids
        return out

    def at_root(self, size: float) -> None:
        c = self.c[self.stream]
        self.doc = np.repeat(np.arange(-1, len(self.ends)), [1, *(self.ends - self.begins)]).astype(np.int32)
        self.train = ~self.held[self.doc]
        self.at = np.arange(1, len(self.stream))
        self.p = (c[1:] + 1.0) / size
        self.parent, self.nodes = np.zeros(len(self.at), np.int64), np.zeros(1, np.int64)
        self.grows = c >= MIN_COUNT  # of a word: whether it may be a context

    def leave_root(self) -> None:
        """Nothing is kept that `at_root` can make again."""
        del self.doc, self.train, self.at, self.p, self.parent, self.nodes, self.grows

    def local(self, words: np.ndarray) -> np.ndarray:
        """Own numbers of words that are known to occur here."""
        return np.searchsorted(self.word, words)

    def keep(self, ok: np.ndarray) -> None:
        """Only some of the places."""
        self.at, self.p, self.parent = self.at[ok], self.p[ok], self.parent[ok]
        if self.counts is not None:
            n, u = self.counts
            self.counts = n[ok], u

    def candidates(self, d: int) -> None:
        """Go on with the tokens whose context of d words is a candidate: numbers of context and of (context, next word)."""
        ok = self.at - self.begins[self.doc[self.at]] + 1 >= d
        ok[ok] = self.grows[self.at[ok] - d if d == 1 else self.at[ok] - d + 1]
        self.keep(ok)
        width = len(self.word)
        self.contexts, self.context = np.unique(self.parent * width + self.stream[self.at - d], return_inverse=True)
        self.pairs, self.pair = np.unique(self.context * width + self.stream[self.at], return_inverse=True)

    def descend(self, d: int, known: dict) -> dict:
        """Take over what is known of level d ; gives how much the texts gain by it."""
        self.candidates(d)
        width = len(self.word)
        n = np.bincount(self.pair[self.train[self.at]], minlength=len(self.pairs))
        order = np.argsort(self.nodes, kind="stable")
        above = order[np.searchsorted(self.nodes, known["parent"], sorter=order)]
        mine = np.searchsorted(self.contexts, above * width + self.local(known["word"]))
        node, t, u = (np.full(len(self.contexts), -1, np.int64) for _ in range(3))
        for x, c in ((node, "node"), (t, "t"), (u, "u")):
            x[mine] = known[c]
        n[np.searchsorted(self.pairs, np.repeat(mine, known["long"]) * width + self.local(known["next"]))] = known["more"]
        return self.take(d, node, n, t, u)

    def take(self, d: int, node: np.ndarray, n: np.ndarray, t: np.ndarray, u: np.ndarray) -> dict:
        """Score with the retained contexts (node >= 0) of level d ; gives how much the texts gain by it."""
        kept = node[self.context] >= 0
        self.at, self.parent, before, n = self.at[kept], self.context[kept], self.p[kept], n[self.pair[kept]]
        self.nodes = node
        if d == 1:
            # Of a place: 0, or if the word before is a context that is often before it, how often, in steps.
            self.grows = np.zeros(len(self.stream), np.int32)
            self.grows[self.at] = np.where(n >= MIN_COUNT, 1 + (n >> COUNT_STEP), 0)
        self.counts, self.t = (n, u) if d == 1 else None, t
        u = u[self.parent]
        self.p = (n + u * before) / (t[self.parent] + u)
        gain = np.bincount(self.doc[self.at], np.log10(self.p / before)) if len(self.at) else np.zeros(0)
        doc = np.unique(self.doc[self.at])
        self.shrink(d, n)
        return {"doc": doc, "delta": gain[doc]}

    def shrink(self, d: int, n: np.ndarray) -> None:
        """Keep only places that may go on. How often a context of d + 1 words occurs is how often (`n`) its nearest word follows the
        rest of it, where that was retained; if that is too seldom, it can't be retained."""
        often = np.ones(len(self.stream), bool)
        often[self.at] = n >= MIN_COUNT
        ok = self.at - self.begins[self.doc[self.at]] >= d
        ok[ok] = self.grows[self.at[ok] - d] > 0
        ok &= often[self.at - 1]
        self.keep(ok)
        above, self.parent = np.unique(self.parent, return_inverse=True)
        self.nodes, self.t = self.nodes[above], self.t[above]
        if self.counts is not None:
            n, u = self.counts
            self.counts = n, u[above]
        # A place reaches back to the next one that does not grow; this one stays and ends the way in the shorter stream too.
        places = np.arange(len(self.stream))
        stop = np.maximum.accumulate(np.where(self.grows, 0, places))
        low = np.maximum(stop[self.at - d], self.begins[self.doc[self.at]] - 1)
        edge = np.zeros(len(places) + 1, np.int64)
        np.add.at(edge, low, 1)
        np.add.at(edge, self.at + 1, -1)
        needed = np.cumsum(edge[:-1]) > 0
        moved = np.concatenate([[0], np.cumsum(needed)])
        self.at, self.begins = moved[self.at], moved[self.begins]
        self.doc, self.grows = self.doc[needed], self.grows[needed]
        words, self.stream = np.unique(self.stream[needed], return_inverse=True)
        self.stream, self.word, self.c = self.stream.astype(np.int32), self.word[words], self.c[words]
        self.train = ~self.held[self.doc]

    @classmethod
    def merged(cls, batches: list[Batch]) -> Batch:
        """All batches as one; `doc` counts through the texts of all of them."""
        one = cls.__new__(cls)

        def joined(get, by=None):
            shift = np.cumsum([0, *[len(by(b)) for b in batches]])[:-1] if by else [0] * len(batches)
            return np.concatenate([get(b) + s if by else get(b) for b, s in zip(batches, shift)])

        stream = lambda b: b.stream
        one.word, first, word = np.unique(joined(lambda b: b.word), return_index=True, return_inverse=True)
        one.c = joined(lambda b: b.c)[first]
        one.stream = word[joined(stream, lambda b: b.word)].astype(np.int32)
        one.nodes, node = np.unique(joined(lambda b: b.nodes), return_inverse=True)
        one.parent = node[joined(lambda b: b.parent, lambda b: b.nodes)]
        one.at, one.begins = joined(lambda b: b.at, stream), joined(lambda b: b.begins, stream)
        one.doc, one.held = joined(lambda b: b.doc, lambda b: b.held), joined(lambda b: b.held)
        one.p, one.grows, one.train = joined(lambda b: b.p), joined(lambda b: b.grows), joined(lambda b: b.train)
        return one

    def alone(self, d: int) -> dict:
        """Level d, when no other batch has places: the test of `level_of` on the own counts."""
        self.candidates(d)
        k, width = len(self.contexts), max(len(self.word), 1)
        n = np.bincount(self.pair[self.train[self.at]], minlength=len(self.pairs))
        up = np.zeros(len(self.pairs), np.float32)
        up[self.pair] = self.p
        context, up, seen = self.pairs // width, up.astype(float), n > 0
        t, u = np.bincount(context, n, k).astype(np.int64), np.bincount(context[seen], minlength=k)
        ok = (t >= MIN_COUNT) & (u < t)
        use = seen & ok[context]
        c, m, up = context[use], n[use], up[use]
        with np.errstate(divide="ignore"):
            left = np.where(m > 1, (m - 1 + u[c] * up) / ((t[c] - 1 + u[c]) * up), (u[c] - 1) / (t[c] + u[c] - 2))
        kept = ok & (np.bincount(c, m * np.log(left), k) > GAIN)
        return self.take(d, np.where(kept, np.arange(k), -1), n, t, u)

    def send(self, d: int, part_rows: int, buckets: int) -> dict:
        """Candidates of level d with the words that follow them, their counts and what their suffixes give."""
        self.candidates(d)
        width = max(len(self.word), 1)
        n = np.bincount(self.pair[self.train[self.at]], minlength=len(self.pairs))
        up = np.zeros(len(self.pairs))
        up[self.pair] = self.p
        context, follows = self.pairs // width, self.word[self.pairs % width]
        far = self.contexts % width
        most = self.c[far]
        if d > 1:
            # All batches know the same of a context, so they deal it alike.
            most[self.context] = self.grows[self.at - d + 1].astype(np.int64) << COUNT_STEP
            most = np.minimum(most, self.t[self.contexts // width])
        parts = 1 + most // part_rows
        part = follows % parts[context]
        parent, word = self.nodes[self.contexts // width], self.word[far]
        bucket = _mixed(parent, word)[context]
        bucket = ((bucket + part.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)).astype(np.int64) % buckets
        order = np.lexsort((part, context, bucket))
        bucket, context, part = bucket[order], context[order], part[order]
        first = np.flatnonzero(np.r_[True, (context[1:] != context[:-1]) | (part[1:] != part[:-1])][:len(context)])
        long = np.diff(np.append(first, len(context)))
        rows = np.flatnonzero(np.diff(bucket[first], prepend=-1))
        own, keys, pairs = context[first], np.append(rows, len(first)), np.append(first[rows], len(context))
        out = {"bucket": bucket[first[rows]].astype(np.int32), "lists": blocks(
            [*((x, keys) for x in (parent[own], word[own], part[first], parts[own], long)),
             *((x, pairs) for x in (follows[order], n[order], up[order].astype(np.float32)))])}
        del self.contexts, self.context, self.pairs, self.pair
        return out


def step(d: int, size: float, buckets: int):
    """Of one batch: take over level d, send the candidates of level d + 1. Rows of three kinds: texts, candidates, state."""
    schema = to_arrow_schema(T.StructType.fromDDL(LEVEL))

    def run(part: pa.Table, rows: pa.Table) -> pa.Table:
        if not len(part):
            return schema.empty_table()
        number = part.column("batch")[0].as_py()
        flat = lambda c: pc.list_flatten(rows.column(c)).to_numpy()
        if d:
            told = opened(rows.column("answer").drop_null())[0]
            known = {c: np.concatenate([*told[i:i + 1], flat(c)]) for i, c in enumerate(KNOWN_OF)}
        else:
            known = {"at": flat("at"), "node": flat("node"), "c": flat("c")}
        batch = Batch(part.column("body")[0].as_py())
        if d == 1:
            batch.at_root(size)
        texts = batch.descend(d, known) if d else batch.start(known, size)
        # After the root a text only has a gain.
        kinds = [{c: [texts.get(c, [None] * len(texts["doc"]))] for c in TEXTS}, batch.send(d + 1, PART_ROWS, buckets)]
        goes_on = len(batch.at) > 0
        if not d:
            batch.leave_root()
        if goes_on:
            kinds.append({"body": [batch.body()], "places": [len(batch.stream)]})
        tables = []
        for kind in kinds:
            long = len(next(iter(kind.values())))
            kind["batch"] = np.full(long, number)
            tables.append(pa.table([pa.array(kind[f.name], f.type) if f.name in kind and not isinstance(kind[f.name], pa.Array)
                                    else kind.get(f.name, pa.nulls(long, f.type)) for f in schema], schema=schema))
        return pa.concat_tables(tables)

    return run


def finish(d: int):
    """Of all that goes on beyond level d, as one batch: what the texts gain on the levels that are left."""
    def run(rows: pa.Table) -> pa.Table:
        numbers_, batches = rows.column("batch").to_pylist(), [Batch(b.as_py()) for b in rows.column("body")]
        owner = np.repeat(numbers_, [len(b.held) for b in batches])
        doc = np.concatenate([np.arange(len(b.held)) for b in batches])
        batch, delta = Batch.merged(batches), np.zeros(len(owner))
        for level in numbers(d + 1):
            if not len(batch.at):
                break
            gain = batch.alone(level)
            delta[gain["doc"]] += gain["delta"]
        return pa.table({"batch": owner, "doc": doc, "delta": delta})

    return run


def counted(keys: np.ndarray, one: np.ndarray, batch: np.ndarray, long: np.ndarray, follows: np.ndarray, n: np.ndarray,
            up: np.ndarray) -> pa.Table:
    """Whole keys (parent, word, part; `one`: the only part), sorted, as lists of several batches: a row of counts for each key,
    and for each list a row with the totals of what other lists hold too."""
    lists = np.arange(len(keys))
    starts = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]).any(axis=1)])
    key_of = np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, len(keys)]))
    at = np.repeat(lists, long)
    key = key_of[at]
    order = np.lexsort((follows, key))
    k, f = key[order], follows[order]
    new = np.r_[True, (k[1:] != k[:-1]) | (f[1:] != f[:-1])][:len(k)]
    pair = np.empty(len(order), np.int64)
    pair[order] = np.cumsum(new) - 1
    first = order[new]
    total, held, up = np.bincount(pair, n).astype(np.int64), np.bincount(pair), up[first].astype(float)
    owner, many = key[first], len(starts)
    t, u = np.bincount(owner, total, many).astype(np.int64), np.bincount(owner[total > 0], minlength=many)
    once = np.bincount(owner[total == 1], minlength=many)
    # What can't be retained is not answered. Of several parts only all together tell.
    alive = ~one[starts] | ((t >= MIN_COUNT) & (u < t))
    use = (total > 1) & alive[owner]
    edges = lambda lengths: pa.array(np.r_[0, np.cumsum(lengths)].astype(np.int32))
    cut = edges(np.bincount(owner[use], minlength=many)[alive])

    def table(columns: dict, rows: int) -> pa.Table:
        return pa.table([columns[x.name] if isinstance(columns.get(x.name), pa.Array) else pa.array(columns[x.name], x.type)
                         if x.name in columns else pa.nulls(rows, x.type) for x in COUNTS_ARROW], schema=COUNTS_ARROW)

    sums = table({"parent": keys[starts, 0][alive], "word": keys[starts, 1][alive], "t": t[alive], "u": u[alive], "once": once[alive],
                  "n": pa.ListArray.from_arrays(cut, pa.array(total[use])),
                  "up": pa.ListArray.from_arrays(cut, pa.array(up[use]))}, int(alive.sum()))
    back = (held[pair] > 1) & (total[pair] > 0) & alive[key]
    lengths = np.bincount(at[back], minlength=len(lists))
    some = alive[key_of]
    cut = edges(lengths[some])
    answers = table({"parent": keys[some, 0], "word": keys[some, 1], "batch": batch[some],
                     "next": pa.ListArray.from_arrays(cut, pa.array(follows[back])),
                     "n": pa.ListArray.from_arrays(cut, pa.array(total[pair][back]))}, int(some.sum()))
    return pa.concat_tables([sums, answers])


def judged(keys: np.ndarray, batch: np.ndarray, long: np.ndarray, follows: np.ndarray, n: np.ndarray, up: np.ndarray,
           bucket: int) -> dict:
    """Whole keys (parent, word) in one part, sorted, as lists of several batches: of each list whose context is retained the batch and
    the columns KNOWN_OF, with the totals of what other lists hold too."""
    starts = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]).any(axis=1)])
    many = len(starts)
    owner = np.repeat(np.arange(many), np.diff(np.r_[starts, len(keys)]))
    at = np.repeat(np.arange(len(keys)), long)
    key = owner[at]
    order = np.lexsort((follows, key))
    k, f = key[order], follows[order]
    new = np.r_[True, (k[1:] != k[:-1]) | (f[1:] != f[:-1])]
    pair = np.empty(len(order), np.int64)
    pair[order] = np.cumsum(new) - 1
    first = order[new]
    total, held, above, context = np.bincount(pair, n).astype(np.int64), np.bincount(pair), up[first].astype(float), key[first]
    t, u = np.bincount(context, total, many).astype(np.int64), np.bincount(context[total > 0], minlength=many)
    ok = (t >= MIN_COUNT) & (u < t)
    use = (total > 0) & ok[context]
    c, m, above = context[use], total[use], above[use]
    with np.errstate(divide="ignore"):
        left = np.where(m > 1, (m - 1 + u[c] * above) / ((t[c] - 1 + u[c]) * above), (u[c] - 1) / (t[c] + u[c] - 2))
    kept = ok & (np.bincount(c, m * np.log(left), many) > GAIN)
    node = 1 + bucket + CONTEXT_BUCKETS * np.arange(many)
    by = np.flatnonzero(kept[owner])
    back = (held[pair] > 1) & (total[pair] > 0) & kept[key]
    return {"batch": batch[by], "parent": keys[by, 0], "word": keys[by, 1], "node": node[owner[by]], "t": t[owner[by]], "u": u[owner[by]],
            "long": np.bincount(at[back], minlength=len(keys))[by], "next": follows[back], "more": total[pair][back]}


def ragged(long: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Places of the values of lists (`long`: their lengths), if the lists come in another order."""
    length = long[order]
    return np.repeat((np.cumsum(long) - long)[order] - np.cumsum(length) + length, length) + np.arange(length.sum())


def answers_of(told: list[dict]) -> pa.RecordBatch:
    """One row per batch of what `judged` gave."""
    all_ = {c: np.concatenate([x[c] for x in told]) for c in ("batch", *KNOWN_OF)}
    order = np.argsort(all_["batch"], kind="stable")
    batch, place = all_["batch"][order], ragged(all_["long"], order)
    rows = np.flatnonzero(np.diff(batch, prepend=-1))
    wide = np.append(rows, len(order))
    deep = np.r_[0, np.cumsum(all_["long"][order])][wide]
    made = blocks([*((all_[c][order], wide) for c in KNOWN_OF[:6]), *((all_[c][place], deep) for c in KNOWN_OF[6:])])
    return pa.RecordBatch.from_arrays([pa.array(batch[rows]) if x.name == "batch" else pa.array(made, x.type) if x.name == "answer"
                                       else pa.nulls(len(rows), x.type) for x in ANSWERS_ARROW], schema=ANSWERS_ARROW)


def count_lists(batches):
    """Rows of `send`, sorted by bucket: contexts in one part are judged, those in several counted, a bucket at a time."""
    def done(rows: list[pa.RecordBatch]):
        table = pa.Table.from_batches(rows)
        (parent, word, part, parts, long, *values), many = opened(table.column("lists"))
        keys, one, batch = np.stack([parent, word, part], axis=1), parts == 1, np.repeat(table.column("batch").to_numpy(), many)
        order = np.lexsort(keys.T[::-1])
        for single in (True, False):
            mine = order[one[order] == single]
            if not len(mine):
                continue
            place = ragged(long, mine)
            lists = [x[place] for x in values]
            if single:
                told.append(judged(keys[mine, :2], batch[mine], long[mine], *lists, table.column("bucket")[0].as_py()))
            else:
                counts = counted(keys[mine], one[mine], batch[mine], long[mine], *lists)
                yield from pa.table([counts.column(x.name) if x.name in COUNTS_ARROW.names else pa.nulls(len(counts), x.type)
                                     for x in ANSWERS_ARROW], schema=ANSWERS_ARROW).to_batches()
        if sum(x.size for t in told for x in t.values()) > ANSWER_NUMBERS:
            yield answers_of(told)
            told.clear()

    told = []
    kept, last = [], None
    for b in batches:
        bucket = b.column("bucket").to_numpy()
        starts = np.flatnonzero(np.diff(bucket, prepend=-1)).tolist()
        for i, j in zip(starts, [*starts[1:], len(bucket)]):
            if kept and bucket[i] != last:
                yield from done(kept)
                kept = []
            kept.append(b.slice(i, j - i))
            last = bucket[i]
    if kept:
        yield from done(kept)
    if told:
        yield answers_of(told)


def level_of(seen: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """Of a level: what each batch gets back, its retained contexts (parent, word, node, t, u) with counts of the words after them that
    others hold too, all as lists; and the stored frames behind it."""
    # Lists are exchanged whole, once; single pairs never become rows.
    counts = stored(seen.select("bucket", "batch", "lists").repartition("bucket").sortWithinPartitions("bucket").mapInArrow(count_lists, ANSWERS))
    sums = counts.where("batch IS NULL").select("parent", "word", "t", "u", "once", "n", "up")
    totals = (sums.groupBy("parent", "word").agg(*[F.sum(c).alias(c) for c in ("t", "u", "once")])
              .where((F.col("t") >= MIN_COUNT) & (F.col("u") < F.col("t"))))
    # All that follow a context once have the same part in its gain.
    gain = F.col("gain") + F.expr("CASE WHEN once > 0 THEN once * ln((u - 1) / (t + u - 2)) ELSE 0 END")
    left = F.expr("aggregate(arrays_zip(n, up), 0D, (s, x) -> s + x.n * ln((x.n - 1 + u * x.up) / ((t - 1 + u) * x.up)))")
    nodes = stored(sums.select("parent", "word", "n", "up").join(totals, ["parent", "word"]).groupBy("parent", "word")
                   .agg(F.sum(left).alias("gain"), F.first("t").alias("t"), F.first("u").alias("u"), F.first("once").alias("once"))
                   .where(gain > GAIN).select("parent", "word", (F.monotonically_increasing_id() + IN_PARTS).alias("node"), "t", "u"))
    parts = counts.where("batch IS NOT NULL AND answer IS NULL").select("batch", "parent", "word", "next", F.col("n").alias("more")).join(
        nodes, ["parent", "word"]).select("batch", *[F.array(c).alias(c) for c in ("parent", "word", "node", "t", "u")],
                                          F.array(F.size("next").cast("bigint")).alias("long"), "next", "more")
    return counts.where("answer IS NOT NULL").select("batch", "answer").unionByName(parts, allowMissingColumns=True), [counts, nodes]


def score(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    spark = docs.sparkSession
    ship(spark)
    parts = stored(pack(docs))
    words = parts.select("batch", "words", "n").mapInArrow(deal_words, WORDS)
    known = stored(words.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(number_words, KNOWN))
    total, distinct = known.agg(F.sum("total"), F.sum("distinct")).first()
    n_tokens, size = total or 0, float((total or 0) + (distinct or 0) + 1)
    buckets = min(CONTEXT_BUCKETS, max(FEW_BUCKETS, 1 << (n_tokens // BUCKET_TOKENS).bit_length()))
    state = stored(parts.select("batch", "body"))
    remove([parts])
    old, levels = [state, known], []
    known = known.select("batch", "at", "node", "c")
    for d in numbers():
        level = stored(state.toDF("batch", "body").groupBy("batch").cogroup(known.groupBy("batch")).applyInArrow(step(d, size, buckets), LEVEL))
        levels.append(stored(level.where("doc IS NOT NULL").select("batch", F.explode(F.arrays_zip(*TEXTS)).alias("x"))
                             .select("batch", "x.*")))
        remove(old)
        state, seen = level.where("body IS NOT NULL").select("batch", "body"), level.where("bucket IS NOT NULL")
        old, places = [level], level.agg(F.sum("places")).first()[0]
        if not places:
            break
        if d and places <= REST_PLACES:
            rest = state.groupBy().applyInArrow(finish(d), "batch bigint, doc bigint, delta double")
            levels.append(stored(rest.select("batch", *[F.col(f.name) if f.name in rest.columns else F.lit(None).cast(f.dataType)
                                                        .alias(f.name) for f in levels[0].schema if f.name != "batch"])))
            break
        known, behind = level_of(seen)
        # The candidates are no longer needed while the next level is written, only the batches.
        state = stored(state)
        remove(old)
        old = [state, *behind]
        if known.isEmpty():
            break
    remove(old)
    one = lambda c: F.max(c).alias(c)
    texts = reduce(DataFrame.unionByName, levels).groupBy("batch", "doc").agg(
        *[one(c) for c in TEXTS[2:]], F.sum("delta").alias("score"))
    return texts.select(F.col("id").alias("doc_id"), F.col("held").alias("held_out"), F.col("tokens").alias("n_tokens"),
                        F.col("found").alias("n_known"), F.lit(n_tokens).cast("bigint").alias("train_tokens"),
                        F.col("base").alias("base_score"), "score")
