"""BPE encoding and decoding with a minimal acyclic transducer as lexicon of the frequent words.

The pre-tokens ("words") of the whole corpus are counted; the most frequent ones (at most LEXICON) are compiled, sorted,
into a minimal acyclic automaton with shared suffixes. Its transitions carry numbers whose sum along a path is the word's
place in the lexicon (a perfect hash), which leads to the word's id sequence. The arrays are broadcast as one block of
bytes (its size bounded by LEXICON words of at most MAX_WORD bytes), which every Python worker writes to its own
temporary file once and memory-maps. Words that the automaton doesn't hold are merged exactly, lowest rank first and
leftmost on ties, with a heap, so a word of any length takes n log n steps. What the lexicon holds decides speed only.

The tokenizer file is a parameter; the driver reads it and sends its ranks. Special tokens inside a text get their own
ids, as the library does by default. Documents are not shuffled for encoding; the word counts are partial sums.

Defined cases: null text is empty, with no ids; repeated rows get equal results; any text decodes to itself.
"""

from __future__ import annotations

import hashlib
import heapq
import io
import json
import mmap
import struct
import tempfile
import uuid
from collections import Counter

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cached, cut_lineage, documents, map_texts, ship

LEXICON = 60_000
MIN_COUNT = 4
MAX_WORD = 64
#: Words a worker remembers: no more than the lexicon holds.
REMEMBERED = 60_000
NO_RANK = 1 << 30
#: Fixed: how byte-level BPE splits a text into words.
PATTERN = (r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+"
           r"|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+")


def _byte_of() -> dict[str, int]:
    """The printable character that stands for each byte in a byte-level vocabulary, the other way round."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Tokenizer:
    """Ranks and ids of a byte-level BPE file."""

    def __init__(self, content: str):
        data, byte = json.loads(content), _byte_of()
        self.special = {t["content"]: t["id"] for t in data["added_tokens"]}
        raw = lambda t: bytes(byte[c] for c in t)
        self.bytes_of = {i: raw(t) for t, i in data["model"]["vocab"].items() if t not in self.special}
        self.bytes_of |= {i: t.encode() for t, i in self.special.items()}
        self.id_of = {b: i for i, b in self.bytes_of.items() if i not in set(self.special.values())}
        pairs = [m if isinstance(m, list) else m.split(" ") for m in data["model"]["merges"]]
        self.rank = {(self.id_of[raw(a)], self.id_of[raw(b)]): r for r, (a, b) in enumerate(pairs)}
        self.merged = {p: self.id_of[self.bytes_of[p[0]] + self.bytes_of[p[1]]] for p in self.rank}
        self.single = [self.id_of[bytes([b])] for b in range(256)]
        # The short merge meets no pair as a tuple: bytes by table, later pairs as one number, results by rank.
        self.by_rank = [0] * len(pairs)
        for p, r in self.rank.items():
            self.by_rank[r] = self.merged[p]
        self.first = [[self.rank.get((a, b), NO_RANK) for b in self.single] for a in self.single]
        self.rank_of = {a << 32 | b: r for (a, b), r in self.rank.items()}

    def merge(self, word: bytes) -> list[int]:
        single = self.single
        ids = [single[b] for b in word]
        if len(ids) < 40:
            first, rank, by_rank = self.first, self.rank_of.get, self.by_rank
            ranks = [first[a][b] for a, b in zip(word, word[1:])]
            while ranks and (lowest := min(ranks)) < NO_RANK:
                i = ranks.index(lowest)
                ids[i] = new = by_rank[lowest]
                del ids[i + 1], ranks[i]
                if i < len(ranks):
                    ranks[i] = rank(new << 32 | ids[i + 1], NO_RANK)
                if i:
                    ranks[i - 1] = rank(ids[i - 1] << 32 | new, NO_RANK)
            return ids
        after, before, alive = list(range(1, len(ids) + 1)), list(range(-1, len(ids) - 1)), [True] * len(ids)
        heap = [(self.rank[p], i, *p) for i, p in enumerate(zip(ids, ids[1:])) if p in self.rank]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i]
            if not alive[i] or ids[i] != a or j >= len(ids) or not alive[j] or ids[j] != b:
                continue
            ids[i], alive[j], after[i] = self.merged[a, b], False, after[j]
            if after[i] < len(ids):
                before[after[i]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if 0 <= x and y < len(ids) and (ids[x], ids[y]) in self.rank:
                    heapq.heappush(heap, (self.rank[ids[x], ids[y]], x, ids[x], ids[y]))
        return [t for t, ok in zip(ids, alive, strict=True) if ok]


class Transducer:
    """Minimal acyclic automaton over bytes; a word's path sums to its place in the sorted lexicon."""

    ARRAYS = ("keys", "target", "skip", "final", "offsets", "ids")

    def __init__(self, **arrays):
        self.__dict__.update(arrays)

    @classmethod
    def compile(cls, words: list[bytes], ids: list[list[int]]):
        """words sorted and distinct. States are shared from the end as soon as no later word can change them."""
        edges, accepts, register = [{}], [False], {}

        def close(path, depth):
            while len(path) - 1 > depth:
                state, (parent, byte) = path[-1][0], path[-1][1]
                shape = (accepts[state], tuple(edges[state].items()))
                same = register.setdefault(shape, state)
                if same != state:
                    edges[parent][byte] = same
                path.pop()

        path, last = [(0, None)], b""
        for word in words:
            shared = 0
            while shared < min(len(word), len(last)) and word[shared] == last[shared]:
                shared += 1
            close(path, shared)
            for byte in word[shared:]:
                edges.append({})
                accepts.append(False)
                edges[path[-1][0]][byte] = len(edges) - 1
                path.append((len(edges) - 1, (path[-1][0], byte)))
            accepts[path[-1][0]], last = True, word
        close(path, 0)

        below: dict[int, int] = {}

        def count(root):
            stack = [root]
            while stack:
                s = stack[-1]
                todo = [t for t in edges[s].values() if t not in below]
                if todo:
                    stack += todo
                else:
                    below[s] = accepts[s] + sum(below[t] for t in edges[s].values())
                    stack.pop()
        count(0)
        number = {s: i for i, s in enumerate(sorted(below))}
        rows = []
        for s in below:
            skip = int(accepts[s])
            for byte, t in sorted(edges[s].items()):
                rows.append((number[s] << 8 | byte, number[t], skip))
                skip += below[t]
        table = np.array(sorted(rows), np.int64).reshape(-1, 3)
        return cls(keys=table[:, 0].copy(), target=table[:, 1].astype(np.int32), skip=table[:, 2].astype(np.int32),
                   final=np.array([accepts[s] for s in sorted(below)], np.bool_),
                   offsets=np.cumsum([0, *map(len, ids)]).astype(np.int64),
                   ids=np.array([i for x in ids for i in x], np.uint32))

    def dump(self) -> bytes:
        out = io.BytesIO()
        for name in self.ARRAYS:
            np.lib.format.write_array(out, getattr(self, name), allow_pickle=False)
        return out.getvalue()

    @classmethod
    def mapped(cls, content: bytes):
        """The arrays as views of a memory-mapped temporary file, which goes with the process."""
        with tempfile.TemporaryFile() as f:
            f.write(content)
            f.flush()
            area = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
        head, arrays = io.BytesIO(content), {}
        for name in cls.ARRAYS:
            np.lib.format.read_magic(head)
            shape, _, kind = np.lib.format.read_array_header_1_0(head)
            arrays[name] = np.frombuffer(area, kind, int(np.prod(shape)), head.tell())
            head.seek(arrays[name].nbytes, 1)
        return cls(**arrays)

    def find(self, words: list[bytes]) -> np.ndarray:
        """Place of each word in the lexicon, or -1: all words walk the automaton together, a byte a step."""
        if not len(self.keys):
            return np.full(len(words), -1)
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        text, starts = np.frombuffer(b"".join(words), np.uint8), np.cumsum(lengths) - lengths
        state, place = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        at, step = np.flatnonzero(lengths <= MAX_WORD), 0
        state[lengths > MAX_WORD] = -1
        while len(at := at[(lengths[at] > step) & (state[at] >= 0)]):
            key = state[at] << 8 | text[starts[at] + step]
            edge = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            ok = self.keys[edge] == key
            place[at] += np.where(ok, self.skip[edge], 0)
            state[at] = np.where(ok, self.target[edge], -1)
            step += 1
        return np.where((state >= 0) & self.final[np.maximum(state, 0)], place, -1)


class Encoder:
    """Per worker: the mapped lexicon, the merges, and the id bytes of words met before."""

    def __init__(self, value: tuple[str, bytes]):
        self.tokenizer, self.lexicon = Tokenizer(value[0]), Transducer.mapped(value[1])
        # Ids of the lexicon's words end to end, four bytes each.
        self.blob, self.ends = self.lexicon.ids.astype("<u4").tobytes(), (self.lexicon.offsets * 4).tolist()
        self.known: dict[str, bytes] = {}
        self.split = regex.compile(PATTERN).findall
        special = sorted(self.tokenizer.special, key=len, reverse=True)
        self.cut = regex.compile("(" + "|".join(map(regex.escape, special)) + ")").split if special else lambda t: [t]
        self.special = {t: np.array([i], "<u4").tobytes() for t, i in self.tokenizer.special.items()}
        size = max(self.tokenizer.bytes_of) + 1
        self.pieces = [self.tokenizer.bytes_of.get(i, b"") for i in range(size)]

    def learn(self, words: list[str]) -> None:
        if len(self.known) > REMEMBERED:
            self.known.clear()
        raw = [w.encode() for w in words]
        blob, ends, merge, known = self.blob, self.ends, self.tokenizer.merge, self.known
        for word, b, place in zip(words, raw, self.lexicon.find(raw).tolist(), strict=True):
            if place >= 0:
                known[word] = blob[ends[place]:ends[place + 1]]
            else:
                ids = merge(b)
                known[word] = struct.pack(f"<{len(ids)}I", *ids)

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """Ids of each text as little-endian 32-bit integers."""
        split = []
        for t in texts:
            parts = self.cut(t.decode("utf-8", "replace"))
            split.append([self.split(p) if i % 2 == 0 else [p] for i, p in enumerate(parts)])
        new = set()
        for parts in split:
            for p in parts[::2]:
                new.update(p)
        if len(self.known) > REMEMBERED:
            self.known.clear()
        self.learn([w for w in new if w not in self.known])
        get = self.known.__getitem__
        return [b"".join(b"".join(map(get, p)) if i % 2 == 0 else self.special[p[0]] for i, p in enumerate(parts))
                for parts in split]

    def decode(self, ids: bytes) -> bytes:
        raw = b"".join(map(self.pieces.__getitem__, np.frombuffer(ids, "<u4").tolist()))
        return raw.decode("utf-8", "replace").encode()


def count_words(docs: DataFrame) -> DataFrame:
    """(word, n) over all pre-tokens of all documents, as UTF-8."""
    def run(batches):
        split, seen = regex.compile(PATTERN).findall, Counter()
        for batch in batches:
            for text in batch.column(0):
                seen.update(split(text.as_py() or ""))
            if len(seen) > REMEMBERED:
                yield pa.RecordBatch.from_arrays([pa.array(seen.keys(), pa.string()), pa.array(seen.values(), pa.int64())],
                                                 names=["word", "n"])
                seen = Counter()
        yield pa.RecordBatch.from_arrays([pa.array(seen.keys(), pa.string()), pa.array(seen.values(), pa.int64())],
                                         names=["word", "n"])

    ship(docs.sparkSession)
    partial = documents(docs).select("body").mapInArrow(run, "word string, n bigint")
    return partial.groupBy("word").agg(F.sum("n").alias("n"))


def frequent_words(docs: DataFrame, limit: int = LEXICON) -> list[bytes]:
    """The words above the smallest count that keeps at most `limit` of them (counts in steps of an eighth octave)."""
    counts = count_words(docs).where((F.col("n") >= MIN_COUNT) & (F.octet_length("word") <= MAX_WORD))
    counts = cut_lineage(counts.withColumn("grade", F.floor(F.log2("n") * 8).cast("int")))
    kept, lowest = 0, None
    for r in sorted(counts.groupBy("grade").count().collect(), key=lambda r: -r["grade"]):
        if kept + r["count"] > limit:
            break
        kept, lowest = kept + r["count"], r["grade"]
    if lowest is None:
        return []
    return sorted(r["word"].encode() for r in counts.where(F.col("grade") >= lowest).select("word").collect())


def encoder(docs: DataFrame, path: str, limit: int = LEXICON):
    """(key, broadcast) from which workers build their Encoder."""
    with open(path, encoding="utf-8") as f:
        content = f.read()
    tokenizer, words = Tokenizer(content), frequent_words(docs, limit)
    lexicon = Transducer.compile(words, [tokenizer.merge(w) for w in words])
    return f"bpe-{uuid.uuid4().hex}", docs.sparkSession.sparkContext.broadcast((content, lexicon.dump()))


def encode(df: DataFrame, key: str, sent, keep: list[str]) -> DataFrame:
    """Columns `keep` of df and, for its column `body`: n_tokens, ids, decoded."""
    def make():
        def step(texts):
            e = cached(key, sent, Encoder)
            ids = e.encode(texts)
            sizes = [len(x) // 4 for x in ids]
            lists = pa.ListArray.from_arrays(np.cumsum([0, *sizes]).astype(np.int32), np.frombuffer(b"".join(ids), "<i4"))
            return [sizes, lists, [e.decode(x).decode() for x in ids]]
        return step
    return map_texts(df, make, "n_tokens bigint, ids array<int>, decoded string", keep)


def encode_digests(docs: DataFrame, path: str) -> DataFrame:
    """Digest per document: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    key, sent = encoder(docs, path)

    def make():
        def step(texts):
            e = cached(key, sent, Encoder)
            ids = e.encode(texts)
            return [[len(x) // 4 for x in ids], [hashlib.sha256(x).hexdigest() for x in ids],
                    [hashlib.sha256(e.decode(x)).hexdigest() for x in ids]]
        return step
    return (map_texts(documents(docs), make, "n_tokens bigint, ids_sha256 string, decoded_sha256 string", ["id"])
            .withColumnRenamed("id", "doc_id"))


def stage(docs: DataFrame, path: str) -> DataFrame:
    """The columns of `docs`, the text as decoded again, plus `bpe_ids` (array of int) and `bpe_length`."""
    key, sent = encoder(docs, path)
    # The text goes to Python once, outside the row that passes through.
    rows = docs.select(F.struct(*[c for c in docs.columns if c != "text"]).alias("row"),
                       F.coalesce(F.col("text"), F.lit("")).alias("body"))
    done = encode(rows, key, sent, ["row"])
    new = {"bpe_length": "n_tokens", "bpe_ids": "ids"}
    return done.select(*[F.col("decoded").alias(c) if c == "text" else F.col("row").getField(c).alias(c)
                         for c in docs.columns if c not in new], *[F.col(v).alias(k) for k, v in new.items()])
