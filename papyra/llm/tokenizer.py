"""Encoding of texts with a public byte-level BPE vocabulary.

Two tiers resolve a pre-token. A minimal perfect hash over the vocabulary (hash and displace) answers for pre-tokens that
are a vocabulary entry; the others go through a heap of candidate merges over a linked list of byte symbols, which costs
O(n log n) for a pre-token of n bytes. Resolved pre-tokens stay in a bounded per-worker memory. A text may be cut before
any line feed that follows a non-blank, as no pre-token of the splitting pattern can span such a place; runs of ASCII
lines so take the faster of two equivalent patterns.

Null and empty texts both give an empty list. Special tokens are never produced: their strings are ordinary text.
"""

from __future__ import annotations

import base64
import heapq
import re
import uuid
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

# The splitting pattern of the vocabulary, and the same for text of ASCII only.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
ASCII_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\sA-Za-z0-9]+|\s+(?!\S)|\s+"

#: Bound of the per-worker memory of pre-tokens, in entries; beyond it the memory starts anew. It changes speed, never ids.
WORDS = 300_000


def read_ranks(path: str) -> list[bytes]:
    """Vocabulary entries in the order of their ids from a rank file (``base64 rank`` on each line)."""
    with open(path, "rb") as f:
        pairs = [line.split() for line in f if line.strip()]
    entries = {int(rank): base64.b64decode(token) for token, rank in pairs}
    return [entries[i] for i in range(len(entries))]


def _mix(h: np.ndarray, d: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = h ^ (d.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        return x ^ (x >> np.uint64(29))


class PerfectHash:
    """Minimal perfect hash of a fixed set of byte strings: slot i of n holds exactly one key, found by one displacement."""

    def __init__(self, keys: list[bytes]):
        n = len(keys)
        self.n, self.buckets = n, max(1, n // 3)
        hashes = np.array([xxhash.xxh3_64_intdigest(k) for k in keys], dtype=np.uint64)
        if len(np.unique(hashes)) != n:
            raise ValueError("two keys share a 64-bit hash")
        home = (hashes % np.uint64(self.buckets)).astype(np.int64)
        order = np.argsort(home, kind="stable")
        starts = np.searchsorted(home[order], np.arange(self.buckets + 1))
        sizes = np.diff(starts)
        self.displace = np.zeros(self.buckets, dtype=np.int32)
        self.key_at = np.full(n, -1, dtype=np.int32)
        taken = np.zeros(n, dtype=bool)
        for b in np.argsort(-sizes, kind="stable"):
            if sizes[b] < 2:
                break
            members = order[starts[b] : starts[b + 1]]
            tries = np.arange(1, 65, dtype=np.uint64)
            while True:
                slots = (_mix(hashes[members][None, :], tries[:, None]) % np.uint64(n)).astype(np.int64)
                fits = ~taken[slots].any(axis=1)
                for row in np.flatnonzero(fits):
                    if len(set(slots[row].tolist())) == len(members):
                        break
                else:
                    tries = tries + np.uint64(64)
                    continue
                self.displace[b] = tries[row]
                taken[slots[row]] = True
                self.key_at[slots[row]] = members
                break
        free = iter(np.flatnonzero(~taken).tolist())
        for b in np.flatnonzero(sizes == 1):
            slot = next(free)
            self.displace[b] = -slot - 1
            self.key_at[slot] = order[starts[b]]

    def find(self, keys: list[bytes]) -> np.ndarray:
        """For each key the index it would have if it were one of the set; the caller compares."""
        h = np.fromiter((xxhash.xxh3_64_intdigest(k) for k in keys), dtype=np.uint64, count=len(keys))
        d = self.displace[(h % np.uint64(self.buckets)).astype(np.int64)]
        slots = (_mix(h, np.maximum(d, 0)) % np.uint64(self.n)).astype(np.int64)
        return self.key_at[np.where(d < 0, -d - 1, slots)]


class Encoder:
    def __init__(self, vocabulary: list[bytes], index: PerfectHash | None = None):
        self.vocabulary = vocabulary
        self.index = index or PerfectHash(vocabulary)
        self.rank: dict[bytes, int] | None = None
        self.words: dict[str, bytes] = {}
        self.split = regex.compile(PATTERN).findall
        self.split_ascii = re.compile(ASCII_PATTERN, re.ASCII).findall

    def merge(self, word: bytes) -> list[int]:
        """Ids of a pre-token that is no vocabulary entry: the lowest-ranked adjacent pair is merged first, leftmost on ties."""
        if self.rank is None:
            self.rank = {t: i for i, t in enumerate(self.vocabulary)}
        rank, n = self.rank, len(word)
        part = [word[i : i + 1] for i in range(n)]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, 2) for i in range(n - 1) if (r := rank.get(word[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, size = heapq.heappop(heap)
            j = after[i] if part[i] else n
            if not part[i] or j >= n or len(part[i]) + len(part[j]) != size:
                continue
            part[i] += part[j]
            part[j] = b""
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                both = part[i] + part[k]
                if (r := rank.get(both)) is not None:
                    heapq.heappush(heap, (r, i, len(both)))
            h = before[i]
            if h >= 0:
                both = part[h] + part[i]
                if (r := rank.get(both)) is not None:
                    heapq.heappush(heap, (r, h, len(both)))
        return [rank[p] for p in part if p]

    def learn(self, fresh: set[str]) -> None:
        """Resolve pre-tokens not seen before: the perfect hash first, the heap for what it misses."""
        texts = list(fresh)
        raw = [t.encode() for t in texts]
        vocabulary = self.vocabulary
        for text, word, i in zip(texts, raw, self.index.find(raw).tolist()):
            ids = [i] if vocabulary[i] == word else self.merge(word)
            self.words[text] = array("i", ids).tobytes()

    def pretokens(self, text: str) -> list[str]:
        if text.isascii():
            return self.split_ascii(text)
        lines = text.split("\n")
        parts, start = [], 0
        for i in range(1, len(lines)):
            last = lines[i - 1]
            # only here can the text be cut, and only where the two patterns take turns need it be
            if last and not last[-1].isspace() and lines[i].isascii() != lines[start].isascii():
                parts.append(("\n" if start else "") + "\n".join(lines[start:i]))
                start = i
        parts.append(("\n" if start else "") + "\n".join(lines[start:]))
        out: list[str] = []
        for part in parts:
            out += self.split_ascii(part) if part.isascii() else self.split(part)
        return out

    def batch(self, texts: Iterable[str | None]) -> list[bytes]:
        """Ids of each text as little-endian 32-bit integers."""
        split = [self.pretokens(t) if t else [] for t in texts]
        used = set().union(*split)
        fresh = used.difference(self.words)
        if len(self.words) + len(fresh) > WORDS:
            self.words.clear()
            fresh = used
        self.learn(fresh)
        known = self.words.__getitem__
        return [b"".join(map(known, words)) for words in split]


_ENCODERS: dict[str, Encoder] = {}


def encode(df: DataFrame, ranks_path: str, key: str = "doc_id", text: str = "text", out: str = "ids") -> DataFrame:
    """``key`` and ``out`` (list of integers) for each row of ``df``.

    Null and empty texts give an empty list, blank ones their ids; repeated rows are kept as they are; other columns of
    ``df`` are not read. The vocabulary is read on the driver and broadcast: its size is that of one file of at most 16 MB.
    """
    spark: SparkSession = df.sparkSession
    vocabulary = read_ranks(ranks_path)
    if sum(map(len, vocabulary)) > 16_000_000:
        raise ValueError("the vocabulary is too large to be broadcast")
    shared = spark.sparkContext.broadcast((vocabulary, PerfectHash(vocabulary)))
    token = uuid.uuid4().hex  # names the broadcast in the memory of reused workers
    name = df.schema[key].dataType
    schema = T.StructType([T.StructField(key, name), T.StructField(out, T.ArrayType(T.IntegerType(), False))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _ENCODERS.get(token)
        if encoder is None:
            _ENCODERS.clear()
            encoder = _ENCODERS[token] = Encoder(*shared.value)
        for batch in batches:
            # slices bound what is in memory at once, as texts may be long
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                ids = encoder.batch(part.column(1).to_pylist())
                ends = np.cumsum([0, *[len(x) // 4 for x in ids]], dtype=np.int64)
                values = pa.array(np.frombuffer(b"".join(ids), dtype=np.int32))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), values)], names=[key, out])

    return df.select(key, text).mapInArrow(run, schema)
