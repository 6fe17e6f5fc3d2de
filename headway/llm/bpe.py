"""Byte-level BPE encoding and decoding with a two-tier lookup.

A pre-token that is a token as a whole is resolved by a minimal perfect hash; the others are merged by rank with a heap
over a linked list of their bytes. The tables have the size of the vocabulary, are built once on the driver and are
broadcast. Each task resolves the distinct pre-tokens of a few MB of text at a time and remembers a bounded number.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from headway.llm.common import pieces

#: Resolved pre-tokens in a generation; a task remembers two, some 120 MB. What is used goes on to the younger one.
REMEMBERED, LONG = 300_000, 256
_BASE = np.uint64(0x9E3779B97F4A7C15)
_MIX = (np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53))


def mixed(h: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit finalizer over uint64."""
    h = h + np.uint64(seed * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    for m in _MIX:
        h = (h ^ (h >> np.uint64(33))) * m
    return h ^ (h >> np.uint64(33))


def hashes(words: list[bytes]) -> np.ndarray:
    """A 64-bit hash of each word: its bytes as digits of a polynomial, column by column over words sorted by length."""
    n = np.fromiter(map(len, words), np.int64, len(words))
    data = np.frombuffer(b"".join(words), np.uint8).astype(np.uint64)
    order = np.argsort(-n, kind="stable")
    start, length = (np.cumsum(n) - n)[order], n[order]
    h = np.full(len(words), 0x243F6A8885A308D3, np.uint64)
    alive = len(words)
    for k in range(int(length[0]) if alive else 0):
        alive = int(np.searchsorted(-length[:alive], -k, side="left"))
        h[:alive] = (h[:alive] ^ (data[start[:alive] + k] + np.uint64(1))) * _BASE
        h[:alive] ^= h[:alive] >> np.uint64(29)
    out = np.empty_like(h)
    out[order] = h
    return out


class PerfectHash:
    """A minimal perfect hash over distinct keys: levels of bits where a key alone in its place sets the bit, the others go to the next level. A key's number is the rank of its bit; a key not in the set may get any number or -1."""

    def __init__(self, keys: np.ndarray, load: float = 2.0, levels: int = 64):
        if len(np.unique(keys)) != len(keys):
            raise ValueError("the keys must be distinct")
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []
        rest, before = keys, 0
        while len(rest):
            if len(self.levels) == levels:
                raise ValueError("no perfect hash found")
            size = max(64, int(load * len(rest)))
            at = (mixed(rest, len(self.levels) + 1) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(at, minlength=size) == 1
            ranks = before + np.cumsum(alone) - 1
            self.levels.append((alone, ranks.astype(np.int32)))
            before = int(ranks[-1]) + 1
            rest = rest[~alone[at]]
        self.size = before

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        out, rest = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for k, (alone, ranks) in enumerate(self.levels):
            if not len(rest):
                break
            at = (mixed(keys[rest], k + 1) % np.uint64(len(alone))).astype(np.int64)
            hit = alone[at]
            out[rest[hit]] = ranks[at[hit]]
            rest = rest[~hit]
        return out


def heap_merge(word: bytes, ranks: dict[bytes, int]) -> tuple[int, ...]:
    """The word's ids: of all neighbours the pair of least rank, leftmost first, is merged until none is in the vocabulary. O(n log n).

    A heap entry is one integer of rank, start and end of a pair.
    """
    n, get, push, pop = len(word), ranks.get, heapq.heappush, heapq.heappop
    bits = n.bit_length()
    mask, twice = (1 << bits) - 1, 2 * bits
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [r << twice | i << bits | i + 2 for i in range(n - 1) if (r := get(word[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        entry = pop(heap)
        i, end = entry >> bits & mask, entry & mask
        j = after[i]
        if j < 0 or j >= n or after[j] != end:  # one of the two was merged meanwhile
            continue
        after[i], after[j] = end, -1
        if (p := before[i]) >= 0 and (r := get(word[p:end])) is not None:
            push(heap, r << twice | p << bits | end)
        if end < n:
            before[end] = i
            if (r := get(word[i : after[end]])) is not None:
                push(heap, r << twice | i << bits | after[end])
    out, i = [], 0
    while i < n:
        j = after[i]
        out.append(ranks[word[i:j]])
        i = j
    return tuple(out)


class Vocabulary:
    """The tables made from a rank file: lines of a base64 token and its rank."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f) if a}
        if missing := [b for b in range(256) if bytes((b,)) not in self.ranks]:
            raise ValueError(f"bytes without a rank: {missing}")
        words = list(self.ranks)
        self.pattern = pattern
        self.whole = PerfectHash(hashes(words))
        at = self.whole(hashes(words))
        self.words: list[bytes] = [b""] * len(words)
        self.ids = np.zeros(len(words), np.int64)
        for k, w in zip(at.tolist(), words):
            self.words[k], self.ids[k] = w, self.ranks[w]
        self.tokens: dict[int, bytes] = {v: k for k, v in self.ranks.items()}

    def resolve(self, words: list[bytes]) -> list[tuple[int, ...]]:
        """The ids of each pre-token."""
        if not words:
            return []
        at = self.whole(hashes(words)).tolist()
        return [(int(self.ids[k]),) if k >= 0 and self.words[k] == w else heap_merge(w, self.ranks) for k, w in zip(at, words)]


def _names(df: DataFrame, without: tuple[str, ...]) -> tuple[DataFrame, str]:
    df = df.select(*[c for c in df.columns if c not in without])
    return df, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)


def encode(docs: DataFrame, path: str, pattern: str, text: str = "text") -> DataFrame:
    """The rows plus ids array<int>: the text's tokens, each match of the pattern encoded by itself, without special tokens.

    Null and empty texts have no ids. Rows that repeat give equal ids each; an empty table gives no rows. A column named ids
    is replaced, others stay. `path` is a rank file that the driver can read. Pre-tokens are remembered from piece to piece,
    REMEMBERED of at most LONG characters; longer ones are resolved anew in each piece.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(Vocabulary(path, pattern))
    docs, schema = _names(docs, ("ids",))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab: Vocabulary = shared.value
        split, known, older = regex.compile(vocab.pattern).findall, {}, {}
        for batch in batches:
            for part in pieces(batch, text, 1 << 20):
                texts = [split(x) if x else [] for x in part.column(text).to_pylist()]
                if len(known) > REMEMBERED:
                    known, older = {}, known
                new = set(chain.from_iterable(texts)).difference(known)
                known.update((w, older[w]) for w in new.intersection(older))
                new = list(new.difference(older))
                known.update(zip(new, vocab.resolve([w.encode() for w in new])))
                ids = [np.fromiter(chain.from_iterable(map(known.__getitem__, x)), np.int32) for x in texts]
                for w in new:
                    if len(w) > LONG:
                        del known[w]
                offsets = np.zeros(len(ids) + 1, np.int32)
                np.cumsum([len(x) for x in ids], out=offsets[1:])
                col = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(ids) if ids else np.zeros(0, np.int32)))
                yield pa.RecordBatch.from_arrays([*part.columns, col], [*part.schema.names, "ids"])

    return docs.mapInArrow(run, f"{schema}, ids array<int>")


def decode(rows: DataFrame, path: str, pattern: str, ids: str = "ids") -> DataFrame:
    """The rows plus decoded binary: the bytes of the ids. Null ids: null; an id outside the vocabulary is an error. A column named decoded is replaced."""
    shared = rows.sparkSession.sparkContext.broadcast(Vocabulary(path, pattern).tokens)
    rows, schema = _names(rows, ("decoded",))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = shared.value.__getitem__
        for batch in batches:
            col = batch.column(ids)
            out = [None if not x.is_valid else b"".join(map(tokens, x.values.to_numpy(zero_copy_only=False).tolist())) for x in col]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.binary())], [*batch.schema.names, "decoded"])

    return rows.mapInArrow(run, f"{schema}, decoded binary")


def default_vocabulary() -> tuple[str, str]:
    """Path and pattern of the public vocabulary that the queries use."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
