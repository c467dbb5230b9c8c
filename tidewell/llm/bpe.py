"""Byte-level BPE, encoding and decoding.

A text is cut into pre-tokens by the tokenizer's pattern.  Two tiers resolve
them: a minimal perfect hash over the vocabulary's byte strings finds
pre-tokens that are tokens themselves; the others are merged from their bytes,
a linked list whose adjacent pairs wait in a heap by rank.  Each Python worker
remembers the pre-tokens that it resolved, up to a bound.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import lean


class PerfectHash:
    """A minimal perfect hash of byte strings: hash, then displace.

    Keys fall into small buckets; the fullest first, each bucket looks for a
    displacement that sends all its keys to free slots.  The slots are exactly
    as many as the keys; the key kept in a slot tells strangers from members.
    """

    def __init__(self, keys: list[bytes], load: int = 4):
        import xxhash

        self.size = n = len(keys)
        self.buckets = max(1, n // load)
        h = np.array([xxhash.xxh3_64_intdigest(k) for k in keys], np.uint64)
        if len(np.unique(h)) != n:
            raise ValueError("keys must be distinct")
        bucket, a, b = self._parts(h)
        self.displace = np.zeros(self.buckets, np.int64)
        self.slot_of = np.zeros(n, np.int64)
        free = np.ones(n, bool)
        order = np.argsort(bucket, kind="stable")
        starts = np.searchsorted(bucket[order], np.arange(self.buckets + 1))
        sizes = np.diff(starts)
        for i in np.argsort(-sizes, kind="stable").tolist():
            own = order[starts[i] : starts[i + 1]]
            if not len(own):
                break
            base, step = 0, 16
            while True:
                d = np.arange(base, base + step, dtype=np.uint64)
                slots = self._slots(a[own][None, :], b[own][None, :], d[:, None])
                ok = free[slots].all(1)
                if len(own) > 1:
                    s = np.sort(slots, axis=1)
                    ok &= (s[:, 1:] != s[:, :-1]).all(1)
                hit = np.flatnonzero(ok)
                if len(hit):
                    break
                base += step
                step = min(step * 4, 16384)
                if base > 1 << 26:
                    raise ValueError("no displacement found")
            self.displace[i] = base + int(hit[0])
            self.slot_of[own] = slots[hit[0]]
            free[slots[hit[0]]] = False
        self.keys: list[bytes] = [b""] * n
        for k, s in zip(keys, self.slot_of.tolist(), strict=True):
            self.keys[s] = k

    def _parts(self, h):
        return (h % np.uint64(self.buckets)).astype(np.int64), h >> np.uint64(20), (h >> np.uint64(7)) | np.uint64(1)

    def _slots(self, a, b, d):
        # Uniform over the slots for each displacement: multiply, fold, reduce.
        v = (a + d * b) * np.uint64(0x9E3779B97F4A7C15)
        v ^= v >> np.uint64(29)
        return (v % np.uint64(self.size)).astype(np.int64)

    def slots(self, keys: list[bytes]) -> list[int]:
        """The slot of each key, or -1."""
        import xxhash

        if not self.size or not keys:
            return [-1] * len(keys)
        h = np.fromiter((xxhash.xxh3_64_intdigest(k) for k in keys), np.uint64, len(keys))
        bucket, a, b = self._parts(h)
        found = self._slots(a, b, self.displace[bucket].astype(np.uint64)).tolist()
        own = self.keys
        return [s if own[s] == k else -1 for s, k in zip(found, keys, strict=True)]


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Merge bytes by rank, the lowest first and the leftmost of equals, in O(n log n)."""
    n, get, pop, push = len(piece), ranks.get, heapq.heappop, heapq.heappush
    after, before = list(range(1, n + 2)), list(range(-1, n))
    # pair[i]: the rank of the part at i joined with the next, or -1.  A heap entry is rank * (n + 1) + i
    # and is stale once pair[i] has another rank.
    pair = [get(piece[i : i + 2], -1) for i in range(n)]
    pair[n - 1] = -1
    wide = n + 1
    heap = [r * wide + i for i, r in enumerate(pair) if r >= 0]
    heapq.heapify(heap)
    while heap:
        r, i = divmod(pop(heap), wide)
        if pair[i] != r:
            continue
        j = after[i]
        after[i] = stop = after[j]
        pair[j] = -1
        if stop < n:
            before[stop] = i
            pair[i] = r = get(piece[i : after[stop]], -1)
            if r >= 0:
                push(heap, r * wide + i)
        else:
            pair[i] = -1
        h = before[i]
        if h >= 0:
            pair[h] = r = get(piece[h:stop], -1)
            if r >= 0:
                push(heap, r * wide + h)
    out, i = [], 0
    while i < n:
        j = after[i]
        out.append(ranks[piece[i:j]])
        i = j
    return out


class Codec:
    """Encodes and decodes with one vocabulary of ranks and one pre-token pattern."""

    #: Pre-tokens remembered in each of two generations, and the longest of them.
    REMEMBERED, LONGEST = 150_000, 64

    def __init__(self, ranks: dict[bytes, int], pattern: str, remembered: int = REMEMBERED):
        import regex

        self.remembered = remembered

        self.ranks = ranks
        self.find = regex.compile(pattern).findall
        self.bytes_of = {v: k for k, v in ranks.items()}
        self.text_of = {v: str(v) for v in self.bytes_of}
        self.hash = PerfectHash(list(ranks))
        self.id_at = [ranks[k] for k in self.hash.keys]
        self.young: dict[str, tuple[int, ...]] = {}
        self.old: dict[str, tuple[int, ...]] = {}

    def resolve(self, pieces: list[str]) -> dict[str, tuple[int, ...]]:
        """Ids of distinct pre-tokens: by the perfect hash, else by merging."""
        raw = [p.encode("utf-8", "surrogatepass") for p in pieces]
        slots = self.hash.slots(raw)
        return {
            p: (self.id_at[s],) if s >= 0 else tuple(merge(b, self.ranks)) for p, b, s in zip(pieces, raw, slots, strict=True)
        }

    def encode(self, text: str | None) -> list[int]:
        pieces = self.find(text or "")
        if len(self.young) > self.remembered:
            self.old, self.young = self.young, {}
        young, old = self.young, self.old
        long: dict[str, tuple[int, ...]] = {}
        if new := set(pieces).difference(young):
            if len(new) > self.remembered:  # one text with that many is not remembered
                known = self.resolve(list(new)) | {p: young[p] for p in set(pieces) - new}
                return list(chain.from_iterable(map(known.__getitem__, pieces)))
            for p in [p for p in new if p in old]:
                young[p] = old[p]
            learnt = self.resolve([p for p in new if p not in young])
            long = {p: v for p, v in learnt.items() if len(p) > self.LONGEST}
            for p in long:
                del learnt[p]
            young.update(learnt)
        if long:  # used, but not remembered
            return [i for p in pieces for i in (long[p] if p in long else young[p])]
        return list(chain.from_iterable(map(young.__getitem__, pieces)))

    def decode(self, ids) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


@dataclass(frozen=True)
class Vocabulary:
    """Where the ranks come from: the text of a .tiktoken file, and the pattern.

    Read on the driver and broadcast; its size is that of the file.
    """

    lines: bytes
    pattern: str

    @classmethod
    def read(cls, path: str, pattern: str) -> Vocabulary:
        with open(path, "rb") as f:
            return cls(f.read(), pattern)

    def ranks(self) -> dict[bytes, int]:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, self.lines.splitlines()) if a}


@lru_cache(maxsize=2)
def codec(vocabulary: Vocabulary, remembered: int = Codec.REMEMBERED) -> Codec:
    """One codec a worker process: building the hash takes a second or so."""
    return Codec(vocabulary.ranks(), vocabulary.pattern, remembered)


def encoded(df: DataFrame, vocabulary: Vocabulary, text_col: str = "text", ids: bool = False, remembered: int = Codec.REMEMBERED) -> DataFrame:
    """``df`` with n_tokens, ids_sha256 and decoded_sha256, and ``ids`` if asked for.

    Null text is empty text: 0 tokens.  ids_sha256 is of the decimal ids joined
    by one space, decoded_sha256 of the bytes that the ids decode to.  Every
    text is encoded whole; special tokens are ordinary text.  Columns of those
    names in ``df`` are replaced.  ``remembered`` bounds the pre-tokens that a
    worker keeps, for speed alone.
    """
    df = df.drop("n_tokens", "ids_sha256", "decoded_sha256", *["ids"] * ids)
    names, at = df.columns, df.columns.index(text_col)
    held = df.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(held.value, remembered)
        for b in batches:
            for start in range(0, b.num_rows, 256):
                part = b.slice(start, 256)
                count, of_ids, of_bytes, all_ids = [], [], [], []
                for t in part.column(at):
                    got = own.encode(t.as_py())
                    count.append(len(got))
                    of_ids.append(hashlib.sha256(" ".join(map(own.text_of.__getitem__, got)).encode()).hexdigest())
                    of_bytes.append(hashlib.sha256(own.decode(got)).hexdigest())
                    if ids:
                        all_ids.append(got)
                more = [pa.array(count, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_bytes, pa.string())]
                if ids:
                    more.append(pa.array(all_ids, pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays([*part.columns, *more], [*names, *added])

    from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructType

    added = ["n_tokens", "ids_sha256", "decoded_sha256", *["ids"] * ids]
    schema = StructType([*df.schema.fields]).add("n_tokens", LongType()).add("ids_sha256", StringType()).add("decoded_sha256", StringType())
    return df.mapInArrow(lean(run), schema.add("ids", ArrayType(IntegerType())) if ids else schema)


def decoded(df: DataFrame, vocabulary: Vocabulary, ids_col: str = "ids", out_col: str = "bytes") -> DataFrame:
    """``df`` with the bytes that ``ids_col`` decodes to; null ids give null."""
    names, at = df.columns, df.columns.index(ids_col)
    held = df.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(held.value, Codec.REMEMBERED)
        for b in batches:
            out = [None if (v := x.as_py()) is None else own.decode(v) for x in b.column(at)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.binary())], [*names, out_col])

    from pyspark.sql.types import BinaryType, StructType

    return df.mapInArrow(run, StructType([*df.schema.fields]).add(out_col, BinaryType()))
