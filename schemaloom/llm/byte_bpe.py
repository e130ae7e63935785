"""Byte-level BPE encoding and decoding with a two-tier lookup.

Tier one: a minimal perfect hash over the vocabulary resolves a pre-token that is itself a token. Tier
two: other pre-tokens are merged by rank with a heap over linked bytes, in n log n whatever their length.
Resolved pre-tokens are remembered in a bounded memo per worker. The vocabulary's arrays (about a
megabyte) are broadcast; one pass, no shuffle. Null texts count as empty.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from heapq import heapify, heappop, heappush
from itertools import chain

import numpy as np
import regex
import xxhash
from pyspark.sql import DataFrame, SparkSession

from schemaloom.llm.common import map_rows, table

#: Pre-tokens remembered per Python worker.
MEMO_TOKENS = 300_000


def read_ranks(path: str) -> dict[bytes, int]:
    """token -> rank from a file of base64 tokens and ranks."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def _place(h: int, d: int, n: int) -> int:
    """Slot of a hash under displacement d."""
    return (((h ^ d * 0x9E3779B97F4A7C15) * 0xD6E8FEB86659FD93 & 0xFFFFFFFFFFFFFFFF) >> 20) % n


class PerfectHash:
    """Minimal perfect hash: n keys to 0..n-1 by a displacement per small bucket, largest buckets placed first."""

    def __init__(self, keys: list[bytes], per_bucket: int = 4):
        n = self.n = len(keys)
        self.buckets = max(1, n // per_bucket)
        self.shift = [0] * self.buckets
        self.keys: list[bytes] = [b""] * n
        self.slot_of = [0] * n
        hashes = [xxhash.xxh3_64_intdigest(k) for k in keys]
        members: list[list[int]] = [[] for _ in range(self.buckets)]
        for i, h in enumerate(hashes):
            members[h % self.buckets].append(i)
        used, free = bytearray(n), 0
        for b in sorted(range(self.buckets), key=lambda b: -len(members[b])):
            if len(members[b]) > 1:
                at, d = [], -1
                while len(set(at)) < len(members[b]) or any(used[s] for s in at):
                    d += 1
                    at = [_place(hashes[i], d, n) for i in members[b]]
                self.shift[b] = d
            else:  # a key alone takes the next free slot, named outright
                if not members[b]:
                    break
                free = used.index(0, free)
                at, self.shift[b] = [free], -1 - free
            for i, s in zip(members[b], at):
                used[s], self.keys[s], self.slot_of[i] = 1, keys[i], s

    def __call__(self, key: bytes) -> int:
        """The key's slot, or -1 if it isn't a key."""
        if not self.n:
            return -1
        h = xxhash.xxh3_64_intdigest(key)
        d = self.shift[h % self.buckets]
        s = _place(h, d, self.n) if d >= 0 else -1 - d
        return s if self.keys[s] == key else -1


class Codec:
    """Encoder and decoder of one vocabulary."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.pattern = pattern
        self.tokens = PerfectHash(list(ranks))
        self.rank = [0] * len(ranks)
        for slot, r in zip(self.tokens.slot_of, ranks.values()):
            self.rank[slot] = r
        self.pair_rank = dict(ranks)  # of joined parts, for the heap
        self.bytes_of = {r: t for t, r in ranks.items()}
        self.memo = None

    def look_up(self, token: bytes) -> int:
        """The token's rank, or -1."""
        slot = self.tokens(token)
        return self.rank[slot] if slot >= 0 else -1

    def merge(self, piece: bytes) -> tuple[int, ...]:
        """Ranks of a pre-token that is not a token: the lowest-ranked, leftmost pair joins first."""
        n, rank = len(piece), self.pair_rank.get
        right, left = list(range(1, n + 1)), list(range(-1, n - 1))
        end = list(range(1, n + 1))  # where the part that begins here ends; 0 once it has been joined
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := rank(piece[i : i + 2])) is not None]
        heapify(heap)
        while heap:
            _, i, e = heappop(heap)
            j = right[i]
            if not end[i] or j >= n or end[j] != e:
                continue
            end[i], end[j] = e, 0
            right[i] = k = right[j]
            if k < n:
                left[k] = i
                if (r := rank(piece[i : end[k]])) is not None:
                    heappush(heap, (r, i, end[k]))
            if (h := left[i]) >= 0 and (r := rank(piece[h:e])) is not None:
                heappush(heap, (r, h, e))
        out, i = [], 0
        while i < n:
            r = rank(piece[i : end[i]])
            if r is None:
                raise ValueError(f"byte {piece[i]} is not in the vocabulary")
            out.append(r)
            i = right[i]
        return tuple(out)

    def encoder(self):
        """A function from str to an array of ids, with a memo."""
        find, codec = regex.compile(self.pattern).findall, self

        class Memo(dict):
            def __missing__(self, token: str) -> tuple[int, ...]:
                if len(self) >= MEMO_TOKENS:
                    self.clear()
                piece = token.encode()
                rank = codec.look_up(piece)
                self[token] = ids = (rank,) if rank >= 0 else codec.merge(piece)
                return ids

        memo = self.memo = Memo() if self.memo is None else self.memo  # lives as long as the worker process
        return lambda text: array("I", chain.from_iterable(map(memo.__getitem__, find(text))))

    def decode(self, ids) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


def encode(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids array<bigint>): the ids of each whole text."""
    return _with_codec(docs.select(id_col, text_col), ranks_path, pattern, f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, ids array<long>", lambda codec, enc: lambda i, t: (i, enc((t or b"").decode()).tolist()))


def decode(ids: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, decoded binary)."""
    return _with_codec(ids.select(id_col, ids_col), ranks_path, pattern, f"`{id_col}` {ids.schema[id_col].dataType.simpleString()}, decoded binary", lambda codec, enc: lambda i, t: (i, codec.decode(t or ())))


def digests(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens and the hex digests of the ids and of what they decode to, in one pass."""

    def make(codec, enc):
        def row(i, text):
            ids = enc((text or b"").decode())
            packed = np.frombuffer(ids, np.uint32).astype("<u4").tobytes() if ids else b""
            return i, len(ids), hashlib.sha256(packed).hexdigest(), hashlib.sha256(codec.decode(ids)).hexdigest()

        return row

    kind = docs.schema["doc_id"].dataType.simpleString()
    return _with_codec(docs.select("doc_id", "text"), ranks_path, pattern, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string", make)


def _with_codec(df: DataFrame, ranks_path: str, pattern: str, schema: str, row) -> DataFrame:
    shared = df.sparkSession.sparkContext.broadcast(Codec(read_ranks(ranks_path), pattern))

    def make():
        return row(shared.value, shared.value.encoder())

    return map_rows(df, make, schema)


def op4_byte_bpe(spark: SparkSession, sf_dir: str, ranks: str = "byte_bpe_50k.tiktoken") -> DataFrame:
    import public_tokenizers

    return digests(table(spark, sf_dir, "documents"), public_tokenizers.path(ranks), public_tokenizers.PATTERN)


QUERIES = {"op4_byte_bpe": op4_byte_bpe}
