"""Byte-level BPE encoding and decoding with a two-tier lookup.

Tier one: a minimal perfect hash over the vocabulary maps a whole pre-token to its rank; the bytes stored at its slot
confirm the hit. Tier two, for pre-tokens that are no single token: a heap of adjacent pairs over a doubly linked list
of bytes merges the pair of lowest rank, leftmost first; stale heap entries are skipped. A pre-token of n bytes takes
n log n steps, so very long runs of letters are no trouble.

Pre-tokens are the matches of the public split pattern; matches never reach over a chunk's end (see ``ChunkEncoder``), so a
chunk goes through both tiers once and its ids are remembered while the memo has room.

Defined results: a null or empty text has no ids (and the digests of no bytes); repeated rows are encoded one by one;
an empty table gives no row; further columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from array import array
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import public_tokenizers
import regex
import xxhash
from pyspark.sql import DataFrame, SparkSession

from tidewater.llm.common import MEMO_ENTRIES, ChunkEncoder, map_rows, read_table


class PerfectHash:
    """Minimal perfect hash of byte strings: in each level a key that is alone in its slot stays there, the others go
    on to the next level; the number of taken slots before a key's slot is its index, 0 to n - 1 without gaps."""

    def __init__(self, keys: list[bytes], room: float = 2.0):
        self.levels: list[tuple[int, array]] = []
        self.order = np.empty(len(keys), np.int64)  # index -> position in keys
        left, taken = np.arange(len(keys)), 0
        while len(left):
            seed, size = len(self.levels), max(1, int(room * len(left)))
            slot = np.array([xxhash.xxh3_64_intdigest(keys[i], seed) % size for i in left.tolist()], np.int64)
            alone = np.bincount(slot, minlength=size) == 1
            index = np.where(alone, taken + np.cumsum(alone) - 1, -1)
            here = alone[slot]
            self.order[index[slot[here]]] = left[here]
            self.levels.append((size, array("i", index.astype(np.int32).tolist())))
            taken += int(alone.sum())
            left = left[~here]

    def find(self, key: bytes) -> int:
        """The index of ``key``; any index or -1 if it isn't one of the keys."""
        for seed, (size, index) in enumerate(self.levels):
            i = index[xxhash.xxh3_64_intdigest(key, seed) % size]
            if i >= 0:
                return i
        return -1


class ByteBPE:
    """Encoder and decoder for a rank file (lines of base64 token and rank)."""

    held: dict[str, "ByteBPE"] = {}

    @classmethod
    def of(cls, path: str, pattern: str) -> "ByteBPE":
        key = f"{path}\n{pattern}"
        if key not in cls.held:
            cls.held[key] = cls(path, pattern)
        return cls.held[key]

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as f:
            pairs = [(base64.b64decode(a), int(b)) for a, b in map(bytes.split, f)]
        self.tokens: dict[int, bytes] = {rank: token for token, rank in pairs}
        self.texts = {rank: str(rank) for rank in self.tokens}
        self.hash = PerfectHash([token for token, _ in pairs])
        self.slots = [pairs[i] for i in self.hash.order.tolist()]
        self.split = regex.compile(pattern).findall
        self.bytes = [self.rank(bytes([b])) for b in range(256)]
        self.pairs: dict[tuple[int, int], int] = {}
        self.memo = ChunkEncoder(lambda chunk: array("i", self.encode_chunk(chunk)).tobytes())

    def rank(self, token: bytes) -> int:
        """The rank of a token, -1 if the vocabulary doesn't have it."""
        i = self.hash.find(token)
        if i >= 0:
            at, rank = self.slots[i]
            if at == token:
                return rank
        return -1

    def pair(self, a: int, b: int) -> int:
        r = self.pairs.get((a, b))
        if r is None:
            if len(self.pairs) > 2 * MEMO_ENTRIES:
                self.pairs.clear()
            r = self.pairs[a, b] = self.rank(self.tokens[a] + self.tokens[b])
        return r

    def merge(self, piece: bytes) -> list[int]:
        """Ids of a pre-token that is no token itself."""
        n = len(piece)
        ids = [self.bytes[b] for b in piece]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := self.pair(ids[i], ids[i + 1])) >= 0]
        heapq.heapify(heap)
        while heap:
            rank, i, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue
            ids[i], ids[j] = rank, -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (r := self.pair(rank, ids[k])) >= 0:
                    heapq.heappush(heap, (r, i, rank, ids[k]))
            if (h := before[i]) >= 0 and (r := self.pair(ids[h], rank)) >= 0:
                heapq.heappush(heap, (r, h, ids[h], rank))
        return [x for x in ids if x >= 0]

    def encode_chunk(self, chunk: str) -> list[int]:
        out: list[int] = []
        for piece in self.split(chunk):
            token = piece.encode()
            rank = self.rank(token)
            if rank >= 0:
                out.append(rank)
            else:
                out += self.merge(token)
        return out

    def encode(self, text: str) -> list[int]:
        return self.memo.text(text).tolist()

    def encode_column(self, column: pa.Array) -> Iterator[list[int]]:
        for _, _, ids, begin in self.memo.slices(column):
            for a, b in pairwise(begin.tolist()):
                yield ids[a:b].tolist()

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


def encode(docs: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """doc_id and the ids of each text."""
    def make():
        bpe = ByteBPE.of(path or public_tokenizers.path("byte_bpe_50k.tiktoken"), pattern or public_tokenizers.PATTERN)
        return lambda b: pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(list(bpe.encode_column(b.column("text"))), pa.list_(pa.int32()))], names=["doc_id", "ids"])
    return map_rows(docs.select("doc_id", "text"), make, "doc_id long, ids array<int>")


def decode(rows: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and the bytes of each list of ids."""
    def make():
        bpe = ByteBPE.of(path or public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
        return lambda b: pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([bpe.decode(x.as_py() or []) for x in b.column("ids")], pa.binary())], names=["doc_id", "bytes"])
    return map_rows(rows.select("doc_id", "ids"), make, "doc_id long, bytes binary")


def digests(docs: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """Encode each text, decode its ids, and keep the digests of both."""
    def make():
        bpe = ByteBPE.of(path or public_tokenizers.path("byte_bpe_50k.tiktoken"), pattern or public_tokenizers.PATTERN)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            n, of_ids, of_bytes = [], [], []
            for ids in bpe.encode_column(batch.column("text")):
                n.append(len(ids))
                of_ids.append(hashlib.sha256(" ".join(map(bpe.texts.__getitem__, ids)).encode()).hexdigest())
                of_bytes.append(hashlib.sha256(bpe.decode(ids)).hexdigest())
            return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(of_ids), pa.array(of_bytes)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
        return step
    return map_rows(docs.select("doc_id", "text"), make, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(read_table(spark, sf_dir, "documents"))
