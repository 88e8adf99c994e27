"""Byte-level BPE encoding and decoding with a two-tier lookup.

Text is split by the tokenizer's pattern. A piece that is itself a vocabulary entry is resolved by a minimal perfect hash
(hash and displace: one slot an entry, one comparison to confirm); every other piece is merged bottom-up with a heap over
a doubly linked list of its bytes. A null text is empty, has no ids and decodes to nothing.

Pairs of equal rank merge from the left. A text of any length is encoded whole, in one task; a very long piece costs its heap, n log n. In
front of both tiers lies a cache of pieces of at most 64 characters, emptied when it is full, which changes no result. Repeated rows are
encoded each by itself. Of the table only the id and the text are read, so other columns may have any names.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import uuid
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame

from corpusloom.llm.common import parts

#: Pieces whose ids a worker keeps; beyond, it starts anew.
CACHED_PIECES = 300_000


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class PerfectHash:
    """A minimal perfect hash of the vocabulary's entries, by hash and displace.

    Entries fall into buckets by a first hash. Buckets, largest first, try seeds of a second hash until all their entries
    meet free slots; a bucket of one takes any free slot, stored as a negative displacement.
    """

    def __init__(self, ids: dict[bytes, int]):
        self.size = max(1, len(ids))
        self.buckets = max(1, self.size // 2)
        self.displace = array("q", [0]) * self.buckets
        self.keys: list[bytes | None] = [None] * self.size
        self.ids = array("q", [-1]) * self.size
        members: dict[int, list[bytes]] = {}
        for key in ids:
            members.setdefault(xxhash.xxh3_64_intdigest(key) % self.buckets, []).append(key)
        free = None
        for bucket in sorted(members, key=lambda b: (-len(members[b]), b)):
            keys = members[bucket]
            if len(keys) == 1:
                free = free if free is not None else [s for s in range(self.size) if self.keys[s] is None]
                slots = [free.pop()]
                self.displace[bucket] = -slots[0] - 1
            else:
                seed = 0
                while True:
                    seed += 1
                    slots = [xxhash.xxh3_64_intdigest(key, seed) % self.size for key in keys]
                    if len(set(slots)) == len(slots) and all(self.keys[s] is None for s in slots):
                        break
                self.displace[bucket] = seed
            for key, slot in zip(keys, slots, strict=True):
                self.keys[slot], self.ids[slot] = key, ids[key]

    def get(self, key: bytes) -> int:
        """The entry's id, or -1."""
        seed = self.displace[xxhash.xxh3_64_intdigest(key) % self.buckets]
        slot = -seed - 1 if seed < 0 else xxhash.xxh3_64_intdigest(key, seed) % self.size
        return self.ids[slot] if self.keys[slot] == key else -1


def merge_piece(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one piece: the pair of lowest rank, the leftmost on a tie, merges until none is left."""
    n = len(piece)
    end = list(range(1, n + 1))  # of the part that starts here; 0 once it is absorbed
    before = list(range(-1, n - 1))
    rank_of = ranks.get
    heap = [(rank, i, i + 2) for i in range(n - 1) if (rank := rank_of(piece[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, left, right_end = heapq.heappop(heap)
        middle = end[left]
        if not middle or middle == n or end[middle] != right_end:
            continue  # one of the two parts has changed since
        end[middle], end[left] = 0, right_end
        if right_end < n:
            before[right_end] = left
            if (rank := rank_of(piece[left : end[right_end]])) is not None:
                heapq.heappush(heap, (rank, left, end[right_end]))
        if (start := before[left]) >= 0 and (rank := rank_of(piece[start:right_end])) is not None:
            heapq.heappush(heap, (rank, start, right_end))
    return [ranks[piece[i : end[i]]] for i in range(n) if end[i]]


class Codec(dict):
    """Encodes and decodes; as a mapping it holds the little-endian ids of pieces seen before."""

    def __init__(self, ranks: dict[bytes, int], perfect: PerfectHash, pattern: str):
        super().__init__()
        self.ranks, self.perfect = ranks, perfect
        self.split = regex.compile(pattern).findall
        self.pieces = {rank: token for token, rank in ranks.items()}

    def __missing__(self, piece: str) -> bytes:
        raw = piece.encode("utf-8", "surrogatepass")
        whole = self.perfect.get(raw)
        ids = array("I", [whole] if whole >= 0 else merge_piece(raw, self.ranks)).tobytes()
        if len(piece) <= 64:
            if len(self) >= CACHED_PIECES:
                self.clear()
            self[piece] = ids
        return ids

    def encode(self, text: str | None) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        return b"".join(map(self.__getitem__, self.split(text))) if text else b""

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.pieces.__getitem__, memoryview(ids).cast("I")))


_codecs: dict[str, Codec] = {}


def _codec(shared: Broadcast, name: str, pattern: str) -> Codec:
    """One codec a worker and vocabulary, kept between tasks."""
    if name not in _codecs:
        _codecs.clear()
        _codecs[name] = Codec(*shared.value, pattern)
    return _codecs[name]


def encode(docs: DataFrame, vocabulary: str, pattern: str, text_col: str = "text", id_col: str = "doc_id", keep_ids: bool = True) -> DataFrame:
    """One row a document: its id column, n_tokens, ids (array<int>, unless keep_ids is false), ids_sha256, decoded_sha256.

    The vocabulary (a file of ranks, under a few MB) goes to the workers by broadcast. Every row is scored by itself: no
    shuffle, and a lost task runs again alone. Repeated rows give equal results; an empty table gives an empty table.
    """
    ranks = read_ranks(vocabulary)
    shared, name = docs.sparkSession.sparkContext.broadcast((ranks, PerfectHash(ranks))), uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(shared, name, pattern)
        for batch in parts(batches):
            counts, ids_hash, text_hash, all_ids = [], [], [], []
            for text in batch.column(1):
                ids = codec.encode(text.as_py())
                counts.append(len(ids) // 4)
                ids_hash.append(hashlib.sha256(ids).hexdigest())
                text_hash.append(hashlib.sha256(codec.decode(ids)).hexdigest())
                if keep_ids:
                    all_ids.append(ids)
            columns = [batch.column(0), pa.array(counts, pa.int64()), pa.array(ids_hash, pa.string()), pa.array(text_hash, pa.string())]
            names = [id_col, "n_tokens", "ids_sha256", "decoded_sha256"]
            if keep_ids:
                ends = pa.array(np.cumsum([0, *counts]), pa.int32())
                columns.append(pa.ListArray.from_arrays(ends, pa.array(np.frombuffer(b"".join(all_ids), np.int32))))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names)

    kind = dict(docs.select(id_col).dtypes)[id_col]
    schema = f"{id_col} {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * keep_ids
    return docs.select(id_col, text_col).mapInArrow(run, schema)


def decode(encoded: DataFrame, vocabulary: str, ids_col: str = "ids", id_col: str = "doc_id") -> DataFrame:
    """One row for each: its id column and text, the decoded bytes as binary. Null ids decode to nothing."""
    ranks = read_ranks(vocabulary)
    shared = encoded.sparkSession.sparkContext.broadcast({rank: token for token, rank in ranks.items()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [b"".join(map(shared.value.__getitem__, ids.as_py() or ())) for ids in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.binary())], [id_col, "text"])

    kind = dict(encoded.select(id_col).dtypes)[id_col]
    return encoded.select(id_col, ids_col).mapInArrow(run, f"{id_col} {kind}, text binary")


__all__ = ["PerfectHash", "Codec", "decode", "encode", "merge_piece", "read_ranks"]
