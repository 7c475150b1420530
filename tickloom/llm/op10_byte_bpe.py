"""Byte-level BPE encoding and decoding with a two-tier lookup.

A minimal perfect hash holds every token of the vocabulary: a pre-token that is a token as a
whole is resolved there by two array reads and one comparison.  Other pre-tokens are merged
with a heap of adjacent pairs over a doubly linked list of their bytes, O(n log n) for n bytes.
Each worker keeps resolved pre-tokens in a bounded table, because words repeat.

Defined cases: a null or empty text has no ids; texts are encoded whole, without special
tokens, row by row; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import struct

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.llm.tables import table

#: Entries after which a worker's table of resolved pre-tokens starts anew (about 200 bytes each).
CACHE = 600_000


def read_ranks(path: str) -> list[bytes]:
    """Tokens in rank order from a file of ``base64 rank`` lines."""
    with open(path, "rb") as f:
        pairs = [line.split() for line in f if line.strip()]
    ranks = {int(rank): base64.b64decode(token) for token, rank in pairs}
    return [ranks[i] for i in range(len(ranks))]


class PerfectHash:
    """Hash and displace: keys fall into buckets, largest bucket first each gets the first displacement that sends its keys to free slots; as many slots as keys."""

    PER_BUCKET = 3

    @classmethod
    def of(cls, state: dict) -> PerfectHash:
        """From plain values: what is broadcast, so that executors don't need this module to read it."""
        own = cls.__new__(cls)
        own.keys, own.shift, own.slot = state["keys"], state["shift"], state["slot"]
        own.n, own.buckets = max(1, len(own.keys)), len(own.shift)
        return own

    def state(self) -> dict:
        return {"keys": self.keys, "shift": self.shift, "slot": self.slot}

    def __init__(self, keys: list[bytes]):
        n = self.n = max(1, len(keys))
        self.keys, self.buckets = keys, max(1, n // self.PER_BUCKET)
        hashes = [xxhash.xxh3_64_intdigest(k) for k in keys]
        own: list[list[int]] = [[] for _ in range(self.buckets)]
        for k, h in enumerate(hashes):
            own[h % self.buckets].append(k)
        self.shift, self.slot = [0] * self.buckets, [-1] * n
        singles = []
        for b in sorted(range(self.buckets), key=lambda b: -len(own[b])):
            if len(own[b]) < 2:
                singles += [(b, k) for k in own[b]]
                continue
            d = 0
            while True:
                at = [self._mix(hashes[k] >> 20, d) % n for k in own[b]]
                if len(set(at)) == len(at) and all(self.slot[a] < 0 for a in at):
                    break
                d += 1
            self.shift[b] = d
            for a, k in zip(at, own[b], strict=True):
                self.slot[a] = k
        # a bucket of one key takes any slot that is left, told directly as a negative number
        for (b, k), a in zip(singles, [a for a, k in enumerate(self.slot) if k < 0], strict=False):
            self.shift[b], self.slot[a] = ~a, k

    @staticmethod
    def _mix(h: int, d: int) -> int:
        return ((h ^ (d * 0x9E3779B97F4A7C15)) * 0xBF58476D1CE4E5B9 & 0xFFFFFFFFFFFFFFFF) >> 24

    def __call__(self, key: bytes) -> int:
        """The key's rank, or -1."""
        h = xxhash.xxh3_64_intdigest(key)
        d = self.shift[h % self.buckets]
        rank = self.slot[~d if d < 0 else self._mix(h >> 20, d) % self.n]
        return rank if rank >= 0 and self.keys[rank] == key else -1


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of a pre-token: the adjacent pair of lowest rank, leftmost first, is joined until none has a rank.

    A part is known by where it starts: ``end`` has where it ends, which is where the next part
    starts (0 once it has been joined to the part before), ``left`` where the part before starts.
    A heap entry packs rank, start of the left part and end of the right one.
    """
    n = len(piece)
    b = 8 if n < 256 else 32  # bits of a position: small numbers compare faster
    b2, mask = 2 * b, (1 << b) - 1
    get, push, pop = ranks.get, heapq.heappush, heapq.heappop
    heap = [r << b2 | i << b | i + 2 for i in range(n - 1) if (r := get(piece[i : i + 2])) is not None]
    heapq.heapify(heap)
    end = list(range(1, n + 1))
    left = list(range(-1, n))
    while heap:
        x = pop(heap)
        i, stop = x >> b & mask, x & mask
        j = end[i]
        if not j or j >= n or end[j] != stop:
            continue  # one of the two has been joined with another
        end[j], end[i] = 0, stop
        left[stop] = i
        if stop < n and (r := get(piece[i : end[stop]])) is not None:
            push(heap, r << b2 | i << b | end[stop])
        k = left[i]
        if k >= 0 and (r := get(piece[k:stop])) is not None:
            push(heap, r << b2 | k << b | stop)
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : end[i]]])
        i = end[i]
    return out


class Encoder(dict):
    """Pre-token to its ids, as little-endian unsigned 32-bit integers; what is missing is looked up in the perfect hash, then merged."""

    def __init__(self, table: PerfectHash, pattern: str):
        super().__init__()
        self.lookup = table
        self.ranks = {k: i for i, k in enumerate(table.keys)}
        self.split = regex.compile(pattern).findall
        self.lengths = np.array([len(k) for k in table.keys], np.int64)
        self.at = np.concatenate([[0], np.cumsum(self.lengths)])
        self.flat = np.frombuffer(b"".join(table.keys), np.uint8)

    def __missing__(self, piece: str) -> bytes:
        raw = piece.encode()
        rank = self.lookup(raw)
        ids = [rank] if rank >= 0 else merge(raw, self.ranks)
        packed = struct.pack(f"<{len(ids)}I", *ids)
        if len(self) >= CACHE:
            self.clear()
        if len(raw) <= 64:
            self[piece] = packed
        return packed

    def encode(self, text: str) -> bytes:
        return b"".join(map(self.__getitem__, self.split(text)))

    def decode(self, packed: bytes) -> bytes:
        """The tokens' bytes, gathered from one array of the whole vocabulary."""
        ids = np.frombuffer(packed, "<u4")
        n = self.lengths[ids]
        starts = np.cumsum(n) - n
        return self.flat[np.repeat(self.at[ids] - starts, n) + np.arange(int(n.sum()))].tobytes()


def _worker(shared, pattern: str, make, schema: pa.Schema):
    def run(batches):
        state = shared.value  # one object for all tasks of a worker, which keeps what they have resolved
        if "encoder" not in state:
            state["encoder"] = Encoder(PerfectHash.of(state), pattern)
        encoder = state["encoder"]
        for batch in batches:
            rows = []
            for text in batch.column(1):
                rows.append(make(encoder, encoder.encode(text.as_py() or "")))
            columns = zip(*rows, strict=True) if rows else [()] * (len(schema) - 1)
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(schema.field(0).type), *(pa.array(c, f.type) for c, f in zip(columns, list(schema)[1:], strict=True))], schema=schema)

    return run


def _ids(encoder: Encoder, packed: bytes) -> tuple:
    return np.frombuffer(packed, "<i4"), encoder.decode(packed)


def _digests(encoder: Encoder, packed: bytes) -> tuple:
    return len(packed) // 4, hashlib.sha256(packed).hexdigest(), hashlib.sha256(encoder.decode(packed)).hexdigest()


def _apply(docs: DataFrame, ranks_path: str, pattern: str, make, fields: list[tuple[str, pa.DataType]], ddl: str, id_col: str, text_col: str) -> DataFrame:
    # the vocabulary is a file of fixed size (about 1 MB here), so its table is sent to all
    shared = docs.sparkSession.sparkContext.broadcast(PerfectHash(read_ranks(ranks_path)).state())
    schema = pa.schema([(id_col, pa.int64()), *fields])
    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(_worker(shared, pattern, make, schema), f"`{id_col}` long, {ddl}")


def byte_bpe(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids array<int>, decoded binary) of each row.  No shuffle."""
    return _apply(docs, ranks_path, pattern, _ids, [("ids", pa.list_(pa.int32())), ("decoded", pa.binary())], "ids array<int>, decoded binary", id_col, text_col)


def byte_bpe_digests(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256): the ids and decoded bytes go through the same code and only their digests leave the worker."""
    fields = [("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())]
    return _apply(docs, ranks_path, pattern, _digests, fields, "n_tokens long, ids_sha256 string, decoded_sha256 string", id_col, text_col)


def public_vocabulary() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe_digests(table(spark, sf_dir, "documents"), *public_vocabulary())


QUERIES = {"op10_byte_bpe": query}
ORACLE_SQL: dict[str, str] = {}
