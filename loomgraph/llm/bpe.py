"""Byte-level BPE encoding and decoding (operator 5).

Pre-tokens are merged through a rank queue.  A bucket for every merge rank holds the positions
in a linked list at which that merge was possible when it was noted; a bitmap in three levels
marks the buckets in use, and find-first-set on each level gives the lowest rank.  Entries that
a later merge has made stale are skipped when they come up.  Each merge costs a few word
operations and one heap step, so a pre-token of a million letters is no special case.

Results are kept per pre-token in a memo of bounded size, as most of them recur.

Defined results: a null or empty text has no ids and decodes to no bytes; repeated rows are
encoded alike, each on its own; further columns pass through ``encode`` untouched, and those that
bear a name of its output are replaced by it.
"""

from __future__ import annotations

import base64
import hashlib
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomgraph.llm import _pretok
from loomgraph.llm._shared import ready

SHIFT = 32


class RankQueue:
    """Ranks 0 to ``ranks`` - 1 with positions under each; gives the least rank's positions."""

    def __init__(self, ranks: int):
        self.low = [0] * ((ranks >> 6) + 1)
        self.mid = [0] * ((ranks >> 12) + 1)
        self.top = 0
        self.buckets: dict[int, list[int]] = {}

    def push(self, rank: int, found: list[int]) -> None:
        bucket = self.buckets.get(rank)
        if bucket is not None:
            bucket += found
            return
        self.buckets[rank] = found
        i = rank >> 6
        self.low[i] |= 1 << (rank & 63)
        self.mid[i >> 6] |= 1 << (i & 63)
        self.top |= 1 << (i >> 6)

    def first(self) -> int:
        """The lowest rank in use, or -1."""
        top = self.top
        if not top:
            return -1
        k = (top & -top).bit_length() - 1
        word = self.mid[k]
        i = (k << 6) | ((word & -word).bit_length() - 1)
        word = self.low[i]
        return (i << 6) | ((word & -word).bit_length() - 1)

    def take(self, rank: int) -> list[int]:
        """The positions under ``rank`` in order; the bucket is gone afterwards."""
        i = rank >> 6
        self.low[i] &= ~(1 << (rank & 63))
        if not self.low[i]:
            k = i >> 6
            self.mid[k] &= ~(1 << (i & 63))
            if not self.mid[k]:
                self.top &= ~(1 << k)
        found = self.buckets.pop(rank)
        found.sort()
        return found


class Merger:
    """Merges by rank.  ``pairs``: (left id << SHIFT | right id) to rank; ``made``: rank to id.

    One queue serves many pre-tokens at once, laid end to end in the linked list with no pair
    across a border.  A pre-token's merges come in its own order of ranks all the same: when one
    makes a lower rank possible, that bucket is taken before what is left of the present one.
    """

    def __init__(self, single: list[int], pairs: dict[int, int], made: list[int] | None, ranks: int, whole: dict[bytes, int] | None = None):
        self.pairs, self.made, self.whole = pairs, made, whole or {}
        self.single = np.array(single, np.int64)
        keys = (self.single[:, None] << SHIFT | self.single[None, :]).ravel().tolist()
        self.byte_pairs = np.array([pairs.get(k, -1) for k in keys], np.int64)
        self.queue = RankQueue(ranks)

    def encode_all(self, found: list[bytes]) -> list[np.ndarray]:
        """The ids of each pre-token, as arrays of little-endian unsigned 32-bit integers."""
        flat, ends = self.merge_all(found)
        return [flat[i:j] for i, j in zip([0, *ends], ends)]

    def merge_all(self, found: list[bytes]) -> tuple[np.ndarray, list[int]]:
        """All ids, and where those of each pre-token end.  Pre-tokens must not be empty."""
        raw = np.frombuffer(b"".join(found), np.uint8).astype(np.int64)
        n = len(raw)
        ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)))
        firsts = self.byte_pairs[raw[:-1] << 8 | raw[1:]] if n > 1 else np.zeros(0, np.int64)
        firsts[ends[:-1] - 1] = -1
        at = np.flatnonzero(firsts >= 0)
        at = at[np.argsort(firsts[at], kind="stable")]
        cuts = np.flatnonzero(np.diff(firsts[at])) + 1
        queue = self.queue
        for part in np.split(at, cuts) if len(at) else ():
            queue.push(int(firsts[part[0]]), part.tolist())
        ids = self.single[raw].tolist()
        after = np.arange(1, n + 1)
        after[ends - 1] = -1
        before = np.arange(-1, n - 1)
        before[ends[:-1]] = -1
        self._run(ids, after.tolist(), before.tolist())
        ids = np.array(ids, np.int64)
        alive = ids >= 0
        kept = np.concatenate([[0], np.cumsum(alive)])
        return ids[alive].astype("<u4"), kept[ends].tolist()

    def _run(self, ids: list[int], after: list[int], before: list[int]) -> None:
        pairs, queue, made = self.pairs.get, self.queue, self.made
        buckets, push = queue.buckets, queue.push
        while (rank := queue.first()) >= 0:
            token = rank if made is None else made[rank]
            found = queue.take(rank)
            lower = False
            for k, at in enumerate(found):
                nxt = after[at]
                one = ids[at]
                if nxt < 0 or one < 0 or pairs(one << SHIFT | ids[nxt]) != rank:
                    continue  # stale
                ids[at] = token
                ids[nxt] = -1
                nxt = after[at] = after[nxt]
                if nxt >= 0:
                    before[nxt] = at
                    new = pairs(token << SHIFT | ids[nxt])
                    if new is not None:
                        if new in buckets:
                            buckets[new].append(at)
                        else:
                            push(new, [at])
                        lower = new < rank
                prv = before[at]
                if prv >= 0:
                    new = pairs(ids[prv] << SHIFT | token)
                    if new is not None:
                        if new in buckets:
                            buckets[new].append(prv)
                        else:
                            push(new, [prv])
                        lower = lower or new < rank
                if lower:
                    if k + 1 < len(found):
                        push(rank, found[k + 1 :])
                    break


def read_ranks(path: str) -> dict[bytes, int]:
    """The ranks of a .tiktoken file."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f) if a}


def rank_merger(ranks: dict[bytes, int]) -> Merger:
    """Any two tokens merge whose bytes together are a token; its rank is the merge's."""
    pairs = {}
    for whole, rank in ranks.items():
        for i in range(1, len(whole)):
            left = ranks.get(whole[:i])
            if left is not None and (right := ranks.get(whole[i:])) is not None:
                pairs[left << SHIFT | right] = rank
    return Merger([ranks[bytes([b])] for b in range(256)], pairs, None, max(ranks.values()) + 1, ranks)


class Codec:
    """Encodes and decodes by the ranks of a file; lives in a Python worker across tasks."""

    _kept: dict[str, Codec] = {}

    def __init__(self, path: str, table: np.ndarray):
        ranks = read_ranks(path)
        self.table = table
        self.merger = rank_merger(ranks)
        self.bytes_of = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.bytes_of[rank] = token
        self.memo = _pretok.Memo(self._solve)

    @classmethod
    def of(cls, path: str, table: np.ndarray) -> Codec:
        if path not in cls._kept:
            cls._kept[path] = cls(path, table)
        return cls._kept[path]

    def _solve(self, found: list[str]) -> list[bytes]:
        out: list = [p.encode() for p in found]
        whole = self.merger.whole.get
        rest = []
        for i, p in enumerate(out):
            rank = whole(p)
            if rank is None:
                rest.append(i)
            else:
                out[i] = rank.to_bytes(4, "little")
        if rest:
            flat, ends = self.merger.merge_all([out[i] for i in rest])
            packed = flat.tobytes()
            for i, a, b in zip(rest, [0, *ends], ends):
                out[i] = packed[4 * a : 4 * b]
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        found = [_pretok.pieces(t, self.table) for t in texts]
        self.memo.learn(list(chain.from_iterable(found)))
        get = self.memo.young.__getitem__
        return [b"".join(map(get, x)) for x in found]

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def encode(docs: DataFrame, path: str, text: str = "text", ids: str = "token_ids", digests: bool = False) -> DataFrame:
    """``docs`` with ``n_tokens`` and the ids of every whole text; with ``digests`` the SHA-256 of
    ids and of the bytes they decode to instead of the ids.  One pass, no shuffle."""
    spark = docs.sparkSession
    ready(spark)
    table = spark.sparkContext.broadcast(_pretok.tiktoken_classes())
    new = (
        [("n_tokens", T.LongType()), ("ids_sha256", T.StringType()), ("decoded_sha256", T.StringType())]
        if digests
        else [("n_tokens", T.LongType()), (ids, T.ArrayType(T.IntegerType()))]
    )
    names = {n for n, _ in new}
    keep = [c for c in docs.columns if c not in names]
    given = docs.select(*keep)
    schema = T.StructType([*given.schema.fields, *[T.StructField(n, t) for n, t in new]])
    lean = [c for c in keep if c != text or text in keep]

    def run(batches):
        codec = Codec.of(path, table.value)
        for batch in batches:
            for rows in _slices(batch, batch.schema.get_field_index(text)):
                counts, one, two = [], [], []
                for packed in codec.encode([x or "" for x in rows.column(text).to_pylist()]):
                    counts.append(len(packed) >> 2)
                    if digests:
                        one.append(hashlib.sha256(packed).hexdigest())
                        two.append(hashlib.sha256(codec.decode(packed)).hexdigest())
                    else:
                        one.append(packed)
                columns = [rows.column(c) for c in lean] + [pa.array(counts, pa.int64())]
                if digests:
                    columns += [pa.array(one, pa.string()), pa.array(two, pa.string())]
                else:
                    flat = np.frombuffer(b"".join(one), "<i4")
                    ends = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
                    columns.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)))
                yield pa.RecordBatch.from_arrays(columns, names=[*lean, *[n for n, _ in new]])

    return given.mapInArrow(run, schema)


def _slices(batch, at: int, most: int = 2 << 20):
    """Parts of a batch with about ``most`` bytes of text each, so that outputs stay small."""
    sizes = np.diff(np.frombuffer(batch.column(at).buffers()[1], np.int32)[batch.column(at).offset :][: batch.num_rows + 1]) if pa.types.is_string(batch.schema.field(at).type) and batch.num_rows else np.zeros(batch.num_rows)
    i = 0
    while i < batch.num_rows:
        j, held = i, 0
        while j < batch.num_rows and (j == i or held + sizes[j] <= most):
            held += sizes[j]
            j += 1
        yield batch.slice(i, j - i)
        i = j


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every document."""
    return encode(docs.select("doc_id", F.col("text").cast("string").alias("text")), path, digests=True).drop("text")


