"""Token ids in binary shards, found through minimal perfect hashing (operator 1).

Layout of a store, all in one folder:

* ``shard-*.ids``: a header of 16 bytes (mark, version, bytes an id, shard) and then nothing but
  ids, little-endian, of documents in ascending doc_id order (null first, ties by their ids).
  Shards hold consecutive ranges of doc_id.
* ``index-*.mph``: for each bucket of document keys a minimal perfect hash function (levels of
  bit sets with ranks) from key to slot, a 32-bit fingerprint of the slot's key, and the slot's
  entries: shard, offset, first token and number of tokens.  A document key that occurs in
  several rows has an entry for each.  A lookup costs one bucket file and a constant number of
  probes; a foreign key is refused by its fingerprint but once in 2**32 cases.

Files are named by attempt and come into the store only through the table of a committed job,
so a task that is run again leaves at most a file that nothing refers to.

Defined results: a null or empty text is the end id alone; rows that repeat a doc_id are stored
each, in the order of their ids, and ``start`` counts all rows before; a null doc_id is stored
first and can be read back by null; other columns do not matter; an empty table makes no files.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomgraph.llm import _pretok
from loomgraph.llm._shared import id_bounds, new_folder, partitions, range_of, ready, store, written
from loomgraph.llm.bpe import _slices

MARK = b"LGTK"
HEAD = "<4sHHQ"
HEAD_SIZE = struct.calcsize(HEAD)
ENTRY = np.dtype([("shard", "<u4"), ("count", "<u4"), ("offset", "<u8"), ("start", "<u8")])


def mixed(keys: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit hash of 64-bit keys (two multiply-and-shift rounds)."""
    with np.errstate(over="ignore"):
        x = keys.astype(np.uint64) + np.uint64((0x9E3779B97F4A7C15 * (seed + 1)) & 0xFFFFFFFFFFFFFFFF)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


class PerfectHash:
    """A minimal perfect hash function over distinct 64-bit keys.

    On each level a key whose place no other key wants sets that bit; the others go on to the
    next level.  A key's slot is the number of bits set before its own.
    """

    def __init__(self, levels: list[np.ndarray]):
        self.levels = levels
        self.before, at = [], 0
        for words in levels:
            ones = np.bitwise_count(words).astype(np.int64)
            self.before.append(at + np.concatenate([[0], np.cumsum(ones)[:-1]]) if len(words) else np.zeros(0, np.int64))
            at += int(ones.sum())
        self.size = at

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        levels, left = [], keys.astype(np.uint64)
        while len(left):
            bits = 64 * max(1, -(-2 * len(left) // 64))
            at = (mixed(left, len(levels)) % np.uint64(bits)).astype(np.int64)
            alone = np.bincount(at, minlength=bits) == 1
            levels.append(np.packbits(alone, bitorder="little").view("<u8"))
            left = left[~alone[at]]
        return cls(levels)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key; -1 where the function can tell that it has none."""
        keys = keys.astype(np.uint64)
        out = np.full(len(keys), -1, np.int64)
        open_ = np.arange(len(keys))
        for level, words in enumerate(self.levels):
            if not len(open_):
                break
            at = (mixed(keys[open_], level) % np.uint64(64 * len(words))).astype(np.int64)
            word, bit = words[at >> 6], (at & 63).astype(np.uint64)
            hit = (word >> bit) & np.uint64(1) == 1
            low = np.bitwise_count(word & ((np.uint64(1) << bit) - np.uint64(1))).astype(np.int64)
            out[open_[hit]] = (self.before[level][at >> 6] + low)[hit]
            open_ = open_[~hit]
        return out


def fingerprint(keys: np.ndarray) -> np.ndarray:
    return (mixed(keys, 1 << 20) >> np.uint64(32)).astype("<u4")


def pack_index(keys: np.ndarray, null: np.ndarray, entries: np.ndarray) -> bytes:
    """An index file; row i of ``entries`` belongs to ``keys[i]`` or, where ``null[i]``, to null."""
    order = np.lexsort((entries["start"], keys, ~null))
    keys, null, entries = keys[order], null[order], entries[order]
    nulls = int(null.sum())
    distinct, first, counts = np.unique(keys[nulls:], return_index=True, return_counts=True)
    hash_ = PerfectHash.build(distinct)
    slot = hash_.slots(distinct)
    size = np.zeros(len(distinct), np.int64)
    size[slot] = counts
    ends = np.cumsum(size)
    begin = np.zeros(len(distinct), np.int64)
    begin[slot] = first
    rows = np.repeat(begin - np.concatenate([[0], ends[:-1]]) if len(ends) else begin, size) + np.arange(len(keys) - nulls)
    marks = np.zeros(len(distinct), "<u4")
    marks[slot] = fingerprint(distinct)
    head = json.dumps({"levels": [len(x) for x in hash_.levels], "keys": len(distinct), "nulls": nulls, "rows": len(keys)}).encode()
    parts = [MARK, struct.pack("<I", len(head)), head, *[x.astype("<u8").tobytes() for x in hash_.levels], marks.tobytes(), ends.astype("<u8").tobytes(), entries[:nulls].tobytes(), entries[nulls:][rows].tobytes()]
    return b"".join(parts)


class Index:
    """An index file in memory."""

    def __init__(self, data: bytes):
        if data[:4] != MARK:
            raise ValueError("not an index file")
        (size,) = struct.unpack_from("<I", data, 4)
        head, at = json.loads(data[8 : 8 + size]), 8 + size
        levels = []
        for n in head["levels"]:
            levels.append(np.frombuffer(data, "<u8", n, at))
            at += 8 * n
        self.hash = PerfectHash(levels)
        self.marks = np.frombuffer(data, "<u4", head["keys"], at)
        at += 4 * head["keys"]
        self.ends = np.frombuffer(data, "<u8", head["keys"], at).astype(np.int64)
        at += 8 * head["keys"]
        self.nulls = np.frombuffer(data, ENTRY, head["nulls"], at)
        at += ENTRY.itemsize * head["nulls"]
        self.entries = np.frombuffer(data, ENTRY, head["rows"] - head["nulls"], at)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(which key, which entry) for every entry of the keys that are in the index."""
        slot = self.hash.slots(keys)
        known = slot >= 0
        known[known] = self.marks[slot[known]] == fingerprint(keys[known])
        which, slot = np.flatnonzero(known), slot[known]
        begin = np.where(slot > 0, self.ends[slot - 1], 0)
        size = self.ends[slot] - begin
        rows = np.repeat(begin - np.cumsum(size) + size, size) + np.arange(size.sum())
        return np.repeat(which, size), rows


class LibraryEncoder:
    """Encodes by the tokenizers library, each distinct pre-token once while the memo holds it."""

    _kept: dict[str, LibraryEncoder] = {}

    def __init__(self, path: str, table: np.ndarray):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.table = table
        self.special = {t.content: i for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        self.line = self.tokenizer.encode("\n", add_special_tokens=False).ids
        self.memo = _pretok.Memo(self._solve)

    @classmethod
    def of(cls, path: str, table) -> LibraryEncoder:
        if path not in cls._kept:
            cls._kept[path] = cls(path, table.value)
        return cls._kept[path]

    def _solve(self, found: list[str]) -> list[bytes]:
        plain = [p for p in found if not p.isspace() and "\n" not in p]
        got = {}
        if len(self.line) == 1:
            for i in range(0, len(plain), 4096):
                part = plain[i : i + 4096]
                # the cut between lines is a pre-token of its own, so the parts do not touch
                ids = np.array(self.tokenizer.encode_batch_fast(["\n".join(part)], add_special_tokens=False)[0].ids, "<u4")
                cuts = np.flatnonzero(ids == self.line[0]).tolist()
                if len(cuts) == len(part) - 1:
                    data = ids.tobytes()
                    got.update({p: data[4 * a : 4 * b] for p, a, b in zip(part, [0, *[c + 1 for c in cuts]], [*cuts, len(ids)])})
        rest = [p for p in found if p not in got]
        for p, e in zip(rest, self.tokenizer.encode_batch(rest, add_special_tokens=False)):
            got[p] = np.array(e.ids, "<u4").tobytes()
        return [got[p] for p in found]

    def encode(self, texts: list[str]) -> list[bytes]:
        strings = list(self.special)
        found, plain = [], []
        for t in texts:
            if any(s in t for s in strings):
                found.append(None)
                plain.append(t)
            else:
                found.append(_pretok.pieces(t, self.table))
        self.memo.learn(list(chain.from_iterable(x for x in found if x is not None)))
        whole = iter(self.tokenizer.encode_batch(plain, add_special_tokens=False))
        get = self.memo.young.__getitem__
        return [np.array(next(whole).ids, "<u4").tobytes() if x is None else b"".join(map(get, x)) for x in found]


def _bucket(key: str, buckets: int):
    return F.pmod(F.xxhash64(F.col(key).cast("long")), F.lit(buckets)).cast("int")


def write(docs: DataFrame, path: str, end_id: int, folder: str | None = None, shards: int | None = None) -> dict:
    """Encodes and stores every document; gives what ``read`` needs: folder, width and files.

    One scan of doc_id for the range bounds, one of the texts; the ids are shuffled once, as
    16-bit numbers if the vocabulary allows, straight to the task that writes their shard.
    """
    from tokenizers import Tokenizer

    spark = docs.sparkSession
    ready(spark)
    folder = folder or new_folder(spark, "tokens")
    # so many that an index bucket, which one task holds, has some 500,000 documents
    shards = shards or max(partitions(spark), -(-docs.count() // 500_000))
    width = 2 if max(Tokenizer.from_file(path).get_vocab_size(with_added_tokens=True), end_id + 1) <= 1 << 16 else 4
    bounds = id_bounds(docs, "doc_id", shards)
    table = spark.sparkContext.broadcast(_pretok.tokenizers_classes())

    def encode(batches):
        import zstandard

        encoder, pack = LibraryEncoder.of(path, table), zstandard.ZstdCompressor(1).compress
        end = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            for rows in _slices(batch, 2):
                ids = [np.frombuffer(x + end, "<u4").astype(f"<u{width}") for x in encoder.encode([x or "" for x in rows.column(2).to_pylist()])]
                yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array([pack(x.tobytes()) for x in ids], pa.binary())], names=["doc_id", "shard", "ids"])

    def put(batches):
        import zstandard

        unpack = zstandard.ZstdDecompressor().decompress
        system, top = store(folder)
        system.create_dir(top, recursive=True)
        out, shard, name, offset, start = None, None, "", 0, 0
        for batch in batches:
            rows = []
            for doc, at, data in zip(*[c.to_pylist() for c in batch.columns]):
                if at != shard:
                    if out is not None:
                        out.close()
                    shard, offset, start, name = at, HEAD_SIZE, 0, f"shard-{at:06d}-{uuid.uuid4().hex}.ids"
                    out = system.open_output_stream(f"{top}/{name}")
                    out.write(struct.pack(HEAD, MARK, 1, width, at))
                data = unpack(data)
                out.write(data)
                n = len(data) // width
                rows.append((doc, shard, name, offset, start, n))
                offset += len(data)
                start += n
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), LAYOUT.types)], schema=LAYOUT) if rows else pa.RecordBatch.from_arrays([pa.array([], t) for t in LAYOUT.types], schema=LAYOUT)
        if out is not None:
            out.close()

    lean = docs.select(F.col("doc_id").cast("long").alias("doc_id"), range_of("doc_id", bounds).alias("shard"), F.col("text").cast("string").alias("text"))
    dealt = lean.mapInArrow(encode, "doc_id long, shard int, ids binary").repartitionById(len(bounds) + 1, F.col("shard"))
    layout = written(dealt.sortWithinPartitions("shard", "doc_id", "ids").mapInArrow(put, "doc_id long, shard int, file string, offset long, start long, n long"), "layout")
    # a row for each shard: as many as there are tasks
    totals = layout.groupBy("shard", "file").agg(F.sum("n").alias("n")).orderBy("shard").collect()
    files, bases, total = {}, {}, 0
    for r in totals:
        files[r["shard"]], bases[r["shard"]] = r["file"], total
        total += r["n"]
    buckets = len(bounds) + 1

    def index(batches):
        rows = [b for b in batches if b.num_rows]
        if not rows:
            return
        system, top = store(folder)
        got = pa.Table.from_batches(rows)
        bucket = got["bucket"].to_numpy()
        for b in np.unique(bucket).tolist():
            part = got.filter(pa.array(bucket == b))
            entries = np.zeros(part.num_rows, ENTRY)
            shard = part["shard"].to_numpy()
            entries["shard"], entries["count"], entries["offset"] = shard, part["n"].to_numpy(), part["offset"].to_numpy()
            entries["start"] = part["start"].to_numpy() + np.array([bases[s] for s in shard.tolist()], np.int64)
            null = part["doc_id"].is_null().to_numpy()
            keys = part["doc_id"].fill_null(0).to_numpy().astype(np.int64).view(np.uint64)
            name = f"index-{b:06d}-{uuid.uuid4().hex}.mph"
            with system.open_output_stream(f"{top}/{name}") as out:
                out.write(pack_index(keys, null, entries))
            yield pa.RecordBatch.from_pydict({"bucket": pa.array([b], pa.int32()), "file": pa.array([name])})

    keyed = layout.select("doc_id", "shard", "offset", "start", "n", _bucket("doc_id", buckets).alias("bucket"))
    made = keyed.repartitionById(buckets, F.col("bucket")).mapInArrow(index, "bucket int, file string").collect()
    return {"folder": folder, "width": width, "shards": files, "buckets": buckets, "index": {r["bucket"]: r["file"] for r in made}, "n_tokens": total}


LAYOUT = pa.schema([("doc_id", pa.int64()), ("shard", pa.int32()), ("file", pa.string()), ("offset", pa.int64()), ("start", pa.int64()), ("n", pa.int64())])


def read(spark: SparkSession, stored: dict, keys: DataFrame, ids: bool = True) -> DataFrame:
    """The documents of ``keys`` (doc_id, each once) out of the files.

    Keys go to the task of their index bucket, which looks them up; what it finds goes to the
    task of its shard, which reads that shard from front to back.  With ``ids`` their array, else
    the crc32 of the ids as little-endian unsigned 32-bit integers.
    """
    ready(spark)
    folder, width, index, shards, buckets = stored["folder"], stored["width"], stored["index"], stored["shards"], stored["buckets"]
    last = T.StructField("token_ids", T.ArrayType(T.IntegerType())) if ids else T.StructField("ids_crc32", T.LongType())
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("start", T.LongType()), T.StructField("n_tokens", T.LongType()), last])

    def look(batches):
        system, top = store(folder)
        at, found = None, None
        for batch in batches:
            bucket = batch.column(1).to_numpy()
            for b in np.unique(bucket).tolist():
                if b not in index:
                    continue
                if at != b:
                    with system.open_input_stream(f"{top}/{index[b]}") as f:
                        at, found = b, Index(f.read())
                part = batch.column(0).filter(pa.array(bucket == b))
                there = part.drop_null()
                keys = there.to_numpy().astype(np.int64)
                which, rows = found.find(keys.view(np.uint64))
                entries = found.entries[rows]
                doc = pa.array(keys[which], pa.int64())
                if part.null_count:
                    entries = np.concatenate([found.nulls, entries])
                    doc = pa.concat_arrays([pa.nulls(len(found.nulls), pa.int64()), doc])
                yield pa.RecordBatch.from_arrays([doc, *[pa.array(entries[c].astype(np.int64), t) for c, t in (("shard", pa.int32()), ("offset", pa.int64()), ("start", pa.int64()), ("count", pa.int64()))]], names=["doc_id", "shard", "offset", "start", "n"])

    def fetch(batches):
        system, top = store(folder)
        at, f, place = None, None, 0
        for batch in batches:
            for rows in (batch.slice(i, 512) for i in range(0, batch.num_rows, 512)):
                got = []
                for shard, offset, n in zip(*[rows.column(c).to_pylist() for c in ("shard", "offset", "n")]):
                    if shard != at:
                        at, f, place = shard, system.open_input_file(f"{top}/{shards[shard]}"), 0
                        mark, _, w, s = struct.unpack(HEAD, f.read(HEAD_SIZE))
                        if (mark, w, s) != (MARK, width, shard):
                            raise ValueError(f"{shards[shard]} is not the shard {shard}")
                        place = HEAD_SIZE
                    if place != offset:
                        f.seek(offset)
                    data = f.read(n * width)
                    if len(data) != n * width:
                        raise ValueError(f"{shards[shard]} ends early")
                    place = offset + len(data)
                    got.append(np.frombuffer(data, f"<u{width}").astype("<u4"))
                if ids:
                    ends = np.concatenate([[0], np.cumsum([len(x) for x in got])]).astype(np.int32)
                    value = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(got).view("<i4") if got else np.zeros(0, np.int32)))
                else:
                    value = pa.array([zlib.crc32(x.tobytes()) for x in got], pa.int64())
                yield pa.RecordBatch.from_arrays([rows.column("doc_id"), rows.column("start"), rows.column("n"), value], names=schema.names)

    wanted = keys.select(F.col("doc_id").cast("long").alias("doc_id"), _bucket("doc_id", buckets).alias("bucket"))
    found = wanted.repartitionById(buckets, F.col("bucket")).sortWithinPartitions("bucket").mapInArrow(look, "doc_id long, shard int, offset long, start long, n long")
    dealt = found.repartitionById(max([*shards, 0]) + 1, F.col("shard")).sortWithinPartitions("shard", "offset")
    return dealt.mapInArrow(fetch, schema)
