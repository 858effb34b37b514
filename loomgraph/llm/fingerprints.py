"""Document fingerprints from content-defined chunks (operator 2).

A gear hash over the last 16 bytes of UTF-8 proposes boundaries.  Chunking is normalised: a chunk
below the usual length needs a rarer hash value to end, one above it a more common one, and
lengths stay between a least and a most.  As boundaries depend on nearby bytes only, text that
moves keeps its chunks.  A fingerprint is the set of chunk digests with their lengths; how much of
one document another contains is the length of its chunks that both have over that of all its
chunks.

Defined results: a null or empty text has the empty fingerprint, which is contained in an empty
one wholly and in any other not at all; documents that repeat a doc_id follow each other in the
order of their texts; null doc_ids come first; the only row of a table is its own next document;
other columns do not matter.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import random

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm._shared import id_bounds, partitions, range_of, ready

LEAST, USUAL, MOST = 12, 32, 120
WINDOW = 16
RARE, COMMON = 6, 3  # bits of the hash that must be zero below and above the usual length


@functools.cache
def gear() -> np.ndarray:
    """A random 32-bit number for every byte."""
    numbers = random.Random(20240601)
    return np.array([numbers.getrandbits(32) for _ in range(256)], np.uint32)


def boundaries(data: bytes) -> list[int]:
    """Where chunks end; the last is the end of the data."""
    n = len(data)
    if not n:
        return []
    h = gear()[np.frombuffer(data, np.uint8)]
    step = 1
    while step < WINDOW and step < n:
        h[step:] = h[step:] + (h[:-step] << np.uint32(step))
        step *= 2
    # the bits that all of the window reaches
    top = h >> np.uint32(WINDOW)
    at = np.flatnonzero((top & np.uint32((1 << COMMON) - 1)) == 0)
    rare = ((top[at] & np.uint32((1 << RARE) - 1)) == 0).tolist()
    out, begin = [], 0
    for end, strong in zip((at + 1).tolist(), rare):
        size = end - begin
        if size < LEAST:
            continue
        while size > MOST:
            begin += MOST
            out.append(begin)
            size = end - begin
        if size >= USUAL or strong and size >= LEAST:
            out.append(end)
            begin = end
    while n - begin > MOST:
        begin += MOST
        out.append(begin)
    if begin < n:
        out.append(n)
    return out


def chunk_set(data: bytes) -> dict[int, int]:
    """48-bit digest to length of the chunks."""
    from xxhash import xxh3_64_intdigest

    out, begin = {}, 0
    for end in boundaries(data):
        part = data[begin:end]
        out[xxh3_64_intdigest(part) >> 16] = end - begin
        begin = end
    return out


def packed(chunks: dict[int, int]) -> str:
    """A fingerprint as text: base64 of sorted records of 6 bytes of digest and 1 of length."""
    return base64.b64encode(b"".join((d << 8 | n).to_bytes(7, "big") for d, n in sorted(chunks.items()))).decode()


def unpacked(fingerprint: str) -> dict[int, int]:
    raw = base64.b64decode(fingerprint)
    return {int.from_bytes(raw[i : i + 6], "big"): raw[i + 6] for i in range(0, len(raw), 7)}


def contained(one: dict[int, int], other: dict[int, int]) -> float:
    """How much of ``one`` is in ``other``, by length."""
    whole = sum(one.values())
    if not whole:
        return 0.0 if other else 1.0
    return sum(n for d, n in one.items() if d in other) / whole


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint of every whole text; one pass, no shuffle."""
    ready(docs.sparkSession)

    def run(batches):
        for batch in batches:
            made = [packed(chunk_set((x.as_py() or "").encode())) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.string())], names=["doc_id", "fingerprint"])

    lean = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return lean.mapInArrow(run, "doc_id long, fingerprint string")


def edited(text: str, following: str) -> str:
    """``text`` with its last half of code points replaced by the first as many of ``following``."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def compare_edited(docs: DataFrame, ranges: int | None = None) -> DataFrame:
    """Each document against its edited text and the next document in ascending doc_id.

    Documents go once to the task of their range of doc_id; the bounds are doc_ids that occur, so
    the first rows of a range are known beforehand and go to the range before as well (those of
    the first range to the last), where they are read as a next document only.
    """
    spark = docs.sparkSession
    ready(spark)
    lean = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    ends = lean.agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most"), F.count(F.when(F.col("doc_id").isNull(), 1)).alias("nulls")).first()
    bounds = [b for b in id_bounds(lean, "doc_id", ranges or partitions(spark)) if ends["least"] is not None and b > ends["least"]]
    n = len(bounds) + 1
    first = F.col("doc_id").isNull() if ends["nulls"] else F.col("doc_id") == F.lit(ends["least"])
    own = range_of("doc_id", bounds)
    head = F.col("doc_id").isin(bounds) if bounds else F.lit(False)
    to = F.array_compact(F.array(F.struct(own.alias("at"), F.lit(0).alias("next")), F.when(head, F.struct((own - 1).alias("at"), F.lit(1).alias("next"))), F.when(first, F.struct(F.lit(n - 1).alias("at"), F.lit(2).alias("next")))))
    dealt = lean.withColumn("to", F.explode(to)).select("doc_id", "text", "to.at", "to.next").repartitionById(n, F.col("at")).sortWithinPartitions("at", "next", "doc_id", "text")
    # a row that is sent along twice to one range must be judged once there: "next" tells
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]

    def judged(one, two):
        (doc, text, chunks), (_, following, other) = one, two
        text2 = edited(text, following)
        data = text2.encode()
        chunks2 = chunk_set(data)
        return (doc, len(text), hashlib.sha256(data).hexdigest(), packed(chunks), packed(chunks2), contained(chunks, chunks2), contained(chunks, other))

    def run(batches):
        last, at_last, tail, out = None, None, False, []
        for batch in batches:
            for doc, text, at, following in zip(*[c.to_pylist() for c in batch.columns]):
                text = text or ""
                if last is not None and at == at_last:
                    if not tail:
                        now = (doc, text, chunk_set(text.encode()))
                        out.append(judged(last, now))
                        last, tail = now, following > 0
                    continue
                if following:
                    continue  # a range without rows of its own
                last, at_last, tail = (doc, text, chunk_set(text.encode())), at, False
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)
                out = []

    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return dealt.mapInArrow(run, schema)
