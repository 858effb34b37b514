"""Toxicity by a linear classifier over character n-grams (operator 10).

Features are the distinct n-grams of code points of the lower-cased text between blanks, each by a 64-bit hash, so
that none are taken for each other.  Each is scaled by its naive Bayes log-count ratio between toxic and
other labelled texts, and a ridge logistic regression is fitted on the scaled features (NB-SVM).  The model is
fitted on at most ``rows`` labelled texts, those with the least hash of doc_id, and has every feature of theirs.
Only the text ever enters a score.

Defined results: a null or empty text has the features of two blanks; labels that repeat a doc_id
count each, contradictory or not, and of texts that repeat a doc_id the least is learnt from; null labels are left
out; without labels of both kinds the score is the share of toxic labels, or 0 without any; rows that repeat a
doc_id are each scored; other columns do not matter.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomgraph.llm._shared import ready, written


@dataclass(frozen=True)
class Settings:
    grams: tuple[int, ...] = (3, 4)
    rows: int = 3000
    smooth: float = 1.0
    ridge: float = 10.0  # against the sum over all texts
    steps: int = 100


@dataclass(frozen=True)
class Model:
    """``keys``: hashes of the features in order; ``ratio``: of each; ``weight``: times its ratio."""

    keys: np.ndarray
    ratio: np.ndarray
    weight: np.ndarray
    bias: float


def features(text: str | None, grams: tuple[int, ...], block: int = 1 << 20) -> np.ndarray:
    """Hashes of the distinct n-grams, in order; long texts are worked through in blocks."""
    whole, longest, found = f" {(text or '').lower()} ", max(grams), []
    for i in range(0, len(whole), block):
        part = np.frombuffer(whole[i : i + block + longest - 1].encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        h = np.zeros(len(part), np.uint64)
        parts = []
        for n in range(1, min(longest, len(part)) + 1):
            h = h[: len(part) - n + 1] * np.uint64(0x9E3779B97F4A7C15) + part[n - 1 :] + np.uint64(1)
            if n in grams:
                # grams that begin in the next block are left to it
                own = h[:block]
                x = (own ^ (own >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9)
                parts.append(x ^ (x >> np.uint64(29)))
        if parts:
            found.append(np.unique(np.concatenate(parts)))
    return np.zeros(0, np.uint64) if not found else found[0] if len(found) == 1 else np.unique(np.concatenate(found))


def sample(docs: DataFrame, labels: DataFrame, s: Settings) -> DataFrame:
    """doc_id, y and the features of at most ``s.rows`` labelled texts, as a written table.

    ``labels``: doc_id, toxic.  The sample's ids, at most ``s.rows``, are sent to all tasks, so no
    other text is shuffled.
    """
    ready(docs.sparkSession)
    chosen = labels.filter("doc_id is not null and toxic is not null").select("doc_id", F.col("toxic").cast("int").alias("y"))
    chosen = written(chosen.orderBy(F.xxhash64("doc_id"), "doc_id", "y").limit(s.rows), "chosen")
    texts = docs.select(F.col("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).join(F.broadcast(chosen.select("doc_id").distinct()), "doc_id", "left_semi")
    # a doc_id has one text, so there are no more rows than labels
    texts = texts.groupBy("doc_id").agg(F.min("text").alias("text")).join(F.broadcast(chosen), "doc_id").select("doc_id", "y", "text")
    grams = s.grams

    def run(batches):
        for batch in batches:
            found = [features(x.as_py(), grams) for x in batch.column(2)]
            ends = np.concatenate([[0], np.cumsum([len(x) for x in found])]).astype(np.int32)
            flat = np.concatenate(found) if found else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat.view(np.int64)))], names=["doc_id", "y", "features"])

    return written(texts.mapInArrow(run, T.StructType([texts.schema["doc_id"], T.StructField("y", T.IntegerType()), T.StructField("features", T.ArrayType(T.LongType()))])), "labelled")


def fit(docs: DataFrame, labels: DataFrame, s: Settings = Settings()) -> Model:
    """The model.  To the driver come the features of at most ``rows`` texts, 8 bytes each."""
    got = sample(docs, labels, s).toArrow().combine_chunks()
    # in one order at every run: the sums of the fit depend on it
    doc, y = got["doc_id"].to_pylist(), np.array([v == 1 for v in got["y"].to_pylist()], bool)
    order = sorted(range(len(doc)), key=lambda i: (doc[i], y[i]))
    y = y[order]
    n1, n0 = int(y.sum()), int((~y).sum())
    none = np.zeros(0)
    if not n0 or not n1:
        return Model(none.astype(np.uint64), none, none, float("inf") if n1 else float("-inf"))
    parts = [x for i in order for x in [got["features"][i].values.to_numpy()]]
    size = np.array([len(x) for x in parts])
    flat = np.concatenate(parts).view(np.uint64)
    del got, parts
    keys, at = np.unique(flat, return_inverse=True)
    del flat
    at = at.astype(np.int32)
    p = np.bincount(at[np.repeat(y, size)], minlength=len(keys))
    q = np.bincount(at, minlength=len(keys)) - p
    ratio = np.log((p + s.smooth) / (n1 + 2 * s.smooth)) - np.log((q + s.smooth) / (n0 + 2 * s.smooth))
    w, bias = logistic(at, size, ratio, y, s)
    return Model(keys, ratio, w * ratio, bias)


def logistic(at: np.ndarray, size: np.ndarray, ratio: np.ndarray, y: np.ndarray, s: Settings) -> tuple[np.ndarray, float]:
    """Ridge logistic regression by Adam over all rows at each step; every text has a feature.

    ``at``: the features of one text after another, ``size`` of each.  Sums go along the texts and, in another
    order of the same entries, along the features.
    """
    begin = np.concatenate([[0], np.cumsum(size)[:-1]])
    order = np.argsort(at, kind="stable").astype(np.int32)
    row = np.repeat(np.arange(len(size), dtype=np.int32), size)[order]
    first = np.searchsorted(at[order], np.arange(len(ratio)))
    del order
    w, b, n = np.full(len(ratio), 0.05), 0.0, len(y)
    m, v, mb, vb = np.zeros(len(ratio)), np.zeros(len(ratio)), 0.0, 0.0
    for step in range(1, s.steps + 1):
        z = np.add.reduceat((w * ratio)[at], begin) + b
        err = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - y
        g = np.add.reduceat(err[row], first) * ratio / n + s.ridge / n * w
        gb = float(err.mean())
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        mb, vb = 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
        a, c = 1 - 0.9**step, 1 - 0.99**step
        w -= 0.02 * (m / a) / (np.sqrt(v / c) + 1e-8)
        b -= 0.05 * (mb / a) / (np.sqrt(vb / c) + 1e-8)
    return w, b


def scored(docs: DataFrame, model: Model, s: Settings = Settings(), name: str = "score") -> DataFrame:
    """``docs`` with the score of each whole text.  One pass, no shuffle; the model is that of the bounded sample."""
    spark = docs.sparkSession
    ready(spark)
    sent = spark.sparkContext.broadcast((model.keys, model.weight))
    bias, grams = model.bias, s.grams
    keep = [c for c in docs.columns if c != name]
    lean = docs.select(*keep)
    at = keep.index("text")

    def run(batches):
        keys, weight = sent.value
        for batch in batches:
            z = np.full(batch.num_rows, bias)
            for i, x in enumerate(batch.column(at)):
                if len(keys):
                    found = features(x.as_py(), grams)
                    place = np.minimum(np.searchsorted(keys, found), len(keys) - 1)
                    z[i] += weight[place[keys[place] == found]].sum()
            with np.errstate(over="ignore"):
                score = 1 / (1 + np.exp(-z))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score)], names=[*keep, name])

    return lean.mapInArrow(run, T.StructType([*lean.schema.fields, T.StructField(name, T.DoubleType())]))


def held_out(doc_id: str = "doc_id"):
    """Whether a document is in the fold that labels are never learnt from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def judge(docs: DataFrame, labels: DataFrame, s: Settings = Settings(), limit: float = 0.7) -> DataFrame:
    """doc_id, held_out, score, predicted of every document; learns from the other folds."""
    lean = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    model = fit(lean, labels.select(F.col("doc_id").cast("long").alias("doc_id"), "toxic").filter(~held_out()), s)
    rows = scored(lean, model, s)
    return rows.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= limit).cast("int").alias("predicted"))
