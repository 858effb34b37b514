"""Token counts without encoding (operator 4).

Before any text is read, every string of the vocabulary is put to the library; those that come
back as the one token they name are proven to stand for themselves.  A pre-token among them
counts as one.  Only the others are merged, and only their number of tokens is kept.

Defined results: a null or empty text has 0 bytes and 0 tokens; special strings inside a text
count as one token each, as by the library's default; repeated rows are counted each on its own;
other columns than doc_id and text do not matter.
"""

from __future__ import annotations

import json
import re
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm import _pretok
from loomgraph.llm._shared import ready
from loomgraph.llm.bpe import SHIFT, Merger, _slices


def byte_letters() -> dict[str, int]:
    """The printable letter that byte-level vocabularies write for each byte, to the byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def read_model(path: str) -> dict:
    """Vocabulary, merges and special strings of a byte-level tokenizers file."""
    with open(path, encoding="utf-8") as f:
        whole = json.load(f)
    model = whole["model"]
    merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
    for token in whole["added_tokens"]:
        if token["normalized"] or token["lstrip"] or token["rstrip"] or token["single_word"]:
            raise ValueError("only plain special strings are supported")
    return {"vocab": model["vocab"], "merges": merges, "special": [t["content"] for t in whole["added_tokens"]]}


def merger_of(model: dict) -> Merger:
    vocab, pairs, made = model["vocab"], {}, []
    for rank, (left, right) in enumerate(model["merges"]):
        pairs.setdefault(vocab[left] << SHIFT | vocab[right], rank)
        made.append(vocab[left + right])
    letters = byte_letters()
    single = [0] * 256
    for letter, b in letters.items():
        single[b] = vocab[letter]
    return Merger(single, pairs, made, len(made))


def proven_single(path: str) -> list[str]:
    """The vocabulary strings that are one pre-token and that the library encodes as one token."""
    from tokenizers import Tokenizer

    letters = byte_letters()
    table = _pretok.tokenizers_classes()
    strings = {}
    for token, number in read_model(path)["vocab"].items():
        try:
            text = bytes(map(letters.__getitem__, token)).decode()
        except (KeyError, UnicodeDecodeError):
            continue
        if len(_pretok.pieces(text, table)) == 1:
            strings[text] = number
    found = Tokenizer.from_file(path).encode_batch(list(strings), add_special_tokens=False)
    return [s for (s, n), e in zip(strings.items(), found) if e.ids == [n]]


def split_special(text: str, special: list[str]) -> list[str]:
    """The text between special strings, the first that begins and of those the longest: one part more than it has of them."""
    if not any(s in text for s in special):
        return [text]
    return re.split("|".join(re.escape(s) for s in sorted(special, key=len, reverse=True)), text)


class Counter:
    """Counts tokens; lives in a Python worker across tasks."""

    _kept: dict[str, Counter] = {}

    def __init__(self, path: str, table: np.ndarray, proven: list[str]):
        model = read_model(path)
        self.table, self.special = table, model["special"]
        self.merger = merger_of(model)
        self.memo = _pretok.Memo(self._solve, fixed=dict.fromkeys(proven, 1))

    @classmethod
    def of(cls, path: str, table, proven) -> Counter:
        if path not in cls._kept:
            cls._kept[path] = cls(path, table.value, proven.value)
        return cls._kept[path]

    def _solve(self, found: list[str]) -> list[int]:
        _, ends = self.merger.merge_all([p.encode() for p in found])
        return np.diff(ends, prepend=0).tolist()

    def count(self, texts: list[str]) -> list[int]:
        cut, table = _pretok.pieces, self.table
        parts = [split_special(t, self.special) for t in texts]
        found = [list(chain.from_iterable(cut(x, table) for x in p)) for p in parts]
        self.memo.learn(list(chain.from_iterable(found)))
        get = self.memo.young.__getitem__
        return [sum(map(get, x)) + len(p) - 1 for x, p in zip(found, parts)]


def token_counts(docs: DataFrame, path: str, limit: int = 512) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of every document.  One pass, no shuffle."""
    spark = docs.sparkSession
    ready(spark)
    table = spark.sparkContext.broadcast(_pretok.tokenizers_classes())
    proven = spark.sparkContext.broadcast(proven_single(path))

    def run(batches):
        counter = Counter.of(path, table, proven)
        for batch in batches:
            for rows in _slices(batch, 1):
                texts = [x or "" for x in rows.column(1).to_pylist()]
                counts = counter.count(texts)
                yield pa.RecordBatch.from_arrays(
                    [rows.column(0), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(counts, pa.int64()), pa.array([c > limit for c in counts])],
                    names=["doc_id", "n_bytes", "n_tokens", "over_limit"],
                )

    lean = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return lean.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
