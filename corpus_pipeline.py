"""The corpus pipeline: toxicity, near-duplicates, mixing, byte-level BPE.

Each stage is a function of (spark, docs, sf_dir); its rows are written as Parquet and read again
as the next one's docs.  All but the last keep the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm import bpe, entry, mixing, simhash, toxicity
from loomgraph.llm._shared import table, written

#: Documents with at least this score are rejected.
TOXIC = 0.7
#: Sources are made as much alike as at most two rounds over any allow; the budget is the least at which each
#: source has a whole round, so no document is left out and those of smaller sources come twice.
MIX = mixing.Target(entropy=1.0, repeats=2.0, budget=None)


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is below the limit; the classifier learns from their labels."""
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic")
    model = toxicity.fit(docs.select("doc_id", "text"), labels)
    return toxicity.scored(docs, model, name="_score").filter(F.col("_score") < TOXIC).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest doc_id, of each group of copies and near copies."""
    return simhash.keep_first(docs, simhash.SIMILAR)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mixture takes them."""
    return mixing.mixture(docs, MIX).select(*docs.columns)


def encode_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their number of tokens and ids."""
    return bpe.encode(docs, entry.tokenizer("byte_bpe_multi_50k.tiktoken"))


STAGES = [("toxicity", reject_toxic), ("simhash_near_dedup", drop_near_copies), ("source_mixing", mix_sources), ("byte_bpe", encode_ids)]

#: The classifier, the fingerprints and the merges have no SQL; tests hold stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
