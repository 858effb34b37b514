"""Alignment by keys that are unique on both sides.

A key that occurs twice on a side matches nothing.  Uniqueness is counted in the same grouping
that brings the sides together, so a stage is one shuffle on its key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.operators import identifiers
from loomgraph.sources.shared import settled


def unique_pairs(source: DataFrame, generated: DataFrame, key: str, by: list[str] | None = None, id: str = "id") -> DataFrame:
    """by, source_id, generated_id of rows whose key is unique on both sides; null keys match nothing."""
    by = by or []
    tagged = source.select(*by, F.col(key).alias("_key"), F.col(id).alias("_s"), F.lit(None).cast(dict(generated.dtypes)[id]).alias("_g")).unionByName(
        generated.select(*by, F.col(key).alias("_key"), F.lit(None).cast(dict(source.dtypes)[id]).alias("_s"), F.col(id).alias("_g"))
    )
    met = tagged.filter(F.col("_key").isNotNull()).groupBy(*by, "_key").agg(F.count("_s").alias("_ns"), F.count("_g").alias("_ng"), F.max("_s").alias("source_id"), F.max("_g").alias("generated_id"))
    return met.filter("_ns = 1 and _ng = 1").select(*by, "source_id", "generated_id")


def left_over(rows: DataFrame, taken: DataFrame, column: str, by: list[str] | None = None, id: str = "id") -> DataFrame:
    by = by or []
    return rows.join(taken.select(*by, F.col(column).alias(id)), [*by, id], "left_anti")


def cascade(source: DataFrame, generated: DataFrame, stages: list[tuple[str, str]], by: list[str] | None = None) -> DataFrame:
    """source_id, generated_id, stage: each stage (name, key column) pairs what is left over from
    those before; rows without a partner have a null on the other side and the stage "unmatched"."""
    by = by or []
    out = None
    left, right = source, generated
    for name, key in stages:
        # read by what is left over on both sides and by the result; found once
        got = settled(unique_pairs(left, right, key, by), "pairs")
        left, right = left_over(left, got, "source_id", by), left_over(right, got, "generated_id", by)
        got = got.withColumn("stage", F.lit(name))
        out = got if out is None else out.unionByName(got)
    none = F.lit(None).cast(dict(source.dtypes)["id"])
    out = out.unionByName(left.select(*by, F.col("id").alias("source_id"), none.alias("generated_id"), F.lit("unmatched").alias("stage")))
    return out.unionByName(right.select(*by, none.alias("source_id"), F.col("id").alias("generated_id"), F.lit("unmatched").alias("stage")))


def evaluation_pairs(truth: DataFrame, output: DataFrame, shared_ids: Column | bool, by: list[str] | None = None) -> DataFrame:
    """Pairs by unique label; with a shared namespace a pair of equal id and equal label overrides."""
    by = by or []
    labelled = unique_pairs(truth, output, "label", by)
    same = truth.select(*by, "id", "label").join(output.select(*by, "id", "label"), [*by, "id", "label"])
    same = same.filter(F.lit(shared_ids) if isinstance(shared_ids, bool) else shared_ids).select(*by, F.col("id").alias("source_id"), F.col("id").alias("generated_id")).distinct()
    rest = labelled.join(same.select(*by, "source_id"), [*by, "source_id"], "left_anti").join(same.select(*by, "generated_id"), [*by, "generated_id"], "left_anti")
    return same.unionByName(rest.select(*by, "source_id", "generated_id"))


def remap(edges: DataFrame, pairs: DataFrame, columns: list[str], by: list[str] | None = None) -> DataFrame:
    """``edges`` with generated ids replaced by source ids; ids without a pair are marked."""
    by = by or []
    out = edges
    for c in columns:
        at = pairs.select(*by, F.col("generated_id").cast("string").alias(c), F.col("source_id").cast("string").alias("_to"))
        out = out.withColumn(c, F.col(c).cast("string")).join(at, [*by, c], "left").withColumn(c, F.coalesce("_to", F.concat(F.lit("generated:"), F.col(c)))).drop("_to")
    return out


def by_id(source: DataFrame, generated: DataFrame, order: list[str], by: str = "g", id: str = "id") -> DataFrame:
    """by, source_id, generated_id: ids that are on both sides, but for those of the source whose portable forms cannot be told apart
    (and what these are emitted as).  ``order``: in which the source's ids are emitted."""
    unclear = identifiers.ambiguous(source, order, by, id).select(by, id).distinct()
    both = source.select(by, id).distinct().join(generated.select(by, id).distinct(), [by, id]).join(unclear, [by, id], "left_anti")
    return both.select(by, F.col(id).alias("source_id"), F.col(id).alias("generated_id"))
