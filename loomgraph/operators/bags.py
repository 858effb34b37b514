"""Multisets: counts by key, and what two of them share.

Two bags meet in one grouping over their union, tagged by side: partial sums are taken before the
only shuffle, and no key is ever paired with another row of its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def bag(rows: DataFrame, *keys: str, n: str | None = None) -> DataFrame:
    """Multiplicity ``n`` of each key; ``n`` names a column of counts to be summed instead."""
    return rows.groupBy(*keys).agg((F.count("*") if n is None else F.sum(n)).alias("n"))


def side_by_side(one: DataFrame, other: DataFrame, keys: list[str], n: str = "n") -> DataFrame:
    """keys, n_a, n_b: multiplicities in either bag, 0 where a key is missing."""
    left = one.select(*keys, F.col(n).alias("n_a"), F.lit(0).cast("long").alias("n_b"))
    right = other.select(*keys, F.lit(0).cast("long").alias("n_a"), F.col(n).alias("n_b"))
    return left.unionByName(right).groupBy(*keys).agg(F.sum("n_a").alias("n_a"), F.sum("n_b").alias("n_b"))


def intersection(one: DataFrame, other: DataFrame, keys: list[str]) -> DataFrame:
    return side_by_side(one, other, keys).select(*keys, F.least("n_a", "n_b").alias("n")).filter("n > 0")


def union_max(one: DataFrame, other: DataFrame, keys: list[str]) -> DataFrame:
    """The union of multisets: the greater multiplicity, not the sum."""
    return side_by_side(one, other, keys).select(*keys, F.greatest("n_a", "n_b").alias("n"))


def difference(one: DataFrame, other: DataFrame, keys: list[str]) -> DataFrame:
    return side_by_side(one, other, keys).select(*keys, (F.col("n_a") - F.col("n_b")).alias("n")).filter("n > 0")


def ratio(a: Column, b: Column) -> Column:
    """a / b, null when b is 0."""
    return a / F.nullif(b, F.lit(0).cast("long"))


def f1_of(overlap: Column, candidate: Column, reference: Column) -> Column:
    """Null without a reference, 0 without a candidate: unavailable is not zero."""
    both = candidate + reference
    return F.when(reference > 0, 2.0 * overlap / both)


def _scores(pairs: DataFrame, by: list[str]) -> DataFrame:
    """Sums over keys first, ratios last; pairs: by, keys, n_a (candidate), n_b (reference)."""
    sums = pairs.groupBy(*by).agg(F.coalesce(F.sum(F.least("n_a", "n_b")), F.lit(0)).alias("overlap"), F.coalesce(F.sum("n_a"), F.lit(0)).alias("candidate"), F.coalesce(F.sum("n_b"), F.lit(0)).alias("reference"))
    o, c, r = F.col("overlap"), F.col("candidate"), F.col("reference")
    return sums.select(*by, "overlap", "candidate", "reference", ratio(o, c).alias("precision"), ratio(o, r).alias("recall"), f1_of(o, c, r).alias("f1"))


def f1(candidate: DataFrame, reference: DataFrame, keys: list[str], by: list[str] | None = None) -> DataFrame:
    """by, overlap, candidate, reference, precision, recall, f1 of two bags of ``by`` + ``keys``."""
    by = by or []
    return _scores(side_by_side(candidate, reference, [*by, *keys]), by)


def f1_of_sides(rows: DataFrame, keys: list[str], by: list[str] | None = None, side: str = "side", candidate="cand", reference="ref", n: str = "n") -> DataFrame:
    """The same of rows that carry both sides, so that what they come from is computed once."""
    by = by or []
    one = lambda v: F.coalesce(F.sum(F.when(F.col(side) == F.lit(v), F.col(n))), F.lit(0))
    return _scores(rows.groupBy(*by, *keys).agg(one(candidate).alias("n_a"), one(reference).alias("n_b")), by)


def recall(found: DataFrame, wanted: DataFrame, keys: list[str], by: list[str] | None = None) -> DataFrame:
    """by, overlap, wanted, recall: null where nothing is wanted."""
    out = f1(found, wanted, keys, by)
    return out.select(*(by or []), "overlap", F.col("reference").alias("wanted"), "recall")


def equal(one: DataFrame, other: DataFrame, keys: list[str], by: list[str]) -> DataFrame:
    """by, equal: whether both bags of each group are the same."""
    return side_by_side(one, other, [*by, *keys]).groupBy(*by).agg(F.bool_and(F.col("n_a") == F.col("n_b")).alias("equal"))
