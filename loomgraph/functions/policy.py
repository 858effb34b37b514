"""Scores, grades and the publishing policy.  A missing metric is missing, never 0."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: weights of metrics in the aggregate
WEIGHTS = {"syntax": 0.12, "render": 0.13, "ocr": 0.14, "provenance": 0.13, "edge": 0.10, "arrow": 0.08, "layout": 0.08, "type": 0.08, "path": 0.08, "numeric": 0.06}
# fixed values: metrics that say nothing about meaning
FORMAL = ("syntax", "render")
# fixed values: least scores of grades
GRADES = (("A", 0.85), ("B", 0.70), ("C", 0.50))
# fixed values: candidates, types and repairs allowed in each mode
MODES = {"strict": (1, 1, 1), "extended": (3, 2, 3), "maximal": (6, 3, 10)}
REVIEW_BELOW, PUBLISH_FROM = 0.70, 0.50


def weighted(metrics: dict[str, Column], semantic_only: bool = False) -> Column:
    """Mean of the available metrics by weight; null if only formal ones are available."""
    names = [m for m in metrics if not (semantic_only and m in FORMAL)]
    total, mass, any_ = F.lit(0.0), F.lit(0.0), F.lit(False)
    for m in names:
        have = metrics[m].isNotNull()
        total = total + F.when(have, metrics[m] * WEIGHTS[m]).otherwise(0.0)
        mass = mass + F.when(have, WEIGHTS[m]).otherwise(0.0)
        if m not in FORMAL:
            any_ = any_ | have
    return F.when(any_, total / mass)


def grade(score: Column) -> Column:
    out = F.when(score.isNull(), "U")
    for name, least in GRADES:
        out = out.when(score >= least, name)
    return out.otherwise("D")


def decision(candidate: Column, sound: Column, policy: Column, aggregate: Column, semantic: Column) -> Column:
    """publish, review or none."""
    letter = grade(aggregate)
    return (
        F.when(~candidate, "none")
        .when(~sound, "review")
        .when(policy == "sidecar_only", "none")
        .when(policy == "review_required", "review")
        .when(aggregate.isNull() | letter.isin("D", "U") | semantic.isNull(), "review")
        .when(policy == "strict", F.when((aggregate >= REVIEW_BELOW) & (semantic >= REVIEW_BELOW), "publish").otherwise("review"))
        .otherwise(F.when((aggregate >= PUBLISH_FROM) & (semantic >= PUBLISH_FROM), "publish").otherwise("review"))
    )


def weighted_rows(rows: DataFrame, by: list[str]) -> DataFrame:
    """The same from rows of by, metric, value (null if unavailable)."""
    weights = F.create_map(*[F.lit(x) for kv in WEIGHTS.items() for x in kv])
    w = F.element_at(weights, F.col("metric"))
    have = F.col("value").isNotNull()
    return rows.groupBy(*by).agg(
        F.sum(F.when(have, F.col("value") * w)).alias("_s"), F.sum(F.when(have, w)).alias("_w"), F.bool_or(have & ~F.col("metric").isin(*FORMAL)).alias("_any")
    ).select(*by, F.when(F.col("_any"), F.col("_s") / F.col("_w")).alias("aggregate"))
