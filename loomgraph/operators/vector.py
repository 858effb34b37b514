"""Duplicates among the shapes and texts of a vector page."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.operators import folds

# fixed value: overlap from which two boxes of one shape are the same
SAME = 0.98
BOX = ("x1", "y1", "x2", "y2")


def distinct_primitives(rows: DataFrame) -> DataFrame:
    """page, id of the primitives that stay.  rows: page, id, kind, points (a text), x1 .. y2, confidence.

    Of equal ones the surest stays (of these the least id); then, by box, one goes if it overlaps a kept one of its kind and
    points.  Boxes without a place or turned inside out are left out.  A shape's rows are one fold, which holds only kept
    boxes that begin near enough for such an overlap.
    """
    good = rows.filter((F.col("x2") >= F.col("x1")) & (F.col("y2") >= F.col("y1")))
    once = good.groupBy("page", "kind", "points", *BOX).agg(F.max_by("id", F.struct("confidence", -F.col("id"))).alias("id"))

    def step(_, group):
        kept = []
        for page, x1, y1, x2, y2, id_ in group:
            # a box that ends too far before this one's begin cannot overlap it or any later one enough
            kept = [k for k in kept if x1 - k[0] <= (1 / SAME - 1) * 1.001 * (k[2] - k[0])]
            for a, b, c, d in kept:
                w, h = min(c, x2) - max(a, x1), min(d, y2) - max(b, y1)
                if w > 0 and h > 0 and w * h / ((c - a) * (d - b) + (x2 - x1) * (y2 - y1) - w * h) >= SAME:
                    break
            else:
                kept.append((x1, y1, x2, y2))
                yield page, id_

    shape = F.to_json(F.struct("page", "kind", "points"))
    types = dict(once.dtypes)
    return folds.fold(once.select(shape.alias("shape"), "page", *BOX, "id"), "shape", [*BOX, "id"], step, f"page {types['page']}, id {types['id']}")


def distinct_texts(rows: DataFrame) -> DataFrame:
    """page, text, x1 .. y2, id, weight: of equal texts at one place the surest (then the least id); its weight only if all agree, none
    being a weight of its own.  rows: page, id, text, x1 .. y2, confidence, weight.  Boxes without an area are left out."""
    good = rows.filter((F.col("x2") > F.col("x1")) & (F.col("y2") > F.col("y1")))
    kinds = F.count_distinct("weight") + F.max(F.col("weight").isNull().cast("int"))
    best = F.max_by(F.struct("id", "weight"), F.struct("confidence", -F.col("id")))
    found = good.groupBy("page", "text", *BOX).agg(best.alias("best"), kinds.alias("kinds"))
    return found.select("page", "text", *BOX, "best.id", F.when(F.col("kinds") == 1, F.col("best.weight")).alias("weight"))
