"""Joins and greedy choices over boxes on pages.

A page is the equality key of every spatial join; on it a grid cell is a second one, so that a
page with very many boxes is spread and only boxes in a common cell are compared.  Greedy choices
depend on what was chosen before, so they run over one page's rows in a pandas function.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.functions import geom


def cells(rows: DataFrame, size: float, prefix: str = "") -> DataFrame:
    """``rows`` once for each grid cell that their box meets: columns gx, gy."""
    x1, y1, x2, y2 = geom.box(prefix)
    span = lambda lo, hi: F.sequence(F.floor(lo / size), F.floor(hi / size))
    return rows.withColumn("gx", F.explode(span(x1, x2))).withColumn("gy", F.explode(span(y1, y2)))


def _first_cell(a, b, size: float) -> Column:
    """Whether (gx, gy) is the lowest cell that both boxes meet: keeps each pair once."""
    return (F.col("gx") == F.floor(F.greatest(a[0], b[0]) / size)) & (F.col("gy") == F.floor(F.greatest(a[1], b[1]) / size))


def box_pairs(one: DataFrame, other: DataFrame, size: float, condition=None, page: str = "page") -> DataFrame:
    """Pairs of boxes of a page that meet (or touch); columns get the prefixes a_ and b_."""
    left = cells(one, size).select(page, "gx", "gy", *[F.col(c).alias(f"a_{c}") for c in one.columns if c != page])
    right = cells(other, size).select(page, "gx", "gy", *[F.col(c).alias(f"b_{c}") for c in other.columns if c != page])
    a, b = geom.box("a_"), geom.box("b_")
    meet = (a[0] <= b[2]) & (b[0] <= a[2]) & (a[1] <= b[3]) & (b[1] <= a[3])
    out = left.join(right, [page, "gx", "gy"]).filter(meet & _first_cell(a, b, size))
    return (out if condition is None else out.filter(condition)).drop("gx", "gy")


def iou_pairs(boxes: DataFrame, least: float, size: float = 32.0) -> DataFrame:
    """page, a, b, iou of different boxes of a page, a < b."""
    out = box_pairs(boxes.select("page", "id", "x1", "y1", "x2", "y2"), boxes.select("page", "id", "x1", "y1", "x2", "y2"), size, F.col("a_id") < F.col("b_id"))
    return out.select("page", F.col("a_id").alias("a"), F.col("b_id").alias("b"), geom.iou(geom.box("a_"), geom.box("b_")).alias("iou")).filter(F.col("iou") >= least)


def points_in_boxes(points: DataFrame, boxes: DataFrame, size: float = 32.0) -> DataFrame:
    """page, pid, id of points that lie in a box (its edges included)."""
    p = points.withColumns({"gx": F.floor(F.col("x") / size), "gy": F.floor(F.col("y") / size)})
    b = cells(boxes.select("page", "id", "x1", "y1", "x2", "y2"), size)
    return p.join(b, ["page", "gx", "gy"]).filter(geom.inside(F.col("x"), F.col("y"), geom.box())).drop("gx", "gy")


def nearest(points: DataFrame, boxes: DataFrame, tolerance: float, tie: float = 1e-6) -> DataFrame:
    """pid, id, distance of the box nearest to each point; null if none is within ``tolerance`` or if
    two are as near.  Points meet the boxes of their own and the cells around, no cell being
    smaller than the tolerance."""
    p = points.select("page", "pid", "x", "y")
    grown = boxes.select("page", "id", "x1", "y1", "x2", "y2", (F.col("x1") - tolerance).alias("g_x1"), (F.col("y1") - tolerance).alias("g_y1"), (F.col("x2") + tolerance).alias("g_x2"), (F.col("y2") + tolerance).alias("g_y2"))
    size = max(32.0, tolerance)
    b = cells(grown, size, "g_").select("page", "id", "x1", "y1", "x2", "y2", "gx", "gy")
    at = p.withColumns({"gx": F.floor(F.col("x") / size), "gy": F.floor(F.col("y") / size)})
    d = geom.point_to_box(F.col("x"), F.col("y"), geom.box())
    near = at.join(b, ["page", "gx", "gy"]).select("pid", "id", d.alias("distance")).filter(F.col("distance") <= tolerance)
    two = near.groupBy("pid").agg(F.min(F.struct("distance", "id")).alias("best"), F.get(F.sort_array(F.collect_list("distance")), F.lit(1)).alias("second"))
    ok = F.col("second").isNull() | (F.col("second") - F.col("best.distance") > tie)
    found = two.select("pid", F.when(ok, F.col("best.id")).alias("id"), F.when(ok, F.col("best.distance")).alias("distance"))
    return p.select("pid").join(found, "pid", "left")


def greedy_keep(boxes: DataFrame, most: float, limit: int | None = None, order: tuple[str, ...] = ("score", "area", "id")) -> DataFrame:
    """The boxes of each page that are kept when taken by descending score and area, ascending id,
    and those are left out that overlap a kept one by more than ``most`` (IoU)."""
    names = ["page", "id", "x1", "y1", "x2", "y2", "score"]
    schema = ", ".join(f"{c} {t}" for c, t in boxes.select(*names).dtypes)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        area = (pdf.x2 - pdf.x1) * (pdf.y2 - pdf.y1)
        pdf = pdf.assign(_a=area).sort_values(["score", "_a", "id"], ascending=[False, False, True])
        b = pdf[["x1", "y1", "x2", "y2"]].to_numpy(float)
        sizes, left, kept = pdf["_a"].to_numpy(float), np.arange(len(pdf)), []
        while len(left) and (limit is None or len(kept) < limit):
            i, left = left[0], left[1:]
            kept.append(i)
            w = np.clip(np.minimum(b[left, 2], b[i, 2]) - np.maximum(b[left, 0], b[i, 0]), 0, None)
            h = np.clip(np.minimum(b[left, 3], b[i, 3]) - np.maximum(b[left, 1], b[i, 1]), 0, None)
            inter = w * h
            whole = sizes[left] + sizes[i] - inter
            left = left[np.where(whole > 0, inter / np.where(whole > 0, whole, 1), 0) <= most]
        return pdf.iloc[kept][names]

    return boxes.select(*names).groupBy("page").applyInPandas(run, schema)


def greedy_clusters(boxes: DataFrame, least: float = 0.45) -> DataFrame:
    """page, id, cluster: each record in order joins the cluster of its own id, else the cluster whose
    box it overlaps best (at least ``least``, the lowest such), else begins one."""
    schema = "page long, id long, cluster int"

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["rank", "id"], ascending=[False, True])
        heads, ids, out = np.zeros((0, 4)), {}, []
        for r in pdf.itertuples(index=False):
            at = ids.get(r.key)
            if at is None and len(heads):
                w = np.clip(np.minimum(heads[:, 2], r.x2) - np.maximum(heads[:, 0], r.x1), 0, None)
                h = np.clip(np.minimum(heads[:, 3], r.y2) - np.maximum(heads[:, 1], r.y1), 0, None)
                whole = (heads[:, 2] - heads[:, 0]) * (heads[:, 3] - heads[:, 1]) + (r.x2 - r.x1) * (r.y2 - r.y1) - w * h
                iou = np.where(whole > 0, w * h / np.where(whole > 0, whole, 1), 0)
                best = int(np.argmax(iou))
                at = best if iou[best] >= least else None
            if at is None:
                at = len(heads)
                heads = np.vstack([heads, [r.x1, r.y1, r.x2, r.y2]])
            ids.setdefault(r.key, at)
            out.append(at)
        return pd.DataFrame({"page": pdf.page, "id": pdf.id, "cluster": np.array(out, np.int32)})

    return boxes.select("page", "id", "key", "rank", "x1", "y1", "x2", "y2").groupBy("page").applyInPandas(run, schema)


def box_components(boxes: DataFrame, gap: float, least_share: float = 0.22, most_area: float | None = None) -> DataFrame:
    """page, id, component: boxes that contain each other, or are close on one axis and overlap on
    the other, chained, unless both together take over ``most_area``; the component is named by its
    smallest id."""
    schema = "page long, id long, component long"

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id")
        b = pdf[["x1", "y1", "x2", "y2"]].to_numpy(float)
        ids, n = pdf["id"].to_numpy(), len(pdf)
        root = np.arange(n)

        def top(i):
            while root[i] != i:
                root[i] = root[root[i]]
                i = root[i]
            return i

        for i in range(n - 1):
            a, o = b[i], b[i + 1 :]
            inside = ((a[:2] <= o[:, :2]).all(1) & (a[2:] >= o[:, 2:]).all(1)) | ((a[:2] >= o[:, :2]).all(1) & (a[2:] <= o[:, 2:]).all(1))
            near = np.zeros(len(o), bool)
            for x, y in ((0, 1), (1, 0)):
                space = np.maximum(a[x], o[:, x]) - np.minimum(a[x + 2], o[:, x + 2])
                common = np.minimum(a[y + 2], o[:, y + 2]) - np.maximum(a[y], o[:, y])
                short = np.minimum(a[y + 2] - a[y], o[:, y + 2] - o[:, y])
                near |= (space <= gap) & (common >= least_share * short) & (short > 0)
            joined = inside | near
            if most_area is not None:
                joined &= (np.maximum(a[2], o[:, 2]) - np.minimum(a[0], o[:, 0])) * (np.maximum(a[3], o[:, 3]) - np.minimum(a[1], o[:, 1])) <= most_area
            for j in np.flatnonzero(joined).tolist():
                p, q = top(i), top(i + 1 + j)
                root[max(p, q)] = min(p, q)
        return pd.DataFrame({"page": pdf.page, "id": ids, "component": [ids[top(i)] for i in range(n)]})

    return boxes.select("page", "id", "x1", "y1", "x2", "y2").groupBy("page").applyInPandas(run, schema)


def largest(boxes: DataFrame, n: int) -> DataFrame:
    """The ``n`` largest boxes of each page, ties by id."""
    w = Window.partitionBy("page").orderBy(F.desc(geom.area(geom.box())), "id")
    return boxes.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= n).drop("_n")


def fragment_pairs(fragments: DataFrame) -> DataFrame:
    """a, b, score: fragments of a page, or of it and the next, that may be one.

    ``fragments``: page, id, x1, y1, x2, y2, page_w, page_h, caption, continued, touches (array of
    edges).  The join is on pages: each fragment goes to its page and to the one before.
    """
    cols = ["page", "id", "x1", "y1", "x2", "y2", "caption", "continued", "touches", "page_w", "page_h"]
    left = fragments.select(F.col("page").alias("at"), *[F.col(c).alias(f"a_{c}") for c in cols])
    right = fragments.select(F.explode(F.array(F.col("page"), F.col("page") - 1)).alias("at"), *[F.col(c).alias(f"b_{c}") for c in cols])
    a, b = geom.box("a_"), geom.box("b_")
    same = F.col("a_page") == F.col("b_page")
    side = lambda i, j, size: (geom.gap(a[i], a[i + 2], b[i], b[i + 2]) <= 0.04 * size) & (geom.overlap(a[j], a[j + 2], b[j], b[j + 2]) > 0)
    adjacent = same & (side(0, 1, F.col("a_page_w")) | side(1, 0, F.col("a_page_h")))
    touch = F.when(same, F.arrays_overlap("a_touches", "b_touches")).otherwise(F.array_contains("a_touches", "bottom") & F.array_contains("b_touches", "top"))
    caption = (F.col("a_caption") == F.col("b_caption")) & (F.col("a_caption") != "")
    caption = F.coalesce(caption, F.lit(False))
    goes_on = F.col("b_continued")
    semantic = caption | goes_on
    spatial = adjacent | (~same & touch)
    score = F.least(F.lit(0.98), 0.34 + 0.24 * adjacent.cast("int") + 0.18 * touch.cast("int") + 0.14 * caption.cast("int") + 0.16 * goes_on.cast("int"))
    earlier = F.when(same, F.col("a_id") < F.col("b_id")).otherwise(F.lit(True))
    out = left.join(right, "at").filter(earlier & spatial & (semantic | (same & touch)) & (same | semantic))
    return out.select(F.col("a_id").alias("a"), F.col("b_id").alias("b"), same.alias("same_page"), F.round(score, 6).alias("score"))
