"""Boxes and points as column expressions.  A box is four columns x1, y1, x2, y2 with a prefix."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def box(prefix: str = "") -> tuple[Column, Column, Column, Column]:
    return tuple(F.col(f"{prefix}{c}") for c in ("x1", "y1", "x2", "y2"))


def valid(b, unit: bool = False) -> Column:
    x1, y1, x2, y2 = b
    finite = F.lit(True)
    for c in b:
        finite = finite & c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    out = finite & (x2 >= x1) & (y2 >= y1)
    return out & (F.least(x1, y1) >= 0) & (F.greatest(x2, y2) <= 1) if unit else out


def area(b) -> Column:
    return (b[2] - b[0]) * (b[3] - b[1])


def overlap(lo1, hi1, lo2, hi2) -> Column:
    return F.greatest(F.lit(0.0), F.least(hi1, hi2) - F.greatest(lo1, lo2))


def overlap_share(lo1, hi1, lo2, hi2) -> Column:
    """Overlap over the shorter length; 0 if that is 0."""
    short = F.least(hi1 - lo1, hi2 - lo2)
    return F.when(short > 0, overlap(lo1, hi1, lo2, hi2) / short).otherwise(0.0)


def shared(a, b) -> Column:
    return overlap(a[0], a[2], b[0], b[2]) * overlap(a[1], a[3], b[1], b[3])


def iou(a, b) -> Column:
    inter = shared(a, b)
    whole = area(a) + area(b) - inter
    return F.when(whole > 0, inter / whole).otherwise(0.0)


def contains(outer, inner) -> Column:
    return (outer[0] <= inner[0]) & (outer[1] <= inner[1]) & (outer[2] >= inner[2]) & (outer[3] >= inner[3])


def inside(x: Column, y: Column, b) -> Column:
    return x.between(b[0], b[2]) & y.between(b[1], b[3])


def crosses(a, b) -> Column:
    """Whether the insides meet: boxes that touch do not."""
    return (a[0] < b[2]) & (b[0] < a[2]) & (a[1] < b[3]) & (b[1] < a[3])


def hull(a, b):
    return F.least(a[0], b[0]), F.least(a[1], b[1]), F.greatest(a[2], b[2]), F.greatest(a[3], b[3])


def centre(b) -> tuple[Column, Column]:
    return (b[0] + b[2]) / 2, (b[1] + b[3]) / 2


def gap(lo1, hi1, lo2, hi2) -> Column:
    return F.greatest(F.lit(0.0), F.greatest(lo1, lo2) - F.least(hi1, hi2))


def point_to_box(x: Column, y: Column, b) -> Column:
    return F.hypot(F.greatest(b[0] - x, F.lit(0.0), x - b[2]), F.greatest(b[1] - y, F.lit(0.0), y - b[3]))


def distance(x1, y1, x2, y2) -> Column:
    return F.hypot(x1 - x2, y1 - y2)


def affine(m, x: Column, y: Column) -> tuple[Column, Column]:
    a, b, c, d, e, f = m
    return a * x + c * y + e, b * x + d * y + f


def affine_box(m, b):
    """The hull of the four corners' images."""
    corners = [affine(m, x, y) for x in (b[0], b[2]) for y in (b[1], b[3])]
    xs, ys = zip(*corners)
    return F.least(*xs), F.least(*ys), F.greatest(*xs), F.greatest(*ys)


def to_unit(b, width: Column, height: Column):
    """Box over canvas, null if the canvas is unknown or the box leaves it."""
    out = b[0] / width, b[1] / height, b[2] / width, b[3] / height
    good = (width > 0) & (height > 0) & valid(out, unit=True)
    return tuple(F.when(good, c) for c in out)


def page_coverage(b, width: Column, height: Column) -> tuple[Column, Column]:
    """Share of the page that a box covers, and whether it is the full page."""
    x1, y1 = F.greatest(b[0], F.lit(0.0)), F.greatest(b[1], F.lit(0.0))
    x2, y2 = F.least(b[2], width), F.least(b[3], height)
    w, h = F.greatest(x2 - x1, F.lit(0.0)) / width, F.greatest(y2 - y1, F.lit(0.0)) / height
    edges = (x1 / width <= 0.04) & (y1 / height <= 0.04) & (1 - x2 / width <= 0.04) & (1 - y2 / height <= 0.04)
    return w * h, (w * h >= 0.9) & edges


def half_away(c: Column) -> Column:
    return F.round(c)


def polar(theta: Column, radius: Column, clockwise_from_top: bool = False) -> tuple[Column, Column]:
    """Where a label stands on the unit square around its middle."""
    if clockwise_from_top:
        return 0.5 + radius * F.sin(theta), 0.5 - radius * F.cos(theta)
    return 0.5 + radius * F.cos(theta), 0.5 + radius * F.sin(theta)


def reading_direction(dx: Column, dy: Column) -> Column:
    """The main direction of summed arrows; null if they cancel out."""
    flat = F.abs(dx) >= F.abs(dy)
    return F.when((dx == 0) & (dy == 0), F.lit(None)).when(flat & (dx > 0), "LR").when(flat, "RL").when(dy > 0, "TB").otherwise("BT")


def sharpest(points: Column) -> Column:
    """Index (from 0) of the vertex with the smallest angle of a triangle of x, y structs."""
    def at(i):
        p, q, r = points[i], points[(i + 1) % 3], points[(i + 2) % 3]
        ux, uy, vx, vy = q["x"] - p["x"], q["y"] - p["y"], r["x"] - p["x"], r["y"] - p["y"]
        size = F.sqrt((ux * ux + uy * uy) * (vx * vx + vy * vy))
        return F.struct(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (ux * vx + uy * vy) / size))).alias("angle"), F.lit(i).alias("i"))

    return F.array_min(F.array(at(0), at(1), at(2)))["i"]
