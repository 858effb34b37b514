"""Regions of pages that may hold a diagram: which components count, how they group, how sure one is.

What a raster gives (densities, longest runs) comes in as columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.functions import geom
from loomgraph.operators import spatial


def of_a_page(b, width: Column, height: Column) -> Column:
    """Whether a component is large enough on a page, and no line of text."""
    w, h = b[2] - b[0], b[3] - b[1]
    text_line = (h < F.greatest(F.lit(6.0), height * 0.012)) & (w > 8 * h)
    return (geom.area(b) >= F.greatest(F.lit(16.0), width * height * 0.000025)) & (w >= 4) & (h >= 4) & ~text_line


def of_a_composite(b, width: Column, height: Column) -> Column:
    return geom.area(b) >= F.greatest(F.lit(4.0), width * height * 0.00008)


def unoccupied(regions: DataFrame, occupied: DataFrame, most: float = 0.01, size: float = 64.0) -> DataFrame:
    """Regions of which no more than ``most`` lies in any occupied box of the page."""
    boxes = ["page", "id", "x1", "y1", "x2", "y2"]
    a, b = geom.box("a_"), geom.box("b_")
    taken = spatial.box_pairs(regions.select(*boxes), occupied.select(*boxes), size, geom.shared(a, b) / F.nullif(geom.area(a), F.lit(0.0)) > most)
    return regions.join(taken.select("page", F.col("a_id").alias("id")).distinct(), ["page", "id"], "left_anti")


def assess(width: Column, height: Column, edges: Column, ink: Column, deviation: Column, row: Column, column: Column, parts: Column) -> Column:
    """How sure a region is a diagram; null if it is none.

    ``edges``, ``ink``: shares of edge and dark pixels; ``row``, ``column``: longest rows and columns of
    edges as shares of the sides; ``parts``: components in it.
    """
    aspect = F.greatest(width / height, height / width)
    long = (row >= 0.42) & (column >= 0.28)
    none = (width <= 0) | (height <= 0) | (aspect > 10) | ~edges.between(0.006, 0.24) | (ink > 0.26) | ((deviation > 67) & (ink > 0.13)) | ~long
    sure = 0.50 + F.when(edges <= 0.12, 0.11).otherwise(0.04) + F.when(ink <= 0.12, 0.08).otherwise(0.02) + F.least(F.lit(0.10), 0.025 * (parts - 1)) + F.when(aspect <= 4, 0.08).otherwise(0.02)
    return F.when(~none, F.round(F.least(F.lit(0.92), sure), 4))


def choose(regions: DataFrame, overlap: float = 0.35, most: int = 8) -> DataFrame:
    """The regions that stay, named in reading order.  regions: page, id, box, score."""
    from pyspark.sql import Window

    kept = spatial.greedy_keep(regions, overlap, most)
    n = F.row_number().over(Window.partitionBy("page").orderBy("y1", "x1", F.desc("score"), "x2", "y2"))
    return kept.withColumn("region_id", F.concat(F.lit("page-diagram-"), F.lpad(n.cast("string"), 3, "0")))


def nearest_point(points: DataFrame, marks: DataFrame, tolerance: float, tie: float = 1e-6) -> DataFrame:
    """pid, mid of the mark nearest to each point (an arrow head, an anchor); null if it is too far or two
    are as near.  points: page, pid, x, y; marks: page, mid, x, y."""
    boxes = marks.select("page", F.col("mid").alias("id"), F.col("x").alias("x1"), F.col("y").alias("y1"), F.col("x").alias("x2"), F.col("y").alias("y2"))
    return spatial.nearest(points, boxes, tolerance, tie).withColumnRenamed("id", "mid")


def covered(nodes: DataFrame, contours: DataFrame, least: float, size: float = 64.0) -> DataFrame:
    """page, id, contour: the contour that covers a node best, at an overlap of at least ``least``."""
    boxes = ["page", "id", "x1", "y1", "x2", "y2"]
    over = geom.iou(geom.box("a_"), geom.box("b_"))
    at = spatial.box_pairs(nodes.select(*boxes), contours.select(*boxes), size).withColumn("iou", over).filter(F.col("iou") >= least)
    return at.groupBy("page", F.col("a_id").alias("id")).agg(F.max_by("b_id", F.struct("iou", -F.col("b_id"))).alias("contour"))


def candidate_blocks(documents: DataFrame) -> DataFrame:
    """doc, page, block_id, kind, box of blocks that may be diagrams, each once.

    documents: doc, pages (array of structs page, blocks (array of structs block_id, kind, x1 .. y2)).
    """
    p = documents.select("doc", F.explode("pages").alias("p")).select("doc", "p.page", F.explode("p.blocks").alias("b"))
    return p.select("doc", "page", "b.*").filter(F.col("kind").isin("Figure", "Picture", "Diagram")).dropDuplicates(["doc", "block_id"])


def sources(*parts: tuple[str, DataFrame]) -> DataFrame:
    """Discovered sources of several kinds, each once by content: the first kind that has it stays.

    parts: kind and rows of doc, page, digest, box; earlier kinds come first.
    """
    out = None
    for rank, (kind, df) in enumerate(parts):
        one = df.select("doc", "page", "digest", "x1", "y1", "x2", "y2").withColumns({"kind": F.lit(kind), "rank": F.lit(rank)})
        out = one if out is None else out.unionByName(one)
    best = out.groupBy("doc", "digest").agg(F.min(F.struct("rank", "page", "y1", "x1", "x2", "y2", "kind")).alias("s"))
    return best.select("doc", "digest", "s.page", "s.kind", "s.x1", "s.y1", "s.x2", "s.y2")
