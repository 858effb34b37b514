"""Boxes on pages: overlaps, containment, neighbours, layout, greedy choices."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from loomgraph.functions import geom
from loomgraph.operators import regions, spatial
from loomgraph.queries._registry import query
from loomgraph.sources import corpora

B = """WITH b AS (SELECT p_partkey // 50 AS page, p_partkey AS id, CAST((p_size * 10) % 97 AS DOUBLE) AS x1, CAST(p_partkey % 89 AS DOUBLE) AS y1, CAST((p_size * 10) % 97 + 5 + p_size % 17 AS DOUBLE) AS x2, CAST(p_partkey % 89 + 5 + p_partkey % 13 AS DOUBLE) AS y2,
  CAST(p_partkey * 37 % 101 AS DOUBLE) AS score, p_brand AS text, p_size FROM part),
p AS (SELECT p_partkey // 50 AS page, p_partkey AS pid, CAST(p_partkey * 7 % 100 AS DOUBLE) AS x, CAST(p_partkey * 11 % 100 AS DOUBLE) AS y, p_brand AS text FROM part)"""
INTER = "(greatest(0, least(a.x2, b.x2) - greatest(a.x1, b.x1)) * greatest(0, least(a.y2, b.y2) - greatest(a.y1, b.y1)))"
IOU = f"({INTER} / ((a.x2 - a.x1) * (a.y2 - a.y1) + (b.x2 - b.x1) * (b.y2 - b.y1) - {INTER}))"


@query(B + f" SELECT a.page, a.id AS a, b.id AS b, round({IOU}, 9) AS iou FROM b a JOIN b ON a.page = b.page AND a.id < b.id WHERE {IOU} >= 0.2")
def iou_pairs(spark, sf_dir):
    """Boxes of a page whose overlap over union is at least 0.2."""
    return spatial.iou_pairs(corpora.boxes(spark, sf_dir), 0.2).withColumn("iou", F.round("iou", 9))


@query(B + " SELECT p.page, p.pid, b.id FROM p JOIN b ON p.page = b.page AND x BETWEEN x1 AND x2 AND y BETWEEN y1 AND y2 WHERE p.text = b.text OR p.pid % 3 = 0")
def point_in_box(spark, sf_dir):
    """Text centres inside boxes, kept where the texts agree (or the text is not to be compared)."""
    boxes = corpora.boxes(spark, sf_dir)
    at = spatial.points_in_boxes(corpora.points(spark, sf_dir), boxes)
    return at.join(boxes.select("id", F.col("text").alias("theirs")), "id").filter((F.col("text") == F.col("theirs")) | (F.col("pid") % 3 == 0)).select("page", "pid", "id")


@query(B + ", m AS (SELECT pid, min(id) AS id, count(*) AS n FROM p JOIN b ON p.page = b.page AND x BETWEEN x1 AND x2 AND y BETWEEN y1 AND y2 GROUP BY pid) SELECT m.id, string_agg(p.text, ' ' ORDER BY p.y, p.x, p.text) AS label, CAST(count(*) AS BIGINT) AS spans FROM m JOIN p USING (pid) WHERE n = 1 GROUP BY m.id")
def unique_containment(spark, sf_dir):
    """Texts that lie in one box alone, joined in reading order into its label."""
    at = spatial.points_in_boxes(corpora.points(spark, sf_dir), corpora.boxes(spark, sf_dir))
    one = at.groupBy("pid").agg(F.min("id").alias("id"), F.count("*").alias("n"), F.first("y").alias("y"), F.first("x").alias("x"), F.first("text").alias("text")).filter("n = 1")
    spans = F.array_sort(F.collect_list(F.struct("y", "x", "text")))
    return one.groupBy("id").agg(F.array_join(F.transform(spans, lambda s: s["text"]), " ").alias("label"), F.count("*").alias("spans"))


@query(B + """, d AS (SELECT pid, id, sqrt(pow(greatest(x1 - x, 0, x - x2), 2) + pow(greatest(y1 - y, 0, y - y2), 2)) AS d FROM p JOIN b ON p.page = b.page),
r AS (SELECT *, row_number() OVER (PARTITION BY pid ORDER BY d, id) AS rn, lead(d) OVER (PARTITION BY pid ORDER BY d, id) AS nxt FROM d WHERE d <= 6), w AS (SELECT * FROM r WHERE rn = 1)
SELECT p.pid, CASE WHEN nxt IS NULL OR nxt - d > 1e-6 THEN w.id END AS id, CASE WHEN nxt IS NULL OR nxt - d > 1e-6 THEN round(d, 9) END AS distance FROM p LEFT JOIN w USING (pid)""")
def nearest_endpoint(spark, sf_dir):
    """The box nearest to a line's end; null if it is too far or two are as near."""
    return spatial.nearest(corpora.points(spark, sf_dir), corpora.boxes(spark, sf_dir), 6.0).withColumn("distance", F.round("distance", 9))


@query(B + " SELECT a.page, CAST(count(*) AS BIGINT) AS violations FROM b a JOIN b ON a.page = b.page AND a.id < b.id AND a.x1 < b.x2 AND b.x1 < a.x2 AND a.y1 < b.y2 AND b.y1 < a.y2 GROUP BY a.page")
def box_overlap_violations(spark, sf_dir):
    """Pairs of record boxes of a page that overlap; touching is no overlap."""
    b = corpora.boxes(spark, sf_dir).select("page", "id", "x1", "y1", "x2", "y2")
    pairs = spatial.box_pairs(b, b, 32.0, (F.col("a_id") < F.col("b_id")) & geom.crosses(geom.box("a_"), geom.box("b_")))
    return pairs.groupBy("page").agg(F.count("*").alias("violations"))


@query(B + """, c AS (SELECT id, greatest(x1, 2) AS u1, greatest(y1, 2) AS v1, least(x2 * 2, 100) AS u2, least(y2 * 2, 100) AS v2 FROM b)
SELECT id, round(greatest(u2 - u1, 0) / 100 * (greatest(v2 - v1, 0) / 100), 9) AS coverage, greatest(u2 - u1, 0) / 100 * (greatest(v2 - v1, 0) / 100) >= 0.25 AND u1 <= 4 AND v1 <= 4 AS large FROM c""")
def full_page_coverage(spark, sf_dir):
    """Share of the page that a clipped box covers."""
    b = corpora.boxes(spark, sf_dir)
    page = F.lit(100.0)
    box = F.greatest("x1", F.lit(2.0)), F.greatest("y1", F.lit(2.0)), F.col("x2") * 2, F.col("y2") * 2
    share, _ = geom.page_coverage(box, page, page)
    return b.select("id", F.round(share, 9).alias("coverage"), ((share >= 0.25) & (box[0] <= 4) & (box[1] <= 4)).alias("large"))


@query(B + """, g AS (SELECT id, page, x1, y1, x2, y2, x1 + (id % 3 - 1) * 2 * (id % 7) AS u1, y1 + (id % 5 - 2) * (id % 11) AS v1 FROM b),
q AS (SELECT a.page, a.id AS a, b.id AS b, a.x1 - b.x1 AS dx, a.y1 - b.y1 AS dy, a.u1 - b.u1 AS du, a.v1 - b.v1 AS dv FROM g a JOIN g b ON a.page = b.page AND a.id < b.id),
s AS (SELECT page, CASE WHEN abs(dx) > 3 THEN CASE WHEN abs(du) <= 3 THEN 0 ELSE CAST(sign(dx) = sign(du) AS INTEGER) END END AS h, CASE WHEN abs(dy) > 3 THEN CASE WHEN abs(dv) <= 3 THEN 0 ELSE CAST(sign(dy) = sign(dv) AS INTEGER) END END AS v FROM q)
SELECT page, CAST(count(h) + count(v) AS BIGINT) AS axes, round((coalesce(sum(h), 0) + coalesce(sum(v), 0)) / nullif(count(h) + count(v), 0), 9) AS similarity FROM s GROUP BY page""")
def layout_similarity(spark, sf_dir):
    """Whether pairs of aligned nodes keep their order on each axis on which they stand apart (3 % of 100)."""
    b = corpora.boxes(spark, sf_dir)
    i = F.col("id")
    g = b.select("page", "id", "x1", "y1", (F.col("x1") + (i % 3 - 1) * 2 * (i % 7)).alias("u1"), (F.col("y1") + (i % 5 - 2) * (i % 11)).alias("v1"))
    a, o = g.select("page", *[F.col(c).alias(f"a_{c}") for c in g.columns[1:]]), g.select("page", *[F.col(c).alias(f"b_{c}") for c in g.columns[1:]])
    q = a.join(o, "page").filter("a_id < b_id")

    def axis(s, t):
        d, e = F.col(f"a_{s}") - F.col(f"b_{s}"), F.col(f"a_{t}") - F.col(f"b_{t}")
        return F.when(F.abs(d) > 3, F.when(F.abs(e) <= 3, 0).otherwise((F.signum(d) == F.signum(e)).cast("int")))

    s = q.select("page", axis("x1", "u1").alias("h"), axis("y1", "v1").alias("v"))
    n, hits = F.count("h") + F.count("v"), F.coalesce(F.sum("h"), F.lit(0)) + F.coalesce(F.sum("v"), F.lit(0))
    return s.groupBy("page").agg(n.alias("axes"), F.round(hits / F.nullif(n, F.lit(0)), 9).alias("similarity"))


@query(B + """, f AS (SELECT *, text AS caption, id % 4 = 0 AS goes_on, list_filter([CASE WHEN y1 <= 4 THEN 'top' END, CASE WHEN y2 >= 88 THEN 'bottom' END, CASE WHEN x1 <= 4 THEN 'left' END], lambda x: x IS NOT NULL) AS touches FROM b),
q AS (SELECT a.id AS a, b.id AS b, a.page = b.page AS same_page,
  a.page = b.page AND ((greatest(0, greatest(a.x1, b.x1) - least(a.x2, b.x2)) <= 4 AND least(a.y2, b.y2) - greatest(a.y1, b.y1) > 0) OR (greatest(0, greatest(a.y1, b.y1) - least(a.y2, b.y2)) <= 4 AND least(a.x2, b.x2) - greatest(a.x1, b.x1) > 0)) AS adjacent,
  CASE WHEN a.page = b.page THEN list_has_any(a.touches, b.touches) ELSE list_contains(a.touches, 'bottom') AND list_contains(b.touches, 'top') END AS touch, a.caption = b.caption AS cap, b.goes_on AS cont
  FROM f a JOIN f b ON (a.page = b.page AND a.id < b.id) OR b.page = a.page + 1)
SELECT a, b, same_page, CAST(round(least(0.98, 0.34 + 0.24 * CAST(adjacent AS INTEGER) + 0.18 * CAST(touch AS INTEGER) + 0.14 * CAST(cap AS INTEGER) + 0.16 * CAST(cont AS INTEGER)), 6) AS DOUBLE) AS score FROM q
WHERE (adjacent OR (NOT same_page AND touch)) AND (cap OR cont OR (same_page AND touch))""")
def fragment_merges(spark, sf_dir):
    """Fragments of a page or of two in a row that may be one, with the score of their signals."""
    b = corpora.boxes(spark, sf_dir)
    edges = F.array_compact(F.array(F.when(F.col("y1") <= 4, F.lit("top")), F.when(F.col("y2") >= 88, F.lit("bottom")), F.when(F.col("x1") <= 4, F.lit("left"))))
    f = b.select("page", "id", "x1", "y1", "x2", "y2", F.col("text").alias("caption"), (F.col("id") % 4 == 0).alias("continued"), edges.alias("touches"), F.lit(100.0).alias("page_w"), F.lit(100.0).alias("page_h"))
    return spatial.fragment_pairs(f)


@query(B + " SELECT page, id, CAST(rn AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY page ORDER BY (x2 - x1) * (y2 - y1) DESC, id) AS rn FROM b) WHERE rn <= 8")
def largest_boxes(spark, sf_dir):
    """The eight largest boxes of each page."""
    b = spatial.largest(corpora.boxes(spark, sf_dir), 8)
    w = Window.partitionBy("page").orderBy(F.desc(geom.area(geom.box())), "id")
    return b.select("page", "id", F.row_number().over(w).alias("rank"))


@query(B + """ SELECT id, x1 * 2 + y1 * -1 + 3 AS tx, x1 * 1 + y1 * 2 - 5 AS ty, CAST(CASE WHEN x2 <= 100 AND y2 <= 100 THEN round(x1 / 100, 9) END AS DOUBLE) AS ux, CAST(CASE WHEN abs(x1 - 50) >= abs(y1 - 40) THEN CASE WHEN x1 > 50 THEN 'LR' WHEN x1 < 50 THEN 'RL' WHEN y1 = 40 THEN NULL ELSE 'RL' END WHEN y1 > 40 THEN 'TB' ELSE 'BT' END AS VARCHAR) AS direction,
  round(sqrt(pow(x1 - 10, 2) + pow(y1 - 20, 2)), 9) AS far FROM b""")
def geometry_functions(spark, sf_dir):
    """Affine images, unit boxes, reading direction, distance."""
    b = corpora.boxes(spark, sf_dir)
    tx, ty = geom.affine([F.lit(float(v)) for v in (2, 1, -1, 2, 3, -5)], F.col("x1"), F.col("y1"))
    unit = geom.to_unit(geom.box(), F.lit(100.0), F.lit(100.0))
    return b.select("id", tx.alias("tx"), ty.alias("ty"), F.round(unit[0], 9).alias("ux"), geom.reading_direction(F.col("x1") - 50, F.col("y1") - 40).alias("direction"), F.round(geom.distance(F.col("x1"), F.col("y1"), F.lit(10.0), F.lit(20.0)), 9).alias("far"))


def _greedy(bound: str, most: str = "") -> str:
    """SQL of a greedy choice: a page's boxes in order, one a step, against the list of those that are kept."""
    w, h = "greatest(0, least(s.x2, o.x2) - greatest(s.x1, o.x1))", "greatest(0, least(s.y2, o.y2) - greatest(s.y1, o.y1))"
    whole = f"((s.x2 - s.x1) * (s.y2 - s.y1) + (o.x2 - o.x1) * (o.y2 - o.y1) - {w} * {h})"
    return B.replace("WITH", "WITH RECURSIVE", 1) + f""", o AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY score DESC, (x2 - x1) * (y2 - y1) DESC, id) AS rn FROM b),
f AS (SELECT DISTINCT page, CAST(0 AS BIGINT) AS k, CAST([] AS STRUCT(id BIGINT, x1 DOUBLE, y1 DOUBLE, x2 DOUBLE, y2 DOUBLE)[]) AS kept FROM b
  UNION ALL SELECT f.page, k + 1, CASE WHEN {most} len(list_filter(kept, lambda s: {w} * {h} / {whole} > {bound})) > 0 THEN kept ELSE list_append(kept, {{'id': o.id, 'x1': o.x1, 'y1': o.y1, 'x2': o.x2, 'y2': o.y2}}) END FROM f JOIN o ON o.page = f.page AND o.rn = f.k + 1),
e AS (SELECT page, arg_max(kept, k) AS kept FROM f GROUP BY page), chosen AS (SELECT page, unnest(list_transform(kept, lambda s: s.id)) AS id FROM e)"""


REGIONS = _greedy("0.35", "len(kept) >= 8 OR")


@query(REGIONS + " SELECT page, id FROM chosen")
def nms_regions(spark, sf_dir):
    """Regions kept by descending confidence and area where none overlaps a kept one by over 0.35; at most 8 a page."""
    return spatial.greedy_keep(corpora.boxes(spark, sf_dir), 0.35, 8).select("page", "id")


@query(_greedy("0.8") + " SELECT page, id FROM chosen")
def greedy_dedup(spark, sf_dir):
    """Contours kept greedily at an overlap below 0.8."""
    return spatial.greedy_keep(corpora.boxes(spark, sf_dir), 0.8).select("page", "id")


INTER_S = "(greatest(0, least(s.x2, o.x2) - greatest(s.x1, o.x1)) * greatest(0, least(s.y2, o.y2) - greatest(s.y1, o.y1)))"


@query(B.replace("WITH", "WITH RECURSIVE", 1) + f""", o AS (SELECT *, CAST(id % 40 AS VARCHAR) AS key, row_number() OVER (PARTITION BY page ORDER BY id % 5 DESC, id) AS rn FROM b),
f AS (SELECT DISTINCT page, CAST(0 AS BIGINT) AS k, CAST([] AS STRUCT(x1 DOUBLE, y1 DOUBLE, x2 DOUBLE, y2 DOUBLE)[]) AS heads, CAST([] AS STRUCT(id BIGINT, key VARCHAR, c INTEGER)[]) AS seen FROM b
  UNION ALL SELECT page, k + 1, CASE WHEN spot IS NULL THEN list_append(heads, {{'x1': x1, 'y1': y1, 'x2': x2, 'y2': y2}}) ELSE heads END, list_append(seen, {{'id': id, 'key': key, 'c': coalesce(spot, CAST(len(heads) AS INTEGER))}})
  FROM (SELECT *, CASE WHEN own IS NOT NULL THEN own WHEN list_max(iou) >= 0.45 THEN CAST(list_position(iou, list_max(iou)) - 1 AS INTEGER) END AS spot
    FROM (SELECT f.page, k, heads, seen, o.id, o.key, o.x1, o.y1, o.x2, o.y2, list_filter(seen, lambda s: s.key = o.key)[1].c AS own,
      list_transform(heads, lambda s: {INTER_S} / ((s.x2 - s.x1) * (s.y2 - s.y1) + (o.x2 - o.x1) * (o.y2 - o.y1) - {INTER_S})) AS iou FROM f JOIN o ON o.page = f.page AND o.rn = f.k + 1))),
e AS (SELECT page, unnest(arg_max(seen, k)) AS s FROM f GROUP BY page)
SELECT page, s.id AS id, s.c AS cluster FROM e""")
def element_clusters(spark, sf_dir):
    """Elements of several observations in clusters: same key, else best overlap of at least 0.45."""
    b = corpora.boxes(spark, sf_dir)
    return spatial.greedy_clusters(b.withColumns({"key": (F.col("id") % 40).cast("string"), "rank": (F.col("id") % 5).cast("int")}))


def _close(x: str, y: str) -> str:
    short = f"least(a.{y}2 - a.{y}1, b.{y}2 - b.{y}1)"
    return f"(greatest(a.{x}1, b.{x}1) - least(a.{x}2, b.{x}2) <= 2 AND least(a.{y}2, b.{y}2) - greatest(a.{y}1, b.{y}1) >= 0.22 * {short} AND {short} > 0)"


@query(B.replace("WITH", "WITH RECURSIVE", 1) + f""", e AS (SELECT a.page, a.id AS a, b.id AS b FROM b a JOIN b ON a.page = b.page AND a.id <> b.id
  WHERE ((a.x1 <= b.x1 AND a.y1 <= b.y1 AND a.x2 >= b.x2 AND a.y2 >= b.y2) OR (a.x1 >= b.x1 AND a.y1 >= b.y1 AND a.x2 <= b.x2 AND a.y2 <= b.y2) OR {_close("x", "y")} OR {_close("y", "x")})
  AND (greatest(a.x2, b.x2) - least(a.x1, b.x1)) * (greatest(a.y2, b.y2) - least(a.y1, b.y1)) <= 7200),
r AS (SELECT page, id, id AS other FROM b UNION SELECT r.page, r.id, e.b FROM r JOIN e ON e.a = r.other)
SELECT page, id, min(other) AS component FROM r GROUP BY 1, 2""")
def box_components(spark, sf_dir):
    """Boxes chained by containment or closeness."""
    return spatial.box_components(corpora.boxes(spark, sf_dir), 2.0, most_area=0.72 * 100 * 100)


@query(B + """, l AS (SELECT DISTINCT s.page, s.id AS source_id, t.id AS target_id, p.pid % 3 AS head FROM p JOIN b s ON p.page = s.page AND p.x BETWEEN s.x1 AND s.x2 AND p.y BETWEEN s.y1 AND s.y2 JOIN b t ON t.page = p.page AND p.y BETWEEN t.x1 AND t.x2 AND p.x BETWEEN t.y1 AND t.y2 WHERE s.id <> t.id)
SELECT DISTINCT page, CASE WHEN head = 1 THEN target_id ELSE source_id END AS source_id, CASE WHEN head = 1 THEN source_id ELSE target_id END AS target_id, head <> 0 AS arrow FROM l""")
def lines_to_relations(spark, sf_dir):
    """Lines whose ends lie in two different boxes; one with an arrow at its start alone is turned round."""
    p, b = corpora.points(spark, sf_dir), corpora.boxes(spark, sf_dir)
    s = spatial.points_in_boxes(p.select("page", "pid", "x", "y"), b).select("page", "pid", F.col("id").alias("s"))
    t = spatial.points_in_boxes(p.select("page", "pid", F.col("y").alias("x"), F.col("x").alias("y")), b).select("page", "pid", F.col("id").alias("t"))
    at = s.join(t, ["page", "pid"]).filter("s <> t").withColumn("head", F.col("pid") % 3)
    turn = F.col("head") == 1
    return at.select("page", F.when(turn, F.col("t")).otherwise(F.col("s")).alias("source_id"), F.when(turn, F.col("s")).otherwise(F.col("t")).alias("target_id"), (F.col("head") != 0).alias("arrow")).distinct()


ASSESS = "CASE WHEN e BETWEEN 0.006 AND 0.24 AND ink <= 0.26 AND NOT (dev > 67 AND ink > 0.13) AND r >= 0.42 AND c >= 0.28 AND greatest(w / h, h / w) <= 10 THEN CAST(round(least(0.92, 0.5 + CASE WHEN e <= 0.12 THEN 0.11 ELSE 0.04 END + CASE WHEN ink <= 0.12 THEN 0.08 ELSE 0.02 END + least(0.10, 0.025 * (n - 1)) + CASE WHEN greatest(w / h, h / w) <= 4 THEN 0.08 ELSE 0.02 END), 4) AS DOUBLE) END"


@query(B + f""", q AS (SELECT id, x2 - x1 AS w, y2 - y1 AS h, CAST(id % 30 AS DOUBLE) / 100 AS e, CAST(id % 29 AS DOUBLE) / 100 AS ink, CAST(id % 80 AS DOUBLE) AS dev, CAST(id % 7 + 3 AS DOUBLE) / 10 AS r, CAST(id % 5 + 2 AS DOUBLE) / 10 AS c, id % 6 + 1 AS n FROM b)
SELECT id, w * h >= 16 AND w >= 4 AND h >= 4 AND NOT (h < 6 AND w > 8 * h) AS counts, {ASSESS} AS sure FROM q""")
def region_assessment(spark, sf_dir):
    """Which components count on a page, and how sure a region is a diagram."""
    i = F.col("id")
    share = lambda m, add, by: ((i % m + add).cast("double") / by)
    b = corpora.boxes(spark, sf_dir)
    w, h = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    sure = regions.assess(w, h, share(30, 0, 100), share(29, 0, 100), (i % 80).cast("double"), share(7, 3, 10), share(5, 2, 10), i % 6 + 1)
    return b.select("id", regions.of_a_page(geom.box(), F.lit(100.0), F.lit(100.0)).alias("counts"), sure.alias("sure"))


@query(B + f" SELECT a.page, a.id FROM b a WHERE a.id % 2 = 0 AND NOT EXISTS (SELECT 1 FROM b WHERE b.page = a.page AND b.id % 10 = 1 AND {INTER} / ((a.x2 - a.x1) * (a.y2 - a.y1)) > 0.01)")
def unoccupied_regions(spark, sf_dir):
    """Regions that no known block takes up."""
    b = corpora.boxes(spark, sf_dir)
    return regions.unoccupied(b.filter("id % 2 = 0"), b.filter("id % 10 = 1")).select("page", "id")


@query(B + f", k AS (SELECT a.page, a.id, b.id AS contour, {IOU} AS v FROM b a JOIN b ON a.page = b.page WHERE a.id % 2 = 0 AND b.id % 2 = 1 AND {IOU} >= 0.2) SELECT page, id, arg_max(contour, (v, -contour)) AS contour FROM k GROUP BY 1, 2")
def contour_authority(spark, sf_dir):
    """The contour that covers a node best."""
    b = corpora.boxes(spark, sf_dir)
    return regions.covered(b.filter("id % 2 = 0"), b.filter("id % 2 = 1"), 0.2)


@query(B + """, m AS (SELECT page, id AS mid, x1 AS x, y1 AS y FROM b WHERE id % 3 = 0), d AS (SELECT pid, mid, sqrt(pow(p.x - m.x, 2) + pow(p.y - m.y, 2)) AS d FROM p JOIN m USING (page)),
r AS (SELECT *, row_number() OVER (PARTITION BY pid ORDER BY d, mid) AS rn, lead(d) OVER (PARTITION BY pid ORDER BY d, mid) AS nxt FROM d WHERE d <= 9)
SELECT p.pid, CASE WHEN nxt IS NULL OR nxt - d > 1e-6 THEN mid END AS mid FROM p LEFT JOIN (SELECT * FROM r WHERE rn = 1) USING (pid)""")
def nearest_arrowhead(spark, sf_dir):
    """The arrow head at a line's end; null if it is too far or two are as near."""
    b = corpora.boxes(spark, sf_dir).filter("id % 3 = 0").select("page", F.col("id").alias("mid"), F.col("x1").alias("x"), F.col("y1").alias("y"))
    return regions.nearest_point(corpora.points(spark, sf_dir), b, 9.0).select("pid", "mid")


@query(REGIONS + " SELECT page, id, 'page-diagram-' || lpad(CAST(row_number() OVER (PARTITION BY page ORDER BY y1, x1, score DESC, x2, y2) AS VARCHAR), 3, '0') AS region_id FROM b SEMI JOIN chosen USING (page, id)")
def page_regions(spark, sf_dir):
    """Regions that stay after overlaps are resolved, named in reading order."""
    return regions.choose(corpora.boxes(spark, sf_dir)).select("page", "id", "region_id")
