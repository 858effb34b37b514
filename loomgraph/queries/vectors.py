"""Duplicates on vector pages, the order of typed candidates, evidence that all inputs share."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomgraph.operators import fusion, vector
from loomgraph.queries._registry import query
from loomgraph.queries.boxes import B
from loomgraph.sources import corpora

SHAPES = B.replace("WITH", "WITH RECURSIVE", 1) + """, v AS (SELECT page, id * 4 + j AS id, text AS kind, CAST(p_size % 2 AS VARCHAR) AS points, x1 + CAST([0, 0, 0.04, 0.12] AS DOUBLE[])[j + 1] AS x1, y1, x2 + CAST([0, 0, 0.04, 0.12] AS DOUBLE[])[j + 1] AS x2, y2, (id * 7 + j) % 5 AS confidence,
  CASE WHEN (id + j) % 3 > 0 THEN CASE WHEN id % 2 = 0 THEN 400 ELSE 400 + 300 * (j % 2) END END AS weight FROM b, generate_series(0, 3) t(j))"""
INTER = "(greatest(0, least(s.x2, o.x2) - greatest(s.x1, o.x1)) * greatest(0, least(s.y2, o.y2) - greatest(s.y1, o.y1)))"


def _shapes(spark, sf_dir):
    """Each box four times: twice as it is, and moved a little."""
    j, i = F.col("j"), F.col("id")
    b = corpora.boxes(spark, sf_dir).join(corpora.table(spark, sf_dir, "part").select(F.col("p_partkey").cast("long").alias("id"), "p_size"), "id")
    at = b.withColumn("j", F.explode(F.array(*map(F.lit, range(4))))).withColumn("by", F.element_at(F.array(*map(F.lit, [0.0, 0.0, 0.04, 0.12])), j + 1))
    weight = F.when((i + j) % 3 > 0, F.when(i % 2 == 0, 400).otherwise(400 + 300 * (j % 2)))
    return at.select("page", (i * 4 + j).alias("id"), F.col("text").alias("kind"), (F.col("p_size") % 2).cast("string").alias("points"), (F.col("x1") + F.col("by")).alias("x1"), "y1", (F.col("x2") + F.col("by")).alias("x2"), "y2", ((i * 7 + j) % 5).alias("confidence"), weight.alias("weight"))


@query(SHAPES + f""", u AS (SELECT *, row_number() OVER (PARTITION BY page, kind, points, x1, y1, x2, y2 ORDER BY confidence DESC, id) AS n FROM v), o AS (SELECT *, row_number() OVER (PARTITION BY page, kind, points ORDER BY x1, y1, x2, y2) AS rn FROM u WHERE n = 1),
f AS (SELECT DISTINCT page, kind, points, CAST(0 AS BIGINT) AS k, CAST([] AS STRUCT(id BIGINT, x1 DOUBLE, y1 DOUBLE, x2 DOUBLE, y2 DOUBLE)[]) AS kept FROM v
  UNION ALL SELECT f.page, f.kind, f.points, k + 1, CASE WHEN len(list_filter(kept, lambda s: {INTER} / ((s.x2 - s.x1) * (s.y2 - s.y1) + (o.x2 - o.x1) * (o.y2 - o.y1) - {INTER}) >= 0.98)) > 0 THEN kept ELSE list_append(kept, {{'id': o.id, 'x1': o.x1, 'y1': o.y1, 'x2': o.x2, 'y2': o.y2}}) END
  FROM f JOIN o ON o.page = f.page AND o.kind = f.kind AND o.points = f.points AND o.rn = f.k + 1),
e AS (SELECT page, arg_max(kept, k) AS kept FROM f GROUP BY page, kind, points)
SELECT page, unnest(list_transform(kept, lambda s: s.id)) AS id FROM e""")
def primitive_dedup(spark, sf_dir):
    """Shapes that stay when equal ones and those of nearly the same place go."""
    return vector.distinct_primitives(_shapes(spark, sf_dir))


@query(SHAPES + """, w AS (SELECT *, kind AS text, count(DISTINCT coalesce(weight, -1)) OVER (PARTITION BY page, kind, x1, y1, x2, y2) AS kinds, row_number() OVER (PARTITION BY page, kind, x1, y1, x2, y2 ORDER BY confidence DESC, id) AS n FROM v)
SELECT page, text, x1, y1, x2, y2, id, CASE WHEN kinds = 1 THEN CAST(weight AS INTEGER) END AS weight FROM w WHERE n = 1""")
def vector_text_dedup(spark, sf_dir):
    """Texts once a place, with a weight only where all agree."""
    return vector.distinct_texts(_shapes(spark, sf_dir).withColumnRenamed("kind", "text"))


@query("""WITH c AS (SELECT p_size AS scene, p_partkey AS key, ['vlm', 'other', 'vector', 'geometry', 'ocr'][p_partkey % 5 + 1] AS source, p_brand AS diagram_type, p_partkey % 3 = 0 AS mapped, p_partkey % 4 AS confidence FROM part)
SELECT CAST(scene AS BIGINT) AS scene, CAST(key AS BIGINT) AS key, CAST(row_number() OVER (PARTITION BY scene ORDER BY diagram_type, mapped DESC, confidence DESC, CASE source WHEN 'vlm' THEN 5 WHEN 'other' THEN 4 WHEN 'vector' THEN 3 WHEN 'geometry' THEN 2 ELSE 1 END DESC, key) AS INTEGER) AS place FROM c""")
def typed_candidate_order(spark, sf_dir):
    """Typed candidates of a scene in the order in which they are given out."""
    p, i = corpora.table(spark, sf_dir, "part"), F.col("p_partkey")
    source = F.element_at(F.array(*map(F.lit, ["vlm", "other", "vector", "geometry", "ocr"])), (i % 5 + 1).cast("int"))
    c = p.select(F.col("p_size").cast("long").alias("scene"), i.cast("long").alias("key"), source.alias("source"), F.col("p_brand").alias("diagram_type"), (i % 3 == 0).alias("mapped"), (i % 4).alias("confidence"))
    return fusion.ordered_candidates(c, ["scene"]).select("scene", "key", "place")


@query("""WITH s AS (SELECT DISTINCT event_type AS scene, event_id % 3 AS input, user_id AS id FROM events), n AS (SELECT scene, count(DISTINCT input) AS n FROM s GROUP BY scene)
SELECT scene, CAST(id AS BIGINT) AS id FROM s JOIN n USING (scene) WHERE scene <> 'purchase' GROUP BY scene, id, n HAVING count(*) = n""")
def shared_authority(spark, sf_dir):
    """Users whom all inputs of a scene name; purchases have an input that names none."""
    e = corpora.table(spark, sf_dir, "events").select(F.col("event_type").alias("scene"), (F.col("event_id") % 3).alias("input"), F.col("user_id").cast("long").alias("id"))
    sets = e.groupBy("scene", "input").agg(F.collect_set("id").alias("ids"))
    return fusion.shared_authority(sets.withColumn("ids", F.when((F.col("scene") != "purchase") | (F.col("input") != 2), F.col("ids"))), ["scene"])
