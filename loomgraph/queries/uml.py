"""Class, entity and requirement diagrams over the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomgraph.plans import uml
from loomgraph.queries._registry import query
from loomgraph.sources import corpora

RECORDS = "WITH n AS (SELECT n_regionkey AS g, n_nationkey AS pos, 'n' || n_nationkey AS id, n_name AS label FROM nation), p AS (SELECT DISTINCT n_regionkey AS g, n_nationkey AS pos, c_mktsegment AS name FROM customer JOIN nation ON c_nationkey = n_nationkey),"
CODE = """, w AS (SELECT g, 1 AS a, pos AS b, line, error FROM r UNION ALL SELECT g, 2, pos, line, error FROM k)
SELECT CAST(g AS INTEGER) AS g, CASE WHEN min(error) IS NULL THEN '{header}' || chr(10) || string_agg(line, chr(10) ORDER BY a, b) END AS code, min(error) AS error FROM w GROUP BY g"""


def _nations(spark, sf_dir):
    n = corpora.table(spark, sf_dir, "nation")
    records = n.select(F.col("n_regionkey").alias("g"), F.col("n_nationkey").alias("pos"), F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("id"), F.col("n_name").alias("label"))
    c = corpora.table(spark, sf_dir, "customer").select("c_nationkey", "c_mktsegment").distinct()
    parts = c.join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("n_regionkey").alias("g"), F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("id"), F.col("n_nationkey").alias("nation"), F.col("c_mktsegment").alias("name"))
    # each but the first five leads to the one five before, which another region may have
    ways = n.filter("n_nationkey >= 5").select(F.col("n_regionkey").alias("g"), F.col("n_nationkey").alias("pos"), F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("source"), F.concat(F.lit("n"), (F.col("n_nationkey") - 5).cast("string")).alias("target"))
    return records, parts, ways


@query(RECORDS + """ m AS (SELECT g, pos, string_agg('        ' || CASE WHEN length(name) % 2 = 0 THEN '+long ' || name ELSE '#' || name || '(int a) long$' END, chr(10) ORDER BY name) AS lines FROM p GROUP BY 1, 2),
r AS (SELECT n.g, n.pos, '    class ' || id || '["' || label || '"]' || coalesce(' {' || chr(10) || lines || chr(10) || '    }', '') AS line, CAST(NULL AS VARCHAR) AS error FROM n LEFT JOIN m USING (g, pos)),
k AS (SELECT n.g, n.pos, '    ' || CASE n.pos % 3 WHEN 0 THEN t.id || ' "1" <|-- ' || n.id WHEN 1 THEN n.id || ' --> "1" ' || t.id || ' : to' ELSE n.id || ' *-- "1" ' || t.id END AS line, CASE WHEN t.id IS NULL THEN 'unknown target' END AS error FROM n LEFT JOIN n t ON t.g = n.g AND t.pos = n.pos - 5 WHERE n.pos >= 5)""" + CODE.format(header="classDiagram"))
def class_code(spark, sf_dir):
    """Regions as class diagrams of their nations."""
    records, parts, ways = _nations(spark, sf_dir)
    even = F.length("name") % 2 == 0
    none = F.lit(None).cast("string")
    members = parts.select("g", "id", F.col("name").alias("pos"), F.when(even, "field").otherwise("method").alias("kind"), "name", F.lit("long").alias("type"), F.when(~even, "int a").alias("parameters"), F.when(even, "+").otherwise("#").alias("visibility"), F.when(~even, "static").alias("classifier"))
    i = F.col("pos") % 3
    relations = ways.select("g", "pos", "source", "target", F.when(i == 0, "inheritance").when(i == 1, "link").otherwise("composition").alias("type"), F.when(i == 1, "to").alias("label"), none.alias("source_cardinality"), F.lit("1").alias("target_cardinality"))
    return uml.classes(records, members, relations)


@query(RECORDS + """ m AS (SELECT g, pos, string_agg('        text ' || name || CASE WHEN length(name) % 2 = 0 THEN ' PK,FK' ELSE ' "some"' END, chr(10) ORDER BY name) AS lines FROM p GROUP BY 1, 2),
r AS (SELECT n.g, n.pos, '    ' || id || '["' || label || '"]' || coalesce(' {' || chr(10) || lines || chr(10) || '    }', '') AS line, CAST(NULL AS VARCHAR) AS error FROM n LEFT JOIN m USING (g, pos)),
k AS (SELECT n.g, n.pos, '    ' || n.id || ' ' || CASE n.pos % 3 WHEN 0 THEN '||--o{' WHEN 1 THEN 'o|..|{' ELSE '}o--||' END || ' ' || t.id || ' : "to"' AS line, CASE WHEN t.id IS NULL THEN 'unknown target' END AS error FROM n LEFT JOIN n t ON t.g = n.g AND t.pos = n.pos - 5 WHERE n.pos >= 5)""" + CODE.format(header="erDiagram"))
def entity_code(spark, sf_dir):
    """Regions as entity diagrams of their nations."""
    records, parts, ways = _nations(spark, sf_dir)
    even = F.length("name") % 2 == 0
    attributes = parts.select("g", "id", F.col("name").alias("pos"), F.lit("text").alias("type"), "name", F.when(even, F.array(F.lit("PK"), F.lit("FK"))).alias("keys"), F.when(~even, "some").alias("comment"))
    i = F.col("pos") % 3
    pick = lambda a, b, c: F.when(i == 0, a).when(i == 1, b).otherwise(c)
    relations = ways.select("g", "pos", "source", "target", pick("one", "zero_or_one", "zero_or_more").alias("source_cardinality"), pick("zero_or_more", "one_or_more", "one").alias("target_cardinality"), (i != 1).alias("identifying"), F.lit("to").alias("label"))
    return uml.entities(records, attributes, relations)


@query(RECORDS + """ r AS (SELECT g, pos, CASE WHEN pos % 2 = 0 THEN CASE pos % 4 WHEN 0 THEN 'functionalRequirement ' ELSE 'designConstraint ' END || id || ' {' || chr(10) || 'id: "' || id || '"' || chr(10) || 'text: "' || label || '"' || chr(10) || 'risk: high' || chr(10) || 'verifyMethod: analysis' || chr(10) || '}'
  ELSE 'element ' || id || ' {' || chr(10) || 'type: "' || label || '"' || chr(10) || 'docref: "' || id || '"' || chr(10) || '}' END AS line, CASE WHEN pos = 4 THEN 'unknown risk' END AS error FROM n),
k AS (SELECT n.g, n.pos, n.id || ' - ' || CASE n.pos % 3 WHEN 0 THEN 'traces' ELSE 'verifies' END || ' -> ' || t.id AS line, CASE WHEN t.id IS NULL THEN 'unknown target' END AS error FROM n LEFT JOIN n t ON t.g = n.g AND t.pos = n.pos - 5 WHERE n.pos >= 5), w AS (SELECT g, CASE WHEN pos % 2 = 0 THEN 1 ELSE 2 END AS a, pos AS b, line, error FROM r UNION ALL SELECT g, 3, pos, line, error FROM k)
SELECT CAST(g AS INTEGER) AS g, CASE WHEN min(error) IS NULL THEN 'requirementDiagram' || chr(10) || 'direction TB' || chr(10) || string_agg(line, chr(10) ORDER BY a, b) END AS code, min(error) AS error FROM w GROUP BY g""")
def requirement_code(spark, sf_dir):
    """Regions as requirement diagrams: even nations are requirements, odd ones elements."""
    records, _, ways = _nations(spark, sf_dir)
    even, i, none = F.col("pos") % 2 == 0, F.col("pos"), F.lit(None).cast("string")
    asked = records.filter(even).select("g", "pos", "id", F.when(i % 4 == 0, "functional").otherwise("design_constraint").alias("type"), F.col("label").alias("text"), F.when(i == 4, "none").otherwise("HIGH").alias("risk"), none.alias("method"))
    things = records.filter(~even).select("g", "pos", "id", F.col("label").alias("type"), none.alias("docref"))
    return uml.requirements(asked, things, ways.select("g", "pos", "source", "target", F.when(i % 3 == 0, none).otherwise("verifies").alias("type")))
