"""Typed plans over the test tables: charts, trees, networks."""

from __future__ import annotations

from pyspark.sql import functions as F


from loomgraph.plans import charts, contracts, network, ordered, trees
from loomgraph.queries._registry import query
from loomgraph.queries.agreement import FLOWS
from loomgraph.sources import corpora

PARTS_BY = "SELECT CAST(p_size AS BIGINT) AS g, p_brand AS label, CAST(regexp_extract(p_brand, '[0-9]+') AS BIGINT) AS pos, CAST(sum(p_partkey % 100) AS BIGINT) AS value FROM part GROUP BY p_size, p_brand"


def _brands(spark, sf_dir):
    p = corpora.table(spark, sf_dir, "part").select("p_size", "p_brand", "p_partkey")
    return p.groupBy(F.col("p_size").cast("long").alias("g"), F.col("p_brand").alias("label")).agg(F.sum(F.col("p_partkey") % 100).alias("value")).withColumn("pos", F.regexp_extract("label", "[0-9]+", 0).cast("long"))


@query(f"""WITH s AS ({PARTS_BY}), t AS (SELECT *, sum(value) OVER (PARTITION BY g) AS total, count(*) OVER (PARTITION BY g) AS n, sum(value) OVER (PARTITION BY g ORDER BY pos, label) - value AS before FROM s)
SELECT g, pos, label, value, CASE WHEN total > 0 THEN CAST(floor(CAST(value AS DOUBLE) * 100 / CAST(total AS DOUBLE) + 0.5) AS BIGINT) END AS percent, CASE WHEN total > 0 THEN value * 100 < total END AS hidden, CASE WHEN total > 0 THEN round(0.5 + 0.375 * sin(2 * pi() * (before + value / 2) / total), 6) END AS x, CASE WHEN total > 0 THEN round(0.5 - 0.375 * cos(2 * pi() * (before + value / 2) / total), 6) END AS y,
  total > 0 AND n <= 12 AS native, CASE WHEN total <= 0 THEN 'no total' END AS error FROM t""")
def pie_plan(spark, sf_dir):
    """Slices with whole percents, hidden ones, and where each label stands."""
    return charts.pie(_brands(spark, sf_dir)).withColumns({"x": F.round("x", 6), "y": F.round("y", 6)})


@query(FLOWS + """, s AS (SELECT node, sum(i) AS inflow, sum(o) AS outflow FROM (SELECT src AS node, 0 AS i, cents AS o FROM flows UNION ALL SELECT dst, cents, 0 FROM flows) GROUP BY node)
SELECT node, CAST(inflow AS BIGINT) AS inflow, CAST(outflow AS BIGINT) AS outflow, CAST(greatest(inflow, outflow) AS BIGINT) AS total, floor(CAST(greatest(inflow, outflow) AS DOUBLE) / 100 * 100 + 0.5) / 100 AS shown, CAST(NULL AS VARCHAR) AS error FROM s""")
def sankey_plan(spark, sf_dir):
    """Node totals of flows: the greater of what comes in and what goes out."""
    return charts.sankey(corpora.flows(spark, sf_dir).select(F.lit(1).alias("g"), "src", "dst", F.col("cents").alias("value"))).drop("g")


@query("""WITH p AS (SELECT p_size AS g, p_partkey AS id, CASE WHEN p_size % 7 = 0 THEN p_brand ELSE 'p' || p_partkey END AS label, lead(p_partkey) OVER w AS nxt, first_value(p_partkey) OVER w AS head FROM part WINDOW w AS (PARTITION BY p_size ORDER BY p_partkey)),
f AS (SELECT g, id AS src, coalesce(nxt, head) AS dst, CASE WHEN g % 5 = 0 THEN id % 20 ELSE 1 END AS value FROM p WHERE (nxt IS NOT NULL OR g % 4 = 0) AND coalesce(nxt, head) <> id),
n AS (SELECT g, count(*) AS nodes, count(DISTINCT label) AS labels FROM p GROUP BY g), v AS (SELECT g, count(*) AS flows, min(value) AS least FROM f GROUP BY g)
SELECT CAST(g AS BIGINT) AS g, CAST(nodes AS BIGINT) AS nodes, CAST(coalesce(flows, 0) AS BIGINT) AS flows, CASE WHEN nodes = 1 THEN 'node without a flow' WHEN labels < nodes THEN 'duplicate label' WHEN least <= 0 THEN 'value is not positive' WHEN g % 4 = 0 THEN 'flows lead back' END AS error FROM n LEFT JOIN v USING (g)""")
def sankey_native(spark, sf_dir):
    """Whether flows can be shown as they are: chains of parts of a size, some closed to rings."""
    from pyspark.sql import Window

    w = Window.partitionBy("g").orderBy("id")
    p = corpora.table(spark, sf_dir, "part").select(F.col("p_size").cast("long").alias("g"), F.col("p_partkey").cast("long").alias("id"), "p_brand")
    at = p.select("g", "id", F.when(F.col("g") % 7 == 0, F.col("p_brand")).otherwise(F.concat(F.lit("p"), F.col("id").cast("string"))).alias("label"), F.lead("id").over(w).alias("nxt"), F.first("id").over(w).alias("head"))
    dst = F.coalesce(F.col("nxt"), F.when(F.col("g") % 4 == 0, F.col("head")))
    flows = at.select("g", F.col("id").alias("src"), dst.alias("dst"), F.when(F.col("g") % 5 == 0, F.col("id") % 20).otherwise(1).alias("value")).filter("dst is not null and dst <> src")
    return charts.sankey_native(at.select("g", "id", "label"), flows)


@query("""WITH l AS (SELECT r_name AS region, n_name AS nation, CAST(round(c_acctbal * 100) AS BIGINT) AS cents FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)
SELECT region, nation, CAST(coalesce(sum(cents) FILTER (WHERE cents > 0), 0) AS BIGINT) AS total, CAST(count(*) FILTER (WHERE cents > 0) AS BIGINT) AS leaves, CAST(count(*) FILTER (WHERE cents <= 0) AS BIGINT) AS errors, CAST(2 - (grouping(region) + grouping(nation)) AS INTEGER) AS level FROM l GROUP BY ROLLUP (region, nation)""")
def treemap_rollup(spark, sf_dir):
    """Totals of a tree over its valid leaves, and the number of invalid ones."""
    return charts.treemap(corpora.tree_leaves(spark, sf_dir), ["region", "nation"], "cents")


@query("""WITH RECURSIVE m AS (SELECT DISTINCT event_type AS name, user_id AS member FROM events),
grown AS (SELECT name AS sets, name AS last, 1 AS k, member FROM m UNION ALL SELECT sets || '&' || m.name, m.name, k + 1, m.member FROM grown JOIN m ON m.member = grown.member AND m.name > grown.last),
s AS (SELECT sets, k, count(*) AS size FROM grown GROUP BY 1, 2)
SELECT sets, CAST(k AS INTEGER) AS k, CAST(size AS BIGINT) AS size, CAST(NULL AS VARCHAR) AS error FROM s""")
def venn_plan(spark, sf_dir):
    """Sizes of sets and of their intersections, checked against each other."""
    sizes = charts.venn(corpora.members(spark, sf_dir))
    return charts.venn_checks(sizes).select(F.array_join("sets", "&").alias("sets"), "k", "size", "error")


@query("""WITH r AS (SELECT l_shipdate AS d, CAST(extract(year FROM l_shipdate) AS BIGINT) AS g, l_returnflag AS series, CAST(extract(month FROM l_shipdate) AS BIGINT) AS pos FROM lineitem), v AS (SELECT g, series, pos, count(*) AS value FROM r GROUP BY 1, 2, 3),
s AS (SELECT g, series, count(*) AS points, count(*) FILTER (WHERE value NOT BETWEEN 10 AND 400) AS outside FROM v GROUP BY 1, 2), w AS (SELECT *, max(points) OVER (PARTITION BY g) AS most, count(*) OVER (PARTITION BY g) AS n, sum(points) OVER (PARTITION BY g) AS a FROM s),
e AS (SELECT *, CASE WHEN outside > 0 THEN 'value is out of bounds' WHEN points <> most THEN 'lengths differ' WHEN points < 2 THEN 'too few points' END AS error FROM w)
SELECT g, series, CAST(points AS BIGINT) AS points, CAST(outside AS BIGINT) AS outside, error IS NULL AND n <= 10 AND a <= 256 AS native, error FROM e""")
def xychart_plan(spark, sf_dir):
    """Series over categories: lengths, bounds, and whether the chart can be shown as it is."""
    l = corpora.table(spark, sf_dir, "lineitem").select(F.year("l_shipdate").cast("long").alias("g"), F.col("l_returnflag").alias("series"), F.month("l_shipdate").cast("long").alias("pos"))  # noqa: E741
    return charts.xychart(l.groupBy("g", "series", "pos").agg(F.count("*").alias("value")), F.lit(10), F.lit(400))


@query("""WITH p AS (SELECT p_partkey // 50 AS g, p_name AS label, CAST(p_size AS DOUBLE) / 50 AS x, CAST(p_partkey % 100 AS DOUBLE) / 90 AS y FROM part)
SELECT g, label, CASE WHEN y <= 1 AND x <= 1 THEN CAST(CASE WHEN x >= 0.5 AND y >= 0.5 THEN 1 WHEN y >= 0.5 THEN 2 WHEN x < 0.5 THEN 3 ELSE 4 END AS INTEGER) END AS quadrant, CASE WHEN y > 1 OR x > 1 THEN 'point is outside' WHEN count(*) OVER (PARTITION BY g, label) > 1 THEN 'duplicate label' END AS error FROM p""")
def quadrant_plan(spark, sf_dir):
    """Points in quadrants; those outside and labels that are taken are errors."""
    p = corpora.table(spark, sf_dir, "part")
    return charts.quadrant(p.select(F.floor(F.col("p_partkey") / 50).cast("long").alias("g"), F.col("p_name").alias("label"), (F.col("p_size").cast("double") / 50).alias("x"), ((F.col("p_partkey") % 100).cast("double") / 90).alias("y")))


@query("""WITH v AS (SELECT n_regionkey AS g, n_name AS series, c_mktsegment AS d, count(*) AS value FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2, 3), i AS (SELECT *, dense_rank() OVER (PARTITION BY g ORDER BY d) - 1 AS dim FROM v),
s AS (SELECT g, series, count(*) AS dims, max(value) AS top, max_by(value, dim) AS v, max(dim) AS dm FROM i GROUP BY 1, 2), w AS (SELECT *, max(dims) OVER (PARTITION BY g) AS need, max(top) OVER (PARTITION BY g) AS scale_max FROM s)
SELECT CAST(g AS INTEGER) AS g, series, CAST(dims AS BIGINT) AS dims, CAST(scale_max AS BIGINT) AS scale_max, CASE WHEN need < 3 THEN 'too few dimensions' WHEN dims <> need THEN 'a value is missing' END AS error,
  round(0.5 + v / scale_max * 0.5 * cos(2 * pi() * dm / need - pi() / 2), 6) AS last_x, round(0.5 + v / scale_max * 0.5 * sin(2 * pi() * dm / need - pi() / 2), 6) AS last_y FROM w""")
def radar_plan(spark, sf_dir):
    """Series over dimensions: complete or not, the scale, and where the last point is."""
    c = corpora.table(spark, sf_dir, "customer").select("c_nationkey", "c_mktsegment").groupBy("c_nationkey", "c_mktsegment").agg(F.count("*").alias("value"))
    n = corpora.table(spark, sf_dir, "nation")
    v = c.join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey")).groupBy(F.col("n_regionkey").alias("g"), F.col("n_name").alias("series"), F.col("c_mktsegment").alias("d")).agg(F.sum("value").alias("value"))
    from pyspark.sql import Window

    v = v.withColumn("dim", F.dense_rank().over(Window.partitionBy("g").orderBy("d")) - 1)
    last = F.element_at("points", -1)
    return charts.radar(v.drop("d")).select("g", "series", "dims", "scale_max", "error", F.round(last["x"], 6).alias("last_x"), F.round(last["y"], 6).alias("last_y"))


TREE = """WITH RECURSIVE t AS (SELECT 'world' AS id, CAST(NULL AS VARCHAR) AS parent, 0 AS pos, 'world' AS label UNION ALL SELECT 'r' || r_regionkey, 'world', r_regionkey, r_name FROM region
  UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, n_nationkey, n_name FROM nation UNION ALL SELECT DISTINCT 'n' || c_nationkey || c_mktsegment, 'n' || c_nationkey, ascii(c_mktsegment), c_mktsegment FROM customer UNION ALL SELECT 'lost', 'nobody', 1, 'lost'),
down AS (SELECT id, parent, label, 0 AS depth, [pos] AS trail FROM t WHERE parent IS NULL UNION ALL SELECT t.id, t.parent, t.label, d.depth + 1, list_append(d.trail, t.pos) FROM down d JOIN t ON t.parent = d.id),
o AS (SELECT *, row_number() OVER (ORDER BY trail, id) AS place FROM down)"""


def _tree(spark, sf_dir):
    text = lambda prefix, c: F.concat(F.lit(prefix), F.col(c).cast("string"))
    r = corpora.table(spark, sf_dir, "region").select(text("r", "r_regionkey").alias("id"), F.lit("world").alias("parent"), F.col("r_regionkey").alias("pos"), F.col("r_name").alias("label"))
    n = corpora.table(spark, sf_dir, "nation").select(text("n", "n_nationkey").alias("id"), text("r", "n_regionkey").alias("parent"), F.col("n_nationkey").alias("pos"), F.col("n_name").alias("label"))
    c = corpora.table(spark, sf_dir, "customer").select("c_nationkey", "c_mktsegment").distinct()
    c = c.select(F.concat(text("n", "c_nationkey"), "c_mktsegment").alias("id"), text("n", "c_nationkey").alias("parent"), F.ascii("c_mktsegment").alias("pos"), F.col("c_mktsegment").alias("label"))
    top = spark.createDataFrame([("world", None, 0, "world"), ("lost", "nobody", 1, "lost")], "id string, parent string, pos int, label string")
    return top.unionByName(r).unionByName(n).unionByName(c).withColumn("g", F.lit(1))


@query(TREE + " SELECT t.id, t.parent, t.label, CAST(o.depth AS INTEGER) AS depth, CAST(o.place AS INTEGER) AS place, CASE WHEN o.place IS NULL THEN 'cycle or unknown parent' END AS error FROM t LEFT JOIN o USING (id)")
def hierarchy_preorder(spark, sf_dir):
    """A tree flattened in preorder; nodes that no root reaches are errors."""
    return trees.hierarchy(_tree(spark, sf_dir)).drop("g")


@query("""WITH c AS (SELECT c_mktsegment AS g, c_custkey AS id, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_custkey) AS n, lag(c_custkey) OVER (PARTITION BY c_mktsegment ORDER BY c_custkey) AS parent FROM customer)
SELECT g, CAST(id AS BIGINT) AS id, CAST(CASE WHEN n <= 64 THEN n - 1 END AS INTEGER) AS depth, CAST(CASE WHEN n <= 64 THEN n END AS INTEGER) AS place,
  CASE WHEN n = 65 THEN 'too deep' WHEN n > 65 THEN 'not reached or below a node that is too deep' END AS error FROM c""")
def hierarchy_depth(spark, sf_dir):
    """Chains: a tree has at most 64 levels, and what is below is an error."""
    from pyspark.sql import Window

    c = corpora.table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("g"), F.col("c_custkey").cast("long").alias("id"))
    parent = F.lag("id").over(Window.partitionBy("g").orderBy("id"))
    return trees.hierarchy(c.withColumns({"parent": parent, "pos": F.lit(0), "label": F.lit("x")})).select("g", "id", "depth", "place", "error")


@query(TREE + " SELECT 'mindmap' || chr(10) || string_agg(repeat('  ', CAST(depth + 1 AS BIGINT)) || label, chr(10) ORDER BY place) AS code FROM o")
def mindmap_code(spark, sf_dir):
    """The code of a mind map."""
    return trees.mindmap(_tree(spark, sf_dir).filter("id <> 'lost'")).select("code")


NET = """WITH n AS (SELECT p_partkey // 20 AS g, CAST(p_partkey % 20 AS INTEGER) AS pos, p_brand || CASE WHEN p_partkey % 2 = 0 THEN '' ELSE '-x' || p_size END AS id, p_name AS label, CASE WHEN p_size % 10 = 0 THEN 'oval' ELSE 'state' END AS role FROM part),
b AS (SELECT *, trim(regexp_replace(id, '[^A-Za-z0-9_]', '_', 'g'), '_') AS base FROM n), q AS (SELECT *, row_number() OVER (PARTITION BY g, base ORDER BY pos, id) AS turn, count(*) OVER (PARTITION BY g, id) AS same FROM b)"""


def _net(spark, sf_dir):
    p = corpora.table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_name", "p_size")
    i = F.col("p_partkey")
    return p.select(F.floor(i / 20).cast("long").alias("g"), F.lit("nodes").alias("record"), (i % 20).cast("int").alias("pos"), F.concat(F.col("p_brand"), F.when(i % 2 == 0, "").otherwise(F.concat(F.lit("-x"), F.col("p_size").cast("string")))).alias("id"), F.col("p_name").alias("label"), F.when(F.col("p_size") % 10 == 0, "oval").otherwise("state").alias("role"))


@query(NET + " SELECT g, pos, id, CASE WHEN turn = 1 THEN base ELSE base || '_' || turn END AS emitted, CASE WHEN same > 1 THEN 'duplicate id' WHEN role = 'oval' THEN 'unknown role' END AS error FROM q")
def state_nodes(spark, sf_dir):
    """States: emitted ids, duplicates, unknown kinds."""
    return network.nodes(network.KINDS["state"], _net(spark, sf_dir)).select("g", "pos", "id", "emitted", "error")


def _net_edges(spark, sf_dir):
    p = corpora.table(spark, sf_dir, "part").select("p_partkey", "p_size")
    i, s = F.col("p_partkey"), F.col("p_size")
    return p.select(F.floor(i / 20).cast("long").alias("g"), (i % 20).cast("int").alias("pos"), F.concat(F.lit("d"), (i % 6).cast("string")).alias("source"), F.concat(F.lit("d"), (s % 7).cast("string")).alias("target"), F.when(s % 3 == 0, F.lit("uses")).alias("label"), F.lit(None).cast("string").alias("token"))


LINEAGE = """WITH n AS (SELECT DISTINCT p_partkey // 20 AS g, 'd' || p_partkey % 6 AS id FROM part), e AS (SELECT p_partkey // 20 AS g, CAST(p_partkey % 20 AS INTEGER) AS pos, 'd' || p_partkey % 6 AS source, 'd' || p_size % 7 AS target FROM part),
j AS (SELECT e.*, EXISTS (SELECT 1 FROM n WHERE n.g = e.g AND n.id = e.target) AS known, count(*) OVER (PARTITION BY g, source, target) AS n FROM e)"""


def _lineage(spark, sf_dir):
    kind = network.KINDS["data_lineage"]
    e = _net_edges(spark, sf_dir)
    n = e.groupBy("g", F.col("source").alias("id")).agg(F.min("pos").alias("pos")).select("g", F.lit("datasets").alias("record"), "pos", "id", F.upper("id").alias("label"), F.lit(None).cast("string").alias("role"))
    planned = network.nodes(kind, n)
    return kind, planned, network.edges(kind, e, planned)


@query(LINEAGE + " SELECT g, pos, source, target, CASE WHEN NOT known THEN 'unknown target' WHEN source = target THEN 'relation to itself' WHEN n > 1 THEN 'duplicate relation' END AS error FROM j")
def data_lineage_plan(spark, sf_dir):
    """Relations between datasets and processes: known ends, no loops, no repeats."""
    _, _, related = _lineage(spark, sf_dir)
    return related.select("g", "pos", "source", "target", "error")


@query(LINEAGE + """, ok AS (SELECT * FROM j WHERE known AND source <> target AND n = 1), nn AS (SELECT g, id, min(pos) AS pos FROM (SELECT p_partkey // 20 AS g, CAST(p_partkey % 20 AS INTEGER) AS pos, 'd' || p_partkey % 6 AS id FROM part) GROUP BY 1, 2)
SELECT g, 'flowchart LR' || chr(10) || (SELECT string_agg('  ' || id || '["' || upper(id) || '"]', chr(10) ORDER BY pos) FROM nn WHERE nn.g = o.g) || coalesce(chr(10) || string_agg('  ' || source || ' --> ' || target, chr(10) ORDER BY o.pos), '') AS code
FROM (SELECT DISTINCT n.g, ok.pos, ok.source, ok.target FROM n LEFT JOIN ok ON ok.g = n.g) o GROUP BY g""")
def lineage_code(spark, sf_dir):
    """The code of lineage diagrams, of relations without errors."""
    kind, planned, related = _lineage(spark, sf_dir)
    return network.lines(kind, planned, related.filter("error is null").withColumn("label", F.lit(None).cast("string")))


@query("""SELECT p_partkey // 50 AS g, p_partkey AS id, CAST((row_number() OVER (PARTITION BY p_partkey // 50 ORDER BY p_partkey) - 1) // 4 AS INTEGER) AS row, CAST((row_number() OVER (PARTITION BY p_partkey // 50 ORDER BY p_partkey) - 1) % 4 AS INTEGER) AS "column" FROM part""")
def block_grid(spark, sf_dir):
    """Blocks in a grid of four columns."""
    p = corpora.table(spark, sf_dir, "part").select(F.floor(F.col("p_partkey") / 50).cast("long").alias("g"), F.col("p_partkey").alias("id"), F.col("p_partkey").alias("pos"))
    return network.block_grid(p, 4)


@query("""WITH m AS (SELECT p_partkey // 100 AS g, p_brand AS grp, 'm' || p_size % 40 AS member FROM part), k AS (SELECT *, (SELECT count(DISTINCT grp) FROM m x WHERE x.g = m.g AND x.member = m.member) AS many FROM m)
SELECT g, grp AS "group", CAST(count(*) AS BIGINT) AS members, CASE WHEN bool_or(CAST(substr(member, 2) AS INTEGER) >= 35) THEN 'unknown member' WHEN bool_or(many > 1) THEN 'member of two groups' END AS error FROM k GROUP BY 1, 2""")
def group_members(spark, sf_dir):
    """Groups whose members are known and in no other group."""
    p = corpora.table(spark, sf_dir, "part")
    m = p.select(F.floor(F.col("p_partkey") / 100).cast("long").alias("g"), F.col("p_brand").alias("group"), F.concat(F.lit("m"), (F.col("p_size") % 40).cast("string")).alias("member"))
    known = m.filter("cast(substr(member, 2) as int) < 35").select("g", F.col("member").alias("id")).distinct()
    return network.groups(m, known)


@query("""SELECT conv_id AS g, role AS period, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY min(turn)) AS INTEGER) AS place, CAST(count(*) AS BIGINT) AS events FROM conversations GROUP BY 1, 2""")
def timeline_plan(spark, sf_dir):
    """Periods in the order in which they come up, with their events."""
    c = corpora.table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("g"), F.col("turn").alias("pos"), F.col("role").alias("period"), F.col("turn").alias("event"))
    return ordered.timeline(c).select("g", "period", "place", F.size("events").cast("long").alias("events"))


@query("""SELECT user_id AS g, event_type AS section, CAST(count(*) AS BIGINT) AS tasks, round(avg(CASE WHEN event_id % 8 BETWEEN 1 AND 5 THEN event_id % 8 END), 9) AS mean, CAST(count(DISTINCT event_id % 3) AS INTEGER) AS actors, CAST(count(*) FILTER (WHERE event_id % 8 NOT BETWEEN 1 AND 5) AS BIGINT) AS errors FROM events GROUP BY 1, 2""")
def journey_plan(spark, sf_dir):
    """Sections with scored tasks; scores outside of 1 to 5 are errors."""
    e = corpora.table(spark, sf_dir, "events").select(F.col("user_id").alias("g"), F.col("event_type").alias("section"), (F.col("event_id") % 8).alias("score"), (F.col("event_id") % 3).alias("actor"))
    return ordered.journey(e).withColumn("actors", F.size("actors"))


@query("""SELECT c_nationkey AS g, CAST(count(*) AS BIGINT) AS n, bool_and(abs(x - (lo + (hi - lo) / (n1 - 1) * (rn - 1))) <= 1e-9) AND max(hi) > min(lo) AS uniform FROM (
  SELECT c_nationkey, x, row_number() OVER w AS rn, count(*) OVER (PARTITION BY c_nationkey) AS n1, min(x) OVER (PARTITION BY c_nationkey) AS lo, max(x) OVER (PARTITION BY c_nationkey) AS hi FROM (SELECT DISTINCT c_nationkey, CAST(c_custkey % (3 + c_nationkey % 2 * 40) AS DOUBLE) AS x FROM customer) WINDOW w AS (PARTITION BY c_nationkey ORDER BY x)) GROUP BY 1""")
def uniform_grid(spark, sf_dir):
    """Whether values go up by one step."""
    c = corpora.table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("g"), (F.col("c_custkey") % (3 + F.col("c_nationkey") % 2 * 40)).cast("double").alias("x")).distinct().withColumn("pos", F.col("x"))
    n = c.groupBy("g").agg(F.count("*").alias("n"))
    return n.join(charts.uniform_grid(c), "g")


@query("""WITH r AS (SELECT p_partkey // 25 AS g, p_partkey AS id, CAST((p_partkey % 25) % 5 * 20 AS DOUBLE) AS x1, CAST((p_partkey % 25) // 5 * 20 AS DOUBLE) AS y1, p_brand AS expected, p_size FROM part)
SELECT g, CASE WHEN bool_or(p_size = 50 OR p_size = 49) THEN 'unavailable' WHEN bool_and(p_size <> 7) THEN 'exact' ELSE 'mismatch' END AS state FROM r GROUP BY g""")
def record_binding(spark, sf_dir):
    """Whether the texts in each record's box are what the record says."""
    p = corpora.table(spark, sf_dir, "part").select("p_partkey", "p_size", "p_brand")
    i, s = F.col("p_partkey"), F.col("p_size")
    x, y = (((i % 25) % 5) * 20).cast("double"), (F.floor((i % 25) / 5) * 20).cast("double")
    g = F.floor(i / 25).cast("long")
    records = p.select(g.alias("g"), i.alias("id"), x.alias("x1"), y.alias("y1"), (x + 20).alias("x2"), (y + 20).alias("y2"), F.col("p_brand").alias("expected"))
    own = p.filter("p_size <> 50").select(g.alias("g"), i.cast("string").alias("eid"), (x + 2).alias("x1"), (y + 2).alias("y1"), (x + 8).alias("x2"), (y + 8).alias("y2"), F.when(s == 7, F.lit("other")).otherwise(F.col("p_brand")).alias("text"), s.alias("s"))
    # some evidence is left out, so its record owns nothing
    return charts.record_binding(records, own.filter("s <> 49").drop("s"))


@query("""WITH d AS (SELECT p_partkey // 20 AS g, p_brand AS label, min(p_partkey) AS first_at FROM part GROUP BY 1, 2), f AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY first_at) AS rn FROM d)
SELECT g, max(CASE WHEN rn = 1 THEN label END) AS title, string_agg(label, ', ' ORDER BY rn) FILTER (WHERE rn <= 5) || '.' AS description FROM f GROUP BY g""")
def accessible_text(spark, sf_dir):
    """A title and description from the first distinct labels."""
    p = corpora.table(spark, sf_dir, "part").select(F.floor(F.col("p_partkey") / 20).cast("long").alias("g"), F.lit("nodes").alias("record"), F.col("p_partkey").alias("pos"), F.col("p_brand").alias("label"))
    none = p.select("g", F.lit(None).cast("string").alias("first"), F.lit(None).cast("string").alias("last")).limit(0)
    return network.accessible(p, none)




@query("""WITH j AS (SELECT p_partkey AS id, CASE p_partkey % 5 WHEN 0 THEN 'flowchart' WHEN 1 THEN 'sequence' WHEN 2 THEN 'mindmap' WHEN 3 THEN 'gitgraph' ELSE 'poem' END AS kind FROM part)
SELECT id, CASE kind WHEN 'poem' THEN 'no contract' WHEN 'flowchart' THEN CASE WHEN id % 3 = 0 THEN 'nodes: not a list' END WHEN 'sequence' THEN 'messages: missing' WHEN 'mindmap' THEN CASE WHEN id % 3 = 1 THEN 'not an object' END WHEN 'gitgraph' THEN 'initial_branch: not a string' END AS error FROM j""")
def type_contracts(spark, sf_dir):
    """Whether a diagram's JSON has the root fields of its type, each of its kind."""
    i = F.col("p_partkey")
    kind = F.when(i % 5 == 0, "flowchart").when(i % 5 == 1, "sequence").when(i % 5 == 2, "mindmap").when(i % 5 == 3, "gitgraph").otherwise("poem")
    body = F.when(i % 5 == 0, F.when(i % 3 == 0, '{"nodes": {}}').otherwise('{"nodes": []}')).when(i % 5 == 1, '{"participants": ["a"]}').when(i % 5 == 2, F.when(i % 3 == 1, "[1").otherwise('{"root": {"label": "x"}}')).when(i % 5 == 3, '{"initial_branch": 3, "operations": []}').otherwise("{}")
    p = corpora.table(spark, sf_dir, "part").select(i.alias("id"), kind.alias("diagram_type"), body.alias("ir"))
    return contracts.check(p).select("id", "error")
