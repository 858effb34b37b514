"""Edges, arrows, paths and layout of two graphs (trade before and after a day; flows)."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomgraph.operators import bags, graph
from loomgraph.queries._registry import query
from loomgraph.sources import corpora

ARCS = """
WITH arcs AS (
  SELECT CASE WHEN o_orderdate < TIMESTAMP '1998-01-01' THEN 'ref' ELSE 'cand' END AS side, s_nationkey AS src, c_nationkey AS dst, count(*) AS n
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey JOIN customer ON o_custkey = c_custkey
  GROUP BY 1, 2, 3)"""


def _f1_sql(keys: str, extra: str = "") -> str:
    return f"""{ARCS}{extra},
  c AS (SELECT {keys}, sum(n) AS n FROM e WHERE side = 'cand' GROUP BY ALL), r AS (SELECT {keys}, sum(n) AS n FROM e WHERE side = 'ref' GROUP BY ALL),
  o AS (SELECT coalesce(sum(least(c.n, r.n)), 0) AS v FROM c JOIN r USING ({keys}))
SELECT CAST(o.v AS BIGINT) AS overlap, CAST((SELECT sum(n) FROM c) AS BIGINT) AS candidate, CAST((SELECT sum(n) FROM r) AS BIGINT) AS reference,
  round(o.v / (SELECT sum(n) FROM c), 9) AS precision, round(o.v / (SELECT sum(n) FROM r), 9) AS recall, round(2.0 * o.v / ((SELECT sum(n) FROM c) + (SELECT sum(n) FROM r)), 9) AS f1 FROM o"""


def _rounded(df):
    return df.select(*[F.round(c, 9).alias(c) if t == "double" else c for c, t in df.dtypes])


@query(_f1_sql("a, b", ", e AS (SELECT side, least(src, dst) AS a, greatest(src, dst) AS b, n FROM arcs)"))
def edge_multiset_f1(spark, sf_dir):
    """Unordered edges of two graphs as multisets: overlap, precision, recall, F1."""
    return _rounded(bags.f1_of_sides(graph.undirected(corpora.trade_arcs(spark, sf_dir), "side"), ["a", "b"]))


@query(_f1_sql("src, dst, kind", """, e AS (
  SELECT side, src, dst, 'directed' AS kind, n FROM arcs WHERE (src + dst) % 5 NOT IN (0, 1)
  UNION ALL SELECT side, src, dst, 'directed', n FROM arcs WHERE (src + dst) % 5 = 1
  UNION ALL SELECT side, dst, src, 'directed', n FROM arcs WHERE (src + dst) % 5 = 1
  UNION ALL SELECT side, least(src, dst), greatest(src, dst), 'undirected', n FROM arcs WHERE (src + dst) % 5 = 0)"""))
def directed_edge_f1(spark, sf_dir):
    """Arcs by arrow heads: none gives an undirected pair, two give an arc each way."""
    some = corpora.trade_arcs(spark, sf_dir)
    kind = (F.col("src") + F.col("dst")) % 5
    rel = some.select("side", "n", F.col("src").alias("source_id"), F.col("dst").alias("target_id"), (kind == 1).alias("arrow_at_start"), (kind != 0).alias("arrow_at_end"))
    return _rounded(bags.f1_of_sides(graph.arcs(rel, "side", "n"), ["src", "dst", "kind"]))


@query(_f1_sql("a, b, head", ", e AS (SELECT side, least(src, dst) AS a, greatest(src, dst) AS b, dst AS head, n FROM arcs)"))
def arrow_agreement(spark, sf_dir):
    """Edges together with the end that holds the arrow."""
    some = corpora.trade_arcs(spark, sf_dir).select("side", "n", F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"), F.col("dst").alias("head"))
    return _rounded(bags.f1_of_sides(some, ["a", "b", "head"]))


@query("SELECT c_nationkey AS g, CAST(count(DISTINCT o_orderpriority) AS BIGINT) AS kinds, CAST(count(*) AS BIGINT) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1")
def set_semantics(spark, sf_dir):
    """Parallel arcs collapse in an adjacency but count in a multiset."""
    o, c = corpora.table(spark, sf_dir, "orders").select("o_custkey", "o_orderpriority"), corpora.table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    some = o.join(c, o.o_custkey == c.c_custkey).groupBy("c_nationkey", "o_orderpriority").agg(F.count("*").alias("n"))
    return some.groupBy(F.col("c_nationkey").alias("g")).agg(F.count("*").alias("kinds"), F.sum("n").alias("n"))


TREE_EDGES = """
WITH edges AS (
  SELECT DISTINCT r_name AS src, n_name AS dst FROM nation JOIN region ON n_regionkey = r_regionkey
  UNION ALL SELECT DISTINCT n_name, 'segment ' || c_mktsegment FROM customer JOIN nation ON c_nationkey = n_nationkey)"""


def _tree_edges(spark, sf_dir):
    n, r = corpora.table(spark, sf_dir, "nation"), corpora.table(spark, sf_dir, "region")
    c = corpora.table(spark, sf_dir, "customer").select("c_nationkey", "c_mktsegment").distinct()
    upper = n.join(F.broadcast(r), n.n_regionkey == r.r_regionkey).select(F.col("r_name").alias("src"), F.col("n_name").alias("dst"))
    lower = c.join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("n_name").alias("src"), F.concat(F.lit("segment "), "c_mktsegment").alias("dst"))
    return upper.unionByName(lower.distinct())


@query(TREE_EDGES + """
SELECT node, CASE WHEN node NOT IN (SELECT dst FROM edges) THEN 'root' ELSE 'terminal' END AS role
FROM (SELECT src AS node FROM edges UNION SELECT dst FROM edges) WHERE node NOT IN (SELECT dst FROM edges) OR node NOT IN (SELECT src FROM edges)""")
def roots_and_terminals(spark, sf_dir):
    """Nodes that nothing points to, and nodes that point to nothing."""
    return graph.roots_and_terminals(_tree_edges(spark, sf_dir))


FLOWS = """
WITH priced AS (SELECT r_name, c_mktsegment, o_orderpriority, CAST(round(o_totalprice * 100) AS BIGINT) AS cents
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
flows AS (SELECT src, dst, CAST(sum(cents) AS BIGINT) AS cents FROM (SELECT r_name AS src, c_mktsegment AS dst, cents FROM priced UNION ALL SELECT c_mktsegment, o_orderpriority, cents FROM priced) GROUP BY 1, 2)"""
FLOWS_REC = FLOWS.replace("WITH priced", "WITH RECURSIVE priced", 1)
WALK = """, walk AS (
  SELECT src AS node, [src] AS path FROM (SELECT DISTINCT src FROM flows WHERE src NOT IN (SELECT dst FROM flows))
  UNION ALL SELECT f.dst, list_append(w.path, f.dst) FROM walk w JOIN flows f ON w.node = f.src WHERE NOT list_contains(w.path, f.dst))"""


def _flow_graph(spark, sf_dir):
    return corpora.flows(spark, sf_dir).withColumn("g", F.lit(1))


@query(FLOWS_REC + WALK + " SELECT array_to_string(path, '>') AS path, CAST(len(path) AS INTEGER) AS nodes FROM walk WHERE node NOT IN (SELECT src FROM flows) AND len(path) >= 2")
def simple_paths(spark, sf_dir):
    """Paths from roots to terminals without a repeated node."""
    return graph.simple_paths(_flow_graph(spark, sf_dir)).select(F.array_join("path", ">").alias("path"), F.size("path").alias("nodes"))


@query(FLOWS_REC.replace("FROM (SELECT r_name AS src", ", side FROM (SELECT r_name AS src").replace("GROUP BY 1, 2", "GROUP BY 1, 2, 4").replace("SELECT r_name, c_mktsegment", "SELECT (o_orderkey % 7 < 5) AS side, r_name, c_mktsegment").replace(", cents FROM priced UNION", ", cents, side FROM priced UNION").replace("o_orderpriority, cents FROM priced)", "o_orderpriority, cents, side FROM priced)").replace("GROUP BY 1, 2, 4)", "GROUP BY src, dst, side), kept AS (SELECT * FROM flows WHERE cents % 3 <> 0)") + """, walk AS (
  SELECT side, src AS node, [src] AS path FROM (SELECT DISTINCT side, src FROM kept k WHERE NOT EXISTS (SELECT 1 FROM kept x WHERE x.side = k.side AND x.dst = k.src))
  UNION ALL SELECT w.side, f.dst, list_append(w.path, f.dst) FROM walk w JOIN kept f ON w.side = f.side AND w.node = f.src WHERE NOT list_contains(w.path, f.dst)),
  done AS (SELECT side, array_to_string(path, '>') AS p FROM walk w WHERE len(path) >= 2 AND NOT EXISTS (SELECT 1 FROM kept x WHERE x.side = w.side AND x.src = w.node)),
  t AS (SELECT count(*) FILTER (WHERE side) AS c, count(*) FILTER (WHERE NOT side) AS r, (SELECT count(*) FROM done a JOIN done b ON a.p = b.p WHERE a.side AND NOT b.side) AS o FROM done)
SELECT CAST(o AS BIGINT) AS overlap, CAST(c AS BIGINT) AS candidate, CAST(r AS BIGINT) AS reference, round(o / nullif(c, 0), 9) AS precision, round(o / nullif(r, 0), 9) AS recall, CASE WHEN r > 0 THEN round(2.0 * o / (c + r), 9) END AS f1 FROM t""")
def path_consistency(spark, sf_dir):
    """Multiset F1 of the root-to-terminal paths of two graphs."""
    o = corpora.table(spark, sf_dir, "orders").select("o_custkey", "o_orderpriority", (F.col("o_orderkey") % 7 < 5).alias("side"), corpora.cents("o_totalprice").alias("cents"))
    o = o.groupBy("side", "o_custkey", "o_orderpriority").agg(F.sum("cents").alias("cents"))
    c = corpora.table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    n = corpora.table(spark, sf_dir, "nation").join(corpora.table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "r_name")
    some = o.join(c, o.o_custkey == c.c_custkey).join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey")).groupBy("side", "r_name", "c_mktsegment", "o_orderpriority").agg(F.sum("cents").alias("cents"))
    legs = F.explode(F.array(F.struct(F.col("r_name").alias("src"), F.col("c_mktsegment").alias("dst")), F.struct(F.col("c_mktsegment").alias("src"), F.col("o_orderpriority").alias("dst"))))
    kept = some.select("side", legs.alias("leg"), "cents").groupBy("side", "leg.src", "leg.dst").agg(F.sum("cents").alias("cents")).filter("cents % 3 <> 0")
    paths = graph.simple_paths(kept.withColumnRenamed("side", "g")).select("g", F.array_join("path", ">").alias("p"))
    return _rounded(bags.f1_of_sides(bags.bag(paths.filter("p is not null"), "g", "p"), ["p"], side="g", candidate=True, reference=False))


@query(FLOWS + """, graphs AS (SELECT 'flows' AS g, src, dst FROM flows UNION ALL SELECT 'looped', src, dst FROM flows UNION ALL SELECT 'looped', min(dst), min(src) FROM flows)
SELECT g, CAST(count(DISTINCT node) AS BIGINT) AS nodes, g = 'flows' AS acyclic FROM (SELECT g, src AS node FROM graphs UNION ALL SELECT g, dst FROM graphs) GROUP BY g""")
def dag_check(spark, sf_dir):
    """Whether a graph has no cycle: the flows, and the flows with one arc turned back."""
    f = corpora.flows(spark, sf_dir).select("src", "dst")
    back = f.agg(F.min("dst").alias("src"), F.min("src").alias("dst"))
    both = f.withColumn("g", F.lit("flows")).unionByName(f.unionByName(back).withColumn("g", F.lit("looped")))
    return graph.acyclic(both)


@query("""WITH rel AS (SELECT o_orderkey % 100 AS g, c_nationkey AS src, (o_orderkey * 7 % 31) AS dst FROM orders JOIN customer ON o_custkey = c_custkey)
SELECT CAST(g AS BIGINT) AS g, CAST(count(*) AS BIGINT) AS relations, CAST(count(*) FILTER (WHERE dst NOT IN (SELECT n_nationkey FROM nation)) AS BIGINT) AS unknown, CAST(count(*) FILTER (WHERE src = dst) AS BIGINT) AS loops,
  CAST(count(*) - count(DISTINCT (src, dst)) AS BIGINT) AS repeated FROM rel GROUP BY g""")
def lineage_fk_check(spark, sf_dir):
    """Relations whose ends are unknown, loops and repeats, by graph."""
    o, c = corpora.table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), corpora.table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    rel = o.join(c, o.o_custkey == c.c_custkey).select((F.col("o_orderkey") % 100).alias("g"), F.col("c_nationkey").cast("long").alias("src"), (F.col("o_orderkey") * 7 % 31).alias("dst"))
    rel = rel.groupBy("g", "src", "dst").agg(F.count("*").alias("n"))
    known = corpora.table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("dst"), F.lit(True).alias("known"))
    at = rel.join(F.broadcast(known), "dst", "left")
    return at.groupBy("g").agg(F.sum("n").alias("relations"), F.coalesce(F.sum(F.when(F.col("known").isNull(), F.col("n"))), F.lit(0)).alias("unknown"), F.coalesce(F.sum(F.when(F.col("src") == F.col("dst"), F.col("n"))), F.lit(0)).alias("loops"), F.sum(F.col("n") - 1).alias("repeated"))


@query(ARCS + " SELECT side, CAST(src AS INTEGER) AS a, CAST(max(n) AS BIGINT) AS n, CAST(arg_max(dst, (n, -dst)) AS INTEGER) AS dst FROM arcs GROUP BY side, src")
def line_dedup(spark, sf_dir):
    """Of lines from one node, the strongest; ties go to the lower end."""
    some = corpora.trade_arcs(spark, sf_dir)
    return some.groupBy("side", F.col("src").alias("a")).agg(F.max("n").alias("n"), F.max_by("dst", F.struct("n", -F.col("dst"))).alias("dst"))


@query("""WITH d AS (SELECT CAST(l_quantity AS BIGINT) % 5 AS g, l_linenumber AS dst, l_suppkey % 10 AS src FROM lineitem), e AS (SELECT DISTINCT g, src, dst FROM d WHERE src <> dst),
deg AS (SELECT g, node, sum(i) AS i, sum(o) AS o FROM (SELECT g, src AS node, 0 AS i, 1 AS o FROM e UNION ALL SELECT g, dst, 1, 0 FROM e) GROUP BY 1, 2),
x AS (SELECT g, CASE WHEN count(*) FILTER (WHERE i = 0) = 1 THEN max(node) FILTER (WHERE i = 0) END AS f, CASE WHEN count(*) FILTER (WHERE o = 0) = 1 THEN max(node) FILTER (WHERE o = 0) END AS l FROM deg GROUP BY g)
SELECT CAST(g AS BIGINT) AS g, CAST(CASE WHEN l IS NOT NULL THEN f END AS BIGINT) AS first, CAST(CASE WHEN f IS NOT NULL THEN l END AS BIGINT) AS last FROM x""")
def unique_path_endpoints(spark, sf_dir):
    """The only start and the only end of each graph, or neither."""
    l = corpora.table(spark, sf_dir, "lineitem").select((F.col("l_quantity").cast("long") % 5).alias("g"), (F.col("l_suppkey") % 10).alias("src"), F.col("l_linenumber").cast("long").alias("dst"))  # noqa: E741
    d = graph.ends(l.filter("src <> dst"), ["g"])
    start, stop = F.col("indegree") == 0, F.col("outdegree") == 0
    one = lambda c: F.when(F.count(F.when(c, 1)) == 1, F.max(F.when(c, F.col("node"))))
    x = d.groupBy("g").agg(one(start).alias("f"), one(stop).alias("l"))
    return x.select("g", F.when(F.col("l").isNotNull(), F.col("f")).alias("first"), F.when(F.col("f").isNotNull(), F.col("l")).alias("last"))
