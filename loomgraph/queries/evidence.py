"""Fusion, repair, style and text scans over the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomgraph.functions import numeric, text
from loomgraph.operators import evidence, fusion, repair
from loomgraph.plans import network
from loomgraph.queries._registry import query
from loomgraph.sources import corpora, manifest

SRC = ("vector", "geometry", "ocr", "vlm", "other")
L = """WITH l AS (SELECT l_orderkey % 200 AS g, l_partkey % 30 AS a0, l_suppkey % 30 AS b0, l_linenumber AS ln, CASE l_suppkey % 5 WHEN 0 THEN 'vector' WHEN 1 THEN 'geometry' WHEN 2 THEN 'ocr' WHEN 3 THEN 'vlm' ELSE 'other' END AS source, CAST(l_quantity AS BIGINT) AS q, l_partkey AS p, l_suppkey AS s, l_orderkey AS o, l_extendedprice AS x FROM lineitem)"""
GEO = "CASE source WHEN 'vector' THEN 5 WHEN 'geometry' THEN 4 WHEN 'other' THEN 3 WHEN 'vlm' THEN 2 ELSE 1 END"
SEM = "CASE source WHEN 'vlm' THEN 5 WHEN 'other' THEN 4 WHEN 'vector' THEN 3 WHEN 'geometry' THEN 2 ELSE 1 END"


def _lines(spark, sf_dir):
    l = corpora.table(spark, sf_dir, "lineitem")  # noqa: E741
    src = F.element_at(F.array(*map(F.lit, SRC)), (F.col("l_suppkey") % 5 + 1).cast("int"))
    return l.select((F.col("l_orderkey") % 200).alias("g"), (F.col("l_partkey") % 30).alias("a0"), (F.col("l_suppkey") % 30).alias("b0"), F.col("l_linenumber").alias("ln"), src.alias("source"), F.col("l_quantity").cast("long").alias("q"), F.col("l_partkey").alias("p"), F.col("l_suppkey").alias("s"), F.col("l_orderkey").alias("o"), F.col("l_extendedprice").alias("x"))


@query(L + f"""SELECT g, a0 AS cluster, arg_max(CAST(q AS DOUBLE), ({GEO}, o, (p * 1000 + ln) * 100 + q)) AS x1, arg_max(ln, ({SEM}, o, (p * 1000 + ln) * 100 + q)) FILTER (WHERE ln <> 3) AS role, CAST(max(q) AS BIGINT) AS confidence, CAST(count(*) AS BIGINT) AS seen FROM (SELECT DISTINCT g, a0, source, o, p, ln, q FROM l) GROUP BY 1, 2""".replace("SELECT g, a0 AS cluster", " SELECT g, a0 AS cluster"))
def fused_elements(spark, sf_dir):
    """Each cluster's box from the source best believed about positions, its role from that about meaning."""
    r = _lines(spark, sf_dir).select("g", "a0", "source", "o", "p", "ln", "q").distinct()
    rows = r.select("g", F.col("a0").alias("cluster"), "source", F.col("o").alias("owner"), ((F.col("p") * 1000 + F.col("ln")) * 100 + F.col("q")).alias("id"), *[F.col("q").cast("double").alias(c) for c in ("x1", "y1", "x2", "y2")], F.when(F.col("ln") != 3, F.col("ln").cast("string")).alias("role"), F.col("q").alias("confidence"), F.array(F.col("p").cast("string")).alias("evidence"))
    return fusion.fuse_elements(rows, ["g"]).select("g", "cluster", "x1", F.col("role").cast("int").alias("role"), "confidence", "seen")


@query(L + f""", r AS (SELECT g, least(a0, b0) AS a, greatest(a0, b0) AS b, a0, b0, CASE WHEN ln % 3 = 0 THEN '' ELSE 'r' || ln % 2 END AS lab0, {SEM} AS rank, q, o, p * 1000 + s AS id, x FROM l),
n AS (SELECT g, a, b, count(DISTINCT lab0) AS k, max(lab0) AS one_label FROM r WHERE lab0 <> '' GROUP BY 1, 2, 3), j AS (SELECT r.*, CASE WHEN lab0 = '' AND k = 1 THEN one_label ELSE lab0 END AS lab FROM r LEFT JOIN n USING (g, a, b)),
m AS (SELECT g, a, b, lab, arg_max(a0, (rank, q, o, id)) AS source_id, arg_max(b0, (rank, q, o, id)) AS target_id, count(DISTINCT a0) AS d FROM j GROUP BY 1, 2, 3, 4)
SELECT g, a, b, nullif(lab, '') AS label, source_id, target_id, (d > 1 OR count(*) OVER (PARTITION BY g, a, b) > 1) AND a <> b AS conflict FROM m""")
def fused_relations(spark, sf_dir):
    """Relations of one pair with labels that fit are one; directions that differ are a conflict."""
    r = _lines(spark, sf_dir)
    rows = r.select("g", "source", F.col("o").alias("owner"), (F.col("p") * 1000 + F.col("s")).alias("id"), F.col("a0").alias("source_id"), F.col("b0").alias("target_id"), F.when(F.col("ln") % 3 != 0, F.concat(F.lit("r"), (F.col("ln") % 2).cast("string"))).alias("label"), F.col("q").alias("confidence"))
    return fusion.fuse_relations(rows, ["g"]).select("g", "a", "b", "label", "source_id", "target_id", "conflict")


@query(L + f""", w AS (SELECT g, o, source, ln AS t, q, CASE source WHEN 'vector' THEN 100 WHEN 'geometry' THEN 90 WHEN 'ocr' THEN 50 WHEN 'vlm' THEN 100 ELSE 75 END AS w FROM l), mass AS (SELECT g, sum(w) AS mass FROM (SELECT DISTINCT g, o, source, w FROM w) GROUP BY g),
s AS (SELECT g, t, CAST(sum(q * w) AS DOUBLE) / 100 AS s FROM w GROUP BY 1, 2)
SELECT g, CAST(t AS VARCHAR) AS diagram_type, round(s / (CAST(mass AS DOUBLE) / 100), 6) AS score FROM s JOIN mass USING (g)""")
def fused_types(spark, sf_dir):
    """Predictions of types by the weight of all who were asked."""
    r = _lines(spark, sf_dir)
    rows = r.select("g", F.col("o").alias("owner"), "source", F.col("ln").cast("string").alias("diagram_type"), F.col("q").cast("double").alias("score"))
    return fusion.fuse_types(rows, ["g"]).select("g", "diagram_type", F.round("score", 6).alias("score"))


@query("""WITH d AS (SELECT doc_id, chr(65279) || '```diagram' || chr(10) || 'flowchart LR' || CASE WHEN doc_id % 2 = 0 THEN chr(13) ELSE '' END || chr(10) || '  a["' || source || CASE WHEN doc_id % 3 = 0 THEN '"' ELSE '' END || ']' || chr(10) || '```' AS code, source FROM documents)
SELECT doc_id, 'flowchart LR' || chr(10) || '  a["' || source || '"]' || chr(10) AS cleaned, true AS stable, CAST(3 + CAST(doc_id % 2 = 0 AS INTEGER) + CAST(doc_id % 3 <> 0 AS INTEGER) AS INTEGER) AS events FROM d""")
def code_repair(spark, sf_dir):
    """Code without byte-order mark and fence, with closed quotes; a second pass changes nothing."""
    i = F.col("doc_id")
    code = F.concat(F.lit("﻿```diagram\nflowchart LR"), F.when(i % 2 == 0, "\r").otherwise(""), F.lit('\n  a["'), F.col("source"), F.when(i % 3 == 0, '"').otherwise(""), F.lit("]\n```"))
    d = corpora.table(spark, sf_dir, "documents").select("doc_id", code.alias("code"))
    cleaned = repair.clean_code(F.col("code"))
    return d.select("doc_id", cleaned.alias("cleaned"), (repair.clean_code(cleaned) == cleaned).alias("stable"), F.size(repair.code_events(F.col("code"))).alias("events"))


@query(L + """, r AS (SELECT g, least(a0, b0) AS a, greatest(a0, b0) AS b, count(*) AS nr, min(a0) AS lo, max(a0) AS hi FROM l WHERE ln = 1 GROUP BY 1, 2, 3), e AS (SELECT g, least(a0, b0) AS a, greatest(a0, b0) AS b, count(*) AS ne, max(a0) AS es FROM l WHERE ln = 2 AND q >= 30 AND p % 3 = s % 3 GROUP BY 1, 2, 3)
SELECT e.g, e.a, e.b, es AS source_id, CASE WHEN nr IS NULL THEN 'add' ELSE 'reverse' END AS action FROM e LEFT JOIN r USING (g, a, b) WHERE ne = 1 AND (nr IS NULL OR (nr = 1 AND hi <> es))""")
def edge_repair(spark, sf_dir):
    """Edges to add or to turn round where one trusted connector says so."""
    r = _lines(spark, sf_dir)
    rel = r.filter("ln = 1").select("g", F.col("a0").alias("source_id"), F.col("b0").alias("target_id"))
    ev = r.filter("ln = 2").select("g", F.col("a0").alias("source_id"), F.col("b0").alias("target_id"), (F.col("q") / 50).alias("score"), (F.col("p") % 3).alias("line_block"), (F.col("s") % 3).alias("arrow_block"))
    return repair.trusted_edges(rel, ev, ["g"])


@query("""WITH s AS (SELECT p_partkey AS id, p_brand || ' ' || p_partkey % 300 AS label, p_partkey % 700 AS ev FROM part WHERE p_partkey % 2 = 0), t AS (SELECT CASE WHEN p_partkey % 5 = 0 THEN p_partkey - 1 ELSE p_partkey END AS id, p_brand || ' ' || p_partkey % 300 AS label, p_partkey % 650 AS ev FROM part WHERE p_partkey % 2 = 1),
same AS (SELECT s.id AS source_id, t.id AS target_id FROM s JOIN t ON s.id = t.id), s1 AS (SELECT * FROM s WHERE id NOT IN (SELECT source_id FROM same)), t1 AS (SELECT * FROM t WHERE id NOT IN (SELECT target_id FROM same)),
sh0 AS (SELECT DISTINCT s1.id AS source_id, t1.id AS target_id FROM s1 JOIN t1 ON s1.ev = t1.ev), sh AS (SELECT * FROM sh0 WHERE source_id IN (SELECT source_id FROM sh0 GROUP BY 1 HAVING count(*) = 1)),
s2 AS (SELECT * FROM s1 WHERE id NOT IN (SELECT source_id FROM sh)), t2 AS (SELECT * FROM t1 WHERE id NOT IN (SELECT target_id FROM sh)),
nm AS (SELECT a.id AS source_id, b.id AS target_id FROM (SELECT lower(replace(label, '#', ' ')) AS k, max(id) AS id FROM s2 GROUP BY 1 HAVING count(*) = 1) a JOIN (SELECT lower(replace(label, '#', ' ')) AS k, max(id) AS id FROM t2 GROUP BY 1 HAVING count(*) = 1) b USING (k)),
u AS (SELECT * FROM same UNION ALL SELECT * FROM sh UNION ALL SELECT * FROM nm)
SELECT source_id, target_id FROM u WHERE target_id IN (SELECT target_id FROM u GROUP BY 1 HAVING count(*) = 1)""")
def style_mapping(spark, sf_dir):
    """Styles go from source to target by id, by shared evidence, by unique label; clashes get none."""
    p = corpora.table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    i = F.col("p_partkey")
    label = F.concat_ws(" ", "p_brand", (i % 300).cast("string")).alias("label")
    s = p.filter("p_partkey % 2 = 0").select(F.lit(1).alias("g"), i.alias("id"), label, F.array(i % 700).alias("evidence"))
    t = p.filter("p_partkey % 2 = 1").select(F.lit(1).alias("g"), F.when(i % 5 == 0, i - 1).otherwise(i).alias("id"), label, F.array(i % 650).alias("evidence"))
    return repair.style_pairs(s, t, ["g"]).select("source_id", "target_id")


@query("""WITH m AS (SELECT p_partkey // 10 AS g, p_partkey AS old, CASE WHEN p_size > 45 THEN 1 ELSE p_partkey + 100000 END AS new FROM part), good AS (SELECT g FROM m GROUP BY g HAVING count(*) = count(DISTINCT old) AND count(*) = count(DISTINCT new))
SELECT m.g, old AS id, CASE WHEN g IN (SELECT g FROM good) THEN new ELSE old END AS renamed FROM m""")
def id_harmonisation(spark, sf_dir):
    """Ids are rewritten in a scene only if its mapping is one to one."""
    i = F.col("p_partkey")
    p = corpora.table(spark, sf_dir, "part").select(F.floor(i / 10).cast("long").alias("g"), i.alias("id"), F.when(F.col("p_size") > 45, F.lit(1)).otherwise(i + 100000).alias("new"))
    return fusion.harmonise_ids(p.select("g", "id", F.col("id").alias("renamed")), p.select("g", F.col("id").alias("old"), "new"), ["g"], ["renamed"])


@query("""WITH c AS (SELECT conv_id, turn, CASE turn % 5 WHEN 0 THEN 'connect n' || conv_id || ' to n' || turn WHEN 1 THEN 'Delete node n' || turn WHEN 2 THEN 'rename n' || turn || ' to ' || role WHEN 3 THEN '노드 n' || turn || ' 삭제' ELSE 'please do something' END AS txt, role FROM conversations)
SELECT conv_id, turn, CASE turn % 5 WHEN 0 THEN 'add_edge' WHEN 1 THEN 'delete_node' WHEN 2 THEN 'relabel' WHEN 3 THEN 'delete_node' END AS op, CASE turn % 5 WHEN 0 THEN 'n' || conv_id WHEN 4 THEN NULL ELSE 'n' || turn END AS a, CASE WHEN turn % 5 = 0 THEN 'n' || turn END AS b, CASE WHEN turn % 5 = 2 THEN role END AS label FROM c""")
def command_parse(spark, sf_dir):
    """Editing sentences in two languages."""
    t, n, v = F.col("turn"), F.concat(F.lit("n"), F.col("turn").cast("string")), F.concat(F.lit("n"), F.col("conv_id").cast("string"))
    txt = F.when(t % 5 == 0, F.concat(F.lit("connect "), v, F.lit(" to "), n)).when(t % 5 == 1, F.concat(F.lit("Delete  node "), n)).when(t % 5 == 2, F.concat(F.lit("rename "), n, F.lit(" to "), "role")).when(t % 5 == 3, F.concat(F.lit("노드 "), n, F.lit(" 삭제"))).otherwise("please do something")
    return corpora.table(spark, sf_dir, "conversations").select("conv_id", "turn", text.command(txt).alias("c")).select("conv_id", "turn", "c.*")


@query("""SELECT p_partkey AS id, CASE p_partkey % 4 WHEN 0 THEN p_name WHEN 1 THEN p_brand WHEN 2 THEN p_type ELSE '' END AS label, CASE p_partkey % 3 WHEN 0 THEN 'flowchart' WHEN 1 THEN 'gitgraph' END AS grammar FROM part""")
def code_scan(spark, sf_dir):
    """The label of a line of code, and the grammar that its first word names."""
    i = F.col("p_partkey")
    line = F.when(i % 4 == 0, F.concat(F.lit('  a["'), "p_name", F.lit('"]'))).when(i % 4 == 1, F.concat(F.lit("  b["), "p_brand", F.lit("]"))).when(i % 4 == 2, F.concat(F.lit("  c : "), "p_type")).otherwise("  d --> e")
    head = F.when(i % 3 == 0, "graph TD").when(i % 3 == 1, "gitGraph").otherwise("no grammar")
    return corpora.table(spark, sf_dir, "part").select(i.alias("id"), F.array_join(text.code_labels(line), "|").alias("label"), text.grammar(head).alias("grammar"))


@query(r"""SELECT page_id, CAST(page_id % 2 AS INTEGER) + 1 AS texts, trim(regexp_extract(html, '<title>([^<]*)</title>', 1)) AS first FROM pages""")
def svg_text(spark, sf_dir):
    """Painted text of an SVG: hidden text and definitions do not count."""
    title = F.regexp_extract("html", "<title>([^<]*)</title>", 1)
    shown = F.concat(F.lit("<svg><defs><text>no</text></defs><title>no</title><text x='1'><tspan>"), title, F.lit("</tspan></text><text display=\"none\">no</text><text style='opacity:0;'>no</text>"), F.when(F.col("page_id") % 2 == 1, "<text>more</text>").otherwise(""), F.lit("</svg>"))
    p = manifest.painted_text(corpora.table(spark, sf_dir, "pages").select("page_id", shown.alias("svg")))
    return p.select("page_id", F.size("texts").alias("texts"), F.element_at("texts", 1).alias("first"))


KIND = "CASE event_id % 8 WHEN 0 THEN 'user_edit' WHEN 1 THEN 'arrowhead' WHEN 2 THEN 'line_segment' WHEN 3 THEN 'contour' WHEN 4 THEN 'vector_text' WHEN 5 THEN 'source_crop' WHEN 6 THEN 'ocr_token' ELSE 'vlm_observation' END"


def _evidence(spark, sf_dir):
    kinds = ["user_edit", "arrowhead", "line_segment", "contour", "vector_text", "source_crop", "ocr_token", "vlm_observation"]
    i = F.col("event_id")
    kind = F.element_at(F.array(*map(F.lit, kinds)), (i % 8 + 1).cast("int"))
    trust = F.when(i % 11 == 0, "connector").when(i % 13 == 0, "label")
    return corpora.table(spark, sf_dir, "events").select(F.col("user_id").alias("g"), i.cast("long").alias("index"), kind.alias("kind"), trust.alias("trust"), (F.round("value").cast("long") % 40 + 1).alias("size"))


@query(f"""WITH e AS (SELECT user_id AS g, event_id AS index, {KIND} AS kind, CASE WHEN event_id % 11 = 0 THEN 'connector' WHEN event_id % 13 = 0 THEN 'label' END AS trust FROM events),
r AS (
  SELECT *, CASE WHEN kind = 'user_edit' THEN 0 WHEN trust = 'connector' THEN 1 WHEN trust = 'label' THEN 2 WHEN kind = 'arrowhead' THEN 3 WHEN kind = 'line_segment' THEN 4 WHEN kind = 'contour' THEN 5
    WHEN kind = 'vector_text' THEN 6 WHEN kind = 'source_crop' THEN 7 WHEN kind = 'ocr_token' THEN 8 ELSE 9 END AS rank, row_number() OVER (PARTITION BY g, kind ORDER BY index) AS turn FROM e),
c AS (SELECT g, index FROM (SELECT *, row_number() OVER (PARTITION BY g ORDER BY rank, index) AS n FROM r WHERE rank < 2) WHERE n <= 2),
after_c AS (SELECT r.* FROM r LEFT JOIN c USING (g, index) WHERE c.index IS NULL),
room AS (SELECT g, 20 - count(c.index) AS free FROM (SELECT DISTINCT g FROM r) LEFT JOIN c USING (g) GROUP BY g),
s AS (SELECT g, index FROM (SELECT a.*, free, row_number() OVER (PARTITION BY g ORDER BY turn, CASE kind WHEN 'arrowhead' THEN 1 WHEN 'line_segment' THEN 2 WHEN 'contour' THEN 3 ELSE 4 END) AS n
  FROM after_c a JOIN room USING (g) WHERE kind IN ('arrowhead', 'line_segment', 'contour', 'vector_text')) WHERE n <= (free + 3) // 4),
taken AS (SELECT *, 'critical' AS phase FROM c UNION ALL SELECT *, 'structural' FROM s), used AS (SELECT g, count(*) AS used FROM taken GROUP BY g),
rest AS (SELECT g, index, row_number() OVER (PARTITION BY g ORDER BY rank, index) AS n FROM r LEFT JOIN taken USING (g, index) WHERE taken.phase IS NULL)
SELECT g, index, phase FROM taken UNION ALL SELECT rest.g, rest.index, 'ranked' FROM rest LEFT JOIN used USING (g) WHERE n <= 20 - coalesce(used, 0)""")
def evidence_quota(spark, sf_dir):
    """Evidence of each observation by quotas: critical, structural kinds in turns, the rest by rank."""
    return evidence.select(_evidence(spark, sf_dir), most=20, chars=1 << 40).select("g", "index", "phase")


@query()
def evidence_budget(spark, sf_dir):
    """The same within 300 characters: what does not fit is passed over, later may fit."""
    return evidence.select(_evidence(spark, sf_dir), most=20, chars=300, least=5)


@query("""WITH t AS (SELECT o_orderkey, regexp_replace(CAST(CAST(o_totalprice AS DECIMAL(20, 2)) AS VARCHAR), '\\.?0+$', '') || '000000000001' AS txt FROM orders)
SELECT o_orderkey, txt, CAST(CAST(CAST(txt AS DOUBLE) AS VARCHAR) AS DECIMAL(38, 14)) = CAST(txt AS DECIMAL(38, 14)) AS safe FROM t""")
def decimal_round_trip(spark, sf_dir):
    """Whether decimal texts are what their nearest double prints as."""
    o = corpora.table(spark, sf_dir, "orders").select("o_orderkey", F.concat(numeric.decimal_text(F.col("o_totalprice").cast("decimal(20,2)"), 2), F.lit("000000000001")).alias("txt"))
    return o.select("o_orderkey", "txt", numeric.round_trips(F.col("txt")).alias("safe"))


@query("""SELECT doc_id, replace(lower(text), 'ß', 'ss') AS folded FROM documents""")
def nfkc_fold(spark, sf_dir):
    """Compatibility-normalised, case-folded text, as a whole."""
    return corpora.table(spark, sf_dir, "documents").select("doc_id", text.nfkc_casefold(F.col("text")).alias("folded"))


@query("""SELECT CAST(p_size AS BIGINT) AS id, CAST(i AS INTEGER) AS tile, CAST(greatest(0, i * 40) AS INTEGER) AS lo, CAST(least(p_size * 10, i * 40 + 50) AS INTEGER) AS hi FROM (SELECT DISTINCT p_size FROM part), generate_series(0, 20) t(i) WHERE i = 0 OR i * 40 + 10 < p_size * 10""")
def overlapping_tiles(spark, sf_dir):
    """Tiles of 50 that overlap by 10."""
    p = corpora.table(spark, sf_dir, "part").select("p_size").distinct()
    n = F.greatest(F.lit(0), F.ceil((F.col("p_size") * 10 - 10) / 40).cast("int") - 1)
    t = p.select(F.col("p_size").cast("long").alias("id"), F.explode(F.sequence(F.lit(0), n)).alias("tile"), "p_size")
    return t.select("id", "tile", (F.col("tile") * 40).alias("lo"), F.least(F.col("p_size") * 10, F.col("tile") * 40 + 50).cast("int").alias("hi"))


@query("""SELECT conv_id AS g, CAST(turn AS INTEGER) AS pos, coalesce(CASE WHEN turn % 4 <> 1 THEN role || turn END, 'P' || turn) AS id, 'p' || row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS emitted FROM conversations""")
def sequence_participants(spark, sf_dir):
    """Participants without an id are named by their position; emitted ids are ordinals."""
    from loomgraph.plans import ordered

    c = corpora.table(spark, sf_dir, "conversations")
    t = F.col("turn")
    return ordered.participants(c.select(F.col("conv_id").alias("g"), t.cast("int").alias("pos"), F.when(t % 4 != 1, F.concat(F.col("role"), t.cast("string"))).alias("id"), F.lit(None).cast("string").alias("label"))).select("g", "pos", "id", "emitted")


@query("""SELECT p_partkey // 30 AS g, 'lane' || p_size % 4 AS lane, 'n' || p_partkey AS node, CAST(row_number() OVER (PARTITION BY p_partkey // 30 ORDER BY p_size % 4, p_partkey) AS INTEGER) AS place FROM part""")
def swimlane_order(spark, sf_dir):
    """Nodes of lanes in one running order."""
    p = corpora.table(spark, sf_dir, "part")
    lanes = p.groupBy(F.floor(F.col("p_partkey") / 30).cast("long").alias("g"), (F.col("p_size") % 4).alias("pos")).agg(F.transform(F.array_sort(F.collect_list("p_partkey")), lambda x: F.concat(F.lit("n"), x.cast("string"))).alias("nodes"))
    return network.lane_order(lanes.withColumn("lane", F.concat(F.lit("lane"), F.col("pos").cast("string"))))


