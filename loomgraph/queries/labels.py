"""Alignment of two sets of labelled nodes, and what is measured on the pairs."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from loomgraph.functions import text
from loomgraph.operators import align, bags, identifiers
from loomgraph.queries._registry import query
from loomgraph.sources import corpora

PARTS = """
WITH parts AS (SELECT CASE WHEN p_partkey % 2 = 0 THEN 'source' ELSE 'generated' END AS side, CAST(p_partkey // 2 AS BIGINT) AS id,
  concat_ws(' ', p_name, p_brand, p_type, CAST(p_size AS VARCHAR)) AS raw, concat_ws(' ', p_name, CAST(p_size AS VARCHAR)) AS short FROM part),
named AS (SELECT *, array_to_string(regexp_extract_all(replace(lower(raw), 'ß', 'ss'), '[\\p{L}\\p{N}_]+'), ' ') AS label FROM parts),
s AS (SELECT * FROM named WHERE side = 'source'), g AS (SELECT * FROM named WHERE side = 'generated')"""
BY = """(SELECT {k} AS k, max(id) AS id FROM {t} GROUP BY 1 HAVING count(*) = 1)"""


def _pair(left: str, right: str, key: str) -> str:
    return f"SELECT a.id AS source_id, b.id AS generated_id FROM {BY.format(k=key, t=left)} a JOIN {BY.format(k=key, t=right)} b ON a.k = b.k"


def _sides(spark, sf_dir):
    rows = corpora.labels(spark, sf_dir).withColumn("label", text.normal_label(F.col("label")))
    return rows.filter("side = 'source'"), rows.filter("side = 'generated'")


NAMED = """
WITH p AS (SELECT p_partkey % 2 AS side, p_partkey // 2 AS k FROM part),
named AS (
  SELECT side, k // 50 AS g, k AS pos,
    CASE k % 10 WHEN 0 THEN 'x' || k // 10 || ' b' WHEN 1 THEN 'x' || k // 10 || '-b' WHEN 2 THEN 'x' || k // 10 || '_b_2' ELSE 'n' || CASE WHEN side = 1 AND k % 7 = 0 THEN -k ELSE k END END AS id
  FROM p),
s AS (SELECT * FROM named WHERE side = 0), o AS (SELECT * FROM named WHERE side = 1),
t AS (
  SELECT *, row_number() OVER (PARTITION BY g, base ORDER BY pos) AS turn, count(*) OVER (PARTITION BY g, base) AS n
  FROM (SELECT *, trim(regexp_replace(id, '[^A-Za-z0-9_]', '_', 'g'), '_') AS base FROM s)),
u0 AS (SELECT g, id, base || CASE WHEN turn > 1 THEN '_' || turn ELSE '' END AS said FROM t WHERE n > 1),
u1 AS (SELECT t.g, t.id, t.base || '_2' AS said FROM t JOIN u0 ON t.g = u0.g AND t.id = u0.said WHERE t.n = 1),
u AS (SELECT * FROM u0 UNION SELECT * FROM u1)"""


def _named(spark, sf_dir):
    """Source and generated records; three ids of each ten share a portable form, the third by what the second becomes."""
    p = corpora.table(spark, sf_dir, "part").select((F.col("p_partkey") % 2).alias("side"), F.floor(F.col("p_partkey") / 2).cast("long").alias("k"))
    ten = F.concat(F.lit("x"), F.floor(F.col("k") / 10).cast("string"))
    other = F.concat(F.lit("n"), F.when((F.col("side") == 1) & (F.col("k") % 7 == 0), -F.col("k")).otherwise(F.col("k")).cast("string"))
    r = F.col("k") % 10
    id_ = F.when(r == 0, F.concat(ten, F.lit(" b"))).when(r == 1, F.concat(ten, F.lit("-b"))).when(r == 2, F.concat(ten, F.lit("_b_2"))).otherwise(other)
    rows = p.select("side", F.floor(F.col("k") / 50).cast("long").alias("g"), F.col("k").alias("pos"), id_.alias("id"))
    return rows.filter("side = 0"), rows.filter("side = 1")


@query(NAMED + " SELECT s.g, s.id AS source_id, s.id AS generated_id FROM s JOIN o ON s.g = o.g AND s.id = o.id WHERE NOT EXISTS (SELECT 1 FROM u WHERE u.g = s.g AND (u.id = s.id OR u.said = s.id))")
def align_by_id(spark, sf_dir):
    """Pairs of equal ids, without those whose portable forms cannot be told apart."""
    return align.by_id(*_named(spark, sf_dir), ["pos"])


@query(NAMED + " SELECT g, id, 'source' AS side FROM u UNION SELECT g, said, 'emitted' FROM u")
def ambiguous_ids(spark, sf_dir):
    """Ids that share a portable form, what they are emitted as, and ids that are called like that."""
    return identifiers.ambiguous(_named(spark, sf_dir)[0], ["pos"])


@query(PARTS + " " + _pair("s", "g", "short"))
def align_by_unique_label(spark, sf_dir):
    """Pairs of labels that occur once on each side."""
    s, g = _sides(spark, sf_dir)
    return align.unique_pairs(s, g, "short")


@query(PARTS + f""", s1 AS (SELECT *, CASE WHEN id % 3 = 0 THEN id END AS k1, CASE WHEN id % 3 = 1 THEN 'n_' || id END AS k2 FROM s), g1 AS (SELECT *, CASE WHEN id % 3 = 0 THEN id END AS k1, CASE WHEN id % 3 = 1 THEN 'n_' || id END AS k2 FROM g),
p1 AS (SELECT a.id AS source_id, b.id AS generated_id FROM s1 a JOIN g1 b ON a.k1 = b.k1), s2 AS (SELECT * FROM s1 WHERE id NOT IN (SELECT source_id FROM p1)), g2 AS (SELECT * FROM g1 WHERE id NOT IN (SELECT generated_id FROM p1)),
p2 AS (SELECT a.id AS source_id, b.id AS generated_id FROM s2 a JOIN g2 b ON a.k2 = b.k2), s3 AS (SELECT * FROM s2 WHERE id NOT IN (SELECT source_id FROM p2)), g3 AS (SELECT * FROM g2 WHERE id NOT IN (SELECT generated_id FROM p2)),
p3 AS ({_pair('s3', 'g3', 'short')})
SELECT source_id, generated_id, 'id' AS stage FROM p1 UNION ALL SELECT source_id, generated_id, 'alias' FROM p2 UNION ALL SELECT source_id, generated_id, 'label' FROM p3
UNION ALL SELECT id, NULL, 'unmatched' FROM s3 WHERE id NOT IN (SELECT source_id FROM p3) UNION ALL SELECT NULL, id, 'unmatched' FROM g3 WHERE id NOT IN (SELECT generated_id FROM p3)""")
def align_cascade(spark, sf_dir):
    """Ids, then portable aliases, then unique labels, each among what is left; and the unmatched."""
    keyed = [
        x.withColumn("k1", F.when(F.col("id") % 3 == 0, F.col("id"))).withColumn("k2", F.when(F.col("id") % 3 == 1, text.portable(F.col("id").cast("string"))))
        for x in _sides(spark, sf_dir)
    ]
    return align.cascade(*keyed, [("id", "k1"), ("alias", "k2"), ("label", "short")])


@query(PARTS + f""", g1 AS (SELECT id, CASE WHEN id % 4 = 0 THEN (SELECT label FROM s WHERE s.id = g.id) ELSE label END AS label FROM g),
same AS (SELECT s.id AS source_id, s.id AS generated_id FROM s JOIN g1 ON s.id = g1.id AND s.label = g1.label), byl AS ({_pair('s', 'g1', 'label')})
SELECT * FROM same UNION ALL SELECT * FROM byl WHERE source_id NOT IN (SELECT source_id FROM same) AND generated_id NOT IN (SELECT generated_id FROM same)""")
def align_shared_namespace(spark, sf_dir):
    """Unique labels, but an equal id with an equal label overrides."""
    s, g = _sides(spark, sf_dir)
    theirs = s.select("id", F.col("label").alias("theirs"))
    g = g.join(theirs, "id", "left").withColumn("label", F.when(F.col("id") % 4 == 0, F.col("theirs")).otherwise(F.col("label")))
    return align.evaluation_pairs(s, g.select("id", "label"), True)


@query(r"""WITH p AS (SELECT p_partkey AS id, p_brand || '-' || CAST(p_partkey % 997 AS VARCHAR) AS raw FROM part UNION ALL SELECT -p_partkey, CAST(p_size AS VARCHAR) || '!' FROM part UNION ALL SELECT -1000000 - p_partkey, '#' || repeat('é', p_size % 3) FROM part),
b AS (SELECT id, raw, trim(regexp_replace(raw, '[^A-Za-z0-9_]', '_', 'g'), '_') AS bare FROM p),
n AS (SELECT id, raw, CASE WHEN bare = '' THEN 'node' WHEN regexp_matches(bare, '^[0-9]') THEN 'n_' || bare ELSE bare END AS portable FROM b)
SELECT id, raw, portable, CASE WHEN rn = 1 THEN portable ELSE portable || '_' || rn END AS emitted, c > 1 AS clashes FROM (SELECT *, row_number() OVER (PARTITION BY portable ORDER BY id) AS rn, count(*) OVER (PARTITION BY portable) AS c FROM n)""")
def portable_identifier(spark, sf_dir):
    """Identifiers fit for diagram code, and suffixes for those that clash."""
    p = corpora.table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_size")
    ids = F.explode(F.array(
        F.struct(F.col("p_partkey").alias("id"), F.concat_ws("-", "p_brand", (F.col("p_partkey") % 997).cast("string")).alias("raw")),
        F.struct((-F.col("p_partkey")).alias("id"), F.concat(F.col("p_size").cast("string"), F.lit("!")).alias("raw")),
        F.struct((-1000000 - F.col("p_partkey")).alias("id"), F.concat(F.lit("#"), F.repeat(F.lit("é"), F.col("p_size") % 3)).alias("raw")),
    ))
    n = p.select(ids.alias("x")).select("x.*").withColumn("portable", text.portable(F.col("raw")))
    w = Window.partitionBy("portable")
    rn = F.row_number().over(w.orderBy("id"))
    return n.select("id", "raw", "portable", F.when(rn == 1, F.col("portable")).otherwise(F.concat_ws("_", "portable", rn.cast("string"))).alias("emitted"), (F.count("*").over(w) > 1).alias("clashes"))


@query(PARTS + f""", pairs AS ({_pair('s', 'g', 'short')}), t AS (SELECT (SELECT count(*) FROM pairs) AS tp, (SELECT count(*) FROM g) AS o, (SELECT count(*) FROM s) AS w)
SELECT CAST(tp AS BIGINT) AS tp, CAST(o - tp AS BIGINT) AS fp, CAST(w - tp AS BIGINT) AS fn, round(tp / nullif(o, 0), 9) AS precision, round(tp / nullif(w, 0), 9) AS recall, round(2.0 * tp / nullif(o + w, 0), 9) AS f1 FROM t""")
def structural_prf(spark, sf_dir):
    """Micro precision, recall and F1 of aligned nodes: summed first, divided last."""
    s, g = _sides(spark, sf_dir)
    counts = align.unique_pairs(s, g, "short").agg(F.count("*").alias("tp"))
    sizes = corpora.labels(spark, sf_dir).agg(F.count(F.when(F.col("side") == "generated", 1)).alias("o"), F.count(F.when(F.col("side") == "source", 1)).alias("w"))
    t, o, w = F.col("tp"), F.col("o"), F.col("w")
    return counts.crossJoin(sizes).select("tp", (o - t).alias("fp"), (w - t).alias("fn"), F.round(bags.ratio(t, o), 9).alias("precision"), F.round(bags.ratio(t, w), 9).alias("recall"), F.round(2.0 * t / F.nullif(o + w, F.lit(0).cast("long")), 9).alias("f1"))


@query("""WITH v AS (SELECT p_brand AS cluster, p_type AS label, p_size % 3 AS kind, p_retailprice AS conf, p_partkey AS id FROM part),
b AS (SELECT cluster, label, min(kind) AS bucket, count(*) AS votes, max(conf) AS conf, max(id) AS rank FROM v GROUP BY 1, 2)
SELECT cluster, label, CAST(bucket AS INTEGER) AS bucket, CAST(votes AS BIGINT) AS votes FROM (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY bucket, votes DESC, conf DESC, rank DESC, label) AS rn FROM b) WHERE rn = 1""")
def label_vote(spark, sf_dir):
    """A cluster's label: best kind of evidence, then votes, confidence, rank, text."""
    v = corpora.table(spark, sf_dir, "part").select(F.col("p_brand").alias("cluster"), F.col("p_type").alias("label"), (F.col("p_size") % 3).alias("kind"), F.col("p_retailprice").alias("conf"), F.col("p_partkey").alias("id"))
    b = v.groupBy("cluster", "label").agg(F.min("kind").alias("bucket"), F.count("*").alias("votes"), F.max("conf").alias("conf"), F.max("id").alias("rank"))
    w = Window.partitionBy("cluster").orderBy("bucket", F.desc("votes"), F.desc("conf"), F.desc("rank"), "label")
    return b.withColumn("rn", F.row_number().over(w)).filter("rn = 1").select("cluster", "label", "bucket", "votes")


@query("""SELECT p_brand AS cluster, CASE WHEN count(DISTINCT CASE WHEN p_size % 5 <> 0 THEN p_size % 2 END) = 1 THEN CAST(max(CASE WHEN p_size % 5 <> 0 THEN p_size % 2 END) AS INTEGER) END AS weight,
  count(DISTINCT CASE WHEN p_size % 5 <> 0 THEN p_size % 2 END) > 1 AS conflict FROM part GROUP BY 1""")
def consensus_or_null(spark, sf_dir):
    """The one value that all who have a value agree on, else null and a conflict."""
    p = corpora.table(spark, sf_dir, "part").select(F.col("p_brand").alias("cluster"), F.when(F.col("p_size") % 5 != 0, F.col("p_size") % 2).alias("w"))
    return p.groupBy("cluster").agg(F.when(F.min("w") == F.max("w"), F.max("w")).cast("int").alias("weight"), F.coalesce(F.min("w") != F.max("w"), F.lit(False)).alias("conflict"))


@query("""WITH claims AS (SELECT l_orderkey AS node, l_partkey % 1500 AS ev, l_linenumber AS line FROM lineitem), owned AS (SELECT ev FROM claims GROUP BY ev HAVING count(DISTINCT node) = 1)
SELECT CAST(count(DISTINCT node) AS BIGINT) AS nodes, CAST(count(DISTINCT node) FILTER (WHERE line <> 2 AND ev IN (SELECT ev FROM owned)) AS BIGINT) AS supported,
  round(count(DISTINCT node) FILTER (WHERE line <> 2 AND ev IN (SELECT ev FROM owned)) / nullif(count(DISTINCT node), 0), 9) AS share FROM claims""")
def injective_provenance(spark, sf_dir):
    """Nodes with a piece of eligible evidence that no other node claims."""
    c = corpora.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("node"), (F.col("l_partkey") % 1500).alias("ev"), (F.col("l_linenumber") != 2).alias("eligible"))
    c = c.groupBy("node", "ev").agg(F.bool_or("eligible").alias("eligible"))
    owned = c.groupBy("ev").agg(F.count("*").alias("claims"), F.max("node").alias("node"), F.bool_or("eligible").alias("eligible")).filter("claims = 1 and eligible")
    supported = owned.agg(F.countDistinct("node").alias("supported"))
    nodes = c.agg(F.countDistinct("node").alias("nodes"))
    return nodes.crossJoin(supported).select("nodes", "supported", F.round(bags.ratio(F.col("supported"), F.col("nodes")), 9).alias("share"))


@query("""WITH e AS (SELECT l_partkey AS id, l_suppkey AS block, CASE l_linenumber % 5 WHEN 0 THEN 5 WHEN 1 THEN 4 WHEN 2 THEN 3 WHEN 3 THEN 2 ELSE 1 END AS rank, l_quantity AS score, l_returnflag AS payload, l_orderkey AS o, l_extendedprice AS x FROM lineitem),
m AS (SELECT id, arg_max(payload, (rank, o, x, payload)) AS payload, arg_max(block, (rank, o, x, payload)) AS wb, list_sort(list_distinct(list(block))) AS blocks, max(score) AS score, count(*) AS n FROM e GROUP BY id)
SELECT id, payload, CAST(CASE WHEN len(blocks) <= 25 THEN len(blocks) ELSE 1 END AS INTEGER) AS n_blocks, CAST(CASE WHEN len(blocks) <= 25 THEN list_sum(blocks) ELSE wb END AS BIGINT) AS block_sum, score, n > 1 AS collision FROM m""")
def evidence_merge(spark, sf_dir):
    """Evidence of one id: the payload of the best source, all blocks (or the winner's alone beyond the cap), the best score."""
    r = F.col("l_linenumber") % 5
    rank = F.when(r == 0, 5).when(r == 1, 4).when(r == 2, 3).when(r == 3, 2).otherwise(1)
    e = corpora.table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("id"), F.col("l_suppkey").alias("block"), F.struct(rank.alias("r"), F.col("l_orderkey"), F.col("l_extendedprice"), F.col("l_returnflag")).alias("by"), F.col("l_quantity").alias("score"), F.col("l_returnflag").alias("payload"))
    m = e.groupBy("id").agg(F.max_by("payload", "by").alias("payload"), F.max_by("block", "by").alias("wb"), F.collect_set("block").alias("blocks"), F.max("score").alias("score"), F.count("*").alias("n"))
    fits = F.size("blocks") <= 25
    return m.select("id", "payload", F.when(fits, F.size("blocks")).otherwise(1).alias("n_blocks"), F.when(fits, F.aggregate("blocks", F.lit(0).cast("long"), lambda s, x: s + x)).otherwise(F.col("wb")).alias("block_sum"), "score", (F.col("n") > 1).alias("collision"))


@query("""WITH p AS (SELECT event_type AS kind, CASE user_id % 5 WHEN 0 THEN 'vector' WHEN 1 THEN 'geometry' WHEN 2 THEN 'ocr' WHEN 3 THEN 'vlm' ELSE 'other' END AS src, CAST(round(value * 100) AS BIGINT) AS score FROM events),
w AS (SELECT *, CASE src WHEN 'vector' THEN 100 WHEN 'geometry' THEN 90 WHEN 'ocr' THEN 50 WHEN 'vlm' THEN 100 ELSE 75 END AS weight FROM p), t AS (SELECT sum(weight) AS total FROM w)
SELECT kind, round(CAST(sum(score * weight) AS DOUBLE) / (SELECT total FROM t), 9) AS score, CAST(row_number() OVER (ORDER BY sum(score * weight) DESC, kind) AS INTEGER) AS rank FROM w GROUP BY kind""")
def weighted_prediction(spark, sf_dir):
    """Type predictions of several sources, fused by the weight of all inputs."""
    # fixed values: weights of sources in percent
    weights = {"vector": 100, "geometry": 90, "ocr": 50, "vlm": 100, "other": 75}
    src = F.element_at(F.array(*map(F.lit, ["vector", "geometry", "ocr", "vlm", "other"])), (F.col("user_id") % 5 + 1).cast("int"))
    e = corpora.table(spark, sf_dir, "events").select(F.col("event_type").alias("kind"), F.element_at(F.create_map(*[F.lit(x) for kv in weights.items() for x in kv]), src).cast("long").alias("weight"), F.round(F.col("value") * 100).cast("long").alias("score"))
    by = e.groupBy("kind").agg(F.sum(F.col("score") * F.col("weight")).alias("s"), F.sum("weight").alias("w"))
    total = by.agg(F.sum("w").alias("total"))
    rank = F.row_number().over(Window.orderBy(F.desc("s"), "kind"))  # few kinds, whatever the size of the table
    return by.crossJoin(total).select("kind", F.round(F.col("s").cast("double") / F.col("total"), 9).alias("score"), rank.alias("rank"))


@query(PARTS + f""", pairs AS ({_pair('s', 'g', 'short')}), e AS (SELECT DISTINCT CAST(p_size AS BIGINT) AS a, CAST(p_partkey // 2 AS BIGINT) AS b FROM part WHERE p_partkey % 2 = 1)
SELECT a, b, coalesce(CAST(p.source_id AS VARCHAR), 'generated:' || b) AS mapped FROM e LEFT JOIN pairs p ON p.generated_id = e.b""")
def edge_remap(spark, sf_dir):
    """Ends of generated edges under source ids; those without a partner are marked."""
    s, g = _sides(spark, sf_dir)
    e = corpora.table(spark, sf_dir, "part").filter("p_partkey % 2 = 1").select(F.col("p_size").cast("long").alias("a"), F.floor(F.col("p_partkey") / 2).cast("long").alias("b")).distinct()
    return align.remap(e.withColumn("mapped", F.col("b")), align.unique_pairs(s, g, "short"), ["mapped"]).select("a", "b", "mapped")
