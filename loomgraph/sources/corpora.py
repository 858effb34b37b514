"""The test tables read as scenes, bags, trees, flows, logs and cases.

Each function scans only the columns that its corpus needs, so the reader prunes the rest, and
leaves joins to the optimizer: no table here is small at every scale but nation and region.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Orders before this day are the reference side of the trade graph.
CUT = "1998-01-01"
#: Parts on a page.
PER_PAGE = 50


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def trade_arcs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """side (ref, cand), src, dst, n: arcs from the supplier's to the customer's nation.

    Arcs are summed per order and supplier's nation before customers are met, so the second join
    moves counts and not lines.
    """
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.when(F.col("o_orderdate") < F.lit(CUT).cast("timestamp_ntz"), "ref").otherwise("cand").alias("side"))
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey")
    suppliers = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").alias("src"))
    customers = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("dst"))
    at = lines.join(suppliers, lines.l_suppkey == suppliers.s_suppkey).join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    some = at.groupBy("side", "src", "o_custkey").agg(F.count("*").alias("n"))
    return some.join(customers, F.col("o_custkey") == F.col("c_custkey")).groupBy("side", "src", "dst").agg(F.sum("n").alias("n"))


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """side (source, generated), id, label, short: parts in pairs that share an id."""
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_type", "p_size")
    label = F.concat_ws(" ", "p_name", "p_brand", "p_type", F.col("p_size").cast("string"))
    return parts.select(
        F.when(F.col("p_partkey") % 2 == 0, "source").otherwise("generated").alias("side"),
        F.floor(F.col("p_partkey") / 2).cast("long").alias("id"),
        label.alias("label"),
        F.concat_ws(" ", "p_name", F.col("p_size").cast("string")).alias("short"),
    )


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page, id, x1, y1, x2, y2, score, text: a box for each part, 50 to a page."""
    p = table(spark, sf_dir, "part").select("p_partkey", "p_size", "p_brand", F.col("p_partkey").cast("long").alias("id"))
    x1, y1 = (F.col("p_size") * 10) % 97, F.col("id") % 89
    return p.select(
        F.floor(F.col("id") / PER_PAGE).cast("long").alias("page"),
        "id",
        x1.cast("double").alias("x1"),
        y1.cast("double").alias("y1"),
        (x1 + 5 + F.col("p_size") % 17).cast("double").alias("x2"),
        (y1 + 5 + F.col("id") % 13).cast("double").alias("y2"),
        ((F.col("id") * 37) % 101).cast("double").alias("score"),
        F.col("p_brand").alias("text"),
    )


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page, pid, x, y, text: a text span's centre for each part, on the pages of ``boxes``."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("long").alias("pid"), "p_brand")
    return p.select(F.floor(F.col("pid") / PER_PAGE).cast("long").alias("page"), "pid", ((F.col("pid") * 7) % 100).cast("double").alias("x"), ((F.col("pid") * 11) % 100).cast("double").alias("y"), F.col("p_brand").alias("text"))


def cents(column: str):
    return F.round(F.col(column) * 100).cast("long")


def tree_leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """region, nation, leaf, cents: customers under nations under regions."""
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_acctbal")
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")
    r = table(spark, sf_dir, "region").select("r_regionkey", "r_name")
    at = c.join(F.broadcast(n.join(r, n.n_regionkey == r.r_regionkey)), c.c_nationkey == F.col("n_nationkey"))
    return at.select(F.col("r_name").alias("region"), F.col("n_name").alias("nation"), F.col("c_custkey").alias("leaf"), cents("c_acctbal").alias("cents"))


def flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """src, dst, cents: region to segment to order priority, by the orders' prices.

    Orders are summed by customer first; the small dimension tables are fixed in size.
    """
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderpriority", cents("o_totalprice").alias("cents"))
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey").join(table(spark, sf_dir, "region").select("r_regionkey", "r_name"), F.col("n_regionkey") == F.col("r_regionkey"))
    by = o.groupBy("o_custkey", "o_orderpriority").agg(F.sum("cents").alias("cents"))
    at = by.join(c, by.o_custkey == c.c_custkey).join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey"))
    some = at.groupBy("r_name", "c_mktsegment", "o_orderpriority").agg(F.sum("cents").alias("cents"))
    legs = F.explode(F.array(F.struct(F.col("r_name").alias("src"), F.col("c_mktsegment").alias("dst")), F.struct(F.col("c_mktsegment").alias("src"), F.col("o_orderpriority").alias("dst"))))
    return some.select(legs.alias("leg"), "cents").groupBy("leg.src", "leg.dst").agg(F.sum("cents").alias("cents"))


def members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """name, member: users of each event type."""
    return table(spark, sf_dir, "events").select(F.col("event_type").alias("name"), F.col("user_id").alias("member")).distinct()


def cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """case_id, lang, source, n_chars, quality, toxic: labels are missing for many."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("case_id"), "lang", "source", "n_chars")
    return d.join(table(spark, sf_dir, "labels").select(F.col("doc_id").alias("case_id"), "quality", "toxic"), "case_id", "left")
