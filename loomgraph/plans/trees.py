"""Plans of hierarchies: mind maps, tree views, organisations, fishbones, treemaps; and railroads,
whose expressions are trees that name what they do."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.operators import graph
from loomgraph.plans.charts import first_error
from loomgraph.plans.ordered import emit

# fixed values: what a railroad expression may be, and how many parts each takes (least, most)
RAILROAD = {"terminal": (0, 0), "nonterminal": (0, 0), "sequence": (1, None), "choice": (2, None), "optional": (1, 1), "repeat": (1, 2), "group": (1, 1)}


def hierarchy(rows: DataFrame, depth: int = graph.DEPTH) -> DataFrame:
    """g, id, parent, label, depth, place, error.  rows: g, id, parent, pos, label.

    Nodes that have no place are in the result with an error: one level too deep, under such a node or (in a diagram
    without any) not reached by a root.
    """
    flat = graph.preorder(rows, depth).select("g", "id", "depth", "place")
    roots = F.count(F.when(F.col("parent").isNull(), 1)).over(Window.partitionBy("g"))
    same = F.count("*").over(Window.partitionBy("g", "id"))
    at = rows.withColumns({"roots": roots, "same": same}).join(flat, ["g", "id"], "left")
    deep = F.col("depth") >= depth
    at = at.withColumn("deepest", F.max("depth").over(Window.partitionBy("g")))
    unseen = F.col("place").isNull()
    error = first_error((F.col("same") > 1, "duplicate id"), (F.col("roots") != 1, "not one root"), (deep, "too deep"), (unseen & (F.col("deepest") >= depth), "not reached or below a node that is too deep"), (unseen, "cycle or unknown parent"))
    return at.select("g", "id", "parent", "label", F.when(~deep, F.col("depth")).alias("depth"), "place", error.alias("error"))


def indented(planned: DataFrame, header: str) -> DataFrame:
    """g, code: a line for each node, indented by depth, of trees without errors."""
    bad = planned.filter("error is not null").select("g").distinct()
    rows = planned.join(bad, "g", "left_anti").select("g", "place", F.concat(F.repeat(F.lit("  "), F.col("depth") + 1), F.col("label")).alias("line"))
    head = rows.select("g").distinct().select("g", F.lit(0).alias("place"), F.lit(header).alias("line"))
    return emit(head.unionByName(rows), "g", ["place"])


def mindmap(rows: DataFrame) -> DataFrame:
    return indented(hierarchy(rows), "mindmap")


def treeview(rows: DataFrame) -> DataFrame:
    return indented(hierarchy(rows), "treeView-beta")


def ishikawa(effects: DataFrame, causes: DataFrame) -> DataFrame:
    """A fishbone: the effect is the root, its categories stand under it.  effects: g, id, label;
    causes: g, id, parent (null: a category), pos, label."""
    root = effects.select("g", "id", F.lit(None).cast("string").alias("parent"), F.lit(0).alias("pos"), "label")
    under = causes.join(effects.select("g", F.col("id").alias("_e")), "g").select("g", "id", F.coalesce("parent", "_e").alias("parent"), "pos", "label")
    return hierarchy(root.unionByName(under))


def organization(people: DataFrame) -> DataFrame:
    """A tree with at least one relation and none of its people twice."""
    planned = hierarchy(people)
    n = F.count("*").over(Window.partitionBy("g"))
    return planned.withColumn("error", F.coalesce("error", F.when(n < 2, "no relation")))


def railroad(nodes: DataFrame) -> DataFrame:
    """g, id, kind, depth, place, error of expression trees.  nodes: g, id, parent, pos, kind, label."""
    planned = hierarchy(nodes).join(nodes.select("g", "id", "kind"), ["g", "id"])
    parts = nodes.filter("parent is not null").groupBy("g", F.col("parent").alias("id")).agg(F.count("*").alias("parts"))
    at = planned.join(parts, ["g", "id"], "left").withColumn("parts", F.coalesce("parts", F.lit(0)))
    wrong = F.lit(False)
    for kind, (least, most) in RAILROAD.items():
        outside = F.col("parts") < least
        if most is not None:
            outside = outside | (F.col("parts") > most)
        wrong = F.when(F.col("kind") == kind, outside).otherwise(wrong)
    error = F.coalesce("error", first_error((~F.col("kind").isin(*RAILROAD), "unknown kind"), (wrong, "wrong number of parts")))
    return at.select("g", "id", "kind", "depth", "place", error.alias("error"))
