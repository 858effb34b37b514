"""Chart plans: arithmetic over records of a chart, with what is wrong in a column of its own.

Every planner takes rows with a chart key ``g`` and works on all charts at once.  ``native`` says
whether the chart's own grammar can show it; if not, its labels go into a fallback.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.functions import geom, numeric, text
from loomgraph.operators import spatial

# fixed values: most records that a native chart shows
SLICES, SERIES, POINTS = 12, 10, 256


def first_error(*rules: tuple[Column, str]) -> Column:
    """The name of the first rule that is broken, else null."""
    out = F.lit(None).cast("string")
    for broken, name in reversed(rules):
        out = F.when(F.coalesce(broken, F.lit(False)), F.lit(name)).otherwise(out)
    return out


def pie(slices: DataFrame) -> DataFrame:
    """g, label, value, percent, hidden, x, y, native, error.  slices: g, pos, label, value."""
    w = Window.partitionBy("g")
    s = slices.withColumn("norm", text.normal_space(F.col("label")))
    s = s.withColumns({"total": F.sum("value").over(w), "count": F.count("*").over(w), "same": F.count("*").over(Window.partitionBy("g", "norm")), "low": F.min("value").over(w)})
    before = F.coalesce(F.sum("value").over(w.orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    middle = 2 * math.pi * (before + F.col("value") / 2) / F.col("total")
    x, y = geom.polar(middle, F.lit(0.375), clockwise_from_top=True)
    error = first_error((F.col("low") < 0, "negative value"), (F.col("total") <= 0, "no total"), (F.max("same").over(w) > 1, "duplicate label"))
    ok = error.isNull()
    share = F.when(ok, numeric.percent(F.col("value"), F.col("total")))
    return s.select("g", "pos", "label", "value", share.alias("percent"), F.when(ok, F.col("value") * 100 < F.col("total")).alias("hidden"), F.when(ok, x).alias("x"), F.when(ok, y).alias("y"), (ok & (F.col("count") <= SLICES)).alias("native"), error.alias("error"))


def sankey(flows: DataFrame) -> DataFrame:
    """g, node, inflow, outflow, total (of hundredths), shown, error.  flows: g, src, dst, value."""
    sides = F.explode(F.array(F.struct(F.col("src").alias("node"), F.lit(0).cast("long").alias("i"), F.col("value").alias("o")), F.struct(F.col("dst").alias("node"), F.col("value").alias("i"), F.lit(0).cast("long").alias("o"))))
    s = flows.select("g", sides.alias("s"), (F.col("value") <= 0).alias("bad"), (F.col("src") == F.col("dst")).alias("self"))
    n = s.groupBy("g", "s.node").agg(F.sum("s.i").alias("inflow"), F.sum("s.o").alias("outflow"), F.bool_or("bad").alias("bad"), F.bool_or("self").alias("self"))
    total = F.greatest("inflow", "outflow")
    error = first_error((F.col("bad"), "value is not positive"), (F.col("self"), "flow to itself"), (~F.col("node").rlike(r"^[\x20-\x7E]+$"), "label is not plain"))
    return n.select("g", "node", "inflow", "outflow", total.alias("total"), numeric.hundredths(total / 100).alias("shown"), error.alias("error"))


def sankey_native(nodes: DataFrame, flows: DataFrame) -> DataFrame:
    """g, nodes, flows, error (null: it can be shown as it is): labels differ and are plain, values are positive, flows join all
    nodes and no others, and lead nowhere back.  nodes: g, id, label; flows: g, src, dst, value."""
    from loomgraph.operators import graph

    names = nodes.groupBy("g").agg(F.count("*").alias("nodes"), F.count_distinct("id").alias("ids"), F.count_distinct("label").alias("labels"), F.coalesce(F.bool_and(F.col("label").rlike(r"^[\x20-\x7E]*$")), F.lit(False)).alias("plain"))
    ways = flows.groupBy("g").agg(F.count("*").alias("flows"), F.bool_and(F.coalesce(F.col("value") > 0, F.lit(False))).alias("positive"))
    ends = flows.select("g", F.explode(F.array("src", "dst")).alias("id")).distinct().withColumn("linked", F.lit(True))
    both = nodes.select("g", "id").distinct().withColumn("known", F.lit(True)).join(ends, ["g", "id"], "full")
    fit = both.groupBy("g").agg(F.bool_or(F.col("known").isNull()).alias("unknown"), F.bool_or(F.col("linked").isNull()).alias("loose"))
    at = names.join(ways, "g", "left").join(fit, "g", "left").join(graph.acyclic(flows.select("g", "src", "dst").distinct()).select("g", "acyclic"), "g", "left")
    error = first_error(
        (F.col("ids") < F.col("nodes"), "duplicate id"), (F.col("unknown"), "unknown end"), (F.col("loose"), "node without a flow"), (F.col("labels") < F.col("nodes"), "duplicate label"),
        (~F.col("plain"), "label is not plain"), (~F.col("positive"), "value is not positive"), (~F.col("acyclic"), "flows lead back"),
    )
    return at.select("g", "nodes", F.coalesce("flows", F.lit(0)).cast("long").alias("flows"), error.alias("error"))


def treemap(leaves: DataFrame, levels: list[str], value: str = "value") -> DataFrame:
    """level columns, level, total, leaves, errors of each node: leaves without a positive value count
    as errors and not toward totals."""
    ok = F.col(value) > 0
    out = leaves.rollup(*levels).agg(F.coalesce(F.sum(F.when(ok, F.col(value))), F.lit(0)).alias("total"), F.count(F.when(ok, 1)).alias("leaves"), F.count(F.when(~ok | F.col(value).isNull(), 1)).alias("errors"), F.grouping_id().alias("_g"))
    return out.withColumn("level", (F.lit(len(levels)) - F.bit_count("_g")).cast("int")).drop("_g")


def venn(members: DataFrame, most: int | None = None) -> DataFrame:
    """sets (array), size of every intersection that has members, of up to ``most`` sets (None: of all).

    members: name, member, distinct.  A member's sets are gathered once, members with the same sets are
    counted, and only then are combinations made, so no two members ever meet.  A member of k sets is
    in 2 ** k - 1 intersections, all of which are in the result.
    """
    by = members.groupBy("member").agg(F.array_sort(F.collect_set("name")).alias("names"))
    alike = by.groupBy("names").agg(F.count("*").alias("n"))
    picks = F.expr("transform(sequence(1L, shiftleft(1L, size(names)) - 1), m -> filter(names, (x, i) -> (shiftright(m, i) & 1) = 1))")
    if most is not None:
        picks = F.filter(picks, lambda s: F.size(s) <= most)
    return alike.select(F.explode(picks).alias("sets"), "n").groupBy("sets").agg(F.sum("n").alias("size"))


def venn_checks(sizes: DataFrame) -> DataFrame:
    """sets, size, error, proper: an intersection must not exceed any that holds it, and every pair of
    a larger one must be there.  sizes: sets (sorted array), size."""
    s = sizes.withColumn("k", F.size("sets"))
    subs = F.transform("sets", lambda x: F.array_remove("sets", x))
    up = s.filter("k >= 2").select("sets", "size", F.explode(subs).alias("sub")).join(sizes.select(F.col("sets").alias("sub"), F.col("size").alias("above")), "sub", "left")
    judged = up.groupBy("sets").agg(F.bool_or(F.col("above") < F.col("size")).alias("over"), F.bool_or(F.col("above").isNull()).alias("gap"), F.bool_or(F.col("above") == F.col("size")).alias("equal"))
    out = s.join(judged, "sets", "left")
    error = first_error((F.col("size") < 0, "negative size"), (F.col("over"), "larger than a part of it"), (F.col("gap"), "a part is missing"))
    return out.select("sets", "size", "k", error.alias("error"), (F.coalesce(~F.col("equal"), F.lit(True))).alias("proper"))


def xychart(rows: DataFrame, low: Column, high: Column) -> DataFrame:
    """g, series, points, outside, pairs, native, error.  rows: g, series, pos, value; categories are by
    position, and all series must have as many."""
    by = rows.groupBy("g", "series").agg(F.count("*").alias("points"), F.count(F.when(~F.col("value").between(low, high), 1)).alias("outside"), F.max("pos").alias("last"), F.min("value").alias("least"))
    w = Window.partitionBy("g")
    wide = by.withColumns({"n": F.count("*").over(w), "most": F.max("points").over(w), "all": F.sum("points").over(w)})
    error = first_error((F.col("outside") > 0, "value is out of bounds"), (F.col("points") != F.col("most"), "lengths differ"), (F.col("points") < 2, "too few points"))
    return wide.select("g", "series", "points", "outside", (error.isNull() & (F.col("n") <= SERIES) & (F.col("all") <= POINTS)).alias("native"), error.alias("error"))


def uniform_grid(points: DataFrame, tolerance: float = 1e-9) -> DataFrame:
    """g, uniform: whether x goes up by one step from first to last.  points: g, pos, x."""
    by = points.groupBy("g").agg(F.min_by("x", "pos").alias("x0"), F.max_by("x", "pos").alias("x1"), F.count("*").alias("n"))
    at = points.withColumn("i", F.row_number().over(Window.partitionBy("g").orderBy("pos")) - 1).join(by, "g")
    want = F.col("x0") + (F.col("x1") - F.col("x0")) / F.nullif(F.col("n") - 1, F.lit(0).cast("long")) * F.col("i")
    return at.groupBy("g").agg((F.bool_and(F.abs(F.col("x") - want) <= tolerance) & (F.max("x1") > F.max("x0")) & (F.max("n") >= 2)).alias("uniform"))


def quadrant(points: DataFrame) -> DataFrame:
    """g, label, quadrant (1 top right, then against the clock), error.  points: g, label, x, y in [0, 1]."""
    x, y = F.col("x"), F.col("y")
    inside = x.between(0, 1) & y.between(0, 1)
    q = F.when((x >= 0.5) & (y >= 0.5), 1).when((x < 0.5) & (y >= 0.5), 2).when(x < 0.5, 3).otherwise(4)
    same = F.count("*").over(Window.partitionBy("g", "label"))
    error = first_error((~inside, "point is outside"), (same > 1, "duplicate label"))
    return points.select("g", "label", F.when(inside, q).alias("quadrant"), error.alias("error"))


def radar(values: DataFrame, low: float = 0.0) -> DataFrame:
    """g, series, dims, scale_max, error, and the points (x, y) by dimension.  values: g, series, dim
    (from 0), value; every series must have every dimension."""
    w = Window.partitionBy("g")
    by = values.groupBy("g", "series").agg(F.count("value").alias("dims"), F.max("value").alias("top"), F.min("value").alias("bottom"), F.countDistinct("dim").alias("distinct"), F.array_sort(F.collect_list(F.struct("dim", "value"))).alias("v"))
    s = by.withColumns({"need": F.max("distinct").over(w), "scale_max": F.max("top").over(w)})
    error = first_error((F.col("need") < 3, "too few dimensions"), (F.col("dims") != F.col("need"), "a value is missing"), (F.col("bottom") < low, "value is out of bounds"))

    def place(p):
        r = (p["value"] - low) / (F.col("scale_max") - low) * 0.5
        theta = 2 * math.pi * p["dim"] / F.col("need") - math.pi / 2
        px, py = geom.polar(theta, r)
        return F.struct(px.alias("x"), py.alias("y"))

    return s.select("g", "series", "dims", "scale_max", error.alias("error"), F.transform("v", place).alias("points"))


def wardley(nodes: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Components with errors (outside [0, 1], label taken) and links with errors (unknown, self, twice)."""
    same = F.count("*").over(Window.partitionBy("g", "label"))
    n = nodes.withColumn("error", first_error((~(F.col("x").between(0, 1) & F.col("y").between(0, 1)), "point is outside"), (same > 1, "duplicate label")))
    twice = F.count("*").over(Window.partitionBy("g", "source", "target"))
    e = links
    for c in ("source", "target"):
        e = e.join(nodes.select("g", F.col("id").alias(c), F.lit(True).alias(f"_{c}")), ["g", c], "left")
    e = e.withColumn("error", first_error((F.col("_source").isNull() | F.col("_target").isNull(), "unknown end"), (F.col("source") == F.col("target"), "link to itself"), (twice > 1, "duplicate link")))
    return n, e.drop("_source", "_target")


def record_binding(records: DataFrame, evidence: DataFrame, size: float = 32.0) -> DataFrame:
    """g, state of each diagram: unavailable if record boxes overlap, evidence is owned twice or a record
    owns nothing; exact if each record's texts in reading order are what it should say; else mismatch.

    records: g, id, x1, y1, x2, y2, expected; evidence: g, eid, x1, y1, x2, y2, text.
    """
    r = records.select("g", "id", "x1", "y1", "x2", "y2")
    crossing = (F.col("a_id") < F.col("b_id")) & geom.crosses(geom.box("a_"), geom.box("b_"))
    clash = spatial.box_pairs(r, r, size, crossing, page="g").select("g").distinct().withColumn("clash", F.lit(True))
    own = spatial.box_pairs(r, evidence.select("g", "eid", "x1", "y1", "x2", "y2", "text"), size, geom.contains(geom.box("a_"), geom.box("b_")), page="g")
    own = own.select("g", F.col("a_id").alias("id"), F.col("b_eid").alias("eid"), F.col("b_x1").alias("x1"), F.col("b_y1").alias("y1"), F.col("b_text").alias("text"))
    twice = own.groupBy("g", "eid").agg(F.count("*").alias("n")).filter("n > 1").select("g").distinct().withColumn("twice", F.lit(True))
    said = own.groupBy("g", "id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("y1", "x1", "text"))), lambda s: s["text"]), " ").alias("said"))
    per = records.select("g", "id", "expected").join(said, ["g", "id"], "left")
    by = per.groupBy("g").agg(F.bool_or(F.col("said").isNull()).alias("bare"), F.bool_and(F.coalesce(text.normal_space(F.col("said")) == text.normal_space(F.col("expected")), F.lit(False))).alias("same"))
    out = by.join(clash, "g", "left").join(twice, "g", "left")
    bad = F.coalesce("clash", F.lit(False)) | F.coalesce("twice", F.lit(False)) | F.col("bare")
    return out.select("g", F.when(bad, "unavailable").when(F.col("same"), "exact").otherwise("mismatch").alias("state"))
