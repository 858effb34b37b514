"""Plans of node-and-edge diagrams: flowcharts, networks, lanes, states, classes, entities,
requirements, blocks, architectures, use cases, lineage, event models, domains.

They share one shape: records with ids, relations between them, groups of them.  A type says which
records it has, which tokens are closed, and what its lines look like.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.functions import text
from loomgraph.operators import identifiers
from loomgraph.plans.charts import first_error
from loomgraph.plans.ordered import emit


@dataclass(frozen=True)
class Kind:
    """``records``: names of node-like lists that are merged into one id space.  ``roles``: closed
    tokens of a node's role.  ``tokens``: closed tokens of a relation.  ``loops``: whether a relation
    may go back to its own node, ``repeats``: whether it may come twice."""

    name: str
    header: str
    records: tuple[str, ...] = ("nodes",)
    roles: tuple[str, ...] = ()
    tokens: tuple[str, ...] = ()
    loops: bool = True
    repeats: bool = True
    grouped: bool = True
    arrow: dict = field(default_factory=lambda: {})
    default_arrow: str = "-->"


# fixed values: cardinalities of entity relations and their signs
CARDINALITIES = {"zero_or_one": "|o", "one": "||", "zero_or_more": "}o", "one_or_more": "}|", "many": "}o"}
KINDS = {
    k.name: k
    for k in (
        Kind("flowchart", "flowchart LR"),
        Kind("generic_network", "flowchart LR"),
        Kind("swimlane", "flowchart LR", records=("lanes",)),
        Kind("bpmn", "flowchart LR", records=("lanes",)),
        Kind("state", "stateDiagram-v2", records=("states",), roles=("state", "choice", "fork", "join")),
        Kind("class", "classDiagram", records=("classes",), tokens=("association", "dependency", "aggregation", "composition", "link", "inheritance", "realization"), arrow={"association": "--", "inheritance": "--|>", "composition": "*--", "aggregation": "o--", "dependency": "..>", "realization": "..|>", "link": "-->"}),
        Kind("er", "erDiagram", records=("entities",), tokens=tuple(CARDINALITIES), grouped=False, default_arrow="--"),
        Kind("requirement", "requirementDiagram", records=("requirements", "elements"), tokens=("contains", "copies", "derives", "satisfies", "verifies", "refines", "traces"), grouped=False),
        Kind("block", "block-beta", records=("blocks",)),
        Kind("architecture", "architecture-beta", records=("services", "junctions"), tokens=("L", "R", "T", "B"), default_arrow="--"),
        Kind("c4", "architecture-beta", records=("people", "systems", "containers", "components"), default_arrow="--"),
        Kind("deployment", "flowchart LR", records=("nodes", "artifacts")),
        Kind("component", "flowchart LR", records=("components", "interfaces")),
        Kind("usecase", "flowchart LR", records=("actors", "usecases"), tokens=("association", "include", "extend", "generalization")),
        Kind("data_lineage", "flowchart LR", records=("datasets", "processes"), loops=False, repeats=False),
        Kind("cynefin", "flowchart LR", records=("items",), roles=("clear", "complicated", "complex", "chaotic", "confusion"), repeats=False),
        Kind("eventmodeling", "flowchart LR", records=("frames",), roles=("command", "event", "view", "processor", "ui")),
        Kind("organization", "flowchart TB", records=("people",), loops=False, repeats=False),
    )
}


def merged(records: dict[str, DataFrame]) -> DataFrame:
    """One id space from several node-like lists: g, record, pos, id, label, role."""
    out = None
    for name, df in records.items():
        one = df.withColumn("record", F.lit(name)).select("g", "record", "pos", "id", "label", "role")
        out = one if out is None else out.unionByName(one)
    return out


def nodes(kind: Kind, rows: DataFrame) -> DataFrame:
    """g, record, pos, id, label, role, emitted, error: ids are unique in a diagram; emitted ids are portable, with suffixes where they
    clash with one that came before; a missing id is N and its place."""
    named = identifiers.emitted(rows.select("g", "record", "pos", "id", "label", "role"), ["record", "pos", "id"])
    same = F.count("*").over(Window.partitionBy("g", "id"))
    n = named.withColumn("label", F.coalesce("label", "id"))
    rules = [(same > 1, "duplicate id"), (text.has_control(F.col("label")), "control character")]
    if kind.roles:
        rules.append((F.col("role").isNotNull() & ~text.casefold(F.col("role")).isin(*kind.roles), "unknown role"))
    return n.withColumn("error", first_error(*rules)).select("g", "record", "pos", "id", "label", "role", "emitted", "error")


def edges(kind: Kind, rows: DataFrame, planned: DataFrame) -> DataFrame:
    """g, pos, source, target, label, token, source_emitted, target_emitted, error.

    Both ends must be known; loops, repeats and tokens are as the kind allows.
    """
    out = rows
    for end in ("source", "target"):
        known = planned.groupBy("g", "id").agg(F.first("emitted").alias(f"{end}_emitted")).withColumnRenamed("id", end)
        out = out.join(known, ["g", end], "left")
    rules = [(F.col("source_emitted").isNull(), "unknown source"), (F.col("target_emitted").isNull(), "unknown target")]
    if not kind.loops:
        rules.append((F.col("source") == F.col("target"), "relation to itself"))
    if not kind.repeats:
        rules.append((F.count("*").over(Window.partitionBy("g", "source", "target")) > 1, "duplicate relation"))
    if kind.tokens:
        rules.append((~F.coalesce("token", F.lit(kind.tokens[0])).isin(*kind.tokens), "unknown token"))
    return out.withColumn("error", first_error(*rules)).select("g", "pos", "source", "target", "label", "token", "source_emitted", "target_emitted", "error")


def groups(rows: DataFrame, planned: DataFrame) -> DataFrame:
    """g, group, members, error: members are known and each is in one group.  rows: g, group, member."""
    many = F.size(F.collect_set("group").over(Window.partitionBy("g", "member")))
    known = planned.select("g", F.col("id").alias("member"), F.lit(True).alias("known")).distinct()
    at = rows.withColumn("many", many).join(known, ["g", "member"], "left")
    return at.groupBy("g", "group").agg(F.count("*").alias("members"), F.bool_or(F.col("known").isNull()).alias("u"), F.bool_or(F.col("many") > 1).alias("m")).select("g", "group", "members", first_error((F.col("u"), "unknown member"), (F.col("m"), "member of two groups")).alias("error"))


def lines(kind: Kind, planned: DataFrame, related: DataFrame) -> DataFrame:
    """g, code of every diagram without errors: header, nodes in order, relations in order."""
    bad = planned.filter("error is not null").select("g").unionByName(related.filter("error is not null").select("g")).distinct()
    quoted = lambda c: F.replace(c, F.lit('"'), F.lit("#quot;"))
    node = F.format_string('  %s["%s"]', F.col("emitted"), quoted(F.col("label")))
    arrow = F.lit(kind.default_arrow)
    for token, sign in kind.arrow.items():
        arrow = F.when(F.col("token") == token, F.lit(sign)).otherwise(arrow)
    label = F.when(F.col("label").isNotNull(), F.concat(F.lit('|"'), quoted(F.col("label")), F.lit('"|'))).otherwise(F.lit(""))
    edge = F.concat(F.lit("  "), F.col("source_emitted"), F.lit(" "), arrow, label, F.lit(" "), F.col("target_emitted"))
    head = planned.select("g").distinct().select("g", F.lit(0).alias("a"), F.lit("").alias("b"), F.lit(0).cast("long").alias("c"), F.lit(kind.header).alias("line"))
    body = planned.select("g", F.lit(1).alias("a"), F.col("record").alias("b"), F.col("pos").cast("long").alias("c"), node.alias("line"))
    rest = related.select("g", F.lit(2).alias("a"), F.lit("").alias("b"), F.col("pos").cast("long").alias("c"), edge.alias("line"))
    return emit(head.unionByName(body).unionByName(rest).join(bad, "g", "left_anti"), "g", ["a", "b", "c"])


def lane_order(lanes: DataFrame) -> DataFrame:
    """g, lane, node, place: nodes of lanes in one running order.  lanes: g, pos, lane, nodes (array)."""
    at = lanes.select("g", "pos", "lane", F.posexplode("nodes").alias("i", "node"))
    return at.select("g", "lane", "node", F.row_number().over(Window.partitionBy("g").orderBy("pos", "i")).alias("place"))


def block_grid(blocks: DataFrame, columns: int) -> DataFrame:
    """g, id, row, column by place."""
    i = F.row_number().over(Window.partitionBy("g").orderBy("pos")) - 1
    return blocks.select("g", "id", F.floor(i / columns).cast("int").alias("row"), (i % columns).alias("column"))


def to_scene(planned: DataFrame, related: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The scene's elements and relations of any such plan."""
    return planned.select(F.col("g").alias("scene_id"), F.col("emitted").alias("id"), "role", F.col("label").alias("text")), related.filter("error is null").select(F.col("g").alias("scene_id"), F.col("source_emitted").alias("source_id"), F.col("target_emitted").alias("target_id"), "label", F.lit(False).alias("arrow_at_start"), F.lit(True).alias("arrow_at_end"))


def visible_text(planned: DataFrame, related: DataFrame) -> DataFrame:
    """g, text of every label that the diagram shows."""
    return planned.select("g", F.col("label").alias("text")).unionByName(related.filter("label is not null").select("g", F.col("label").alias("text")))


def accessible(planned: DataFrame, ends: DataFrame, most: int = 5) -> DataFrame:
    """g, title, description: the first distinct labels in order, and where the only path goes."""
    first = planned.groupBy("g", "label").agg(F.min(F.struct("record", "pos")).alias("at"))
    names = F.transform(F.slice(F.array_sort(F.collect_list(F.struct("at", "label"))), 1, most), lambda s: s["label"])
    by = first.groupBy("g").agg(names.alias("labels"))
    at = by.join(ends, "g", "left")
    way: Column = F.when(F.col("first").isNotNull(), F.concat(F.lit(" From "), F.col("first"), F.lit(" to "), F.col("last"), F.lit("."))).otherwise(F.lit(""))
    return at.select("g", F.element_at("labels", 1).alias("title"), F.concat(F.array_join("labels", ", "), F.lit("."), way).alias("description"))
