"""Code of class, entity and requirement diagrams from records, their parts and relations.

Each function gives g, code, error: a diagram with a record that breaks a rule has its first error (of the least text) and no code.
A record's parts are joined within the record; a diagram's lines meet only in its code.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.plans import network
from loomgraph.plans.charts import first_error
from loomgraph.plans.ordered import emit

# fixed values: signs of class relations, of cardinalities before and after the line, and words of requirements
RELATIONS = {"association": "--", "dependency": "..>", "aggregation": "o--", "composition": "*--", "link": "-->", "inheritance": "<|--", "realization": "<|.."}
BEFORE = {"one": "||", "only_one": "||", "zero_or_one": "o|", "one_or_more": "}|", "zero_or_more": "}o"}
AFTER = {"one": "||", "only_one": "||", "zero_or_one": "|o", "one_or_more": "|{", "zero_or_more": "o{"}
KEYS = ("PK", "FK", "UK")
REQUIREMENTS = {
    "requirement": "requirement",
    "functional": "functionalRequirement",
    "functional_requirement": "functionalRequirement",
    "interface": "interfaceRequirement",
    "interface_requirement": "interfaceRequirement",
    "performance": "performanceRequirement",
    "performance_requirement": "performanceRequirement",
    "physical": "physicalRequirement",
    "physical_requirement": "physicalRequirement",
    "design_constraint": "designConstraint",
}
RISKS = ("low", "medium", "high")
METHODS = ("analysis", "demonstration", "inspection", "test")


def _of(values: dict[str, str], c: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for pair in values.items() for x in pair]), c)


def _quoted(c: Column) -> Column:
    return F.replace(c, F.lit('"'), F.lit("#quot;"))


def _given(c: Column) -> Column:
    """Null for an empty text."""
    return F.nullif(c, F.lit(""))


def _code(header: str, records: DataFrame, relations: DataFrame) -> DataFrame:
    """Both: g, part, pos, line, error."""
    every = records.select("g", F.lit(1).alias("a"), "part", F.col("pos").cast("long").alias("b"), "line", "error")
    every = every.unionByName(relations.select("g", F.lit(2).alias("a"), F.lit("").alias("part"), F.col("pos").cast("long").alias("b"), "line", "error"))
    wrong = every.groupBy("g").agg(F.min("error").alias("error"))
    head = wrong.select("g", F.lit(0).alias("a"), F.lit("").alias("part"), F.lit(0).cast("long").alias("b"), F.lit(header).alias("line"))
    text = emit(head.unionByName(every.select("g", "a", "part", "b", "line")), "g", ["a", "part", "b"])
    return text.join(wrong, "g").select("g", F.when(F.col("error").isNull(), F.col("code")).alias("code"), "error")


def _related(relations: DataFrame, planned: DataFrame) -> DataFrame:
    """``relations`` with source_emitted and target_emitted, null where the end is unknown."""
    for end in ("source", "target"):
        known = planned.groupBy("g", "id").agg(F.first("emitted").alias(f"{end}_emitted")).withColumnRenamed("id", end)
        relations = relations.join(known, ["g", end], "left")
    return relations


def _ends() -> list:
    return [(F.col("source_emitted").isNull(), "unknown source"), (F.col("target_emitted").isNull(), "unknown target")]


def _parts(rows: DataFrame, line: Column, error: Column) -> DataFrame:
    """g, id, lines (of a record's parts, in order), wrong (its first error)."""
    at = rows.select("g", "id", "pos", line.alias("line"), error.alias("error"))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"])
    return at.groupBy("g", "id").agg(F.array_join(lines, "\n").alias("lines"), F.min("error").alias("wrong"))


def classes(records: DataFrame, members: DataFrame, relations: DataFrame) -> DataFrame:
    """Code of class diagrams; the source of an inheritance or realization is the child.

    records: g, pos, id, label; members: g, id, pos, kind (field, method), name, type, parameters (a text), visibility, classifier
    (static, abstract); relations: g, pos, source, target, type, label, source_cardinality, target_cardinality.
    """
    planned = network.nodes(network.KINDS["class"], records.select("g", F.lit("classes").alias("record"), "pos", "id", "label", F.lit(None).cast("string").alias("role")))
    kind, name = F.coalesce("kind", F.lit("field")), _given(F.trim("name"))
    said = F.coalesce("visibility", F.lit(""))
    own = F.when(kind == "field", F.concat_ws(" ", _given(F.trim("type")), name)).otherwise(F.concat_ws(" ", F.concat(name, F.lit("("), F.coalesce("parameters", F.lit("")), F.lit(")")), _given(F.trim("type"))))
    mark = F.when(F.col("classifier") == "static", "$").when(F.col("classifier") == "abstract", "*").otherwise("")
    syntax = F.concat_ws(" ", "name", "type", "parameters").rlike("[{};]")
    rules = first_error((name.isNull(), "member without a name"), (syntax, "member has unsupported syntax"), (~said.isin("", "+", "-", "#", "~"), "unknown visibility"), (~kind.isin("field", "method"), "unknown kind of member"))
    inside = _parts(members, F.concat(F.lit("        "), said, own, mark), rules)
    p = planned.join(inside, ["g", "id"], "left")
    head = F.concat(F.lit("    class "), F.col("emitted"), F.lit('["'), _quoted(F.col("label")), F.lit('"]'))
    line = F.when(F.col("lines").isNull(), head).otherwise(F.concat(head, F.lit(" {\n"), F.col("lines"), F.lit("\n    }")))
    r = _related(relations, planned)
    turned = F.col("type").isin("inheritance", "realization")
    pick = lambda a, b: F.when(turned, F.col(a)).otherwise(F.col(b))
    count = lambda c: F.concat(F.lit('"'), _quoted(_given(c)), F.lit('"'))
    left = F.concat_ws(" ", pick("target_emitted", "source_emitted"), count(pick("target_cardinality", "source_cardinality")))
    right = F.concat_ws(" ", count(pick("source_cardinality", "target_cardinality")), pick("source_emitted", "target_emitted"))
    label = F.coalesce(F.concat(F.lit(" : "), _quoted(_given(F.col("label")))), F.lit(""))
    sign = _of(RELATIONS, F.col("type"))
    arrows = r.select("g", "pos", F.concat(F.lit("    "), F.concat_ws(" ", left, sign, right), label).alias("line"), first_error(*_ends(), (sign.isNull(), "unknown relation")).alias("error"))
    return _code("classDiagram", p.select("g", F.lit("").alias("part"), "pos", line.alias("line"), F.coalesce("error", "wrong").alias("error")), arrows)


def entities(records: DataFrame, attributes: DataFrame, relations: DataFrame) -> DataFrame:
    """Code of entity diagrams.

    records: g, pos, id, label; attributes: g, id, pos, type, name, keys (array), comment; relations: g, pos, source, target,
    source_cardinality, target_cardinality, identifying, label.
    """
    planned = network.nodes(network.KINDS["er"], records.select("g", F.lit("entities").alias("record"), "pos", "id", "label", F.lit(None).cast("string").alias("role")))
    keys = F.coalesce("keys", F.array().cast("array<string>"))
    odd = F.exists(keys, lambda k: ~F.coalesce(k.isin(*KEYS), F.lit(False)))
    rules = first_error((_given(F.trim("type")).isNull() | _given(F.trim("name")).isNull(), "attribute without a type or name"), (odd, "unknown key"))
    comment = F.concat(F.lit('"'), _quoted(_given(F.col("comment"))), F.lit('"'))
    inside = _parts(attributes, F.concat(F.lit("        "), F.concat_ws(" ", "type", "name", _given(F.array_join(keys, ",")), comment)), rules)
    p = planned.join(inside, ["g", "id"], "left")
    head = F.concat(F.lit("    "), F.when(F.col("label") == F.col("emitted"), F.col("emitted")).otherwise(F.concat(F.col("emitted"), F.lit('["'), _quoted(F.col("label")), F.lit('"]'))))
    line = F.when(F.col("lines").isNull(), head).otherwise(F.concat(head, F.lit(" {\n"), F.col("lines"), F.lit("\n    }")))
    r = _related(relations, planned)
    a, b = _of(BEFORE, F.col("source_cardinality")), _of(AFTER, F.col("target_cardinality"))
    way = F.when(F.coalesce("identifying", F.lit(True)), "--").otherwise("..")
    edge = F.concat(F.lit("    "), F.col("source_emitted"), F.lit(" "), a, way, b, F.lit(" "), F.col("target_emitted"), F.lit(' : "'), _quoted(F.coalesce("label", F.lit(""))), F.lit('"'))
    arrows = r.select("g", "pos", edge.alias("line"), first_error(*_ends(), (a.isNull() | b.isNull(), "unknown cardinality")).alias("error"))
    return _code("erDiagram", p.select("g", F.lit("").alias("part"), "pos", line.alias("line"), F.coalesce("error", "wrong").alias("error")), arrows)


def requirements(records: DataFrame, elements: DataFrame, relations: DataFrame) -> DataFrame:
    """Code of requirement diagrams.

    records: g, pos, id, type, text, risk, method; elements: g, pos, id, type, docref; relations: g, pos, source, target, type.
    """
    none = F.lit(None).cast("string")
    one = records.select("g", F.lit("1").alias("record"), "pos", "id", F.col("text").alias("label"), none.alias("role"))
    planned = network.nodes(network.KINDS["requirement"], one.unionByName(elements.select("g", F.lit("2").alias("record"), "pos", "id", F.col("type").alias("label"), none.alias("role"))))
    names = planned.select("g", "record", "pos", "id", "emitted", "error")
    word = _of(REQUIREMENTS, F.lower(F.coalesce("type", F.lit("requirement"))))
    risk, method = F.lower(F.coalesce("risk", F.lit("medium"))), F.lower(F.coalesce("method", F.lit("analysis")))
    rules = first_error((F.col("error").isNotNull(), "duplicate id"), (word.isNull(), "unknown type"), (~risk.isin(*RISKS), "unknown risk"), (~method.isin(*METHODS), "unknown method"), (_given(F.col("text")).isNull(), "requirement without a text"))
    q = records.select("g", "pos", "type", "text", "risk", "method").join(names.filter("record = '1'"), ["g", "pos"])
    block = F.concat(word, F.lit(" "), F.col("emitted"), F.lit(' {\nid: "'), _quoted(F.col("id")), F.lit('"\ntext: "'), _quoted(F.col("text")), F.lit('"\nrisk: '), risk, F.lit("\nverifyMethod: "), method, F.lit("\n}"))
    e = elements.select("g", "pos", "type", "docref").join(names.filter("record = '2'"), ["g", "pos"])
    other = F.concat(F.lit("element "), F.col("emitted"), F.lit(' {\ntype: "'), _quoted(F.coalesce(_given(F.col("type")), F.lit("element"))), F.lit('"\ndocref: "'), _quoted(F.coalesce(_given(F.col("docref")), F.col("id"))), F.lit('"\n}'))
    lines = q.select("g", F.lit("1").alias("part"), "pos", block.alias("line"), rules.alias("error")).unionByName(e.select("g", F.lit("2").alias("part"), "pos", other.alias("line"), F.col("error")))
    r = _related(relations, planned)
    said = F.lower(F.coalesce("type", F.lit("traces")))
    edge = F.concat(F.col("source_emitted"), F.lit(" - "), said, F.lit(" -> "), F.col("target_emitted"))
    arrows = r.select("g", "pos", edge.alias("line"), first_error(*_ends(), (~said.isin(*network.KINDS["requirement"].tokens), "unknown relation")).alias("error"))
    return _code("requirementDiagram\ndirection TB", lines, arrows)
