"""Root fields that a typed diagram's JSON must have, and their kinds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# fixed values: required root fields by type
ROOTS = {
    "flowchart": {"nodes": "list"},
    "generic_network": {"nodes": "list"},
    "swimlane": {"lanes": "list"},
    "bpmn": {"lanes": "list"},
    "sequence": {"participants": "list", "messages": "list"},
    "state": {"states": "list", "transitions": "list"},
    "class": {"classes": "list"},
    "er": {"entities": "list"},
    "architecture": {"services": "list"},
    "c4": {"elements": "list"},
    "requirement": {"requirements": "list"},
    "block": {"blocks": "list"},
    "deployment": {"nodes": "list"},
    "component": {"components": "list"},
    "usecase": {"actors": "list", "use_cases": "list"},
    "mindmap": {"root": "object"},
    "timeline": {"events": "list"},
    "gantt": {"sections": "list"},
    "journey": {"sections": "list"},
    "kanban": {"columns": "list", "cards": "list"},
    "gitgraph": {"initial_branch": "string", "operations": "list"},
    "pie": {"slices": "list"},
    "xychart": {"x_axis": "object", "y_axis": "object", "series": "list"},
    "quadrant": {"x_axis": "object", "y_axis": "object", "points": "list"},
    "sankey": {"nodes": "list", "flows": "list"},
    "radar": {"dimensions": "list", "series": "list"},
    "treemap": {"root": "object"},
    "venn": {"sets": "list", "intersections": "list"},
    "packet": {"fields": "list"},
    "ishikawa": {"effect": "object", "categories": "list"},
    "wardley": {"components": "list"},
    "cynefin": {"domains": "list"},
    "treeview": {"root": "object"},
    "eventmodeling": {"lanes": "list"},
    "zenuml": {"participants": "list", "messages": "list"},
    "railroad": {"rules": "list"},
    "organization": {"root": "object"},
    "data_lineage": {"datasets": "list", "relations": "list"},
}
KINDS = {"list": ("ARRAY", "a list"), "object": ("OBJECT", "an object"), "string": ("STRING", "a string")}


def check(rows: DataFrame, kind: str = "diagram_type", ir: str = "ir") -> DataFrame:
    """``rows`` with ``error``: the first root field that is missing or of another kind; null if none.

    The JSON is parsed once, to a variant, whose own kinds are asked.
    """
    v = rows.withColumn("_v", F.try_parse_json(F.col(ir)))
    whole = F.schema_of_variant("_v")
    error = F.when(~F.col(kind).isin(*ROOTS) | F.col(kind).isNull(), "no contract").when(F.col("_v").isNull() | ~F.startswith(whole, F.lit("OBJECT")), "not an object")
    for name, fields in ROOTS.items():
        for field, wanted in fields.items():
            have = F.try_variant_get("_v", f"$.{field}", "variant")
            sign, said = KINDS[wanted]
            error = error.when((F.col(kind) == name) & have.isNull(), f"{field}: missing").when((F.col(kind) == name) & ~F.startswith(F.schema_of_variant(have), F.lit(sign)), f"{field}: not {said}")
    return v.withColumn("error", error).drop("_v")
