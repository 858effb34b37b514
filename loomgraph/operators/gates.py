"""Release gates: each is a name, a status, what was observed, what is required and how many cases.

A gate that lacks what it needs is unavailable; it never passes.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Gate:
    """What a gate asks of the rows that ``where`` picks.

    ``kind``: all_true (``value`` is true in all; missing is not true), all_false (true in none),
    sum_zero (adds up to 0), mean (of what is there, at least ``required``), ratio (sum of
    ``value`` over sum of ``per``, at least ``required``), ratio_max (at most), count (rows, at
    least), any (``value`` is true in one).  ``needs``: unavailable without any row, for the kinds
    that otherwise pass then.  ``complete``: unavailable if ``value`` is missing in some row.
    """

    name: str
    kind: str
    value: str = "true"
    where: str = "true"
    required: float = 1.0
    per: str = "1"
    needs: bool = False
    complete: bool = False


# fixed values: least results of the quality gates
TARGETS = {"structural_precision": 0.88, "structural_recall": 0.85, "core_type_accuracy": 0.85, "extended_type_accuracy": 0.70, "ocr_label_recall": 0.85, "edge_f1": 0.75, "path_f1": 0.65, "architecture_node_recall": 0.75, "numeric_exact_match": 0.70, "human_accept_rate": 0.70}
# fixed values: least numbers of cases by group
FIXTURES = {"flowchart": 100, "uml": 100, "architecture_c4": 80, "bpmn_swimlane": 80, "planning": 80, "data_chart": 120, "mindmap_tree": 50, "specialized": 100, "negative": 150}


# fixed values: types of which one real case each must come through
FUNCTIONAL = ("flowchart", "swimlane", "sequence", "state", "class", "er", "architecture", "c4", "requirement", "mindmap", "timeline", "gantt", "kanban", "pie", "xychart", "quadrant", "sankey", "radar", "treemap", "venn", "packet", "ishikawa")


def evaluate(rows: DataFrame, gates: list[Gate]) -> DataFrame:
    """gate, status, observed, required, sample_count: one pass over the rows for all gates."""
    aggs = []
    for i, g in enumerate(gates):
        inside = F.expr(g.where)
        truth = g.kind in ("all_true", "all_false", "any")
        v = F.coalesce(F.expr(g.value).cast("boolean"), F.lit(False)).cast("double") if truth else F.expr(g.value).cast("double")
        aggs += [
            F.count(F.when(inside, 1)).alias(f"n{i}"), F.count(F.when(inside, F.expr(g.value))).alias(f"k{i}"), F.coalesce(F.sum(F.when(inside, v)), F.lit(0.0)).alias(f"s{i}"),
            (F.sum(F.when(inside, F.expr(g.per).cast("double"))) if g.kind.startswith("ratio") else F.lit(None).cast("double")).alias(f"p{i}"),
        ]
    one = rows.agg(*aggs)
    structs = []
    for i, g in enumerate(gates):
        n, k, s, per = (F.col(f"{c}{i}") for c in "nksp")
        zero = g.kind in ("all_false", "sum_zero")
        seen = {"all_true": s / n, "all_false": s, "sum_zero": s, "mean": s / F.nullif(k, F.lit(0)), "ratio": s / F.nullif(per, F.lit(0.0)), "ratio_max": s / F.nullif(per, F.lit(0.0)), "count": n.cast("double"), "any": F.when(s > 0, 1.0).otherwise(0.0)}[g.kind]
        missing = F.lit(False) if g.kind in ("count", "any") or zero and not g.needs else n == 0
        missing = missing | seen.isNull() | (F.lit(g.complete) & (k < n))
        good = {"all_true": s == n, "all_false": s == 0, "sum_zero": s == 0, "ratio_max": seen <= g.required, "any": s > 0}.get(g.kind, seen >= g.required)
        status = F.when(F.coalesce(missing, F.lit(True)), "unavailable").when(good, "pass").otherwise("fail")
        structs.append(F.struct(F.lit(g.name).alias("gate"), status.alias("status"), F.when(status != "unavailable", F.round(seen, 9)).alias("observed"), F.lit(float(0 if zero else g.required)).alias("required"), n.alias("sample_count")))
    return one.select(F.explode(F.array(*structs)).alias("g")).select("g.*")


def overall(gates: DataFrame, by: list[str] | None = None) -> DataFrame:
    """by, status: fail if any fails, else unavailable if any is, else pass."""
    failed, missing = F.bool_or(F.col("status") == "fail"), F.bool_or(F.col("status") == "unavailable")
    return gates.groupBy(*(by or [])).agg(F.when(failed, "fail").when(missing, "unavailable").when(F.count("*") == 0, "unavailable").otherwise("pass").alias("status"))


def null_unless_all(value: str, check: Column) -> Column:
    """Mean of ``value``, null if it is missing anywhere."""
    return F.when(~F.bool_or(check), F.avg(F.col(value).cast("double")))
