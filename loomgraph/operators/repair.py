"""Repairs of code and scenes, each only where evidence supports it, and style recovery."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.functions import text
from loomgraph.operators import align, spatial

# fixed values: least scores of evidence for labels read by OCR, and for connectors
LABEL_SCORE, EDGE_SCORE, EVENTS = 0.8, 0.6, 8
GAIN = 1e-12


def clean_code(code: Column) -> Column:
    """Code without a byte-order mark and fence, with closed quotes and one line end; doing it again
    changes nothing."""
    out = F.regexp_replace(code, "^﻿", "")
    out = F.regexp_replace(out, r"(?s)^\s*```[A-Za-z]*[ \t]*\r?\n(.*?)\r?\n?```\s*$", "$1")
    out = F.regexp_replace(out, r"\r\n?", "\n")
    out = F.regexp_replace(out, r'(?m)(\["[^"\n\]]*)\]', '$1"]')
    return F.concat(F.regexp_replace(out, r"\s+$", ""), F.lit("\n"))


def code_events(code: Column) -> Column:
    """Names of the repairs that ``clean_code`` makes, at most EVENTS."""
    rules = [(code.startswith("﻿"), "byte order mark"), (code.rlike(r"(?s)^\s*﻿?```"), "fence"), (F.contains(code, F.lit("\r")), "line ends"), (code.rlike(r'(?m)\["[^"\n\]]*\]'), "open quote"), (~code.rlike(r"\S\n\z"), "last line end")]
    return F.slice(F.array_compact(F.array(*[F.when(c, F.lit(n)) for c, n in rules])), 1, EVENTS)


def drop_repeated_lines(lines: DataFrame) -> DataFrame:
    """g, pos, line: node lines that say exactly what an earlier one says are dropped.  lines: g, pos, line."""
    w = Window.partitionBy("g", "line").orderBy("pos")
    node = F.col("line").rlike(r'^\s*[A-Za-z0-9_]+\s*[\[({]')
    return lines.withColumn("_n", F.row_number().over(w)).filter(~node | (F.col("_n") == 1)).drop("_n")


def trusted_labels(elements: DataFrame, evidence: DataFrame) -> DataFrame:
    """page, id, text, proposed: the only trusted text inside an element that says something else.

    elements: page, id, x1, y1, x2, y2, text; evidence: page, pid, x, y, text, kind, score.
    """
    good = evidence.filter((F.col("kind") == "vector_text") | ((F.col("kind") == "ocr") & (F.col("score") >= LABEL_SCORE)))
    at = spatial.points_in_boxes(good.select("page", "pid", "x", "y", F.col("text").alias("said")), elements)
    one = at.groupBy("page", "id").agg(F.count("*").alias("n"), F.first("said").alias("proposed")).filter("n = 1").drop("n")
    both = elements.select("page", "id", "text").join(one, ["page", "id"])
    return both.filter(~text.either_contains(text.normal_label(F.col("text")), text.normal_label(F.col("proposed"))))


def trusted_edges(relations: DataFrame, evidence: DataFrame, by: list[str]) -> DataFrame:
    """by, a, b, action (reverse, add): what trusted connectors say about pairs of nodes.

    A pair counts only if it has at most one relation and one trusted connector.  relations: by,
    source_id, target_id; evidence: by, source_id, target_id, score, line_block, arrow_block.
    """
    ends = {"a": F.least("source_id", "target_id"), "b": F.greatest("source_id", "target_id")}
    r = relations.filter("source_id is not null and target_id is not null").withColumns(ends).groupBy(*by, "a", "b").agg(F.count("*").alias("nr"), F.first("source_id").alias("rs"))
    e = evidence.filter((F.col("score") >= EDGE_SCORE) & (F.col("line_block") == F.col("arrow_block"))).withColumns(ends).groupBy(*by, "a", "b").agg(F.count("*").alias("ne"), F.first("source_id").alias("es"))
    both = e.filter("ne = 1").join(r, [*by, "a", "b"], "left")
    action = F.when(F.col("nr").isNull(), "add").when((F.col("nr") == 1) & (F.col("rs") != F.col("es")), "reverse")
    return both.withColumn("action", action).filter("action is not null").select(*by, "a", "b", F.col("es").alias("source_id"), "action")


def accepted(before: Column, after: Column, semantic_before: Column, semantic_after: Column) -> Column:
    return F.coalesce((after - before > GAIN) & (semantic_after >= semantic_before), F.lit(False))


def style_pairs(source: DataFrame, target: DataFrame, by: list[str]) -> DataFrame:
    """by, source_id, target_id: by equal id, else by evidence that both alone share, else by a label
    unique on both sides; targets that two sources claim get none.

    source, target: by, id, label, evidence (array).
    """
    same = source.select(*by, "id").join(target.select(*by, "id"), [*by, "id"]).select(*by, F.col("id").alias("source_id"), F.col("id").alias("target_id"))
    s = source.join(same.select(*by, F.col("source_id").alias("id")), [*by, "id"], "left_anti")
    t = target.join(same.select(*by, F.col("target_id").alias("id")), [*by, "id"], "left_anti")
    es, et = s.select(*by, F.col("id").alias("source_id"), F.explode("evidence").alias("e")), t.select(*by, F.col("id").alias("target_id"), F.explode("evidence").alias("e"))
    shared = es.join(et, [*by, "e"]).select(*by, "source_id", "target_id").distinct()
    shared = shared.withColumn("_n", F.count("*").over(Window.partitionBy(*by, "source_id"))).filter("_n = 1").drop("_n")

    rest_s = s.join(shared.select(*by, F.col("source_id").alias("id")), [*by, "id"], "left_anti")
    rest_t = t.join(shared.select(*by, F.col("target_id").alias("id")), [*by, "id"], "left_anti")
    named = align.unique_pairs(rest_s.withColumn("_k", text.normal_label(F.col("label"))), rest_t.withColumn("_k", text.normal_label(F.col("label"))), "_k", by).select(*by, F.col("source_id"), F.col("generated_id").alias("target_id"))
    every = same.unionByName(shared).unionByName(named)
    return every.withColumn("_n", F.count("*").over(Window.partitionBy(*by, "target_id"))).filter("_n = 1").drop("_n")


def bold_support(labels: DataFrame, spans: DataFrame) -> DataFrame:
    """page, id, bold: whether the bold spans inside a box say its label, word for word in order.

    labels: page, id, x1, y1, x2, y2, label; spans: page, pid, x1, y1, x2, y2, text, bold.
    """
    s = spans.filter("bold").withColumns({"x": (F.col("x1") + F.col("x2")) / 2, "y": (F.col("y1") + F.col("y2")) / 2}).select("page", "pid", "x", "y", "text")
    at = spatial.points_in_boxes(s, labels)
    said = at.groupBy("page", "id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("y", "x", "text"))), lambda v: v["text"]), " ").alias("said"))
    out = labels.select("page", "id", "label").join(said, ["page", "id"], "left")
    return out.select("page", "id", F.coalesce(text.normal_label(F.col("said")) == text.normal_label(F.col("label")), F.lit(False)).alias("bold"))


