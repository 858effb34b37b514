"""Evaluation manifests and what they refer to: schemas, confined reads, digests.

Files are read by Spark, with explicit schemas and failing on what does not fit; a reference is
confined by its path and held to its digest, and what fails either is an error row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

REF = "struct<path: string, sha256: string>"
CASE = f"struct<case_id: string, fixture_group: string, fixture_tiers: array<string>, source_origin: string, scope: string, languages: array<string>, source: {REF}, ground_truth: {REF}, prediction: {REF}>"
MANIFEST = f"schema_version string, gate_profile string, corpus struct<corpus_id: string, version: string, license: string, split: string>, cases array<{CASE}>"
BOX = "x1 double, y1 double, x2 double, y2 double"
ELEMENT = f"scene_id string, id string, role string, text string, {BOX}, confidence double, evidence_ids array<string>"
RELATION = "scene_id string, id string, source_id string, target_id string, relation_type string, semantic_relation string, label string, arrow_at_start boolean, arrow_at_end boolean, confidence double, evidence_ids array<string>"
GROUP = f"scene_id string, id string, role string, label string, {BOX}, member_ids array<string>"
EVIDENCE = f"case_id string, id string, kind string, {BOX}, text string, font_weight string, score double, source_block_ids array<string>"
SCENE = "struct<elements: array<struct<id: string, role: string, text: string, bbox: array<double>, confidence: double, evidence_ids: array<string>>>, relations: array<struct<id: string, source_id: string, target_id: string, relation_type: string, label: string, arrow_at_start: boolean, arrow_at_end: boolean, confidence: double>>, groups: array<struct<id: string, label: string, member_ids: array<string>>>, canvas_size: array<double>>"
OBSERVATION = f"prediction struct<candidates: array<string>, scores: array<double>>, scene {SCENE}, typed_candidates array<struct<diagram_type: string, ir: string, confidence: double>>, evidence array<struct<id: string, kind: string, bbox: array<double>, text: string, score: double, source_block_ids: array<string>>>"
GROUPS = ("flowchart", "uml", "architecture_c4", "bpmn_swimlane", "planning", "data_chart", "mindmap_tree", "specialized", "negative")
SCOPES = ("serializer", "end_to_end", "detector", "fault_probe")
#: Largest manifest, in bytes.
LARGEST = 32 << 20


def files(spark: SparkSession, path: str, pattern: str | None = None) -> DataFrame:
    """path, length, sha256, content of files below a folder."""
    r = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if pattern:
        r = r.option("pathGlobFilter", pattern)
    return r.load(path).select("path", "length", F.sha2("content", 256).alias("sha256"), "content")


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """One row a case, with an error where a closed token is not known or an id comes twice."""
    size = spark.read.format("binaryFile").load(path).agg(F.max("length").alias("n")).first()["n"]
    if size > LARGEST:
        raise ValueError(f"the manifest has {size} bytes, more than {LARGEST}")
    m = spark.read.schema(MANIFEST).json(path, multiLine=True, mode="FAILFAST")
    c = m.select("corpus.corpus_id", F.explode("cases").alias("c")).select("corpus_id", "c.*")
    from pyspark.sql import Window

    same = F.count("*").over(Window.partitionBy("case_id"))
    error = F.when(same > 1, "duplicate case").when(~F.col("fixture_group").isin(*GROUPS), "unknown group").when(~F.col("scope").isin(*SCOPES), "unknown scope")
    return c.withColumn("error", error)


def confined(path: Column) -> Column:
    """Whether a relative path stays below its root."""
    return path.isNotNull() & (path != "") & ~path.rlike(r"(^/|\\|(^|/)\.\.(/|$)|^[A-Za-z]:|\x00)")


def artifacts(cases: DataFrame, root_files: DataFrame, root: str, column: str) -> DataFrame:
    """case_id, path, content, error of what ``column`` (path, sha256) of each case refers to."""
    ref = cases.select("case_id", F.col(f"{column}.path").alias("rel"), F.col(f"{column}.sha256").alias("want"))
    base = root.rstrip("/")
    have = root_files.select(F.regexp_replace("path", "^file:/+", "/").alias("full"), "sha256", "content")
    at = ref.withColumn("full", F.concat(F.lit(base + "/"), "rel")).join(have, "full", "left")
    error = F.when(~confined(F.col("rel")), "path leaves the root").when(F.col("sha256").isNull(), "no such file").when(F.col("sha256") != F.col("want"), "digest differs")
    return at.select("case_id", F.col("rel").alias("path"), F.when(error.isNull(), F.col("content")).alias("content"), error.alias("error"))


def observations(spark: SparkSession, path: str) -> DataFrame:
    """Observations of engines, one JSON file each, under their schema."""
    return spark.read.schema(OBSERVATION).json(path, multiLine=True, mode="FAILFAST").withColumn("owner", F.col("_metadata.file_name"))


def scene_tables(rows: DataFrame, key: str = "owner", scene: str = "scene") -> dict[str, DataFrame]:
    """The elements, relations and groups of nested scenes as tables."""
    k = F.col(key).alias("scene_id")
    e = rows.select(k, F.explode(f"{scene}.elements").alias("e")).select("scene_id", "e.id", "e.role", "e.text", *[F.get("e.bbox", F.lit(i)).alias(c) for i, c in enumerate(("x1", "y1", "x2", "y2"))], "e.confidence", "e.evidence_ids")
    r = rows.select(k, F.explode(f"{scene}.relations").alias("r")).select("scene_id", "r.*")
    g = rows.select(k, F.explode(f"{scene}.groups").alias("g")).select("scene_id", "g.*")
    return {"elements": e, "relations": r.withColumns({"arrow_at_start": F.coalesce("arrow_at_start", F.lit(False)), "arrow_at_end": F.coalesce("arrow_at_end", F.lit(True))}), "groups": g}


def scene_errors(tables: dict[str, DataFrame]) -> DataFrame:
    """scene_id, error, id: ids that come twice, ends and members that are unknown, boxes that are none."""
    from loomgraph.functions import geom

    e, r, g = tables["elements"], tables["relations"], tables["groups"]
    out = e.groupBy("scene_id", "id").count().filter("count > 1").select("scene_id", F.lit("duplicate id").alias("error"), "id")
    out = out.unionByName(e.filter(~geom.valid(geom.box())).select("scene_id", F.lit("invalid box").alias("error"), "id"))
    known = e.select("scene_id", F.col("id").alias("end")).distinct()
    for end in ("source_id", "target_id"):
        out = out.unionByName(r.filter(F.col(end).isNotNull()).select("scene_id", F.col(end).alias("end"), "id").join(known, ["scene_id", "end"], "left_anti").select("scene_id", F.lit(f"unknown {end}").alias("error"), "id"))
    return out.unionByName(g.select("scene_id", "id", F.explode("member_ids").alias("end")).join(known, ["scene_id", "end"], "left_anti").select("scene_id", F.lit("unknown member").alias("error"), "id"))


def painted_text(pages: DataFrame, column: str = "svg") -> DataFrame:
    """``pages`` with ``texts``: what text elements of an SVG show, without definitions and hidden ones."""
    bare = F.regexp_replace(F.col(column), r"(?s)<(defs|symbol|clipPath|mask|marker|title|desc)\b.*?</\1>", "")
    hidden = r"(?s)<text\b[^>]*(?:display\s*[:=]\s*\"?none|visibility\s*[:=]\s*\"?hidden|opacity\s*[:=]\s*\"?0(?:\.0*)?[\";\s>])[^>]*>.*?</text>"
    shown = F.regexp_extract_all(F.regexp_replace(bare, hidden, ""), F.lit(r"(?s)<text\b[^>]*>(.*?)</text>"), F.lit(1))
    plain = lambda t: F.trim(F.regexp_replace(F.regexp_replace(t, "<[^>]*>", ""), r"\s+", " "))
    return pages.withColumn("texts", F.filter(F.transform(shown, plain), lambda t: t != ""))
