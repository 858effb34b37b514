"""Fusing what several engines saw of one diagram: evidence, types, elements, relations, ids.

Which source is believed depends on the aspect: positions follow one ranking, meaning another.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# fixed values: who is believed about positions, about meaning, and by how much about types
GEOMETRY_RANK = {"vector": 5, "geometry": 4, "other": 3, "vlm": 2, "ocr": 1}
SEMANTIC_RANK = {"vlm": 5, "other": 4, "vector": 3, "geometry": 2, "ocr": 1}
TYPE_WEIGHT = {"vector": 1.0, "geometry": 0.9, "ocr": 0.5, "vlm": 1.0, "other": 0.75}
# fixed values: most references of a record, and the overlap below which a match is noted
REFERENCES, DOUBTFUL = 256, 0.2


def ranked(source: Column, ranks: dict) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in ranks.items() for x in kv]), source)


def merge_evidence(rows: DataFrame, by: list[str]) -> DataFrame:
    """by, id, payload of the believed source, blocks (all, or the winner's alone above the cap), best
    score, collision (claimed more than once), conflict (with different payloads).

    rows: by, source, owner, id, payload, score, blocks (array).
    """
    rank = F.struct(ranked(F.col("source"), GEOMETRY_RANK).alias("r"), F.col("score"), F.col("owner"))
    m = rows.withColumn("_r", rank).groupBy(*by, "id").agg(
        F.max_by("payload", "_r").alias("payload"), F.max_by("blocks", "_r").alias("_w"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("blocks")))).alias("_all"),
        F.max("score").alias("score"), (F.count("*") > 1).alias("collision"), (F.count_distinct("payload") > 1).alias("conflict"),
    )
    return m.withColumn("blocks", F.when(F.size("_all") <= REFERENCES, F.col("_all")).otherwise(F.col("_w"))).drop("_all", "_w")


def fuse_types(rows: DataFrame, by: list[str]) -> DataFrame:
    """by, diagram_type, score, rank: weighted by all inputs, not only those that name the type.

    rows: by, owner, source, diagram_type, score.
    """
    w = ranked(F.col("source"), TYPE_WEIGHT)
    mass = rows.select(*by, "owner", "source", w.alias("w")).distinct().groupBy(*by).agg(F.sum("w").alias("mass"))
    s = rows.groupBy(*by, "diagram_type").agg(F.sum(F.col("score") * w).alias("s")).join(mass, by)
    order = Window.partitionBy(*by).orderBy(F.desc("score"), "diagram_type")
    return s.select(*by, "diagram_type", (F.col("s") / F.col("mass")).alias("score")).withColumn("rank", F.row_number().over(order))


def fuse_elements(rows: DataFrame, by: list[str]) -> DataFrame:
    """by, cluster: the box of the source best believed about positions, the role of the one best
    believed about meaning that has one, all evidence, best confidence.

    rows: by, cluster, source, owner, id, x1, y1, x2, y2, role, confidence, evidence (array).
    """
    g = F.struct(ranked(F.col("source"), GEOMETRY_RANK).alias("r"), F.col("owner"), F.col("id"))
    m = F.when(F.col("role").isNotNull() & (F.col("role") != "unknown"), F.struct(ranked(F.col("source"), SEMANTIC_RANK).alias("r"), F.col("owner"), F.col("id")))
    out = rows.withColumns({"_g": g, "_m": m}).groupBy(*by, "cluster").agg(
        F.max_by(F.struct("id", "x1", "y1", "x2", "y2"), "_g").alias("_b"), F.max_by("role", "_m").alias("role"), F.max("confidence").alias("confidence"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("evidence")))).alias("evidence"), F.count("*").alias("seen"),
    )
    return out.select(*by, "cluster", "_b.*", "role", "confidence", "evidence", "seen")


def fuse_relations(rows: DataFrame, by: list[str]) -> DataFrame:
    """by, a, b, label, source_id, target_id, conflict: relations between the same two nodes with labels
    that fit are one; different directions make a conflict, and so do several on one pair.

    rows: by, source, owner, id, source_id, target_id, label, confidence.  An unlabelled relation
    joins the only labelled one of its pair.
    """
    r = rows.withColumns({"a": F.least("source_id", "target_id"), "b": F.greatest("source_id", "target_id"), "lab": F.coalesce(F.lower(F.trim("label")), F.lit(""))})
    pair = Window.partitionBy(*by, "a", "b")
    names = F.array_remove(F.collect_set("lab").over(pair), "")
    r = r.withColumn("lab", F.when((F.col("lab") == "") & (F.size(names) == 1), names[0]).otherwise(F.col("lab")))
    rank = F.struct(ranked(F.col("source"), SEMANTIC_RANK).alias("r"), F.col("confidence"), F.col("owner"), F.col("id"))
    m = r.withColumn("_r", rank).groupBy(*by, "a", "b", "lab").agg(F.max_by(F.struct("source_id", "target_id"), "_r").alias("_w"), F.count_distinct("source_id").alias("_d"), F.max("confidence").alias("confidence"))
    many = F.count("*").over(pair) > 1
    self = F.col("a") == F.col("b")
    return m.select(*by, "a", "b", F.nullif("lab", F.lit("")).alias("label"), "_w.*", "confidence", (((F.col("_d") > 1) | many) & ~self).alias("conflict"))


def group_key(members: Column) -> Column:
    """Groups are one if their sorted members are."""
    return F.array_join(F.array_sort(F.array_distinct(members)), "\x1f")


def harmonise_ids(rows: DataFrame, mapping: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
    """``rows`` with ids rewritten, all or nothing: a scene whose mapping is no bijection stays as it is.

    mapping: by, old, new.
    """
    good = mapping.groupBy(*by).agg((F.count("*") == F.count_distinct("old")).alias("x"), (F.count("*") == F.count_distinct("new")).alias("y")).filter("x and y").select(*by)
    use = mapping.join(good, by, "left_semi")
    for c in columns:
        rows = rows.join(use.select(*by, F.col("old").alias(c), F.col("new").alias("_n")), [*by, c], "left").withColumn(c, F.coalesce("_n", c)).drop("_n")
    return rows


def ordered_candidates(rows: DataFrame, by: list[str]) -> DataFrame:
    """``rows`` with place: by type, those with a mapping first, then confidence, how far the source is believed, and key.

    rows: by, key, source, diagram_type, mapped (boolean), confidence.
    """
    rank = ranked(F.col("source"), SEMANTIC_RANK)
    order = Window.partitionBy(*by).orderBy("diagram_type", F.desc("mapped"), F.desc("confidence"), F.desc(rank), "key")
    return rows.withColumn("place", F.row_number().over(order))


def shared_authority(inputs: DataFrame, by: list[str]) -> DataFrame:
    """by, id: evidence that every input of a scene may publish; a scene with an input that names none (null) has no rows.

    inputs: by, input, ids (array).  Ids are counted, so no scene's sets meet in one row.
    """
    scenes = inputs.groupBy(*by).agg(F.count("*").alias("_n"), F.bool_or(F.col("ids").isNull()).alias("_open")).filter("not _open")
    seen = inputs.select(*by, F.explode(F.array_distinct("ids")).alias("id")).groupBy(*by, "id").agg(F.count("*").alias("_seen"))
    return seen.join(scenes, by).filter("_seen = _n").select(*by, "id")
