"""Reports, bundles and documents written through Spark's commit protocol."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.functions import digest


def report(gates: DataFrame, cases: DataFrame, path: str) -> None:
    """The gates and the cases of a report as JSON, each a folder that is replaced as a whole."""
    gates.write.mode("overwrite").json(f"{path}/gates")
    cases.write.mode("overwrite").json(f"{path}/cases")


def report_markdown(gates: DataFrame) -> DataFrame:
    """value: a table of the gates, one row of text."""
    line = F.format_string("| %s | %s | %s | %s |", "gate", "status", F.coalesce(F.col("observed").cast("string"), F.lit("")), F.col("required").cast("string"))
    rows = gates.groupBy().agg(F.array_sort(F.collect_list(line)).alias("rows"))
    return rows.select(F.concat_ws("\n", F.lit("| gate | status | observed | required |"), F.lit("| --- | --- | --- | --- |"), F.array_join("rows", "\n")).alias("value"))


def bundle(artifacts: DataFrame, path: str) -> DataFrame:
    """Artifacts (source_id, name, content) by source, and their manifest: source_id, names, digest.

    Nothing is overwritten: a bundle that is there is an error.
    """
    artifacts.write.mode("errorifexists").partitionBy("source_id").parquet(f"{path}/artifacts")
    hashed = artifacts.select("source_id", "name", digest.sha256(F.col("content")).alias("sha256"), F.octet_length("content").alias("bytes"))
    manifest = hashed.groupBy("source_id").agg(F.array_sort(F.collect_list(F.struct("name", "sha256", "bytes"))).alias("files"))
    manifest = manifest.withColumn("digest", F.sha2(F.to_json("files"), 256))
    manifest.write.mode("errorifexists").json(f"{path}/manifest")
    return artifacts.sparkSession.read.json(f"{path}/manifest")


def fenced(image: Column, code: Column, language: str = "diagram") -> Column:
    """Markdown of a reconstruction: its image first, then at most one fence, longer than any in it."""
    inside = F.regexp_extract_all(code, F.lit("(`{3,})"), F.lit(1))
    fence = F.rpad(F.lit(""), F.greatest(F.lit(3), F.coalesce(F.array_max(F.transform(inside, F.length)), F.lit(0)) + 1), "`")
    shown = F.concat(F.lit("![]("), image, F.lit(")"))
    return F.when(code.isNull(), shown).otherwise(F.concat(shown, F.lit("\n\n"), fence, F.lit(language + "\n"), code, F.lit("\n"), fence))


def document(blocks: DataFrame) -> DataFrame:
    """doc, markdown: blocks (doc, pos, text) joined in order."""
    return blocks.groupBy("doc").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda b: b["text"]), "\n\n").alias("markdown"))
