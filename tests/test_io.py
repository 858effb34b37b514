"""Manifests, artifacts, scenes, sinks, streams."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from loomgraph.operators import review
from loomgraph.plans.serializers import Registry
from loomgraph.sources import manifest, sinks
from loomgraph.streaming import review as streams


def test_manifest_and_artifacts(spark, tmp_path):
    (tmp_path / "a.json").write_text("{}")
    good = hashlib.sha256(b"{}").hexdigest()
    ref = lambda p, h: {"path": p, "sha256": h}
    case = lambda i, r, g="uml": {"case_id": i, "fixture_group": g, "fixture_tiers": [], "source_origin": "real", "scope": "end_to_end", "languages": ["en"], "source": r, "ground_truth": r, "prediction": r}
    body = {"schema_version": "1", "gate_profile": "x", "corpus": {"corpus_id": "c", "version": "1", "license": "l", "split": "s"}, "cases": [case("1", ref("a.json", good)), case("2", ref("../a.json", good)), case("3", ref("a.json", "0")), case("4", ref("none", good), "poetry")]}
    (tmp_path / "m.json").write_text(json.dumps(body))
    cases = manifest.manifest(spark, f"{tmp_path}/m.json")
    assert {r.case_id: r.error for r in cases.collect()} == {"1": None, "2": None, "3": None, "4": "unknown group"}
    found = manifest.artifacts(cases, manifest.files(spark, str(tmp_path)), str(tmp_path), "source")
    assert {r.case_id: r.error for r in found.collect()} == {"1": None, "2": "path leaves the root", "3": "digest differs", "4": "no such file"}
    (tmp_path / "bad.json").write_text('{"cases": 3}')
    with pytest.raises(Exception):
        manifest.manifest(spark, f"{tmp_path}/bad.json").collect()


def test_observation_scene(spark, tmp_path):
    node = lambda i, b: {"id": i, "role": "process", "text": i, "bbox": b, "confidence": 1.0, "evidence_ids": []}
    scene = {"elements": [node("a", [0, 0, 1, 1]), node("b", [2, 0, 1, 1])], "relations": [{"id": "r", "source_id": "a", "target_id": "z"}], "groups": [{"id": "g", "label": "", "member_ids": ["a", "q"]}], "canvas_size": [10, 10]}
    (tmp_path / "o.json").write_text(json.dumps({"scene": scene}))
    tables = manifest.scene_tables(manifest.observations(spark, f"{tmp_path}/o.json"))
    assert tables["relations"].first().arrow_at_end is True
    assert {(r.error, r.id) for r in manifest.scene_errors(tables).collect()} == {("invalid box", "b"), ("unknown target_id", "r"), ("unknown member", "g")}


def test_sinks(spark, tmp_path):
    gates = spark.createDataFrame([("g", "pass", 1.0, 0.5), ("h", "unavailable", None, 0.5)], "gate string, status string, observed double, required double")
    assert sinks.report_markdown(gates).first().value.splitlines()[2:] == ["| g | pass | 1.0 | 0.5 |", "| h | unavailable |  | 0.5 |"]
    sinks.report(gates, gates, f"{tmp_path}/r")
    assert spark.read.json(f"{tmp_path}/r/gates").count() == 2
    parts = spark.createDataFrame([("s", "a", bytearray(b"x")), ("s", "b", bytearray(b"y"))], "source_id string, name string, content binary")
    assert len(sinks.bundle(parts, f"{tmp_path}/b").first().files) == 2
    with pytest.raises(Exception):
        sinks.bundle(parts, f"{tmp_path}/b")
    r = spark.range(1).select(sinks.fenced(F.lit("i.png"), F.lit("a ```` b")).alias("x"), sinks.fenced(F.lit("i.png"), F.lit(None).cast("string")).alias("y")).first()
    assert r.x.startswith("![](i.png)\n\n`````diagram\n") and r.y == "![](i.png)"
    blocks = spark.createDataFrame([(1, 2, "b"), (1, 1, "a")], "doc long, pos int, text string")
    assert sinks.document(blocks).first().markdown == "a\n\nb"


def test_registry(spark):
    r = Registry.default()
    assert len(r.names()) == 38
    with pytest.raises(KeyError):
        r.register("flowchart", lambda x: x)
    r.register("flowchart", lambda x: x, replace=True)
    assert r.plan("flowchart")(5) == 5


LOG = "bundle long, seq long, op string, event_id long, expected_version long"


def test_stream_gives_what_the_table_gives(spark, tmp_path):
    rows = [(b, s, ["edit", "undo", "redo", "edit", "approve"][(b + s) % 5], s, 0 if s % 7 == 0 else None) for b in range(4) for s in range(30)]
    df = spark.createDataFrame(rows, LOG)
    for i, lo in enumerate(range(0, 30, 10)):
        df.filter(f"seq >= {lo} and seq < {lo + 10}").coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    for i in range(3):
        spark.read.parquet(f"{tmp_path}/in/{i}").write.mode("append").parquet(f"{tmp_path}/stream")
    events = spark.readStream.schema(LOG).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/stream")
    q = streams.fold_stream(events).writeStream.outputMode("update").format("memory").queryName("folded").option("checkpointLocation", f"{tmp_path}/cp").start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    last = {}
    for r in spark.sql("select * from folded").collect():
        if r.bundle not in last or r.version + r.refused >= last[r.bundle].version + last[r.bundle].refused:
            last[r.bundle] = r
    assert {b: tuple(r) for b, r in last.items()} == {r.bundle: tuple(r) for r in review.fold(df).collect()}


def test_windows_over_a_stream(spark, tmp_path):
    e = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select(F.col("ts").cast("timestamp").alias("ts"), "event_type", "user_id")
    e.write.parquet(f"{tmp_path}/e")
    s = spark.readStream.schema(e.schema).parquet(f"{tmp_path}/e")
    for name, out in (("hours", streams.windows(s)), ("visits", streams.sessions(s))):
        q = out.writeStream.outputMode("append").format("memory").queryName(name).start()
        try:
            q.processAllAvailable()
        finally:
            q.stop()
        n, total = spark.table(name).agg(F.count("*"), F.sum("n")).first()
        assert n > 0 and total <= e.count()
