"""Evaluation cases: metrics, grades, decisions, gates, choice of candidates."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from loomgraph.functions import digest, policy
from loomgraph.operators import gates
from loomgraph.plans import release
from loomgraph.queries._registry import query
from loomgraph.sources import corpora

C = "WITH c AS (SELECT d.doc_id AS case_id, lang, source, n_chars, quality, toxic FROM documents d LEFT JOIN labels l USING (doc_id))"
# metric values in percent, some missing
METRIC = {"syntax": "100", "render": "case_id % 2 * 100", "ocr": "CASE WHEN quality IS NOT NULL THEN n_chars % 101 END", "edge": "CASE WHEN case_id % 3 <> 0 AND quality IS NOT NULL THEN case_id * 7 % 101 END", "type": "CASE WHEN quality IS NOT NULL THEN quality * 100 END"}


def _metrics():
    return {k: F.expr(v).cast("double") / 100 for k, v in METRIC.items()}


def _weighted_sql(names):
    have = lambda m: f"CASE WHEN ({METRIC[m]}) IS NOT NULL THEN CAST({policy.WEIGHTS[m]} AS DOUBLE) ELSE CAST(0 AS DOUBLE) END"
    num = " + ".join(f"coalesce(CAST(({METRIC[m]}) AS DOUBLE) / 100 * CAST({policy.WEIGHTS[m]} AS DOUBLE), 0)" for m in names)
    den = " + ".join(have(m) for m in names)
    any_ = " OR ".join(f"({METRIC[m]}) IS NOT NULL" for m in names if m not in policy.FORMAL)
    return f"CASE WHEN {any_} THEN ({num}) / ({den}) END"


SCORED = C + f", s AS (SELECT *, {_weighted_sql(list(METRIC))} AS aggregate, {_weighted_sql([m for m in METRIC if m not in policy.FORMAL])} AS semantic FROM c), q AS (SELECT *, CASE WHEN aggregate IS NULL THEN 'U' WHEN aggregate >= 0.85 THEN 'A' WHEN aggregate >= 0.7 THEN 'B' WHEN aggregate >= 0.5 THEN 'C' ELSE 'D' END AS grade FROM s)"


def _scored(spark, sf_dir):
    m = _metrics()
    c = corpora.cases(spark, sf_dir).withColumns({"aggregate": policy.weighted(m), "semantic": policy.weighted(m, semantic_only=True)})
    return c.withColumn("grade", policy.grade(F.col("aggregate")))


@query(SCORED + " SELECT case_id, round(aggregate, 9) AS aggregate, round(semantic, 9) AS semantic, grade FROM q")
def quality_grade(spark, sf_dir):
    """Weighted means over the metrics that are available, and the grade."""
    return _scored(spark, sf_dir).select("case_id", F.round("aggregate", 9).alias("aggregate"), F.round("semantic", 9).alias("semantic"), "grade")


@query(SCORED + """, p AS (SELECT *, CASE case_id % 4 WHEN 0 THEN 'strict' WHEN 1 THEN 'best_effort' WHEN 2 THEN 'review_required' ELSE 'sidecar_only' END AS policy, case_id % 11 <> 0 AS candidate, case_id % 2 = 1 AS sound FROM q),
d AS (SELECT case_id, policy, CASE WHEN NOT candidate THEN 'none' WHEN NOT sound THEN 'review' WHEN policy = 'sidecar_only' THEN 'none' WHEN policy = 'review_required' THEN 'review' WHEN aggregate IS NULL OR grade IN ('D', 'U') OR semantic IS NULL THEN 'review'
  WHEN policy = 'strict' THEN CASE WHEN aggregate >= 0.7 AND semantic >= 0.7 THEN 'publish' ELSE 'review' END WHEN aggregate >= 0.5 AND semantic >= 0.5 THEN 'publish' ELSE 'review' END AS decision FROM p) SELECT * FROM d""")
def publish_decision(spark, sf_dir):
    """What becomes of a result under each policy."""
    kind = F.element_at(F.array(*map(F.lit, ["strict", "best_effort", "review_required", "sidecar_only"])), (F.col("case_id") % 4 + 1).cast("int"))
    q = _scored(spark, sf_dir).withColumn("policy", kind)
    return q.select("case_id", "policy", policy.decision(F.col("case_id") % 11 != 0, F.col("case_id") % 2 == 1, F.col("policy"), F.col("aggregate"), F.col("semantic")).alias("decision"))


@query(C + " SELECT lang, source, CAST(count(*) AS BIGINT) AS cases, CAST(count(quality) AS BIGINT) AS selected, round(avg(CAST(quality AS DOUBLE)), 9) AS accuracy FROM c GROUP BY 1, 2")
def type_accuracy(spark, sf_dir):
    """Share of right types among the cases that have one; null when none has."""
    return corpora.cases(spark, sf_dir).groupBy("lang", "source").agg(F.count("*").alias("cases"), F.count("quality").alias("selected"), F.round(F.avg(F.col("quality").cast("double")), 9).alias("accuracy"))


@query(C + " SELECT lang, source, n_chars % 3 AS k, CASE WHEN count(*) = count(quality) THEN round(avg(CAST(quality AS DOUBLE)), 9) END AS rate FROM c GROUP BY 1, 2, 3")
def accept_rate_or_null(spark, sf_dir):
    """Acceptance rate, null if any case lacks a verdict."""
    return corpora.cases(spark, sf_dir).groupBy("lang", "source", (F.col("n_chars") % 3).alias("k")).agg(F.round(gates.null_unless_all("quality", F.col("quality").isNull()), 9).alias("rate"))


GATES = [
    gates.Gate("labels_are_valid", "all_true", "quality in (0, 1)", "quality is not null"),
    gates.Gate("none_is_empty", "all_false", "n_chars = 0"),
    gates.Gate("no_toxic_english", "sum_zero", "toxic", "lang = 'en' and toxic is not null"),
    gates.Gate("type_accuracy", "mean", "quality", "quality is not null", gates.TARGETS["core_type_accuracy"]),
    gates.Gate("accept_rate", "mean", "quality", "lang = 'de'", gates.TARGETS["human_accept_rate"], complete=True),
    gates.Gate("enough_cases", "count", "1", "lang = 'fr'", gates.FIXTURES["flowchart"]),
    gates.Gate("enough_negatives", "count", "1", "toxic = 1", gates.FIXTURES["negative"]),
    gates.Gate("no_such_language", "all_true", "true", "lang = 'xx'"),
    gates.Gate("none_of_such_language", "all_false", "true", "lang = 'xx'"),
    gates.Gate("some_of_such_language", "all_false", "true", "lang = 'xx'", needs=True),
]


def _gate_sql(g, table="c"):
    w, zero = g.where, g.kind in ("all_false", "sum_zero")
    v = f"CAST(coalesce(CAST(({g.value}) AS BOOLEAN), false) AS DOUBLE)" if g.kind in ("all_true", "all_false", "any") else f"CAST(({g.value}) AS DOUBLE)"
    n, k = f"count(*) FILTER (WHERE {w})", f"count({g.value}) FILTER (WHERE {w})"
    s = f"coalesce(sum({v}) FILTER (WHERE {w}), 0)"
    per = f"nullif(sum(CAST(({g.per}) AS DOUBLE)) FILTER (WHERE {w}), 0)"
    seen = {"all_true": f"{s} / nullif({n}, 0)", "all_false": s, "sum_zero": s, "mean": f"{s} / nullif({k}, 0)", "ratio": f"{s} / {per}", "ratio_max": f"{s} / {per}", "count": f"CAST({n} AS DOUBLE)", "any": f"CASE WHEN {s} > 0 THEN 1.0 ELSE 0.0 END"}[g.kind]
    good = {"all_true": f"{s} = {n}", "all_false": f"{s} = 0", "sum_zero": f"{s} = 0", "ratio_max": f"{seen} <= {g.required}", "any": f"{s} > 0"}.get(g.kind, f"{seen} >= {g.required}")
    missing = ["false" if g.kind in ("count", "any") or zero and not g.needs else f"{n} = 0", f"({seen}) IS NULL", *([f"{k} < {n}"] if g.complete else [])]
    missing = "(" + " OR ".join(missing) + ")"
    return f"SELECT '{g.name}' AS gate, CASE WHEN {missing} THEN 'unavailable' WHEN {good} THEN 'pass' ELSE 'fail' END AS status, CAST(CASE WHEN NOT {missing} THEN round({seen}, 9) END AS DOUBLE) AS observed, CAST({0 if zero else g.required} AS DOUBLE) AS required, CAST({n} AS BIGINT) AS sample_count FROM {table}"


GATE_SQL = C + ", g AS (" + " UNION ALL ".join(map(_gate_sql, GATES)) + ")"


@query(GATE_SQL + " SELECT * FROM g")
def gate_table(spark, sf_dir):
    """All gates in one pass over the cases."""
    return gates.evaluate(corpora.cases(spark, sf_dir), GATES)


@query(GATE_SQL + " SELECT CASE WHEN bool_or(status = 'fail') THEN 'fail' WHEN bool_or(status = 'unavailable') THEN 'unavailable' ELSE 'pass' END AS status FROM g")
def overall_status(spark, sf_dir):
    """Fail over unavailable over pass."""
    return gates.overall(gates.evaluate(corpora.cases(spark, sf_dir), GATES))


@query(SCORED + " SELECT lang, source, CAST(count(*) FILTER (WHERE grade = 'U') AS BIGINT) AS unavailable, CAST(count(*) FILTER (WHERE grade IN ('A', 'B')) AS BIGINT) AS good, round(avg(aggregate), 9) AS mean FROM q GROUP BY ROLLUP (lang, source)")
def grade_rollup(spark, sf_dir):
    """Grades by language and source, with the totals above."""
    q = _scored(spark, sf_dir)
    return q.rollup("lang", "source").agg(F.count(F.when(F.col("grade") == "U", 1)).alias("unavailable"), F.count(F.when(F.col("grade").isin("A", "B"), 1)).alias("good"), F.round(F.avg("aggregate"), 9).alias("mean"))


CAND = SCORED + ", k AS (SELECT *, case_id // 4 AS grp, case_id % 2 = 1 AS sound, case_id % 3 AS method, semantic >= 0.5 AS publishable FROM q)"


def _candidates(spark, sf_dir):
    i = F.col("case_id")
    return _scored(spark, sf_dir).withColumns({"grp": F.floor(i / 4).cast("long"), "sound": i % 2 == 1, "method": (i % 3), "publishable": F.col("semantic") >= 0.5})


@query(CAND + " SELECT grp, case_id, grade FROM (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY coalesce(publishable, false) DESC, coalesce(aggregate, -1) DESC, coalesce(semantic, -1) DESC, method, case_id) AS rn FROM k WHERE sound) WHERE rn = 1")
def candidate_select(spark, sf_dir):
    """The best sound candidate of each source."""
    k = _candidates(spark, sf_dir).filter("sound")
    w = Window.partitionBy("grp").orderBy(F.coalesce("publishable", F.lit(False)).desc(), F.coalesce("aggregate", F.lit(-1.0)).desc(), F.coalesce("semantic", F.lit(-1.0)).desc(), "method", "case_id")
    return k.withColumn("rn", F.row_number().over(w)).filter("rn = 1").select("grp", "case_id", "grade")


@query("""WITH k AS (SELECT doc_id AS id, doc_id // 12 AS source_id, doc_id % 3 AS method, text AS code FROM documents), u AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source_id, code ORDER BY method, id) AS d FROM k) WHERE d = 1),
r AS (SELECT *, row_number() OVER (PARTITION BY source_id, method ORDER BY id) AS turn FROM u), o AS (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY turn, method) AS place FROM r)
SELECT source_id, id, CAST(place AS INTEGER) AS place FROM o WHERE place <= 3""")
def candidate_round_robin(spark, sf_dir):
    """Three distinct candidates of each source, its methods taking turns."""
    k = corpora.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.floor(F.col("doc_id") / 12).cast("long").alias("source_id"), (F.col("doc_id") % 3).alias("method"), digest.sha256(F.col("text")).alias("code"))
    u = k.groupBy("source_id", "code").agg(F.min(F.struct("method", "id")).alias("m")).select("source_id", "m.*")
    r = u.withColumn("turn", F.row_number().over(Window.partitionBy("source_id", "method").orderBy("id")))
    o = r.withColumn("place", F.row_number().over(Window.partitionBy("source_id").orderBy("turn", "method")))
    return o.filter("place <= 3").select("source_id", "id", "place")


@query(SCORED + ", b AS (SELECT case_id, aggregate AS a0, semantic AS s0, lead(aggregate) OVER (PARTITION BY case_id // 5 ORDER BY case_id) AS a1, lead(semantic) OVER (PARTITION BY case_id // 5 ORDER BY case_id) AS s1 FROM q) SELECT case_id, a1 - a0 > 1e-12 AND s1 >= s0 AS accepted FROM b WHERE a0 IS NOT NULL AND a1 IS NOT NULL")
def repair_accept(spark, sf_dir):
    """A repair is taken if the aggregate goes up and the semantic score does not go down."""
    w = Window.partitionBy(F.floor(F.col("case_id") / 5)).orderBy("case_id")
    b = _scored(spark, sf_dir).select("case_id", F.col("aggregate").alias("a0"), F.col("semantic").alias("s0"), F.lead("aggregate").over(w).alias("a1"), F.lead("semantic").over(w).alias("s1"))
    return b.filter("a0 is not null and a1 is not null").select("case_id", ((F.col("a1") - F.col("a0") > 1e-12) & (F.col("s1") >= F.col("s0"))).alias("accepted"))


@query(C + ", p AS (SELECT case_id, unnest(['flowchart', 'sequence', 'pie', 'gantt']) AS kind, unnest([case_id % 10, n_chars % 10, case_id * 3 % 10, n_chars * 7 % 10]) AS score FROM c) SELECT case_id, kind, CAST(rn AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY score DESC, kind) AS rn FROM p) WHERE rn <= 2 AND kind <> 'gantt'")
def type_top_k(spark, sf_dir):
    """The first two predicted types of each case that are enabled."""
    i, n = F.col("case_id"), F.col("n_chars")
    scores = {"flowchart": i % 10, "sequence": n % 10, "pie": i * 3 % 10, "gantt": n * 7 % 10}
    ordered = F.array_sort(F.array(*[F.struct((-s).alias("s"), F.lit(k).alias("kind")) for k, s in scores.items()]))
    p = corpora.cases(spark, sf_dir).select("case_id", F.posexplode(F.slice(ordered, 1, 2)).alias("pos", "p"))
    return p.select("case_id", F.col("p.kind").alias("kind"), (F.col("pos") + 1).alias("rank")).filter("kind <> 'gantt'")


@query("""SELECT l_orderkey % 500 AS case_id, CAST(count(*) FILTER (WHERE l_returnflag = 'A') AS BIGINT) AS tp, CAST(count(*) FILTER (WHERE l_returnflag = 'N') AS BIGINT) AS fp, CAST(count(*) FILTER (WHERE l_returnflag = 'R') AS BIGINT) AS fn,
  round(2.0 * count(*) FILTER (WHERE l_returnflag = 'A') / nullif(2 * count(*) FILTER (WHERE l_returnflag = 'A') + count(*) FILTER (WHERE l_returnflag IN ('N', 'R')), 0), 9) AS f1 FROM lineitem GROUP BY 1""")
def case_metrics(spark, sf_dir):
    """True and false findings by case, and their F1."""
    f = lambda *x: F.count(F.when(F.col("l_returnflag").isin(*x), 1))
    den = F.nullif(2 * f("A") + f("N", "R"), F.lit(0).cast("long"))
    return corpora.table(spark, sf_dir, "lineitem").groupBy((F.col("l_orderkey") % 500).alias("case_id")).agg(f("A").alias("tp"), f("N").alias("fp"), f("R").alias("fn"), F.round(2.0 * f("A") / den, 9).alias("f1"))


# columns of a release corpus, made up from documents in a way that any engine computes alike
RELEASE = {
    "case_id": "doc_id", "scope": "CASE doc_id % 7 WHEN 0 THEN 'detector' WHEN 1 THEN 'serializer' WHEN 2 THEN 'fault_probe' ELSE 'end_to_end' END", "expected": "doc_id % 5 <> 0",
    "fixture_group": "CASE doc_id % 9 WHEN 0 THEN 'flowchart' WHEN 1 THEN 'uml' WHEN 2 THEN 'architecture_c4' WHEN 3 THEN 'bpmn_swimlane' WHEN 4 THEN 'planning' WHEN 5 THEN 'data_chart' WHEN 6 THEN 'mindmap_tree' WHEN 7 THEN 'specialized' ELSE 'negative' END",
    "origin": "CASE WHEN doc_id % 3 = 0 THEN 'real' ELSE 'synthetic' END", "kind": "CASE doc_id % 4 WHEN 0 THEN 'flowchart' WHEN 1 THEN 'architecture' WHEN 2 THEN 'pie' ELSE 'state' END", "said": "CASE n_chars % 4 WHEN 0 THEN 'flowchart' WHEN 1 THEN 'architecture' WHEN 2 THEN 'pie' ELSE 'state' END",
    "stability": "CASE doc_id % 3 WHEN 0 THEN 'core' WHEN 1 THEN 'extended' ELSE 'experimental' END", "reconstructed": "n_chars % 10 <> 0", "published": "n_chars % 10 > 2", "syntax_valid": "n_chars % 10 <> 3", "render_valid": "CASE WHEN n_chars % 11 <> 0 THEN n_chars % 10 <> 4 END", "grade": "CASE n_chars % 5 WHEN 0 THEN 'A' WHEN 1 THEN 'B' WHEN 2 THEN 'C' WHEN 3 THEN 'D' ELSE 'U' END",
    "original_preserved": "true", "document_failed": "false", "forbidden_actions": "0", "duplicate_insertions": "CAST(n_chars % 97 = 0 AS INT)", "orphans": "0", "over_budget": "false", "nodes": "n_chars % 13", "supported": "n_chars % 13 - CAST(n_chars % 3 = 0 AND n_chars % 13 > 0 AS INT)", "warned": "n_chars % 2 = 0", "sidecar": "true", "reviewable": "true", "precision": "CASE WHEN n_chars % 6 <> 0 THEN 0.5 END",
    "elements": "n_chars % 13 + 1", "texts": "n_chars % 3", "labels": "n_chars % 3", "numeric": "CASE WHEN n_chars % 8 <> 0 THEN n_chars % 2 = 0 END", "accepted": "n_chars % 4 <> 0", "tp": "n_chars % 17", "fp": "n_chars % 3", "fn": "n_chars % 4", "edge_tp": "n_chars % 19", "edge_fp": "n_chars % 5", "edge_fn": "n_chars % 2", "path_tp": "n_chars % 23", "path_fp": "n_chars % 5", "path_fn": "n_chars % 7", "path_applies": "n_chars % 3 = 0", "path_known": "true", "ocr_found": "n_chars % 29", "ocr_wanted": "n_chars % 29 + n_chars % 4", "node_found": "n_chars % 11", "node_wanted": "n_chars % 11 + n_chars % 2", "numbers_equal": "n_chars % 5 <> 0",
}
RELEASE_SQL = "WITH r AS (SELECT " + ", ".join(f"{v} AS {k}" for k, v in RELEASE.items()) + " FROM documents), g AS (" + " UNION ALL ".join(f"SELECT '{s}' AS section, * FROM ({_gate_sql(g, 'r')})" for s, gs in release.SECTIONS.items() for g in gs) + ")"


@query(RELEASE_SQL + " SELECT * FROM g")
def release_gates(spark, sf_dir):
    """All gates of a release over a corpus of evaluated cases, in one pass."""
    d = corpora.table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    return release.evaluate(d.select(*[F.expr(v).alias(k) for k, v in RELEASE.items()]))


@query(RELEASE_SQL + " SELECT section, CASE WHEN bool_or(status = 'fail') THEN 'fail' WHEN bool_or(status = 'unavailable') THEN 'unavailable' ELSE 'pass' END AS status FROM g GROUP BY section")
def release_sections(spark, sf_dir):
    """The status of each section of a release."""
    return gates.overall(release_gates(spark, sf_dir), ["section"])
