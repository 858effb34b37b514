"""Ordered records: ranges, runs, schedules, boards, logs that are replayed."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from loomgraph.operators import review
from loomgraph.plans import ordered
from loomgraph.queries._registry import query
from loomgraph.sources import corpora


@query("""WITH f AS (SELECT l_orderkey AS g, CAST(l_quantity AS BIGINT) AS s, CAST(l_quantity AS BIGINT) + l_linenumber - 1 AS e, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_quantity, l_extendedprice, l_partkey) AS pos FROM lineitem),
p AS (SELECT *, lag(e) OVER (PARTITION BY g ORDER BY pos) AS prev FROM f)
SELECT g, CAST(count(*) AS BIGINT) AS fields, CAST(count(*) FILTER (WHERE s > e OR s <= prev) AS BIGINT) AS errors, bool_and(CASE WHEN prev IS NULL THEN s = 0 ELSE s = prev + 1 END) AS contiguous FROM p GROUP BY g""")
def packet_ranges(spark, sf_dir):
    """Bit ranges of a packet: in order, without overlap, and whether they leave no gap."""
    l = corpora.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("g"), F.col("l_quantity").cast("long").alias("start"), (F.col("l_quantity").cast("long") + F.col("l_linenumber") - 1).alias("end"), "l_linenumber", "l_quantity", "l_extendedprice", "l_partkey")  # noqa: E741
    pos = F.row_number().over(Window.partitionBy("g").orderBy("l_linenumber", "l_quantity", "l_extendedprice", "l_partkey"))
    return ordered.packet(l.withColumn("pos", pos)).select("g", "fields", "errors", "contiguous")


@query("""WITH e AS (SELECT user_id, ts, event_id, event_type = 'click' AS flag FROM events), m AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - row_number() OVER (PARTITION BY user_id, flag ORDER BY ts, event_id) AS isl FROM e)
SELECT user_id, min(ts) AS first_ts, max(ts) AS last_ts, CAST(count(*) AS BIGINT) AS n FROM m WHERE flag GROUP BY user_id, isl HAVING count(*) >= 2""")
def runs_of_true(spark, sf_dir):
    """Runs of at least two rows in a row that have a flag."""
    e = corpora.table(spark, sf_dir, "events").select("user_id", "ts", "event_id", (F.col("event_type") == "click").alias("flag"))
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    change = F.sum(F.when(F.col("flag"), 0).otherwise(1)).over(w)
    return e.withColumn("isl", change).filter("flag").groupBy("user_id", "isl").agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count("*").alias("n")).filter("n >= 2").drop("isl")


@query("""WITH t AS (SELECT l_orderkey AS g, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_extendedprice, l_quantity) AS BIGINT) AS pos, CAST(l_quantity AS BIGINT) * 86400000 AS ms, l_shipdate FROM lineitem),
r AS (SELECT g, pos, CASE WHEN pos = 1 THEN CAST(epoch_ms(l_shipdate) AS BIGINT) END AS own, ms FROM t)
SELECT g, pos, CAST(max(own) OVER (PARTITION BY g) + coalesce(sum(ms) OVER (PARTITION BY g ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start_ms, CAST(max(own) OVER (PARTITION BY g) + sum(ms) OVER (PARTITION BY g ORDER BY pos) AS BIGINT) AS end_ms FROM r""")
def gantt_schedule(spark, sf_dir):
    """Tasks of which each begins after the one before: start and end through the dependencies."""
    l = corpora.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("g"), "l_linenumber", "l_partkey", "l_extendedprice", "l_quantity", "l_shipdate")  # noqa: E741
    pos = F.row_number().over(Window.partitionBy("g").orderBy("l_linenumber", "l_partkey", "l_extendedprice", "l_quantity")).cast("long")
    t = l.withColumn("pos", pos).select("g", "pos", F.col("pos").alias("id"), F.when(F.col("pos") > 1, F.array(F.col("pos") - 1)).alias("after"), F.when(F.col("pos") == 1, F.unix_millis(F.col("l_shipdate").cast("timestamp"))).alias("start_ms"), (F.col("l_quantity").cast("long") * 86400000).alias("duration_ms"))
    return ordered.schedule(t).select("g", "pos", "start_ms", "end_ms")


@query("""WITH cards AS (SELECT doc_id AS id, lang AS col, source AS label FROM documents), cols AS (SELECT unnest(['en', 'de', 'fr', 'es', 'it']) AS col, unnest([1, 2, 3, 4, 5]) AS pos)
SELECT coalesce(cols.col, cards.col) AS col, CAST(cols.pos AS INTEGER) AS pos, CASE WHEN cols.col IS NULL THEN 'unknown column' END AS error, CAST(count(id) AS BIGINT) AS cards, coalesce(string_agg(CAST(id AS VARCHAR), ' ' ORDER BY id), '') AS ids FROM cols FULL JOIN cards ON cols.col = cards.col GROUP BY 1, 2, 3""")
def kanban_board(spark, sf_dir):
    """Cards under their columns in order; empty columns stay."""
    cards = corpora.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("lang").alias("col"), F.col("doc_id").alias("pos"))
    cols = spark.createDataFrame([("en", 1), ("de", 2), ("fr", 3), ("es", 4), ("it", 5)], "col string, pos int")
    return ordered.board(cols, cards).select("col", "pos", "error", "cards", F.array_join(F.transform("ids", lambda x: x.cast("string")), " ").alias("ids"))


@query("""SELECT conv_id, CAST(count(*) AS BIGINT) AS messages, CAST(count(DISTINCT role) AS BIGINT) AS participants, bool_and(turn = rn - 1) AS gapless, string_agg(left(role, 1), '>' ORDER BY turn) AS line
FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rn FROM conversations) GROUP BY conv_id""")
def sequence_plan(spark, sf_dir):
    """Messages in order between participants that are numbered as they come up."""
    c = corpora.table(spark, sf_dir, "conversations").select("conv_id", "turn", "role")
    return ordered.sequence(c).select("conv_id", "messages", "participants", "gapless", F.array_join(F.transform("roles", lambda r: F.left(r, F.lit(1))), ">").alias("line"))


@query("""WITH e AS (SELECT user_id, event_type, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events),
d AS (SELECT a.user_id, a.rn, a.event_type, (SELECT max(b.rn) FROM e b WHERE b.user_id = a.user_id AND b.rn < a.rn AND b.event_type = a.event_type) AS dep FROM e a)
SELECT user_id, CAST(count(*) AS BIGINT) AS tasks, CAST(count(dep) AS BIGINT) AS dependent, CAST(max(rn - dep) AS INTEGER) AS longest FROM d GROUP BY user_id""")
def earlier_dependency(spark, sf_dir):
    """Each record depends on the last before it of its kind."""
    e = corpora.table(spark, sf_dir, "events").select("user_id", "event_type", "ts", "event_id").withColumn("rn", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")))
    d = e.withColumn("dep", F.lag("rn").over(Window.partitionBy("user_id", "event_type").orderBy("rn")))
    return d.groupBy("user_id").agg(F.count("*").alias("tasks"), F.count("dep").alias("dependent"), F.max(F.col("rn") - F.col("dep")).alias("longest"))


@query("""WITH RECURSIVE l AS (SELECT user_id AS g, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq, CASE WHEN event_type IN ('click', 'view') THEN 'commit' WHEN event_type = 'purchase' THEN 'merge' ELSE 'branch' END AS op, 'b' || (event_id % 3) AS branch, 'c' || event_id AS id FROM events),
f AS (SELECT DISTINCT g, CAST(0 AS BIGINT) AS k, CAST(NULL AS VARCHAR) AS hm, CAST(NULL AS VARCHAR) AS h0, CAST(NULL AS VARCHAR) AS h1, CAST(NULL AS VARCHAR) AS h2, 'main' AS now, 0 AS commits, 0 AS merges, CAST(NULL AS VARCHAR) AS error, 0 AS done FROM l
  UNION ALL SELECT g, k + 1, CASE WHEN puts AND now = 'main' THEN id ELSE hm END,
    CASE WHEN puts AND now = 'b0' THEN id WHEN opens AND branch = 'b0' THEN coalesce(h0, cur) ELSE h0 END, CASE WHEN puts AND now = 'b1' THEN id WHEN opens AND branch = 'b1' THEN coalesce(h1, cur) ELSE h1 END,
    CASE WHEN puts AND now = 'b2' THEN id WHEN opens AND branch = 'b2' THEN coalesce(h2, cur) ELSE h2 END, CASE WHEN opens THEN branch ELSE now END, commits + CAST(puts AS INTEGER), merges + CAST(puts AND op = 'merge' AS INTEGER),
    coalesce(error, (k + 1) || ': ' || bad), done + CAST(bad IS NULL AS INTEGER)
  FROM (SELECT *, bad IS NULL AND op IN ('commit', 'merge') AS puts, bad IS NULL AND op = 'branch' AS opens
    FROM (SELECT *, CASE WHEN op = 'branch' AND cur IS NULL THEN 'branch without a commit' WHEN op = 'merge' AND (other IS NULL OR branch = now) THEN 'merge of an unknown or the same branch' WHEN op = 'merge' AND (cur IS NULL OR cur = other) THEN 'merge without different heads' END AS bad
      FROM (SELECT f.*, l.op, l.branch, l.id, CASE now WHEN 'main' THEN hm WHEN 'b0' THEN h0 WHEN 'b1' THEN h1 ELSE h2 END AS cur, CASE l.branch WHEN 'b0' THEN h0 WHEN 'b1' THEN h1 ELSE h2 END AS other FROM f JOIN l ON l.g = f.g AND l.seq = f.k + 1)))),
e AS (SELECT g, arg_max(f, k) AS s FROM f GROUP BY g)
SELECT CAST(g AS BIGINT) AS g, s.done AS operations, s.commits AS commits, CAST(1 + (s.h0 IS NOT NULL)::INT + (s.h1 IS NOT NULL)::INT + (s.h2 IS NOT NULL)::INT AS INTEGER) AS branches, s.now AS current, CASE s.now WHEN 'main' THEN s.hm WHEN 'b0' THEN s.h0 WHEN 'b1' THEN s.h1 ELSE s.h2 END AS head, s.merges AS merges, s.error AS error FROM e""")
def gitgraph_replay(spark, sf_dir):
    """Commits, branches and merges replayed: the heads of each log, or its first error."""
    kind = F.when(F.col("event_type").isin("click", "view"), "commit").when(F.col("event_type") == "purchase", "merge").otherwise("branch")
    e = corpora.table(spark, sf_dir, "events")
    log = e.select(F.col("user_id").alias("g"), F.struct("ts", "event_id").alias("_o"), "event_id", kind.alias("op"), F.concat(F.lit("b"), (F.col("event_id") % 3).cast("string")).alias("branch"))
    log = log.withColumn("seq", F.row_number().over(Window.partitionBy("g").orderBy("_o"))).select("g", "seq", "op", "branch", F.concat(F.lit("c"), F.col("event_id").cast("string")).alias("id"))
    return ordered.git_replay(log)


@query("""WITH RECURSIVE l AS (SELECT user_id AS bundle, event_id, ['edit', 'undo', 'redo', 'edit', 'approve'][event_id % 5 + 1] AS op, CASE WHEN event_id % 7 = 0 THEN 0 END AS expected, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq FROM events),
f AS (SELECT DISTINCT bundle, CAST(0 AS BIGINT) AS k, CAST(0 AS BIGINT) AS version, 0 AS cursor, CAST([-1] AS BIGINT[]) AS timeline, 'pending' AS decision, 0 AS refused FROM l
  UNION ALL SELECT bundle, k + 1, version + CAST(ok AS INTEGER), CASE WHEN NOT ok THEN cursor WHEN op IN ('edit', 'redo') THEN cursor + 1 WHEN op = 'undo' THEN cursor - 1 ELSE cursor END,
    CASE WHEN ok AND op = 'edit' THEN list_append(timeline[1:cursor + 1], event_id) ELSE timeline END, CASE WHEN ok AND op = 'edit' THEN 'pending' WHEN ok AND op = 'approve' THEN 'approved' ELSE decision END, refused + CAST(NOT ok AS INTEGER)
  FROM (SELECT f.*, l.op, l.event_id, (expected IS NULL OR expected = version) AND CASE l.op WHEN 'undo' THEN cursor > 0 WHEN 'redo' THEN cursor + 1 < len(timeline) ELSE true END AS ok FROM f JOIN l ON l.bundle = f.bundle AND l.seq = f.k + 1)),
e AS (SELECT bundle, arg_max(f, k) AS s FROM f GROUP BY bundle)
SELECT CAST(bundle AS BIGINT) AS bundle, s.version AS version, s.cursor AS cursor, s.timeline[s.cursor + 1] AS head, CAST(len(s.timeline) - 1 AS INTEGER) AS revisions, s.decision AS decision, s.refused AS refused FROM e""")
def review_fold(spark, sf_dir):
    """Edits, undo, redo and checkout folded to a state; stale edits are refused."""
    e = corpora.table(spark, sf_dir, "events")
    op = F.element_at(F.array(*map(F.lit, ["edit", "undo", "redo", "edit", "approve"])), (F.col("event_id") % 5 + 1).cast("int"))
    log = e.select(F.col("user_id").alias("bundle"), "event_id", "ts", op.alias("op"), F.when(F.col("event_id") % 7 == 0, F.lit(0)).alias("expected_version"))
    log = log.withColumn("seq", F.row_number().over(Window.partitionBy("bundle").orderBy("ts", "event_id"))).drop("ts")
    return review.fold(log.select("bundle", "seq", "op", "event_id", "expected_version"))


@query("""SELECT window_start, event_type, CAST(count(*) AS BIGINT) AS n FROM (SELECT event_type, time_bucket(INTERVAL 1 HOUR, ts) AS window_start FROM events) GROUP BY 1, 2""")
def events_tumbling(spark, sf_dir):
    """Events by hour (an addition: the same plan runs over a stream)."""
    e = corpora.table(spark, sf_dir, "events").select("event_type", "ts")
    return e.groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").cast("timestamp_ntz").alias("window_start"), "event_type", "n")


@query("""WITH e AS (SELECT user_id, event_id, CAST(round(value * 100) AS BIGINT) AS cost, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq FROM events), b AS (SELECT *, sum(cost) OVER (PARTITION BY user_id ORDER BY seq) AS used FROM e)
SELECT user_id, CAST(count(*) FILTER (WHERE used <= 50000) AS BIGINT) AS admitted, CAST(count(*) FILTER (WHERE used > 50000) AS BIGINT) AS rejected FROM b GROUP BY user_id""")
def budget_admission(spark, sf_dir):
    """Evidence is admitted in order while its costs stay within the budget."""
    e = corpora.table(spark, sf_dir, "events").select("user_id", "ts", "event_id", F.round(F.col("value") * 100).cast("long").alias("cost"))
    used = F.sum("cost").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    b = e.withColumn("used", used)
    return b.groupBy("user_id").agg(F.count(F.when(F.col("used") <= 50000, 1)).alias("admitted"), F.count(F.when(F.col("used") > 50000, 1)).alias("rejected"))


@query("""WITH h AS (SELECT user_id AS bundle, event_type AS node, event_id, value FROM events) SELECT bundle, node, CAST(max(event_id) AS BIGINT) AS version, arg_max(value, event_id) AS value FROM h GROUP BY 1, 2""")
def layout_hints(spark, sf_dir):
    """Of hints for a node the last written stays."""
    e = corpora.table(spark, sf_dir, "events")
    return e.groupBy(F.col("user_id").alias("bundle"), F.col("event_type").alias("node")).agg(F.max("event_id").alias("version"), F.max_by("value", "event_id").alias("value"))


