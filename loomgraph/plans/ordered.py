"""Plans whose records have an order: sequences, packets, timelines, schedules, boards, journeys,
commit logs.  Plans never raise: what is wrong is counted or named in a column."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.operators import folds



def sequence(messages: DataFrame) -> DataFrame:
    """conv_id, messages, participants, gapless, roles (in order)."""
    ordered = F.array_sort(F.collect_list(F.struct("turn", "role")))
    by = messages.groupBy("conv_id").agg(ordered.alias("m"))
    gapless = F.forall(F.sequence(F.lit(1), F.size("m")), lambda i: F.element_at("m", i)["turn"] == i - 1)
    roles = F.transform("m", lambda x: x["role"])
    return by.select("conv_id", F.size("m").cast("long").alias("messages"), F.size(F.array_distinct(roles)).cast("long").alias("participants"), gapless.alias("gapless"), roles.alias("roles"))


def participants(rows: DataFrame) -> DataFrame:
    """g, pos, id, label, emitted, error: missing ids are P1, P2, ... by position, missing labels the
    id; an id that occurs twice is an error; emitted ids are ordinals."""
    id_ = F.coalesce(F.col("id"), F.concat(F.lit("P"), F.col("pos").cast("string")))
    w = Window.partitionBy("g")
    out = rows.withColumn("id", id_).withColumn("label", F.coalesce("label", "id"))
    n = F.count("*").over(Window.partitionBy("g", "id"))
    place = F.row_number().over(w.orderBy("pos"))
    return out.select("g", "pos", "id", "label", F.concat(F.lit("p"), place.cast("string")).alias("emitted"), F.when(n > 1, "duplicate id").alias("error"))


def packet(fields: DataFrame) -> DataFrame:
    """g, fields, errors (turned round, or not after the field before), contiguous."""
    prev = F.lag("end").over(Window.partitionBy("g").orderBy("pos"))
    f = fields.withColumn("prev", prev)
    bad = (F.col("start") > F.col("end")) | F.coalesce(F.col("start") <= F.col("prev"), F.lit(False))
    joined = F.when(F.col("prev").isNull(), F.col("start") == 0).otherwise(F.col("start") == F.col("prev") + 1)
    return f.groupBy("g").agg(F.count("*").alias("fields"), F.count(F.when(bad, 1)).alias("errors"), F.bool_and(joined).alias("contiguous"))


def schedule(tasks: DataFrame) -> DataFrame:
    """g, pos, id, start_ms, end_ms, error: a task begins at its own start or at the latest end of
    those it is after, which must come before it.

    tasks: g, pos, id, after (array of ids or null), start_ms, duration_ms.  Ends depend on ends, so
    each group is worked through in its order in one task.
    """

    def step(g, rows):
        done = {}
        for pos, id_, after, start, size in rows:
            error = begin = end = None
            if id_ in done:
                error = "duplicate id"
            elif after:
                ends = [done.get(a) for a in after]
                if None in ends:
                    error = "dependency is not earlier"
                elif start is not None:
                    error = "both start and dependency"
                else:
                    begin = max(ends)
            elif start is None:
                error = "no start"
            else:
                begin = start
            if error is None and size is None:
                error = "no duration"
            elif error is None:
                end = begin + size
            done.setdefault(id_, end)
            yield g, pos, id_, begin, end, error

    schema = "g long, pos long, id long, start_ms long, end_ms long, error string"
    return folds.fold(tasks.select("g", "pos", "id", "after", "start_ms", "duration_ms"), "g", ["pos"], step, schema)


def board(columns: DataFrame, cards: DataFrame) -> DataFrame:
    """col, pos, cards, ids in order, error of every column; cards of an unknown column are under its name, as an error."""
    ordered = F.transform(F.array_sort(F.collect_list(F.when(F.col("id").isNotNull(), F.struct("cpos", "id")))), lambda x: x["id"])
    c = cards.select(F.col("col").alias("ccol"), F.col("pos").alias("cpos"), "id")
    met = columns.withColumn("known", F.lit(True)).join(c, columns["col"].eqNullSafe(c["ccol"]), "full")
    met = met.withColumns({"col": F.coalesce("col", "ccol"), "error": F.when(F.col("known").isNull(), "unknown column")})
    return met.groupBy("col", "pos", "error").agg(F.count("id").alias("cards"), ordered.alias("ids"))


def timeline(rows: DataFrame) -> DataFrame:
    """g, place, period, events: periods in the order in which they first come, with their events."""
    by = rows.groupBy("g", "period").agg(F.min("pos").alias("first"), F.transform(F.array_sort(F.collect_list(F.struct("pos", "event"))), lambda x: x["event"]).alias("events"))
    return by.select("g", F.row_number().over(Window.partitionBy("g").orderBy("first")).alias("place"), "period", "events")


def journey(rows: DataFrame, low: int = 1, high: int = 5) -> DataFrame:
    """g, section, tasks, mean, actors, errors: scores must be whole numbers from ``low`` to ``high``."""
    bad = F.col("score").isNull() | ~F.col("score").between(low, high)
    return rows.groupBy("g", "section").agg(F.count("*").alias("tasks"), F.round(F.avg(F.when(~bad, F.col("score"))), 9).alias("mean"), F.array_sort(F.collect_set("actor")).alias("actors"), F.count(F.when(bad, 1)).alias("errors"))


GIT = "g long, operations int, commits int, branches int, current string, head string, merges int, error string"


def git_replay(log: DataFrame, strict: bool = False) -> DataFrame:
    """One row a log.  log: g, seq, op (commit, branch, merge, checkout), branch, id.

    The first branch is main.  A commit needs a known branch, a branch a commit to start from, a
    merge two branches with different heads, and commit ids are unique.  What breaks a rule is
    skipped and counts as the first error; with ``strict`` the log ends there.
    """

    def step(g, rows):
        heads, now, ids, merges, error, done = {"main": None}, "main", set(), 0, None, 0
        for seq, op, branch, id_ in rows:
            bad = None
            if op == "commit":
                bad = "commit id is taken" if id_ in ids else None
            elif op == "branch":
                bad = "branch without a commit" if heads[now] is None else None
            elif op == "merge":
                if branch not in heads or branch == now:
                    bad = "merge of an unknown or the same branch"
                elif None in (heads[branch], heads[now]) or heads[branch] == heads[now]:
                    bad = "merge without different heads"
                elif id_ in ids:
                    bad = "commit id is taken"
            elif op == "checkout":
                bad = None if branch in heads else "unknown branch"
            else:
                bad = "unknown operation"
            if bad:
                error = error or f"{seq}: {bad}"
                if strict:
                    break
                continue
            done += 1
            if op in ("commit", "merge"):
                ids.add(id_)
                heads[now] = id_
                merges += op == "merge"
            else:
                heads.setdefault(branch, heads[now])
                now = branch
        yield g, done, len(ids), len(heads), now, heads[now], merges, error

    return folds.fold(log.select("g", "seq", "op", "branch", "id"), "g", ["seq"], step, GIT)


def emit(rows: DataFrame, by: str, order: list[str], line: str = "line") -> DataFrame:
    """by, code: lines joined in order, one text a group."""
    lines = F.transform(F.array_sort(F.collect_list(F.struct(*order, line))), lambda x: x[line])
    return rows.groupBy(by).agg(F.array_join(lines, "\n").alias("code"))


