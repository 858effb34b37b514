"""Arcs, paths, cycles and trees.

Graphs are edge rows with a graph key.  What can take exponentially many steps (paths) or must not
revisit (cycles) is a fold over one graph's distinct arcs.  Paths have budgets: a graph that exceeds one is
unavailable as a whole, never cut short.  Graphs too large for one task are tested for cycles, and trees
flattened, a level at a time over written tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.operators import folds
from loomgraph.sources.shared import settled

# fixed values: most paths and steps of a graph
PATHS, STATES = 10_000, 100_000
#: Arcs of a graph that one task holds.
ARCS = 1_000_000
#: Levels of a tree, the root's included (a fixed value).
DEPTH = 64


def arcs(relations: DataFrame, *keep: str) -> DataFrame:
    """keep, src, dst, kind: an arc for each arrow head, or one undirected pair without any.

    ``relations``: source_id, target_id, arrow_at_start, arrow_at_end; unresolved ends are left out.
    """
    s, t = F.col("source_id"), F.col("target_id")
    one = lambda a, b, kind: F.struct(a.alias("src"), b.alias("dst"), F.lit(kind).alias("kind"))
    out = F.when(~F.col("arrow_at_end") & ~F.col("arrow_at_start"), F.array(one(F.least(s, t), F.greatest(s, t), "undirected"))).otherwise(
        F.array_compact(F.array(F.when(F.col("arrow_at_end"), one(s, t, "directed")), F.when(F.col("arrow_at_start"), one(t, s, "directed"))))
    )
    return relations.filter(s.isNotNull() & t.isNotNull()).select(*keep, F.explode(out).alias("arc")).select(*keep, "arc.*")


def undirected(edges: DataFrame, *keep: str, n: str = "n") -> DataFrame:
    """keep, a, b, n: multiplicity of each unordered pair."""
    return edges.groupBy(*keep, F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg(F.sum(n).alias("n"))


def ends(edges: DataFrame, by: list[str] | None = None) -> DataFrame:
    """by, node, indegree, outdegree over distinct arcs."""
    by = by or []
    both = edges.select(*by, "src", "dst").distinct()
    sides = F.explode(F.array(F.struct(F.col("src").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("dst").alias("node"), F.lit(0).alias("o"), F.lit(1).alias("i"))))
    return both.select(*by, sides.alias("s")).groupBy(*by, "s.node").agg(F.sum("s.i").alias("indegree"), F.sum("s.o").alias("outdegree"))


def roots_and_terminals(edges: DataFrame, by: list[str] | None = None) -> DataFrame:
    """by, node, role."""
    role = F.when(F.col("indegree") == 0, "root").when(F.col("outdegree") == 0, "terminal")
    return ends(edges, by).withColumn("role", role).filter("role is not null").select(*(by or []), "node", "role")


def _arcs_of(rows, most: int | None = None) -> dict | None:
    """Adjacency of a graph, None beyond ``most`` arcs."""
    out: dict = {}
    for n, (src, dst) in enumerate(rows):
        if most is not None and n >= most:
            return None
        out.setdefault(src, []).append(dst)
        out.setdefault(dst, [])
    return out


def simple_paths(edges: DataFrame, paths: int = PATHS, states: int = STATES) -> DataFrame:
    """g, path: from every root to every terminal without a repeated node, at least two nodes; a single
    null path where the graph has too many steps or paths, each arc being a step.  edges: g, src, dst."""
    kinds = dict(edges.dtypes)

    def step(g, rows):
        to = _arcs_of(rows, states)
        if to is None:
            yield g, None
            return
        entered = {d for out in to.values() for d in out}
        found, steps = [], 0
        for root in sorted(n for n in to if n not in entered):
            trail, on, ways = [root], {root}, [iter(to[root])]
            while ways:
                nxt = next(ways[-1], None)
                if nxt is None:
                    ways.pop()
                    on.discard(trail.pop())
                    continue
                steps += 1
                if steps > states or len(found) > paths:
                    yield g, None
                    return
                if nxt in on:
                    continue
                if not to[nxt]:
                    found.append([*trail, nxt])
                    continue
                trail.append(nxt)
                on.add(nxt)
                ways.append(iter(to[nxt]))
        if len(found) > paths:
            yield g, None
            return
        for path in found:
            yield g, path

    rows = edges.select("g", "src", "dst").distinct()
    return folds.fold(rows, "g", ["src", "dst"], step, f"g {kinds['g']}, path array<{kinds['src']}>")


def path_counts(edges: DataFrame) -> DataFrame:
    """g, paths: null where there are too many; graphs without a path are not in it."""
    return simple_paths(edges).groupBy("g").agg(F.when(F.count("path") == F.count("*"), F.count("*")).alias("paths"))


def acyclic(edges: DataFrame, most: int = ARCS) -> DataFrame:
    """g, nodes, acyclic: whether taking away nodes that nothing enters leaves none.

    A graph of up to ``most`` distinct arcs is one task's.  Of larger ones all arcs from such nodes, and all to nodes
    that nothing leaves, go at a time, over written tables, as often as the longest way has arcs.
    """
    kind = dict(edges.dtypes)["g"]

    def step(g, rows):
        to = _arcs_of(rows)
        entered = dict.fromkeys(to, 0)
        for out in to.values():
            for d in out:
                entered[d] += 1
        free = [n for n, k in entered.items() if not k]
        gone = 0
        while free:
            gone += 1
            for d in to[free.pop()]:
                entered[d] -= 1
                if not entered[d]:
                    free.append(d)
        yield g, len(to), gone == len(to)

    every = settled(edges.select("g", "src", "dst").distinct(), "arcs")
    large = settled(every.groupBy("g").count().filter(F.col("count") > most).select("g"), "large")
    small = folds.fold(every.join(large, "g", "left_anti"), "g", ["src", "dst"], step, f"g {kind}, nodes long, acyclic boolean")
    if large.isEmpty():
        return small
    left = settled(every.join(large, "g", "left_semi"), "arcs")
    nodes = left.select("g", F.explode(F.array("src", "dst")).alias("n")).distinct().groupBy("g").agg(F.count("*").alias("nodes"))
    n, before = left.count(), None
    while n and n != before:
        entered, leaving = left.select("g", F.col("dst").alias("src")).distinct(), left.select("g", F.col("src").alias("dst")).distinct()
        left = settled(left.join(entered, ["g", "src"], "left_semi").join(leaving, ["g", "dst"], "left_semi").select("g", "src", "dst"), "arcs")
        n, before = left.count(), n
    cyclic = left.select("g").distinct().withColumn("cyclic", F.lit(True))
    return small.unionByName(nodes.join(cyclic, "g", "left").select("g", "nodes", F.col("cyclic").isNull().alias("acyclic")))


def preorder(tree: DataFrame, depth: int = DEPTH) -> DataFrame:
    """g, id, parent, depth (0: a root), place: preorder from the roots.  tree: g, id, parent (null: root), pos.

    A tree has ``depth`` levels at most, the roots' included: nodes one level below have a depth and no place, and what
    is under them does not appear.  Nor do nodes that no root reaches (cycles, orphans), ids that a diagram has
    twice, and what is under these.  A level is a join of the level above with the tree, both written, so a node
    with very many children is split; only the places of one diagram are ordered by one task.
    """
    t = settled(tree.select("g", "id", "parent", "pos"), "tree")
    twice = t.groupBy("g", "id").count().filter("count > 1").select("g", "id")
    t = settled(t.join(twice, ["g", "id"], "left_anti"), "tree")
    here = F.array(F.struct("pos", "id"))
    level = t.filter("parent is null").select("g", "id", "parent", F.lit(0).alias("depth"), here.alias("trail"))
    found = level.limit(0)
    for i in range(depth + 1):
        level = settled(level, "level")
        if level.isEmpty():
            break
        found = found.unionByName(level)
        above = level.select("g", F.col("id").alias("parent"), F.col("trail").alias("_above"))
        level = t.join(above, ["g", "parent"]).select("g", "id", "parent", F.lit(i + 1).alias("depth"), F.concat("_above", here).alias("trail"))
    shown = F.col("depth") < depth
    place = F.when(shown, F.row_number().over(Window.partitionBy("g", shown).orderBy("trail")))
    return found.withColumn("place", place).drop("trail")


def rollup(leaves: DataFrame, levels: list[str], value: str) -> DataFrame:
    """level (0: all), the level columns and the total of each node of a tree of fixed levels."""
    out = leaves.rollup(*levels).agg(F.sum(value).alias("total"), F.count("*").alias("leaves"), F.grouping_id().alias("_g"))
    return out.withColumn("level", (F.lit(len(levels)) - F.bit_count("_g")).cast("int")).drop("_g")


def degree_ends(edges: DataFrame, by: list[str]) -> DataFrame:
    """by, first, last: the only start and the only end of a graph, else null; self-loops do not count."""
    d = ends(edges.filter("src <> dst"), by)
    start, stop = (F.col("indegree") == 0) & (F.col("outdegree") > 0), (F.col("outdegree") == 0) & (F.col("indegree") > 0)
    one = lambda c: F.when(F.count(F.when(c, 1)) == 1, F.max(F.when(c, F.col("node"))))
    return d.groupBy(*by).agg(one(start).alias("first"), one(stop).alias("last")).withColumns({"first": F.when(F.col("last").isNotNull(), F.col("first")), "last": F.when(F.col("first").isNotNull(), F.col("last"))})


def set_column(name: str) -> Column:
    return F.array_sort(F.collect_set(name))
