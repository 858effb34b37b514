"""Review logs: edits on a timeline with a cursor, and operations on scene tables.

A bundle's events are folded in order as a stream, as each depends on the state before; what a fold
holds is one timeline of numbers, not the events.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.operators import folds

SCHEMA = "bundle long, version long, cursor int, head long, revisions int, decision string, refused int"


class State:
    """timeline, cursor, version: an edit after an undo drops what could be redone; every accepted
    operation, undo and redo too, raises the version by one."""

    def __init__(self, timeline=(-1,), cursor=0, version=0, decision="pending", refused=0):
        self.timeline, self.cursor, self.version, self.decision, self.refused = list(timeline), cursor, version, decision, refused

    def apply(self, op: str, revision: int, expected: int | None = None, target: int | None = None) -> bool:
        ok = expected is None or expected == self.version
        if ok and op == "edit":
            self.timeline = [*self.timeline[: self.cursor + 1], revision]
            self.cursor += 1
            self.decision = "pending"
        elif ok and op == "undo":
            ok = self.cursor > 0
            self.cursor -= ok
        elif ok and op == "redo":
            ok = self.cursor + 1 < len(self.timeline)
            self.cursor += ok
        elif ok and op == "checkout":
            ok = target is not None and 0 <= target < len(self.timeline)
            self.cursor = target if ok else self.cursor
        elif ok and op in ("approve", "reject"):
            self.decision = {"approve": "approved", "reject": "rejected"}[op]
        else:
            ok = False
        self.version += ok
        self.refused += not ok
        return bool(ok)

    def row(self, bundle) -> tuple:
        return bundle, self.version, self.cursor, self.timeline[self.cursor], len(self.timeline) - 1, self.decision, self.refused


def fold(log: DataFrame) -> DataFrame:
    """One row a bundle.  log: bundle, seq, op, event_id (the revision), expected_version."""

    def step(bundle, rows):
        state = State()
        for _, op, revision, expected in rows:
            state.apply(op, revision, expected)
        yield state.row(bundle)

    return folds.fold(log.select("bundle", "seq", "op", "event_id", "expected_version"), "bundle", ["seq"], step, SCHEMA)


def last_hint(hints: DataFrame, known: DataFrame) -> DataFrame:
    """bundle, node: the last hint of each node that is still there."""
    w = Window.partitionBy("bundle", "node").orderBy(F.desc("seq"))
    return hints.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n").join(known, ["bundle", "node"], "left_semi")


#: Operations, and which of id, source, target, label, members each needs besides its id.
OPERATIONS = ("add_node", "delete_node", "relabel", "add_edge", "delete_edge", "reconnect", "label_edge", "group", "ungroup")


class Scene:
    """Nodes, edges and groups by id.  An operation that does not fit the scene as it is then changes nothing."""

    def __init__(self):
        self.nodes: dict = {}
        self.edges: dict = {}
        self.groups: dict = {}

    def apply(self, op: str, id, source=None, target=None, label=None, members=None) -> bool:
        if id is None:
            return False
        if op == "add_node":
            ok = id not in self.nodes
            if ok:
                self.nodes[id] = label
        elif op == "delete_node":
            ok = id in self.nodes
            if ok:
                del self.nodes[id]
                self.edges = {k: e for k, e in self.edges.items() if id not in e[:2]}
                self.groups = {k: (name, some) for k, (name, all_) in self.groups.items() if (some := [m for m in all_ if m != id])}
        elif op == "relabel":
            ok = id in self.nodes and label is not None
            if ok:
                self.nodes[id] = label
        elif op in ("add_edge", "reconnect"):
            ok = source in self.nodes and target in self.nodes and (id in self.edges) == (op == "reconnect")
            if ok:
                self.edges[id] = (source, target, label if op == "add_edge" else self.edges[id][2])
        elif op == "delete_edge":
            ok = self.edges.pop(id, None) is not None
        elif op == "label_edge":
            ok = id in self.edges
            if ok:
                self.edges[id] = (*self.edges[id][:2], label)
        elif op == "group":
            some = members or []
            placed = {m for _, all_ in self.groups.values() for m in all_}
            ok = id not in self.groups and len(some) >= 2 and len(set(some)) == len(some) and all(m in self.nodes and m not in placed for m in some)
            if ok:
                self.groups[id] = (label, list(some))
        elif op == "ungroup":
            ok = self.groups.pop(id, None) is not None
        else:
            ok = False
        return ok


def apply_operations(nodes: DataFrame, edges: DataFrame, ops: DataFrame, groups: DataFrame | None = None) -> DataFrame:
    """bundle, kind (node, edge, group; refused: an operation that changed nothing), id, source, target, label, members.

    nodes: bundle, id, label; edges: bundle, id, source, target, label; groups: bundle, id, label, members; ops: bundle, seq, op (of
    OPERATIONS), id, source, target, label, and members if there are groups.  Each operation meets the scene that those
    before it left, so a bundle is one fold; it holds one scene.  An edge goes with either of its nodes, and a group
    with its last member; a label of null takes an edge's label away.  Scene rows that do not fit (ends that are
    unknown, ids that come twice) are refused like operations.
    """
    columns = {"id": "string", "source": "string", "target": "string", "label": "string", "members": "array<string>"}

    def as_ops(df: DataFrame, turn: int, op: str | None) -> DataFrame:
        have = [F.col(c).cast(t).alias(c) if c in df.columns else F.lit(None).cast(t).alias(c) for c, t in columns.items()]
        seq = F.col("seq").cast("long") if op is None else F.lit(0).cast("long")
        return df.select("bundle", F.lit(turn).alias("turn"), seq.alias("seq"), (F.col("op") if op is None else F.lit(op)).alias("op"), *have)

    every = as_ops(nodes, 0, "add_node").unionByName(as_ops(edges, 1, "add_edge"))
    if groups is not None:
        every = every.unionByName(as_ops(groups, 2, "group"))
    every = every.unionByName(as_ops(ops, 3, None))

    def step(bundle, rows):
        scene = Scene()
        for _, _, op, id, source, target, label, members in rows:
            if not scene.apply(op, id, source, target, label, members):
                yield bundle, "refused", id, source, target, op, members
        for id, label in scene.nodes.items():
            yield bundle, "node", id, None, None, label, None
        for id, (source, target, label) in scene.edges.items():
            yield bundle, "edge", id, source, target, label, None
        for id, (label, members) in scene.groups.items():
            yield bundle, "group", id, None, None, label, members

    kind = dict(every.dtypes)["bundle"]
    return folds.fold(every, "bundle", ["turn", "seq", "id"], step, f"bundle {kind}, kind string, " + ", ".join(f"{c} {t}" for c, t in columns.items()))
