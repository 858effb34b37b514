"""The planners by diagram type; one may be added or replaced."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from loomgraph.plans import charts, network, ordered, trees, uml


class Registry:
    """Diagram type to planner, a function of DataFrames."""

    def __init__(self):
        self._plans: dict[str, Callable] = {}

    def register(self, name: str, plan: Callable, replace: bool = False) -> None:
        if name in self._plans and not replace:
            raise KeyError(f"{name} has a planner")
        self._plans[name] = plan

    def plan(self, name: str) -> Callable:
        return self._plans[name]

    def names(self) -> list[str]:
        return sorted(self._plans)

    @classmethod
    def default(cls) -> Registry:
        out = cls()
        for name, kind in network.KINDS.items():
            if name != "organization":
                out.register(name, partial(network.nodes, kind))
        for name, plan in {
            "sequence": ordered.sequence, "zenuml": ordered.sequence, "timeline": ordered.timeline, "gantt": ordered.schedule, "journey": ordered.journey, "kanban": ordered.board, "gitgraph": ordered.git_replay, "packet": ordered.packet,
            "pie": charts.pie, "xychart": charts.xychart, "quadrant": charts.quadrant, "sankey": charts.sankey, "radar": charts.radar, "treemap": charts.treemap, "venn": charts.venn, "wardley": charts.wardley,
            "mindmap": trees.mindmap, "treeview": trees.treeview, "ishikawa": trees.ishikawa, "organization": trees.organization, "railroad": trees.railroad,
        }.items():
            out.register(name, plan)
        return out

    @classmethod
    def serializers(cls) -> Registry:
        """Those that give a diagram's code from its records."""
        out = cls()
        for name, code in {"class": uml.classes, "er": uml.entities, "requirement": uml.requirements}.items():
            out.register(name, code)
        return out
