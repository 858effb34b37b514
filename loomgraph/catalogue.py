"""All queries by name, and the SQL that gives the same rows."""

from __future__ import annotations

from loomgraph.queries import agreement, boxes, cases, evidence, labels, logs, planners, tokens, uml, vectors  # noqa: F401  (they register themselves)
from loomgraph.queries._registry import ORACLES, QUERIES

FLAGSHIP = "edge_multiset_f1"

__all__ = ["FLAGSHIP", "ORACLES", "QUERIES"]
