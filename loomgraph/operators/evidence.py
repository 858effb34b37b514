"""Which evidence goes into a prompt: quotas of items, and a budget of characters.

First the critical items (user edits and trusted connectors) up to an eighth of the slots, then structural ones, whose
kinds take turns, up to a quarter of what is left, then all by rank.  An item that the characters do not allow is
passed over and does not count toward a quota; none is looked at twice.
"""

from __future__ import annotations

from itertools import zip_longest

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.operators import folds

# fixed values: rank of kinds (after user edits 0, trusted connectors 1, trusted labels 2), and the structural kinds in their turns
RANKS = {"user_edit": 0, "arrowhead": 3, "line_segment": 4, "contour": 5, "vector_text": 6, "source_crop": 7, "ocr_token": 8, "vlm_observation": 9}
STRUCTURAL = ("arrowhead", "line_segment", "contour", "vector_text")


class Budget:
    """Items and characters that are left; each item after the first needs a comma."""

    def __init__(self, items: int, chars: int, least: int):
        self.items, self.chars, self.least = items, chars, least
        self.taken: list = []
        self.seen: set = set()
        self.full = False

    def offer(self, item) -> bool:
        """Whether the item is taken now."""
        index, size = item[0], item[1]
        if self.full or index in self.seen:
            return False
        comma = 1 if self.taken else 0
        if self.chars < self.least + comma:
            self.full = True
            return False
        self.seen.add(index)
        if size + comma > self.chars:
            return False
        self.chars -= size + comma
        self.taken.append(item)
        return True


def chosen(items: list[tuple], most: int, chars: int, least: int) -> list[tuple]:
    """(item, phase) in the order in which they are taken.  items: (index, size, kind, trust) by index."""
    rank = lambda x: (0 if x[2] == "user_edit" else {"connector": 1, "label": 2}.get(x[3], RANKS.get(x[2], 9)), x[0])
    ranked = sorted(items, key=rank)
    critical = [x for x in ranked if x[2] == "user_edit" or x[3] == "connector"]
    turns = zip_longest(*([x for x in items if x[2] == kind] for kind in STRUCTURAL))
    structural = [x for turn in turns for x in turn if x is not None]
    budget, phases = Budget(most, chars, least), {}

    def take(some, name, quota):
        n = 0
        for x in some:
            if n >= quota or budget.full:
                return
            if budget.offer(x):
                phases[x[0]] = name
                n += 1

    take(critical, "critical", min(len(critical), max(1, most // 8)))
    left = max(0, most - len(budget.taken))
    take(structural, "structural", (left + 3) // 4)
    take(ranked, "ranked", most - len(budget.taken))
    return [(x, phases[x[0]]) for x in budget.taken]


def select(rows: DataFrame, most: int, chars: int, least: int = 1) -> DataFrame:
    """g, index, place, phase of the evidence that is taken.

    rows: g, index, kind, trust (connector, label or null), size (characters); ``least``: characters that the smallest item needs.
    The order depends on what fitted before, so an observation is one fold; it holds four values an item.
    """
    kinds = dict(rows.dtypes)

    def step(g, group):
        items = [(index, size, kind, trust) for index, kind, trust, size in group]
        for place, (x, phase) in enumerate(chosen(items, most, chars, least), 1):
            yield g, x[0], place, phase

    lean = rows.select("g", F.col("index").cast("long").alias("index"), "kind", "trust", F.col("size").cast("long").alias("size"))
    return folds.fold(lean, "g", ["index"], step, f"g {kinds['g']}, index long, place int, phase string")
