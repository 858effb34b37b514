"""Portable identifiers of a diagram's records: what is emitted for each, and which cannot be told apart.

What an id becomes depends on all that were emitted before it, so a diagram's ids are folded in order; the fold
holds the names that are taken.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.functions import text
from loomgraph.operators import folds


class Names:
    """Names that are taken: a base that is gets the first suffix from 2 on that is free."""

    def __init__(self):
        self.taken: set[str] = set()
        self.tried: dict[str, int] = {}

    def take(self, base: str) -> str:
        name, k = base, self.tried.get(base, 2)
        while name in self.taken:
            name, k = f"{base}_{k}", k + 1
        # all smaller suffixes are taken for good
        self.tried[base] = k
        self.taken.add(name)
        return name


def emitted(rows: DataFrame, order: list[str], by: str = "g", id: str = "id") -> DataFrame:
    """``rows`` with ``id`` (a null or empty one is N and its place from 1) and ``emitted``, the name it gets after those before it.

    A suffix avoids what is emitted already, not what later records are called; those then get suffixes themselves.
    """
    kinds = dict(rows.dtypes)
    others = [c for c in rows.columns if c not in (by, id)]
    named = rows.withColumn("_base", text.portable(F.col(id), "")).select(by, id, "_base", *others)

    def step(key, group):
        names = Names()
        for n, (own, base, *rest) in enumerate(group, 1):
            yield key, own or f"N{n}", *rest, names.take(base or f"N{n}")

    schema = ", ".join([f"`{by}` {kinds[by]}", f"`{id}` string", *(f"`{c}` {kinds[c]}" for c in others), "emitted string"])
    return folds.fold(named, by, order, step, schema)


def ambiguous(rows: DataFrame, order: list[str], by: str = "g", id: str = "id") -> DataFrame:
    """by, id, side (source, emitted): ids that share a portable form, what these are emitted as, ids that are called like that, and so on.

    A source id that occurs twice shares its form with itself.  Null ids are left out.
    """
    kinds = dict(rows.dtypes)
    named = rows.filter(F.col(id).isNotNull()).withColumn("_base", text.portable(F.col(id))).select(by, id, "_base", *order)

    def step(key, group):
        names, placed, shared = Names(), {}, {}
        for own, base, *_ in group:
            placed.setdefault(own, []).append(names.take(base))
            shared.setdefault(base, []).append(own)
        unclear = {own for some in shared.values() if len(some) > 1 for own in some}
        called: set[str] = set()
        ahead = list(unclear)
        while ahead:
            for name in placed[ahead.pop()]:
                called.add(name)
                if name in placed and name not in unclear:
                    unclear.add(name)
                    ahead.append(name)
        for own in sorted(unclear):
            yield key, own, "source"
        for name in sorted(called):
            yield key, name, "emitted"

    return folds.fold(named, by, order, step, f"`{by}` {kinds[by]}, `{id}` string, side string")
