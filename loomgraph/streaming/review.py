"""Streams: the review log folded as events come, and event-time windows with late data dropped.

What is folded here is what ``operators.review`` folds over a table; the state store keeps a
bundle's timeline, and a restart goes on from its checkpoint.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.operators.review import SCHEMA, State


def fold_stream(events: DataFrame) -> DataFrame:
    """The state of each bundle after each batch that touched it (output mode update).

    events: bundle, seq, op, event_id, expected_version.  Within a batch events go by seq.
    """
    names = [c.split()[0] for c in SCHEMA.split(", ")]

    def step(key, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        kept = json.loads(state.get[0]) if state.exists else None
        s = State(**kept) if kept else State()
        pdf = pd.concat(list(frames)).sort_values("seq")
        for op, revision, expected in zip(pdf.op, pdf.event_id, pdf.expected_version):
            s.apply(op, int(revision), None if pd.isna(expected) else int(expected))
        state.update((json.dumps({"timeline": s.timeline, "cursor": s.cursor, "version": s.version, "decision": s.decision, "refused": s.refused}),))
        yield pd.DataFrame([s.row(key[0])], columns=names)

    return events.groupBy("bundle").applyInPandasWithState(step, SCHEMA, "kept string", "update", "NoTimeout")


def windows(events: DataFrame, late: str = "10 minutes", size: str = "1 hour", slide: str | None = None) -> DataFrame:
    """window_start, event_type, n over event time (ts); what is later than ``late`` is dropped."""
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    return events.withWatermark("ts", late).groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), "event_type", "n")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """user_id, session_start, n of sessions that a pause ends."""
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("session_start"), "n")
