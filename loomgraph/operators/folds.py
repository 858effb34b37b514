"""Ordered folds: a group's rows in order through one Python function, as a stream.

Rows are dealt by key and sorted in their partition, and a group is an iterator over Arrow batches:
nothing but the fold's own state is held, however long a group is, and many small groups cost no
more than their rows.
"""

from __future__ import annotations

from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema


def fold(rows: DataFrame, key: str, order: list[str], step, schema: str, batch: int = 4096) -> DataFrame:
    """What ``step(key, rows)`` yields (tuples) for each group.  Rows are tuples of the columns
    without the key, in the order of ``order``."""
    others = [c for c in rows.columns if c != key]
    out = to_arrow_schema(T._parse_datatype_string(schema))

    def stream(batches):
        for b in batches:
            yield from zip(*[b.column(i).to_pylist() for i in range(b.num_columns)])

    def run(batches):
        held = []
        for k, group in groupby(stream(batches), key=lambda r: r[0]):
            for row in step(k, (r[1:] for r in group)):
                held.append(row)
                if len(held) >= batch:
                    yield _made(held, out)
                    held = []
        if held:
            yield _made(held, out)

    dealt = rows.select(key, *others).repartition(key).sortWithinPartitions(key, *order)
    return dealt.mapInArrow(run, schema)


def _made(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
