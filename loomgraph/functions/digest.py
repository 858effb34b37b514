"""Digests and canonical JSON."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def sha256(c: Column) -> Column:
    return F.sha2(c.cast("binary"), 256)


def canonical_json(**fields: Column) -> Column:
    """Compact JSON with its keys in order; nulls are kept."""
    return F.to_json(F.struct(*[fields[k].alias(k) for k in sorted(fields)]), {"ignoreNullFields": "false"})


def content_key(**fields: Column) -> Column:
    return sha256(canonical_json(**fields))
