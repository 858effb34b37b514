"""Shared folders, range dealing and worker imports for the training-data operators.

Every intermediate table goes to the folder that the session names in
``spark.checkpoint.dir``; executors and the driver share nothing else.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def ready(spark: SparkSession) -> None:
    """Let Python workers import this package even if the job began in another folder."""
    env = spark.sparkContext.environment
    have = env.get("PYTHONPATH", "")
    if _ROOT not in have.split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (_ROOT, have) if x)
    env.setdefault("TOKENIZERS_PARALLELISM", "false")


def shared_root(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir`` as a URI; a local master without one gets its own."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="loomgraph-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root if "://" in root or root.startswith("file:") else "file://" + os.path.abspath(root)


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_root(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, **options) -> DataFrame:
    """``df`` as a table in the shared folder: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = new_folder(spark, name)
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def store(uri: str):
    """(file system, path) of a URI, for workers that write or read plain files."""
    import pyarrow.fs as pafs

    return pafs.FileSystem.from_uri(uri)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def id_bounds(df: DataFrame, key: str, n: int, cells: int = 1 << 14) -> list[int]:
    """Up to n - 1 distinct values of ``key`` that cut its rows into about equal ranges.

    Rows are counted by cells of equal width, before the shuffle too, and cells that have more than a range's share once more
    by finer ones; to the driver come the counts and least values of a bounded number of cells.
    """
    lean = df.select(F.col(key).cast("long").alias("k")).filter("k is not null")
    lo, hi, rows = lean.agg(F.min("k"), F.max("k"), F.count("*")).first()
    if n <= 1 or not rows:
        return []
    cells = max(cells, 4 * n)

    def counted(part: DataFrame, lo: int, hi: int) -> list[tuple[int, int]]:
        # the place of a cell grows with the key, also where doubles are coarse
        place = F.floor((F.col("k").cast("double") - float(lo)) / max(1.0, (float(hi) - float(lo) + 1) / cells))
        return sorted((r["least"], r["count"]) for r in part.groupBy(place.alias("p")).agg(F.min("k").alias("least"), F.count("*").alias("count")).collect())

    found = counted(lean, lo, hi)
    ends = [x for x, _ in found[1:]] + [hi + 1]
    fine = []
    for (least, count), end in zip(found, ends):
        wide = count > rows / n and end - least > 1
        fine += counted(lean.filter(F.col("k").between(least, end - 1)), least, end - 1) if wide else [(least, count)]
    bounds, before = [], 0
    for least, count in fine:
        # a range begins with the first cell after each share
        if before and before * n // rows > (before - last) * n // rows:
            bounds.append(least)
        last = count
        before += count
    return bounds


def range_of(key: str, bounds: list[int]):
    """The number of bounds at or below ``key`` (null: 0): the range that holds the key."""
    if not bounds:
        return F.lit(0)
    step = max(1, int(len(bounds) ** 0.5))
    coarse = bounds[::step]
    at = F.size(F.filter(F.array(*map(F.lit, coarse)), lambda b: b <= F.col(key)))
    fine = F.slice(F.array(*map(F.lit, bounds)), F.greatest(at - 1, F.lit(0)) * step + 1, step)
    inside = F.size(F.filter(fine, lambda b: b <= F.col(key)))
    return F.when(F.col(key).isNull() | (at == 0), F.lit(0)).otherwise((at - 1) * step + inside).cast("int")
