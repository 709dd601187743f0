"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bourse.session import stored  # noqa: F401  (shared by the operators)

#: rows turned into Python objects at a time, so that an Arrow batch of long texts is never held twice
STEP = 256


def documents(spark: SparkSession, sf_dir: str, table: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def col(name: str) -> Column:
    """A column by its literal name (dots and blanks included)."""
    return F.col("`" + name.replace("`", "``") + "`")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names like `names` that `df` does not have."""
    taken, out = {c.lower() for c in df.columns}, []
    for n in names:
        while n.lower() in taken:
            n = f"_{n}"
        taken.add(n.lower())
        out.append(n)
    return out


def pieces(batches: Iterator[pa.RecordBatch], step: int = STEP) -> Iterator[pa.RecordBatch]:
    """The rows of Arrow batches, a few at a time."""
    for b in batches:
        for at in range(0, b.num_rows, step):
            yield b.slice(at, step)


def small(df: DataFrame, rows: int) -> DataFrame:
    """`df` marked for broadcast if it has at most `rows` rows (it is counted); else as it is, for a shuffled join."""
    return F.broadcast(df) if df.count() <= rows else df
