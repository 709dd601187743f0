"""Partitioning of time series for window operators.

A daily series (key column of type DATE, one row per ticker and date) can hold
at most one row per calendar day, so `PARTITION BY ticker` is a bounded group
however large the table is.  An intraday series (TIMESTAMP key) has no such
bound: one ticker may hold a third of the table.  `open_series` therefore looks
at the type of the time column:

* DATE       -> windows run over (ticker), one exchange, no extra work;
* TIMESTAMP  -> every ticker is cut into chunks of a fixed number of rows, and
  each chunk carries a copy of the `memory` rows before it, so that operators
  with finite memory (rolling frames, lags, exponential averages) give the same
  values as over the whole series while every task stays small.

Both the position of a row and a running total need the input twice (bucket
totals, then rows), so a chain of operators would read its source 2, 4, 8, ...
times.  The input of each such step is therefore stored (`settled`): a chain
costs one write and two reads per step, however long it is.

Running totals have unbounded memory and need no copies: `running` totals each
chunk, carries the totals over the (few) chunks of a ticker and adds the carry
to the totals inside the chunk.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bourse.session import stored

CHUNK_ROWS = 65_536
#: a TIMESTAMP series is counted and summed by the hour: few rows per bucket, few buckets per ticker
POSITION_BUCKET = "hour"

_HELPERS = ("_chunk", "_copy")


@dataclass(frozen=True)
class Series:
    df: DataFrame
    keys: tuple[str, ...]
    time: str
    chunked: bool

    def w(self) -> WindowSpec:
        return Window.partitionBy(*self.keys).orderBy(self.time)

    def rows(self, n: int) -> WindowSpec:
        return self.w().rowsBetween(-(n - 1), 0)

    def upto(self) -> WindowSpec:
        return self.w().rowsBetween(Window.unboundedPreceding, 0)

    def with_columns(self, cols: dict[str, Column]) -> "Series":
        return replace(self, df=self.df.withColumns(cols)) if cols else self

    def close(self) -> DataFrame:
        """Drop copied rows and helper columns."""
        df = self.df
        if self.chunked:
            df = df.where(~F.col("_copy"))
        return df.drop(*_HELPERS)


def is_daily(df: DataFrame, time: str) -> bool:
    return isinstance(df.schema[time].dataType, T.DateType)


def require_daily(df: DataFrame, time: str = "date") -> DataFrame:
    """For operators that fold a whole series in one task: one row per day at most."""
    if not is_daily(df, time):
        raise ValueError(f"{time} must be a DATE: a longer series would not be a bounded group")
    return df


def settled(df: DataFrame) -> DataFrame:
    """The input of a step that reads it twice, stored while the plan is built."""
    return stored(df, "series")


def with_position(df: DataFrame, key: str = "ticker", time: str = "date",
                  bucket: str = POSITION_BUCKET) -> DataFrame:
    """Add `_pos`, the 0-based index of each row in its series.

    Rows are counted per (key, time bucket) first; only those counts are summed
    over a whole series, so no task ever sees all rows of one ticker.
    """
    b = settled(df.withColumn("_bucket", F.date_trunc(bucket, F.col(time))))
    before = Window.partitionBy(key).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (b.groupBy(key, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
               .select(key, "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off")))
    inside = Window.partitionBy(key, "_bucket").orderBy(time)
    return (b.join(offsets, [key, "_bucket"])
            .withColumn("_pos", F.col("_off") + F.row_number().over(inside) - 1)
            .drop("_bucket", "_off"))


def open_series(df: DataFrame, memory: int, key: str = "ticker", time: str = "date",
                chunk_rows: int | None = None) -> Series:
    """Choose the layout for operators that look back at most `memory` rows."""
    if is_daily(df, time) and chunk_rows is None:
        return Series(df, (key,), time, False)
    n = max(chunk_rows or CHUNK_ROWS, 1)
    pos = F.col("_pos")
    own = F.floor(pos / n)
    # a row is also needed by every later chunk that starts within `memory` rows
    last = F.floor((pos + memory) / n)
    laid = (with_position(df, key, time, "year" if is_daily(df, time) else POSITION_BUCKET)
            .withColumn("_own", own)
            .withColumn("_chunk", F.explode(F.sequence(own, last)))
            .withColumn("_copy", F.col("_chunk") > F.col("_own"))
            .drop("_own", "_pos"))
    return Series(laid, (key, "_chunk"), time, True)


_LOCAL = {
    "sum": F.sum,
    "count": F.count,
    "max": F.max,
    "last": lambda c: F.last(c, ignorenulls=True),
}


def _combine(kind: str, carry: Column, local: Column) -> Column:
    if kind in ("sum", "count"):
        # NULL only while nothing has been seen, like the plain window function
        return F.when(carry.isNull(), local).when(local.isNull(), carry).otherwise(carry + local)
    if kind == "max":
        return F.greatest(carry, local)
    return F.coalesce(local, carry)


def running(df: DataFrame, cols: dict[str, tuple[str, Column]], key: str = "ticker",
            time: str = "date", bucket: str | None = None) -> DataFrame:
    """Running aggregates from the start of each series.

    `cols` maps an output name to (kind, expression); kind is one of sum,
    count, max, last (last ignores NULLs).  With a TIMESTAMP key, or when
    `bucket` is given, each series is summed in time buckets with a carry.
    """
    if bucket is None and is_daily(df, time):
        w = Window.partitionBy(key).orderBy(time).rowsBetween(Window.unboundedPreceding, 0)
        return df.withColumns({o: _LOCAL[k](e).over(w) for o, (k, e) in cols.items()})
    b = df.withColumn("_bucket", F.date_trunc(bucket or POSITION_BUCKET, F.col(time)))
    b = settled(b.withColumns({f"_in_{o}": e for o, (_, e) in cols.items()}))

    def end_of(o, k):
        v = F.col(f"_in_{o}")
        if k == "last":
            return F.max_by(v, F.when(v.isNotNull(), F.col(time)))
        return _LOCAL[k](v)

    before = Window.partitionBy(key).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    ends = b.groupBy(key, "_bucket").agg(*[end_of(o, k).alias(f"_end_{o}") for o, (k, _) in cols.items()])
    carry = ends.select(key, "_bucket", *[
        _LOCAL["sum" if k == "count" else k](F.col(f"_end_{o}")).over(before).alias(f"_carry_{o}")
        for o, (k, _) in cols.items()])
    w = Window.partitionBy(key, "_bucket").orderBy(time).rowsBetween(Window.unboundedPreceding, 0)
    out = b.join(carry, [key, "_bucket"], "left")
    out = out.withColumns({o: _combine(k, F.col(f"_carry_{o}"), _LOCAL[k](F.col(f"_in_{o}")).over(w))
                           for o, (k, _) in cols.items()})
    return out.drop("_bucket", *[f"_in_{o}" for o in cols], *[f"_carry_{o}" for o in cols])
