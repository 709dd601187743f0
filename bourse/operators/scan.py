"""Running combinations of rows by any associative operation, as window columns.

Running totals cover what windows offer (sums, counts, maxima).  A fold whose step is linear in its state, a best
path, or a chain of look-ups is none of these, but its steps can be combined pairwise in any grouping:
(a . b) . c = a . (b . c).  `scanned` therefore gives every row the combination of all rows up to it by doubling
strides: after step k a row holds the combination of the last RADIX**k rows, so a chunk of n rows takes
log(n) window columns over one partitioning, with one exchange and one sort.

A daily series is one chunk (a ticker has at most one row a day).  Of a longer series every chunk's total is a row
of the next level, and the totals before a chunk are carried into it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from bourse.operators.series import POSITION_BUCKET, is_daily, with_position

RADIX = 4
#: rows of a daily series (717 years), and of a chunk of a longer one
DAILY_ROWS, CHUNK = RADIX ** 9, RADIX ** 6

State = dict[str, Column]


def _columns(names: list[str], tag: str = "") -> State:
    return {n: F.col(n + tag) for n in names}


def _doubled(df: DataFrame, names: list[str], combine: Callable[[State, State], State], identity: dict, keys: list[str], order: Column, rows: int) -> DataFrame:
    """Every row combined with all rows before it in its partition of at most `rows` rows."""
    window, stride = W.partitionBy(*keys).orderBy(order), 1
    rest = [F.col(f"`{c}`") for c in df.columns if c not in names]
    while stride < rows:
        # three strides back, in two halves that are combined at once
        back = [F.lag(n, stride * j, identity[n]).over(window).alias(f"{n}__{j}") for j in range(1, RADIX) for n in names]
        df = df.select("*", *back)
        early, late = combine(_columns(names, "__3"), _columns(names, "__2")), combine(_columns(names, "__1"), _columns(names))
        df = df.select(*rest, *[c.alias(f"{n}__e") for n, c in early.items()], *[c.alias(f"{n}__l") for n, c in late.items()])
        both = combine(_columns(names, "__e"), _columns(names, "__l"))
        df = df.select(*rest, *[c.alias(n) for n, c in both.items()])
        stride *= RADIX
    return df


def _levels(df: DataFrame, names, combine, identity, key: str, rows: int, highest: int, reverse: bool) -> DataFrame:
    """`df` with positions 0 to `highest` in `_pos`, in chunks of `rows`."""
    order = F.col("_pos").desc() if reverse else F.col("_pos").asc()
    if highest < rows:
        return _doubled(df, names, combine, identity, [key], order, rows)
    df = df.withColumn("_chunk_no", F.floor(F.col("_pos") / rows))
    local = _doubled(df, names, combine, identity, [key, "_chunk_no"], order, rows)
    last = F.lead("_pos").over(W.partitionBy(key, "_chunk_no").orderBy(order)).isNull()
    totals = (local.withColumn("_last", last).where("_last")
              .select(key, F.col("_chunk_no").alias("_pos"), *names))
    carried = _levels(totals, names, combine, identity, key, rows, highest // rows, reverse).select(
        key, (F.col("_pos") + (-1 if reverse else 1)).alias("_chunk_no"), *[F.col(n).alias(f"{n}__in") for n in names])
    before = {n: F.coalesce(F.col(f"{n}__in"), F.lit(identity[n])) for n in names}
    return local.join(carried, [key, "_chunk_no"], "left").withColumns(combine(before, _columns(names))).drop("_chunk_no", *[f"{n}__in" for n in names])


def scanned(df: DataFrame, state: State, combine: Callable[[State, State], State], identity: dict, key: str = "ticker", time: str = "date",
            reverse: bool = False, chunk: int | None = None) -> DataFrame:
    """`df` with the columns of `state` combined over all rows of the series up to (`reverse`: from) each row.

    `combine` takes the earlier and the later state in the direction of the scan; `identity` holds
    plain values that change nothing.  A TIMESTAMP series, or any with `chunk`, is worked on in chunks.
    """
    names = list(state)
    if is_daily(df, time) and chunk is None:
        order = F.col(time).desc() if reverse else F.col(time).asc()
        return _doubled(df.withColumns(state), names, combine, identity, [key], order, DAILY_ROWS)
    placed = with_position(df, key, time, "year" if is_daily(df, time) else POSITION_BUCKET).withColumns(state)
    highest = placed.agg(F.max("_pos")).first()[0] or 0
    return _levels(placed, names, combine, identity, key, max(2, chunk or CHUNK), highest, reverse).drop("_pos")
