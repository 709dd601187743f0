"""Window operators on bars: labels, returns, sequences, pooling, de-duplication."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bourse.functions.columns import safe_div
from bourse.operators.series import is_daily, open_series, running, with_position


def returns_and_range(bars: DataFrame) -> DataFrame:
    """Return (relative change of close) and Range (high - low); first bars dropped."""
    s = open_series(bars, memory=1)
    s = s.with_columns({"ret": safe_div("close", F.lag("close").over(s.w())) - 1.0,
                        "range": F.col("high") - F.col("low")})
    return s.close().dropna(subset=["ret", "range"])


def add_label(bars: DataFrame, horizon: int = 5, direction: str = "lead", name: str = "shifted_prices") -> DataFrame:
    """Close `horizon` bars ahead (`lead`) or back (`lag`)."""
    if direction not in ("lead", "lag"):
        raise ValueError("direction must be 'lead' or 'lag'")
    h = abs(horizon)
    if direction == "lag" or is_daily(bars, "date"):
        s = open_series(bars, memory=h)
        fn = F.lead if direction == "lead" else F.lag
        return s.with_columns({name: fn("close", h).over(s.w())}).close()
    # a chunk carries rows before it, not after it: look the future bar up by position
    p = with_position(bars)
    future = p.select("ticker", (F.col("_pos") - h).alias("_pos"), F.col("close").alias(name))
    return p.join(future, ["ticker", "_pos"], "left").drop("_pos")


def cumulative_return(df: DataFrame, ret: str = "ret", name: str = "cumulative_return") -> DataFrame:
    """(prod(1 + r) - 1) * 100 from the start of each series."""
    out = running(df, {"_g": ("sum", F.log1p(F.when(F.col(ret) > -1.0, F.col(ret)))),
                       "_ruin": ("max", F.when(F.col(ret) <= -1.0, 1).otherwise(0))})
    grown = F.coalesce(F.expm1("_g"), F.lit(0.0))
    return out.withColumn(name, F.when(F.col("_ruin") == 1, F.lit(-100.0)).otherwise(grown * 100.0)).drop("_g", "_ruin")


def sequences(df: DataFrame, features: list[str], window: int, padding: str = "zero", name: str = "seq") -> DataFrame:
    """Per row the last `window` feature vectors, padded on the left at the start.

    Padding: zeros, the mean of the rows so far, or the first row repeated.
    """
    if padding not in ("zero", "mean", "repeat"):
        raise ValueError("padding must be zero, mean or repeat")
    s = open_series(df, memory=window)
    vec = F.array(*[F.col(f).cast("double") for f in features])
    seq = F.collect_list(vec).over(s.rows(window))
    s = s.with_columns({"_seq": seq})
    got = F.col("_seq")
    if padding == "zero":
        fill = F.array(*[F.lit(0.0) for _ in features])
    elif padding == "repeat":
        fill = got[0]
    else:
        fill = F.array(*[_mean_of(F.transform(got, _nth(i))) for i in range(len(features))])
    s = s.with_columns({name: F.concat(F.array_repeat(fill, F.lit(window) - F.size(got)), got)})
    return s.close().drop("_seq")


def _nth(i: int):
    return lambda v: v[i]


def _mean_of(arr: Column) -> Column:
    return F.aggregate(arr, F.lit(0.0), lambda acc, x: acc + x) / F.size(arr)


def past_sequences(df: DataFrame, features: list[str], window: int, name: str = "seq") -> DataFrame:
    """Per row the `window` vectors before it; rows without a full window are dropped."""
    s = open_series(df, memory=window)
    vec = F.array(*[F.col(f).cast("double") for f in features])
    s = s.with_columns({name: F.collect_list(vec).over(s.w().rowsBetween(-window, -1))})
    return s.close().where(F.size(name) == window)


def downsample(df: DataFrame, features: list[str], factor: int) -> DataFrame:
    """Average of each `factor` consecutive rows; the last group is filled up with zeros."""
    if is_daily(df, "date"):
        w = Window.partitionBy("ticker").orderBy("date")
        pos = df.withColumn("_pos", F.row_number().over(w) - 1)
    else:
        pos = with_position(df)
    return (pos.groupBy("ticker", F.floor(F.col("_pos") / factor).alias("step"))
            .agg(F.min("date").alias("start"),
                 *[(F.sum(f) / F.lit(float(factor))).alias(f) for f in features]))


def keep_first(df: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """One row per key, the first in `order`.

    A min_by aggregation instead of a window: repeated keys are reduced before
    the shuffle, however many copies one key has.
    """
    rest = [c for c in df.columns if c not in key]
    row = F.struct(*[F.col(c) for c in rest])
    return df.groupBy(*key).agg(F.min_by(row, F.struct(*order)).alias("_r")).select(*key, "_r.*")


def ordered_distinct(df: DataFrame, value: str, position: str) -> DataFrame:
    """Distinct values with the position of their first appearance."""
    return df.groupBy(value).agg(F.min(position).alias(position))
