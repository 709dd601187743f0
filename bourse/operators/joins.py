"""As-of joins and the equi joins of the price pipeline."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bourse.operators.series import is_daily, running


def asof(left: DataFrame, right: DataFrame, values: list[str], key: str = "ticker",
         left_time: str = "asof", right_time: str = "date") -> DataFrame:
    """For each left row the values of the last right row at or before its time.

    Both sides are stacked into one series per key and the latest right row is
    carried forward, so there is no inequality join and nothing is broadcast.
    At equal times the right row counts as known.  A DATE asked of TIMESTAMP
    rows covers the whole day: its last row counts.  Of several right rows at
    one time the one with the largest values counts.

    Daily rows of a key are bounded, so one window carries them to the (distinct) times asked for; a longer
    series is first reduced to one row per time and then carried over time buckets.
    """
    if is_daily(left, left_time) and is_daily(right, right_time):
        return _asof_daily(left, right, values, key, left_time, right_time)
    t = left.schema[left_time].dataType
    rest = [c for c in left.columns if c not in (key, left_time)]
    value = F.struct(*[F.col(v) for v in values])
    asks = left.select(key, F.col(left_time).alias("_t"), F.lit(True).alias("_asked"),
                       F.lit(None).cast(right.select(value.alias("v")).schema["v"].dataType).alias("_v"),
                       F.lit(None).cast(right.schema[right_time].dataType).alias("_at"))
    known = right.select(key, F.col(right_time).cast(t).alias("_t"), F.lit(False).alias("_asked"), value.alias("_v"), F.col(right_time).alias("_at"))
    # one entry per key and time, however often it is asked for
    both = asks.unionByName(known).groupBy(key, "_t").agg(F.max("_asked").alias("_asked"), F.max(F.when(F.col("_v").isNotNull(), F.struct("_at", "_v")))["_v"].alias("_v"))
    found = running(both, {"_known": ("last", F.col("_v"))}, key, "_t").where("_asked")
    out = left.join(found.select(key, F.col("_t").alias(left_time), "_known"), [key, left_time], "left")
    return out.select(key, left_time, *rest, *[F.col(f"_known.{v}").alias(v) for v in values])


def _asof_daily(left: DataFrame, right: DataFrame, values: list[str], key: str, left_time: str, right_time: str) -> DataFrame:
    rest = [c for c in left.columns if c not in (key, left_time)]
    value = F.struct(*[F.col(v).alias(f"v{i}") for i, v in enumerate(values)])
    known = right.select(F.col(key).alias("_k"), F.col(right_time).alias("_t"), F.lit(False).alias("_asked"), value.alias("_v"))
    asks = left.select(F.col(key).alias("_k"), F.col(left_time).alias("_t")).distinct()
    both = known.unionByName(asks.withColumns({"_asked": F.lit(True), "_v": F.lit(None).cast(known.schema["_v"].dataType)}))
    upto = (Window.partitionBy("_k").orderBy("_t", "_asked", *[f"_v.v{i}" for i in range(len(values))])
            .rowsBetween(Window.unboundedPreceding, 0))
    # a row without a time is known at no time
    seen = F.last(F.when(F.col("_t").isNotNull(), F.col("_v")), ignorenulls=True).over(upto)
    found = both.withColumn("_known", seen).where("_asked").select(F.col("_k").alias(key), F.col("_t").alias(left_time), "_known")
    out = left.join(found, [key, left_time], "left")
    return out.select(key, left_time, *rest, *[F.col(f"_known.v{i}").alias(v) for i, v in enumerate(values)])


def predictions_with_prices(predictions: DataFrame, bars: DataFrame) -> DataFrame:
    """Predictions beside the bars of their date; dates without a bar stay NULL."""
    return predictions.join(bars, ["ticker", "date"], "left")


def returns_with_benchmark(returns: DataFrame, benchmark: DataFrame, value: str = "ret") -> DataFrame:
    """Strategy returns beside the benchmark's return of the same date."""
    return returns.join(benchmark.select("date", F.col(value).alias("benchmark_ret")), "date")


def with_positions(tickers: DataFrame, positions: DataFrame) -> DataFrame:
    return (tickers.join(positions, "ticker", "left")
            .withColumn("cost_basis", F.coalesce("cost_basis", F.lit(0.0))))


def index_feature(bars: DataFrame, index_values: DataFrame, column: str) -> DataFrame:
    """A market-wide value by date beside every ticker's bars."""
    return bars.join(index_values.select("date", column), "date", "left")
