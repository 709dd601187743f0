"""Aggregations of the backtest, portfolio and model reports."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bourse.functions.columns import safe_div


def last_return(curve: DataFrame, value: str = "cumulative_return", name: str = "final_return") -> DataFrame:
    return curve.groupBy("ticker").agg(F.max_by(value, "date").alias(name))


def win_loss_counts(finals: DataFrame, value: str = "final_return") -> DataFrame:
    v = F.col(value)
    return (finals.agg(F.count_if(v > 0).alias("positive"), F.count_if(v <= 0).alias("negative"),
                       F.count(v).alias("total"))
            .withColumn("positive_share", safe_div(F.col("positive").cast("double"), F.col("total").cast("double"))))


def summarise_metrics(metrics: DataFrame, columns: dict[str, str]) -> DataFrame:
    """mean / min / max / population std of per-ticker metrics, one row per metric."""
    entries = F.array(*[F.struct(F.lit(label).alias("metric_name"), F.col(c).cast("double").alias("v"))
                        for c, label in columns.items()])
    long = metrics.select(F.explode(entries).alias("e")).select("e.*")
    return (long.where(F.col("v").isNotNull() & ~F.isnan("v")).groupBy("metric_name")
            .agg(F.avg("v").alias("average"), F.min("v").alias("minimum"),
                 F.max("v").alias("maximum"), F.stddev_pop("v").alias("std_dev")))


def forecast_error(df: DataFrame, actual: str = "actual", predicted: str = "predicted", by=("split",)) -> DataFrame:
    """MSE, RMSE and MAPE (terms capped at 1000 %, denominators at least 1e-6)."""
    err = F.col(predicted) - F.col(actual)
    pct = F.least(F.abs(err) / F.greatest(F.abs(F.col(actual)), F.lit(1e-6)), F.lit(10.0))
    return (df.where(F.col(actual).isNotNull() & F.col(predicted).isNotNull()).groupBy(*by)
            .agg(F.count(F.lit(1)).alias("n"), F.avg(err * err).alias("mse"),
                 F.sqrt(F.avg(err * err)).alias("rmse"), (F.avg(pct) * 100.0).alias("mape")))


def insider_scores(trades: DataFrame) -> DataFrame:
    """Buy share per ticker from the sign of the traded shares, scored 8 / 6 / 4 (5 without trades).

    Also the variant that reads the type words and gives +2 / +1 / 0 / -1.
    """
    shares = F.col("transaction_shares")
    word = F.lower("transaction_type")
    g = trades.groupBy("ticker").agg(
        F.count_if(shares > 0).alias("buys"), F.count_if(shares < 0).alias("sells"),
        F.count_if(word.isin("buy", "purchase")).alias("word_buys"),
        F.count_if(word.isin("sell", "sale")).alias("word_sells"))
    return (g.withColumn("buy_ratio", safe_div(F.col("buys").cast("double"), (F.col("buys") + F.col("sells")).cast("double")))
            .withColumn("score", insider_score(F.col("buy_ratio")))
            .withColumn("points", insider_points(F.col("word_buys"), F.col("word_sells"))))


def insider_score(ratio: Column) -> Column:
    return F.when(ratio > 0.7, 8).when(ratio > 0.4, 6).when(ratio.isNotNull(), 4).otherwise(5)


def insider_points(buys: Column, sells: Column) -> Column:
    r = safe_div(buys.cast("double"), (buys + sells).cast("double"))
    return F.when(r > 0.7, 2).when(r > 0.4, 1).when((r < 0.1) & (sells > 5), -1).otherwise(0)


def signals_map(results: DataFrame) -> DataFrame:
    """ticker -> map(agent -> (signal, confidence)); a ticker has one row per agent."""
    entry = F.struct(F.col("agent"), F.struct("signal", "confidence").alias("v"))
    return (results.where(F.col("signal").isNotNull()).groupBy("ticker")
            .agg(F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("signals")))


def distinct_tickers(df: DataFrame) -> DataFrame:
    return df.select("ticker").distinct().orderBy("ticker")


# ------------------------------------------------------------------ exact quantiles
#: half the share of the rows that the sketched range is meant to hold
MARGIN = 0.0005


def exact_quantiles(df: DataFrame, columns: list[str], q: float = 0.5) -> dict[str, float | None]:
    """Exact interpolated quantile of each column over the whole table."""
    return {c: v[0] for c, v in exact_quantile_lists(df, columns, [q]).items()}


def exact_quantile_lists(df: DataFrame, columns: list[str], shares: list[float]) -> dict[str, list[float | None]]:
    """Several exact interpolated quantiles of each column, found together.

    A quantile lies between the values at two ranks.  Each is searched by the
    same steps at every size: a mergeable sketch proposes two values around the
    rank, one aggregation counts the rows below, at, between and above them, and
    the search goes on in the part that holds the rank.  The proposed values
    themselves leave the search, so it ends on any data (ties, neighbouring
    doubles, infinities); a sketch leaves about a thousandth of the rows, so it
    ends after a few rounds.  Only a few numbers per column reach the driver; the
    columns are kept for the passes (lost blocks are recomputed).
    """
    kept = df.select(*columns).persist()
    try:
        n = kept.agg(*[F.count(c).alias(f"n{i}") for i, c in enumerate(columns)]).first()
        asked = {(c, q): q * (k - 1) for c, k in zip(columns, n, strict=True) if k for q in shares}
        wanted = sorted({(c, r) for (c, _), x in asked.items() for r in (math.floor(x), math.ceil(x))})
        at = _order_statistics(kept, wanted, dict(zip(columns, n, strict=True)))

        def value(c, q):
            x = asked.get((c, q))
            return None if x is None else _between(at[c, math.floor(x)], at[c, math.ceil(x)], x % 1)

        return {c: [value(c, q) for q in shares] for c in columns}
    finally:
        kept.unpersist()


def _between(low: float, high: float, share: float) -> float:
    return low if low == high or share == 0 else low * (1 - share) + high * share


def _order_statistics(df: DataFrame, wanted: list[tuple[str, int]], rows: dict[str, int]) -> dict[tuple[str, int], float]:
    """{(column, rank from 0): value}"""
    found = {}
    # open range of values, rows below it, rows in it
    state = {w: (None, None, 0, rows[w[0]]) for w in wanted}
    while state:
        asks = list(state.items())
        inside = [_inside(c, lo, hi) for (c, _), (lo, hi, _, _) in asks]
        shares = [(rank - below) / max(n - 1, 1) for (_, rank), (_, _, below, n) in asks]
        sketched = df.agg(*[F.percentile_approx(x, [max(s - MARGIN, 0.0), min(s + MARGIN, 1.0)], 10_000).alias(f"r{i}")
                            for i, (x, s) in enumerate(zip(inside, shares, strict=True))]).first()
        counts = df.agg(*[F.struct(*[F.count_if(e).alias(k) for k, e in (
            ("below", x < a), ("at_a", x == a), ("between", (x > a) & (x < b)), ("at_b", x == b))]).alias(f"c{i}")
            for i, (x, (a, b)) in enumerate(zip(inside, sketched, strict=True))]).first()
        for (key, (lo, hi, below, n)), (a, b), c in zip(asks, sketched, counts, strict=True):
            rank = key[1] - below
            ends = [c["below"], c["below"] + c["at_a"], c["below"] + c["at_a"] + c["between"]]
            last = ends[2] + (c["at_b"] if b != a else 0)
            if rank < ends[0]:
                state[key] = (lo, a, below, ends[0])
            elif rank < ends[1]:
                found[key] = a
            elif rank < ends[2]:
                state[key] = (a, b, below + ends[1], c["between"])
            elif rank < last:
                found[key] = b
            else:
                state[key] = (b, hi, below + last, n - last)
            if key in found:
                del state[key]
    return found


def _inside(c: str, lo: float | None, hi: float | None) -> Column:
    x = F.col(c).cast("double")
    on = F.lit(True)
    if lo is not None:
        on = on & (x > lo)
    if hi is not None:
        on = on & (x < hi)
    return F.when(on, x)


def medians(df: DataFrame, columns: list[str], spark: SparkSession | None = None) -> DataFrame:
    """(feature, median) of each column, exact."""
    spark = spark or df.sparkSession
    m = exact_quantiles(df, columns)
    return spark.createDataFrame([(c, m[c]) for c in columns], "feature string, median double")


def scaler_stats(df: DataFrame, columns: list[str]) -> DataFrame:
    """(feature, mean, scale): population std, a zero std counts as 1."""
    row = df.agg(*[F.struct(F.lit(c).alias("feature"), F.avg(c).alias("mean"),
                            F.stddev_pop(c).alias("raw_scale")).alias(f"s{i}") for i, c in enumerate(columns)])
    return (row.select(F.explode(F.array(*[F.col(f"s{i}") for i in range(len(columns))])).alias("s")).select("s.*")
            .withColumn("scale", F.when(F.col("raw_scale") == 0, 1.0).otherwise(F.col("raw_scale"))))
