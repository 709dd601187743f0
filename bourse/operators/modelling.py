"""Model tables: chronological split, cleaning, scaling, a linear baseline, scoring."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bourse.functions.columns import total
from bourse.operators.aggregates import exact_quantiles, scaler_stats
from bourse.operators.series import open_series
from bourse.operators.windows import past_sequences


def chrono_split(df: DataFrame, val: float = 0.1, test: float = 0.1, date: str = "date") -> DataFrame:
    """Add `split` (train / val / test): the newest rows are the test set.

    Rows are counted per day first; the running count then runs over one row
    per calendar day, so no task orders the whole table.  A day is never divided.
    """
    day = F.to_date(F.col(date))
    per_day = df.groupBy(day.alias("_day")).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    n = F.sum("_n").over(everything)
    n_test, n_val = F.floor(n * test), F.floor(n * val)
    older = F.coalesce(F.sum("_n").over(before), F.lit(0))
    cut = per_day.select("_day", F.when(older < n - n_test - n_val, "train")
                         .when(older < n - n_test, "val").otherwise("test").alias("split"))
    # one row per calendar day: a century is under a megabyte
    return df.withColumn("_day", day).join(F.broadcast(cut), "_day").drop("_day")


def finite(df: DataFrame, features: list[str]) -> DataFrame:
    """Infinite and NaN feature values -> NULL."""
    def clean(c):
        x = F.col(c).cast("double")
        return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)
    return df.withColumns({c: clean(c) for c in features})


def clean(df: DataFrame, features: list[str]) -> DataFrame:
    """Missing feature values -> the median of the train rows (exact, see `exact_quantiles`)."""
    tidy = finite(df, features)
    med = exact_quantiles(tidy.where(F.col("split") == "train"), features)
    return tidy.withColumns({c: F.coalesce(F.col(c), F.lit(med[c])) for c in features})


def scale(df: DataFrame, features: list[str]) -> DataFrame:
    """(x - mean) / scale with the statistics of the train rows."""
    stats = scaler_stats(df.where(F.col("split") == "train"), features)
    wide = stats.agg(F.struct(*[F.max(F.when(F.col("feature") == c, F.struct("mean", "scale"))).alias(c)
                                for c in features]).alias("s"))
    out = df.withColumn("_s", wide.scalar())  # a scalar subquery, read once
    return out.withColumns({c: (F.col(c) - F.col(f"_s.{c}.mean")) / F.col(f"_s.{c}.scale") for c in features}).drop("_s")


def zero_scales(stats: DataFrame, eps: float = 1e-6) -> DataFrame:
    """Features whose spread is zero or nearly zero."""
    raw = F.abs("raw_scale")
    return (stats.where(raw < eps)
            .select("feature", "raw_scale", F.when(raw == 0, "zero").otherwise("near zero").alias("problem")))


def window_means(df: DataFrame, features: list[str], window: int) -> DataFrame:
    """Average of each feature over the `window` rows before a row, full windows only."""
    s = open_series(df, memory=window)
    w = s.w().rowsBetween(-window, -1)
    s = s.with_columns({"_full": F.count(F.lit(1)).over(w) == window,
                        **{f"{f}_mean": F.avg(f).over(w) for f in features}})
    return s.close().where("_full").drop("_full")


def fit_linear(df: DataFrame, features: list[str], label: str = "shifted_prices") -> dict:
    """Least squares on the train rows with a label and all features; returns intercept and coefficients by feature.

    One aggregation gives the means and the (centred) Gram matrix of features and label; its equations
    are solved on the driver, on the scale of correlations.  Features that others determine get the shortest solution.
    """
    columns = [*features, label]
    rows = df.where(F.col("split") == "train").select(*[F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(columns)]).dropna()
    k = len(columns)
    sums = rows.agg(F.count(F.lit(1)).alias("n"), *[F.avg(f"c{i}").alias(f"m{i}") for i in range(k)],
                    *[F.covar_pop(f"c{i}", f"c{j}").alias(f"g{i}_{j}") for i in range(k) for j in range(i + 1)]).first()
    if not sums["n"]:
        raise ValueError("no train rows with a label and all features")
    gram = np.array([[sums[f"g{max(i, j)}_{min(i, j)}"] for j in range(k)] for i in range(k)])
    mean = np.array([sums[f"m{i}"] for i in range(k)])
    size = np.sqrt(np.diag(gram)[:-1])
    size[size == 0] = 1.0
    found = np.linalg.lstsq(gram[:-1, :-1] / np.outer(size, size), gram[:-1, -1] / size, rcond=1e-12)[0] / size
    return {"intercept": float(mean[-1] - found @ mean[:-1]), "coefficients": dict(zip(features, map(float, found)))}


def score_linear(df: DataFrame, model: dict, name: str = "predicted") -> DataFrame:
    """Dot product of coefficients and columns: stays in generated code."""
    terms = [F.lit(model["intercept"])] + [F.col(f) * F.lit(w) for f, w in model["coefficients"].items()]
    return df.withColumn(name, total(terms))


def score_model(df: DataFrame, features: list[str], window: int,
                predict: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """Predictions of any model on the window before each row.

    `predict` gets an array [rows, window, features] and returns one number per
    row; it is called on Arrow batches, not row by row.
    """
    seq = past_sequences(df, features, window).select("ticker", "date", F.flatten("seq").alias("seq"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                x = np.concatenate(pdf["seq"].to_numpy()).reshape(len(pdf), window, len(features))
                yield pd.DataFrame({"ticker": pdf["ticker"], "date": pdf["date"], "predicted": np.asarray(predict(x), dtype="float64")})

    date = df.schema["date"].dataType.simpleString()
    return seq.mapInPandas(run, f"ticker string, date {date}, predicted double")


def linear_importance(df: DataFrame, model: dict) -> DataFrame:
    """Mean absolute contribution coef * (x - mean(x)) of each feature."""
    feats = list(model["coefficients"])
    means = df.agg(F.struct(*[F.avg(f).alias(f) for f in feats]).alias("m"))
    row = df.withColumn("_m", means.scalar()).agg(*[
        F.avg(F.abs(F.lit(w) * (F.col(f) - F.col(f"_m.{f}")))).alias(f) for f, w in model["coefficients"].items()])
    return row.select(F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).alias("importance"))
                                          for f in feats])).alias("r")).select("r.*")
