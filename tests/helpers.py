import numpy as np
import pandas as pd
from pyspark.sql import functions as F


def price_frame(sizes, seed=0, freq="D"):
    """Random OHLCV rows of several tickers, shuffled."""
    rng = np.random.default_rng(seed)
    parts = []
    for t, n in sizes.items():
        c = 100 * np.exp(np.cumsum(rng.normal(0, 0.01, n)))
        o = c * np.exp(rng.normal(0, 0.005, n))
        parts.append(pd.DataFrame(dict(
            ticker=t, date=pd.date_range("2001-03-05", periods=n, freq=freq), open=o,
            high=np.maximum(o, c) * (1 + rng.uniform(0, 0.01, n)), low=np.minimum(o, c) * (1 - rng.uniform(0, 0.01, n)),
            close=c, volume=rng.integers(1, 100, n).astype(float))))
    return pd.concat(parts, ignore_index=True)


def daily(spark, pdf):
    return spark.createDataFrame(pdf.sample(frac=1, random_state=1)).withColumn("date", F.to_date("date"))


def ordered(df, key="ticker", time="date"):
    return df.toPandas().sort_values([key, time]).reset_index(drop=True)


def close_to(a, b, tol=1e-9):
    a, b = np.asarray(a, dtype=float), np.asarray(b, dtype=float)
    assert (np.isnan(a) == np.isnan(b)).all(), "NULLs differ"
    scale = np.maximum(1.0, np.abs(np.nan_to_num(b)))
    assert np.nanmax(np.abs(a - b) / scale, initial=0.0) < tol
