import numpy as np
import pandas as pd
import pytest
from helpers import close_to, daily, ordered, price_frame
from pyspark.sql import functions as F

from bourse.operators import joins, windows
from bourse.operators.series import open_series, running, with_position


def test_running_with_carry_equals_plain_window(spark):
    pdf = price_frame({"A": 400, "B": 3})
    pdf.loc[pdf.index % 7 != 0, "open"] = np.nan
    df = daily(spark, pdf).withColumn("open", F.when(~F.isnan("open"), F.col("open")))
    cols = {"s": ("sum", F.col("volume")), "m": ("max", F.col("close")), "l": ("last", F.col("open")), "n": ("count", F.col("open"))}
    a, b = ordered(running(df, cols)), ordered(running(df, cols, bucket="month"))
    for c in cols:
        close_to(a[c], b[c], 1e-12)


def test_position_counts_from_the_first_row(spark):
    pdf = price_frame({"A": 100, "B": 5}, freq="7h")
    got = ordered(with_position(spark.createDataFrame(pdf)))
    assert list(got["_pos"]) == list(range(100)) + list(range(5))


def test_chunks_keep_every_row_once(spark):
    pdf = price_frame({"A": 100, "B": 5}, freq="h")
    s = open_series(spark.createDataFrame(pdf), memory=10, chunk_rows=16)
    assert s.chunked and s.close().count() == 105
    assert s.df.groupBy(*s.keys).count().agg(F.max("count")).first()[0] <= 26


def _brute_seq(x, i, w, pad):
    have = x[max(0, i - w + 1): i + 1]
    miss = w - len(have)
    if pad == "zero":
        fill = [0.0] * miss
    elif pad == "mean":
        fill = [float(np.mean(x[: i + 1]))] * miss
    else:
        fill = [x[0]] * miss
    return fill + list(have)


@pytest.mark.parametrize("pad", ["zero", "mean", "repeat"])
def test_sequences_against_brute_force(spark, pad):
    pdf = price_frame({"A": 12, "B": 3})
    got = ordered(windows.sequences(daily(spark, pdf), ["close", "volume"], 5, pad))
    for _, g in got.groupby("ticker"):
        x = g["close"].tolist()
        for i, seq in enumerate(g["seq"]):
            close_to([v[0] for v in seq], _brute_seq(x, i, 5, pad), 1e-12)
    with pytest.raises(ValueError):
        windows.sequences(daily(spark, pdf), ["close"], 5, "reflect")


def test_past_sequences_exclude_the_row(spark):
    pdf = price_frame({"A": 9, "B": 2})
    got = ordered(windows.past_sequences(daily(spark, pdf), ["close"], 4))
    assert len(got) == 5
    a = pdf[pdf.ticker == "A"].close.tolist()
    for k, seq in enumerate(got["seq"]):
        close_to([v[0] for v in seq], a[k: k + 4], 1e-12)


def test_downsample_fills_the_tail_with_zeros(spark):
    pdf = price_frame({"A": 7})
    got = windows.downsample(daily(spark, pdf), ["close"], 3).toPandas().sort_values("step")
    x = pdf.close.tolist() + [0.0, 0.0]
    close_to(got["close"], np.array(x).reshape(3, 3).mean(axis=1), 1e-12)


def test_labels_lead_and_lag(spark):
    pdf = price_frame({"A": 9, "B": 4})
    got = ordered(windows.add_label(windows.add_label(daily(spark, pdf), 2, "lead", "ahead"), 2, "lag", "back"))
    g = pdf.groupby("ticker").close
    close_to(got["ahead"], g.shift(-2))
    close_to(got["back"], g.shift(2))
    stamped = ordered(windows.add_label(spark.createDataFrame(pdf), 2, "lead", "ahead"))
    close_to(stamped["ahead"], g.shift(-2))


def test_cumulative_return_and_ruin(spark):
    pdf = pd.DataFrame(dict(ticker="A", date=pd.date_range("2020-01-01", periods=4), ret=[0.1, -0.5, -1.0, 3.0]))
    got = ordered(windows.cumulative_return(daily(spark, pdf)))
    close_to(got["cumulative_return"], [10.0, -45.0, -100.0, -100.0], 1e-12)


def test_returns_drop_the_first_bar_of_each_ticker(spark):
    pdf = price_frame({"A": 5, "B": 3})
    got = ordered(windows.returns_and_range(daily(spark, pdf)))
    assert got.groupby("ticker").size().to_dict() == {"A": 4, "B": 2}
    close_to(got["ret"], pdf.groupby("ticker").close.pct_change().dropna())


def test_keep_first_and_ordered_distinct(spark):
    df = spark.createDataFrame([("A", 1, 2, "x"), ("A", 1, 1, "y"), ("B", 1, 5, "z")], "ticker string, d int, src int, v string")
    rows = {(r.ticker, r.d): r.v for r in windows.keep_first(df, ["ticker", "d"], [F.col("src")]).collect()}
    assert rows == {("A", 1): "y", ("B", 1): "z"}
    assert {r.v: r.src for r in windows.ordered_distinct(df.unionAll(df), "v", "src").collect()} == {"x": 2, "y": 1, "z": 5}


@pytest.mark.parametrize("kind", ["date", "timestamp"])
def test_asof_against_merge_asof(spark, kind):
    rng = np.random.default_rng(3)
    left = pd.DataFrame(dict(ticker=rng.choice(["A", "B", "C"], 60), asof=pd.Timestamp("2020-01-01") + pd.to_timedelta(rng.integers(0, 50, 60), "D"), k=range(60)))
    right = pd.DataFrame(dict(ticker=["A"] * 12 + ["B"] * 5, date=list(pd.date_range("2020-01-06", periods=12, freq="3D")) + list(pd.date_range("2020-01-20", periods=5))))
    right["close"] = np.arange(len(right), dtype=float)
    sl = spark.createDataFrame(left).withColumn("asof", F.col("asof").cast(kind))
    sr = spark.createDataFrame(right).withColumn("date", F.col("date").cast(kind))
    got = joins.asof(sl, sr, ["close"]).toPandas().sort_values("k")
    want = pd.merge_asof(left.sort_values("asof"), right.rename(columns={"date": "asof"}).sort_values("asof"), on="asof", by="ticker").sort_values("k")
    close_to(got["close"], want["close"])


def test_asof_of_daily_rows_equals_that_of_times(spark):
    """Ties, missing values, keys and times, repeated asks; days as such and as midnights give the same."""
    import datetime as dt
    day = lambda i: dt.date(2020, 1, i)
    left = [("A", day(1), 0), ("A", day(5), 1), ("A", day(5), 2), ("A", None, 3), (None, day(9), 4), ("B", day(2), 5), ("C", day(2), 6), ("A", day(31), 7)]
    right = [("A", day(3), 1.0, "x"), ("A", day(5), 2.0, "a"), ("A", day(5), 2.0, "b"), ("A", day(5), None, "z"), ("A", day(7), None, None), ("B", day(2), 5.0, "y"), ("B", day(3), 6.0, "y"), ("A", None, 9.0, "n")]
    sl = spark.createDataFrame(left, "ticker string, asof date, k int")
    sr = spark.createDataFrame(right, "ticker string, date date, close double, v string")
    got = {r.k: (r.close, r.v) for r in joins.asof(sl, sr, ["close", "v"]).collect()}
    assert got == {0: (None, None), 1: (2.0, "b"), 2: (2.0, "b"), 3: (None, None), 4: (None, None), 5: (5.0, "y"), 6: (None, None), 7: (None, None)}
    times = joins.asof(sl.withColumn("asof", F.col("asof").cast("timestamp")), sr.withColumn("date", F.col("date").cast("timestamp")), ["close", "v"])
    assert {r.k: (r.close, r.v) for r in times.collect()} == got
    plan = joins.asof(sl, sr, ["close", "v"])._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and plan.count("Exchange hashpartitioning") <= 4
