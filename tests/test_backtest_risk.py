import math

import numpy as np
import pandas as pd
import pytest
from helpers import close_to, daily, ordered, price_frame
from pyspark.sql import functions as F

from bourse.operators import aggregates as agg
from bourse.operators import backtest as bt
from bourse.operators import risk

E, X, SLIP, FEE = 1.0, 0.5, 0.001, 0.002


@pytest.fixture(scope="module")
def pred(spark):
    return bt.sma_predictions(daily(spark, price_frame({"A": 300, "B": 60, "C": 10}, seed=5))).cache()


@pytest.fixture(scope="module")
def curve(pred):
    return bt.run(pred, E, X, 500.0, SLIP, FEE).cache()


def loop(pdf):
    """The same strategy as an ordinary loop over bars."""
    out = []
    for t, g in pdf.groupby("ticker"):
        cash, shares = 500.0, 0.0
        for r in g.itertuples():
            gap = (r.predicted - r.close) / r.close * 100
            if gap >= E and shares == 0:
                shares, cash = cash / (r.close * (1 + SLIP) * (1 + FEE)), 0.0
            elif gap <= -X and shares > 0:
                cash, shares = shares * r.close * (1 - SLIP) * (1 - FEE), 0.0
            out.append((t, r.date, cash + shares * r.close, int(shares > 0)))
    return pd.DataFrame(out, columns=["ticker", "date", "equity", "position"])


def test_equity_matches_the_loop(pred, curve):
    want = loop(ordered(pred))
    got = ordered(curve)
    close_to(got["equity"], want["equity"], 1e-10)
    assert list(got["position"]) == list(want["position"])
    assert got["position"].sum() > 10


def test_equity_is_flat_without_a_position(curve):
    g = ordered(curve)
    g["prev"] = g.groupby("ticker").position.shift().fillna(0)
    assert (g[(g.position == 0) & (g.prev == 0)].ret == 0).all()


def test_full_confidence_equals_all_in(pred):
    sig = bt.signals(pred, E, X).withColumn("confidence", F.lit(1.0))
    close_to(ordered(bt.equity_sized(sig, 500.0, SLIP, FEE))["equity"], loop(ordered(pred))["equity"], 1e-9)


def test_trades_account_for_the_whole_result(curve):
    t = bt.trades(curve, SLIP, FEE).toPandas()
    end = ordered(curve).groupby("ticker").equity.last() - 500.0
    close_to(t.groupby("ticker").pnl.sum().reindex(end.index).fillna(0.0), end, 1e-9)
    assert (t[t.status == "Closed"].exit_date > t[t.status == "Closed"].entry_date).all()


def sized_loop(pdf):
    out = []
    for t, g in pdf.sort_values("date").groupby("ticker"):
        cash, shares = 500.0, 0.0
        for r in g.itertuples():
            if r.entry_signal and not r.exit_signal:
                spent = cash * r.confidence
                cash, shares = cash - spent, shares + spent / (r.close * (1 + SLIP) * (1 + FEE))
            elif r.exit_signal and not r.entry_signal:
                sold = shares * r.confidence
                cash, shares = cash + sold * r.close * (1 - SLIP) * (1 - FEE), shares - sold
            out.append((t, r.date, cash, shares, cash + shares * r.close))
    return pd.DataFrame(out, columns=["ticker", "date", "cash", "shares", "equity"])


@pytest.mark.parametrize("chunk", [None, 7, 50])
@pytest.mark.parametrize("freq", ["D", "h"])
def test_sized_equals_a_loop_on_any_series(spark, freq, chunk):
    pdf = price_frame({"A": 300, "B": 60, "C": 1}, seed=5, freq=freq)
    rng = np.random.default_rng(1)
    pdf["entry_signal"], pdf["exit_signal"], pdf["confidence"] = rng.random(len(pdf)) < 0.4, rng.random(len(pdf)) < 0.4, rng.random(len(pdf))
    df = daily(spark, pdf) if freq == "D" else spark.createDataFrame(pdf)
    got, want = ordered(bt.equity_sized(df, 500.0, SLIP, FEE, chunk=chunk)), sized_loop(pdf).sort_values(["ticker", "date"], ignore_index=True)
    for c in ("cash", "shares", "equity"):
        close_to(got[c], want[c], 1e-9)


def test_sized_folds_no_arrays(pred):
    plan = bt.equity_sized(bt.signals(pred, E, X).withColumn("confidence", F.lit(0.5)))._jdf.queryExecution().optimizedPlan().toString()
    assert "aggregate(" not in plan and "collect_list" not in plan


def test_sized_orders_need_a_price(spark):
    kind = "ticker string, date date, close double, entry_signal boolean, exit_signal boolean, confidence double"
    import datetime as dt
    df = spark.createDataFrame([("a", dt.date(2001, 1, i + 1), c, True, False, 0.5) for i, c in enumerate([0.0, None, 10.0])], kind)
    got = bt.equity_sized(df, slippage=0.0, fees=0.0).orderBy("date").collect()
    assert [(r.cash, r.shares, r.equity) for r in got] == [(1000.0, 0.0, 1000.0), (1000.0, 0.0, None), (500.0, 50.0, 1000.0)]


def test_metrics_against_numpy(curve):
    got = {r.ticker: r for r in risk.all_metrics(curve.select("ticker", "date", "ret"), 4.0).collect()}
    for t, g in ordered(curve).groupby("ticker"):
        r, m = g.ret.to_numpy(), got[t]
        rf = 1.04 ** (1 / 252) - 1
        sd = r.std(ddof=1)
        if sd == 0:
            assert m.sharpe is None
            continue
        assert math.isclose(m.sharpe, (r - rf).mean() / sd * math.sqrt(252), rel_tol=1e-9)
        assert math.isclose(m.sortino, (r - rf).mean() / math.sqrt((np.minimum(r - rf, 0) ** 2).mean()) * math.sqrt(252), rel_tol=1e-9)
        assert math.isclose(m.var_hist, np.percentile(r, 5), abs_tol=1e-12)
        total = np.prod(1 + r) - 1
        days = (g.date.iloc[-1] - g.date.iloc[0]).days
        assert math.isclose(m.cumulative_return, total, rel_tol=1e-8, abs_tol=1e-10)
        assert math.isclose(m.cagr, (1 + total) ** (365.25 / days) - 1, rel_tol=1e-8, abs_tol=1e-10)
        value = np.cumprod(1 + r)
        dd = value / np.maximum(np.maximum.accumulate(value), 1.0) - 1
        assert math.isclose(m.max_drawdown, dd.min(), rel_tol=1e-8)
        longest = best = 0
        depths, cur = [], 0.0
        for i, x in enumerate(dd):
            if x < -1e-12:
                longest, cur = longest + 1, min(cur, x)
            if (x >= -1e-12 or i == len(dd) - 1) and cur < 0:
                depths.append(cur)
                cur = 0.0
            if x >= -1e-12:
                best, longest = max(best, longest), 0
        assert m.longest_days == max(best, longest)  # the fixture has a bar every day
        assert math.isclose(m.avg_drawdown, np.mean(depths), rel_tol=1e-8)
        ulcer = math.sqrt((dd ** 2).sum() / (len(dd) - 1))
        tail = dd[dd < dd.mean() - 1.645 * dd.std(ddof=1)]
        if len(tail) == 0:
            assert m.serenity is None
            continue
        pitfall = -tail.mean() / sd
        assert math.isclose(m.serenity, (r.sum() - 0.04) / (ulcer * pitfall), rel_tol=1e-7)


def test_longer_series_give_the_same_measures(spark, curve):
    """TIMESTAMP dates take the aggregate-and-join route."""
    daily_r = curve.select("ticker", "date", "ret")
    stamped = daily_r.withColumn("date", F.col("date").cast("timestamp"))
    a = risk.all_metrics(daily_r, 4.0).toPandas().set_index("ticker").sort_index()
    b = risk.all_metrics(stamped, 4.0).toPandas().set_index("ticker").sort_index()
    for c in a.columns:
        close_to(a[c], b[c], 1e-9)


def test_never_negative_run_has_no_drawdown(spark):
    pdf = pd.DataFrame(dict(ticker="U", date=pd.date_range("2020-01-01", periods=5), ret=[0.0, 0.1, 0.2, 0.0, 0.1]))
    m = risk.drawdown_metrics(daily(spark, pdf)).first()
    assert (m.max_drawdown, m.avg_drawdown, m.longest_days) == (0.0, 0.0, 0)


def test_tearsheet_has_ten_rows_per_ticker(curve):
    r = curve.select("ticker", "date", "ret")
    t = risk.tearsheet(r, r.where("ticker = 'A'").select("date", "ret"), 4.0)
    assert t.count() == 30
    assert t.where("ticker = 'A' AND abs(delta) > 1e-12").count() == 0


def test_position_limits(spark):
    bars = spark.sql("SELECT * FROM VALUES ('A', DATE'2020-01-01', 5.0D), ('A', DATE'2020-01-02', 7.0D), ('B', DATE'2020-01-01', 0.0D) AS t(ticker, date, close)")
    pos = spark.sql("SELECT 'A' AS ticker, 10.0D AS shares, 400.0D AS cost_basis")
    r = {x.ticker: x for x in risk.position_limits(bars, pos, 600.0).collect()}
    assert r["A"].portfolio_value == 1000.0 and r["A"].remaining_limit == -200.0 and r["A"].max_shares == -28
    assert r["B"].remaining_position_limit == 200.0 and r["B"].max_shares == 0


def test_forecast_error_is_capped(spark):
    df = spark.createDataFrame([("x", 0.0, 1.0), ("x", 2.0, 1.0), ("x", None, 1.0)], "split string, actual double, predicted double")
    r = agg.forecast_error(df).first()
    assert (r.n, r.mse, r.mape) == (2, 1.0, (10.0 + 0.5) / 2 * 100)


@pytest.mark.parametrize("q", [0.0, 0.05, 0.5, 0.77, 1.0])
def test_exact_quantiles_by_narrowing(spark, q):
    rng = np.random.default_rng(1)
    x = rng.normal(size=5000)
    y = np.where(rng.random(5000) < 0.4, 3.0, rng.integers(0, 10, 5000).astype(float))  # one value holds a third of the rows
    z = np.where(rng.random(5000) < 0.4, 0.25, x)  # the same amid distinct values
    data = dict(x=x, y=y, z=z)
    got = agg.exact_quantiles(spark.createDataFrame(pd.DataFrame(data)), list(data), q)
    for c, v in data.items():
        assert math.isclose(got[c], np.quantile(v, q), rel_tol=1e-12, abs_tol=1e-12), c
    df = spark.createDataFrame(pd.DataFrame(data))
    assert agg.exact_quantiles(df.where("x > 100"), ["x"])["x"] is None


@pytest.mark.parametrize("values", [[1.0000000000000002, 1.0000000000000004] * 3, [float("-inf"), 1.0, float("inf")], [-1.7e308, 1.7e308, 0.0],
                                    [5e-324, 0.0, -5e-324, -0.0], [7.0], [3.0] * 40 + list(range(80))])
def test_exact_quantiles_end_on_any_values(spark, values):
    df = spark.createDataFrame([(float(v),) for v in values], "x double")
    for q in (0.0, 0.25, 0.5, 1.0):
        rank = q * (len(values) - 1)
        low, high = sorted(values)[math.floor(rank)], sorted(values)[math.ceil(rank)]
        assert low <= agg.exact_quantiles(df, ["x"], q)["x"] <= high


def test_a_total_loss_stays_lost(spark):
    rows = [("a", f"2001-01-0{i + 1}", c, i == 0) for i, c in enumerate([10.0, 10.0, 0.0, 5.0])]
    sig = spark.createDataFrame(rows, "ticker string, date string, close double, entry_signal boolean").selectExpr(
        "ticker", "CAST(date AS date) date", "close", "entry_signal", "false AS exit_signal")
    got = [r.equity for r in bt.equity(bt.position(sig)).orderBy("date").collect()]
    assert got[1] > 990 and got[2:] == [0.0, 0.0]
    ret = spark.createDataFrame([("a", f"2001-01-0{i + 1}", r) for i, r in enumerate([0.1, -1.0, 0.05])], "ticker string, date string, ret double")
    m = risk.all_metrics(ret.selectExpr("ticker", "CAST(date AS date) date", "ret")).first()
    assert m.cumulative_return == -1.0 and m.max_drawdown == -1.0


def test_sized_orders_without_bars_and_with_null_signals(spark):
    kind = "ticker string, date date, close double, entry_signal boolean, exit_signal boolean, confidence double"
    assert bt.equity_sized(spark.createDataFrame([], kind)).count() == 0
    import datetime as dt
    df = spark.createDataFrame([("a", dt.date(2001, 1, 1), 10.0, None, None, None), ("a", dt.date(2001, 1, 2), 10.0, True, None, 1.0)], kind)
    assert [round(r.equity, 6) for r in bt.equity_sized(df, slippage=0.0, fees=0.0).orderBy("date").collect()] == [1000.0, 1000.0]


@pytest.mark.parametrize("n", [1, 2, 21, 4000])
def test_quantile_of_a_long_series_is_exact(spark, n):
    rng = np.random.default_rng(n)
    pdf = pd.DataFrame(dict(ticker="A", date=pd.date_range("2001-01-01", periods=n, freq="h"), ret=np.where(rng.random(n) < 0.3, -0.02, rng.normal(size=n) / 50)))
    got = risk.return_metrics(spark.createDataFrame(pdf)).first()
    assert math.isclose(got.var_hist, np.quantile(pdf["ret"], 0.05), rel_tol=1e-12, abs_tol=1e-15) and got.n == n


@pytest.mark.parametrize("meet", [3, 60, risk.MEET])
@pytest.mark.parametrize("share", [0.0, 0.05, 0.5, 1.0])
def test_quantiles_by_ticker_with_a_hot_ticker(spark, meet, share):
    """However few values may meet in a task; ties, one-row tickers and a value that holds many rows."""
    rng = np.random.default_rng(7)
    data = {"hot": rng.normal(size=6000), "tied": rng.integers(-3, 3, 900) / 100.0, "one": np.array([0.25]), "two": np.array([0.5, -0.5]),
            "lump": np.where(rng.random(2000) < 0.4, -0.02, rng.normal(size=2000) / 50), "same": np.full(50, 0.1)}
    rows = [(t, float(x)) for t, v in data.items() for x in v]
    got = {r.ticker: r.var_hist for r in risk._long_quantile(spark.createDataFrame(rows, "ticker string, ret double"), share, meet).collect()}
    assert got.keys() == data.keys()
    for t, v in data.items():
        assert math.isclose(got[t], np.quantile(v, share), rel_tol=1e-12, abs_tol=1e-15), t


def test_a_chain_on_hourly_bars_does_not_multiply(spark):
    df = spark.createDataFrame(price_frame({"A": 200, "B": 50}, freq="h"))
    c = bt.run(bt.sma_predictions(df), E, X)
    plan = risk.drawdowns(c.select("ticker", "date", "ret"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") <= 4
