import numpy as np
import pandas as pd
import pytest
from helpers import close_to, daily, ordered, price_frame
from pyspark.sql import functions as F

from bourse.operators.indicators import INDICATORS, add_indicators

SIZES = {"A": 1300, "B": 140, "C": 6, "D": 1}


def _stoch(s, n):
    d = s.diff()
    gain, loss = d.clip(lower=0).rolling(n).mean(), (-d.clip(upper=0)).rolling(n).mean()
    rsi = 100 - 100 / (1 + gain / loss)
    lo, hi = rsi.rolling(14).min(), rsi.rolling(14).max()
    return (rsi - lo) / (hi - lo)


def _tr(g):
    pc = g.close.shift()
    return pd.concat([g.high - g.low, (g.high - pc).abs(), (g.low - pc).abs()], axis=1).max(axis=1)


def _adx(g):
    atr = _tr(g).rolling(14).mean()
    up, down = g.high.diff().clip(lower=0), (-g.low.diff()).clip(lower=0)
    pos, neg = 100 * up.rolling(14).mean() / atr, 100 * down.rolling(14).mean() / atr
    return (100 * (pos - neg).abs() / (pos + neg)).rolling(14).mean()


def _ewm(s, n):
    return s.ewm(span=n, adjust=False).mean()


def _momentum(g):
    r = g.close.pct_change()
    return 0.4 * r.rolling(21).sum() + 0.3 * r.rolling(63).sum() + 0.3 * r.rolling(126).sum()


def _bollinger(g):
    m, sd = g.close.rolling(20).mean(), g.close.rolling(20).std()
    return (g.close - (m - 2 * sd)) / (4 * sd)


def _engulf(g, bull):
    out = []
    rows = list(zip(g.open, g.close))
    for i, (o, c) in enumerate(rows):
        po, pc = rows[i - 1] if i else (np.nan, np.nan)
        if bull:
            hit = c > o and not pc > po and o <= pc and c >= po
        else:
            hit = not c > o and pc > po and o >= pc and c <= po
        out.append(int(hit and abs(c - o) > abs(pc - po)))
    return pd.Series(out, index=g.index)


EXPECTED = {
    "ema_20": lambda g: _ewm(g.close, 20), "ema_50": lambda g: _ewm(g.close, 50), "ema_200": lambda g: _ewm(g.close, 200),
    "trend_short": lambda g: (_ewm(g.close, 8) > _ewm(g.close, 21)).astype(int),
    "trend_long": lambda g: (_ewm(g.close, 21) > _ewm(g.close, 55)).astype(int),
    "z_score": lambda g: (g.close - g.close.rolling(50).mean()) / g.close.rolling(50).std(),
    "stoch_rsi14": lambda g: _stoch(g.close, 14), "stoch_rsi28": lambda g: _stoch(g.close, 28),
    "macd": lambda g: _ewm(g.close, 12) - _ewm(g.close, 26),
    "atr": lambda g: _tr(g).rolling(14).mean(), "adx": _adx,
    "b_percent": _bollinger, "price_momentum": _momentum,
    "volume_momentum": lambda g: g.volume / g.volume.rolling(21).mean(),
    "keltner_upper": lambda g: g.close.ewm(span=20).mean() + 2 * (g.high - g.low).rolling(10).mean(),
    "keltner_lower": lambda g: g.close.ewm(span=20).mean() - 2 * (g.high - g.low).rolling(10).mean(),
    "bullish_engulfing": lambda g: _engulf(g, True), "bearish_engulfing": lambda g: _engulf(g, False),
    "williams_r": lambda g: -(g.high.rolling(14).max() - g.close) / (g.high.rolling(14).max() - g.low.rolling(14).min()),
}


@pytest.fixture(scope="module")
def prices():
    return price_frame(SIZES)


@pytest.fixture(scope="module")
def computed(spark, prices):
    return ordered(add_indicators(daily(spark, prices), list(INDICATORS)))


def test_every_indicator_has_an_expectation():
    assert set(EXPECTED) == set(INDICATORS)


@pytest.mark.parametrize("name", sorted(EXPECTED))
def test_matches_pandas(prices, computed, name):
    want = pd.concat([EXPECTED[name](g) for _, g in prices.groupby("ticker")])
    close_to(computed[name], want.to_numpy(), 1e-9)


def test_chunks_give_the_same_values(spark, prices):
    """Row chunks with copied history against whole series, memory shorter than a chunk."""
    names = ["z_score", "stoch_rsi14", "adx", "price_momentum", "macd", "ema_20", "bullish_engulfing", "keltner_upper"]
    whole = ordered(add_indicators(daily(spark, prices), names))
    stamped = spark.createDataFrame(prices)  # TIMESTAMP dates
    parts = ordered(add_indicators(stamped, names, chunk_rows=450))
    assert len(whole) == len(parts)
    for n in names:
        close_to(parts[n], whole[n], 1e-9)


def test_constant_series_gives_null_not_error(spark):
    pdf = pd.DataFrame(dict(ticker="K", date=pd.date_range("2020-01-01", periods=80), open=5.0, high=5.0, low=5.0,
                            close=5.0, volume=0.0))
    r = ordered(add_indicators(daily(spark, pdf), ["z_score", "b_percent", "williams_r", "stoch_rsi14", "volume_momentum", "adx"]))
    assert r[["z_score", "b_percent", "williams_r", "stoch_rsi14", "volume_momentum", "adx"]].isna().all().all()


def test_long_series_does_not_overflow(spark):
    n = 9000
    pdf = pd.DataFrame(dict(ticker="L", date=pd.date_range("1990-01-01", periods=n), open=1.0, high=1.0, low=1.0,
                            close=1000 + np.sin(np.arange(n)), volume=1.0))
    r = ordered(add_indicators(daily(spark, pdf), ["macd", "trend_short", "ema_200"]))
    close_to(r["ema_200"], pdf.close.ewm(span=200, adjust=False).mean(), 1e-10)
    close_to(r["macd"], _ewm(pdf.close, 12) - _ewm(pdf.close, 26), 1e-9)


def test_unknown_indicator_is_an_error(spark, prices):
    with pytest.raises(ValueError, match="nasdaq_rsi14"):
        add_indicators(daily(spark, prices), ["ema_20", "nasdaq_rsi14"])


def test_one_exchange_for_all_indicators(spark, prices):
    plan = add_indicators(daily(spark, prices), list(INDICATORS))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_unrequested_window_columns_are_not_computed(spark, prices):
    df = add_indicators(daily(spark, prices), ["z_score"])
    assert "stddev_samp" in df._jdf.queryExecution().optimizedPlan().toString()
    assert "stddev_samp" not in df.select("ticker", "close")._jdf.queryExecution().optimizedPlan().toString()


def test_feature_table_columns_and_modes(spark, prices):
    from bourse.operators.features import feature_table
    bars = daily(spark, prices)
    states = bars.selectExpr("ticker", "date", "1 AS state", "'Neutral' AS regime")
    full = feature_table(bars, ["z_score", "state", "close"], states=states, horizon=3)
    assert full.columns == ["ticker", "date", "shifted_prices", "z_score", "state", "close"]
    assert full.count() == (1300 - 49 - 3) + (140 - 49 - 3)
    assert feature_table(bars, ["z_score"], prediction_mode=True).count() == (1300 - 49) + (140 - 49)
    for bad in (["positive"], ["regime"], ["ema_100"]):
        with pytest.raises(ValueError):
            feature_table(bars, bad)


@pytest.mark.parametrize("pattern", ["gaps", "first", "long", "all"])
def test_averages_over_missing_values_equal_pandas(spark, pattern):
    """A NULL ages what came before it; chunks and segments must not show."""
    pdf = price_frame({"A": 1500}, seed=4)
    rng = np.random.default_rng(0)
    gone = {"gaps": rng.random(1500) < 0.4, "first": np.arange(1500) < 7, "long": (np.arange(1500) > 300) & (np.arange(1500) < 1100),
            "all": np.full(1500, True)}[pattern]
    pdf.loc[gone, "close"] = np.nan
    df = daily(spark, pdf).withColumn("close", F.when(~F.isnan("close"), F.col("close")))
    got = ordered(add_indicators(df, ["ema_20", "ema_200", "macd"]))
    e = lambda n: pdf["close"].ewm(span=n, adjust=False).mean().ffill()
    close_to(got["ema_20"], e(20))
    close_to(got["ema_200"], e(200))
    close_to(got["macd"], e(12) - e(26))
    k = ordered(add_indicators(df, ["keltner_upper", "keltner_lower"]))
    middle = pdf["close"].ewm(span=20).mean().ffill()
    seen = k["keltner_upper"].notna()
    close_to(((k["keltner_upper"] + k["keltner_lower"]) / 2)[seen], middle[seen])
