"""The model-ready feature table: bars, indicators, news, regimes and label in one frame."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame

from bourse.operators.indicators import INDICATORS, add_indicators
from bourse.operators.windows import add_label
from bourse.sources.bars import OHLCV
from bourse.sources.news import SENTIMENTS, join_daily_sentiment

LABEL = "shifted_prices"
STATES = ["state", "regime"]


def feature_table(bars: DataFrame, columns: Iterable[str], daily_news: DataFrame | None = None,
                  states: DataFrame | None = None, horizon: int = 5, prediction_mode: bool = False,
                  index_values: DataFrame | None = None) -> DataFrame:
    """(ticker, date[, shifted_prices], columns): rows with any missing value are dropped.

    `columns` may name indicators, bar columns, sentiments (needs `daily_news`),
    state / regime (needs `states`) and the columns of `index_values`, one row per
    date that holds for all tickers.  In prediction mode there is no label.
    """
    columns = list(dict.fromkeys(columns))
    known = [*INDICATORS, *OHLCV] + (SENTIMENTS if daily_news is not None else []) + (STATES if states is not None else [])
    market = [c for c in index_values.columns if c != "date"] if index_values is not None else []
    known += market
    unknown = [c for c in columns if c not in known]
    if unknown:
        raise ValueError(f"unknown column(s) {unknown}; available: {sorted(known)}")
    df = bars
    # joins first: label and indicators then share one exchange by ticker
    if any(c in SENTIMENTS for c in columns):
        df = join_daily_sentiment(df, daily_news)
    if any(c in STATES for c in columns):
        df = df.join(states.select("ticker", "date", *STATES), ["ticker", "date"], "left")
    if any(c in market for c in columns):
        df = df.join(index_values, "date", "left")
    if not prediction_mode:
        df = add_label(df, horizon, "lead", LABEL)
    df = add_indicators(df, [c for c in columns if c in INDICATORS])
    return df.select("ticker", "date", *([] if prediction_mode else [LABEL]), *columns).dropna("any")
