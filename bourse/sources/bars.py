"""Bar tables: loading, resampling, time zones, storage."""

from __future__ import annotations

from collections.abc import Iterable
from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BAR_SCHEMA = T.StructType([
    T.StructField("ticker", T.StringType()),
    T.StructField("date", T.DateType()),
    T.StructField("open", T.DoubleType()),
    T.StructField("high", T.DoubleType()),
    T.StructField("low", T.DoubleType()),
    T.StructField("close", T.DoubleType()),
    T.StructField("volume", T.DoubleType()),
])
OHLCV = ["open", "high", "low", "close", "volume"]


def read_bars(spark: SparkSession, path: str, fmt: str = "parquet", **options) -> DataFrame:
    """A landed bar table with the declared schema (parquet, csv, json, orc, ...)."""
    return spark.read.format(fmt).schema(BAR_SCHEMA).options(**options).load(path)


def select_bars(bars: DataFrame, tickers: str | Iterable[str] | None = None, start=None, end=None,
                years: int | None = None) -> DataFrame:
    """Bars of some tickers in a date range; `years` counts 365-day years back from `end`."""
    if tickers is not None:
        bars = bars.where(F.col("ticker").isin([tickers] if isinstance(tickers, str) else list(tickers)))
    if years is not None:
        stop = F.lit(end).cast("date") if end is not None else F.current_date()
        bars = bars.where(F.col("date") >= F.date_sub(stop, 365 * years))
    if start is not None:
        bars = bars.where(F.col("date") >= F.lit(start).cast("date"))
    if end is not None:
        bars = bars.where(F.col("date") <= F.lit(end).cast("date"))
    return bars


def resample(trades: DataFrame, timespan: str = "day", multiplier: int = 1, key: str = "ticker",
             ts: str = "ts", price: str = "px", size: str = "size", tie: str = "id") -> DataFrame:
    """Bars of `multiplier` x `timespan` from trades or finer bars.

    Trades with the same time are ordered by `tie`.  One aggregation with
    map-side partials: a heavily traded ticker is reduced before the shuffle.
    Time and an integer `tie` make up one number of fixed width, so the first and
    the last price are kept by hash aggregation; other ties are compared as they are.
    """
    if isinstance(trades.schema[tie].dataType, T.IntegralType):
        wide = "decimal(38,0)"
        order = (F.unix_micros(F.col(ts).cast("timestamp")).cast("decimal(19,0)") * F.lit(Decimal(1 << 64)).cast("decimal(20,0)")
                 + F.col(tie).cast("decimal(19,0)")).cast(wide)
    else:
        order = F.struct(F.col(ts), F.col(tie))
    return (trades.groupBy(key, bar_time(F.col(ts), timespan, multiplier).alias("date"))
            .agg(F.min_by(price, order).alias("open"), F.max(price).alias("high"),
                 F.min(price).alias("low"), F.max_by(price, order).alias("close"),
                 F.sum(size).alias("volume")))


_SECONDS = {"second": 1, "minute": 60, "hour": 3600}


def bar_time(ts: Column, timespan: str, multiplier: int = 1) -> Column:
    """Start of the bar a time falls into; day and longer spans give a DATE."""
    if multiplier < 1:
        raise ValueError("multiplier must be at least 1")
    if timespan in _SECONDS:
        step = _SECONDS[timespan] * multiplier
        secs = F.unix_seconds(ts.cast("timestamp"))
        return F.timestamp_seconds(secs - F.pmod(secs, F.lit(step)))
    if timespan == "day":
        days = F.unix_date(ts.cast("date"))
        return F.date_from_unix_date((days - F.pmod(days, F.lit(multiplier))).cast("int"))
    if timespan == "week":
        # weeks start on Monday; 1970-01-05 was one
        days = F.unix_date(ts.cast("date")) - 4
        return F.date_from_unix_date((days - F.pmod(days, F.lit(7 * multiplier)) + 4).cast("int"))
    if timespan in ("month", "quarter", "year"):
        months = {"month": 1, "quarter": 3, "year": 12}[timespan] * multiplier
        idx = F.year(ts) * 12 + F.month(ts) - 1
        first = idx - F.pmod(idx, F.lit(months))
        return F.make_date(F.floor(first / 12).cast("int"), (F.pmod(first, F.lit(12)) + 1).cast("int"), F.lit(1))
    raise ValueError(f"unknown timespan {timespan!r}")


def trading_date(epoch_ms: Column, zone: str = "America/New_York") -> Column:
    """UTC epoch milliseconds -> calendar date in the exchange's zone.

    Works on zone-less times throughout, so the session's zone does not matter.
    """
    utc = F.timestamp_add("MILLISECOND", epoch_ms, F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'"))
    return F.to_date(F.convert_timezone(F.lit("UTC"), F.lit(zone), utc))


def index_bars(bars: DataFrame, index_ticker: str) -> DataFrame:
    return bars.where(F.col("ticker") == index_ticker)


_TITLE = {"ticker": "Ticker", "date": "Date", "open": "Open", "high": "High", "low": "Low",
          "close": "Close", "volume": "Volume"}


def to_storage_names(bars: DataFrame) -> DataFrame:
    """Engine column names -> capitalised names of the stored daily tables."""
    return bars.withColumnsRenamed({k: v for k, v in _TITLE.items() if k in bars.columns})


def to_engine_names(bars: DataFrame) -> DataFrame:
    return bars.withColumnsRenamed({v: k for k, v in _TITLE.items() if v in bars.columns})


def calendar_fill(bars: DataFrame, calendar: DataFrame) -> DataFrame:
    """Every calendar day beside the bars of that day."""
    return calendar.join(bars, "date", "left")
