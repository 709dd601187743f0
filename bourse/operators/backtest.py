"""Signal backtests for all tickers at once.

Long-only, all-in: the last signal decides the position, so a backtest is a few
window columns over (ticker, date) and no per-ticker loop.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bourse.functions.columns import safe_div
from bourse.operators.scan import scanned
from bourse.operators.series import open_series, running

SLIPPAGE, FEES = 0.001, 0.0


def sma_predictions(bars: DataFrame, n: int = 20) -> DataFrame:
    """A stand-in forecast: the simple moving average of close."""
    s = open_series(bars, memory=n)
    w = s.rows(n)
    s = s.with_columns({"predicted": F.when(F.count("close").over(w) == n, F.avg("close").over(w))})
    return s.close()


def signals(df: DataFrame, entry_pct: float = 0.05, exit_pct: float = 0.05) -> DataFrame:
    """gap in percent of close; entry at or above `entry_pct`, exit at or below -|exit_pct|."""
    gap = safe_div(F.col("predicted") - F.col("close"), F.col("close")) * 100.0
    return (df.withColumn("gap_pct", gap)
            .withColumn("entry_signal", F.coalesce(F.col("gap_pct") >= float(entry_pct), F.lit(False)))
            .withColumn("exit_signal", F.coalesce(F.col("gap_pct") <= -abs(float(exit_pct)), F.lit(False))))


def position(sig: DataFrame) -> DataFrame:
    """position after the bar (1 long, 0 flat), and whether a trade opened or closed on it."""
    act = (F.when(F.col("entry_signal") & ~F.col("exit_signal"), 1)
           .when(F.col("exit_signal") & ~F.col("entry_signal"), 0))
    df = running(sig, {"_last": ("last", act)}).withColumn("position", F.coalesce("_last", F.lit(0))).drop("_last")
    s = open_series(df, memory=1)
    prev = F.coalesce(F.lag("position").over(s.w()), F.lit(0))
    return s.with_columns({"opened": (F.col("position") == 1) & (prev == 0),
                           "closed": (F.col("position") == 0) & (prev == 1),
                           "_prev_close": F.lag("close").over(s.w())}).close()


def equity(pos: DataFrame, initial_cash: float = 1000.0, slippage: float = SLIPPAGE, fees: float = FEES) -> DataFrame:
    """Portfolio value and return per bar."""
    move = safe_div("close", "_prev_close")
    factor = (F.when(F.col("opened"), F.lit(1.0 / ((1.0 + slippage) * (1.0 + fees))))
              .when(F.col("closed"), move * (1.0 - slippage) * (1.0 - fees))
              .when(F.col("position") == 1, move).otherwise(F.lit(1.0)))
    df = pos.withColumn("growth", factor)
    df = running(df, {"_log": ("sum", F.ln(F.when(F.col("growth") > 0, F.col("growth")))),
                      "_lost": ("max", (F.col("growth") <= 0).cast("int"))})
    # what is lost at a price of 0 stays lost
    return (df.withColumn("equity", F.when(F.col("_lost") == 1, F.lit(0.0)).otherwise(F.exp(F.coalesce("_log", F.lit(0.0))) * initial_cash))
            .withColumn("ret", F.col("growth") - 1.0).drop("_log", "_lost", "_prev_close"))


def run(predicted: DataFrame, entry_pct: float = 0.05, exit_pct: float = 0.05, initial_cash: float = 1000.0,
        slippage: float = SLIPPAGE, fees: float = FEES) -> DataFrame:
    """signals -> position -> equity, for every ticker of the table."""
    return equity(position(signals(predicted, entry_pct, exit_pct)), initial_cash, slippage, fees)


def exposure(curve: DataFrame) -> DataFrame:
    """Net exposure by bar: the invested share of the portfolio."""
    return curve.select("ticker", "date", F.col("position").cast("double").alias("net_exposure"))


def trades(curve: DataFrame, slippage: float = SLIPPAGE, fees: float = FEES) -> DataFrame:
    """One row per round trip; an open trade has no exit and is valued at the last close."""
    df = running(curve, {"trade_id": ("sum", F.col("opened").cast("int"))})
    inside = df.where((F.col("position") == 1) | F.col("closed"))
    g = inside.groupBy("ticker", "trade_id").agg(
        F.min("date").alias("entry_date"),
        (F.max(F.when(F.col("opened"), F.col("close"))) * (1.0 + slippage)).alias("entry_price"),
        F.max(F.when(F.col("closed"), F.col("date"))).alias("exit_date"),
        (F.max(F.when(F.col("closed"), F.col("close"))) * (1.0 - slippage)).alias("exit_price"),
        F.count(F.lit(1)).alias("bars"),
        F.max(F.when(F.col("opened"), F.col("equity"))).alias("_start"),
        F.max_by("equity", "date").alias("_end"))
    start = F.col("_start") * ((1.0 + slippage) * (1.0 + fees))
    return (g.withColumn("pnl", F.col("_end") - start)
            .withColumn("trade_return", safe_div(F.col("_end"), start) - 1.0)
            .withColumn("status", F.when(F.col("exit_date").isNull(), "Open").otherwise("Closed"))
            .drop("_start", "_end"))


def cumulative(curve: DataFrame, initial_cash: float = 1000.0) -> DataFrame:
    """The cumulative return frame in percent."""
    return curve.select("ticker", "date", "ret", ((F.col("equity") / initial_cash - 1.0) * 100.0).alias("cumulative_return"))


def _after(first: dict, then: dict) -> dict:
    """The matrix of two bars in a row."""
    return {"_a": then["_a"] * first["_a"] + then["_b"] * first["_c"], "_b": then["_a"] * first["_b"] + then["_b"] * first["_d"],
            "_c": then["_c"] * first["_a"] + then["_d"] * first["_c"], "_d": then["_c"] * first["_b"] + then["_d"] * first["_d"]}


def equity_sized(sig: DataFrame, initial_cash: float = 1000.0, slippage: float = SLIPPAGE, fees: float = FEES,
                 chunk: int | None = None) -> DataFrame:
    """Portfolio value when each signal trades only a `confidence` share.

    An entry spends that share of the cash, an exit sells that share of the
    holding.  Either is linear in (cash, shares), so a bar is a 2x2 matrix and the
    state after it the product of all matrices up to it: a scan, on series of any
    length.  A bar without a positive price trades nothing.
    """
    buy, sell = (1.0 + slippage) * (1.0 + fees), (1.0 - slippage) * (1.0 - fees)
    entry, leave = (F.coalesce(F.col(c), F.lit(False)) for c in ("entry_signal", "exit_signal"))
    priced = F.coalesce(F.col("close") > 0, F.lit(False))
    size, none = F.coalesce(F.col("confidence").cast("double"), F.lit(0.0)), F.lit(0.0)
    enters, leaves = entry & ~leave & priced, leave & ~entry & priced
    close = F.col("close").cast("double")
    bar = {"_a": F.when(enters, 1.0 - size).otherwise(1.0), "_b": F.when(leaves, size * close * sell).otherwise(none),
           "_c": F.when(enters, safe_div(size, close * buy)).otherwise(none), "_d": F.when(leaves, 1.0 - size).otherwise(1.0)}
    identity = {"_a": 1.0, "_b": 0.0, "_c": 0.0, "_d": 1.0}
    done = scanned(sig.select("ticker", "date", "close", "entry_signal", "exit_signal", "confidence"), bar, _after, identity, chunk=chunk)
    cash, shares = F.col("_a") * float(initial_cash), F.col("_c") * float(initial_cash)
    return done.select("ticker", "date", cash.alias("cash"), shares.alias("shares"), (cash + shares * F.col("close")).alias("equity"))
