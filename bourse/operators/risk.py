"""Portfolio risk measures over return series.

Definitions (252 periods a year, r = bar return, e = r - rf per period):
  sharpe     avg(e) / stddev_samp(r) * sqrt(252)
  sortino    avg(e) / sqrt(avg(min(e, 0)^2)) * sqrt(252)
  volatility stddev_samp(r) * sqrt(252)
  cagr       (prod(1 + r)) ^ (365.25 / calendar days) - 1
  var_hist   5 % quantile of r;  var_normal  avg(r) - 1.645 * stddev_samp(r)
  drawdown   value / running peak - 1, the peak starting at the initial value
  serenity   (sum(r) - rf) / (ulcer * pitfall), ulcer = sqrt(sum(dd^2)/(n-1)),
             pitfall = -avg(dd below avg(dd) - 1.645 * stddev(dd)) / stddev_samp(r)
rf is given in percent a year and spread geometrically over the periods.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bourse.functions.columns import safe_div
from bourse.operators.series import is_daily, open_series, running, settled

PERIODS = 252.0
Z95 = 1.645
VAR_SHARE = 0.05


def bar_returns(curve: DataFrame, value: str = "equity", start: float | None = None) -> DataFrame:
    """Return of each bar against the one before (the first against `start`, if given)."""
    s = open_series(curve, memory=1)
    prev = F.lag(value).over(s.w())
    if start is not None:
        prev = F.coalesce(prev, F.lit(float(start)))
    return s.with_columns({"ret": safe_div(F.col(value), prev) - 1.0}).close()


def period_rate(rf_pct: float) -> float:
    return (1.0 + rf_pct / 100.0) ** (1.0 / PERIODS) - 1.0


def total_return(r: Column) -> Column:
    """prod(1 + r) - 1 as an aggregate; -1 when a return reaches -100 %."""
    grown = F.expm1(F.sum(F.log1p(F.when(r > -1.0, r))))
    return F.when(F.min(r) <= -1.0, F.lit(-1.0)).otherwise(grown)


def _return_aggregates(rf_pct: float) -> list[Column]:
    r = F.col("ret")
    e = r - F.lit(period_rate(rf_pct))
    down = F.least(e, F.lit(0.0))
    root = F.lit(math.sqrt(PERIODS))
    total = total_return(r)
    days = F.datediff(F.max("date"), F.min("date"))
    return [
        F.count(r).alias("n"),
        (safe_div(F.avg(e), F.stddev_samp(r)) * root).alias("sharpe"),
        (safe_div(F.avg(e), F.sqrt(F.avg(down * down))) * root).alias("sortino"),
        (F.stddev_samp(r) * root).alias("volatility"),
        (F.pow(1.0 + total, F.lit(365.25) / F.nullif(days, F.lit(0))) - 1.0).alias("cagr"),
        total.alias("cumulative_return"),
        F.percentile(r, F.lit(VAR_SHARE)).alias("var_hist"),
        (F.avg(r) - Z95 * F.stddev_samp(r)).alias("var_normal")]


def return_metrics(returns: DataFrame, rf_pct: float = 0.0) -> DataFrame:
    """sharpe, sortino, volatility, cagr, cumulative return and VaR per ticker.

    Plain aggregates: partial sums are made before the shuffle.  The quantile of
    a daily series is taken over its (bounded) days; that of a longer one is
    searched for (`_long_quantile`).
    """
    if not is_daily(returns, "date"):
        kept = settled(returns.where(F.col("ret").isNotNull()).select("ticker", "date", "ret"))
        rest = kept.groupBy("ticker").agg(*[c for c in _return_aggregates(rf_pct)[:-2]], _return_aggregates(rf_pct)[-1])
        return rest.join(_long_quantile(kept), "ticker").select("ticker", *RETURN_METRICS)
    return returns.where(F.col("ret").isNotNull()).groupBy("ticker").agg(*_return_aggregates(rf_pct))


RETURN_METRICS = ["n", "sharpe", "sortino", "volatility", "cagr", "cumulative_return", "var_hist", "var_normal"]


#: percentages a sketch is asked for, and the most rows of a ticker that meet in one task
GRID, MEET = 1000, 65_536


def _long_quantile(returns: DataFrame, share: float = VAR_SHARE, meet: int = MEET) -> DataFrame:
    """(ticker, var_hist), exact: the range of values that holds the quantile is narrowed until few rows are left.

    A round sketches the values inside every ticker's range, takes the two neighbours of the wanted rank on the
    grid as the next range, and counts the rows below and inside it, all by partial aggregates.  A range keeps a few
    thousandths of its rows, so even a ticker with a third of the table needs few rounds; then at
    most `meet` rows strictly inside a range are ordered.  Equal values count as one row there.
    """
    r = F.col("ret")
    floats = [i / GRID for i in range(GRID + 1)]
    rank = (F.col("_n") - 1) * share

    def bracket(inside: DataFrame, below: Column, rows: Column) -> DataFrame:
        """The next range of each ticker: `inside` holds the rows of its present one."""
        # the share of rows up to the rank: a grid point below it and one above lie on either side of the value
        at = F.least(F.floor((F.floor(rank) - below + 1) / rows * GRID), F.lit(GRID)).cast("int")
        e = inside.groupBy("ticker").agg(F.max("_n").alias("_n"), F.max("_below").alias("_below"), F.max("_in").alias("_in"),
                                         F.percentile_approx(r, floats, 10_000).alias("_e"))
        return e.select("ticker", "_n", F.element_at("_e", F.greatest(at - 1, F.lit(0)) + 1).alias("_a"),
                        F.element_at("_e", F.least(at + 2, F.lit(GRID)) + 1).alias("_b"))

    def counted(ranges: DataFrame) -> DataFrame:
        both = returns.join(ranges, "ticker")
        return settled(both.groupBy("ticker", "_n", "_a", "_b").agg(
            F.count_if(r < F.col("_a")).alias("_below"), F.count_if((r >= F.col("_a")) & (r <= F.col("_b"))).alias("_in"),
            F.count_if((r > F.col("_a")) & (r < F.col("_b"))).alias("_between"), F.min(F.when(r > F.col("_b"), r)).alias("_next")))

    sizes = returns.groupBy("ticker").agg(F.count(r).alias("_n")).withColumns({"_below": F.lit(0).cast("bigint"), "_in": F.col("_n")})
    state = counted(bracket(returns.join(sizes, "ticker"), F.col("_below"), F.col("_in")))
    while not (wide := state.where(F.col("_between") > meet)).isEmpty():
        inside = returns.join(wide.select("ticker", "_n", "_a", "_b", "_below", "_in"), "ticker").where(r.between(F.col("_a"), F.col("_b")))
        state = settled(state.where(F.col("_between") <= meet).unionByName(counted(bracket(inside, F.col("_below"), F.col("_in")))))
    inside = (returns.join(state, "ticker").where(r.between(F.col("_a"), F.col("_b")))
              .groupBy("ticker", "ret").agg(F.count(F.lit(1)).alias("k")))
    w = Window.partitionBy("ticker").orderBy("ret").rowsBetween(Window.unboundedPreceding, 0)
    at = inside.withColumn("_upto", F.sum("k").over(w)).join(state.select("ticker", "_n", "_below", "_next"), "ticker")
    last = F.col("_below") + F.col("_upto") - 1  # rank of the value's last row, from 0
    low = F.min(F.when(last >= F.floor(rank), r))
    high = F.coalesce(F.min(F.when(last >= F.ceil(rank), r)), F.min("_next"))
    got = at.groupBy("ticker").agg(low.alias("_low"), high.alias("_high"), F.max(rank - F.floor(rank)).alias("_share"))
    return got.select("ticker", (F.col("_low") + (F.col("_high") - F.col("_low")) * F.col("_share")).alias("var_hist"))


def drawdowns(returns: DataFrame) -> DataFrame:
    """Per bar: growth of 1, its running peak, and the drawdown (never positive)."""
    g = running(returns.where(F.col("ret").isNotNull()), {
        "_log": ("sum", F.log1p(F.when(F.col("ret") > -1.0, F.col("ret")))), "_lost": ("max", (F.col("ret") <= -1.0).cast("int"))})
    g = g.withColumn("value", F.when(F.col("_lost") == 1, F.lit(0.0)).otherwise(F.exp(F.coalesce("_log", F.lit(0.0))))).drop("_log", "_lost")
    g = running(g, {"_peak": ("max", F.col("value"))})
    return (g.withColumn("peak", F.greatest(F.col("_peak"), F.lit(1.0))).drop("_peak")
            .withColumn("drawdown", F.col("value") / F.col("peak") - 1.0))


def episodes(dd: DataFrame) -> DataFrame:
    """One row per stretch below the peak: depth, first and last day, length in days."""
    at_peak = F.when(F.col("drawdown") >= -1e-12, 1).otherwise(0)
    runs = running(dd, {"_episode": ("sum", at_peak)}).where(F.col("drawdown") < -1e-12)
    return (runs.groupBy("ticker", F.col("_episode").alias("episode"))
            .agg(F.min("drawdown").alias("depth"), F.min("date").alias("start"), F.max("date").alias("end"),
                 F.count(F.lit(1)).alias("bars"))
            .withColumn("days", F.datediff("end", "start") + 1))


def drawdown_metrics(returns: DataFrame) -> DataFrame:
    """Worst and average drawdown and the longest time under water, per ticker."""
    if is_daily(returns, "date"):
        return _daily_metrics(returns, 0.0).select("ticker", "max_drawdown", "avg_drawdown", "longest_days")
    dd = drawdowns(returns)
    e = episodes(dd).groupBy("ticker").agg(
        F.min("depth").alias("max_drawdown"), F.avg("depth").alias("avg_drawdown"), F.max("days").alias("longest_days"))
    return (returns.where(F.col("ret").isNotNull()).select("ticker").distinct().join(e, "ticker", "left")
            .fillna({"max_drawdown": 0.0, "avg_drawdown": 0.0, "longest_days": 0}))


def _serenity(rf_pct: float, cvar: Column) -> Column:
    """The ratio from aggregates over `ret` and `drawdown`; `cvar` is the mean of the tail."""
    x, r = F.col("drawdown"), F.col("ret")
    ulcer = F.sqrt(safe_div(F.sum(x * x), F.count(x) - 1.0))
    return safe_div(F.sum(r) - rf_pct / 100.0, ulcer * safe_div(-cvar, F.stddev_samp(r)))


def _tail_cut(x: Column, over=None) -> Column:
    if over is None:
        return F.avg(x) - Z95 * F.stddev_samp(x)
    return F.avg(x).over(over) - Z95 * F.stddev_samp(x).over(over)


def serenity(returns: DataFrame, rf_pct: float = 0.0) -> DataFrame:
    """Serenity ratio per ticker.

    Daily series: the cut of the tail is a window column over the partitioning
    the drawdown already has.  Longer series: the cut is aggregated and joined
    back, so that no task holds a whole ticker.
    """
    dd = drawdowns(returns).select("ticker", "ret", "drawdown")
    x = F.col("drawdown")
    if is_daily(returns, "date"):
        cut = dd.withColumn("_cut", _tail_cut(x, Window.partitionBy("ticker")))
    else:
        cut = dd.join(dd.groupBy("ticker").agg(_tail_cut(x).alias("_cut")), "ticker")
    return cut.groupBy("ticker").agg(_serenity(rf_pct, F.avg(F.when(x < F.col("_cut"), x))).alias("serenity"))


TEARSHEET = {
    "Ann. Return (CAGR) %": ("cagr", 100.0),
    "Cumulative Return %": ("cumulative_return", 100.0),
    "Ann. Volatility %": ("volatility", 100.0),
    "Sharpe Ratio": ("sharpe", 1.0),
    "Serenity Ratio": ("serenity", 1.0),
    "Sortino Ratio": ("sortino", 1.0),
    "Daily Value-at-Risk %": ("var_normal", 100.0),
    "Avg Drawdown %": ("avg_drawdown", 100.0),
    "Max Drawdown %": ("max_drawdown", 100.0),
    "Max Time-under-water (days)": ("longest_days", 1.0),
}


def all_metrics(returns: DataFrame, rf_pct: float = 0.0) -> DataFrame:
    """All measures, one row per ticker."""
    if is_daily(returns, "date"):
        return _daily_metrics(returns, rf_pct)
    return (return_metrics(returns, rf_pct).join(drawdown_metrics(returns), "ticker")
            .join(serenity(returns, rf_pct), "ticker"))


def _daily_metrics(returns: DataFrame, rf_pct: float) -> DataFrame:
    """Daily series need a single exchange: drawdown, episodes and the tail cut
    are window columns over (ticker), the measures one aggregation of them."""
    x = F.col("drawdown")
    under = F.when(x < -1e-12, x)
    df = running(drawdowns(returns), {"_episode": ("sum", F.when(x >= -1e-12, 1).otherwise(0))})
    one, ticker = Window.partitionBy("ticker", "_episode"), Window.partitionBy("ticker")
    day = F.when(under.isNotNull(), F.col("date"))
    df = df.withColumns({"_depth": F.min(under).over(one), "_from": F.min(day).over(one), "_to": F.max(day).over(one)})
    # one row of each episode speaks for it
    speaks = F.col("date") == F.col("_from")
    df = df.withColumns({"_depth": F.when(speaks, F.col("_depth")),
                         "_days": F.when(speaks, F.datediff("_to", "_from") + 1),
                         "_cut": _tail_cut(x, ticker)})
    return df.groupBy("ticker").agg(
        *_return_aggregates(rf_pct),
        F.coalesce(F.min("_depth"), F.lit(0.0)).alias("max_drawdown"),
        F.coalesce(F.avg("_depth"), F.lit(0.0)).alias("avg_drawdown"),
        F.coalesce(F.max("_days"), F.lit(0)).alias("longest_days"),
        _serenity(rf_pct, F.avg(F.when(x < F.col("_cut"), x))).alias("serenity"))


def tearsheet(strategy: DataFrame, benchmark: DataFrame, rf_pct: float = 0.0) -> DataFrame:
    """(ticker, metric, strategy, benchmark, delta): ten rows per ticker.

    `benchmark` holds one series (date, ret); its metrics are one row.
    """
    def long(df, name, *key):
        rows = F.array(*[F.struct(F.lit(m).alias("metric"), (F.col(c).cast("double") * k).alias(name))
                         for m, (c, k) in TEARSHEET.items()])
        return df.select(*key, F.explode(rows).alias("r")).select(*key, "r.*")

    s = long(all_metrics(strategy, rf_pct), "strategy", "ticker")
    b = long(all_metrics(benchmark.withColumn("ticker", F.lit("benchmark")), rf_pct), "benchmark")
    # the benchmark side is ten rows whatever the data
    return s.join(F.broadcast(b), "metric").withColumn("delta", F.col("strategy") - F.col("benchmark"))


# ------------------------------------------------------------------ position limits
MAX_POSITION_SHARE = 0.20


def portfolio_total(positions: DataFrame, cash: float) -> DataFrame:
    return positions.agg((F.coalesce(F.sum("cost_basis"), F.lit(0.0)) + F.lit(float(cash))).alias("portfolio_value"))


def latest_prices(bars: DataFrame) -> DataFrame:
    return bars.groupBy("ticker").agg(F.max_by("close", "date").alias("price"))


def position_limits(bars: DataFrame, positions: DataFrame, cash: float) -> DataFrame:
    """How much more may be put into each ticker: 20 % of the portfolio less what is held, at most the cash."""
    held = positions.groupBy("ticker").agg(F.sum("cost_basis").alias("current_position"))
    df = (latest_prices(bars).join(held, "ticker", "left").fillna(0.0, ["current_position"])
          .withColumn("portfolio_value", portfolio_total(positions, cash).scalar()))
    limit = F.col("portfolio_value") * MAX_POSITION_SHARE
    return (df.withColumn("position_limit", limit)
            .withColumn("remaining_limit", F.col("position_limit") - F.col("current_position"))
            .withColumn("remaining_position_limit", F.least(F.col("remaining_limit"), F.lit(float(cash))))
            .withColumn("max_shares", max_shares(F.col("remaining_position_limit"), F.col("price"))))


def max_shares(limit: Column, price: Column) -> Column:
    """limit / price cut toward zero; 0 without a positive price."""
    return F.when(price > 0, (limit / price).cast("bigint")).otherwise(F.lit(0).cast("bigint"))
