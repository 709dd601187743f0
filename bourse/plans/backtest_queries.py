"""Queries over signal backtests, risk measures and position limits."""

from __future__ import annotations

from pyspark.sql import functions as F

from bourse.operators import aggregates as agg
from bourse.operators import backtest as bt
from bourse.operators import joins, risk
from bourse.plans import fixtures as fx
from bourse.plans.price_queries import HOURLY, sroll
from bourse.plans.registry import out, query, sql
from bourse.session import stored
from bourse.sources import bars as bar_src

B = fx.BARS_CTE
ENTRY, EXIT = 1.0, 0.5

PREDS = f"preds AS (SELECT ticker, date, close, {sroll('avg', 'close', 20)} AS predicted FROM calm)"
SIG = f"""sig AS (SELECT *, coalesce(gap_pct >= {ENTRY}, false) AS entry_signal, coalesce(gap_pct <= -{EXIT}, false) AS exit_signal
  FROM (SELECT *, (predicted - close) / nullif(close, 0) * 100 AS gap_pct FROM preds) g)"""
# the state machine written as a recursive fold, one bar per step
FOLD = """so AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY date) AS rn FROM sig),
fold(ticker, date, rn, close, position, opened, closed, equity, growth) AS (
  SELECT ticker, date, rn, close, entry_signal::INT, entry_signal, false,
         CASE WHEN entry_signal THEN 1000.0 / 1.001 ELSE CAST(1000 AS DOUBLE) END, CASE WHEN entry_signal THEN 1 / CAST(1.001 AS DOUBLE) ELSE 1.0 END FROM so WHERE rn = 1
  UNION ALL
  SELECT s.ticker, s.date, s.rn, s.close,
    CASE WHEN s.entry_signal THEN 1 WHEN s.exit_signal THEN 0 ELSE f.position END,
    s.entry_signal AND f.position = 0, s.exit_signal AND f.position = 1,
    f.equity * CASE WHEN s.entry_signal AND f.position = 0 THEN 1 / CAST(1.001 AS DOUBLE)
      WHEN s.exit_signal AND f.position = 1 THEN s.close / f.close * (1 - CAST(0.001 AS DOUBLE)) WHEN f.position = 1 THEN s.close / f.close ELSE 1 END,
    CASE WHEN s.entry_signal AND f.position = 0 THEN 1 / CAST(1.001 AS DOUBLE)
      WHEN s.exit_signal AND f.position = 1 THEN s.close / f.close * (1 - CAST(0.001 AS DOUBLE)) WHEN f.position = 1 THEN s.close / f.close ELSE 1 END
  FROM fold f JOIN so s ON s.ticker = f.ticker AND s.rn = f.rn + 1),
curve AS MATERIALIZED (SELECT *, growth - 1 AS ret FROM fold)"""
CURVE = [B, fx.CALM_CTE, PREDS, SIG, FOLD]


def predictions(spark, d):
    return bt.sma_predictions(fx.calm_bars(spark, d))


def curve(spark, d):
    return bt.run(predictions(spark, d), ENTRY, EXIT)


@query("bt_signals", sql([B, fx.CALM_CTE, PREDS, SIG], "SELECT ticker, date, predicted, gap_pct, entry_signal, exit_signal FROM sig", "predicted gap_pct"))
def bt_signals(spark, d):
    return out(bt.signals(predictions(spark, d), ENTRY, EXIT).select("ticker", "date", "predicted", "gap_pct", "entry_signal", "exit_signal"))


@query("bt_position", sql(CURVE, "SELECT ticker, date, position, opened, closed FROM curve"))
def bt_position(spark, d):
    return bt.position(bt.signals(predictions(spark, d), ENTRY, EXIT)).select("ticker", "date", "position", "opened", "closed")


@query("bt_equity", sql(CURVE, "SELECT ticker, date, equity, ret FROM curve", "equity ret", 4, ret=8))
def bt_equity(spark, d):
    return out(curve(spark, d).select("ticker", "date", "equity", "ret"), 4, ret=8)


RUIN = "ruin AS (SELECT * REPLACE (CASE WHEN date >= DATE '1997-06-01' AND ticker LIKE '%2' THEN 0 ELSE close END AS close) FROM calm)"


@query("bt_equity_ruin", sql([B, fx.CALM_CTE, RUIN, """held AS (SELECT ticker, date, close, lag(close) OVER w AS pc, row_number() OVER w AS rn FROM ruin WINDOW w AS (PARTITION BY ticker ORDER BY date)),
steps AS (SELECT *, CASE WHEN rn = 1 THEN 1 / CAST(1.001 AS DOUBLE) ELSE close / nullif(pc, 0) END AS growth FROM held),
runs AS (SELECT *, max((growth <= 0)::INT) OVER w AS lost, sum(CASE WHEN growth > 0 THEN ln(growth) END) OVER w AS lg FROM steps WINDOW w AS (PARTITION BY ticker ORDER BY date)),
val AS (SELECT ticker, date, growth - 1 AS ret, CASE WHEN lost = 1 THEN 0 ELSE exp(lg) END AS value FROM runs)"""], """
SELECT ticker, date, value * 1000 AS equity, ret,
  CASE WHEN ret IS NOT NULL THEN value / greatest(max(value) OVER (PARTITION BY ticker ORDER BY date), 1) - 1 END AS drawdown FROM val""", "equity ret drawdown", 6, equity=3))
def bt_equity_ruin(spark, d):
    """Bought on the first bar and held; some prices fall to 0 and stay there."""
    calm = fx.calm_bars(spark, d).withColumn("close", F.expr("CASE WHEN date >= DATE'1997-06-01' AND ticker LIKE '%2' THEN 0 ELSE close END"))
    sig = calm.withColumns({"entry_signal": F.lit(True), "exit_signal": F.lit(False)})
    c = bt.equity(bt.position(sig)).select("ticker", "date", "equity", "ret")
    dd = risk.drawdowns(c.select("ticker", "date", "ret")).select("ticker", "date", "drawdown")
    return out(c.join(dd, ["ticker", "date"], "left"), 6, equity=3)


CONF = "least(abs(coalesce(gap_pct, 0)) / 5, 1)"


SIZED = f"""so AS MATERIALIZED (SELECT *, {CONF} AS c, row_number() OVER (PARTITION BY ticker ORDER BY date) AS rn FROM sig),
fold(ticker, date, rn, cash, shares, equity) AS (
  SELECT ticker, date, rn, CASE WHEN entry_signal THEN 1000 * (1 - c) ELSE CAST(1000 AS DOUBLE) END, CASE WHEN entry_signal THEN 1000 * c / (close * 1.001) ELSE CAST(0 AS DOUBLE) END,
    CASE WHEN entry_signal THEN 1000 * (1 - c) + 1000 * c / (close * 1.001) * close ELSE CAST(1000 AS DOUBLE) END FROM so WHERE rn = 1
  UNION ALL
  SELECT ticker, date, rn, cash, shares, cash + shares * close FROM (
    SELECT s.ticker, s.date, s.rn, s.close,
      CASE WHEN s.entry_signal THEN f.cash * (1 - s.c) WHEN s.exit_signal THEN f.cash + f.shares * s.c * s.close * 0.999 ELSE f.cash END AS cash,
      CASE WHEN s.entry_signal THEN f.shares + f.cash * s.c / (s.close * 1.001) WHEN s.exit_signal THEN f.shares * (1 - s.c) ELSE f.shares END AS shares
    FROM fold f JOIN so s ON s.ticker = f.ticker AND s.rn = f.rn + 1) x)"""


@query("bt_equity_sized", sql([B, fx.CALM_CTE, PREDS, SIG, SIZED], "SELECT ticker, date, cash, shares, equity FROM fold", "cash shares equity", 4))
def bt_equity_sized(spark, d):
    sig = bt.signals(predictions(spark, d), ENTRY, EXIT).withColumn("confidence", F.expr(CONF))
    return out(bt.equity_sized(sig), 4)


@query("bt_trades", sql([*CURVE, """tids AS (SELECT *, sum(opened::INT) OVER (PARTITION BY ticker ORDER BY date) AS tid FROM curve)"""], """
SELECT e.ticker, e.tid AS trade_id, e.date AS entry_date, e.close * 1.001 AS entry_price, x.date AS exit_date, x.close * 0.999 AS exit_price,
  CAST(b.n AS BIGINT) AS bars, l.equity - e.equity * 1.001 AS pnl, l.equity / (e.equity * 1.001) - 1 AS trade_return,
  CASE WHEN x.date IS NULL THEN 'Open' ELSE 'Closed' END AS status
FROM (SELECT * REPLACE (CAST(tid AS BIGINT) AS tid) FROM tids WHERE opened) e LEFT JOIN (SELECT * FROM tids WHERE closed) x ON x.ticker = e.ticker AND x.tid = e.tid
JOIN (SELECT ticker, tid, count(*) AS n, max(date) AS last FROM tids WHERE position = 1 OR closed GROUP BY ALL) b ON b.ticker = e.ticker AND b.tid = e.tid
JOIN curve l ON l.ticker = e.ticker AND l.date = b.last""", "entry_price exit_price pnl trade_return", 4))
def bt_trades(spark, d):
    return out(bt.trades(curve(spark, d)), 4)


@query("bt_exposure", sql(CURVE, "SELECT ticker, date, CAST(position AS DOUBLE) AS net_exposure FROM curve"))
def bt_exposure(spark, d):
    return bt.exposure(curve(spark, d))


@query("bt_many", sql([fx.bars_cte(fine=True), fx.CALM_CTE, PREDS, SIG, FOLD], "SELECT ticker, date, ret, (equity / 1000 - 1) * 100 AS cumulative_return FROM curve", "ret cumulative_return", 4, ret=8))
def bt_many(spark, d):
    """All (up to 150) fine-grained tickers in one plan."""
    preds = bt.sma_predictions(fx.calm_bars(spark, d, fine=True))
    return out(bt.cumulative(bt.run(preds, ENTRY, EXIT)), 4, ret=8)


FINALS = "finals AS (SELECT ticker, arg_max((equity / 1000 - 1) * 100, date) AS final_return FROM curve GROUP BY ticker)"


def finals(spark, d):
    return agg.last_return(bt.cumulative(curve(spark, d)))


@query("agg_last_return", sql([*CURVE, FINALS], "SELECT * FROM finals", "final_return", 4))
def agg_last_return(spark, d):
    return out(finals(spark, d), 4)


@query("bt_final_returns", sql([*CURVE, FINALS], "SELECT ticker, final_return, final_return > 0 AS made_money FROM finals ORDER BY final_return DESC", "final_return", 4))
def bt_final_returns(spark, d):
    """Which tickers would have made money by mean reversion?  The whole path in one plan."""
    f = finals(spark, d).withColumn("made_money", F.col("final_return") > 0)
    return out(f, 4).orderBy(F.desc("final_return"))


@query("srt_final_return", sql([*CURVE, FINALS], "SELECT ticker, final_return FROM finals ORDER BY final_return DESC", "final_return", 4))
def srt_final_return(spark, d):
    return out(finals(spark, d).orderBy(F.desc("final_return")), 4)


@query("agg_pos_neg_count", sql([*CURVE, FINALS], """SELECT count(*) FILTER (final_return > 0) AS positive, count(*) FILTER (final_return <= 0) AS negative,
  count(final_return) AS total, count(*) FILTER (final_return > 0) / nullif(count(final_return), 0) AS positive_share FROM finals""", "positive_share"))
def agg_pos_neg_count(spark, d):
    return out(agg.win_loss_counts(finals(spark, d)))


SHARPE = "avg(ret) / nullif(stddev_samp(ret), 0) * sqrt(252)"


@query("agg_metric_summary", sql([*CURVE, FINALS, f"m AS (SELECT c.ticker, {SHARPE} AS sharpe, quantile_cont(ret, 0.05) AS var_hist FROM curve c GROUP BY ticker)"], """
SELECT metric_name, avg(v) AS average, min(v) AS minimum, max(v) AS maximum, stddev_pop(v) AS std_dev FROM (
  SELECT 'Cumulative Return (%)' AS metric_name, final_return AS v FROM finals UNION ALL SELECT 'Sharpe Ratio', sharpe FROM m
  UNION ALL SELECT 'Value-at-Risk (%)', var_hist FROM m) x WHERE v IS NOT NULL GROUP BY metric_name""", "average minimum maximum std_dev", 4))
def agg_metric_summary(spark, d):
    c = curve(spark, d)
    m = (agg.last_return(bt.cumulative(c)).join(risk.return_metrics(c).select("ticker", "sharpe", "var_hist"), "ticker"))
    return out(agg.summarise_metrics(m, {"final_return": "Cumulative Return (%)", "sharpe": "Sharpe Ratio",
                                         "var_hist": "Value-at-Risk (%)"}), 4)


# ------------------------------------------------------------------ hourly bars: a TIMESTAMP series
HOUR_CALM = "calm AS (SELECT ticker, date, 100 + close AS close FROM bars)"
HOUR_CURVE = [fx.TICKS_CTE, HOURLY, HOUR_CALM, PREDS, SIG, FOLD]


def hourly_predictions(spark, d):
    return bt.sma_predictions(bar_src.resample(fx.ticks(spark, d), "hour").withColumn("close", F.col("close") + 100))


def hourly_curve(spark, d):
    return bt.run(hourly_predictions(spark, d), ENTRY, EXIT)


@query("bt_hourly", sql(HOUR_CURVE, "SELECT ticker, date, position, opened, closed, ret, ln(equity) AS log_equity FROM curve", "ret log_equity"))
def bt_hourly(spark, d):
    c = hourly_curve(spark, d).select("ticker", F.col("date").cast("timestamp_ntz").alias("date"), "position", "opened", "closed", "ret", F.ln("equity").alias("log_equity"))
    return out(c)


@query("bt_equity_sized_hourly", sql([fx.TICKS_CTE, HOURLY, HOUR_CALM, PREDS, SIG, SIZED],
                                     "SELECT ticker, date, ln(equity) AS log_equity, cash / equity AS cash_share FROM fold", "log_equity cash_share"))
def bt_equity_sized_hourly(spark, d):
    """Sized orders on hourly bars, in chunks of 1,024 bars."""
    sig = bt.signals(hourly_predictions(spark, d), ENTRY, EXIT).withColumn("confidence", F.expr(CONF))
    e = bt.equity_sized(sig, chunk=1024)
    return out(e.select("ticker", F.col("date").cast("timestamp_ntz").alias("date"), F.ln("equity").alias("log_equity"), (F.col("cash") / F.col("equity")).alias("cash_share")))


# ------------------------------------------------------------------ risk
RF = 4.0
RFP = f"(pow(1 + {RF} / 100, 1.0 / 252) - 1)"


@query("risk_returns", sql(CURVE, "SELECT ticker, date, equity / lag(equity, 1, CAST(1000 AS DOUBLE)) OVER (PARTITION BY ticker ORDER BY date) - 1 AS ret FROM curve", "ret"))
def risk_returns(spark, d):
    return out(risk.bar_returns(curve(spark, d).select("ticker", "date", "equity"), start=1000.0).select("ticker", "date", "ret"))


def risk_query(key: str, select: str, digits: int = 4):
    column = key.removeprefix("risk_") if not key == "risk_cum" else "cumulative_return"
    columns = {"risk_var": ["var_hist", "var_normal"], "risk_vol": ["volatility"]}.get(key, [column])
    query(key, sql(CURVE, f"SELECT ticker, {select} FROM curve GROUP BY ticker", " ".join(columns), digits))(
        lambda spark, d: out(risk.return_metrics(curve(spark, d), RF).select("ticker", *columns), digits))


TOTAL = "product(1 + ret)"
risk_query("risk_sharpe", f"avg(ret - {RFP}) / nullif(stddev_samp(ret), 0) * sqrt(252) AS sharpe")
risk_query("risk_sortino", f"avg(ret - {RFP}) / nullif(sqrt(avg(pow(least(ret - {RFP}, 0), 2))), 0) * sqrt(252) AS sortino")
risk_query("risk_vol", "stddev_samp(ret) * sqrt(252) AS volatility")
risk_query("risk_cum", f"{TOTAL} - 1 AS cumulative_return")
risk_query("risk_cagr", f"pow({TOTAL}, 365.25 / nullif(max(date) - min(date), 0)) - 1 AS cagr")
risk_query("risk_var", "quantile_cont(ret, 0.05) AS var_hist, avg(ret) - 1.645 * stddev_samp(ret) AS var_normal", 5)

DD = """val AS (SELECT *, product(1 + ret) OVER (PARTITION BY ticker ORDER BY date) AS v FROM curve),
dd AS MATERIALIZED (SELECT ticker, date, ret, v / greatest(max(v) OVER (PARTITION BY ticker ORDER BY date), 1) - 1 AS dd FROM val)"""
EPI = """epi AS (SELECT ticker, g, min(dd) AS depth, max(date) - min(date) + 1 AS days FROM (
  SELECT *, sum((dd >= -1e-12)::INT) OVER (PARTITION BY ticker ORDER BY date) AS g FROM dd) x WHERE dd < -1e-12 GROUP BY ticker, g),
ddm AS (SELECT t.ticker, coalesce(min(depth), 0) AS max_drawdown, coalesce(avg(depth), 0) AS avg_drawdown, CAST(coalesce(max(days), 0) AS INTEGER) AS longest_days
  FROM (SELECT DISTINCT ticker FROM curve) t LEFT JOIN epi e ON e.ticker = t.ticker GROUP BY t.ticker)"""
SER = f"""cuts AS (SELECT ticker, avg(dd) - 1.645 * stddev_samp(dd) AS cut FROM dd GROUP BY ticker),
cv AS (SELECT d.ticker, avg(dd) FILTER (dd < cut) AS cvar, sum(ret) AS total, stddev_samp(ret) AS sd, sqrt(sum(dd * dd) / nullif(count(*) - 1, 0)) AS ulcer
  FROM dd d JOIN cuts c ON c.ticker = d.ticker GROUP BY d.ticker),
ser AS (SELECT ticker, (total - {RF} / 100) / nullif(nullif(ulcer, 0) * (-cvar / nullif(sd, 0)), 0) AS serenity FROM cv)"""


@query("risk_drawdown", sql([*CURVE, DD, EPI], "SELECT * FROM ddm", "max_drawdown avg_drawdown"))
def risk_drawdown(spark, d):
    return out(risk.drawdown_metrics(curve(spark, d)))


@query("risk_serenity", sql([*CURVE, DD, SER], "SELECT * FROM ser", "serenity", 4))
def risk_serenity(spark, d):
    return out(risk.serenity(curve(spark, d), RF), 4)


@query("risk_hourly", sql([*HOUR_CURVE, DD, EPI.replace("max(date) - min(date) + 1", "date_diff('day', min(date), max(date)) + 1"), SER, f"""
m AS (SELECT ticker, {SHARPE} AS sharpe, quantile_cont(ret, 0.05) AS var_hist, stddev_samp(ret) * sqrt(252) AS volatility FROM curve GROUP BY ticker)"""], """
SELECT m.*, d.max_drawdown, d.avg_drawdown, s.serenity FROM m JOIN ddm d ON d.ticker = m.ticker JOIN ser s ON s.ticker = m.ticker""",
                          "sharpe var_hist volatility max_drawdown avg_drawdown serenity", 4))
def risk_hourly(spark, d):
    """Backtest and risk measures of hourly bars in one chain."""
    m = risk.return_metrics(c := stored(hourly_curve(spark, d).select("ticker", "date", "ret"), "curve"))
    m = m.join(risk.drawdown_metrics(c), "ticker").join(risk.serenity(c, RF), "ticker")
    return out(m.select("ticker", "sharpe", "var_hist", "volatility", "max_drawdown", "avg_drawdown", "serenity"), 4)


# benchmark: the average close of all tickers by date
BENCH = """bench AS (SELECT date, c / lag(c) OVER (ORDER BY date) - 1 AS bret FROM (SELECT date, avg(close) AS c FROM calm GROUP BY date) x)"""


def benchmark(spark, d):
    b = (fx.calm_bars(spark, d).groupBy("date").agg(F.avg("close").alias("close")).withColumn("ticker", F.lit("benchmark")))
    return risk.bar_returns(b, "close").where("ret IS NOT NULL").select("date", "ret")


@query("join_benchmark", sql([*CURVE, BENCH], "SELECT c.ticker, c.date, c.ret, b.bret AS benchmark_ret FROM curve c JOIN bench b ON b.date = c.date WHERE b.bret IS NOT NULL", "ret benchmark_ret"))
def join_benchmark(spark, d):
    return out(joins.returns_with_benchmark(curve(spark, d).select("ticker", "date", "ret"), benchmark(spark, d)))


def metrics_sql(source: str, name: str) -> str:
    """All ten measures of a (ticker, date, ret) relation, unpivoted."""
    dd = (DD + "," + EPI + "," + SER)
    for n in ("val", "dd", "epi", "ddm", "cuts", "cv", "ser"):
        dd = dd.replace(f"{n} AS ", f"{n}_{name} AS ").replace(f"FROM {n}) ", f"FROM {n}_{name}) ").replace(f"FROM {n} ", f"FROM {n}_{name} ").replace(f"JOIN {n} ", f"JOIN {n}_{name} ").replace(f"FROM {n})", f"FROM {n}_{name})")
    dd = dd.replace("FROM curve", f"FROM {source}").replace("AS MATERIALIZED", "AS")
    return f"""{dd},
base_{name} AS (SELECT ticker, avg(ret - {RFP}) / nullif(stddev_samp(ret), 0) * sqrt(252) AS sharpe,
  avg(ret - {RFP}) / nullif(sqrt(avg(pow(least(ret - {RFP}, 0), 2))), 0) * sqrt(252) AS sortino, stddev_samp(ret) * sqrt(252) AS volatility,
  {TOTAL} - 1 AS total, pow({TOTAL}, 365.25 / nullif(max(date) - min(date), 0)) - 1 AS cagr, avg(ret) - 1.645 * stddev_samp(ret) AS var_normal
  FROM {source} GROUP BY ticker),
long_{name} AS (SELECT b.ticker, unnest([
  {{'m': 'Ann. Return (CAGR) %', 'v': cagr * 100}}, {{'m': 'Cumulative Return %', 'v': total * 100}}, {{'m': 'Ann. Volatility %', 'v': volatility * 100}},
  {{'m': 'Sharpe Ratio', 'v': sharpe}}, {{'m': 'Serenity Ratio', 'v': serenity}}, {{'m': 'Sortino Ratio', 'v': sortino}}, {{'m': 'Daily Value-at-Risk %', 'v': var_normal * 100}},
  {{'m': 'Avg Drawdown %', 'v': avg_drawdown * 100}}, {{'m': 'Max Drawdown %', 'v': max_drawdown * 100}}, {{'m': 'Max Time-under-water (days)', 'v': CAST(longest_days AS DOUBLE)}}]) AS r
  FROM base_{name} b JOIN ddm_{name} d ON d.ticker = b.ticker JOIN ser_{name} s ON s.ticker = b.ticker)"""


@query("risk_tearsheet", sql([*CURVE, BENCH, "brets AS (SELECT 'benchmark' AS ticker, date, bret AS ret FROM bench WHERE bret IS NOT NULL)",
                              metrics_sql("curve", "s"), metrics_sql("brets", "b")], """
SELECT s.ticker, s.r.m AS metric, s.r.v AS strategy, b.r.v AS benchmark, s.r.v - b.r.v AS delta
FROM long_s s JOIN long_b b ON b.r.m = s.r.m""", "strategy benchmark delta", 3))
def risk_tearsheet(spark, d):
    return out(risk.tearsheet(curve(spark, d).select("ticker", "date", "ret"), benchmark(spark, d), RF)
               .select("ticker", "metric", "strategy", "benchmark", "delta"), 3)


# ------------------------------------------------------------------ positions
POS = fx.POSITIONS_CTE
CASH = fx.ACCOUNT_CASH
LIMITS = f"""tot AS (SELECT {CASH} + coalesce(sum(cost_basis), 0) AS portfolio_value FROM positions),
px_last AS (SELECT ticker, arg_max(close, date) AS price FROM bars GROUP BY ticker),
limits AS (SELECT l.ticker, price, coalesce(p.cost_basis, 0) AS current_position, portfolio_value, 0.2 * portfolio_value AS position_limit,
  0.2 * portfolio_value - coalesce(p.cost_basis, 0) AS remaining_limit FROM px_last l CROSS JOIN tot LEFT JOIN positions p ON p.ticker = l.ticker),
capped AS (SELECT *, least(remaining_limit, {CASH}) AS remaining_position_limit FROM limits)"""


@query("agg_portfolio_total", sql([B, POS], f"SELECT {CASH} + sum(cost_basis) AS portfolio_value FROM positions", "portfolio_value", 3))
def agg_portfolio_total(spark, d):
    return out(risk.portfolio_total(fx.positions(fx.bars(spark, d)), CASH), 3)


@query("agg_latest_price", sql(B, "SELECT ticker, arg_max(close, date) AS price FROM bars GROUP BY ticker", "price"))
def agg_latest_price(spark, d):
    return out(risk.latest_prices(fx.bars(spark, d)))


@query("risk_position_limit", sql([B, POS, LIMITS], "SELECT ticker, price, current_position, portfolio_value, position_limit, remaining_limit, remaining_position_limit FROM capped",
                                  "price current_position portfolio_value position_limit remaining_limit remaining_position_limit", 3))
def risk_position_limit(spark, d):
    b = fx.bars(spark, d)
    return out(risk.position_limits(b, fx.positions(b), CASH).drop("max_shares"), 3)


@query("risk_max_shares", sql([B, POS, LIMITS], "SELECT ticker, CASE WHEN price > 0 THEN CAST(trunc(remaining_position_limit / price) AS BIGINT) ELSE 0 END AS max_shares FROM capped"))
def risk_max_shares(spark, d):
    b = fx.bars(spark, d)
    return risk.position_limits(b, fx.positions(b), CASH).select("ticker", "max_shares")
