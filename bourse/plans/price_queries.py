"""Queries over bars, news and calendars."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from bourse.functions.columns import rnd
from bourse.operators import aggregates as agg
from bourse.operators import calendar as cal
from bourse.operators import joins, windows
from bourse.operators.backtest import sma_predictions
from bourse.operators.features import feature_table
from bourse.operators.indicators import INDICATORS, add_indicators, add_to_series, memory_of
from bourse.plans import fixtures as fx
from bourse.plans.registry import ORACLES, out, query, sql, sql_round
from bourse.sources import bars as bar_src
from bourse.sources import news as news_src
from bourse.sources import reference as ref
from bourse.sources import tables

B = fx.BARS_CTE
W = "OVER (PARTITION BY ticker ORDER BY date)"


def frame(n: int) -> str:
    return f"OVER (PARTITION BY ticker ORDER BY date ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def sroll(fn: str, x: str, n: int) -> str:
    return f"CASE WHEN count({x}) {frame(n)} = {n} THEN {fn}({x}) {frame(n)} END"


# ------------------------------------------------------------------ sources
@query("src_bars", sql(B, "SELECT * FROM bars WHERE date BETWEEN DATE '1997-01-01' AND DATE '1999-12-31' AND ticker IN ('Brand#1', 'Brand#7', 'Brand#12')",
                       "open high low close volume"))
def src_bars(spark, d):
    return out(bar_src.select_bars(fx.bars(spark, d), ["Brand#1", "Brand#7", "Brand#12"], "1997-01-01", "1999-12-31"))


@query("src_bars_resample", sql(fx.TICKS_CTE, """
SELECT ticker, make_timestamp(CAST(floor(epoch(ts) / 14400) * 14400 * 1000000 AS BIGINT)) AS date,
       arg_min(px, struct_pack(a := ts, b := id)) AS open, max(px) AS high, min(px) AS low,
       arg_max(px, struct_pack(a := ts, b := id)) AS close, sum(size) AS volume
FROM ticks GROUP BY ALL""", "open high low close volume"))
def src_bars_resample(spark, d):
    b = bar_src.resample(fx.ticks(spark, d), "hour", 4)
    return out(b.withColumn("date", F.col("date").cast("timestamp_ntz")))


@query("src_bars_resample_month", sql(B, """
SELECT ticker, CAST(date_trunc('month', date) AS DATE) AS date, arg_min(open, date) AS open, max(high) AS high,
       min(low) AS low, arg_max(close, date) AS close, sum(volume) AS volume
FROM bars GROUP BY ALL""", "open high low close volume"))
def src_bars_resample_month(spark, d):
    b = fx.bars(spark, d)
    return out(b.groupBy("ticker", bar_src.bar_time(F.col("date"), "month").alias("date"))
               .agg(F.min_by("open", "date").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"),
                    F.max_by("close", "date").alias("close"), F.sum("volume").alias("volume")))


@query("src_ts_to_date", """
SELECT CAST(((ts AT TIME ZONE 'UTC') AT TIME ZONE 'America/New_York') AS DATE) AS ny_date, count(*) AS n,
       min(event_id) AS first_event, max(event_id) AS last_event
FROM events GROUP BY ALL""")
def src_ts_to_date(spark, d):
    ev = fx.table(spark, d, "events")
    ms = F.expr("timestampdiff(MILLISECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)")
    return (ev.groupBy(bar_src.trading_date(ms).alias("ny_date"))
            .agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first_event"), F.max("event_id").alias("last_event")))


STOCH14 = f"""d AS (SELECT ticker, date, close, close - lag(close) {W} AS delta FROM bars),
gl AS (SELECT *, CASE WHEN delta IS NOT NULL THEN greatest(delta, 0) END AS gain, CASE WHEN delta IS NOT NULL THEN -least(delta, 0) END AS loss FROM d),
av AS (SELECT *, {sroll('avg', 'gain', 14)} AS g14, {sroll('avg', 'loss', 14)} AS l14,
       {sroll('avg', 'gain', 28)} AS g28, {sroll('avg', 'loss', 28)} AS l28 FROM gl),
rs AS (SELECT *, CASE WHEN l14 > 0 THEN 100 - 100 / (1 + g14 / l14) WHEN g14 > 0 THEN 100.0 END AS rsi14,
       CASE WHEN l28 > 0 THEN 100 - 100 / (1 + g28 / l28) WHEN g28 > 0 THEN 100.0 END AS rsi28 FROM av),
st AS (SELECT *, {sroll('min', 'rsi14', 14)} AS lo14, {sroll('max', 'rsi14', 14)} AS hi14,
       {sroll('min', 'rsi28', 14)} AS lo28, {sroll('max', 'rsi28', 14)} AS hi28 FROM rs),
stoch AS (SELECT ticker, date, close, (rsi14 - lo14) / nullif(hi14 - lo14, 0) AS stoch_rsi14,
       (rsi28 - lo28) / nullif(hi28 - lo28, 0) AS stoch_rsi28 FROM st)"""


@query("src_index_bars", sql([B, STOCH14], """
SELECT b.ticker, b.date, b.close, i.stoch_rsi14 AS index_stoch_rsi
FROM bars b LEFT JOIN (SELECT date, stoch_rsi14 FROM stoch WHERE ticker = 'Brand#1') i ON b.date = i.date""",
                             "close index_stoch_rsi"))
def src_index_bars(spark, d):
    b = fx.bars(spark, d)
    idx = add_indicators(bar_src.index_bars(b, "Brand#1"), ["stoch_rsi14"]).withColumnRenamed("stoch_rsi14", "index_stoch_rsi")
    return out(joins.index_feature(b.select("ticker", "date", "close"), idx, "index_stoch_rsi"))


@query("src_news_flatten", """
SELECT ticker, date, sentiment, count(*) AS n FROM (
  SELECT unnest(['Brand#' || CAST(user_id % 25 + 1 AS VARCHAR), 'MARKET']) AS ticker, CAST(ts AS DATE) AS date,
         """ + fx._SENTIMENT_SQL + """ AS sentiment FROM events WHERE user_id % 10 <> 0) t GROUP BY ALL""")
def src_news_flatten(spark, d):
    flat = news_src.flatten_articles(fx.articles(spark, d))
    return flat.groupBy("ticker", "date", "sentiment").agg(F.count(F.lit(1)).alias("n"))


@query("src_index_members", sql(fx.INDEX_MEMBERS_CTE, """
SELECT ticker, CAST(min(i) AS INTEGER) AS first_index, CAST(arg_min(pos, i) AS INTEGER) AS first_pos FROM (
  SELECT ticker, pos, list_position(['EUROPE', 'ASIA', 'AFRICA'], index_name) AS i FROM index_members
  WHERE index_name IN ('EUROPE', 'ASIA', 'AFRICA') AND ticker IS NOT NULL) m GROUP BY ticker"""))
def src_index_members(spark, d):
    return ref.index_tickers(fx.index_members(spark, d), ["EUROPE", "ASIA", "AFRICA"])


@query("src_sample_tickers", "SELECT ticker FROM (SELECT DISTINCT p_brand AS ticker FROM part) t ORDER BY md5(ticker || '42') LIMIT 10")
def src_sample_tickers(spark, d):
    return ref.sample_tickers(fx.table(spark, d, "part").select(F.col("p_brand").alias("ticker")), 10, 42)


LANDED = "SELECT ticker, date, open, high, low, close, volume FROM bars WHERE date >= DATE '1997-01-01'"


def landed(spark, d, fmt, **options):
    """Bars written as text files and read back with the declared schema."""
    path = tables.work_folder(spark, fmt)
    rows = fx.bars(spark, d).where("date >= '1997-01-01'").select("ticker", "date", *bar_src.OHLCV)
    rows.write.format(fmt).options(**options).save(path)
    return out(bar_src.read_bars(spark, path, fmt, **options))


@query("src_bars_csv", sql(B, LANDED, "open high low close volume"))
def src_bars_csv(spark, d):
    return landed(spark, d, "csv", header="true")


@query("src_bars_json", sql(B, LANDED, "open high low close volume"))
def src_bars_json(spark, d):
    return landed(spark, d, "json")


STORED_SQL = "SELECT date AS \"Date\", ticker AS \"Ticker\", open AS \"Open\", high AS \"High\", low AS \"Low\", close AS \"Close\", volume AS \"Volume\" FROM bars"


@query("src_bars_stored", sql(B, "SELECT ticker, date, close, volume FROM bars WHERE date BETWEEN DATE '1996-03-01' AND DATE '1997-02-28' AND ticker IN ('Brand#11', 'Brand#32')", "close volume"))
def src_bars_stored(spark, d):
    """Bars stored by year and read back: year folders and tickers are pruned."""
    path = tables.work_folder(spark, "bars")
    tables.append_bars(fx.bars(spark, d), path)
    return out(tables.scan_bars(spark, path, ["Brand#11", "Brand#32"], "1996-03-01", "1997-02-28").select("ticker", "date", "close", "volume"))


@query("snk_table_append", sql(B, "SELECT CAST(year(\"Date\") AS INTEGER) AS \"Year\", count(*) AS n, min(\"Date\") AS first_date, max(\"Date\") AS last_date FROM (" + STORED_SQL + ") s GROUP BY ALL"))
def snk_table_append(spark, d):
    """Two appends (before and from 1998), then a read of the stored table."""
    path = tables.work_folder(spark, "daily")
    b = fx.bars(spark, d)
    tables.append_bars(b.where("date < '1998-01-01'"), path)
    tables.append_bars(b.where("date >= '1998-01-01'"), path)
    return (tables.scan_table(spark, path).groupBy("Year")
            .agg(F.count(F.lit(1)).alias("n"), F.min("Date").alias("first_date"), F.max("Date").alias("last_date")))


HOURLY = """bars AS MATERIALIZED (
  SELECT ticker, make_timestamp(CAST(floor(epoch(ts) / 3600) * 3600 * 1000000 AS BIGINT)) AS date,
         arg_min(px, struct_pack(a := ts, b := id)) AS open, max(px) AS high, min(px) AS low,
         arg_max(px, struct_pack(a := ts, b := id)) AS close, sum(size) AS volume
  FROM ticks GROUP BY ALL)"""

LOADED = """SELECT CAST(year(date) AS INTEGER) AS "Year", ticker AS "Ticker", count(*) AS n, sum(close + CASE WHEN {late} THEN 1 ELSE 0 END) AS total
FROM bars GROUP BY ALL"""


def _load_twice(spark, d, replace):
    """Three overlapping loads, the last one a repeat: prices of the later ones are higher by 1."""
    path = tables.work_folder(spark, "loads")
    b = fx.bars(spark, d)
    late = b.where("date >= '1996-07-01'").withColumn("close", F.col("close") + 1)
    tables.append_bars(b.where("date < '1998-01-01'"), path, replace=replace)
    for _ in range(2):
        tables.append_bars(late.unionByName(late.where("ticker = 'Brand#11'")), path, replace=replace)
    return out(tables.scan_table(spark, path).groupBy("Year", "Ticker").agg(F.count(F.lit(1)).alias("n"), F.sum("Close").alias("total")), 4)


@query("snk_table_append_twice", sql(B, LOADED.format(late="date >= DATE '1998-01-01'"), "total", 4))
def snk_table_append_twice(spark, d):
    """A key that is stored keeps its row."""
    return _load_twice(spark, d, False)


@query("snk_table_replace", sql(B, LOADED.format(late="date >= DATE '1996-07-01'"), "total", 4))
def snk_table_replace(spark, d):
    """A key that is stored gets the new row."""
    return _load_twice(spark, d, True)


@query("src_table_scan", sql(B, STORED_SQL, "Open High Low Close Volume"))
def src_table_scan(spark, d):
    path = tables.work_folder(spark, "scan")
    tables.append_bars(fx.bars(spark, d), path)
    return out(tables.scan_table(spark, path).select(*tables.STORED))


def bucketed(spark, bars, memory=0, chunk_rows=None):
    """The name of a bucketed table of bars below the shared folder."""
    name = f"bars_{uuid.uuid4().hex}"
    tables.save_bucketed(bars, name, 16, tables.work_folder(spark, "bucketed"), memory, chunk_rows)
    return name


BUCKETED = ["z_score", "b_percent", "volume_momentum"]
BUCKETED_SQL = f"""SELECT ticker, date, (close - ({sroll('avg', 'close', 50)})) / nullif({sroll('stddev_samp', 'close', 50)}, 0) AS z_score,
    (close - (({sroll('avg', 'close', 20)}) - 2 * ({sroll('stddev_samp', 'close', 20)}))) / nullif(4 * ({sroll('stddev_samp', 'close', 20)}), 0) AS b_percent,
    volume / nullif({sroll('avg', 'volume', 21)}, 0) AS volume_momentum FROM bars"""


def on_bucketed(spark, name):
    """Indicators of a bucketed table: no exchange, whatever its layout."""
    s = tables.bucketed_series(spark, name)
    return add_to_series(lambda memory: s, s.df, BUCKETED).select("ticker", "date", *BUCKETED)


@query("src_table_bucketed", sql([B], BUCKETED_SQL, " ".join(BUCKETED), 4))
def src_table_bucketed(spark, d):
    return out(on_bucketed(spark, bucketed(spark, fx.bars(spark, d))), 4)


@query("src_table_bucketed_hourly", sql([fx.TICKS_CTE, HOURLY], BUCKETED_SQL, " ".join(BUCKETED), 4))
def src_table_bucketed_hourly(spark, d):
    """Hourly bars in chunks of 200: the bars of one ticker lie in many buckets."""
    name = bucketed(spark, bar_src.resample(fx.ticks(spark, d), "hour"), memory_of(BUCKETED), 200)
    return out(on_bucketed(spark, name).withColumn("date", F.col("date").cast("timestamp_ntz")), 4)


@query("snk_table_clone", sql(B, STORED_SQL, "Open High Low Close Volume"))
def snk_table_clone(spark, d):
    source, target = tables.work_folder(spark, "source"), tables.work_folder(spark, "clone")
    tables.append_bars(fx.bars(spark, d), source)
    tables.clone_table(spark, source, target)
    return out(tables.scan_table(spark, target).select(*tables.STORED))


@query("chk_primary_key", "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def chk_primary_key(spark, d):
    return tables.duplicate_keys(fx.table(spark, d, "lineitem"), "l_orderkey", "l_linenumber")


DAILY = f"""daily AS (SELECT ticker, date, {', '.join(f"CAST(count(*) FILTER (sentiment = '{s}') AS BIGINT) AS {s}" for s in news_src.SENTIMENTS)}
FROM news GROUP BY ticker, date)"""


# ------------------------------------------------------------------ projections and filters
@query("prj_rename_ohlcv", sql(B, "SELECT ticker AS \"Ticker\", date AS \"Date\", open AS \"Open\", high AS \"High\", low AS \"Low\", close AS \"Close\", volume AS \"Volume\" FROM bars",
                               "Open High Low Close Volume"))
def prj_rename_ohlcv(spark, d):
    return out(bar_src.to_storage_names(fx.bars(spark, d)))


@query("prj_select_indicators", sql(B, f"""
SELECT ticker, shifted_prices, z_score, williams_r FROM (
  SELECT ticker, lead(close, 5) {W} AS shifted_prices,
         (close - ({sroll('avg', 'close', 50)})) / nullif({sroll('stddev_samp', 'close', 50)}, 0) AS z_score,
         -(({sroll('max', 'high', 14)}) - close) / nullif(({sroll('max', 'high', 14)}) - ({sroll('min', 'low', 14)}), 0) AS williams_r
  FROM bars) f WHERE shifted_prices IS NOT NULL AND z_score IS NOT NULL AND williams_r IS NOT NULL""",
                                    "shifted_prices z_score williams_r"))
def prj_select_indicators(spark, d):
    feats = add_indicators(windows.add_label(fx.bars(spark, d), 5), ["z_score", "williams_r"])
    return out(feats.select("ticker", "shifted_prices", "z_score", "williams_r").dropna("any"))


@query("prj_feature_table", sql([fx.NEWS_CTE, DAILY, B], f"""
SELECT f.ticker, f.date, f.shifted_prices, f.z_score, f.williams_r, f.close, coalesce(n.positive, 0) AS positive, coalesce(n.mixed, 0) AS mixed FROM (
  SELECT ticker, date, close, lead(close, 5) {W} AS shifted_prices,
         (close - ({sroll('avg', 'close', 50)})) / nullif({sroll('stddev_samp', 'close', 50)}, 0) AS z_score,
         -(({sroll('max', 'high', 14)}) - close) / nullif(({sroll('max', 'high', 14)}) - ({sroll('min', 'low', 14)}), 0) AS williams_r
  FROM bars) f LEFT JOIN (SELECT *, CAST(date - 8400 AS DATE) AS bar_date FROM daily) n ON n.ticker = f.ticker AND n.bar_date = f.date
WHERE shifted_prices IS NOT NULL AND z_score IS NOT NULL AND williams_r IS NOT NULL""", "shifted_prices z_score williams_r close", 5))
def prj_feature_table(spark, d):
    """Bars, indicators, news and label in one frame (news shifted onto the bars as in join_news_left)."""
    daily = news_src.daily_sentiment(fx.news(spark, d)).withColumn("date", F.date_sub("date", 8400))
    return out(feature_table(fx.bars(spark, d), ["z_score", "williams_r", "close", "positive", "mixed"], daily), 5)


@query("flt_ticker", sql(B, "SELECT * FROM bars WHERE ticker = 'Brand#7'", "open high low close volume"))
def flt_ticker(spark, d):
    return out(bar_src.select_bars(fx.bars(spark, d), "Brand#7"))


# ------------------------------------------------------------------ joins
@query("agg_sentiment_pivot", sql([fx.NEWS_CTE, DAILY], "SELECT * FROM daily"))
def agg_sentiment_pivot(spark, d):
    return news_src.daily_sentiment(fx.news(spark, d))


@query("join_news_left", sql([fx.NEWS_CTE, DAILY, B], f"""
SELECT b.ticker, b.date, b.close, {', '.join(f'coalesce({s}, 0) AS {s}' for s in news_src.SENTIMENTS)}
FROM (SELECT ticker, date + INTERVAL 8400 DAY AS nd, date, close FROM bars) b0,
     LATERAL (SELECT b0.ticker, b0.date, b0.close, CAST(b0.nd AS DATE) AS nd) b
LEFT JOIN daily n ON b.ticker = n.ticker AND b.nd = n.date""", "close"))
def join_news_left(spark, d):
    # the news cover one month of 2024: shift them back 8,400 days onto the bars
    daily = news_src.daily_sentiment(fx.news(spark, d)).withColumn("date", F.date_sub("date", 8400))
    return out(news_src.join_daily_sentiment(fx.bars(spark, d).select("ticker", "date", "close"), daily))


@query("join_predictions_left", sql(B, f"""
SELECT p.ticker, p.date, p.predicted, b.open, b.high, b.low, b.close, b.volume FROM (
  SELECT ticker, date, {sroll('avg', 'close', 20)} AS predicted FROM bars) p
LEFT JOIN (SELECT * FROM bars WHERE volume > 200) b ON p.ticker = b.ticker AND p.date = b.date""",
                                    "predicted open high low close volume"))
def join_predictions_left(spark, d):
    b = fx.bars(spark, d)
    preds = sma_predictions(b).select("ticker", "date", "predicted")
    return out(joins.predictions_with_prices(preds, b.where("volume > 200")))


DAYBARS = fx.bars_cte("day")


@query("join_asof_close", sql([DAYBARS, """asks AS (SELECT DISTINCT ticker, last_day(date) AS asof FROM bars)"""], """
SELECT a.ticker, a.asof, b.date, b.close FROM asks a ASOF LEFT JOIN bars b ON a.ticker = b.ticker AND a.asof >= b.date""", "close"))
def join_asof_close(spark, d):
    b = fx.bars(spark, d, "day")
    asks = b.select("ticker", F.last_day("date").alias("asof")).distinct()
    return out(joins.asof(asks, b, ["date", "close"]))


@query("join_asof_day", sql(fx.TICKS_CTE, """
SELECT t.ticker, CAST(t.ts AS DATE) AS day, arg_max(t.px, struct_pack(a := t.ts, b := t.px)) AS px
FROM ticks t GROUP BY ALL""", "px"))
def join_asof_day(spark, d):
    """Days asked of trades: the last trade of the day counts."""
    t = fx.ticks(spark, d)
    return out(joins.asof(t.select("ticker", F.to_date("ts").alias("day")).distinct(), t.select("ticker", "ts", "px"), ["px"], left_time="day", right_time="ts"))


@query("join_positions_left", sql([B, fx.POSITIONS_CTE], """
SELECT t.ticker, coalesce(p.cost_basis, 0) AS cost_basis FROM (SELECT DISTINCT ticker FROM bars) t
LEFT JOIN positions p ON t.ticker = p.ticker""", "cost_basis"))
def join_positions_left(spark, d):
    b = fx.bars(spark, d)
    return out(joins.with_positions(b.select("ticker").distinct(), fx.positions(b)).select("ticker", "cost_basis"))


# ------------------------------------------------------------------ indicators
def ema_cte(spans: list[int], source: str = "bars") -> str:
    """Recursive averages y = (1 - a) y' + a x, one step per bar."""
    init = ", ".join(f"close AS e{n}" for n in spans)
    step = ", ".join(f"(1 - 2.0 / ({n} + 1)) * r.e{n} + 2.0 / ({n} + 1) * o.close" for n in spans)
    return f"""ord AS MATERIALIZED (SELECT ticker, date, CAST(close AS DOUBLE) AS close, row_number() {W} AS rn FROM {source}),
ema(ticker, date, rn, close, {', '.join(f'e{n}' for n in spans)}) AS (
  SELECT ticker, date, rn, close, {init} FROM ord WHERE rn = 1
  UNION ALL
  SELECT o.ticker, o.date, o.rn, o.close, {step} FROM ema r JOIN ord o ON o.ticker = r.ticker AND o.rn = r.rn + 1)"""


def indicator(key: str, names: list[str], select: str, ctes: list[str] | None = None):
    """A query adding indicators to the bars; `select` gives ticker, date and the columns."""
    doubles = " ".join(n for n in names if not n.startswith(("trend", "bull", "bear")))
    query(key, sql([B] + (ctes or []), select, doubles, 4))(
        lambda spark, d: out(add_indicators(fx.bars(spark, d), names).select("ticker", "date", *names), 4))


indicator("ind_ema", ["ema_20", "ema_50", "ema_200"],
          "SELECT ticker, date, e20 AS ema_20, e50 AS ema_50, e200 AS ema_200 FROM ema", [ema_cte([20, 50, 200])])
indicator("ind_trend", ["trend_short", "trend_long"],
          "SELECT ticker, date, CAST(e8 > e21 AS INTEGER) AS trend_short, CAST(e21 > e55 AS INTEGER) AS trend_long FROM ema",
          [ema_cte([8, 21, 55])])
indicator("ind_macd", ["macd"], "SELECT ticker, date, e12 - e26 AS macd FROM ema", [ema_cte([12, 26])])
indicator("ind_zscore", ["z_score"], f"""SELECT ticker, date, (close - ({sroll('avg', 'close', 50)})) / nullif({sroll('stddev_samp', 'close', 50)}, 0) AS z_score FROM bars""")
indicator("ind_stoch_rsi", ["stoch_rsi14", "stoch_rsi28"], "SELECT ticker, date, stoch_rsi14, stoch_rsi28 FROM stoch", [STOCH14])
TR = f"tr AS (SELECT *, greatest(high - low, abs(high - lag(close) {W}), abs(low - lag(close) {W})) AS tr, high - lag(high) {W} AS dh, low - lag(low) {W} AS dl FROM bars)"
indicator("ind_atr", ["atr"], f"SELECT ticker, date, {sroll('avg', 'tr', 14)} AS atr FROM tr", [TR])
indicator("ind_adx", ["adx"], f"SELECT ticker, date, {sroll('avg', 'dx', 14)} AS adx FROM dx", [TR, f"""
di AS (SELECT *, 100 * ({sroll('avg', 'up', 14)}) / nullif({sroll('avg', 'tr', 14)}, 0) AS pos, 100 * ({sroll('avg', 'down', 14)}) / nullif({sroll('avg', 'tr', 14)}, 0) AS neg
       FROM (SELECT *, CASE WHEN dh IS NOT NULL THEN greatest(dh, 0) END AS up, CASE WHEN dl IS NOT NULL THEN greatest(-dl, 0) END AS down FROM tr) u),
dx AS (SELECT *, 100 * abs(pos - neg) / nullif(pos + neg, 0) AS dx FROM di)"""])
RET = f"rt AS (SELECT *, close / nullif(lag(close) {W}, 0) - 1 AS ret FROM bars)"
indicator("ind_momentum", ["price_momentum"], f"""SELECT ticker, date, 0.4 * ({sroll('sum', 'ret', 21)}) + 0.3 * ({sroll('sum', 'ret', 63)}) + 0.3 * ({sroll('sum', 'ret', 126)}) AS price_momentum FROM rt""", [RET])
indicator("ind_volume_momentum", ["volume_momentum"], f"SELECT ticker, date, volume / nullif({sroll('avg', 'volume', 21)}, 0) AS volume_momentum FROM bars")
indicator("ind_bollinger_b", ["b_percent"], f"""SELECT ticker, date, (close - (m - 2 * s)) / nullif((m + 2 * s) - (m - 2 * s), 0) AS b_percent
FROM (SELECT *, {sroll('avg', 'close', 20)} AS m, {sroll('stddev_samp', 'close', 20)} AS s FROM bars) x""")
indicator("ind_williams_r", ["williams_r"], f"""SELECT ticker, date, -(hh - close) / nullif(hh - ll, 0) AS williams_r
FROM (SELECT *, {sroll('max', 'high', 14)} AS hh, {sroll('min', 'low', 14)} AS ll FROM bars) x""")
indicator("ind_engulfing", ["bullish_engulfing", "bearish_engulfing"], """
SELECT ticker, date,
  CAST(coalesce(c > o AND NOT pu AND o <= pc AND c >= po AND abs(c - o) > abs(pc - po), false) AS INTEGER) AS bullish_engulfing,
  CAST(coalesce(NOT (c > o) AND pu AND o >= pc AND c <= po AND abs(c - o) > abs(pc - po), false) AS INTEGER) AS bearish_engulfing
FROM (SELECT ticker, date, open AS o, close AS c, po, pc, coalesce(pc > po, false) AS pu
      FROM (SELECT *, lag(open) OVER w AS po, lag(close) OVER w AS pc FROM bars WINDOW w AS (PARTITION BY ticker ORDER BY date)) x) y""")
indicator("ind_keltner", ["keltner_upper", "keltner_lower"], f"""
SELECT a.ticker, a.date, a.num / a.den + 2 * b.r AS keltner_upper, a.num / a.den - 2 * b.r AS keltner_lower
FROM adj a JOIN (SELECT ticker, date, {sroll('avg', 'high - low', 10)} AS r FROM bars) b ON a.ticker = b.ticker AND a.date = b.date""", [f"""
ord AS MATERIALIZED (SELECT ticker, date, close, row_number() {W} AS rn FROM bars),
adj(ticker, date, rn, num, den) AS (
  SELECT ticker, date, rn, close, CAST(1 AS DOUBLE) FROM ord WHERE rn = 1
  UNION ALL
  SELECT o.ticker, o.date, o.rn, o.close + (1 - 2.0 / 21) * a.num, 1 + (1 - 2.0 / 21) * a.den
  FROM adj a JOIN ord o ON o.ticker = a.ticker AND o.rn = a.rn + 1)"""])



@query("ind_intraday_chunked", sql([fx.TICKS_CTE, HOURLY, RET, ema_cte([20])], f"""
SELECT z.ticker, z.date, z.z_score, z.b_percent, z.volume_momentum, e.e20 AS ema_20 FROM (
  SELECT ticker, date, (close - ({sroll('avg', 'close', 50)})) / nullif({sroll('stddev_samp', 'close', 50)}, 0) AS z_score,
    (close - (({sroll('avg', 'close', 20)}) - 2 * ({sroll('stddev_samp', 'close', 20)}))) / nullif(4 * ({sroll('stddev_samp', 'close', 20)}), 0) AS b_percent,
    volume / nullif({sroll('avg', 'volume', 21)}, 0) AS volume_momentum FROM bars) z
JOIN ema e ON z.ticker = e.ticker AND z.date = e.date""", "z_score b_percent volume_momentum ema_20", 4))
def ind_intraday_chunked(spark, d):
    """Hourly bars: a TIMESTAMP series, cut into row chunks with copied history."""
    b = bar_src.resample(fx.ticks(spark, d), "hour")
    names = ["z_score", "b_percent", "volume_momentum", "ema_20"]
    df = add_indicators(b, names, chunk_rows=500)
    return out(df.select("ticker", F.col("date").cast("timestamp_ntz").alias("date"), *names), 4)


GAP = "(CAST(date AS DATE) - DATE '1990-01-01') // 7 % 5 = length(ticker) % 5"
STEPS = {n: f"2.0 / ({n} + 1)" for n in (20, 200)}


@query("ind_ema_gaps", sql([B, f"""
ord AS MATERIALIZED (SELECT ticker, date, CASE WHEN NOT ({GAP}) THEN CAST(close AS DOUBLE) END AS close, row_number() {W} AS rn FROM bars),
ema(ticker, date, rn, gap, {', '.join(f'e{n}' for n in STEPS)}, num, den) AS (
  SELECT ticker, date, rn, CAST(0 AS BIGINT), {', '.join('close' for _ in STEPS)}, coalesce(close, CAST(0 AS DOUBLE)), CASE WHEN close IS NULL THEN CAST(0 AS DOUBLE) ELSE CAST(1 AS DOUBLE) END FROM ord WHERE rn = 1
  UNION ALL
  SELECT o.ticker, o.date, o.rn, CASE WHEN o.close IS NULL THEN r.gap + 1 ELSE 0 END,
    {', '.join(f"CASE WHEN o.close IS NULL THEN r.e{n} WHEN r.e{n} IS NULL THEN o.close ELSE (pow(1 - {a}, r.gap + 1) * r.e{n} + {a} * o.close) / (pow(1 - {a}, r.gap + 1) + {a}) END" for n, a in STEPS.items())},
    coalesce(o.close, 0) + (1 - {STEPS[20]}) * r.num, (o.close IS NOT NULL)::INT + (1 - {STEPS[20]}) * r.den
  FROM ema r JOIN ord o ON o.ticker = r.ticker AND o.rn = r.rn + 1)"""], f"""
SELECT a.ticker, a.date, e20 AS ema_20, e200 AS ema_200, num / nullif(den, 0) + 2 * r AS keltner_upper FROM ema a
JOIN (SELECT ticker, date, {sroll('avg', 'high - low', 10)} AS r FROM bars) b ON a.ticker = b.ticker AND a.date = b.date""",
                           "ema_20 ema_200 keltner_upper", 4))
def ind_ema_gaps(spark, d):
    """Bars of which every fifth has no close."""
    b = fx.bars(spark, d)
    gap = F.floor(F.datediff("date", F.lit("1990-01-01")) / 7) % 5 == F.length("ticker") % 5
    b = b.withColumn("close", F.when(~gap, F.col("close").cast("double")))
    names = ["ema_20", "ema_200", "keltner_upper"]
    return out(add_indicators(b, names).select("ticker", "date", *names), 4)


SINGLE = ["ind_trend", "ind_macd", "ind_zscore", "ind_stoch_rsi", "ind_atr", "ind_adx", "ind_momentum", "ind_volume_momentum", "ind_bollinger_b",
          "ind_williams_r", "ind_engulfing", "ind_keltner"]


@query("ind_all", "SELECT * FROM (" + ORACLES["ind_ema"] + ") ema " + " ".join(f"JOIN ({ORACLES[k]}) {k} USING (ticker, date)" for k in SINGLE))
def ind_all(spark, d):
    """All indicators in one plan; the oracle joins the oracles of the single ones."""
    return out(add_indicators(fx.bars(spark, d), list(INDICATORS)).select("ticker", "date", *INDICATORS), 4)



# ------------------------------------------------------------------ windows
@query("win_returns_range", sql([B, RET], 'SELECT ticker, date, ret, high - low AS "range" FROM rt WHERE ret IS NOT NULL', "ret range"))
def win_returns_range(spark, d):
    return out(windows.returns_and_range(fx.bars(spark, d)).select("ticker", "date", "ret", "range"))


@query("win_label", sql(B, f"SELECT ticker, date, lead(close, 5) {W} AS ahead, lag(close, 5) {W} AS behind FROM bars", "ahead behind"))
def win_label(spark, d):
    b = windows.add_label(fx.bars(spark, d), 5, "lead", "ahead")
    return out(windows.add_label(b, 5, "lag", "behind").select("ticker", "date", "ahead", "behind"))


@query("win_sentiment_ratios", sql([fx.NEWS_CTE, DAILY], f"""
SELECT ticker, date, tot AS total_count, coalesce(positive / nullif(tot, 0), 0) AS pos_sent_ratio,
       coalesce(negative / nullif(tot, 0), 0) AS neg_sent_ratio, coalesce(neutral / nullif(tot, 0), 0) AS neu_sent_ratio,
       coalesce(net, 0) AS net_sentiment, coalesce({sroll('avg', 'net', 3)}, 0) AS roll3_net
FROM (SELECT *, (positive - negative) / nullif(tot, 0) AS net FROM (SELECT *, positive + negative + neutral AS tot FROM daily) a) b""",
                                    "pos_sent_ratio neg_sent_ratio neu_sent_ratio net_sentiment roll3_net"))
def win_sentiment_ratios(spark, d):
    r = news_src.sentiment_ratios(news_src.daily_sentiment(fx.news(spark, d)))
    return out(r.select("ticker", "date", "total_count", "pos_sent_ratio", "neg_sent_ratio", "neu_sent_ratio",
                        "net_sentiment", "roll3_net"))


@query("win_cum_return", sql([B, RET], """
SELECT ticker, date, (product(1 + ret) OVER (PARTITION BY ticker ORDER BY date) - 1) * 100 AS cumulative_return FROM rt WHERE ret IS NOT NULL""",
                             "cumulative_return", 3))
def win_cum_return(spark, d):
    r = windows.returns_and_range(fx.bars(spark, d))
    return out(windows.cumulative_return(r).select("ticker", "date", "cumulative_return"), 3)


@query("win_cum_return_intraday", sql([fx.TICKS_CTE, HOURLY, RET], """
SELECT ticker, date, (product(1 + ret) OVER (PARTITION BY ticker ORDER BY date) - 1) * 100 AS cumulative_return FROM rt WHERE ret IS NOT NULL""",
                                      "cumulative_return", digits=4))
def win_cum_return_intraday(spark, d):
    """The same over hourly bars: running totals per day with a carry."""
    b = bar_src.resample(fx.ticks(spark, d), "hour")
    r = windows.cumulative_return(windows.returns_and_range(b))
    return out(r.select("ticker", F.col("date").cast("timestamp_ntz").alias("date"), "cumulative_return"), 4)


def _steps(df):
    return (df.select("ticker", "date", F.posexplode("seq").alias("step", "v"))
            .select("ticker", "date", "step", F.col("v")[0].alias("close"), F.col("v")[1].alias("volume")))


def seq_sql(pad_close: str, pad_volume: str) -> str:
    """One row per (bar, step) of a 5-step window; missing steps take the padding."""
    return f"""
SELECT o.ticker, o.date, CAST(s.step AS INTEGER) AS step,
       CASE WHEN h.rn IS NULL THEN {pad_close} ELSE h.close END AS close,
       CASE WHEN h.rn IS NULL THEN {pad_volume} ELSE h.volume END AS volume
FROM o CROSS JOIN (SELECT unnest([0, 1, 2, 3, 4]) AS step) s
LEFT JOIN o h ON h.ticker = o.ticker AND h.rn = o.rn - 4 + s.step"""


OSEQ = f"""o AS MATERIALIZED (SELECT ticker, date, close, volume, row_number() {W} AS rn,
  avg(close) OVER c AS mc, avg(volume) OVER c AS mv, first_value(close) OVER c AS fc, first_value(volume) OVER c AS fv
  FROM bars WINDOW c AS (PARTITION BY ticker ORDER BY date ROWS UNBOUNDED PRECEDING))"""
for _pad, _c, _v in (("zero", "0.0", "0.0"), ("mean", "o.mc", "o.mv"), ("repeat", "o.fc", "o.fv")):
    query("win_seq" if _pad == "zero" else f"win_seq_{_pad}", sql([B, OSEQ], seq_sql(_c, _v), "close volume", 4))(
        lambda spark, d, pad=_pad: out(_steps(windows.sequences(fx.bars(spark, d), ["close", "volume"], 5, pad)), 4))


@query("win_seq_exclusive", sql([B, OSEQ], """
SELECT o.ticker, o.date, CAST(s.step AS INTEGER) AS step, h.close, h.volume
FROM o CROSS JOIN (SELECT unnest([0, 1, 2, 3, 4]) AS step) s JOIN o h ON h.ticker = o.ticker AND h.rn = o.rn - 5 + s.step
WHERE o.rn > 5""", "close volume"))
def win_seq_exclusive(spark, d):
    return out(_steps(windows.past_sequences(fx.bars(spark, d), ["close", "volume"], 5)))


@query("win_downsample", sql([B, OSEQ], """
SELECT ticker, CAST(floor((rn - 1) / 4) AS BIGINT) AS step, min(date) AS start, sum(close) / 4 AS close, sum(volume) / 4 AS volume
FROM o GROUP BY ALL""", "close volume", 4))
def win_downsample(spark, d):
    return out(windows.downsample(fx.bars(spark, d), ["close", "volume"], 4), 4)


# ------------------------------------------------------------------ sorts, sets
@query("srt_date", sql(B, "SELECT ticker, date, close FROM bars ORDER BY date, ticker", "close"))
def srt_date(spark, d):
    return out(fx.bars(spark, d).select("ticker", "date", "close")).orderBy("date", "ticker")


@query("agg_distinct_tickers", "SELECT DISTINCT p_brand || '-' || p_type AS ticker FROM part ORDER BY 1")
def agg_distinct_tickers(spark, d):
    return agg.distinct_tickers(fx.table(spark, d, "part").select(F.concat_ws("-", "p_brand", "p_type").alias("ticker")))


@query("set_union_tables", sql([fx.bars_cte("week").replace("bars AS", "week_bars AS").replace("px AS", "wpx AS", 1).replace("FROM px", "FROM wpx"),
                                fx.bars_cte("month").replace("bars AS", "month_bars AS").replace("px AS", "mpx AS", 1).replace("FROM px", "FROM mpx")], """
SELECT 'week' AS source, ticker, date, close, volume FROM week_bars UNION ALL
SELECT 'month', ticker, date, close, CAST(NULL AS DOUBLE) FROM month_bars""", "close volume"))
def set_union_tables(spark, d):
    week = fx.bars(spark, d, "week").select(F.lit("week").alias("source"), "ticker", "date", "close", "volume")
    month = fx.bars(spark, d, "month").select(F.lit("month").alias("source"), "ticker", "date", "close")
    return out(week.unionByName(month, allowMissingColumns=True))


@query("set_dedup_keep_first", """
SELECT ticker, date, l_orderkey, l_quantity FROM (
  SELECT p_brand AS ticker, CAST(l_shipdate AS DATE) AS date, l_orderkey, l_quantity,
         row_number() OVER (PARTITION BY p_brand, CAST(l_shipdate AS DATE) ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey) AS rn
  FROM lineitem JOIN part ON l_partkey = p_partkey) t WHERE rn = 1""")
def set_dedup_keep_first(spark, d):
    line = fx.table(spark, d, "lineitem").select("l_partkey", "l_orderkey", "l_linenumber", "l_suppkey", "l_shipdate", "l_quantity")
    part = fx.table(spark, d, "part").select("p_partkey", F.col("p_brand").alias("ticker"))
    df = line.join(part, line.l_partkey == part.p_partkey).withColumn("date", F.to_date("l_shipdate"))
    first = windows.keep_first(df, ["ticker", "date"], [F.col(c) for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")])
    return first.select("ticker", "date", "l_orderkey", "l_quantity")


@query("set_dedup_ordered", sql(fx.INDEX_MEMBERS_CTE, "SELECT ticker, min(pos) AS pos FROM index_members WHERE ticker IS NOT NULL GROUP BY ticker"))
def set_dedup_ordered(spark, d):
    return windows.ordered_distinct(fx.index_members(spark, d).dropna(subset=["ticker"]), "ticker", "pos")


# ------------------------------------------------------------------ calendar
def _bounds(spark, d):
    o = fx.table(spark, d, "orders")
    return o.agg(F.to_date(F.min("o_orderdate")).alias("start"), F.to_date(F.max("o_orderdate")).alias("end"))


def _per_day(spark, d):
    return (fx.table(spark, d, "orders").groupBy(F.to_date("o_orderdate").alias("date"))
            .agg(F.count(F.lit(1)).alias("n_orders")))


RANGE = "rng AS (SELECT CAST(min(o_orderdate) AS DATE) AS d1, CAST(max(o_orderdate) AS DATE) AS d2 FROM orders)"
DAYS = "days AS (SELECT CAST(unnest(generate_series(d1, d2, INTERVAL 1 DAY)) AS DATE) AS date FROM rng)"
PER_DAY = "per_day AS (SELECT CAST(o_orderdate AS DATE) AS date, count(*) AS n_orders FROM orders GROUP BY ALL)"
# holidays found by scanning the days (weekday and day-of-month tests), Easter by the anonymous algorithm
HOLIDAYS = """ys AS (SELECT unnest(generate_series(CAST(year(d1) AS INTEGER), CAST(year(d2) AS INTEGER) + 1)) AS y FROM rng),
e1 AS (SELECT y, y % 19 AS a, y // 100 AS b, y % 100 AS c FROM ys),
e2 AS (SELECT *, b // 4 AS dd, b % 4 AS e, (b + 8) // 25 AS f FROM e1),
e3 AS (SELECT *, (19 * a + b - dd - (b - f + 1) // 3 + 15) % 30 AS h, c // 4 AS i, c % 4 AS k FROM e2),
e4 AS (SELECT *, (32 + 2 * e + 2 * i - h - k) % 7 AS l FROM e3),
e5 AS (SELECT *, (a + 11 * h + 22 * l) // 451 AS m FROM e4),
easter AS (SELECT make_date(CAST(y AS INTEGER), CAST((h + l - 7 * m + 114) // 31 AS INTEGER), CAST((h + l - 7 * m + 114) % 31 + 1 AS INTEGER)) AS sunday FROM e5),
cand AS (SELECT make_date(CAST(y AS INTEGER), 1, 1) + CAST(n AS INTEGER) AS date FROM ys, (SELECT unnest(generate_series(0, 365)) AS n) z),
alld AS (SELECT DISTINCT date, CAST(year(date) AS INTEGER) AS y, month(date) AS mo, day(date) AS dy, isodow(date) AS wd FROM cand),
nominal AS (
  SELECT date, 'New Year''s Day' AS holiday, true AS moves FROM alld WHERE mo = 1 AND dy = 1
  UNION ALL SELECT date, 'Martin Luther King Jr. Day', false FROM alld WHERE mo = 1 AND wd = 1 AND dy BETWEEN 15 AND 21 AND y >= 1986
  UNION ALL SELECT date, 'Presidents Day', false FROM alld WHERE mo = 2 AND wd = 1 AND dy BETWEEN 15 AND 21 AND y >= 1971
  UNION ALL SELECT CAST(sunday - 2 AS DATE), 'Good Friday', false FROM easter
  UNION ALL SELECT date, 'Memorial Day', false FROM alld WHERE mo = 5 AND wd = 1 AND dy BETWEEN 25 AND 31 AND y >= 1971
  UNION ALL SELECT date, 'Juneteenth', true FROM alld WHERE mo = 6 AND dy = 19 AND y >= 2021
  UNION ALL SELECT date, 'Independence Day', true FROM alld WHERE mo = 7 AND dy = 4
  UNION ALL SELECT date, 'Labor Day', false FROM alld WHERE mo = 9 AND wd = 1 AND dy <= 7
  UNION ALL SELECT date, 'Columbus Day', false FROM alld WHERE mo = 10 AND wd = 1 AND dy BETWEEN 8 AND 14
  UNION ALL SELECT date, 'Veterans Day', true FROM alld WHERE mo = 11 AND dy = 11
  UNION ALL SELECT date, 'Thanksgiving', false FROM alld WHERE mo = 11 AND wd = 4 AND dy BETWEEN 22 AND 28
  UNION ALL SELECT date, 'Christmas', true FROM alld WHERE mo = 12 AND dy = 25),
observed AS (SELECT CAST(CASE WHEN moves AND isodow(date) = 6 THEN date - 1 WHEN moves AND isodow(date) = 7 THEN date + 1 ELSE date END AS DATE) AS date, holiday FROM nominal),
holidays AS (SELECT date, holiday FROM observed, rng WHERE date BETWEEN d1 AND d2)"""


@query("dt_calendar", sql([RANGE, DAYS, PER_DAY], """
SELECT d.date, coalesce(p.n_orders, 0) AS n_orders FROM days d LEFT JOIN per_day p ON d.date = p.date"""))
def dt_calendar(spark, d):
    return bar_src.calendar_fill(_per_day(spark, d), cal.days(_bounds(spark, d))).fillna(0, ["n_orders"])


@query("dt_holidays", sql([RANGE, PER_DAY, HOLIDAYS], """
SELECT h.date, h.holiday, coalesce(p.n_orders, 0) AS n_orders FROM holidays h LEFT JOIN per_day p ON h.date = p.date"""))
def dt_holidays(spark, d):
    return cal.market_holidays(_bounds(spark, d)).join(_per_day(spark, d), "date", "left").fillna(0, ["n_orders"])


@query("dt_business_day_back", sql([RANGE, DAYS, PER_DAY, HOLIDAYS], """
SELECT p.date, b.date AS business_day, p.n_orders FROM per_day p
ASOF LEFT JOIN (SELECT date FROM days WHERE isodow(date) < 6 AND date NOT IN (SELECT date FROM holidays)) b ON p.date >= b.date"""))
def dt_business_day_back(spark, d):
    bounds = _bounds(spark, d)
    back = cal.previous_business_day(cal.days(bounds), cal.market_holidays(bounds))
    return _per_day(spark, d).join(back, "date").select("date", "business_day", "n_orders")


# ------------------------------------------------------------------ scalar function families
@query("fn_scalar", """
SELECT event_id, substr(CAST(ts AS VARCHAR), 1, 10) AS day_text, lower(event_type) AS kind,
       printf('%s: %.2f', event_type, value) AS line, concat_ws('; ', event_type, CASE WHEN value > 50 THEN 'large' END) AS reasons,
       """ + sql_round("sqrt(value)") + """ AS root, """ + sql_round("least(greatest(value, 10), 60)") + """ AS clipped,
       CAST(CAST(ts AS DATE) - 365 AS DATE) AS year_back, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k
FROM events""")
def fn_scalar(spark, d):
    """String, math, date and JSON expressions as used by the operators."""
    from bourse.functions.columns import clip
    ev = fx.table(spark, d, "events")
    return ev.select(
        "event_id", F.date_format("ts", "yyyy-MM-dd").alias("day_text"), F.lower("event_type").alias("kind"),
        F.format_string("%s: %.2f", F.col("event_type"), F.col("value")).alias("line"),
        F.concat_ws("; ", "event_type", F.when(F.col("value") > 50, "large")).alias("reasons"),
        rnd(F.sqrt("value")).alias("root"), rnd(clip("value", 10.0, 60.0)).alias("clipped"),
        F.date_sub(F.to_date("ts"), 365).alias("year_back"),
        F.from_json("props", "k int")["k"].alias("k"))
