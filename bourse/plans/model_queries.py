"""Queries over model tables and market regimes."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import functions as F

from bourse.operators import aggregates as agg
from bourse.operators import modelling as ml
from bourse.operators import regimes, windows
from bourse.operators.features import feature_table
from bourse.operators.indicators import add_indicators
from bourse.plans import fixtures as fx
from bourse.plans.price_queries import DAILY, HOURLY, STOCH14, W, sroll
from bourse.plans.registry import ORACLES, out, query, sql
from bourse.sources import bars as bar_src
from bourse.sources import news as news_src
from bourse.sources import tables
from bourse.sources.news import SENTIMENTS

B = fx.BARS_CTE
FEATS = ["z_score", "b_percent", "volume_momentum"]
FEAT_SQL = f"""feat AS MATERIALIZED (SELECT ticker, date, close, lead(close, 5) {W} AS shifted_prices,
  (close - ({sroll('avg', 'close', 50)})) / nullif({sroll('stddev_samp', 'close', 50)}, 0) AS z_score,
  (close - (({sroll('avg', 'close', 20)}) - 2 * ({sroll('stddev_samp', 'close', 20)}))) / nullif(4 * ({sroll('stddev_samp', 'close', 20)}), 0) AS b_percent,
  volume / nullif({sroll('avg', 'volume', 21)}, 0) AS volume_momentum FROM bars)"""
SPLIT = """cnts AS (SELECT date, row_number() OVER (ORDER BY date) AS dn, count(*) AS k FROM feat GROUP BY date),
tot AS (SELECT count(*) AS n, CAST(floor(count(*) * 0.1) AS BIGINT) AS nt FROM feat),
cutd AS (SELECT c.date, CASE WHEN coalesce(sum(o.k), 0) < n - 2 * nt THEN 'train' WHEN coalesce(sum(o.k), 0) < n - nt THEN 'val' ELSE 'test' END AS split
  FROM cnts c CROSS JOIN tot LEFT JOIN cnts o ON o.dn < c.dn GROUP BY c.date, n, nt),
spl AS MATERIALIZED (SELECT f.*, split FROM feat f JOIN cutd c ON c.date = f.date)"""
CLEAN = f"""med AS ({' UNION ALL '.join(f"SELECT '{c}' AS feature, median({c}) AS median FROM spl WHERE split = 'train'" for c in FEATS)}),
cleaned AS MATERIALIZED (SELECT ticker, date, split, shifted_prices, {', '.join(f"coalesce({c}, (SELECT median FROM med WHERE feature = '{c}')) AS {c}" for c in FEATS)} FROM spl)"""
STATS = f"""stats AS ({' UNION ALL '.join(f"SELECT '{c}' AS feature, avg({c}) AS mean, stddev_pop({c}) AS raw_scale FROM cleaned WHERE split = 'train'" for c in FEATS)})"""


def features(spark, d):
    df = add_indicators(windows.add_label(fx.bars(spark, d), 5), FEATS)
    return ml.chrono_split(df.select("ticker", "date", "close", "shifted_prices", *FEATS))


def cleaned(spark, d):
    return ml.clean(features(spark, d), FEATS)


@query("ml_chrono_split", sql([B, FEAT_SQL, SPLIT], "SELECT ticker, date, split FROM spl"))
def ml_chrono_split(spark, d):
    return features(spark, d).select("ticker", "date", "split")


@query("agg_medians", sql([B, FEAT_SQL, SPLIT, CLEAN], "SELECT * FROM med", "median"))
def agg_medians(spark, d):
    return out(agg.medians(ml.finite(features(spark, d), FEATS).where("split = 'train'"), FEATS))


@query("ml_clean", sql([B, FEAT_SQL, SPLIT, CLEAN], f"SELECT ticker, date, split, {', '.join(FEATS)} FROM cleaned", " ".join(FEATS)))
def ml_clean(spark, d):
    return out(cleaned(spark, d).select("ticker", "date", "split", *FEATS))


@query("agg_scaler_fit", sql([B, FEAT_SQL, SPLIT, CLEAN, STATS], "SELECT feature, mean, CASE WHEN raw_scale = 0 THEN 1 ELSE raw_scale END AS scale FROM stats", "mean scale"))
def agg_scaler_fit(spark, d):
    return out(agg.scaler_stats(cleaned(spark, d).where("split = 'train'"), FEATS).select("feature", "mean", "scale"))


@query("ml_scale", sql([B, FEAT_SQL, SPLIT, CLEAN, STATS], "SELECT ticker, date, " + ", ".join(
    f"({c} - (SELECT mean FROM stats WHERE feature = '{c}')) / (SELECT CASE WHEN raw_scale = 0 THEN 1 ELSE raw_scale END FROM stats WHERE feature = '{c}') AS {c}" for c in FEATS) + " FROM cleaned", " ".join(FEATS)))
def ml_scale(spark, d):
    return out(ml.scale(cleaned(spark, d), FEATS).select("ticker", "date", *FEATS))


@query("ml_zero_scale_check", sql(B, """
SELECT feature, CASE WHEN raw_scale = 0 THEN 'zero' ELSE 'near zero' END AS problem FROM (
  SELECT 'constant' AS feature, stddev_pop(close * 0) AS raw_scale FROM bars UNION ALL SELECT 'tiny', stddev_pop(close / 1e15) FROM bars
  UNION ALL SELECT 'close', stddev_pop(close) FROM bars) x WHERE abs(raw_scale) < 1e-6"""))
def ml_zero_scale_check(spark, d):
    df = fx.bars(spark, d).select("close", (F.col("close") * 0.0).alias("constant"), (F.col("close") / 1e15).alias("tiny"))
    return ml.zero_scales(agg.scaler_stats(df, ["constant", "tiny", "close"])).select("feature", "problem")


def fitted(spark, d):
    m = ml.window_means(cleaned(spark, d), FEATS, 5)
    cols = [f"{c}_mean" for c in FEATS]
    return m, ml.fit_linear(m, cols), cols


def _det(a: str, b: str, c: str) -> str:
    """Determinant of the 3 x 3 matrix whose columns are named a, b, c (rows 1..3)."""
    return (f"({a}1 * ({b}2 * {c}3 - {b}3 * {c}2) - {b}1 * ({a}2 * {c}3 - {a}3 * {c}2) + {c}1 * ({a}2 * {b}3 - {a}3 * {b}2))")


# least squares by Cramer's rule over the covariances of features and label
OLS = f"""wm AS (SELECT * FROM (SELECT split, shifted_prices AS y, {', '.join(f'avg({c}) OVER p AS f{i + 1}' for i, c in enumerate(FEATS))}, count(*) OVER p AS full_n
  FROM cleaned WINDOW p AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING)) x WHERE full_n = 5 AND split = 'train' AND y IS NOT NULL),
cv AS (SELECT {', '.join(f'covar_pop(f{i}, f{j}) AS m{j}{i}' for i in (1, 2, 3) for j in (1, 2, 3))}, {', '.join(f'covar_pop(f{i}, y) AS r{i}' for i in (1, 2, 3))},
  avg(f1) AS a1, avg(f2) AS a2, avg(f3) AS a3, avg(y) AS ay FROM wm),
sol AS (SELECT {_det('r', 'm2', 'm3')} / {_det('m1', 'm2', 'm3')} AS b1, {_det('m1', 'r', 'm3')} / {_det('m1', 'm2', 'm3')} AS b2,
  {_det('m1', 'm2', 'r')} / {_det('m1', 'm2', 'm3')} AS b3, a1, a2, a3, ay FROM cv)"""


@query("ml_fit_baseline", sql([B, FEAT_SQL, SPLIT, CLEAN, OLS], " UNION ALL ".join(
    ["SELECT 'intercept' AS feature, ay - b1 * a1 - b2 * a2 - b3 * a3 AS coefficient FROM sol"]
    + [f"SELECT '{c}_mean', b{i + 1} FROM sol" for i, c in enumerate(FEATS)]), "coefficient", 6))
def ml_fit_baseline(spark, d):
    _, model, _ = fitted(spark, d)
    rows = [("intercept", model["intercept"])] + list(model["coefficients"].items())
    return out(spark.createDataFrame(rows, "feature string, coefficient double"))


LINEAR = {"intercept": 10.0, "coefficients": {"close_mean": 0.9, "high_mean": 0.05, "low_mean": 0.04}}


@query("ml_score", sql(B, f"""
SELECT ticker, date, 10 + 0.9 * avg(close) OVER w + 0.05 * avg(high) OVER w + 0.04 * avg(low) OVER w AS predicted
FROM bars WINDOW w AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) QUALIFY count(*) OVER w = 5""", "predicted", 4))
def ml_score(spark, d):
    m = ml.window_means(fx.bars(spark, d), ["close", "high", "low"], 5)
    return out(ml.score_linear(m, LINEAR).select("ticker", "date", "predicted"), 4)


@query("ml_score_model", sql(B, """
SELECT ticker, date, 10 + 0.9 * avg(close) OVER w + 0.05 * avg(high) OVER w + 0.04 * avg(low) OVER w AS predicted
FROM bars WINDOW w AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) QUALIFY count(*) OVER w = 5""", "predicted", 4))
def ml_score_model(spark, d):
    """The same model given as a Python callable on windows (Arrow batches)."""
    return out(ml.score_model(fx.bars(spark, d), ["close", "high", "low"], 5,
                              lambda x: 10.0 + x.mean(axis=1) @ [0.9, 0.05, 0.04]), 4)


@query("ml_importance", sql([B, f"m AS (SELECT avg(close) AS c, avg(high) AS h, avg(low) AS l FROM bars)"], """
SELECT unnest([{'f': 'close', 'v': avg(abs(0.9 * (close - c)))}, {'f': 'high', 'v': avg(abs(0.05 * (high - h)))}, {'f': 'low', 'v': avg(abs(0.04 * (low - l)))}], recursive := true)
FROM bars CROSS JOIN m""".replace("SELECT unnest", "SELECT f AS feature, v AS importance FROM (SELECT unnest").replace("CROSS JOIN m", "CROSS JOIN m) x"), "importance", 4))
def ml_importance(spark, d):
    return out(ml.linear_importance(fx.bars(spark, d), {"coefficients": {"close": 0.9, "high": 0.05, "low": 0.04}}), 4)


@query("agg_forecast_error", sql([B, FEAT_SQL, SPLIT], f"""
SELECT split, count(*) AS n, avg(e * e) AS mse, sqrt(avg(e * e)) AS rmse, avg(least(abs(e) / greatest(abs(a), 1e-6), 10)) * 100 AS mape FROM (
  SELECT split, shifted_prices AS a, close - shifted_prices AS e FROM spl WHERE shifted_prices IS NOT NULL) x GROUP BY split""", "mse rmse mape", 3))
def agg_forecast_error(spark, d):
    """Error of the naive forecast (today's close) by split."""
    return out(agg.forecast_error(features(spark, d), "shifted_prices", "close"), 3)


# ------------------------------------------------------------------ regimes
REG = f"""reg AS MATERIALIZED (SELECT * FROM (SELECT ticker, date, close, close / nullif(lag(close) {W}, 0) - 1 AS ret, high - low AS rng, volume FROM bars) x WHERE ret IS NOT NULL)"""
# states of the label queries: bars by their range, in an order unlike the return order
STATE_SQL = "CASE WHEN rng > 20000 THEN 1 WHEN rng > 10000 THEN 2 ELSE 0 END"
LABELS = f"""st AS (SELECT *, {STATE_SQL} AS state FROM reg),
nm AS (SELECT state, avg(ret) AS mean_return, (['Bearish', 'Neutral', 'Bullish'])[CAST(row_number() OVER (ORDER BY avg(ret), state) AS INTEGER)] AS regime FROM st GROUP BY state)"""


def states(spark, d):
    r = windows.returns_and_range(fx.bars(spark, d)).withColumnRenamed("range", "rng")
    return r.withColumn("state", F.expr(STATE_SQL))


@query("reg_features", sql([B, REG], 'SELECT ticker, date, ret, rng AS "range", volume FROM reg', "ret range volume"))
def reg_features(spark, d):
    return out(regimes.features(fx.bars(spark, d)))


@query("reg_fit")
def reg_fit(spark, d):
    return regimes.model_table(spark, regimes.fit(regimes.features(fx.bars(spark, d))))


@query("reg_decode")
def reg_decode(spark, d):
    feats = regimes.features(fx.bars(spark, d))
    return regimes.decode(feats, regimes.fit(feats))


def _given_model() -> regimes.Hmm:
    """A model in round numbers: independent features, states by range of the bar."""
    means = np.array([[0.5, 15000.0, 100.0], [1.0, 25000.0, 150.0], [1.5, 40000.0, 220.0]])
    sd = np.array([1.0, 8000.0, 60.0])
    trans = np.array([[0.8, 0.15, 0.05], [0.1, 0.8, 0.1], [0.05, 0.15, 0.8]])
    return regimes.Hmm(np.full(3, 1 / 3), trans, means, np.array([np.diag(sd ** 2)] * 3), np.zeros(3), np.ones(3))


def _viterbi_sql() -> list[str]:
    m = _given_model()
    dens = lambda k: " + ".join(f"-0.5 * pow(({c} - {m.means[k][i]}) / {math.sqrt(m.covs[k][i][i])}, 2)" for i, c in enumerate(("ret", "rng", "volume")))
    lt = lambda j, k: f"ln(CAST({m.trans[j][k]} AS DOUBLE))"
    cand = lambda k: [f"v.s{j} + {lt(j, k)}" for j in range(3)]
    best = ", ".join(f"greatest({', '.join(cand(k))}) + o.d{k}" for k in range(3))
    back = ", ".join("CASE WHEN {0} >= {1} AND {0} >= {2} THEN 0 WHEN {1} >= {2} THEN 1 ELSE 2 END".format(*[f"({c})" for c in cand(k)]) for k in range(3))
    return [f"""obs AS MATERIALIZED (SELECT ticker, date, row_number() {W} AS rn, {', '.join(f'{dens(k)} AS d{k}' for k in range(3))} FROM reg),
vit(ticker, rn, s0, s1, s2, p0, p1, p2) AS (
  SELECT ticker, rn, CAST(d0 AS DOUBLE), CAST(d1 AS DOUBLE), CAST(d2 AS DOUBLE), 0, 0, 0 FROM obs WHERE rn = 1
  UNION ALL SELECT o.ticker, o.rn, {best}, {back} FROM vit v JOIN obs o ON o.ticker = v.ticker AND o.rn = v.rn + 1),
vm AS MATERIALIZED (SELECT * FROM vit),
path(ticker, rn, state) AS (
  SELECT ticker, rn, CASE WHEN s0 >= s1 AND s0 >= s2 THEN 0 WHEN s1 >= s2 THEN 1 ELSE 2 END FROM vm v WHERE rn = (SELECT max(rn) FROM vm x WHERE x.ticker = v.ticker)
  UNION ALL SELECT v.ticker, p.rn - 1, CASE p.state WHEN 0 THEN v.p0 WHEN 1 THEN v.p1 ELSE v.p2 END FROM path p JOIN vm v ON v.ticker = p.ticker AND v.rn = p.rn WHERE p.rn > 1)"""]


@query("reg_decode_given", sql([B, REG, *_viterbi_sql()], """
SELECT o.ticker, o.date, p.state, (['Bearish', 'Neutral', 'Bullish'])[p.state + 1] AS regime FROM path p JOIN obs o ON o.ticker = p.ticker AND o.rn = p.rn"""))
def reg_decode_given(spark, d):
    """State paths under a given model, so that they can be compared state by state."""
    return regimes.decode(regimes.features(fx.bars(spark, d)), _given_model())


@query("reg_decode_hourly", sql([fx.TICKS_CTE, HOURLY, REG, *_viterbi_sql()], """
SELECT o.ticker, o.date, p.state, (['Bearish', 'Neutral', 'Bullish'])[p.state + 1] AS regime FROM path p JOIN obs o ON o.ticker = p.ticker AND o.rn = p.rn"""))
def reg_decode_hourly(spark, d):
    """The same model on hourly bars, in chunks of 50 bars whose products carry the path on."""
    feats = regimes.features(bar_src.resample(fx.ticks(spark, d), "hour"))
    return regimes.decode(feats, _given_model(), chunk=50).withColumn("date", F.col("date").cast("timestamp_ntz"))


def _round_sql() -> list[str]:
    """One round of expectation-maximisation from the given model, bar by bar."""
    m = _given_model()
    names, ks = ("ret", "rng", "volume"), range(3)
    dens = lambda k: " + ".join(f"-0.5 * pow(({c} - {m.means[k][i]}) / {math.sqrt(m.covs[k][i][i])}, 2) - ln({math.sqrt(m.covs[k][i][i] * 2 * math.pi)!r})" for i, c in enumerate(names))
    move = lambda k: " + ".join(f"f.a{j} * {m.trans[j][k]}" for j in ks)
    back = lambda j: " + ".join(f"{m.trans[j][k]} * n.b{k} * w.e{k}" for k in ks)
    per = lambda text: ", ".join(text.format(k=k) for k in ks)
    scaled = lambda a: f"{', '.join(f'{a}{k} / ({a}0 + {a}1 + {a}2)' for k in ks)}"
    means = ", ".join(f"sum(g{k} * {c}) / sum(g{k}) AS m{k}_{c}" for k in ks for c in names)
    covs = lambda k: ", ".join(f"sum(g{k} * {a} * {b}) / sum(g{k}) - any_value(m{k}_{a}) * any_value(m{k}_{b}){' + 1e-6' if a == b else ''} AS cov_{a}_{b}"
                               for i, a in enumerate(names) for b in names[:i + 1])
    state = lambda k: (f"SELECT {k} AS state, sum(g{k}) FILTER (rn = 1) / count(*) FILTER (rn = 1) AS start, "
                       + ", ".join(f"any_value(x{k}{j}) / any_value(x{k}0 + x{k}1 + x{k}2) AS to_{j}" for j in ks)
                       + ", " + ", ".join(f"any_value(m{k}_{c}) AS mean_{c}" for c in names) + f", {covs(k)}, any_value(ll) AS log_likelihood FROM gam, mom, tra, lik")
    return [f"""ob AS (SELECT ticker, date, ret, rng, volume, row_number() {W} AS rn, {', '.join(f'{dens(k)} AS d{k}' for k in ks)} FROM reg),
wt AS MATERIALIZED (SELECT *, greatest(d0, d1, d2) AS top, {per('exp(d{k} - greatest(d0, d1, d2)) AS b{k}')} FROM ob),
fw(ticker, rn, s, a0, a1, a2) AS (
  SELECT ticker, rn, (b0 + b1 + b2) / 3, {scaled('b')} FROM wt WHERE rn = 1
  UNION ALL SELECT ticker, rn, q0 + q1 + q2, {scaled('q')} FROM (
    SELECT n.ticker, n.rn, {', '.join(f'({move(k)}) * n.b{k} AS q{k}' for k in ks)} FROM fw f JOIN wt n ON n.ticker = f.ticker AND n.rn = f.rn + 1) z),
fm AS MATERIALIZED (SELECT * FROM fw),
bw(ticker, rn, e0, e1, e2) AS (
  SELECT ticker, max(rn), CAST(1 AS DOUBLE), CAST(1 AS DOUBLE), CAST(1 AS DOUBLE) FROM wt GROUP BY ticker
  UNION ALL SELECT ticker, rn, {scaled('q')} FROM (
    SELECT n.ticker, n.rn - 1 AS rn, {', '.join(f'{back(j)} AS q{j}' for j in ks)} FROM bw w JOIN wt n ON n.ticker = w.ticker AND n.rn = w.rn WHERE n.rn > 1) z),
bm AS MATERIALIZED (SELECT * FROM bw),
gam AS (SELECT o.*, {per('f.a{k} * w.e{k} / (f.a0 * w.e0 + f.a1 * w.e1 + f.a2 * w.e2) AS g{k}')}
  FROM wt o JOIN fm f ON f.ticker = o.ticker AND f.rn = o.rn JOIN bm w ON w.ticker = o.ticker AND w.rn = o.rn),
pairs AS (SELECT {', '.join(f'f.a{j} * {m.trans[j][k]} * n.b{k} * w.e{k} AS y{j}{k}' for j in ks for k in ks)}
  FROM fm f JOIN wt n ON n.ticker = f.ticker AND n.rn = f.rn + 1 JOIN bm w ON w.ticker = n.ticker AND w.rn = n.rn),
tra AS (SELECT {', '.join(f"sum(y{j}{k} / ({' + '.join(f'y{a}{b}' for a in ks for b in ks)})) AS x{j}{k}" for j in ks for k in ks)} FROM pairs),
mom AS (SELECT {means} FROM gam),
lik AS (SELECT sum(ln(f.s) + o.top) AS ll FROM fm f JOIN wt o ON o.ticker = f.ticker AND o.rn = f.rn)""", " UNION ALL ".join(state(k) for k in ks)]


ROUND = _round_sql()
ROUND_COLUMNS = "start to_0 to_1 to_2 mean_ret mean_rng mean_volume cov_ret_ret cov_rng_ret cov_rng_rng cov_volume_ret cov_volume_rng cov_volume_volume log_likelihood"


ROUND_DIGITS = dict(cov_rng_rng=1, cov_volume_rng=2, mean_rng=4, cov_rng_ret=3, log_likelihood=3)


def _round(spark, feats):
    return out(regimes.parameter_table(spark, regimes.one_round(feats, _given_model())).toDF("state", *ROUND_COLUMNS.split()), 5, **ROUND_DIGITS)


@query("reg_fit_round", sql([B, REG, ROUND[0]], ROUND[1], ROUND_COLUMNS, 5, **ROUND_DIGITS))
def reg_fit_round(spark, d):
    """One round of the fit from the given model, number by number."""
    return _round(spark, regimes.features(fx.bars(spark, d)))


@query("reg_fit_round_hourly", sql([fx.TICKS_CTE, HOURLY, REG, ROUND[0]], ROUND[1], ROUND_COLUMNS, 5, **ROUND_DIGITS))
def reg_fit_round_hourly(spark, d):
    """The same on hourly bars: runs of a ticker in tasks of their own."""
    return _round(spark, regimes.features(bar_src.resample(fx.ticks(spark, d), "hour")))


@query("reg_decode_stored", ORACLES["reg_decode_given"])
def reg_decode_stored(spark, d):
    """The same model stored as a table, read again and applied."""
    path = tables.work_folder(spark, "regimes")
    regimes.save_model(spark, _given_model(), path)
    return regimes.decode(regimes.features(fx.bars(spark, d)), regimes.load_model(spark, path))


@query("srt_state_order", sql([B, REG, LABELS], "SELECT state, mean_return, regime FROM nm", "mean_return"))
def srt_state_order(spark, d):
    return out(regimes.state_names(states(spark, d)))


@query("reg_label", sql([B, REG, LABELS], "SELECT s.ticker, s.date, s.state, n.regime FROM st s JOIN nm n ON n.state = s.state"))
def reg_label(spark, d):
    return regimes.label(states(spark, d)).select("ticker", "date", "state", "regime")


@query("join_regime_label", sql([B, REG, LABELS], "SELECT n.regime, count(*) AS n FROM st s JOIN nm n ON n.state = s.state GROUP BY n.regime"))
def join_regime_label(spark, d):
    return regimes.label(states(spark, d)).groupBy("regime").agg(F.count(F.lit(1)).alias("n"))


@query("ml_feature_table", sql([fx.NEWS_CTE, DAILY, B, STOCH14, REG, LABELS.replace("st AS (", "sta AS (").replace("FROM st ", "FROM sta ")], f"""
SELECT f.ticker, f.date, f.shifted_prices, f.z_score, f.close, {', '.join(f'coalesce(n.{s}, 0) AS {s}' for s in SENTIMENTS)},
  s.state, s.regime, i.stoch_rsi14 AS index_stoch_rsi FROM (
  SELECT ticker, date, close, lead(close, 5) {W} AS shifted_prices,
         (close - ({sroll('avg', 'close', 50)})) / nullif({sroll('stddev_samp', 'close', 50)}, 0) AS z_score FROM bars) f
LEFT JOIN (SELECT *, CAST(date - 8400 AS DATE) AS bar_date FROM daily) n ON n.ticker = f.ticker AND n.bar_date = f.date
JOIN (SELECT sta.ticker, sta.date, sta.state, nm.regime FROM sta JOIN nm ON nm.state = sta.state) s ON s.ticker = f.ticker AND s.date = f.date
JOIN stoch i ON i.ticker = 'Brand#13' AND i.date = f.date
WHERE shifted_prices IS NOT NULL AND z_score IS NOT NULL AND i.stoch_rsi14 IS NOT NULL""", "shifted_prices z_score close index_stoch_rsi", 5))
def ml_feature_table(spark, d):
    """The whole training table: label, indicators, all sentiments, regime and a feature of the index."""
    b = fx.bars(spark, d)
    daily = news_src.daily_sentiment(fx.news(spark, d)).withColumn("date", F.date_sub("date", 8400))
    index = add_indicators(bar_src.index_bars(b, "Brand#13"), ["stoch_rsi14"]).select("date", F.col("stoch_rsi14").alias("index_stoch_rsi"))
    columns = ["z_score", "close", *SENTIMENTS, "state", "regime", "index_stoch_rsi"]
    return out(feature_table(b, columns, daily, regimes.label(states(spark, d)), index_values=index), 5)


@query("reg_summary", sql([B, REG, LABELS], """
SELECT s.ticker, n.regime, count(*) AS bars, avg(ret) AS mean_return, min(close) AS low_close, max(close) AS high_close
FROM st s JOIN nm n ON n.state = s.state GROUP BY s.ticker, n.regime""", "mean_return low_close high_close"))
def reg_summary(spark, d):
    return out(regimes.summary(regimes.label(states(spark, d))))
