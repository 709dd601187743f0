import itertools
import math

import numpy as np
import pytest
from helpers import close_to, daily, ordered, price_frame
from pyspark.sql import functions as F

from bourse.operators import aggregates as agg
from bourse.operators import modelling as ml
from bourse.operators import regimes as rg


@pytest.fixture(scope="module")
def table(spark):
    return ml.chrono_split(daily(spark, price_frame({"A": 200, "B": 100, "C": 50}, seed=2))).cache()


def test_split_is_by_time_and_keeps_days_whole(table):
    t = table.toPandas()
    assert t.groupby("date").split.nunique().max() == 1
    order = t.sort_values("date").drop_duplicates("date").split.tolist()
    assert order == sorted(order, key=["train", "val", "test"].index)
    share = (t.split == "train").mean()
    assert 0.78 < share < 0.83


def test_clean_uses_train_medians(spark):
    df = spark.createDataFrame([("train", 1.0), ("train", 3.0), ("train", float("inf")), ("test", None), ("test", float("nan")), ("test", 100.0)], "split string, x double")
    got = sorted(r.x for r in ml.clean(df, ["x"]).collect())
    assert got == [1.0, 2.0, 2.0, 2.0, 3.0, 100.0]


def test_scale_with_constant_feature(table):
    df = table.withColumn("k", F.lit(4.0))
    got = ml.scale(df, ["close", "k"]).toPandas()
    tr = got[got.split == "train"]
    assert abs(tr.close.mean()) < 1e-9 and abs(tr.close.std(ddof=0) - 1) < 1e-9 and (got.k == 0).all()
    zero = ml.zero_scales(agg.scaler_stats(df, ["close", "k"])).collect()
    assert [(r.feature, r.problem) for r in zero] == [("k", "zero")]


def test_linear_fit_finds_the_coefficients(table):
    df = table.withColumn("y", 3.0 + 2.0 * F.col("close") - 0.5 * F.col("volume"))
    m = ml.fit_linear(df, ["close", "volume"], "y")
    assert math.isclose(m["intercept"], 3.0, abs_tol=1e-6) and math.isclose(m["coefficients"]["volume"], -0.5, abs_tol=1e-8)
    p = ml.score_linear(df, m).select(F.max(F.abs(F.col("predicted") - F.col("y")))).first()[0]
    assert p < 1e-6


def test_linear_fit_equals_least_squares(table):
    """Also with a feature that others determine, missing values, and no usable row."""
    df = table.withColumns({"y": F.col("close") * 1.5 + F.sin("volume") * 3, "double": F.col("close") * 2, "gap": F.when(F.col("volume") > 20, F.col("open"))})
    pdf = df.where("split = 'train'").toPandas()
    use = pdf.dropna(subset=["gap"])
    a = np.column_stack([np.ones(len(use)), use[["close", "volume", "gap"]]])
    want = np.linalg.lstsq(a, use["y"], rcond=None)[0]
    m = ml.fit_linear(df, ["close", "volume", "gap"], "y")
    close_to([m["intercept"], *m["coefficients"].values()], want, 1e-6)
    twin = ml.fit_linear(df, ["close", "double", "volume"], "y")
    p = ml.score_linear(df, twin).where("split = 'train'").toPandas()
    b = np.column_stack([np.ones(len(pdf)), pdf[["close", "volume"]]])
    close_to(np.sort(p["predicted"]), np.sort(b @ np.linalg.lstsq(b, pdf["y"], rcond=None)[0]), 1e-6)
    with pytest.raises(ValueError):
        ml.fit_linear(df.where("false"), ["close"], "y")


def test_model_hook_gets_past_windows(table):
    got = ordered(ml.score_model(table, ["close"], 3, lambda x: x[:, -1, 0]))
    src = ordered(table)
    want = src.assign(p=src.groupby("ticker").close.shift(1), n=src.groupby("ticker").cumcount())
    close_to(got["predicted"], want[want.n >= 3].p)


def test_importance(table):
    pdf = table.toPandas()
    r = {x.feature: x.importance for x in ml.linear_importance(table, {"coefficients": {"close": 2.0, "volume": -1.0}}).collect()}
    assert math.isclose(r["close"], (2 * (pdf.close - pdf.close.mean()).abs()).mean(), rel_tol=1e-9)


def _model(seed=0):
    rng = np.random.default_rng(seed)
    a = rng.random((3, 3, 3))
    t = rng.random((3, 3)) + 0.1
    return rg.Hmm(np.array([0.5, 0.3, 0.2]), t / t.sum(axis=1, keepdims=True), rng.normal(size=(3, 3)),
                  np.array([m @ m.T + np.eye(3) for m in a]), np.zeros(3), np.ones(3))


def _paths(x, m):
    dens = rg._log_density(x, m)
    for path in itertools.product(range(3), repeat=len(x)):
        p = math.log(m.start[path[0]]) + dens[0, path[0]]
        for t in range(1, len(x)):
            p += math.log(m.trans[path[t - 1], path[t]]) + dens[t, path[t]]
        yield path, p


def test_forward_backward_against_all_paths():
    m = _model()
    x = np.random.default_rng(1).normal(size=(6, 3))
    ll, g, xi = rg.forward_backward(rg.Sequences(x, np.array([6]), np.array([True])), m)
    allp = list(_paths(x, m))
    total = np.logaddexp.reduce([p for _, p in allp])
    assert math.isclose(ll, total, rel_tol=1e-10)
    w = np.zeros((6, 3))
    tr = np.zeros((3, 3))
    for path, p in allp:
        e = math.exp(p - total)
        for t, k in enumerate(path):
            w[t, k] += e
        for a, b in zip(path, path[1:]):
            tr[a, b] += e
    close_to(g, w, 1e-9)
    close_to(xi, tr, 1e-9)


def _bar_by_bar(x, m):
    """(log-likelihood, state weights, transition weights) of one sequence, one bar after the other."""
    logb = rg._log_density(x, m)
    top = logb.max(axis=1, keepdims=True)
    b, n = np.exp(logb - top), len(x)
    alpha, scale, beta, xi = np.empty((n, 3)), np.empty(n), np.ones((n, 3)), np.zeros((3, 3))
    for t in range(n):
        a = (alpha[t - 1] @ m.trans if t else m.start) * b[t]
        scale[t] = a.sum()
        alpha[t] = a / scale[t]
    for t in range(n - 2, -1, -1):
        w = b[t + 1] * beta[t + 1] / scale[t + 1]
        xi += m.trans * np.outer(alpha[t], w)
        beta[t] = m.trans @ w
    return np.log(scale).sum() + top.sum(), alpha * beta, xi


def test_runs_of_one_series_carry_over():
    """Runs with entry and leave weights give what the whole series gives."""
    m, x = _model(4), np.random.default_rng(2).normal(size=(150, 3))
    want = _bar_by_bar(x, m)
    cut = rg.Sequences(x, np.array([40, 1, 64, 45]), np.array([True, False, False, False]))
    p = rg.run_products(cut, m)
    entry, leave = np.full((4, 3), 1 / 3), np.ones((4, 3))
    for i in range(1, 4):
        entry[i] = entry[i - 1] @ p[i - 1]
    for i in (2, 1, 0):
        leave[i] = p[i + 1] @ leave[i + 1]
    ll, g, xi = rg.forward_backward(cut, m, entry, leave)
    assert math.isclose(ll, want[0], rel_tol=1e-10)
    close_to(g, want[1], 1e-9)
    close_to(xi, want[2], 1e-9)


def test_decoded_path_is_the_best_of_all(spark):
    import datetime as dt
    m = _model(3)
    x = np.random.default_rng(5).normal(size=(13, 3))
    best = lambda part: max(_paths(part, m), key=lambda v: v[1])[0]
    want = {"A": best(x[:7]), "B": best(x[7:12]), "C": best(x[12:])}
    rows, at = [], 0
    for t, n in (("A", 7), ("B", 5), ("C", 1)):
        rows += [(t, dt.datetime(2001, 1, 1, i), *map(float, x[at + i])) for i in range(n)]
        at += n
    hourly = spark.createDataFrame(rows, "ticker string, date timestamp, ret double, range double, volume double")
    by_day = hourly.withColumn("date", F.expr("date_add(date'2001-01-01', hour(date))"))
    for df, chunk in ((by_day, None), (by_day, 2), (hourly, None), (hourly, 3)):
        got = rg.decode(df, m, chunk=chunk).orderBy("ticker", "date").collect()
        assert {t: tuple(r.state for r in got if r.ticker == t) for t in want} == want
        assert {r.regime for r in got if r.state == 0} <= {m.labels()[0]}


def test_missing_features_fit_all_states_alike(spark):
    import datetime as dt
    df = spark.createDataFrame([("A", dt.date(2001, 1, 1), None, 1.0, 1.0)], "ticker string, date date, ret double, range double, volume double")
    assert rg.decode(df, _model()).first().state == 0 and rg.decode(df.where("false"), _model()).count() == 0


def test_fit_never_loses_likelihood_and_orders_regimes(spark):
    feats = rg.features(daily(spark, price_frame({"A": 150, "B": 80}, seed=9)))
    m = rg.fit(feats, max_rounds=8)
    assert all(b >= a - 1e-3 for a, b in zip(m.history, m.history[1:]))  # the covariance floor may cost a trace
    assert sorted(m.labels().values()) == sorted(rg.REGIMES)
    rows = {r.regime: r for r in rg.model_table(spark, m).collect()}
    assert rows["Bearish"].mean_return <= rows["Neutral"].mean_return <= rows["Bullish"].mean_return
    assert math.isclose(rows["Neutral"].aic, -2 * m.log_likelihood + 2 * 35)
    d = rg.decode(feats, m)
    assert d.count() == feats.count() and set(d.toPandas().regime) <= set(rg.REGIMES)


def test_hourly_series_are_fitted_alike(spark, monkeypatch):
    """Cut into runs of 20 bars, hourly bars give the model of the same bars by day."""
    monkeypatch.setattr(rg, "RUN", 20)
    pdf = price_frame({"A": 150, "B": 80}, seed=9)
    by_day = rg.features(daily(spark, pdf))
    hourly = by_day.withColumn("date", F.expr("timestamp'2001-01-01 00:00:00' + make_interval(0, 0, 0, 0, datediff(date, date'2001-01-01'))"))
    a, b = rg.fit(by_day, max_rounds=4), rg.fit(hourly, max_rounds=4)
    for name in ("start", "trans", "means", "covs"):
        close_to(getattr(a, name), getattr(b, name), 1e-6)
    assert math.isclose(a.log_likelihood, b.log_likelihood, rel_tol=1e-9)


def test_one_task_and_many_give_the_same_model(spark, monkeypatch):
    feats = rg.features(daily(spark, price_frame({"A": 150, "B": 80, "C": 3}, seed=9)))
    a = rg.fit(feats, max_rounds=9)
    monkeypatch.setattr(rg, "BUCKET_ROWS", 50)
    b = rg.fit(feats, max_rounds=9)
    for name in ("start", "trans", "means", "covs", "history"):
        close_to(getattr(a, name), getattr(b, name), 1e-7)
    assert (a.rounds, a.converged, a.rows) == (b.rounds, b.converged, b.rows)


def test_leaps_end_where_plain_rounds_do(spark, monkeypatch):
    feats = rg.features(daily(spark, price_frame({"A": 200, "B": 120}, seed=4)))
    fast = rg.fit(feats, max_rounds=300, tol=1e-6)
    monkeypatch.setattr(rg, "_leap", lambda a, b, c, floor: c)
    plain = rg.fit(feats, max_rounds=2000, tol=1e-6)
    assert fast.log_likelihood > plain.log_likelihood - 0.5
    assert fast.rounds < plain.rounds


def test_pieces_stepped_together_equal_single_bars(spark, tmp_path):
    rng = np.random.default_rng(3)
    m = rg.Hmm(np.array([0.5, 0.3, 0.2]), np.array([[0.8, 0.15, 0.05], [0.1, 0.8, 0.1], [0.05, 0.15, 0.8]]), rng.normal(size=(3, 3)),
               np.array([np.eye(3) * s for s in (0.5, 1.0, 2.0)]), np.zeros(3), np.ones(3))
    length = np.array([40, 1, 7, 23, 32, 33, 100])
    x = rng.normal(size=(length.sum(), 3))
    ll, g, xi = rg.forward_backward(rg.Sequences(x, length, np.ones(7, bool)), m)
    single = [_bar_by_bar(p, m) for p in np.split(x, np.cumsum(length)[:-1])]
    assert np.isclose(ll, sum(s[0] for s in single)) and np.allclose(xi, sum(s[2] for s in single))
    assert np.allclose(g, np.concatenate([s[1] for s in single]))
    rg.save_model(spark, m, str(tmp_path / "m"))
    back = rg.load_model(spark, str(tmp_path / "m"))
    assert all((getattr(back, f) == getattr(m, f)).all() for f in ("start", "trans", "means", "covs", "shift", "scale"))
