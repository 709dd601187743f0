import pytest
from pyspark.sql import functions as F

from bourse.operators import fundamentals as fo
from bourse.operators import scorers
from bourse.operators.aggregates import insider_scores, signals_map
from bourse.operators.scorers import snapshot as snaps
from bourse.plans import fixtures as fx
from bourse.sources.reference import METRICS

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def fund(spark):
    return fo.ratios(fo.reconstruct_q4(fx.statements(spark, SF))).cache()


@pytest.fixture(scope="module")
def snap(fund):
    return snaps.build(fund, fx.thresholds(fund)).cache()


def test_reconstructed_q4_is_the_withheld_quarter(spark):
    full = fx.statements(spark, SF, with_q4=True).where("fiscal_period = 'Q4'")
    made = fo.fourth_quarters(fx.statements(spark, SF))
    flow, stock = "income_statement.revenues.value", "balance_sheet.assets.value"
    j = made.alias("a").join(full.alias("b"), ["ticker", "fiscal_year"])
    assert made.count() > 0 and j.count() == made.count()
    worst = j.select(F.abs(F.col(f"a.`{flow}`") - F.col(f"b.`{flow}`")).alias("f"), F.abs(F.col(f"a.`{stock}`") - F.col(f"b.`{stock}`")).alias("s")).agg(F.max("f"), F.max("s")).first()
    assert worst[0] < 1e-4 and worst[1] < 1e-4


def test_literal_q4_subtracts_balances_too(spark):
    st = fx.statements(spark, SF)
    stock = "`balance_sheet.assets.value`"
    a = {(r[0], r[1]): r[2] for r in fo.fourth_quarters(st).select("ticker", "fiscal_year", stock).collect()}
    b = {(r[0], r[1]): r[2] for r in fo.fourth_quarters(st, literal=True).select("ticker", "fiscal_year", stock).collect()}
    assert a.keys() == b.keys() and all(a[k] != b[k] for k in a)


def test_year_without_a_quarter_gives_no_q4(spark):
    st = fx.statements(spark, SF)
    assert fo.fourth_quarters(st.where("fiscal_period <> 'Q2'")).count() == 0
    m = fo.missing_periods(st.where("fiscal_period <> 'Q2'"))
    assert m.where("complete").count() == 0 and m.where("missing LIKE '%Q2%'").count() == m.count()


def test_period_names_are_checked(fund):
    with pytest.raises(ValueError):
        fo.latest_periods(fund, "quarterly")
    assert fo.latest_periods(fund, "Quarterly").groupBy("ticker").count().agg(F.max("count")).first()[0] == 4


def test_latest_periods_uses_group_limit(fund):
    assert "WindowGroupLimit" in fo.latest_periods(fund)._jdf.queryExecution().executedPlan().toString()


def test_threshold_fallbacks(spark):
    def row(code, v):
        return (code, code) + tuple(v for _ in METRICS)
    th = spark.createDataFrame([row("99", 1.0), row("7399", 2.0), row("05", 3.0), ("06", "06", None) + (4.0,) * 17],
                               "code string, name string, " + ", ".join(f"{m} double" for m in METRICS))
    keys = spark.createDataFrame([("a", "05", "0511"), ("b", "06", "0611"), ("c", "07", "0711"), ("d", "73", "7312"), ("e", None, None), ("f", "73", None)],
                                 "ticker string, sic2 string, sic4 string")
    got = {r.ticker: (r.t_free_cash_flow_per_share, r.t_current_ratio) for r in fo.attach_thresholds(keys, th).collect()}
    assert got == {"a": (3.0, 3.0), "b": (1.0, 4.0), "c": (1.0, 1.0), "d": (2.0, 2.0), "e": (1.0, 1.0), "f": (2.0, 2.0)}


def test_scores_stay_in_range_and_votes_add_up(snap):
    long = scorers.score_all(snap).cache()
    bad = long.where("score IS NOT NULL AND (score < 0 OR score > max_score)")
    assert bad.where("agent <> 'ackman'").count() == 0
    s = scorers.summary(snap).cache()
    n = long.groupBy("ticker").count()
    assert s.join(n, "ticker").where("bullish + bearish + neutral <> count").count() == 0
    v = scorers.vote_summary(long).select("ticker", F.col("signal").alias("sig"), F.col("score").alias("sc"))
    assert s.join(v, "ticker").where("signal <> sig OR abs(score - sc) > 1e-9").count() == 0


def test_chosen_scorers(snap):
    two = scorers.score_all(snap, ["graham", "Warren Buffett"])
    assert {r.agent for r in two.select("agent").distinct().collect()} == {"graham", "buffett"}
    with pytest.raises(ValueError, match="soros"):
        scorers.score_all(snap, ["soros"])


def test_literal_flag_changes_signs(snap):
    a = scorers.score(snap, "ackman", literal=True).select("ticker", F.col("discipline").alias("a"))
    b = scorers.score(snap, "ackman", literal=False).select("ticker", F.col("discipline").alias("b"))
    assert a.join(b, "ticker").where("a <> b").count() > 0


def test_side_inputs_replace_the_constants(spark, snap):
    trades = fx.insider_trades(spark, SF)
    heads = snap.select("ticker", F.lit(3).alias("score"))
    with_inputs = snaps.with_side_inputs(snap, insider_scores(trades), heads)
    got = scorers.score(with_inputs, "lynch").select("sentiment", "insider").distinct().collect()
    assert {r.sentiment for r in got} == {3.0} and {r.insider for r in got} <= {4.0, 5.0, 6.0, 8.0}
    assert {r.insider for r in scorers.score(snap, "lynch").select("insider").distinct().collect()} == {5.0}
    assert {r.insider for r in scorers.score(with_inputs, "fisher").select("insider").distinct().collect()} == {5.0}


def test_signals_map(snap):
    m = signals_map(scorers.score_all(snap, ["graham", "valuation"])).first()
    assert m.signals["graham"].signal in ("bullish", "bearish", "neutral") and m.signals["graham"].confidence is None
    assert 0 <= m.signals["valuation"].confidence <= 100


def test_reasons_cover_every_block(snap):
    r = scorers.reasons(snap)
    assert r.where("details IS NULL").count() == 0
    assert r.select("agent").distinct().count() == 9  # the valuation scorer has no rule blocks
