"""Peter Lynch: growth at a reasonable price."""

from pyspark.sql import functions as F

from bourse.functions import valuation as v
from bourse.functions.columns import growth, safe_div
from bourse.functions.rules import Rules
from bourse.operators.scorers.base import Scorer, scaled_to_ten, ten_point_signal


def growth_group(rules, what, rate, t, strong, mid, low):
    """+3 / +2 / +1 for growth above three levels given as functions of the threshold."""
    return rules.first((rate > strong(t), 3, f"strong {what} growth"), (rate > mid(t), 2, f"moderate {what} growth"),
                       (rate > low(t), 1, f"slight {what} growth"), (None, 0, f"no {what} growth"))


def revenue_growth(s):
    return F.when(s.x("revenue", 1) > 0, growth(s.x("revenue"), s.x("revenue", 1)))


def eps_growth(s):
    old = s.x("earnings_per_share", 1)
    return F.when(F.abs(old) > 1e-9, growth(s.x("earnings_per_share"), old))


def _pe(s):
    return safe_div(s.x("market_cap"), s.x("net_income"))


def _peg(s):
    return v.peg(_pe(s), s.x("earnings_per_share"), s.x("earnings_per_share", 1))


def _parts(s, literal):
    levels = (lambda t: t * 1.25 + t, lambda t: t, lambda t: t - t * 0.8)
    grow = Rules(s.n >= 2, "not enough history")
    growth_group(grow, "revenue", revenue_growth(s), s.t("revenue_growth_qoq"), *levels)
    growth_group(grow, "EPS", eps_growth(s), s.t("eps_growth_qoq"), *levels)

    equity = F.when(s.x("shareholders_equity") == 0, F.lit(1e-9)).otherwise(s.x("shareholders_equity"))
    de, tde = s.x("total_debt") / equity, s.t("debt_to_equity")
    om, tom = s.x("operating_margin"), s.t("operating_margin")
    basics = (Rules()
              .first((de < tde, 2, "low debt"), (de < tde + tde, 1, "moderate debt"), (None, 0, "high debt"))
              .first((om > tom + tom, 2, "strong operating margin"), (om > tom, 1, "moderate operating margin"),
                     (None, 0, "low operating margin"))
              .first((s.x("free_cash_flow") > 0, 2, "positive free cash flow"), (None, 0, "no positive free cash flow")))

    pe, tpe, peg = _pe(s), s.t("price_to_earning_ratio"), _peg(s)
    value = (Rules()
             .first((pe < tpe - tpe * 0.4, 2, "low P/E"), (pe < tpe, 1, "fair P/E"), (None, 0, "high or no P/E"))
             .first((peg < 1, 3, "attractive PEG"), (peg < 2, 2, "fair PEG"), (peg < 3, 1, "full PEG"),
                    (None, 0, "high or no PEG")))
    return {"growth": grow, "fundamentals": basics, "valuation": value,
            "sentiment": Rules().first((None, F.col("sentiment_score"), "news sentiment")),
            "insider": Rules().first((None, F.col("insider_score"), "insider activity"))}


SCORER = Scorer(
    key="lynch", name="Peter Lynch", parts=_parts, max_score=10.0,
    scale={"growth": scaled_to_ten(6), "fundamentals": scaled_to_ten(6), "valuation": scaled_to_ten(5)},
    values=lambda s: {"pe_ratio": _pe(s), "peg_ratio": _peg(s)},
    score=lambda c: (c("growth") * 0.30 + c("valuation") * 0.25 + c("fundamentals") * 0.20
                     + c("sentiment") * 0.15 + c("insider") * 0.10),
    signal=ten_point_signal)
