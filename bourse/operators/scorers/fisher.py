"""Phil Fisher: quality growth, stable margins, efficient management."""

from pyspark.sql import functions as F

from bourse.functions.columns import safe_div
from bourse.functions.rules import Rules
from bourse.operators.scorers.base import Scorer, scaled_to_ten, ten_point_signal
from bourse.operators.scorers.lynch import eps_growth, growth_group, revenue_growth
from bourse.operators.scorers.snapshot import mean_of


def _pstdev(arr):
    m = mean_of(arr)
    return F.sqrt(mean_of(F.transform(arr, lambda x: (x - m) * (x - m))))


def _parts(s, literal):
    levels = (lambda t: t * 8.0 + t, lambda t: t * 3.0 + t, lambda t: t)
    grow = Rules(s.n >= 2, "not enough history")
    growth_group(grow, "revenue", revenue_growth(s), s.t("revenue_growth_qoq"), *levels)
    growth_group(grow, "EPS", eps_growth(s), s.t("eps_growth_qoq"), *levels)
    rev = F.when(s.x("revenue") == 0, F.lit(1e-9)).otherwise(s.x("revenue"))
    rd = s.x("research_and_development") / rev
    grow.first((rd.between(0.03, 0.12), 3, "healthy research share"), (rd > 0.12, 2, "very high research share"),
               (rd > 0, 1, "low research share"), (None, 0, "no research"))

    om0, oml = s.x("operating_margin"), s.oldest("operating_margin")
    gm, tgm = s.x("gross_margin"), s.t("gross_margin")
    dev = _pstdev(s.all("operating_margin"))
    margins = (Rules(s.n >= 2, "not enough history")
               .first(((om0 >= oml) & (oml > 0), 2, "operating margin stable or improving"),
                      (om0 > 0, 1, "operating margin positive"), (None, 0, "operating margin not positive"))
               .first((gm > tgm, 2, "strong gross margin"), (gm > tgm - tgm * 0.4, 1, "moderate gross margin"),
                      (None, 0, "low gross margin"))
               .first(((s.n >= 3) & (dev < 0.02), 2, "very stable operating margin"),
                      ((s.n >= 3) & (dev < 0.05), 1, "stable operating margin"),
                      (None, 0, "operating margin volatile or short")))

    roe, troe, de, tde = s.x("return_on_equity"), s.t("return_on_equity"), s.x("debt_to_equity"), s.t("debt_to_equity")
    share = s.count("free_cash_flow", lambda f: f > 0) / s.n
    management = (Rules()
                  .first((roe > troe + troe, 3, "high return on equity"), (roe > troe, 2, "good return on equity"),
                         (roe > troe - troe, 1, "low return on equity"), (None, 0, "no return on equity"))
                  .first((de < tde - tde * 0.4, 2, "low debt"), (de < tde, 1, "manageable debt"), (None, 0, "high debt"))
                  .first(((s.n >= 2) & (share > 0.8), 1, "free cash flow mostly positive"),
                         (None, 0, "free cash flow inconsistent")))

    pe, tpe = safe_div(s.x("market_cap"), s.x("net_income")), s.t("price_to_earning_ratio")
    pf, tpf = safe_div(s.x("market_cap"), s.x("free_cash_flow")), s.t("price_to_fcf")
    value = (Rules()
             .first((pe < tpe - tpe * 0.2, 2, "attractive P/E"), (pe < tpe + tpe * 0.2, 1, "fair P/E"),
                    (None, 0, "high or no P/E"))
             .first((pf < tpf + tpf * 0.33, 2, "reasonable P/FCF"), (pf < tpf + tpf * 2.0, 1, "full P/FCF"),
                    (None, 0, "high or no P/FCF")))
    # this scorer always takes the neutral values for insiders and news
    return {"growth": grow, "margins": margins, "management": management, "valuation": value,
            "insider": Rules().first((None, 5, "neutral insider activity")),
            "sentiment": Rules().first((None, 5, "neutral news sentiment"))}


SCORER = Scorer(
    key="fisher", name="Phil Fisher", parts=_parts, max_score=10.0,
    scale={"growth": scaled_to_ten(9), "margins": scaled_to_ten(6), "management": scaled_to_ten(6),
           "valuation": scaled_to_ten(4)},
    score=lambda c: (c("growth") * 0.30 + c("margins") * 0.25 + c("management") * 0.20 + c("valuation") * 0.15
                     + c("insider") * 0.05 + c("sentiment") * 0.05),
    signal=ten_point_signal)
