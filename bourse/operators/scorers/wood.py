"""Cathie Wood: disruption, innovation-led growth, high-growth valuation."""

from pyspark.sql import functions as F

from bourse.functions import valuation as v
from bourse.functions.columns import growth, safe_div
from bourse.functions.rules import Rules
from bourse.operators.scorers.base import Scorer, share_signal


def growth_rates(s, item, literal):
    """Growth of neighbouring periods, pairs with a zero left out.

    `literal` follows the rule as written: (older - newer) / |newer|.
    """
    def rate(newer, older):
        g = growth(older, newer) if literal else growth(newer, older)
        return F.when((newer != 0) & (older != 0), g)
    return F.filter(s.pairs(item, rate), lambda r: r.isNotNull())


def _intrinsic(s):
    fcf = s.x("free_cash_flow")
    return F.when(fcf > 0, v.dcf_multiple(fcf, 0.20, 0.15, 25.0, 5))


def _margin(s):
    return v.margin_of_safety(_intrinsic(s), s.x("market_cap"))


def _parts(s, literal):
    three, two = s.n >= 3, s.n >= 2
    rates = growth_rates(s, "revenue", literal)
    g0, g1 = F.get(rates, F.lit(0)), F.get(rates, F.lit(1))
    latest = F.coalesce(g0, F.lit(0.0))
    tg = s.t("revenue_growth_qoq")
    gm0, gm1 = s.x("gross_margin"), s.x("gross_margin", 1)
    rev0, rev1 = s.x("revenue"), s.x("revenue", 1)
    rd0, rd1 = s.x("research_and_development"), s.x("research_and_development", 1)
    intensity = safe_div(rd0, rev0)
    disruptive = (Rules()
                  .first((three & (g0 > g1), 2, "revenue growth accelerating"))
                  .first((three & (latest > tg + tg), 3, "exceptional revenue growth"),
                         (three & (latest > tg), 2, "strong revenue growth"),
                         (three & (latest > tg - tg * 0.6), 1, "moderate revenue growth"),
                         (~three, 0, "not enough revenue history"))
                  .first((two & (gm0 - gm1 > 0.05), 2, "gross margin expanding"),
                         (two & (gm0 - gm1 > 0), 1, "gross margin improving slightly"))
                  .first((two & (gm0 > s.t("gross_margin")), 2, "high gross margin"))
                  .first((two & (growth(rev0, rev1) > growth(s.x("operating_expense"), s.x("operating_expense", 1))),
                          2, "revenue grows faster than operating expense"))
                  .first((intensity > 0.13, 3, "high research intensity"),
                         (intensity > 0.08, 2, "moderate research intensity"),
                         (intensity > 0.04, 1, "some research")))

    rd_growth = F.when(rd1 == 0, F.lit(0.0)).otherwise(growth(rd0, rd1))
    f0, f1 = s.x("free_cash_flow"), s.x("free_cash_flow", 1)
    positive = s.count("free_cash_flow", lambda f: f > 0)
    om0, om1, tom = s.x("operating_margin"), s.x("operating_margin", 1), s.t("operating_margin")
    c0, c1 = F.abs(s.x("capital_expenditure")), F.abs(s.x("capital_expenditure", 1))
    capex = safe_div(c0, rev0)
    capex_growth = F.when(c1 == 0, F.lit(0.0)).otherwise(growth(c0, c1))
    payout = F.when(f0 == 0, F.lit(1.0)).otherwise(safe_div(s.x("dividends_and_other_cash_distributions"), f0))
    innovation = (Rules()
                  .first((two & (rd_growth > 0.5), 3, "strong research growth"),
                         (two & (rd_growth > 0.2), 2, "moderate research growth"))
                  .first((two & (intensity > safe_div(rd1, rev1)), 2, "research intensity rising"))
                  .first((two & (growth(f0, f1) > 0.3) & (positive == s.n), 3, "strong and steady free cash flow"),
                         (two & (positive >= s.n * F.lit(0.75)), 2, "steady free cash flow"),
                         (two & (positive > s.n * F.lit(0.5)), 1, "mostly positive free cash flow"))
                  .first((two & (om0 > tom * 0.5 + tom) & (om0 - om1 > 0), 3, "strong and rising operating margin"),
                         (two & (om0 > tom), 2, "healthy operating margin"),
                         (two & (om0 - om1 > 0), 1, "rising operating margin"))
                  .first((two & (capex > 0.10) & (capex_growth > 0.2), 2, "strong capital investment"),
                         (two & (capex > 0.05), 1, "moderate capital investment"))
                  .first((payout < 0.2, 2, "reinvests instead of paying out"),
                         (payout < 0.4, 1, "moderate payout")))

    m = _margin(s)
    value = Rules().first((m > 0.5, 3, "large margin of safety"), (m > 0.2, 1, "some margin of safety"),
                          (None, 0, "no margin of safety"))
    return {"disruptive": disruptive, "innovation": innovation, "valuation": value}


SCORER = Scorer(
    key="wood", name="Cathie Wood", parts=_parts, max_score=15.0,
    scale={"disruptive": lambda r: r / 12.0 * 5.0, "innovation": lambda r: r / 15.0 * 5.0},
    values=lambda s: {"intrinsic_value": _intrinsic(s), "margin_of_safety": _margin(s)},
    score=lambda c: c("disruptive") + c("innovation") + c("valuation"), signal=share_signal(15.0))
