"""Stanley Druckenmiller: growth and momentum with contained downside."""

from pyspark.sql import functions as F

from bourse.functions.columns import safe_div
from bourse.functions.rules import Rules
from bourse.operators.scorers.base import Scorer, scaled_to_ten, ten_point_signal
from bourse.operators.scorers.lynch import eps_growth, growth_group, revenue_growth

# fixed value: points given in place of price momentum and price volatility
MOMENTUM_POINTS, VOLATILITY_POINTS = 3, 3


def _parts(s, literal):
    levels = (lambda t: t * 2.0 + t, lambda t: t * 0.5 + t, lambda t: t - t * 0.5)
    grow = Rules(s.n >= 2, "not enough history")
    growth_group(grow, "revenue", revenue_growth(s), s.t("revenue_growth_qoq"), *levels)
    growth_group(grow, "EPS", eps_growth(s), s.t("eps_growth_qoq"), *levels)
    grow.first((None, MOMENTUM_POINTS, "momentum not measured"))

    de, tde = s.x("debt_to_equity"), s.t("debt_to_equity")
    risk = (Rules()
            .first((de < tde - tde * 0.4, 3, "low debt"), (de < tde + tde * 0.4, 2, "moderate debt"),
                   (de < tde + tde * 2.0, 1, "somewhat high debt"), (None, 0, "high debt"))
            .first((None, VOLATILITY_POINTS, "volatility not measured")))

    cap, ev = s.x("market_cap"), s.x("enterprise_value")
    tpe, tpf, tev = s.t("price_to_earning_ratio"), s.t("price_to_fcf"), s.t("ev_to_ebitda")
    pe = F.abs(safe_div(cap, s.x("net_income")))
    pf = F.abs(safe_div(cap, s.x("free_cash_flow")))
    ebit = F.when(ev > 0, F.abs(safe_div(ev, s.x("ebit"))))
    ebitda = F.when(ev > 0, F.abs(safe_div(ev, s.x("ebitda"))))
    value = (Rules()
             .first((pe < tpe - tpe * 0.4, 2, "attractive P/E"), (pe < tpe, 1, "fair P/E"), (None, 0, "high or no P/E"))
             .first((pf < tpf, 2, "attractive P/FCF"), (pf < tpf + tpf * 0.66, 1, "fair P/FCF"),
                    (None, 0, "high or no P/FCF"))
             .first((ebit < tev + tev * 0.5, 2, "attractive EV/EBIT"), (ebit < tev + tev * 1.5, 1, "fair EV/EBIT"),
                    (None, 0, "high or no EV/EBIT"))
             .first((ebitda < tev, 2, "attractive EV/EBITDA"), (ebitda < tev + tev * 0.8, 1, "fair EV/EBITDA"),
                    (None, 0, "high or no EV/EBITDA")))
    return {"growth": grow, "risk": risk, "valuation": value,
            "sentiment": Rules().first((None, F.col("sentiment_score"), "news sentiment")),
            "insider": Rules().first((None, F.col("insider_score"), "insider activity"))}


SCORER = Scorer(
    key="druckenmiller", name="Stanley Druckenmiller", parts=_parts, max_score=10.0,
    scale={"growth": scaled_to_ten(9), "risk": scaled_to_ten(6), "valuation": scaled_to_ten(8)},
    score=lambda c: (c("growth") * 0.35 + c("risk") * 0.20 + c("valuation") * 0.20
                     + c("sentiment") * 0.15 + c("insider") * 0.10),
    signal=ten_point_signal)
