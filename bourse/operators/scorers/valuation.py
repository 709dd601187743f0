"""Valuation: weighted gap between four fair values and the market cap."""

from pyspark.sql import functions as F

from bourse.functions import valuation as v
from bourse.functions.columns import growth
from bourse.operators.scorers.base import Scorer


def _values(s):
    # annual analysis looks at the two newest years, quarterly at all four quarters
    annual = F.col("period") == "Annual"

    def newest(item):
        return F.when(annual, F.slice(s.all(item), 1, 2)).otherwise(s.all(item))

    eps_g = F.coalesce(growth(s.x("earnings_per_share"), s.x("earnings_per_share", 1)), F.lit(0.0))
    book_g = F.coalesce(growth(s.x("book_value"), s.x("book_value", 1)), F.lit(0.0))
    wc = F.coalesce(s.x("working_capital") - s.x("working_capital", 1), F.lit(0.0))
    cap = s.x("market_cap")
    values = {
        "dcf": v.dcf(s.x("free_cash_flow"), eps_g, 0.10, 0.03, 5),
        "owner_earnings": v.owner_earnings(s.x("net_income"), s.x("depreciation_and_amortization"),
                                           s.x("capital_expenditure"), wc, eps_g),
        "ev_ebitda": v.ev_ebitda_value(newest("enterprise_value"), newest("ebitda"), cap),
        "residual_income": v.residual_income(cap, s.x("net_income"), s.x("price_to_book_ratio"), book_g),
    }
    return {**values, "gap": v.weighted_gap(values, cap)}


SCORER = Scorer(
    key="valuation", name="Valuation", parts=lambda s, literal: {}, values=_values,
    signal=lambda c: v.gap_signal(c("gap")), confidence=lambda c: v.gap_confidence(c("gap")))
