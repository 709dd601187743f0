"""Warren Buffett: fundamentals, consistency, moat, management, intrinsic value."""

from pyspark.sql import functions as F

from bourse.functions import valuation as v
from bourse.functions.rules import Rules
from bourse.operators.scorers.base import Scorer
from bourse.operators.scorers.wood import growth_rates


def _owner_earnings(s):
    return v.owner_earnings_simple(s.x("net_income"), s.x("depreciation_and_amortization"), s.x("capital_expenditure"))


def _intrinsic(s):
    return v.dcf_multiple(_owner_earnings(s), 0.05, 0.09, 12.0, 10)


def _margin(s):
    value = _intrinsic(s)
    return F.when(value.isNotNull(), F.coalesce(v.margin_of_safety(value, s.x("market_cap")), F.lit(0.0)))


def _parts(s, literal):
    roe_t = s.t("return_on_equity") * 0.5 + s.t("return_on_equity")
    om_t = s.t("operating_margin") * 0.5 + s.t("operating_margin")
    basics = (Rules()
              .first((s.x("return_on_equity") > roe_t, 2, "strong return on equity"), (None, 0, "weak return on equity"))
              .first((s.x("debt_to_equity") < s.t("debt_to_equity"), 2, "conservative debt"), (None, 0, "high debt"))
              .first((s.x("operating_margin") > om_t, 2, "strong operating margin"), (None, 0, "weak operating margin"))
              .first((s.x("current_ratio") > s.t("current_ratio"), 1, "good liquidity"), (None, 0, "weak liquidity")))

    rates = growth_rates(s, "net_income", literal)
    consistency = (Rules(s.n >= 4, "needs four periods")
                   .first((F.get(rates, F.lit(0)) > F.get(rates, F.lit(1)), 3, "consistent earnings growth"),
                          (None, 0, "inconsistent earnings growth")))

    roe_ok = F.forall(s.all("return_on_equity"), lambda r: F.coalesce(r > roe_t, F.lit(False)))
    om_ok = F.forall(s.all("operating_margin"), lambda m: F.coalesce(m > om_t, F.lit(False)))
    moat = (Rules(s.n >= 3, "needs three periods")
            .first((roe_ok, 1, "stable return on equity"), (None, 0, "return on equity not stable"))
            .first((om_ok, 1, "stable operating margin"), (None, 0, "operating margin not stable"))
            .first((roe_ok & om_ok, 1, "both stable")))

    management = (Rules()
                  .first((s.x("issuance_or_purchase_of_equity_shares") < 0, 1, "buys back shares"),
                         (None, 0, "no buybacks"))
                  .first((s.x("dividends_and_other_cash_distributions") < 0, 1, "pays dividends"),
                         (None, 0, "no dividends")))
    return {"fundamentals": basics, "consistency": consistency, "moat": moat, "management": management}


def _signal(c):
    s, m = c("score"), c("margin_of_safety")
    return (F.when((s >= F.lit(0.7 * 15.0)) & (m >= 0.3), "bullish")
            .when((s <= F.lit(0.3 * 15.0)) | (m < -0.3), "bearish").otherwise("neutral"))


SCORER = Scorer(
    key="buffett", name="Warren Buffett", parts=_parts, max_score=15.0,
    values=lambda s: {"owner_earnings": _owner_earnings(s), "intrinsic_value": _intrinsic(s),
                      "margin_of_safety": _margin(s)},
    score=lambda c: c("fundamentals") + c("consistency") + c("moat") + c("management"), signal=_signal)
