"""Bill Ackman: quality business, discipline, room for activism, discount."""

from pyspark.sql import functions as F

from bourse.functions import valuation as v
from bourse.functions.columns import growth
from bourse.functions.rules import Rules
from bourse.operators.scorers.base import Scorer, share_signal


def _intrinsic(s):
    fcf = s.x("free_cash_flow")
    return F.when(fcf != 0, v.dcf_multiple(fcf, 0.06, 0.10, 15.0, 5))


def _margin(s):
    return v.margin_of_safety(_intrinsic(s), s.x("market_cap"))


def _parts(s, literal):
    r0, r1 = s.x("revenue"), s.x("revenue", 1)
    g = growth(r0, r1)
    tg, tom, troe = s.t("revenue_growth_qoq"), s.t("operating_margin"), s.t("return_on_equity")
    strong_om, strong_roe = tom * 0.5 + tom, troe * 0.5 + troe
    grew = (r0 != 0) & (r1 != 0) & (r0 > r1)
    quality = (Rules()
               .first((grew & (g > tg * 0.4 + tg), 2, "strong revenue growth"),
                      (grew, 1, "revenue growth"),
                      (None, 0, "no revenue growth"))
               .first((s.majority("operating_margin", lambda m: m > strong_om), 2, "operating margin mostly high"),
                      (None, 0, "operating margin not consistently high"))
               .first((s.majority("free_cash_flow", lambda f: f > 0), 1, "free cash flow mostly positive"),
                      (None, 0, "free cash flow not consistently positive"))
               .first((s.x("return_on_equity") > strong_roe, 2, "high return on equity"),
                      (None, 0, "return on equity not high"))
               .first((s.sum("intangible_assets") > 0, 1, "intangible assets")))

    de2 = s.t("debt_to_equity") * 2.0
    sh0, sh1 = s.x("outstanding_shares"), s.x("outstanding_shares", 1)
    fewer = sh1 < sh0 if literal else sh0 < sh1
    discipline = (Rules()
                  .first((s.any_nonzero("debt_to_equity") & s.majority("debt_to_equity", lambda d: d < de2),
                          2, "reasonable leverage in most periods"),
                         (None, 0, "leverage high in many periods"))
                  .first((s.majority("dividends_and_other_cash_distributions", lambda d: d < 0), 1, "dividends in most periods"),
                         (None, 0, "no regular dividends"))
                  .first((fewer, 1, "share count fell"), (None, 0, "share count did not fall")))

    low = s.mean("operating_margin") < tom
    activism = (Rules((s.n >= 2) & s.any_nonzero("operating_margin"), "not enough history")
                .first(((g > 0.15) & low, 2, "growth with low margins: room for activism"),
                       (None, 0, "no activism opportunity")))

    m = _margin(s)
    value = (Rules(s.any_nonzero("market_cap"), "no market cap")
             .first((m > 0.3, 3, "large margin of safety"), (m > 0.1, 1, "some margin of safety"),
                    (None, 0, "no margin of safety")))
    return {"quality": quality, "discipline": discipline, "activism": activism, "valuation": value}


SCORER = Scorer(
    key="ackman", name="Bill Ackman", parts=_parts, max_score=20.0,
    values=lambda s: {"intrinsic_value": _intrinsic(s), "margin_of_safety": _margin(s)},
    score=lambda c: c("quality") + c("discipline") + c("activism") + c("valuation"), signal=share_signal(20.0))
