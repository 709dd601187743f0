"""Charlie Munger: moat, management, predictability, fair price."""

from pyspark.sql import functions as F

from bourse.functions import valuation as v
from bourse.functions.columns import safe_div
from bourse.functions.rules import Rules
from bourse.operators.scorers.base import Scorer, ten_point_signal
from bourse.operators.scorers.snapshot import mean_of


def _normal_fcf(s):
    return v.fcf_average(s.all("free_cash_flow"), 5)


def _mad(arr):
    m = mean_of(arr)
    return mean_of(F.transform(arr, lambda x: F.abs(x - m)))


def _parts(s, literal):
    n = s.n
    troic, tgm = s.t("return_on_invested_capital"), s.t("gross_margin")
    high = s.count("return_on_invested_capital", lambda r: r > troic)
    # neighbours run newest to oldest; as written, a period counts when the older margin is not lower
    rising = F.size(F.filter(s.pairs("gross_margin", lambda new, old: (old >= new) if literal else (new >= old)),
                             lambda b: b))
    capex = mean_of(F.zip_with(s.all("capital_expenditure"), s.all("revenue"), lambda c, r: safe_div(F.abs(c), r)))
    moat = (Rules()
            .first((high >= n * F.lit(0.8), 3, "high return on capital in nearly all periods"),
                   (high >= n * F.lit(0.5), 2, "high return on capital in half of the periods"),
                   (high > 0, 1, "high return on capital in some periods"),
                   (None, 0, "return on capital never high"))
            .first(((n >= 3) & (rising >= n * F.lit(0.7)), 2, "gross margin went up most of the time"),
                   ((n >= 3) & (s.mean("gross_margin") > tgm), 1, "good average gross margin"),
                   (n >= 3, 0, "low or falling gross margin"),
                   (None, 0, "not enough gross margin history"))
            .first(((n >= 3) & (capex < 0.05), 2, "low capital needs"),
                   ((n >= 3) & (capex < 0.10), 1, "moderate capital needs"),
                   (n >= 3, 0, "high capital needs"))
            .first((s.sum("research_and_development") > 0, 1, "invests in research"))
            .add(n > 0, 1, "goodwill and intangible assets reported"))

    conversion = mean_of(F.filter(F.zip_with(s.all("free_cash_flow"), s.all("net_income"), safe_div),
                                  lambda r: r.isNotNull()))
    de, tde = s.x("debt_to_equity"), s.t("debt_to_equity")
    cash = F.coalesce(safe_div(s.x("cash_and_equivalents"), s.x("revenue")), F.lit(0.0))
    sh0, shl = s.x("outstanding_shares"), s.oldest("outstanding_shares")
    owed = (de != 0)
    management = (Rules()
                  .first((conversion > 1.1, 3, "free cash flow well above net income"),
                         (conversion > 0.9, 2, "free cash flow about as high as net income"),
                         (conversion > 0.7, 1, "free cash flow somewhat below net income"),
                         (None, 0, "free cash flow far below net income"))
                  .first((owed & (de < tde - tde * 0.4), 3, "debt far below the sector level"),
                         (owed & (de < tde * 0.4 + tde), 2, "debt near the sector level"),
                         (owed & (de < tde * 2.0 + tde), 1, "debt above the sector level"),
                         (None, 0, "high or unknown debt"))
                  .first((cash.between(0.1, 0.25), 2, "cash reserve of a fitting size"),
                         (((cash >= 0.05) & (cash < 0.1)) | ((cash > 0.25) & (cash <= 0.4)), 1, "cash reserve slightly off"),
                         (None, 0, "too much or too little cash"))
                  .first((None, F.col("insider_points"), "insider activity"))
                  .first(((n >= 3) & (sh0 < shl * 0.95), 2, "share count falling"),
                         ((n >= 3) & (sh0 < shl * 1.05), 1, "stable share count"),
                         ((n >= 3) & (sh0 > shl * 1.2), -1, "heavy dilution"),
                         (None, 0, "share count rising or unknown")))

    rates = s.pairs("revenue", lambda new, old: safe_div(new, old) - 1.0)
    g, d, tg = mean_of(rates), _mad(rates), s.t("revenue_growth_qoq")
    op = s.count("operating_income", lambda x: x > 0)
    om_dev = _mad(s.all("operating_margin"))
    fcf = s.count("free_cash_flow", lambda x: x > 0)
    predictability = (Rules(n >= 4, "needs four periods")
                      .first(((g > F.abs(tg) * 0.5 + tg) & (d < 0.1), 3, "steady revenue growth"),
                             ((g > tg) & (d < 0.2), 2, "fairly steady revenue growth"),
                             (g > tg, 1, "unsteady revenue growth"),
                             (None, 0, "revenue not growing enough"))
                      .first(((n >= 5) & (op == n), 3, "operating income always positive"),
                             ((n >= 5) & (op >= n * F.lit(0.8)), 2, "operating income mostly positive"),
                             ((n >= 5) & (op >= n * F.lit(0.6)), 1, "operating income often positive"),
                             (None, 0, "operating income unpredictable or short"))
                      .first((om_dev < 0.03, 2, "very stable margins"), (om_dev < 0.07, 1, "stable margins"),
                             (None, 0, "volatile margins"))
                      .first((fcf == n, 2, "free cash flow always positive"),
                             (fcf >= n * F.lit(0.8), 1, "free cash flow mostly positive"),
                             (None, 0, "free cash flow unpredictable")))

    flows = s.all("free_cash_flow")
    norm, cap = _normal_fcf(s), s.x("market_cap")
    fcf_yield = safe_div(norm, cap)
    upside = v.margin_of_safety(norm * 15.0, cap)
    recent = mean_of(F.slice(flows, 1, 3))
    older = F.when(n >= 6, mean_of(F.slice(flows, F.greatest(n - 2, F.lit(1)), F.lit(3)))).otherwise(s.oldest("free_cash_flow"))
    value = (Rules(s.any_nonzero("market_cap") & (n >= 3) & (norm != 0), "not enough cash flow history")
             .first((fcf_yield > 0.08, 4, "excellent cash flow yield"), (fcf_yield > 0.05, 3, "good cash flow yield"),
                    (fcf_yield > 0.03, 1, "fair cash flow yield"), (None, 0, "low cash flow yield"))
             .first((upside > 0.3, 3, "large upside to reasonable value"),
                    (upside > 0.1, 2, "moderate upside to reasonable value"),
                    (upside > -0.1, 1, "near reasonable value"), (None, 0, "above reasonable value"))
             .first((recent > older * 1.2, 3, "growing cash flow"), (recent > older, 2, "stable cash flow"),
                    (None, 0, "falling cash flow")))
    return {"moat": moat, "management": management, "predictability": predictability, "valuation": value}


def _cap10(raw):
    return F.least(F.lit(10.0), raw)


SCORER = Scorer(
    key="munger", name="Charlie Munger", parts=_parts, max_score=10.0,
    scale={"moat": lambda r: F.least(F.lit(10.0), r * 10.0 / 9.0),
           "management": lambda r: F.greatest(F.lit(0.0), F.least(F.lit(10.0), r * 10.0 / 12.0)),
           "predictability": _cap10, "valuation": _cap10},
    values=lambda s: {"normalized_fcf": _normal_fcf(s), "fcf_yield": safe_div(_normal_fcf(s), s.x("market_cap")),
                      "conservative_value": _normal_fcf(s) * 10.0, "reasonable_value": _normal_fcf(s) * 15.0,
                      "optimistic_value": _normal_fcf(s) * 20.0},
    score=lambda c: c("moat") * 0.35 + c("management") * 0.25 + c("predictability") * 0.25 + c("valuation") * 0.15,
    signal=ten_point_signal)
