"""Benjamin Graham: steady earnings, strong balance sheet, discount to value."""

from pyspark.sql import functions as F

from bourse.functions import valuation as v
from bourse.functions.columns import safe_div
from bourse.functions.rules import Rules
from bourse.operators.scorers.base import Scorer, share_signal


def _price(s):
    return safe_div(s.x("market_cap"), s.x("outstanding_shares"))


def _margin(s):
    number = v.graham_number(s.x("earnings_per_share"), s.x("book_value_per_share"))
    return F.when((s.x("outstanding_shares") > 0) & (_price(s) > 0), safe_div(number - _price(s), _price(s)))


def _parts(s, literal):
    positive = s.count("earnings_per_share", lambda e: e > 0)
    earnings = (Rules(s.n >= 2, "not enough EPS history")
                .first((positive == s.n, 3, "EPS positive in all periods"),
                       (positive >= s.n * F.lit(0.8), 2, "EPS positive in most periods"),
                       (None, 0, "EPS negative in several periods"))
                .first((s.x("earnings_per_share") > s.x("earnings_per_share", 1), 1, "EPS grew"),
                       (None, 0, "EPS did not grow")))

    cr, t, dr = s.x("current_ratio"), s.t("current_ratio"), s.x("debt_ratio")
    strength = (Rules()
                .first(((cr > 0) & (cr >= t * 0.333 + t), 2, F.format_string("solid current ratio %.2f", cr)),
                       ((cr > 0) & (cr >= t), 1, F.format_string("fair current ratio %.2f", cr)),
                       (cr > 0, 0, F.format_string("weak current ratio %.2f", cr)),
                       (None, 0, "no current ratio"))
                .first(((dr > 0) & (dr < 0.5), 2, F.format_string("conservative debt ratio %.2f", dr)),
                       ((dr > 0) & (dr < 0.8), 1, F.format_string("acceptable debt ratio %.2f", dr)),
                       (dr > 0, 0, F.format_string("high debt ratio %.2f", dr)),
                       (None, 0, "no debt ratio"))
                .first((s.x("dividends_and_other_cash_distributions") < 0, 1, "dividends paid"),
                       (None, 0, "no dividends paid")))

    cap, shares = s.x("market_cap"), s.x("outstanding_shares")
    ncav = v.net_current_assets(s.x("current_assets"), s.x("total_liabilities"))
    usable = (ncav > 0) & (shares > 0)
    margin = _margin(s)
    value = (Rules(cap > 0, "no market cap")
             .first((usable & (ncav > cap), 4, "net current assets above market cap"),
                    (usable & (safe_div(ncav, shares) >= _price(s) * 0.67), 2, "net current assets near price"),
                    (None, 0, "no net-net discount"))
             .first((margin > 0.5, 3, "large margin to Graham number"),
                    (margin > 0.2, 1, "some margin to Graham number"),
                    (margin.isNotNull(), 0, "no margin to Graham number"),
                    (None, 0, "no Graham number")))
    return {"earnings": earnings, "strength": strength, "valuation": value}


def _values(s):
    return {"graham_number": v.graham_number(s.x("earnings_per_share"), s.x("book_value_per_share")),
            "margin_of_safety": _margin(s)}


SCORER = Scorer(
    key="graham", name="Benjamin Graham", parts=_parts, values=_values, max_score=15.0,
    score=lambda c: c("earnings") + c("strength") + c("valuation"), signal=share_signal(15.0))
