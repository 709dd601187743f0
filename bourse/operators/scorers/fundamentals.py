"""Fundamentals: four sub-signals from threshold counts, and the price ratios."""

from pyspark.sql import functions as F

from bourse.functions.columns import flag, growth, safe_div
from bourse.functions.rules import Rules
from bourse.operators.scorers.base import Scorer


def price_ratios(s):
    return {"pe_ratio": safe_div(s.x("market_cap"), s.x("net_income")),
            "pb_ratio": s.x("price_to_book_ratio"),
            "ps_ratio": safe_div(s.x("market_cap"), s.x("revenue"))}


def _growth(s, item):
    return F.coalesce(growth(s.x(item), s.x(item, 1)), F.lit(0.0))


def _parts(s, literal):
    profit = Rules()
    for item in ("return_on_equity", "net_margin", "operating_margin"):
        profit.add(s.x(item) > s.t(item), 1, f"{item} above sector")
    grow = (Rules().add(_growth(s, "revenue") > s.t("revenue_growth_qoq"), 1, "revenue growth above sector")
            .add(_growth(s, "earnings_per_share") > s.t("eps_growth_qoq"), 1, "EPS growth above sector")
            .add(_growth(s, "book_value") > s.t("bookValue_growth_qoq"), 1, "book value growth above sector"))
    cr, de, eps = s.x("current_ratio"), s.x("debt_to_equity"), s.x("earnings_per_share")
    fps, bps = s.x("free_cash_flow_per_share"), s.x("book_value_per_share")
    health = (Rules().add((cr != 0) & (cr > s.t("current_ratio")), 1, "strong liquidity")
              .add((de != 0) & (de < s.t("debt_to_equity")), 1, "conservative debt")
              .add((fps != 0) & (eps != 0) & (fps > eps * 0.8), 1, "cash flow covers earnings")
              .add((bps != 0) & (bps > s.t("book_value_per_share")), 1, "book value above sector"))
    p = price_ratios(s)
    price = (Rules().add(p["pe_ratio"] > s.t("price_to_earning_ratio"), 1, "P/E above sector")
             .add(p["pb_ratio"] > s.t("price_to_book_ratio"), 1, "P/B above sector")
             .add(p["ps_ratio"] > s.t("price_to_sales_ratio"), 1, "P/S above sector"))
    return {"profitability": profit, "growth": grow, "health": health, "price": price}


def _counts(c):
    """Bullish and bearish sub-signals; expensive price ratios are bearish."""
    good, bad = [], []
    for part in ("profitability", "growth", "health"):
        good.append(flag(c(part) >= 2))
        bad.append(flag(c(part) == 0))
    good.append(flag(c("price") == 0))
    bad.append(flag(c("price") >= 2))
    return sum(good[1:], good[0]), sum(bad[1:], bad[0])


def _signal(c):
    up, down = _counts(c)
    return F.when(up > down, "bullish").when(down > up, "bearish").otherwise("neutral")


def _confidence(c):
    up, down = _counts(c)
    return F.greatest(up, down) / F.lit(4.0) * 100.0


SCORER = Scorer(key="fundamentals", name="Fundamentals", parts=_parts, values=price_ratios,
                signal=_signal, confidence=_confidence)
