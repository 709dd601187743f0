"""Valuation formulas as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from bourse.functions.columns import growth, safe_div, total


def _lit(x) -> Column:
    return x if isinstance(x, Column) else F.lit(float(x))


def present_value(flow: Column, g, r, years: int) -> Column:
    """sum over k = 1..years of flow * (1+g)^k / (1+r)^k"""
    g, r = _lit(g), _lit(r)
    return total([flow * F.pow(1.0 + g, F.lit(float(k))) / F.pow(1.0 + r, F.lit(float(k)))
                  for k in range(1, years + 1)])


def dcf(fcf: Column, g, r=0.10, terminal_g=0.02, years: int = 5) -> Column:
    """Discounted cash flow with a growing perpetuity; 0 when fcf <= 0."""
    term = fcf * F.pow(1.0 + _lit(g), F.lit(float(years))) * (1.0 + terminal_g) / (r - terminal_g)
    value = present_value(fcf, g, r, years) + term / F.pow(F.lit(1.0 + r), F.lit(float(years)))
    return F.when(fcf > 0, value).when(fcf.isNull() | (fcf <= 0), F.lit(0.0))


def dcf_multiple(flow: Column, g: float, r: float, multiple: float, years: int) -> Column:
    """Discounted flows plus a terminal multiple of the last one."""
    n = F.lit(float(years))
    return present_value(flow, g, r, years) + flow * F.pow(F.lit(1.0 + g), n) * multiple / F.pow(F.lit(1.0 + r), n)


def margin_of_safety(value: Column, market_cap: Column) -> Column:
    return safe_div(value - market_cap, market_cap)


def owner_earnings(net: Column, depreciation: Column, capex: Column, wc_change: Column, g: Column,
                   r: float = 0.15, margin: float = 0.25, years: int = 5) -> Column:
    """Owner-earnings value with a margin of safety; 0 when earnings are not positive."""
    oe = net + depreciation - capex - wc_change
    tg = F.least(g, F.lit(0.03))
    n = F.lit(float(years))
    term = oe * F.pow(1.0 + g, n) * (1.0 + tg) / (F.lit(r) - tg) / F.pow(F.lit(1.0 + r), n)
    value = (present_value(oe, g, r, years) + term) * (1.0 - margin)
    return F.when(oe > 0, value).otherwise(F.lit(0.0))


def owner_earnings_simple(net: Column, depreciation: Column, capex: Column) -> Column:
    """net + depreciation - 75 % of capex; NULL when all three are zero."""
    none = (net == 0) & (depreciation == 0) & (capex == 0)
    return F.when(~none, net + depreciation - 0.75 * capex)


def median_of(arr: Column) -> Column:
    """Median of a short array; NULL when it is empty or holds a NULL."""
    a = F.array_sort(arr)
    n = F.size(a)
    hi = F.get(a, F.floor(n / 2).cast("int"))
    lo = F.get(a, F.floor((n - 1) / 2).cast("int"))
    return F.when(~F.exists(arr, lambda v: v.isNull()), (lo + hi) / 2.0)


def ev_ebitda_value(ev: Column, ebitda: Column, market_cap: Column) -> Column:
    """Median EV/EBITDA of the periods on the newest EBITDA, less net debt; never negative.

    `ev` and `ebitda` are arrays, newest first.
    """
    multiples = F.zip_with(ev, ebitda, lambda a, b: safe_div(a, b))
    ev0, e0 = F.get(ev, F.lit(0)), F.get(ebitda, F.lit(0))
    value = F.greatest(median_of(multiples) * e0 - (ev0 - market_cap), F.lit(0.0))
    return F.when(ev0.isNull() | (ev0 == 0) | e0.isNull() | (e0 == 0), F.lit(0.0)).otherwise(value)


def residual_income(market_cap: Column, net: Column, price_to_book: Column, g: Column,
                    cost: float = 0.10, terminal_g: float = 0.03, years: int = 5) -> Column:
    """Book value plus discounted residual income, less 20 %; 0 when it is not positive."""
    book = safe_div(market_cap, price_to_book)
    ri = net - cost * book
    term = ri * F.pow(1.0 + g, F.lit(float(years + 1))) / (cost - terminal_g) / F.pow(F.lit(1.0 + cost), F.lit(float(years)))
    value = (book + present_value(ri, g, cost, years) + term) * 0.8
    usable = (market_cap != 0) & (net != 0) & (price_to_book > 0) & (ri > 0)
    return F.when(usable, value).otherwise(F.lit(0.0))


# fixed value: weights of the four methods
METHOD_WEIGHTS = {"dcf": 0.35, "owner_earnings": 0.35, "ev_ebitda": 0.20, "residual_income": 0.10}


def weighted_gap(values: dict[str, Column], market_cap: Column) -> Column:
    """Weighted relative gap to market cap over the methods with a positive value."""
    parts, weights = [], []
    for name, v in values.items():
        w = METHOD_WEIGHTS[name]
        gap = margin_of_safety(v, market_cap)
        parts.append(F.when(v > 0, w * gap).otherwise(F.lit(0.0)))
        weights.append(F.when(v > 0, F.lit(w)).otherwise(F.lit(0.0)))
    return safe_div(total(parts), total(weights))


def gap_signal(gap: Column) -> Column:
    return F.when(gap > 0.15, "bullish").when(gap < -0.15, "bearish").when(gap.isNotNull(), "neutral")


def gap_confidence(gap: Column) -> Column:
    """0..100, halves rounded to even."""
    return F.bround(F.least(F.abs(gap) / 0.30 * 100.0, F.lit(100.0)), 0)


def graham_number(eps: Column, book_per_share: Column) -> Column:
    return F.when((eps > 0) & (book_per_share > 0), F.sqrt(22.5 * eps * book_per_share))


def net_current_assets(current_assets: Column, liabilities: Column) -> Column:
    return current_assets - liabilities


def fcf_average(fcf: Column, newest: int = 5) -> Column:
    """Average of the newest cash flows of an array, newest first."""
    a = F.slice(fcf, 1, newest)
    return F.aggregate(a, F.lit(0.0), lambda acc, v: acc + v) / F.nullif(F.size(a), F.lit(0))


def eps_growth(eps0: Column, eps1: Column) -> Column:
    return growth(eps0, eps1)


def peg(pe: Column, eps0: Column, eps1: Column) -> Column:
    """P/E over EPS growth in percent; NULL unless EPS grew (growth over signed older EPS)."""
    g = safe_div(eps0 - eps1, eps1)
    return F.when(g > 0, pe / (g * 100.0))
