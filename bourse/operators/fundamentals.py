"""Statements -> reconstructed Q4 -> ratios -> newest periods and thresholds."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bourse.functions.columns import growth
from bourse.sources.filings import value_columns
from bourse.sources.reference import DEFAULT_SIC2, DEFAULT_SIC4, METRICS, sector_code

QUARTERS = ["Q1", "Q2", "Q3", "Q4"]
#: statement columns that are balances at a date (not flows over a period)
BALANCES = ("balance_sheet.",)
BALANCE_COLUMNS = ("income_statement.basic_average_shares.value",)


def statement_pivot(st: DataFrame, metrics: list[str], periods=("Q1", "Q2", "Q3", "FY")) -> DataFrame:
    """First filed value per (ticker, year) for each period x metric."""
    return st.groupBy("ticker", "fiscal_year").agg(*[
        F.min_by(F.when(F.col("fiscal_period") == p, F.col(f"`{m}`")),
                 F.when((F.col("fiscal_period") == p) & F.col(f"`{m}`").isNotNull(), F.col("filing_date"))).alias(f"{p}_{m}")
        for p in periods for m in metrics])


def missing_periods(st: DataFrame, required=("Q1", "Q2", "Q3", "FY")) -> DataFrame:
    """Per (ticker, year): is every required period filed, and which are not."""
    have = F.collect_set("fiscal_period")
    req = F.array(*[F.lit(p) for p in required])
    return (st.groupBy("ticker", "fiscal_year").agg(have.alias("_have"))
            .select("ticker", "fiscal_year",
                    (F.size(F.array_except(req, "_have")) == 0).alias("complete"),
                    F.array_join(F.array_sort(F.array_except(req, "_have")), ",").alias("missing")))


def _with_fourth_quarter(st: DataFrame, literal: bool, keep_filed: bool) -> DataFrame:
    """Per (ticker, year) the filed rows (optionally) and the reconstructed Q4 row.

    The few filings of a year are gathered once, so the statements are read and
    shuffled a single time.
    """
    metrics = value_columns(st)
    rest = [c for c in st.columns if c not in ("ticker", "fiscal_year")]
    row = "struct(" + ", ".join(f"`{c}`" for c in rest) + ")"
    year = st.groupBy("ticker", "fiscal_year").agg(
        F.expr(f"array_sort(collect_list(struct(filing_date AS _o, {row} AS r))) AS f"))
    # the first filed row of each period
    year = year.selectExpr("ticker", "fiscal_year", "transform(f, x -> x.r) AS f").selectExpr(
        "*", *[f"get(filter(f, x -> x.fiscal_period = '{p}'), 0) AS {p}" for p in ("Q1", "Q2", "Q3", "FY")])

    def field(c):
        if c == "fiscal_period":
            return f"'{c}', 'Q4'"
        flow = c in metrics and (literal or not (c.startswith(BALANCES) or c in BALANCE_COLUMNS))
        return f"'{c}', " + (f"FY.`{c}` - (Q1.`{c}` + Q2.`{c}` + Q3.`{c}`)" if flow else f"FY.`{c}`")

    q4 = f"named_struct({', '.join(field(c) for c in rest)})"
    complete = "Q1 IS NOT NULL AND Q2 IS NOT NULL AND Q3 IS NOT NULL AND FY IS NOT NULL"
    if keep_filed:
        out = year.selectExpr("ticker", "fiscal_year", f"inline(CASE WHEN {complete} THEN array_append(f, {q4}) ELSE f END)")
    else:
        out = year.where(complete).selectExpr("ticker", "fiscal_year", f"inline(array({q4}))")
    return out.select(*[F.col(f"`{c}`") for c in st.columns])


def fourth_quarters(st: DataFrame, literal: bool = False) -> DataFrame:
    """Q4 = FY - (Q1 + Q2 + Q3) for years that have all four periods.

    Header and market cap come from the FY row.  Balances and average shares
    are those of FY; `literal=True` subtracts them too, as the formula is written.
    """
    return _with_fourth_quarter(st, literal, keep_filed=False)


def reconstruct_q4(st: DataFrame, literal: bool = False) -> DataFrame:
    """Statements with the reconstructed Q4 rows appended."""
    return _with_fourth_quarter(st, literal, keep_filed=True)


_HEAD = ["ticker", "company_name", "sic2", "sic4", "filing_date", "end_date", "fiscal_period", "fiscal_year"]

# short names of the statement items used by the ratios
_ITEMS = {
    "net": "income_statement.net_income_loss", "rev": "income_statement.revenues",
    "costs": "income_statement.costs_and_expenses", "opex": "income_statement.operating_expenses",
    "op": "income_statement.operating_income_loss", "tax": "income_statement.income_tax_expense_benefit",
    "interest": "income_statement.interest_and_debt_expense",
    "depreciation": "income_statement.depreciation_and_amortization",
    "rd": "income_statement.research_and_development", "eps": "income_statement.basic_earnings_per_share",
    "shares": "income_statement.basic_average_shares", "common_div": "income_statement.common_stock_dividends",
    "preferred_div": "income_statement.preferred_stock_dividends_and_other_adjustments",
    "assets": "balance_sheet.assets", "debt": "balance_sheet.liabilities", "equity": "balance_sheet.equity",
    "cur_assets": "balance_sheet.current_assets", "cur_debt": "balance_sheet.current_liabilities",
    "cash": "balance_sheet.cash", "intangible": "balance_sheet.intangible_assets",
    "cf_operating": "cash_flow_statement.net_cash_flow_from_operating_activities",
    "cf_investing": "cash_flow_statement.net_cash_flow_from_investing_activities",
    "cf_financing": "cash_flow_statement.net_cash_flow_from_financing_activities",
}
_EBIT = "net + tax + interest"
_FCF = "cf_operating - cf_investing"

# fixed value: fundamentals column -> formula over the short names
RATIOS = {
    "return_on_equity": "net / nullif(equity, 0)",
    "operating_margin": "op / nullif(rev, 0)",
    "debt_to_equity": "debt / nullif(equity, 0)",
    "debt_ratio": "debt / nullif(assets, 0)",
    "current_ratio": "cur_assets / nullif(cur_debt, 0)",
    "enterprise_value": "market_cap + debt - cash",
    "ebit": _EBIT,
    "ebitda": f"{_EBIT} + depreciation",
    "free_cash_flow": _FCF,
    "free_cash_flow_per_share": f"({_FCF}) / nullif(shares, 0)",
    "net_margin": "net / nullif(rev, 0)",
    "book_value": "assets - debt",
    "book_value_per_share": "(assets - debt) / nullif(shares, 0)",
    "price_to_book_ratio": "market_cap / nullif(assets - debt, 0)",
    "return_on_invested_capital": "(net - common_div) / nullif(equity + debt, 0)",
    "gross_margin": "(rev - costs) / nullif(rev, 0)",
    "working_capital": "cur_assets - cur_debt",
    "earnings_per_share": "eps",
    "revenue": "rev",
    "net_income": "net",
    "total_assets": "assets",
    "total_liabilities": "debt",
    "total_debt": "debt",
    "current_assets": "cur_assets",
    "current_liabilities": "cur_debt",
    "dividends_and_other_cash_distributions": "preferred_div",
    "issuance_or_purchase_of_equity_shares": "cf_financing",
    "outstanding_shares": "shares",
    "capital_expenditure": "cf_investing",
    "operating_expense": "opex",
    "cash_and_equivalents": "cash",
    "shareholders_equity": "equity",
    "research_and_development": "rd",
    "goodwill_and_intangible_assets": "intangible",
    "intangible_assets": "intangible",
    "operating_income": "op",
    "depreciation_and_amortization": "depreciation",
    "market_cap": "market_cap",
}
RATIO_COLUMNS = list(RATIOS)


def ratios(st: DataFrame) -> DataFrame:
    """The fundamentals table: one projection over flat statements."""
    short = st.selectExpr(*_HEAD, "market_cap", *[f"`{c}.value` AS {n}" for n, c in _ITEMS.items()])
    return short.selectExpr(*_HEAD, *[f"{e} AS {n}" for n, e in RATIOS.items()])


PERIODS = {"Annual": ("FY", 10), "Quarterly": ("Q", 4)}


def check_period(period: str) -> tuple[str, int]:
    if period not in PERIODS:
        raise ValueError(f"period must be one of {sorted(PERIODS)}, got {period!r}")
    return PERIODS[period]


def latest_periods(fund: DataFrame, period: str = "Annual", limit: int | None = None) -> DataFrame:
    """The newest periods of each ticker, ranked newest first in `rn`.

    Annual: FY rows by period end, 10 of them.  Quarterly: Q1-Q4 rows by filing
    date, 4 of them; `limit` asks for another number.  Rank and filter sit next to each other so that Spark
    trims each ticker before the shuffle (WindowGroupLimit).
    """
    code, default = check_period(period)
    if code == "Q":
        rows, order = fund.where(F.col("fiscal_period").isin(QUARTERS)), [F.desc("filing_date"), F.desc("end_date")]
        n = limit or default
    else:
        rows, order = fund.where(F.col("fiscal_period") == code), [F.desc("end_date"), F.desc("filing_date")]
        n = limit or default
    if n < 1:
        raise ValueError("limit must be at least 1")
    w = Window.partitionBy("ticker").orderBy(*order)
    return rows.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= n)


def period_growth(fund: DataFrame, metrics: list[str], period: str = "Annual") -> DataFrame:
    """Growth of each metric against the next older period."""
    w = Window.partitionBy("ticker").orderBy("rn")
    return latest_periods(fund, period).select(
        "ticker", "fiscal_year", "fiscal_period", "rn",
        *[growth(F.col(m), F.lead(m).over(w)).alias(f"{m}_growth") for m in metrics])


def attach_thresholds(df: DataFrame, thresholds: DataFrame, prefix: str = "t_") -> DataFrame:
    """Add the sector's thresholds as `t_<metric>`.

    A missing code or an empty cell falls back to the default row of the matrix
    the code belongs to.  SIC codes have at most four digits, so the matrix can
    never pass 10,100 rows; it is joined on the code and left to the planner's
    size check to broadcast.  The default rows (one per matrix) ride along as
    scalar aggregates.
    """
    t = (thresholds.withColumn("_first", F.row_number().over(Window.partitionBy("code").orderBy("name", *METRICS)))
         .where("_first = 1").drop("_first"))  # of a repeated code the first row by name
    rows = t.selectExpr("code AS _code", *[f"{m} AS _c_{m}" for m in METRICS])
    defaults = (t.where(F.col("code").isin(DEFAULT_SIC2, DEFAULT_SIC4))
                .selectExpr("length(code) = 4 AS _four", *[f"{m} AS _d_{m}" for m in METRICS]))
    coded = df.withColumns({"_code": sector_code(), "_four": F.coalesce(F.length(sector_code()) == 4, F.col("sic2") == "73", F.lit(False))})
    # at most two default rows
    out = coded.join(rows, "_code", "left").join(F.broadcast(defaults), "_four", "left")
    return out.selectExpr(*[f"`{c}`" for c in df.columns],
                          *[f"coalesce(_c_{m}, _d_{m}) AS {prefix}{m}" for m in METRICS])
