"""Queries over filings, ratios, valuations and scorers."""

from __future__ import annotations

from pyspark.sql import functions as F

from bourse.functions import valuation as v
from bourse.operators import aggregates as agg
from bourse.operators import fundamentals as fund_ops
from bourse.operators import joins, scorers
from bourse.operators.scorers import snapshot as snaps
from bourse.plans import fixtures as fx
from bourse.plans.registry import ORACLES, out, query, sql
from bourse.sources import filings as fil
from bourse.sources import news as news_src
from bourse.sources import reference as ref
from bourse.sources import tables

ST = fx.STATEMENTS_CTE
FU = fx.FUND_CTE
TH = fx.THRESHOLDS_CTE


def statements(spark, d):
    """Landed filings parsed into flat statements."""
    return fil.flatten_filings(fx.filings_json(spark, d), fx.SECTIONS)


def fund(spark, d):
    return fund_ops.ratios(fund_ops.reconstruct_q4(fx.statements(spark, d)))


def snapshot(spark, d, period="Annual"):
    f = fund(spark, d)
    return snaps.build(f, fx.thresholds(f), period)


def _short(df, *items):
    """Value columns under their item name (dots out of the result names)."""
    return df.select(*[F.col(f"`{c}`").alias(c.split(".")[1]) if c.endswith(".value") else F.col(c)
                       for c in df.columns if not items or c in items])


ALL_ITEMS = " ".join(fx.ITEMS)


@query("src_filings_json", sql(ST, f"SELECT ticker, fiscal_year, fiscal_period, filing_date, {', '.join(fx.ITEMS)} FROM statements", ALL_ITEMS, 4))
def src_filings_json(spark, d):
    df = statements(spark, d)
    return out(_short(df.select("ticker", "fiscal_year", "fiscal_period", "filing_date",
                                *[F.col(f"`{c}`") for c in fil.value_columns(df)])), 4)


def undeclared(spark, d):
    """Filings with a section and an item that no schema declares, and some texts that cannot be parsed."""
    f = fx.filings_json(spark, d)
    body = F.expr("substring(financials, 2)")
    more = F.concat(F.lit('{"comprehensive_income":{"other_income":{"value":'), (F.col("fiscal_year") * 2).cast("string"), F.lit(',"unit":"EUR"},"note":{"unit":"none"}},'), body)
    return f.withColumn("financials", F.when(F.col("ticker") == "Brand#13", F.lit("{broken")).otherwise(more))


ITEM_ROWS = " UNION ALL ".join(
    [f"SELECT ticker, fiscal_year, fiscal_period, '{sec}' AS section, '{i}' AS item, {i} AS value, 'USD' AS unit FROM statements WHERE ticker <> 'Brand#13'"
     for sec, items in fx.SECTIONS.items() for i in items]
    + ["SELECT ticker, fiscal_year, fiscal_period, 'comprehensive_income', 'other_income', fiscal_year * 2, 'EUR' FROM statements WHERE ticker <> 'Brand#13'",
       "SELECT ticker, fiscal_year, fiscal_period, 'comprehensive_income', 'note', NULL, 'none' FROM statements WHERE ticker <> 'Brand#13'"])


@query("src_filings_items", sql(ST, ITEM_ROWS, "value", 4))
def src_filings_items(spark, d):
    """Every item of every filing, declared or not."""
    return out(fil.filing_items(undeclared(spark, d)).select("ticker", "fiscal_year", "fiscal_period", "section", "item", "value", "unit"), 4)


@query("src_filings_flat", sql(ST, f"SELECT ticker, fiscal_year, fiscal_period, CAST(fiscal_year * 2 AS DOUBLE) AS other_income, CAST(NULL AS DOUBLE) AS note, {', '.join(fx.ITEMS)} FROM statements WHERE ticker <> 'Brand#13'",
                               ALL_ITEMS + " other_income", 4))
def src_filings_flat(spark, d):
    """The flat form with a column for every item that occurs."""
    return out(_short(fil.flat_items(fil.filing_items(undeclared(spark, d)), ["ticker", "fiscal_year", "fiscal_period"])), 4)


@query("join_flat_items", sql(ST, "SELECT ticker, cik, company_name, fiscal_year, fiscal_period, end_date, revenues, net_income_loss, assets FROM statements",
                              "revenues net_income_loss assets", 4))
def join_flat_items(spark, d):
    """Header and flattened items come from the same row: no join."""
    df = statements(spark, d)
    return out(_short(df, "ticker", "cik", "company_name", "fiscal_year", "fiscal_period", "end_date",
                      "income_statement.revenues.value", "income_statement.net_income_loss.value",
                      "balance_sheet.assets.value"), 4)


@query("src_filings_range", sql(ST, "SELECT ticker, fiscal_year, fiscal_period, filing_date FROM statements WHERE filing_date BETWEEN DATE '1997-05-01' AND DATE '1999-05-15'"))
def src_filings_range(spark, d):
    return fil.filed_between(fx.statements(spark, d), "1997-05-01", "1999-05-15").select(
        "ticker", "fiscal_year", "fiscal_period", "filing_date")


@query("src_fill_zero", sql(FU, "SELECT ticker, fiscal_year, fiscal_period, coalesce(current_ratio, 0) AS current_ratio, coalesce(net_margin, 0) AS net_margin FROM fund",
                            "current_ratio net_margin"))
def src_fill_zero(spark, d):
    f = fund(spark, d).select("ticker", "fiscal_year", "fiscal_period", "current_ratio", "net_margin")
    return out(fil.fill_zero(f, ["current_ratio", "net_margin"]))


@query("src_thresholds", sql([FU, TH], "SELECT * FROM thresholds", " ".join(ref.METRICS)))
def src_thresholds(spark, d):
    """The matrix written as CSV and read back with its declared schema."""
    path = tables.work_folder(spark, "thresholds")
    fx.thresholds(fund(spark, d)).select("code", "name", *ref.METRICS).write.csv(path, header=True)
    return out(ref.read_thresholds(spark, path))


@query("prj_value_columns", sql(ST, f"SELECT ticker, fiscal_year, fiscal_period, {', '.join(fx.ITEMS)} FROM statements", ALL_ITEMS, 4))
def prj_value_columns(spark, d):
    return out(_short(fil.select_value_columns(fx.statements(spark, d))), 4)


@query("flt_period", sql(ST, "SELECT ticker, fiscal_year, fiscal_period, revenues FROM statements WHERE fiscal_period IN ('Q1', 'Q3', 'FY')", "revenues", 4))
def flt_period(spark, d):
    return out(_short(fil.in_periods(fx.statements(spark, d), ["Q1", "Q3", "FY"]),
                      "ticker", "fiscal_year", "fiscal_period", "income_statement.revenues.value"), 4)


@query("prj_line_items", sql(FU, "SELECT ticker, fiscal_year, fiscal_period, revenue, ebitda, debt_ratio FROM fund", "revenue ebitda debt_ratio", 4))
def prj_line_items(spark, d):
    """One of the requested items does not exist and is left out."""
    return out(fil.line_items(fund(spark, d), ["revenue", "ebitda", "no_such_item", "debt_ratio"],
                              ("ticker", "fiscal_year", "fiscal_period")), 4)


@query("prj_sic2", sql(fx.TICKER_DETAILS_CTE, "SELECT ticker, \"asof\", left(sic4, 2) AS sic2 FROM ticker_details"))
def prj_sic2(spark, d):
    return fx.ticker_details(spark, d).select("ticker", "asof", ref.sic2("sic4").alias("sic2"))


@query("prj_sic_choice", sql(ST, "SELECT DISTINCT ticker, CASE sic2 WHEN '73' THEN sic4 ELSE sic2 END AS code FROM statements"))
def prj_sic_choice(spark, d):
    return fx.statements(spark, d).select("ticker", ref.sector_code().alias("code")).distinct()


@query("fund_ratios", sql(FU, "SELECT * FROM fund", " ".join(fund_ops.RATIO_COLUMNS), 4))
def fund_ratios(spark, d):
    return out(fund(spark, d), 4)


@query("agg_statement_pivot", sql(ST, """
SELECT ticker, fiscal_year, max(revenues) FILTER (fiscal_period = 'Q1') AS Q1_revenues, max(revenues) FILTER (fiscal_period = 'Q2') AS Q2_revenues,
       max(revenues) FILTER (fiscal_period = 'Q3') AS Q3_revenues, max(revenues) FILTER (fiscal_period = 'FY') AS FY_revenues
FROM statements GROUP BY ALL""", "Q1_revenues Q2_revenues Q3_revenues FY_revenues", 4))
def agg_statement_pivot(spark, d):
    m = "income_statement.revenues.value"
    p = fund_ops.statement_pivot(fx.statements(spark, d), [m])
    return out(p.select("ticker", "fiscal_year", *[F.col(f"`{q}_{m}`").alias(f"{q}_revenues") for q in ("Q1", "Q2", "Q3", "FY")]), 4)


@query("agg_q4_reconstruct", sql(FU, f"SELECT ticker, company_name, fiscal_year, fiscal_period, filing_date, market_cap, {', '.join(fx.ITEMS)} FROM full_statements",
                                 "market_cap " + ALL_ITEMS, 4))
def agg_q4_reconstruct(spark, d):
    df = fund_ops.reconstruct_q4(fx.statements(spark, d))
    return out(_short(df.select("ticker", "company_name", "fiscal_year", "fiscal_period", "filing_date", "market_cap",
                                *[F.col(f"`{c}`") for c in fil.value_columns(df)])), 4)


@query("set_subset_check", sql(ST, """
SELECT ticker, fiscal_year, len(list_filter(['Q1', 'Q2', 'Q3', 'FY'], lambda p: NOT list_contains(have, p))) = 0 AS complete,
       array_to_string(list_sort(list_filter(['Q1', 'Q2', 'Q3', 'FY'], lambda p: NOT list_contains(have, p))), ',') AS missing
FROM (SELECT ticker, fiscal_year, list(fiscal_period) AS have FROM statements GROUP BY ALL) h"""))
def set_subset_check(spark, d):
    return fund_ops.missing_periods(fx.statements(spark, d))


# ------------------------------------------------------------------ newest periods
def latest_sql(period: str, n: int | None = None) -> str:
    if period == "Annual":
        return f"""latest AS (SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY ticker ORDER BY end_date DESC, filing_date DESC) AS INTEGER) AS rn
  FROM fund WHERE fiscal_period = 'FY') x WHERE rn <= {n or 10})"""
    return """latest AS (SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY ticker ORDER BY filing_date DESC, end_date DESC) AS INTEGER) AS rn
  FROM fund WHERE fiscal_period <> 'FY') x WHERE rn <= 4)"""


@query("win_latest_periods", sql([FU, latest_sql("Quarterly")], "SELECT ticker, fiscal_year, fiscal_period, rn, revenue, earnings_per_share FROM latest", "revenue earnings_per_share", 4))
def win_latest_periods(spark, d):
    return out(fund_ops.latest_periods(fund(spark, d), "Quarterly").select(
        "ticker", "fiscal_year", "fiscal_period", "rn", "revenue", "earnings_per_share"), 4)


@query("topk_per_ticker", sql([FU, latest_sql("Annual", 2)], "SELECT ticker, fiscal_year, rn, book_value FROM latest", "book_value", 4))
def topk_per_ticker(spark, d):
    return out(fund_ops.latest_periods(fund(spark, d), "Annual", 2).select("ticker", "fiscal_year", "rn", "book_value"), 4)


@query("win_growth", sql([FU, latest_sql("Annual")], """
SELECT a.ticker, a.fiscal_year, a.fiscal_period, a.rn, (a.revenue - b.revenue) / nullif(abs(b.revenue), 0) AS revenue_growth,
       (a.earnings_per_share - b.earnings_per_share) / nullif(abs(b.earnings_per_share), 0) AS earnings_per_share_growth
FROM latest a LEFT JOIN latest b ON a.ticker = b.ticker AND b.rn = a.rn + 1""", "revenue_growth earnings_per_share_growth"))
def win_growth(spark, d):
    return out(fund_ops.period_growth(fund(spark, d), ["revenue", "earnings_per_share"]))


# ------------------------------------------------------------------ joins
T_COLS = ", ".join(f"coalesce(t.{m}, d.{m}) AS t_{m}" for m in ref.METRICS)


@query("join_threshold_lookup", sql([FU, TH], f"""
SELECT s.ticker, s.code, {T_COLS} FROM (SELECT DISTINCT ticker, CASE WHEN sic2 = '73' THEN sic4 ELSE sic2 END AS code FROM fund) s
LEFT JOIN thresholds t ON t.code = s.code JOIN thresholds d ON d.code = CASE WHEN length(s.code) = 4 THEN '7399' ELSE '99' END""",
                                    " ".join(f"t_{m}" for m in ref.METRICS)))
def join_threshold_lookup(spark, d):
    f = fund(spark, d)
    keys = f.select("ticker", "sic2", "sic4").distinct().withColumn("code", ref.sector_code())
    return out(fund_ops.attach_thresholds(keys, fx.thresholds(f)).select("ticker", "code", *[f"t_{m}" for m in ref.METRICS]))


GAPPY = "CASE WHEN ascii(right(ticker, 1)) % 3 = 0 THEN NULL ELSE sic2 END AS sic2, CASE WHEN ascii(right(ticker, 1)) % 3 < 2 THEN NULL ELSE sic4 END AS sic4"


@query("join_threshold_gaps", sql([FU, TH], f"""
SELECT s.ticker, s.code, {T_COLS} FROM (SELECT *, CASE WHEN sic2 = '73' THEN sic4 ELSE sic2 END AS code FROM (SELECT DISTINCT ticker, {GAPPY} FROM fund) g) s
LEFT JOIN thresholds t ON t.code = s.code JOIN thresholds d ON d.code = CASE WHEN sic2 = '73' THEN '7399' ELSE '99' END""",
                                  " ".join(f"t_{m}" for m in ref.METRICS)))
def join_threshold_gaps(spark, d):
    """Some tickers have no sector code: they get the default row."""
    f = fund(spark, d)
    keys = f.selectExpr("ticker", GAPPY.split(", CASE")[0], "CASE" + GAPPY.split(", CASE")[1]).distinct().withColumn("code", ref.sector_code())
    return out(fund_ops.attach_thresholds(keys, fx.thresholds(f)).select("ticker", "code", *[f"t_{m}" for m in ref.METRICS]))


@query("join_asof_market_cap", sql([ST, fx.TICKER_DETAILS_CTE], """
SELECT s.ticker, s.fiscal_year, s.fiscal_period, s.end_date, t."asof", t.market_cap, t.sic4
FROM (SELECT ticker, fiscal_year, fiscal_period, end_date FROM statements) s
ASOF LEFT JOIN ticker_details t ON t.ticker = s.ticker AND s.end_date >= t."asof" """, "market_cap", 2))
def join_asof_market_cap(spark, d):
    asks = fx.statements(spark, d).select("ticker", "fiscal_year", "fiscal_period", "end_date")
    return out(joins.asof(asks, fx.ticker_details(spark, d), ["asof", "market_cap", "sic4"],
                          left_time="end_date", right_time="asof"), 2)


# ------------------------------------------------------------------ insiders, headlines
@query("agg_insider_ratio", sql(fx.INSIDER_CTE, """
SELECT *, CASE WHEN buy_ratio > 0.7 THEN 8 WHEN buy_ratio > 0.4 THEN 6 WHEN buy_ratio IS NOT NULL THEN 4 ELSE 5 END AS score,
  CASE WHEN wr > 0.7 THEN 2 WHEN wr > 0.4 THEN 1 WHEN wr < 0.1 AND word_sells > 5 THEN -1 ELSE 0 END AS points
FROM (SELECT ticker, count(*) FILTER (transaction_shares > 0) AS buys, count(*) FILTER (transaction_shares < 0) AS sells,
        count(*) FILTER (transaction_type = 'Buy') AS word_buys, count(*) FILTER (transaction_type = 'Sell') AS word_sells,
        count(*) FILTER (transaction_shares > 0) / nullif(count(transaction_shares), 0) AS buy_ratio,
        count(*) FILTER (transaction_type = 'Buy') / nullif(count(transaction_type), 0) AS wr
      FROM insider_trades GROUP BY ticker) x""".replace("SELECT *,", "SELECT ticker, buys, sells, word_buys, word_sells, buy_ratio,", 1), "buy_ratio"))
def agg_insider_ratio(spark, d):
    return out(agg.insider_scores(fx.insider_trades(spark, d)))


WORDS = ["secret", "the the", "mention", "license"]


@query("agg_news_keyword", """
SELECT ticker, headlines, negative, CASE WHEN negative > 0.3 * headlines THEN 3 WHEN negative > 0 THEN 6 ELSE 8 END AS score
FROM (SELECT source AS ticker, count(*) AS headlines, count(*) FILTER (regexp_matches(lower(text), 'secret|the the|mention|license')) AS negative
      FROM documents GROUP BY source) x""")
def agg_news_keyword(spark, d):
    docs = fx.table(spark, d, "documents").select(F.col("source").alias("ticker"), F.col("text").alias("title"))
    return news_src.headline_scores(docs, WORDS)


# ------------------------------------------------------------------ snapshot in SQL
def snap_cte(period: str = "Annual") -> str:
    lists = ", ".join(f"list({c} ORDER BY rn) AS {c}" for c in fund_ops.RATIO_COLUMNS)
    tcols = ", ".join(f"coalesce(t.{m}, d.{m}) AS t_{m}" for m in ref.METRICS)
    return latest_sql(period) + f""",
lists AS (SELECT ticker, arg_min(company_name, rn) AS company_name, arg_min(sic2, rn) AS sic2, arg_min(sic4, rn) AS sic4,
  count(*) AS n, {lists} FROM latest GROUP BY ticker),
snap AS MATERIALIZED (SELECT s.*, {tcols}, 5 AS insider_score, 2 AS insider_points, 5 AS sentiment_score FROM lists s
  LEFT JOIN thresholds t ON t.code = CASE WHEN s.sic2 = '73' THEN s.sic4 ELSE s.sic2 END
  JOIN thresholds d ON d.code = CASE WHEN s.sic2 = '73' THEN '7399' ELSE '99' END)"""


SNAP = [FU, TH, snap_cte()]


def snap_values(key: str, select: str, doubles: str, digits: int, fn):
    """A query of one-row-per-ticker expressions over the annual snapshot."""
    def run(spark, d):
        s = snaps.Snap()
        return out(snapshot(spark, d).select("ticker", *[c.alias(n) for n, c in fn(s).items()]), digits)
    query(key, sql(SNAP, select, doubles, digits))(run)


def sum_pv(flow: str, g: str, r: str, n: int) -> str:
    return "(" + " + ".join(f"({flow}) * pow(1 + ({g}), {k}) / pow(1 + ({r}), {k})" for k in range(1, n + 1)) + ")"


FCF, NI, CAP = "free_cash_flow[1]", "net_income[1]", "market_cap[1]"
G_EPS = "coalesce((earnings_per_share[1] - earnings_per_share[2]) / nullif(abs(earnings_per_share[2]), 0), 0)"
G_BOOK = "coalesce((book_value[1] - book_value[2]) / nullif(abs(book_value[2]), 0), 0)"
OE = "(net_income[1] + depreciation_and_amortization[1] - capital_expenditure[1] - coalesce(working_capital[1] - working_capital[2], 0))"


def dcf_sql(f, g, r, tg, n=5):
    return f"CASE WHEN {f} > 0 THEN {sum_pv(f, g, r, n)} + ({f}) * pow(1 + ({g}), {n}) * (1 + {tg}) / ({r} - {tg}) / pow(1 + {r}, {n}) ELSE 0 END"


def multiple_sql(f, g, r, m, n):
    return f"({sum_pv(f, str(g), str(r), n)} + ({f}) * pow(1 + {g}, {n}) * {m} / pow(1 + {r}, {n}))"


OWNER_SQL = f"""CASE WHEN {OE} > 0 THEN ({sum_pv(OE, G_EPS, '0.15', 5)}
  + {OE} * pow(1 + {G_EPS}, 5) * (1 + least({G_EPS}, 0.03)) / (0.15 - least({G_EPS}, 0.03)) / pow(1.15, 5)) * 0.75 ELSE 0 END"""
# median of two multiples is their mean; one period stands for itself
EVM = "(enterprise_value[1] / nullif(ebitda[1], 0) + coalesce(enterprise_value[2] / nullif(ebitda[2], 0), enterprise_value[1] / nullif(ebitda[1], 0))) / 2"
EV_SQL = f"""CASE WHEN coalesce(enterprise_value[1], 0) = 0 OR coalesce(ebitda[1], 0) = 0 THEN 0
  ELSE greatest({EVM} * ebitda[1] - (enterprise_value[1] - market_cap[1]), 0) END"""
BK = "(market_cap[1] / nullif(price_to_book_ratio[1], 0))"
RI = f"(net_income[1] - 0.10 * {BK})"
RIM_SQL = f"""CASE WHEN market_cap[1] <> 0 AND net_income[1] <> 0 AND price_to_book_ratio[1] > 0 AND {RI} > 0
  THEN ({BK} + {sum_pv(RI, G_BOOK, '0.10', 5)} + {RI} * pow(1 + {G_BOOK}, 6) / (0.10 - 0.03) / pow(1.10, 5)) * 0.8 ELSE 0 END"""
OES = "(net_income[1] + depreciation_and_amortization[1] - 0.75 * capital_expenditure[1])"

snap_values("val_dcf", f"SELECT ticker, {dcf_sql(FCF, G_EPS, '0.10', '0.03')} AS dcf FROM snap", "dcf", 1,
            lambda s: {"dcf": v.dcf(s.x("free_cash_flow"), F.coalesce(v.eps_growth(s.x("earnings_per_share"), s.x("earnings_per_share", 1)), F.lit(0.0)), 0.10, 0.03)})
snap_values("val_dcf_multiple", f"""SELECT ticker, {multiple_sql(FCF, .06, .10, 15, 5)} AS moderate, {multiple_sql(FCF, .20, .15, 25, 5)} AS fast,
  {multiple_sql(FCF, .05, .09, 12, 10)} AS patient FROM snap""", "moderate fast patient", 1,
            lambda s: {"moderate": v.dcf_multiple(s.x("free_cash_flow"), .06, .10, 15., 5),
                       "fast": v.dcf_multiple(s.x("free_cash_flow"), .20, .15, 25., 5),
                       "patient": v.dcf_multiple(s.x("free_cash_flow"), .05, .09, 12., 10)})
snap_values("val_owner_earnings", f"SELECT ticker, {OWNER_SQL} AS owner_value FROM snap", "owner_value", 1,
            lambda s: {"owner_value": v.owner_earnings(
                s.x("net_income"), s.x("depreciation_and_amortization"), s.x("capital_expenditure"),
                F.coalesce(s.x("working_capital") - s.x("working_capital", 1), F.lit(0.0)),
                F.coalesce(v.eps_growth(s.x("earnings_per_share"), s.x("earnings_per_share", 1)), F.lit(0.0)))})
snap_values("val_owner_earnings_simple", f"""SELECT ticker, CASE WHEN net_income[1] = 0 AND depreciation_and_amortization[1] = 0 AND capital_expenditure[1] = 0
  THEN NULL ELSE {OES} END AS owner_earnings FROM snap""", "owner_earnings", 3,
            lambda s: {"owner_earnings": v.owner_earnings_simple(s.x("net_income"), s.x("depreciation_and_amortization"), s.x("capital_expenditure"))})
snap_values("val_ev_ebitda", """SELECT ticker, CASE WHEN coalesce(enterprise_value[1], 0) = 0 OR coalesce(ebitda[1], 0) = 0 THEN 0
  ELSE greatest(list_median(m) * ebitda[1] - (enterprise_value[1] - market_cap[1]), 0) END AS equity_value
  FROM (SELECT *, list_transform(list_zip(enterprise_value, ebitda), lambda z: z[1] / nullif(z[2], 0)) AS m FROM snap) x""".replace("list_median(m)", "list_aggregate(m, 'median')"),
            "equity_value", 1,
            lambda s: {"equity_value": v.ev_ebitda_value(s.all("enterprise_value"), s.all("ebitda"), s.x("market_cap"))})
snap_values("val_residual_income", f"SELECT ticker, {RIM_SQL} AS residual_value FROM snap", "residual_value", 1,
            lambda s: {"residual_value": v.residual_income(s.x("market_cap"), s.x("net_income"), s.x("price_to_book_ratio"),
                                                           F.coalesce(v.growth(s.x("book_value"), s.x("book_value", 1)), F.lit(0.0)))})
snap_values("val_graham_number", """SELECT ticker, gn AS graham_number, (gn - price) / nullif(price, 0) AS margin FROM (
  SELECT ticker, CASE WHEN earnings_per_share[1] > 0 AND book_value_per_share[1] > 0 THEN sqrt(22.5 * earnings_per_share[1] * book_value_per_share[1]) END AS gn,
         market_cap[1] / nullif(outstanding_shares[1], 0) AS price FROM snap) x""", "graham_number margin", 4,
            lambda s: {"graham_number": v.graham_number(s.x("earnings_per_share"), s.x("book_value_per_share")),
                       "margin": v.margin_of_safety(v.graham_number(s.x("earnings_per_share"), s.x("book_value_per_share")),
                                                    s.x("market_cap") / s.x("outstanding_shares"))})
snap_values("val_ncav", """SELECT ticker, current_assets[1] - total_liabilities[1] AS ncav, (current_assets[1] - total_liabilities[1]) / nullif(market_cap[1], 0) AS to_market_cap FROM snap""",
            "ncav to_market_cap", 4,
            lambda s: {"ncav": v.net_current_assets(s.x("current_assets"), s.x("total_liabilities")),
                       "to_market_cap": v.safe_div(v.net_current_assets(s.x("current_assets"), s.x("total_liabilities")), s.x("market_cap"))})
snap_values("val_fcf_yield", """SELECT ticker, f AS normal_fcf, f / nullif(market_cap[1], 0) AS fcf_yield, f * 10 AS low_value, f * 15 AS fair_value, f * 20 AS high_value
  FROM (SELECT *, list_avg(free_cash_flow[1:5]) AS f FROM snap) x""", "normal_fcf fcf_yield low_value fair_value high_value", 3,
            lambda s: {"normal_fcf": v.fcf_average(s.all("free_cash_flow")),
                       "fcf_yield": v.safe_div(v.fcf_average(s.all("free_cash_flow")), s.x("market_cap")),
                       **{n: v.fcf_average(s.all("free_cash_flow")) * k for n, k in (("low_value", 10.0), ("fair_value", 15.0), ("high_value", 20.0))}})
snap_values("val_peg", """SELECT ticker, pe, CASE WHEN g > 0 THEN pe / (g * 100) END AS peg FROM (
  SELECT ticker, market_cap[1] / nullif(net_income[1], 0) AS pe, (earnings_per_share[1] - earnings_per_share[2]) / nullif(earnings_per_share[2], 0) AS g FROM snap) x""", "pe peg", 4,
            lambda s: {"pe": v.safe_div(s.x("market_cap"), s.x("net_income")),
                       "peg": v.peg(v.safe_div(s.x("market_cap"), s.x("net_income")), s.x("earnings_per_share"), s.x("earnings_per_share", 1))})
snap_values("val_price_ratios", """SELECT ticker, market_cap[1] / nullif(net_income[1], 0) AS pe_ratio, price_to_book_ratio[1] AS pb_ratio, market_cap[1] / nullif(revenue[1], 0) AS ps_ratio FROM snap""",
            "pe_ratio pb_ratio ps_ratio", 4, lambda s: scorers.fundamentals.price_ratios(s))

GAP = f"""vals AS (SELECT ticker, market_cap[1] AS cap, {dcf_sql(FCF, G_EPS, '0.10', '0.03')} AS dcf, {OWNER_SQL} AS owner_earnings,
  {EV_SQL} AS ev_ebitda, {RIM_SQL} AS residual_income FROM snap),
gaps AS (SELECT ticker, dcf, owner_earnings, ev_ebitda, residual_income,
  sum(w * (val - cap) / nullif(cap, 0)) / nullif(sum(w), 0) AS gap FROM (
    SELECT v.*, m.w, CASE m.name WHEN 'dcf' THEN dcf WHEN 'oe' THEN owner_earnings WHEN 'ev' THEN ev_ebitda ELSE residual_income END AS val
    FROM vals v, (VALUES ('dcf', 0.35), ('oe', 0.35), ('ev', 0.20), ('ri', 0.10)) m(name, w)) x
  WHERE val > 0 GROUP BY ALL),
valuation AS (SELECT v.ticker, v.dcf, v.owner_earnings, v.ev_ebitda, v.residual_income, g.gap,
  CASE WHEN gap > 0.15 THEN 'bullish' WHEN gap < -0.15 THEN 'bearish' WHEN gap IS NOT NULL THEN 'neutral' END AS signal,
  round_even(least(abs(gap) / 0.30 * 100, 100), 0) AS confidence
  FROM vals v LEFT JOIN gaps g ON v.ticker = g.ticker)"""


@query("val_weighted_gap", sql([*SNAP, GAP], "SELECT ticker, gap, signal, confidence FROM valuation", "gap confidence", 4))
def val_weighted_gap(spark, d):
    return out(scorers.score(snapshot(spark, d), "valuation").select("ticker", "gap", "signal", "confidence"), 4)


# ------------------------------------------------------------------ scorers
def cnt(item: str, cond: str) -> str:
    return f"len(list_filter({item}, lambda x: x {cond}))"


def case(*branches: str) -> str:
    """case('cond -> points', ...) else 0"""
    return "(CASE " + " ".join("WHEN {} THEN {}".format(*b.split(" -> ")) for b in branches) + " ELSE 0 END)"


def maj(item: str, cond: str) -> str:
    return f"{cnt(item, cond)} >= n // 2 + 1"


def grow_sql(item: str) -> str:
    return f"(({item}[1] - {item}[2]) / nullif(abs({item}[2]), 0))"


def pair_list(item: str, expr: str) -> str:
    """expr over a = newer and b = older value of neighbouring periods."""
    e = expr.replace("$a", f"{item}[i]").replace("$b", f"{item}[i + 1]")
    return f"list_transform(range(1, n), lambda i: {e})"


SHARE_SIGNAL = "CASE WHEN score >= 0.7 * max_score THEN 'bullish' WHEN score <= 0.3 * max_score THEN 'bearish' ELSE 'neutral' END AS signal"
TEN_SIGNAL = "CASE WHEN score >= 7.5 THEN 'bullish' WHEN score <= 4.5 THEN 'bearish' ELSE 'neutral' END AS signal"
SCORER_SQL: dict[str, tuple[str, list[str], list[str]]] = {}


def scorer_sql(key, parts: dict[str, str], total: str | None, max_score: float | None, signal: str,
               values: dict[str, str] | None = None, pre: str = "snap"):
    cols = ", ".join(f"CAST({e} AS DOUBLE) AS {n}" for n, e in {**parts, **(values or {})}.items())
    text = f"SELECT ticker, {cols} FROM {pre}"
    text = f"SELECT *, {total} AS score, CAST({max_score} AS DOUBLE) AS max_score FROM ({text}) p"
    SCORER_SQL[key] = (f"SELECT *, {signal} FROM ({text}) q", list(parts), list(values or {}))


PRICE = "(market_cap[1] / nullif(outstanding_shares[1], 0))"
GN = "(CASE WHEN earnings_per_share[1] > 0 AND book_value_per_share[1] > 0 THEN sqrt(22.5 * earnings_per_share[1] * book_value_per_share[1]) END)"
GM = f"(CASE WHEN outstanding_shares[1] > 0 AND {PRICE} > 0 THEN ({GN} - {PRICE}) / {PRICE} END)"
NCAV = "(current_assets[1] - total_liabilities[1])"
scorer_sql("graham", {
    "earnings": f"CASE WHEN n >= 2 THEN {case(cnt('earnings_per_share', '> 0') + ' = n -> 3', cnt('earnings_per_share', '> 0') + ' >= 0.8 * n -> 2')} + {case('earnings_per_share[1] > earnings_per_share[2] -> 1')} ELSE 0 END",
    "strength": case("current_ratio[1] > 0 AND current_ratio[1] >= t_current_ratio * 1.333 -> 2", "current_ratio[1] > 0 AND current_ratio[1] >= t_current_ratio -> 1")
    + " + " + case("debt_ratio[1] > 0 AND debt_ratio[1] < 0.5 -> 2", "debt_ratio[1] > 0 AND debt_ratio[1] < 0.8 -> 1")
    + " + " + case("dividends_and_other_cash_distributions[1] < 0 -> 1"),
    "valuation": f"CASE WHEN market_cap[1] > 0 THEN {case(f'{NCAV} > 0 AND outstanding_shares[1] > 0 AND {NCAV} > market_cap[1] -> 4', f'{NCAV} > 0 AND outstanding_shares[1] > 0 AND {NCAV} / outstanding_shares[1] >= 0.67 * {PRICE} -> 2')} + {case(f'{GM} > 0.5 -> 3', f'{GM} > 0.2 -> 1')} ELSE 0 END",
}, "earnings + strength + valuation", 15, SHARE_SIGNAL, {"graham_number": GN, "margin_of_safety": GM})

ACK = f"(CASE WHEN free_cash_flow[1] <> 0 THEN {multiple_sql(FCF, .06, .10, 15, 5)} END)"
MOS = "(({v}) - market_cap[1]) / nullif(market_cap[1], 0)"
ACK_M = MOS.format(v=ACK)
scorer_sql("ackman", {
    "quality": case(f"revenue[1] <> 0 AND revenue[2] <> 0 AND revenue[1] > revenue[2] AND {grow_sql('revenue')} > t_revenue_growth_qoq * 1.4 -> 2",
                    "revenue[1] <> 0 AND revenue[2] <> 0 AND revenue[1] > revenue[2] -> 1")
    + " + " + case(maj("operating_margin", "> t_operating_margin * 1.5") + " -> 2") + " + " + case(maj("free_cash_flow", "> 0") + " -> 1")
    + " + " + case("return_on_equity[1] > t_return_on_equity * 1.5 -> 2") + " + " + case("list_sum(intangible_assets) > 0 -> 1"),
    "discipline": case(f"{cnt('debt_to_equity', '<> 0')} > 0 AND {maj('debt_to_equity', '< 2 * t_debt_to_equity')} -> 2")
    + " + " + case(maj("dividends_and_other_cash_distributions", "< 0") + " -> 1") + " + " + case("outstanding_shares[2] < outstanding_shares[1] -> 1"),
    "activism": f"CASE WHEN n >= 2 THEN {case(grow_sql('revenue') + ' > 0.15 AND list_avg(operating_margin) < t_operating_margin -> 2')} ELSE 0 END",
    "valuation": case(f"{ACK_M} > 0.3 -> 3", f"{ACK_M} > 0.1 -> 1"),
}, "quality + discipline + activism + valuation", 20, SHARE_SIGNAL, {"intrinsic_value": ACK, "margin_of_safety": ACK_M})

WOOD = f"(CASE WHEN free_cash_flow[1] > 0 THEN {multiple_sql(FCF, .20, .15, 25, 5)} END)"
WOOD_M = MOS.format(v=WOOD)
RATES = "list_filter(" + pair_list("{i}", "CASE WHEN $a <> 0 AND $b <> 0 THEN ($b - $a) / abs($a) END") + ", lambda x: x IS NOT NULL)"
SNAP_W = f"(SELECT *, {RATES.replace('{i}', 'revenue')} AS g, {RATES.replace('{i}', 'net_income')} AS gi FROM snap) s"
RDI = "research_and_development[{i}] / nullif(revenue[{i}], 0)"
PAYOUT = "(CASE WHEN free_cash_flow[1] = 0 THEN 1 ELSE dividends_and_other_cash_distributions[1] / nullif(free_cash_flow[1], 0) END)"
scorer_sql("wood", {
    "disruptive": "(" + case("n >= 3 AND g[1] > g[2] -> 2")
    + " + " + case("n >= 3 AND coalesce(g[1], 0) > 2 * t_revenue_growth_qoq -> 3", "n >= 3 AND coalesce(g[1], 0) > t_revenue_growth_qoq -> 2",
                   "n >= 3 AND coalesce(g[1], 0) > t_revenue_growth_qoq - t_revenue_growth_qoq * 0.6 -> 1")
    + " + " + case("n >= 2 AND gross_margin[1] - gross_margin[2] > 0.05 -> 2", "n >= 2 AND gross_margin[1] > gross_margin[2] -> 1")
    + " + " + case("n >= 2 AND gross_margin[1] > t_gross_margin -> 2")
    + " + " + case(f"n >= 2 AND {grow_sql('revenue')} > {grow_sql('operating_expense')} -> 2")
    + " + " + case(*[f"{RDI.format(i=1)} > {lim} -> {p}" for lim, p in ((0.13, 3), (0.08, 2), (0.04, 1))]) + ") / CAST(12 AS DOUBLE) * 5",
    "innovation": "(" + case("n >= 2 AND coalesce(" + grow_sql("research_and_development") + ", 0) > 0.5 -> 3", "n >= 2 AND coalesce(" + grow_sql("research_and_development") + ", 0) > 0.2 -> 2")
    + " + " + case(f"n >= 2 AND {RDI.format(i=1)} > {RDI.format(i=2)} -> 2")
    + " + " + case(f"n >= 2 AND {grow_sql('free_cash_flow')} > 0.3 AND {cnt('free_cash_flow', '> 0')} = n -> 3",
                   f"n >= 2 AND {cnt('free_cash_flow', '> 0')} >= 0.75 * n -> 2", f"n >= 2 AND {cnt('free_cash_flow', '> 0')} > 0.5 * n -> 1")
    + " + " + case("n >= 2 AND operating_margin[1] > t_operating_margin * 1.5 AND operating_margin[1] > operating_margin[2] -> 3".replace("t_operating_margin * 1.5", "t_operating_margin * 0.5 + t_operating_margin"),
                   "n >= 2 AND operating_margin[1] > t_operating_margin -> 2", "n >= 2 AND operating_margin[1] - operating_margin[2] > 0 -> 1")
    + " + " + case("n >= 2 AND abs(capital_expenditure[1]) / nullif(revenue[1], 0) > 0.10 AND coalesce((abs(capital_expenditure[1]) - abs(capital_expenditure[2])) / nullif(abs(capital_expenditure[2]), 0), 0) > 0.2 -> 2",
                   "n >= 2 AND abs(capital_expenditure[1]) / nullif(revenue[1], 0) > 0.05 -> 1")
    + " + " + case(f"{PAYOUT} < 0.2 -> 2", f"{PAYOUT} < 0.4 -> 1") + ") / CAST(15 AS DOUBLE) * 5",
    "valuation": case(f"{WOOD_M} > 0.5 -> 3", f"{WOOD_M} > 0.2 -> 1"),
}, "disruptive + innovation + valuation", 15, SHARE_SIGNAL, {"intrinsic_value": WOOD, "margin_of_safety": WOOD_M}, SNAP_W)

SNAP_M = f"""(SELECT *, list_avg(list_transform(rg, lambda x: abs(x - list_avg(rg)))) AS rg_dev, list_avg(rg) AS rg_avg,
  list_avg(list_transform(operating_margin, lambda x: abs(x - list_avg(operating_margin)))) AS om_dev,
  list_avg(list_filter(conv, lambda x: x IS NOT NULL)) AS conv_avg, list_avg(free_cash_flow[1:5]) AS norm
  FROM (SELECT *, {pair_list('revenue', '$a / nullif($b, 0) - 1')} AS rg,
    list_transform(range(1, n + 1), lambda i: free_cash_flow[i] / nullif(net_income[i], 0)) AS conv,
    list_avg(list_transform(range(1, n + 1), lambda i: abs(capital_expenditure[i]) / nullif(revenue[i], 0))) AS capex,
    len(list_filter({pair_list('gross_margin', '$b >= $a')}, lambda x: x)) AS rising FROM snap) s1) s"""
DE = "debt_to_equity[1] <> 0 AND debt_to_equity[1]"
CASH = "coalesce(cash_and_equivalents[1] / nullif(revenue[1], 0), 0)"
OLD3 = "(CASE WHEN n >= 6 THEN list_avg(free_cash_flow[n - 2 : n]) ELSE free_cash_flow[n] END)"
UP = "(norm * 15 - market_cap[1]) / nullif(market_cap[1], 0)"
scorer_sql("munger", {
    "moat": "least(10, (" + case(cnt("return_on_invested_capital", "> t_return_on_invested_capital") + " >= 0.8 * n -> 3",
                                 cnt("return_on_invested_capital", "> t_return_on_invested_capital") + " >= 0.5 * n -> 2",
                                 cnt("return_on_invested_capital", "> t_return_on_invested_capital") + " > 0 -> 1")
    + " + " + case("n >= 3 AND rising >= 0.7 * n -> 2", "n >= 3 AND list_avg(gross_margin) > t_gross_margin -> 1")
    + " + " + case("n >= 3 AND capex < 0.05 -> 2", "n >= 3 AND capex < 0.10 -> 1")
    + " + " + case("list_sum(research_and_development) > 0 -> 1") + " + 1) * 10 / CAST(9 AS DOUBLE))",
    "management": "greatest(0, least(10, (" + case("conv_avg > 1.1 -> 3", "conv_avg > 0.9 -> 2", "conv_avg > 0.7 -> 1")
    + " + " + case(f"{DE} < t_debt_to_equity - 0.4 * t_debt_to_equity -> 3", f"{DE} < 0.4 * t_debt_to_equity + t_debt_to_equity -> 2", f"{DE} < 3 * t_debt_to_equity -> 1")
    + " + " + case(f"{CASH} BETWEEN 0.1 AND 0.25 -> 2", f"{CASH} BETWEEN 0.05 AND 0.4 -> 1") + " + insider_points"
    + " + " + case("n >= 3 AND outstanding_shares[1] < 0.95 * outstanding_shares[n] -> 2", "n >= 3 AND outstanding_shares[1] < 1.05 * outstanding_shares[n] -> 1",
                   "n >= 3 AND outstanding_shares[1] > 1.2 * outstanding_shares[n] -> -1") + ") * 10 / CAST(12 AS DOUBLE)))",
    "predictability": "CASE WHEN n >= 4 THEN " + case("rg_avg > t_revenue_growth_qoq + 0.5 * abs(t_revenue_growth_qoq) AND rg_dev < 0.1 -> 3", "rg_avg > t_revenue_growth_qoq AND rg_dev < 0.2 -> 2", "rg_avg > t_revenue_growth_qoq -> 1")
    + " + " + case(f"n >= 5 AND {cnt('operating_income', '> 0')} = n -> 3", f"n >= 5 AND {cnt('operating_income', '> 0')} >= 0.8 * n -> 2", f"n >= 5 AND {cnt('operating_income', '> 0')} >= 0.6 * n -> 1")
    + " + " + case("om_dev < 0.03 -> 2", "om_dev < 0.07 -> 1")
    + " + " + case(cnt("free_cash_flow", "> 0") + " = n -> 2", cnt("free_cash_flow", "> 0") + " >= 0.8 * n -> 1") + " ELSE 0 END",
    "valuation": "CASE WHEN n >= 3 AND norm <> 0 THEN " + case(*[f"norm / nullif(market_cap[1], 0) > {lim} -> {p}" for lim, p in ((0.08, 4), (0.05, 3), (0.03, 1))])
    + " + " + case(f"{UP} > 0.3 -> 3", f"{UP} > 0.1 -> 2", f"{UP} > -0.1 -> 1")
    + " + " + case(f"list_avg(free_cash_flow[1:3]) > 1.2 * {OLD3} -> 3", f"list_avg(free_cash_flow[1:3]) > {OLD3} -> 2") + " ELSE 0 END",
}, "moat * 0.35 + management * 0.25 + predictability * 0.25 + valuation * 0.15", 10, TEN_SIGNAL,
    {"normalized_fcf": "norm", "fcf_yield": "norm / nullif(market_cap[1], 0)", "conservative_value": "norm * 10",
     "reasonable_value": "norm * 15", "optimistic_value": "norm * 20"}, SNAP_M)

REV_G = f"CASE WHEN revenue[2] > 0 THEN {grow_sql('revenue')} END"
EPS_G = f"CASE WHEN abs(earnings_per_share[2]) > 1e-9 THEN {grow_sql('earnings_per_share')} END"
SNAP_G = f"(SELECT *, {REV_G} AS rev_g, {EPS_G} AS eps_g, market_cap[1] / nullif(net_income[1], 0) AS pe, market_cap[1] / nullif(free_cash_flow[1], 0) AS pf FROM snap) s"


def growth_sql(strong: float, mid: float, low: float) -> str:
    one = lambda x, t: case(f"{x} > {strong} * {t} -> 3", f"{x} > {mid} * {t} -> 2", f"{x} > {low} * {t} -> 1")
    return f"{one('rev_g', 't_revenue_growth_qoq')} + {one('eps_g', 't_eps_growth_qoq')}"


PEG = "(CASE WHEN (earnings_per_share[1] - earnings_per_share[2]) / nullif(earnings_per_share[2], 0) > 0 THEN pe / ((earnings_per_share[1] - earnings_per_share[2]) / nullif(earnings_per_share[2], 0) * 100) END)"
LDE = "total_debt[1] / (CASE WHEN shareholders_equity[1] = 0 THEN 1e-9 ELSE shareholders_equity[1] END)"
scorer_sql("lynch", {
    "growth": f"CASE WHEN n >= 2 THEN least(10, ({growth_sql(2.25, 1, 0.2)}) / CAST(6 AS DOUBLE) * 10) ELSE 0 END",
    "fundamentals": "least(10, (" + case(f"{LDE} < t_debt_to_equity -> 2", f"{LDE} < 2 * t_debt_to_equity -> 1")
    + " + " + case("operating_margin[1] > 2 * t_operating_margin -> 2", "operating_margin[1] > t_operating_margin -> 1")
    + " + " + case("free_cash_flow[1] > 0 -> 2") + ") / CAST(6 AS DOUBLE) * 10)",
    "valuation": "least(10, (" + case("pe < 0.6 * t_price_to_earning_ratio -> 2", "pe < t_price_to_earning_ratio -> 1")
    + " + " + case(f"{PEG} < 1 -> 3", f"{PEG} < 2 -> 2", f"{PEG} < 3 -> 1") + ") / CAST(5 AS DOUBLE) * 10)",
    "sentiment": "sentiment_score", "insider": "insider_score",
}, "growth * 0.30 + valuation * 0.25 + fundamentals * 0.20 + sentiment * 0.15 + insider * 0.10", 10, TEN_SIGNAL,
    {"pe_ratio": "pe", "peg_ratio": PEG}, SNAP_G)

RDR = "research_and_development[1] / (CASE WHEN revenue[1] = 0 THEN 1e-9 ELSE revenue[1] END)"
scorer_sql("fisher", {
    "growth": f"CASE WHEN n >= 2 THEN least(10, ({growth_sql(9, 4, 1)} + {case(f'{RDR} BETWEEN 0.03 AND 0.12 -> 3', f'{RDR} > 0.12 -> 2', f'{RDR} > 0 -> 1')}) / CAST(9 AS DOUBLE) * 10) ELSE 0 END",
    "margins": "CASE WHEN n >= 2 THEN least(10, (" + case("operating_margin[1] >= operating_margin[n] AND operating_margin[n] > 0 -> 2", "operating_margin[1] > 0 -> 1")
    + " + " + case("gross_margin[1] > t_gross_margin -> 2", "gross_margin[1] > 0.6 * t_gross_margin -> 1")
    + " + " + case("n >= 3 AND list_stddev_pop(operating_margin) < 0.02 -> 2", "n >= 3 AND list_stddev_pop(operating_margin) < 0.05 -> 1") + ") / CAST(6 AS DOUBLE) * 10) ELSE 0 END",
    "management": "least(10, (" + case("return_on_equity[1] > 2 * t_return_on_equity -> 3", "return_on_equity[1] > t_return_on_equity -> 2", "return_on_equity[1] > 0 -> 1")
    + " + " + case("debt_to_equity[1] < 0.6 * t_debt_to_equity -> 2", "debt_to_equity[1] < t_debt_to_equity -> 1")
    + " + " + case(f"n >= 2 AND {cnt('free_cash_flow', '> 0')} / n > 0.8 -> 1") + ") / CAST(6 AS DOUBLE) * 10)",
    "valuation": "least(10, (" + case("pe < 0.8 * t_price_to_earning_ratio -> 2", "pe < 1.2 * t_price_to_earning_ratio -> 1")
    + " + " + case("pf < 1.33 * t_price_to_fcf -> 2", "pf < 3 * t_price_to_fcf -> 1") + ") / CAST(4 AS DOUBLE) * 10)",
    "insider": "5", "sentiment": "5",
}, "growth * 0.30 + margins * 0.25 + management * 0.20 + valuation * 0.15 + insider * 0.05 + sentiment * 0.05", 10, TEN_SIGNAL, pre=SNAP_G)

EVX = "abs(CASE WHEN enterprise_value[1] > 0 THEN enterprise_value[1] / nullif({d}[1], 0) END)"
scorer_sql("druckenmiller", {
    "growth": f"CASE WHEN n >= 2 THEN least(10, ({growth_sql(3, 1.5, 0.5)} + 3) / CAST(9 AS DOUBLE) * 10) ELSE 0 END",
    "risk": "least(10, (" + case("debt_to_equity[1] < 0.6 * t_debt_to_equity -> 3", "debt_to_equity[1] < 1.4 * t_debt_to_equity -> 2", "debt_to_equity[1] < 3 * t_debt_to_equity -> 1") + " + 3) / CAST(6 AS DOUBLE) * 10)",
    "valuation": "least(10, (" + case("abs(pe) < 0.6 * t_price_to_earning_ratio -> 2", "abs(pe) < t_price_to_earning_ratio -> 1")
    + " + " + case("abs(pf) < t_price_to_fcf -> 2", "abs(pf) < 1.66 * t_price_to_fcf -> 1")
    + " + " + case(f"{EVX.format(d='ebit')} < 1.5 * t_ev_to_ebitda -> 2", f"{EVX.format(d='ebit')} < 2.5 * t_ev_to_ebitda -> 1")
    + " + " + case(f"{EVX.format(d='ebitda')} < t_ev_to_ebitda -> 2", f"{EVX.format(d='ebitda')} < 1.8 * t_ev_to_ebitda -> 1") + ") / CAST(8 AS DOUBLE) * 10)",
    "sentiment": "sentiment_score", "insider": "insider_score",
}, "growth * 0.35 + risk * 0.20 + valuation * 0.20 + sentiment * 0.15 + insider * 0.10", 10, TEN_SIGNAL, pre=SNAP_G)

BOE = f"(CASE WHEN NOT (net_income[1] = 0 AND depreciation_and_amortization[1] = 0 AND capital_expenditure[1] = 0) THEN {OES} END)"
BIV = multiple_sql(BOE, .05, .09, 12, 10)
BM = f"(CASE WHEN {BOE} IS NOT NULL THEN coalesce({MOS.format(v=BIV)}, 0) END)"
ROE_OK, OM_OK = f"{cnt('return_on_equity', '> 1.5 * t_return_on_equity')} = n", f"{cnt('operating_margin', '> 1.5 * t_operating_margin')} = n"
scorer_sql("buffett", {
    "fundamentals": case("return_on_equity[1] > 1.5 * t_return_on_equity -> 2") + " + " + case("debt_to_equity[1] < t_debt_to_equity -> 2")
    + " + " + case("operating_margin[1] > 1.5 * t_operating_margin -> 2") + " + " + case("current_ratio[1] > t_current_ratio -> 1"),
    "consistency": case("n >= 4 AND gi[1] > gi[2] -> 3"),
    "moat": f"CASE WHEN n >= 3 THEN {case(ROE_OK + ' -> 1')} + {case(OM_OK + ' -> 1')} + {case(ROE_OK + ' AND ' + OM_OK + ' -> 1')} ELSE 0 END",
    "management": case("issuance_or_purchase_of_equity_shares[1] < 0 -> 1") + " + " + case("dividends_and_other_cash_distributions[1] < 0 -> 1"),
}, "fundamentals + consistency + moat + management", 15,
    "CASE WHEN score >= 10.5 AND margin_of_safety >= 0.3 THEN 'bullish' WHEN score <= 4.5 OR margin_of_safety < -0.3 THEN 'bearish' ELSE 'neutral' END AS signal",
    {"owner_earnings": BOE, "intrinsic_value": BIV, "margin_of_safety": BM}, SNAP_W)

FUNDAMENTALS = f"""fparts AS (SELECT ticker,
  CAST({' + '.join(case(f'{m}[1] > t_{m} -> 1') for m in ('return_on_equity', 'net_margin', 'operating_margin'))} AS DOUBLE) AS profitability,
  CAST({case(f"coalesce({grow_sql('revenue')}, 0) > t_revenue_growth_qoq -> 1")} + {case(f"{G_EPS} > t_eps_growth_qoq -> 1")} + {case(f"{G_BOOK} > t_bookValue_growth_qoq -> 1")} AS DOUBLE) AS growth,
  CAST({case("current_ratio[1] <> 0 AND current_ratio[1] > t_current_ratio -> 1")} + {case("debt_to_equity[1] <> 0 AND debt_to_equity[1] < t_debt_to_equity -> 1")}
     + {case("free_cash_flow_per_share[1] <> 0 AND earnings_per_share[1] <> 0 AND free_cash_flow_per_share[1] > earnings_per_share[1] * 0.8 -> 1")}
     + {case("book_value_per_share[1] <> 0 AND book_value_per_share[1] > t_book_value_per_share -> 1")} AS DOUBLE) AS health,
  CAST({case("market_cap[1] / nullif(net_income[1], 0) > t_price_to_earning_ratio -> 1")} + {case("price_to_book_ratio[1] > t_price_to_book_ratio -> 1")}
     + {case("market_cap[1] / nullif(revenue[1], 0) > t_price_to_sales_ratio -> 1")} AS DOUBLE) AS price,
  market_cap[1] / nullif(net_income[1], 0) AS pe_ratio, price_to_book_ratio[1] AS pb_ratio, market_cap[1] / nullif(revenue[1], 0) AS ps_ratio FROM snap),
fvotes AS (SELECT *, (profitability >= 2)::INT + (growth >= 2)::INT + (health >= 2)::INT + (price = 0)::INT AS up,
  (profitability = 0)::INT + (growth = 0)::INT + (health = 0)::INT + (price >= 2)::INT AS down FROM fparts),
fundamentals AS (SELECT ticker, profitability, growth, health, price, pe_ratio, pb_ratio, ps_ratio, greatest(up, down) / 4 * 100 AS confidence,
  CASE WHEN up > down THEN 'bullish' WHEN down > up THEN 'bearish' ELSE 'neutral' END AS signal FROM fvotes)"""

for _key, (_text, _parts, _vals) in SCORER_SQL.items():
    query(f"score_{_key}", sql(SNAP, _text, " ".join(["score", "max_score", *_parts, *_vals]), 4,
                               **{c: 1 for c in _vals if "value" in c or "earnings" in c or c.endswith("fcf")}))(
        lambda spark, d, k=_key, vals=_vals: out(
            scorers.score(snapshot(spark, d), k), 4, **{c: 1 for c in vals if "value" in c or "earnings" in c or c.endswith("fcf")}))


@query("score_valuation", sql([*SNAP, GAP], "SELECT * FROM valuation", "dcf owner_earnings ev_ebitda residual_income gap confidence", 1, gap=4))
def score_valuation(spark, d):
    return out(scorers.score(snapshot(spark, d), "valuation"), 1, gap=4)


@query("score_fundamentals", sql([*SNAP, FUNDAMENTALS], "SELECT * FROM fundamentals",
                                 "profitability growth health price pe_ratio pb_ratio ps_ratio confidence", 4))
def score_fundamentals(spark, d):
    return out(scorers.score(snapshot(spark, d), "fundamentals"), 4)


def long_sql(period: str = "Annual", snap: str | None = None) -> list[str]:
    arms = [f"SELECT ticker, '{k}' AS agent, signal, score, max_score, CAST(NULL AS DOUBLE) AS confidence FROM ({t}) x" for k, (t, _, _) in SCORER_SQL.items()]
    arms.append("SELECT ticker, 'valuation', signal, NULL, NULL, confidence FROM valuation WHERE signal IS NOT NULL")
    arms.append("SELECT ticker, 'fundamentals', signal, NULL, NULL, confidence FROM fundamentals")
    gap = GAP if period == "Annual" else GAP.replace(EV_SQL, EV_QUARTERLY)
    return [FU, TH, snap or snap_cte(period), gap, FUNDAMENTALS, "results AS MATERIALIZED (" + " UNION ALL ".join(arms) + ")"]


EV_QUARTERLY = """CASE WHEN coalesce(enterprise_value[1], 0) = 0 OR coalesce(ebitda[1], 0) = 0 THEN 0
  ELSE greatest(list_aggregate(list_transform(range(1, n + 1), lambda i: enterprise_value[i] / nullif(ebitda[i], 0)), 'median') * ebitda[1] - (enterprise_value[1] - market_cap[1]), 0) END"""


@query("score_all", sql(long_sql(), "SELECT * FROM results", "score max_score confidence", 4))
def score_all(spark, d):
    return out(scorers.score_all(snapshot(spark, d)).drop("parts", "company_name"), 4)


HEADLINE_TICKER = "'S' || lpad(CAST(CAST(regexp_extract(source, '([0-9]+)', 1) AS INT) + 1 AS {0}), 5, '0')"
SIDE_SNAP = snap_cte().replace("5 AS insider_score, 2 AS insider_points, 5 AS sentiment_score FROM lists s", f"""
  coalesce(i.score, 5) AS insider_score, coalesce(i.points, 2) AS insider_points, coalesce(h.score, 5) AS sentiment_score FROM lists s
  LEFT JOIN ({ORACLES['agg_insider_ratio']}) i ON i.ticker = s.ticker
  LEFT JOIN (SELECT ticker, CASE WHEN negative > 0.3 * n THEN 3 WHEN negative > 0 THEN 6 ELSE 8 END AS score FROM (
    SELECT {HEADLINE_TICKER.format('VARCHAR')} AS ticker, count(*) AS n, count(*) FILTER (regexp_matches(lower(text), 'secret|the the|mention|license')) AS negative
    FROM documents GROUP BY 1) x) h ON h.ticker = s.ticker""")


@query("score_side_inputs", sql(long_sql(snap=SIDE_SNAP), "SELECT * FROM results", "score max_score confidence", 4))
def score_side_inputs(spark, d):
    """All scorers with insider trades and headlines instead of the neutral values."""
    titles = fx.table(spark, d, "documents").select(F.expr(HEADLINE_TICKER.format("STRING")).alias("ticker"), F.col("text").alias("title"))
    snap = snaps.with_side_inputs(snapshot(spark, d), agg.insider_scores(fx.insider_trades(spark, d)), news_src.headline_scores(titles, WORDS))
    return out(scorers.score_all(snap).drop("parts", "company_name"), 4)


@query("score_all_quarterly", sql(long_sql("Quarterly"), "SELECT * FROM results", "score max_score confidence", 4))
def score_all_quarterly(spark, d):
    return out(scorers.score_all(snapshot(spark, d, "Quarterly")).drop("parts", "company_name"), 4)


@query("score_pct", sql(long_sql(), "SELECT ticker, agent, coalesce(score / max_score * 100, confidence) AS percent FROM results", "percent", 4))
def score_pct(spark, d):
    return out(scorers.display(scorers.score_all(snapshot(spark, d))).select("ticker", "agent", "percent"), 4)


VOTES = """votes AS (SELECT ticker, CAST(sum((signal = 'bullish')::INT) AS BIGINT) AS bullish, CAST(sum((signal = 'bearish')::INT) AS BIGINT) AS bearish,
  CAST(sum((signal = 'neutral')::INT) AS BIGINT) AS neutral, sum(coalesce(score, 0)) AS score FROM results GROUP BY ticker),
summary AS (SELECT v.ticker, s.company_name, CASE WHEN bullish >= bearish AND bullish >= neutral THEN 'Bullish' WHEN bearish >= neutral THEN 'Bearish' ELSE 'Neutral' END AS signal,
  score, bullish, bearish, neutral, nullif(f.pe_ratio, 0) AS pe_ratio, nullif(f.pb_ratio, 0) AS pb_ratio, nullif(f.ps_ratio, 0) AS ps_ratio
  FROM votes v JOIN snap s ON s.ticker = v.ticker JOIN fundamentals f ON f.ticker = v.ticker)"""


@query("agg_vote_summary", sql([*long_sql(), VOTES], "SELECT * FROM summary", "score pe_ratio pb_ratio ps_ratio", 4))
def agg_vote_summary(spark, d):
    df = scorers.summary(snapshot(spark, d))
    return out(df.withColumns({c: F.col(c).cast("bigint") for c in ("bullish", "bearish", "neutral")}), 4)


@query("srt_agents", sql([*long_sql(), VOTES], "SELECT ticker, signal, score FROM summary ORDER BY score DESC, ticker", "score", 4))
def srt_agents(spark, d):
    return out(scorers.vote_summary(scorers.score_all(snapshot(spark, d))).select("ticker", "signal", "score"), 4).orderBy(F.desc("score"), "ticker")


@query("agg_signals_map", sql(long_sql(), "SELECT ticker, agent, signal, confidence FROM results", "confidence", 4))
def agg_signals_map(spark, d):
    """The map is flattened again so that its entries can be compared."""
    m = agg.signals_map(scorers.score_all(snapshot(spark, d)))
    return out(m.select("ticker", F.explode("signals").alias("agent", "v"))
               .select("ticker", "agent", F.col("v.signal").alias("signal"), F.col("v.confidence").alias("confidence")), 4)


def _fmt(text: str, col: str) -> str:
    return f"printf('{text} %.2f', {col})"


@query("score_reasons", sql(SNAP, f"""
SELECT ticker, 'graham' AS agent, 'earnings' AS block, CASE WHEN n < 2 THEN 'not enough EPS history' ELSE
    CASE WHEN {cnt('earnings_per_share', '> 0')} = n THEN 'EPS positive in all periods' WHEN {cnt('earnings_per_share', '> 0')} >= 0.8 * n THEN 'EPS positive in most periods' ELSE 'EPS negative in several periods' END
    || '; ' || CASE WHEN earnings_per_share[1] > earnings_per_share[2] THEN 'EPS grew' ELSE 'EPS did not grow' END END AS details FROM snap
UNION ALL SELECT ticker, 'graham', 'strength', concat_ws('; ',
    CASE WHEN current_ratio[1] > 0 THEN CASE WHEN current_ratio[1] >= t_current_ratio * 1.333 THEN {_fmt('solid current ratio', 'current_ratio[1]')}
      WHEN current_ratio[1] >= t_current_ratio THEN {_fmt('fair current ratio', 'current_ratio[1]')} ELSE {_fmt('weak current ratio', 'current_ratio[1]')} END ELSE 'no current ratio' END,
    CASE WHEN debt_ratio[1] > 0 THEN CASE WHEN debt_ratio[1] < 0.5 THEN {_fmt('conservative debt ratio', 'debt_ratio[1]')}
      WHEN debt_ratio[1] < 0.8 THEN {_fmt('acceptable debt ratio', 'debt_ratio[1]')} ELSE {_fmt('high debt ratio', 'debt_ratio[1]')} END ELSE 'no debt ratio' END,
    CASE WHEN dividends_and_other_cash_distributions[1] < 0 THEN 'dividends paid' ELSE 'no dividends paid' END) FROM snap
UNION ALL SELECT ticker, 'graham', 'valuation', CASE WHEN NOT market_cap[1] > 0 THEN 'no market cap' ELSE concat_ws('; ',
    CASE WHEN {NCAV} > 0 AND {NCAV} > market_cap[1] THEN 'net current assets above market cap' WHEN {NCAV} > 0 AND {NCAV} / outstanding_shares[1] >= 0.67 * {PRICE} THEN 'net current assets near price' ELSE 'no net-net discount' END,
    CASE WHEN {GM} > 0.5 THEN 'large margin to Graham number' WHEN {GM} > 0.2 THEN 'some margin to Graham number' WHEN {GM} IS NOT NULL THEN 'no margin to Graham number' ELSE 'no Graham number' END) END FROM snap
UNION ALL SELECT ticker, 'buffett', 'fundamentals', concat_ws('; ',
    CASE WHEN return_on_equity[1] > 1.5 * t_return_on_equity THEN 'strong return on equity' ELSE 'weak return on equity' END,
    CASE WHEN debt_to_equity[1] < t_debt_to_equity THEN 'conservative debt' ELSE 'high debt' END,
    CASE WHEN operating_margin[1] > 1.5 * t_operating_margin THEN 'strong operating margin' ELSE 'weak operating margin' END,
    CASE WHEN current_ratio[1] > t_current_ratio THEN 'good liquidity' ELSE 'weak liquidity' END) FROM snap
UNION ALL SELECT ticker, 'buffett', 'consistency', CASE WHEN n < 4 THEN 'needs four periods' WHEN gi[1] > gi[2] THEN 'consistent earnings growth' ELSE 'inconsistent earnings growth' END FROM {SNAP_W}
UNION ALL SELECT ticker, 'buffett', 'moat', CASE WHEN n < 3 THEN 'needs three periods' ELSE concat_ws('; ',
    CASE WHEN {ROE_OK} THEN 'stable return on equity' ELSE 'return on equity not stable' END,
    CASE WHEN {OM_OK} THEN 'stable operating margin' ELSE 'operating margin not stable' END,
    CASE WHEN {ROE_OK} AND {OM_OK} THEN 'both stable' END) END FROM snap
UNION ALL SELECT ticker, 'buffett', 'management', CASE WHEN issuance_or_purchase_of_equity_shares[1] < 0 THEN 'buys back shares' ELSE 'no buybacks' END
    || '; ' || CASE WHEN dividends_and_other_cash_distributions[1] < 0 THEN 'pays dividends' ELSE 'no dividends' END FROM snap"""))
def score_reasons(spark, d):
    return scorers.reasons(snapshot(spark, d), ["graham", "buffett"])


@query("score_reasons_all")
def score_reasons_all(spark, d):
    """Reasons of every scorer (two of them have an oracle above)."""
    return scorers.reasons(snapshot(spark, d))
