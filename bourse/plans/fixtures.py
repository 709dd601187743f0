"""Market tables derived from the given test tables (see FIXTURES.md).

Each function has a DataFrame form (used by `queries()`) and an SQL form (the
`*_CTE` texts, used by `oracle_sql()`); both follow the same definitions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from bourse.functions.columns import growth
from bourse.sources.reference import sector_code


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---------------------------------------------------------------- bars
def bars(spark, sf_dir, span: str = "week", fine: bool = False) -> DataFrame:
    """OHLCV bars: ticker = part brand (or brand-type), px = price per unit.

    Lines of a bar are ordered by day, order, line and a mix of part and
    supplier, written as one DECIMAL (any BIGINT order key and INT line number
    fit): with a fixed-width order the partial aggregation hashes the rows, with a
    struct it would sort them first.
    """
    name = F.concat_ws("-", "p_brand", "p_type") if fine else F.col("p_brand")
    part = table(spark, sf_dir, "part").select("p_partkey", name.alias("ticker"))
    day = "CAST(l_shipdate AS DATE)"
    first = day if span == "day" else f"trunc({day}, '{span}')"
    line = (table(spark, sf_dir, "lineitem")
            .selectExpr("l_partkey", f"{first} AS date", "l_extendedprice / l_quantity AS px", "l_quantity",
                        f"CAST(CAST(datediff({day}, {first}) AS DECIMAL(5)) * CAST(1e33 AS DECIMAL(34)) AS DECIMAL(38))"
                        " + CAST(l_orderkey AS DECIMAL(19)) * 100000000000000"
                        " + CAST(l_linenumber AS BIGINT) * 10000 + (l_partkey * 31 + l_suppkey) % 8192 AS k"))
    return (line.join(part, line.l_partkey == part.p_partkey).groupBy("ticker", "date")
            .agg(F.expr("min_by(px, k) AS open"), F.expr("max(px) AS high"), F.expr("min(px) AS low"),
                 F.expr("max_by(px, k) AS close"), F.expr("sum(l_quantity) AS volume")))


def bars_cte(span: str = "week", fine: bool = False) -> str:
    name = "p_brand || '-' || p_type" if fine else "p_brand"
    return f"""px AS (
  SELECT {name} AS ticker, CAST(date_trunc('{span}', l_shipdate) AS DATE) AS date,
         l_extendedprice / l_quantity AS px, l_quantity AS qty,
         struct_pack(a := l_shipdate, b := l_orderkey, c := l_linenumber, m := (l_partkey * 31 + l_suppkey) % 8192,
           d := l_partkey, e := l_suppkey) AS k
  FROM lineitem JOIN part ON l_partkey = p_partkey),
bars AS MATERIALIZED (
  SELECT ticker, date, arg_min(px, k) AS open, max(px) AS high, min(px) AS low,
         arg_max(px, k) AS close, sum(qty) AS volume
  FROM px GROUP BY ticker, date)"""


BARS_CTE = bars_cte()


def calm_bars(spark, sf_dir, fine: bool = False) -> DataFrame:
    """(ticker, date, close) with moves of a few percent, for backtests.

    Prices per unit jump tenfold from week to week, which compounds past the
    range where results can be compared; here they are a small part of the close.
    """
    return bars(spark, sf_dir, fine=fine).selectExpr("ticker", "date", "1000 + CAST(0.001 AS DOUBLE) * close AS close")


CALM_CTE = "calm AS (SELECT ticker, date, 1000 + CAST(0.001 AS DOUBLE) * close AS close FROM bars)"


# ---------------------------------------------------------------- news
# event type -> sentiment of the derived news facts
SENTIMENT_OF_EVENT = {
    "purchase": "positive",
    "view": "neutral",
    "error": "negative",
    "click": "bullish",
    "signup": "mixed",
}


def news(spark, sf_dir) -> DataFrame:
    """Sentiment facts (ticker, date, sentiment), one row per event."""
    ev = table(spark, sf_dir, "events")
    sent = F.coalesce(*[F.when(F.col("event_type") == k, F.lit(v)) for k, v in SENTIMENT_OF_EVENT.items()])
    return ev.select(_event_ticker().alias("ticker"), F.to_date("ts").alias("date"), sent.alias("sentiment"))


def _event_ticker():
    return F.concat(F.lit("Brand#"), (F.col("user_id") % 25 + 1).cast("string"))


_SENTIMENT_SQL = "CASE event_type " + " ".join(
    f"WHEN '{k}' THEN '{v}'" for k, v in SENTIMENT_OF_EVENT.items()) + " END"
NEWS_CTE = f"""news AS (
  SELECT 'Brand#' || CAST(user_id % 25 + 1 AS VARCHAR) AS ticker, CAST(ts AS DATE) AS date,
         {_SENTIMENT_SQL} AS sentiment FROM events)"""


def articles(spark, sf_dir) -> DataFrame:
    """Nested articles, one per event, with two insights: the event's ticker and the market.

    Articles of users whose id is divisible by 10 carry NULL insights.
    """
    ev = table(spark, sf_dir, "events")
    sent = F.coalesce(*[F.when(F.col("event_type") == k, F.lit(v)) for k, v in SENTIMENT_OF_EVENT.items()])
    insight = F.struct(_event_ticker().alias("ticker"), sent.alias("sentiment"))
    return ev.select(
        F.col("event_id").alias("article_id"),
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("published_utc"),
        F.when(F.col("user_id") % 10 != 0, F.array(
            insight, F.struct(F.lit("MARKET").alias("ticker"), sent.alias("sentiment")))).alias("insights"))


def ticks(spark, sf_dir) -> DataFrame:
    """Intraday trades: events as (ticker, ts, id, px, size)."""
    ev = table(spark, sf_dir, "events")
    return ev.select(_event_ticker().alias("ticker"), F.col("ts"), F.col("event_id").alias("id"),
                     F.col("value").alias("px"), (F.col("event_id") % 7 + 1).cast("double").alias("size"))


TICKS_CTE = """ticks AS (
  SELECT 'Brand#' || CAST(user_id % 25 + 1 AS VARCHAR) AS ticker, ts, event_id AS id, value AS px,
         CAST(event_id % 7 + 1 AS DOUBLE) AS size FROM events)"""


# ---------------------------------------------------------------- statements
#: statement items in column order; every one is a DOUBLE column `<section>.<item>.value`
INCOME_ITEMS = (
    "revenues", "costs_and_expenses", "operating_expenses", "operating_income_loss",
    "research_and_development", "depreciation_and_amortization", "interest_and_debt_expense",
    "income_tax_expense_benefit", "net_income_loss", "common_stock_dividends",
    "preferred_stock_dividends_and_other_adjustments", "basic_average_shares",
    "basic_earnings_per_share",
)
BALANCE_ITEMS = (
    "assets", "liabilities", "equity", "current_assets", "current_liabilities", "cash",
    "intangible_assets",
)
CASH_ITEMS = (
    "net_cash_flow_from_operating_activities", "net_cash_flow_from_investing_activities",
    "net_cash_flow_from_financing_activities",
)
SECTIONS = {
    "income_statement": INCOME_ITEMS,
    "balance_sheet": BALANCE_ITEMS,
    "cash_flow_statement": CASH_ITEMS,
}
ITEMS = [i for items in SECTIONS.values() for i in items]
FLOW_ITEMS = [i for i in INCOME_ITEMS if i not in ("basic_average_shares", "basic_earnings_per_share")] + list(CASH_ITEMS)
STOCK_ITEMS = list(BALANCE_ITEMS) + ["basic_average_shares", "market_cap"]

# per-quarter sums over the supplier's lines: name -> (SQL expression over l_* columns)
_QUARTER_SUMS = {
    "revenues": "l_extendedprice",
    "costs_and_expenses": "l_extendedprice * (0.55 + 2 * l_discount)",
    "operating_expenses": "l_extendedprice * (0.10 + l_discount)",
    "operating_income_loss": "l_extendedprice * (0.35 - 3 * l_discount)",
    "research_and_development": "l_extendedprice * l_tax",
    "debt_base": "l_extendedprice * (1 + 20 * l_tax)",
    "cash": "l_extendedprice * (0.1 + l_discount)",
    "e_f": "CASE WHEN l_linestatus = 'F' THEN l_extendedprice ELSE 0 END",
    "e_o": "CASE WHEN l_linestatus = 'O' THEN l_extendedprice ELSE 0 END",
    "e_r": "CASE WHEN l_returnflag = 'R' THEN l_extendedprice ELSE 0 END",
    "e_a": "CASE WHEN l_returnflag = 'A' THEN l_extendedprice ELSE 0 END",
    "e_n": "CASE WHEN l_returnflag = 'N' THEN l_extendedprice ELSE 0 END",
}

# quarter items from those sums (plain SQL that both engines read the same way)
_QUARTER_ITEMS = {
    "revenues": "revenues",
    "costs_and_expenses": "costs_and_expenses",
    "operating_expenses": "operating_expenses",
    "operating_income_loss": "operating_income_loss",
    "research_and_development": "research_and_development",
    "depreciation_and_amortization": "0.03 * revenues",
    "interest_and_debt_expense": "0.02 * e_f",
    "income_tax_expense_benefit": "0.21 * operating_income_loss",
    "net_income_loss": "0.79 * operating_income_loss - 0.3 * e_r",
    "common_stock_dividends": "0.01 * e_o",
    "preferred_stock_dividends_and_other_adjustments": "-0.01 * e_f",
    "basic_average_shares": "1000 + 10 * (s_suppkey % 100) + n_lines",
    "assets": "4 * revenues + 100000",
    "liabilities": "debt_base",
    "equity": "4 * revenues + 100000 - debt_base",
    "current_assets": "0.5 * (4 * revenues + 100000)",
    "current_liabilities": "CASE WHEN s_suppkey % 17 = 0 THEN 0 ELSE 0.6 * debt_base END",
    "cash": "cash",
    "intangible_assets": "CASE WHEN s_acctbal > 5000 THEN 0.1 * (4 * revenues + 100000) ELSE 0 END",
    "net_cash_flow_from_operating_activities": "0.79 * operating_income_loss - 0.3 * e_r + 0.03 * revenues",
    "net_cash_flow_from_investing_activities": "-0.08 * e_a",
    "net_cash_flow_from_financing_activities": "0.05 * e_r - 0.02 * e_n",
}


def _snap(expr: str) -> str:
    """Nearest multiple of 1e-6, by the same arithmetic in both engines.

    Sums over differently ordered lines differ in their last bits; the items
    have at most six decimals, so this gives every engine the same number.
    """
    return f"CAST(floor(({expr}) * 1000000 + 0.5) AS DOUBLE) / 1000000"


def _sql_sic2(pre=""):
    return f"CASE WHEN {pre}s_nationkey = 24 THEN '73' ELSE lpad(CAST({pre}s_nationkey + 1 AS STRING), 2, '0') END"


def statements(spark, sf_dir, with_q4: bool = False) -> DataFrame:
    """Flat statements: one row per supplier and fiscal quarter plus FY rows.

    Lines are summed per (supplier key, quarter) before the supplier join, so
    only one row per supplier and quarter is shuffled.  Q4 rows are withheld
    unless `with_q4` is set; a year has an FY row only when all four quarters exist.
    """
    q = (table(spark, sf_dir, "lineitem")
         .selectExpr("l_suppkey AS _supp", "year(l_shipdate) AS fiscal_year", "quarter(l_shipdate) AS qtr", "*")
         .groupBy("_supp", "fiscal_year", "qtr")
         .agg(F.expr("count(1) AS n_lines"),
              *[F.expr(f"{_snap(f'sum(CAST({e} AS DOUBLE))')} AS {n}") for n, e in _QUARTER_SUMS.items()]))
    s = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_nationkey", "s_acctbal")
    head = ["s_suppkey", "s_name", "s_nationkey", "s_acctbal", "fiscal_year"]
    quarter = (q.join(s, q._supp == s.s_suppkey)
               .selectExpr(*head, "qtr", *[f"{_snap(f'CAST({e} AS DOUBLE)')} AS {n}" for n, e in _QUARTER_ITEMS.items()])
               .selectExpr("*", f"{_snap('equity * (1 + s_acctbal / 10000) + 5 * revenues')} AS market_cap"))
    # each quarter row counts for itself and for the year (qtr 0): one pass gives both
    rows = (quarter.selectExpr("*", "explode(array(qtr, 0)) AS period")
            .groupBy(*head, F.col("period").alias("_p"))
            .agg(F.expr("count(1) AS _n"),
                 *[F.expr(f"{_snap(f'sum({i})')} AS {i}") for i in FLOW_ITEMS],
                 *[F.expr(f"max_by({i}, qtr) AS {i}") for i in STOCK_ITEMS])
            .where("_p > 0 OR _n = 4").withColumnRenamed("_p", "qtr").drop("_n"))
    if not with_q4:
        rows = rows.where("qtr <> 4")
    end = "last_day(make_date(fiscal_year, CASE WHEN qtr = 0 THEN 12 ELSE qtr * 3 END, 1))"
    eps = _snap("net_income_loss / nullif(basic_average_shares, 0)")
    return rows.selectExpr(
        "concat('S', lpad(CAST(s_suppkey AS STRING), 5, '0')) AS ticker",
        "lpad(CAST(s_suppkey AS STRING), 10, '0') AS cik", "s_name AS company_name", "fiscal_year",
        "CASE WHEN qtr = 0 THEN 'FY' ELSE concat('Q', CAST(qtr AS STRING)) END AS fiscal_period",
        f"{end} AS end_date", f"date_add({end}, 45) AS filing_date", f"{_sql_sic2()} AS sic2",
        f"concat({_sql_sic2()}, lpad(CAST(s_suppkey % 100 AS STRING), 2, '0')) AS sic4",
        *[f"{eps if i == 'basic_earnings_per_share' else i} AS `{sec}.{i}.value`" for sec, items in SECTIONS.items() for i in items],
        "market_cap")


def _statements_cte() -> str:
    sums = ",\n         ".join(f"{_snap(f'sum(CAST({e} AS DOUBLE))')} AS {n}" for n, e in _QUARTER_SUMS.items())
    items = ",\n         ".join(f"{_snap(f'CAST({e} AS DOUBLE)')} AS {n}" for n, e in _QUARTER_ITEMS.items())
    flows = ", ".join(f"{_snap(f'sum({i})')} AS {i}" for i in FLOW_ITEMS)
    stocks = ", ".join(f"arg_max({i}, qtr) AS {i}" for i in STOCK_ITEMS)
    cols = ", ".join(i for i in ITEMS if i != "basic_earnings_per_share")
    sic2 = _sql_sic2().replace("STRING", "VARCHAR")
    return f"""qsum AS (
  SELECT l_suppkey, CAST(year(l_shipdate) AS INTEGER) AS fiscal_year, CAST(quarter(l_shipdate) AS INTEGER) AS qtr,
         count(*) AS n_lines,
         {sums}
  FROM lineitem GROUP BY ALL),
qitem AS (
  SELECT s_suppkey, s_name, s_nationkey, s_acctbal, fiscal_year, qtr,
         {items}
  FROM qsum JOIN supplier ON l_suppkey = s_suppkey),
quarters AS (
  SELECT *, {_snap('equity * (1 + s_acctbal / 10000) + 5 * revenues')} AS market_cap FROM qitem),
years AS (
  SELECT s_suppkey, s_name, s_nationkey, s_acctbal, fiscal_year, 0 AS qtr, {flows}, {stocks}
  FROM quarters GROUP BY s_suppkey, s_name, s_nationkey, s_acctbal, fiscal_year HAVING count(*) = 4),
st_rows AS (SELECT * FROM quarters UNION ALL BY NAME SELECT * FROM years),
all_statements AS MATERIALIZED (
  SELECT 'S' || lpad(CAST(s_suppkey AS VARCHAR), 5, '0') AS ticker,
         lpad(CAST(s_suppkey AS VARCHAR), 10, '0') AS cik, s_name AS company_name, fiscal_year,
         CASE WHEN qtr = 0 THEN 'FY' ELSE 'Q' || CAST(qtr AS VARCHAR) END AS fiscal_period,
         last_day(make_date(fiscal_year, CASE WHEN qtr = 0 THEN 12 ELSE qtr * 3 END, 1)) AS end_date,
         last_day(make_date(fiscal_year, CASE WHEN qtr = 0 THEN 12 ELSE qtr * 3 END, 1)) + 45 AS filing_date,
         {sic2} AS sic2,
         ({sic2}) || lpad(CAST(s_suppkey % 100 AS VARCHAR), 2, '0') AS sic4,
         {cols}, {_snap('net_income_loss / nullif(basic_average_shares, 0)')} AS basic_earnings_per_share, market_cap
  FROM st_rows),
statements AS (SELECT * FROM all_statements WHERE fiscal_period <> 'Q4')"""


STATEMENTS_CTE = _statements_cte()


def filings_json(spark, sf_dir) -> DataFrame:
    """The same statements as nested filings: header columns and a JSON text."""
    st = statements(spark, sf_dir)
    item = lambda sec, i: f"'{i}', named_struct('value', `{sec}.{i}.value`, 'unit', 'USD')"
    nested = ", ".join(f"'{sec}', named_struct({', '.join(item(sec, i) for i in items)})" for sec, items in SECTIONS.items())
    return st.selectExpr("ticker", "cik", "company_name", "fiscal_year", "fiscal_period", "end_date",
                         "filing_date", "sic2", "sic4", f"to_json(named_struct({nested})) AS financials", "market_cap")


# ---------------------------------------------------------------- reference data
def index_members(spark, sf_dir) -> DataFrame:
    """(index_name, pos, ticker): brands sold by suppliers of a region, most lines first.

    The NULL ticker rows stand for unreadable cells of a landed list.
    """
    line = table(spark, sf_dir, "lineitem").groupBy("l_partkey", "l_suppkey").agg(F.count(F.lit(1)).alias("n"))
    part = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    sup = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    nat = table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    reg = table(spark, sf_dir, "region").select("r_regionkey", "r_name")
    counts = (line.join(part, line.l_partkey == part.p_partkey).join(sup, line.l_suppkey == sup.s_suppkey)
              .join(nat, sup.s_nationkey == nat.n_nationkey).join(reg, nat.n_regionkey == reg.r_regionkey)
              .groupBy(F.col("r_name").alias("index_name"), F.col("p_brand").alias("brand"))
              .agg(F.sum("n").alias("n")))
    pos = F.row_number().over(Window.partitionBy("index_name").orderBy(F.desc("n"), "brand"))
    return counts.select("index_name", pos.alias("pos"),
                         F.when(F.col("n") % 11 != 0, F.col("brand")).alias("ticker"))


INDEX_MEMBERS_CTE = """member_counts AS (
  SELECT r_name AS index_name, p_brand AS brand, count(*) AS n
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey
       JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
  GROUP BY ALL),
index_members AS (
  SELECT index_name, CAST(row_number() OVER (PARTITION BY index_name ORDER BY n DESC, brand) AS INTEGER) AS pos,
         CASE WHEN n % 11 <> 0 THEN brand END AS ticker
  FROM member_counts)"""


def ticker_details(spark, sf_dir) -> DataFrame:
    """(ticker, asof, market_cap, sic4): one row per supplier and month."""
    line = table(spark, sf_dir, "lineitem")
    m = (line.groupBy("l_suppkey", F.trunc(F.col("l_shipdate").cast("date"), "month").alias("asof"))
         .agg(F.round(F.sum("l_extendedprice"), 2).alias("e")))
    s = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    sic2 = F.expr(_sql_sic2())
    return m.join(s, m.l_suppkey == s.s_suppkey).select(
        F.concat(F.lit("S"), F.lpad(F.col("s_suppkey").cast("string"), 5, "0")).alias("ticker"), "asof",
        (F.col("e") * 12).alias("market_cap"),
        F.concat(sic2, F.lpad((F.col("s_suppkey") % 100).cast("string"), 2, "0")).alias("sic4"))


TICKER_DETAILS_CTE = f"""ticker_details AS (
  SELECT 'S' || lpad(CAST(s_suppkey AS VARCHAR), 5, '0') AS ticker, "asof", e * 12 AS market_cap,
         ({_sql_sic2().replace('STRING', 'VARCHAR')}) || lpad(CAST(s_suppkey % 100 AS VARCHAR), 2, '0') AS sic4
  FROM (SELECT l_suppkey, CAST(date_trunc('month', l_shipdate) AS DATE) AS "asof", round(sum(l_extendedprice), 2) AS e
        FROM lineitem GROUP BY ALL) JOIN supplier ON l_suppkey = s_suppkey)"""


def insider_trades(spark, sf_dir) -> DataFrame:
    """(ticker, transaction_shares, transaction_type) from the supplier's lines."""
    line = table(spark, sf_dir, "lineitem")
    return line.select(
        F.concat(F.lit("S"), F.lpad(F.col("l_suppkey").cast("string"), 5, "0")).alias("ticker"),
        F.expr("CASE l_returnflag WHEN 'R' THEN -l_quantity WHEN 'A' THEN l_quantity END").alias("transaction_shares"),
        F.expr("CASE l_returnflag WHEN 'R' THEN 'Sell' WHEN 'A' THEN 'Buy' END").alias("transaction_type"))


INSIDER_CTE = """insider_trades AS (
  SELECT 'S' || lpad(CAST(l_suppkey AS VARCHAR), 5, '0') AS ticker,
         CASE l_returnflag WHEN 'R' THEN -l_quantity WHEN 'A' THEN l_quantity END AS transaction_shares,
         CASE l_returnflag WHEN 'R' THEN 'Sell' WHEN 'A' THEN 'Buy' END AS transaction_type
  FROM lineitem)"""


def positions(bar_df: DataFrame) -> DataFrame:
    """(ticker, shares, cost_basis) for every third brand."""
    num = F.regexp_extract("ticker", r"(\d+)", 1).cast("int")
    return (bar_df.groupBy("ticker").agg((F.max_by("close", "date") * 100).alias("cost_basis"))
            .where(num % 3 == 0).select("ticker", F.lit(100.0).alias("shares"), "cost_basis"))


POSITIONS_CTE = r"""positions AS (
  SELECT ticker, 100.0 AS shares, arg_max(close, date) * 100 AS cost_basis FROM bars
  WHERE CAST(regexp_extract(ticker, '(\d+)', 1) AS INTEGER) % 3 = 0 GROUP BY ticker)"""
ACCOUNT_CASH = 1_000_000.0


# ---------------------------------------------------------------- sector thresholds
_CLIPPED = "avg(least(greatest({c}, -1), 1))"
#: sector value of each metric over the FY rows of its tickers (sums, so that a
#: large sector is reduced before the shuffle)
_SECTOR = {
    "free_cash_flow_per_share": "sum(free_cash_flow) / nullif(sum(outstanding_shares), 0)",
    "debt_to_equity": "sum(total_debt) / nullif(sum(shareholders_equity), 0)",
    "current_ratio": "sum(current_assets) / nullif(sum(current_liabilities), 0)",
    "book_value_per_share": "sum(book_value) / nullif(sum(outstanding_shares), 0)",
    "gross_margin": "avg(gross_margin)",
    "return_on_equity": "sum(net_income) / nullif(sum(shareholders_equity), 0)",
    "net_margin": "sum(net_income) / nullif(sum(revenue), 0)",
    "operating_margin": "sum(operating_income) / nullif(sum(revenue), 0)",
    "price_to_fcf": "abs(sum(market_cap) / nullif(sum(free_cash_flow), 0))",
    "price_to_book_ratio": "sum(market_cap) / nullif(sum(book_value), 0)",
    "price_to_earning_ratio": "abs(sum(market_cap) / nullif(sum(net_income), 0))",
    "price_to_sales_ratio": "sum(market_cap) / nullif(sum(revenue), 0)",
    "ev_to_ebitda": "abs(sum(enterprise_value) / nullif(sum(ebitda), 0))",
    "return_on_invested_capital": "avg(return_on_invested_capital)",
    "revenue_growth_qoq": _CLIPPED.format(c="rev_g") + " * 0.5",
    "bookValue_growth_qoq": _CLIPPED.format(c="book_g") + " * 0.5",
    "eps_growth_qoq": _CLIPPED.format(c="eps_g") + " * 0.5",
    "rd_intensity": "sum(research_and_development) / nullif(sum(revenue), 0)",
}
_HOLES = ("eps_growth_qoq", "price_to_fcf")


def thresholds(fund: DataFrame) -> DataFrame:
    """Sector matrix from the FY ratios of each sector.

    Left out on purpose: every fifth two-digit sector, odd four-digit codes, and
    some cells.  The default rows (99, 7399) hold the values of all sectors.
    """
    w = Window.partitionBy("ticker").orderBy("end_date")
    fy = fund.where("fiscal_period = 'FY'").withColumns({
        "code": sector_code(),
        "rev_g": growth(F.col("revenue"), F.lag("revenue").over(w)),
        "book_g": growth(F.col("book_value"), F.lag("book_value").over(w)),
        "eps_g": growth(F.col("earnings_per_share"), F.lag("earnings_per_share").over(w))})
    aggs = [F.expr(f"round({e}, 4) AS {m}") for m, e in _SECTOR.items()]
    # the sectors and, in the same pass, all of them together (code NULL)
    sums = fy.rollup("code").agg(*aggs)
    last2 = F.substring("code", -2, 2).cast("int")
    keep = (F.when(F.col("code").isNull(), F.lit(True))
            .when(F.length("code") == 2, (F.col("code").cast("int") - 1) % 5 != 0)
            .otherwise((last2 % 2 == 0) & (F.col("code") != "7399")))
    holes = {m: F.when(F.col("code").isNull() | (last2 % 4 != 1), F.col(m)) for m in _HOLES}
    codes = F.when(F.col("code").isNull(), F.array(F.lit("99"), F.lit("7399"))).otherwise(F.array("code"))
    rows = sums.where(keep).withColumns(holes).withColumn("code", F.explode(codes))
    return rows.select("code", F.concat(F.lit("sector "), "code").alias("name"), *_SECTOR)


def _fund_cte() -> str:
    flows = [i for i in ITEMS if i in FLOW_ITEMS or i == "basic_earnings_per_share"]
    stocks = [i for i in ITEMS if i not in flows]
    q4 = ", ".join([f"f.{i} - (a.{i} + b.{i} + c.{i}) AS {i}" for i in flows] + [f"f.{i}" for i in stocks])
    return f"""q4rows AS (
  SELECT f.ticker, f.cik, f.company_name, f.fiscal_year, 'Q4' AS fiscal_period, f.end_date, f.filing_date, f.sic2, f.sic4, f.market_cap, {q4}
  FROM statements f JOIN statements a ON a.ticker = f.ticker AND a.fiscal_year = f.fiscal_year AND a.fiscal_period = 'Q1'
       JOIN statements b ON b.ticker = f.ticker AND b.fiscal_year = f.fiscal_year AND b.fiscal_period = 'Q2'
       JOIN statements c ON c.ticker = f.ticker AND c.fiscal_year = f.fiscal_year AND c.fiscal_period = 'Q3'
  WHERE f.fiscal_period = 'FY'),
full_statements AS MATERIALIZED (SELECT * FROM statements UNION ALL BY NAME SELECT * FROM q4rows),
fund AS MATERIALIZED (
  SELECT ticker, company_name, sic2, sic4, filing_date, end_date, fiscal_period, fiscal_year,
    net_income_loss / nullif(equity, 0) AS return_on_equity,
    operating_income_loss / nullif(revenues, 0) AS operating_margin,
    liabilities / nullif(equity, 0) AS debt_to_equity, liabilities / nullif(assets, 0) AS debt_ratio,
    current_assets / nullif(current_liabilities, 0) AS current_ratio,
    market_cap + liabilities - cash AS enterprise_value,
    net_income_loss + income_tax_expense_benefit + interest_and_debt_expense AS ebit,
    net_income_loss + income_tax_expense_benefit + interest_and_debt_expense + depreciation_and_amortization AS ebitda,
    net_cash_flow_from_operating_activities - net_cash_flow_from_investing_activities AS free_cash_flow,
    (net_cash_flow_from_operating_activities - net_cash_flow_from_investing_activities) / nullif(basic_average_shares, 0) AS free_cash_flow_per_share,
    net_income_loss / nullif(revenues, 0) AS net_margin, assets - liabilities AS book_value,
    (assets - liabilities) / nullif(basic_average_shares, 0) AS book_value_per_share,
    market_cap / nullif(assets - liabilities, 0) AS price_to_book_ratio,
    (net_income_loss - common_stock_dividends) / nullif(equity + liabilities, 0) AS return_on_invested_capital,
    (revenues - costs_and_expenses) / nullif(revenues, 0) AS gross_margin,
    current_assets - current_liabilities AS working_capital,
    basic_earnings_per_share AS earnings_per_share, revenues AS revenue, net_income_loss AS net_income,
    assets AS total_assets, liabilities AS total_liabilities, liabilities AS total_debt, current_assets, current_liabilities,
    preferred_stock_dividends_and_other_adjustments AS dividends_and_other_cash_distributions,
    net_cash_flow_from_financing_activities AS issuance_or_purchase_of_equity_shares,
    basic_average_shares AS outstanding_shares, net_cash_flow_from_investing_activities AS capital_expenditure,
    operating_expenses AS operating_expense, cash AS cash_and_equivalents, equity AS shareholders_equity,
    research_and_development, intangible_assets AS goodwill_and_intangible_assets, intangible_assets,
    operating_income_loss AS operating_income, depreciation_and_amortization, market_cap
  FROM full_statements)"""


FUND_CTE = STATEMENTS_CTE + ",\n" + _fund_cte()


def _thresholds_cte() -> str:
    aggs = ", ".join(f"round({e}, 4) AS {m}" for m, e in _SECTOR.items())
    cells = ", ".join(f"CASE WHEN CAST(right(code, 2) AS INTEGER) % 4 <> 1 THEN {m} END AS {m}" if m in _HOLES else m for m in _SECTOR)
    g = lambda c, n: f"({c} - lag({c}) OVER y) / nullif(abs(lag({c}) OVER y), 0) AS {n}"
    return f"""fy AS (SELECT *, CASE WHEN sic2 = '73' THEN sic4 ELSE sic2 END AS code,
    {g('revenue', 'rev_g')}, {g('book_value', 'book_g')}, {g('earnings_per_share', 'eps_g')}
  FROM fund WHERE fiscal_period = 'FY' WINDOW y AS (PARTITION BY ticker ORDER BY end_date)),
thresholds AS MATERIALIZED (
  SELECT code, 'sector ' || code AS name, {cells} FROM (SELECT code, {aggs} FROM fy GROUP BY code) s
  WHERE CASE WHEN length(code) = 2 THEN (CAST(code AS INTEGER) - 1) % 5 <> 0
             ELSE CAST(right(code, 2) AS INTEGER) % 2 = 0 AND code <> '7399' END
  UNION ALL
  SELECT c.code, 'sector ' || c.code AS name, {', '.join(_SECTOR)} FROM (SELECT {aggs} FROM fy) s, (SELECT unnest(['99', '7399']) AS code) c)"""


THRESHOLDS_CTE = _thresholds_cte()
