"""Small reference tables: index members, ticker samples, sector thresholds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# fixed value: the numeric metrics of a sector threshold row
METRICS = [
    "free_cash_flow_per_share", "debt_to_equity", "current_ratio", "book_value_per_share",
    "gross_margin", "return_on_equity", "net_margin", "operating_margin", "price_to_fcf",
    "price_to_book_ratio", "price_to_earning_ratio", "price_to_sales_ratio", "ev_to_ebitda",
    "return_on_invested_capital", "revenue_growth_qoq", "bookValue_growth_qoq",
    "eps_growth_qoq", "rd_intensity",
]
#: codes of the default rows (two-digit matrix, business-services matrix)
DEFAULT_SIC2, DEFAULT_SIC4 = "99", "7399"

THRESHOLD_SCHEMA = T.StructType(
    [T.StructField("code", T.StringType()), T.StructField("name", T.StringType())]
    + [T.StructField(m, T.DoubleType()) for m in METRICS])


def read_thresholds(spark: SparkSession, path: str, header: bool = True) -> DataFrame:
    """Sector matrix from CSV; codes stay text ('01'), cells may be empty."""
    t = spark.read.csv(path, schema=THRESHOLD_SCHEMA, header=header,
                       ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)
    return t.withColumns({"code": F.trim("code"), "name": F.trim("name")})


def sic2(sic4) -> Column:
    return F.substring(sic4, 1, 2)


def sector_code(two: str = "sic2", four: str = "sic4") -> Column:
    """Business services (73) is looked up by its four-digit code."""
    return F.when(F.col(two) == "73", F.col(four)).otherwise(F.col(two))


def index_tickers(members: DataFrame, indices: list[str]) -> DataFrame:
    """Members of any of the indices, once each, in first-appearance order.

    Order: the index's place in the request, then the place in its list.
    """
    rank = F.array_position(F.array(*[F.lit(i) for i in indices]), F.col("index_name"))
    return (members.where(F.col("index_name").isin(indices)).dropna(subset=["ticker"])
            .groupBy("ticker").agg(F.min(F.struct(rank.alias("idx"), F.col("pos"))).alias("first"))
            .select("ticker", F.col("first.idx").cast("int").alias("first_index"),
                    F.col("first.pos").alias("first_pos")))


def sample_tickers(tickers: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """`n` distinct tickers in a repeatable random order; an error if there are not more than n."""
    distinct = tickers.select("ticker").distinct()
    have = distinct.count()
    if n >= have:
        raise ValueError(f"sample size {n} must be below the number of tickers ({have})")
    return distinct.orderBy(F.md5(F.concat("ticker", F.lit(str(seed))))).limit(n)
