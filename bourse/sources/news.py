"""News articles -> sentiment facts -> daily counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bourse.functions.columns import roll, safe_div
from bourse.operators.series import open_series

# fixed value: the sentiment columns of the feature table
SENTIMENTS = ["positive", "neutral", "negative", "bullish", "bearish", "hold", "mixed"]

# fixed value: headline words that count as negative
NEGATIVE_KEYWORDS = ["lawsuit", "fraud", "negative", "downturn", "decline", "investigation", "recall"]


def flatten_articles(articles: DataFrame) -> DataFrame:
    """One row per insight; articles without insights give no row."""
    return (articles.select(F.to_date(F.substring("published_utc", 1, 10)).alias("date"),
                            F.explode("insights").alias("i"))
            .select("i.ticker", "date", "i.sentiment"))


def daily_sentiment(news: DataFrame) -> DataFrame:
    """Counts per (ticker, date) with one column for each known sentiment."""
    return (news.groupBy("ticker", "date").pivot("sentiment", SENTIMENTS).agg(F.count(F.lit(1)))
            .fillna(0, SENTIMENTS))


def join_daily_sentiment(bars: DataFrame, daily: DataFrame) -> DataFrame:
    """Bars with their day's counts; days without news count zero."""
    return bars.join(daily, ["ticker", "date"], "left").fillna(0, SENTIMENTS)


def sentiment_ratios(daily: DataFrame) -> DataFrame:
    """Shares of positive / negative / neutral news, net sentiment, 3-row average."""
    tot = F.col("positive") + F.col("negative") + F.col("neutral")
    s = open_series(daily.withColumn("total_count", tot), memory=3)
    net = safe_div(F.col("positive") - F.col("negative"), F.col("total_count"))
    s = s.with_columns({
        "pos_sent_ratio": safe_div(F.col("positive"), F.col("total_count")),
        "neg_sent_ratio": safe_div(F.col("negative"), F.col("total_count")),
        "neu_sent_ratio": safe_div(F.col("neutral"), F.col("total_count")),
        "net_sentiment": net,
    })
    s = s.with_columns({"roll3_net": roll(F.avg, "net_sentiment", 3, s)})
    return s.close().fillna(0.0, ["pos_sent_ratio", "neg_sent_ratio", "neu_sent_ratio",
                                  "net_sentiment", "roll3_net"])


def headline_scores(headlines: DataFrame, keywords=None, title: str = "title") -> DataFrame:
    """Score 3 / 6 / 8 per ticker by the share of headlines with a negative word."""
    words = keywords or NEGATIVE_KEYWORDS
    low = F.lower(F.coalesce(F.col(title), F.lit("")))
    hit = F.lit(False)
    for w in words:
        hit = hit | F.contains(low, F.lit(w.lower()))
    return (headlines.groupBy("ticker")
            .agg(F.count(F.lit(1)).alias("headlines"), F.count_if(hit).alias("negative"))
            .withColumn("score", F.when(F.col("negative") > 0.3 * F.col("headlines"), 3)
                        .when(F.col("negative") > 0, 6).otherwise(8)))
