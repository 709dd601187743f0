"""One row per ticker: its newest periods (newest first) and its sector thresholds."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bourse.operators.fundamentals import RATIO_COLUMNS, attach_thresholds, latest_periods


def build(fund: DataFrame, thresholds: DataFrame, period: str = "Annual") -> DataFrame:
    """ticker, company_name, sic codes, `p` = array of period structs, `t_*` thresholds.

    At most ten periods per ticker are collected (`latest_periods` trims before).
    """
    top = latest_periods(fund, period)
    row = F.struct("rn", "fiscal_year", "fiscal_period", "company_name", "sic2", "sic4", *RATIO_COLUMNS)
    snap = top.groupBy("ticker").agg(F.array_sort(F.collect_list(row)).alias("p"))
    snap = snap.withColumns({c: F.col("p")[0][c] for c in ("company_name", "sic2", "sic4")})
    snap = attach_thresholds(snap, thresholds).withColumn("period", F.lit(period))
    return with_side_inputs(snap)


# fixed value: what the scorers assume without insider trades and headlines
NO_INSIDERS_SCORE, NO_INSIDERS_POINTS, NO_NEWS_SCORE = 5, 2, 5


def with_side_inputs(snap: DataFrame, insiders: DataFrame | None = None,
                     headlines: DataFrame | None = None) -> DataFrame:
    """Add insider and headline scores; the neutral constants where there are none."""
    df = snap.drop("insider_score", "insider_points", "sentiment_score")
    if insiders is not None:
        df = df.join(insiders.select("ticker", F.col("score").alias("insider_score"),
                                     F.col("points").alias("insider_points")), "ticker", "left")
    else:
        df = df.withColumns({"insider_score": F.lit(None).cast("int"), "insider_points": F.lit(None).cast("int")})
    if headlines is not None:
        df = df.join(headlines.select("ticker", F.col("score").alias("sentiment_score")), "ticker", "left")
    else:
        df = df.withColumn("sentiment_score", F.lit(None).cast("int"))
    return df.fillna({"insider_score": NO_INSIDERS_SCORE, "insider_points": NO_INSIDERS_POINTS,
                      "sentiment_score": NO_NEWS_SCORE})


class Snap:
    """Accessors on a snapshot row; repeated requests share one expression."""

    def __init__(self):
        self._memo: dict[tuple, Column] = {}
        self.n = F.size("p")

    def _once(self, *key, make: Callable[[], Column]) -> Column:
        if key not in self._memo:
            self._memo[key] = make()
        return self._memo[key]

    def x(self, item: str, i: int = 0) -> Column:
        """Value of the i-th newest period, NULL if there is none."""
        return self._once("x", item, i, make=lambda: F.expr(f"get(p, {i}).{item}"))

    def oldest(self, item: str) -> Column:
        return self._once("oldest", item, make=lambda: F.expr(f"get(p, size(p) - 1).{item}"))

    def all(self, item: str) -> Column:
        return self._once("all", item, make=lambda: F.expr(f"p.{item}"))

    def t(self, metric: str) -> Column:
        return self._once("t", metric, make=lambda: F.col(f"t_{metric}"))

    def count(self, item: str, pred: Callable[[Column], Column]) -> Column:
        return F.size(F.filter(self.all(item), pred))

    def any_nonzero(self, item: str) -> Column:
        return self._once("any", item, make=lambda: F.expr(f"exists(p.{item}, v -> v <> 0)"))

    def majority(self, item: str, pred) -> Column:
        return self.count(item, pred) >= F.floor(self.n / 2) + 1

    def sum(self, item: str) -> Column:
        return self._once("sum", item, make=lambda: add_up(self.all(item)))

    def mean(self, item: str) -> Column:
        return self._once("mean", item, make=lambda: self.sum(item) / self.n)

    def pairs(self, item: str, fn: Callable[[Column, Column], Column]) -> Column:
        """fn(newer, older) over neighbouring periods, newest pair first."""
        newer = self._once("newer", item, make=lambda: F.expr(f"slice(p.{item}, 1, size(p) - 1)"))
        older = self._once("older", item, make=lambda: F.expr(f"slice(p.{item}, 2, size(p) - 1)"))
        return F.zip_with(newer, older, fn)


def add_up(arr: Column) -> Column:
    return F.aggregate(arr, F.lit(0.0), lambda acc, v: acc + v)


def mean_of(arr: Column) -> Column:
    return add_up(arr) / F.nullif(F.size(arr), F.lit(0))
