"""Scans of rows by an associative operation, against a loop."""

import numpy as np
import pytest
from helpers import daily, price_frame
from pyspark.sql import functions as F

from bourse.operators import scan

NAMES = ["p", "q"]
IDENTITY = {"p": 1, "q": 0}


def affine(first, then):
    """x -> p x + q, one after the other, modulo a prime: associative, not commutative."""
    return {"p": (then["p"] * first["p"]) % 10007, "q": (then["p"] * first["q"] + then["q"]) % 10007}


def looped(pdf, reverse):
    want = {}
    for t, g in pdf.sort_values("date", ascending=not reverse).groupby("ticker", sort=False):
        p, q = 1, 0
        for r in g.itertuples():
            a, b = int(r.volume) % 7 + 1, int(r.volume) % 11
            p, q = a * p % 10007, (a * q + b) % 10007
            want[t, str(r.date)[:19]] = (p, q)
    return want


def scanned(df, **options):
    a, b = (F.col("volume") % 7 + 1).cast("long"), (F.col("volume") % 11).cast("long")
    got = scan.scanned(df, {"p": a, "q": b}, affine, IDENTITY, **options)
    return {(r.ticker, str(r.date)[:19]): (r.p, r.q) for r in got.collect()}


@pytest.mark.parametrize("reverse", [False, True])
@pytest.mark.parametrize("chunk", [None, 2, 5, 64])
def test_daily_series(spark, reverse, chunk):
    pdf = price_frame({"A": 70, "B": 5, "C": 1})
    df = daily(spark, pdf)
    want = {(t, d[:10]): v for (t, d), v in looped(pdf, reverse).items()}
    assert scanned(df, reverse=reverse, chunk=chunk) == want


@pytest.mark.parametrize("chunk", [None, 3])
def test_hourly_series(spark, chunk):
    pdf = price_frame({"A": 90, "B": 7}, freq="h")
    assert scanned(spark.createDataFrame(pdf), chunk=chunk) == looped(pdf, False)


def test_no_rows(spark):
    df = daily(spark, price_frame({"A": 3})).where("ticker = 'Z'")
    assert scanned(df) == {} and scanned(df, chunk=4) == {}


def test_one_exchange_and_one_sort_on_a_daily_series(spark):
    df = daily(spark, price_frame({"A": 30}))
    plan = scan.scanned(df, {"p": F.lit(1), "q": F.lit(0)}, affine, IDENTITY)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and plan.count("Sort [") == 1


def test_strides_cover_long_chunks():
    assert scan.RADIX ** int(np.log(scan.CHUNK) / np.log(scan.RADIX) + 0.5) == scan.CHUNK
    assert scan.DAILY_ROWS > 700 * 366
