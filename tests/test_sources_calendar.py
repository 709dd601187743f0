import datetime as dt

import pytest
from helpers import close_to, daily, ordered, price_frame
from pyspark.sql import functions as F

from bourse.operators import calendar as cal
from bourse.sources import bars as b
from bourse.sources import filings, news, reference, tables


def test_trading_date_follows_new_york_clock(spark):
    utc = dt.timezone.utc
    cases = [(dt.datetime(2024, 1, 10, 4, 59, tzinfo=utc), dt.date(2024, 1, 9)), (dt.datetime(2024, 1, 10, 5, 0, tzinfo=utc), dt.date(2024, 1, 10)),
             (dt.datetime(2024, 7, 10, 3, 59, tzinfo=utc), dt.date(2024, 7, 9)), (dt.datetime(2024, 7, 10, 4, 0, tzinfo=utc), dt.date(2024, 7, 10))]
    df = spark.createDataFrame([(int(t.timestamp() * 1000),) for t, _ in cases], "ms bigint")
    assert [r[0] for r in df.select(b.trading_date(F.col("ms"))).collect()] == [d for _, d in cases]


@pytest.mark.parametrize("span,n,want", [("minute", 15, "2024-03-13 10:30:00"), ("hour", 4, "2024-03-13 08:00:00"), ("day", 1, "2024-03-13"),
                                         ("week", 1, "2024-03-11"), ("month", 1, "2024-03-01"), ("quarter", 1, "2024-01-01"), ("year", 1, "2024-01-01")])
def test_bar_time(spark, span, n, want):
    df = spark.sql("SELECT TIMESTAMP_NTZ'2024-03-13 10:44:59' AS ts")
    assert str(df.select(b.bar_time(F.col("ts"), span, n).cast("string")).first()[0]) == want


@pytest.mark.parametrize("tie", ["bigint", "string"])
def test_first_and_last_price_by_time_and_tie(spark, tie):
    """Integer ties hash, also with times before 1970 and ids of any size; others are compared as they are."""
    rows = [("A", t, i, float(p)) for p, (t, i) in enumerate([("1969-12-31 10:00:00", 5), ("1969-12-31 10:00:00", -3), ("1969-12-31 12:00:00", 2 ** 62), ("1969-12-31 12:00:00", 7),
                                                             ("2001-01-01 00:00:00", 1), ("2001-01-01 23:59:59.999999", 1), ("2001-01-01 23:59:59.999998", 9)])]
    df = spark.createDataFrame(rows, "ticker string, ts string, id bigint, px double").selectExpr("ticker", "CAST(ts AS timestamp) ts", f"CAST(id AS {tie}) id", "px", "1.0D AS size")
    got = b.resample(df)
    assert [(str(r.date), r.open, r.close) for r in got.orderBy("date").collect()] == [("1969-12-31", 1.0, 2.0 if tie == "bigint" else 3.0), ("2001-01-01", 4.0, 5.0)]
    assert ("SortAggregate" in got._jdf.queryExecution().executedPlan().toString()) == (tie == "string")


def test_select_bars_limits(spark):
    df = daily(spark, price_frame({"A": 20, "B": 20}))
    assert b.select_bars(df, "A").select("ticker").distinct().collect()[0][0] == "A"
    assert b.select_bars(df, ["A", "B"], "2001-03-07", "2001-03-08").count() == 4
    assert b.select_bars(df, end="2012-03-07", years=11).count() == b.select_bars(df, start="2001-03-10").count()


def test_append_scan_clone(spark, tmp_path):
    df = daily(spark, price_frame({"A": 20, "B": 4}))
    path, copy = str(tmp_path / "t"), str(tmp_path / "c")
    tables.append_bars(df, path)
    tables.clone_table(spark, path, copy)
    assert tables.scan_table(spark, copy).count() == 24
    plan = tables.scan_bars(spark, copy, "A", "2001-03-10", "2001-03-12")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(Year" in plan
    tables.append_bars(df.limit(1), path)
    assert tables.duplicate_keys(tables.scan_table(spark, path), "Ticker", "Date").isEmpty()
    tables.scan_table(spark, path).limit(1).write.mode("append").partitionBy("Year").parquet(path)
    assert tables.duplicate_keys(tables.scan_table(spark, path), "Ticker", "Date").count() == 1
    with pytest.raises(ValueError):
        tables.clone_table(spark, path, str(tmp_path / "d"))


def test_stored_bars_prune_folders_columns_and_rows(spark, tmp_path):
    path = str(tmp_path / "t")
    tables.append_bars(daily(spark, price_frame({"A": 800, "B": 800})), path)
    df = tables.scan_bars(spark, path, "A", "2002-01-10", "2002-02-10").select("date", "close")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(Year" in plan and "GreaterThanOrEqual(Date,2002-01-10)" in plan and "EqualTo(Ticker,A)" in plan
    assert "Open" not in plan.split("ReadSchema")[1]
    assert df.count() == 32


@pytest.mark.parametrize("replace", [False, True])
def test_loads_can_be_repeated(spark, tmp_path, replace):
    path = str(tmp_path / "t")
    pdf = price_frame({"A": 400, "B": 10})
    first, second = daily(spark, pdf[pdf.date < "2002-02-01"]), daily(spark, pdf[pdf.date > "2001-12-01"].assign(close=1.0))
    tables.append_bars(first.where("false"), path, replace=replace)
    assert not tables.has_table(spark, path)
    for batch in (first, second, second.unionByName(second), first.where("false"), second):
        tables.append_bars(batch, path, replace=replace)
    got = tables.scan_table(spark, path)
    assert got.count() == len(pdf) and tables.duplicate_keys(got, "Ticker", "Date").isEmpty()
    assert got.where("Close = 1").count() == (pdf.date > ("2001-12-01" if replace else "2002-01-31")).sum()


def test_a_load_leaves_other_years_alone(spark, tmp_path):
    import glob
    path = str(tmp_path / "t")
    df = daily(spark, price_frame({"A": 700}))
    tables.append_bars(df, path)
    files = set(glob.glob(f"{path}/Year=2001/*.parquet"))
    tables.append_bars(df.where("year(date) = 2002").withColumn("close", F.lit(2.0)), path, replace=True)
    assert files == set(glob.glob(f"{path}/Year=2001/*.parquet"))
    assert tables.scan_table(spark, path).where("Close = 2").count() == 365


def test_equal_keys_of_a_batch_count_once_and_keys_are_needed(spark, tmp_path):
    df = daily(spark, price_frame({"A": 3}))
    both = df.unionByName(df.withColumn("open", F.lit(0.5)))
    tables.append_bars(both, str(tmp_path / "t"))
    assert [r.Open for r in tables.scan_table(spark, str(tmp_path / "t")).collect()] == [0.5] * 3
    for c in ("ticker", "date"):
        with pytest.raises(ValueError):
            tables.append_bars(df.withColumn(c, F.lit(None).cast(df.schema[c].dataType)), str(tmp_path / "u"))


@pytest.mark.parametrize("freq", ["D", "h"])
def test_window_columns_on_a_bucketed_table_need_no_shuffle(spark, tmp_path, freq):
    """A hot ticker's hourly bars lie in several buckets, with the rows they look back on."""
    from bourse.operators.indicators import add_indicators, add_to_series, memory_of
    names = ["z_score", "macd", "adx"] if freq == "D" else ["z_score", "b_percent"]
    pdf = price_frame({"A": 400, "B": 60, "C": 30}, freq=freq)
    df = daily(spark, pdf) if freq == "D" else spark.createDataFrame(pdf)
    tables.save_bucketed(df, "bucketed_bars", 8, str(tmp_path / "b"), memory_of(names), None if freq == "D" else 64)
    try:
        s = tables.bucketed_series(spark, "bucketed_bars")
        got = add_to_series(lambda memory: s, s.df, names)
        assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
        want = ordered(add_indicators(df, names))
        for n in names:
            close_to(ordered(got)[n], want[n])
        if freq == "h":
            files = spark.table("bucketed_bars").where("ticker = 'A'").select(F.input_file_name()).distinct().count()
            assert files > 1
    finally:
        spark.sql("DROP TABLE bucketed_bars")


def test_items_of_a_filing_follow_its_keys(spark):
    rows = [("a", '{"x":{"p":{"value":1.5,"unit":"USD"},"q":{"value":"n/a"}},"y":{"p":{"unit":"EUR"}},"z":[1,2],"w":3}'), ("b", None), ("c", "{broken"), ("d", "{}"),
            ("e", '{"x":{"p":{"value":null}}}')]
    items = filings.filing_items(spark.createDataFrame(rows, "ticker string, financials string"))
    got = sorted((r.ticker, r.section, r.item, r.value, r.unit) for r in items.collect())
    assert got == [("a", "x", "p", 1.5, "USD"), ("a", "x", "q", None, None), ("a", "y", "p", None, "EUR"), ("e", "x", "p", None, None)]
    assert filings.item_names(items) == {"x": ("p", "q"), "y": ("p",)}
    flat = {r.ticker: r for r in filings.flat_items(items, ["ticker"]).collect()}
    assert flat["a"]["x.p.value"] == 1.5 and flat["a"]["y.p.value"] is None and flat["e"]["x.p.value"] is None


def test_work_folder_is_below_the_shared_folder(spark, tmp_path):
    class Conf:
        def __init__(self, value):
            self.value = value

        def get(self, key, default=None):
            return self.value if key == "spark.checkpoint.dir" and self.value else default

    class Context:
        def __init__(self, master):
            self.master = master

    class Session:
        _jvm, _jsc = spark._jvm, spark._jsc

        def __init__(self, value, master):
            self.conf, self.sparkContext = Conf(value), Context(master)

    assert tables.work_folder(Session(f"file://{tmp_path}/", "yarn"), "x").startswith(f"file:{tmp_path}/x-")
    assert "bourse-" in tables.work_folder(Session(None, "local[2]"), "x")
    with pytest.raises(ValueError):
        tables.work_folder(Session(None, "local-cluster[2,1,1024]"), "x")


def test_thresholds_csv_keeps_codes_as_text(spark, tmp_path):
    p = tmp_path / "m.csv"
    p.write_text("code,name," + ",".join(reference.METRICS) + "\n01, Crops," + ",".join(["1.5"] * 17) + ",\n 99,Default," + ",".join(["2"] * 18) + "\n")
    rows = {r.code: r for r in reference.read_thresholds(spark, str(p)).collect()}
    assert set(rows) == {"01", "99"} and rows["01"].name == "Crops" and rows["01"].rd_intensity is None


def test_sample_needs_more_tickers_than_it_takes(spark):
    df = spark.createDataFrame([(f"T{i}",) for i in range(5)] * 2, "ticker string")
    assert reference.sample_tickers(df, 3, 1).distinct().count() == 3
    assert reference.sample_tickers(df, 3, 1).collect() == reference.sample_tickers(df, 3, 1).collect()
    with pytest.raises(ValueError):
        reference.sample_tickers(df, 5)


def test_articles_without_insights_give_no_rows(spark):
    df = spark.createDataFrame([("2024-01-02T03:00:00Z", [("A", "positive"), ("B", "hold")]), ("2024-01-02T04:00:00Z", None), ("2024-01-03T00:00:00Z", [])],
                               "published_utc string, insights array<struct<ticker:string,sentiment:string>>")
    flat = news.flatten_articles(df)
    assert flat.count() == 2
    d = {r.ticker: r for r in news.daily_sentiment(flat).collect()}
    assert d["A"].positive == 1 and d["A"].bearish == 0 and d["B"].hold == 1


def test_headline_scores(spark):
    rows = [("A", "Fraud probe"), ("A", "ok"), ("B", "fine"), ("B", None)] + [("C", "good")] * 9 + [("C", "a RECALL")]
    got = {r.ticker: r.score for r in news.headline_scores(spark.createDataFrame(rows, "ticker string, title string")).collect()}
    assert got == {"A": 3, "B": 8, "C": 6}


def test_filings_missing_items_are_null_then_zero(spark):
    sections = {"income_statement": ("revenues", "net_income_loss"), "balance_sheet": ("assets",)}
    df = spark.createDataFrame([("A", '{"income_statement":{"revenues":{"value":5.5,"unit":"USD"}}}')], "ticker string, financials string")
    flat = filings.flatten_filings(df, sections)
    assert flat.columns == ["ticker", "income_statement.revenues.value", "income_statement.net_income_loss.value", "balance_sheet.assets.value"]
    assert list(flat.first())[1:] == [5.5, None, None]
    assert list(filings.fill_zero(flat).first())[1:] == [5.5, 0.0, 0.0]


def test_holidays_against_pandas(spark):
    from dateutil.easter import easter
    from pandas.tseries.holiday import USFederalHolidayCalendar
    bounds = spark.sql("SELECT DATE'1990-01-01' AS start, DATE'2040-12-31' AS end")
    got = {r.date for r in cal.market_holidays(bounds).collect()}
    want = {d.date() for d in USFederalHolidayCalendar().holidays("1990-01-01", "2040-12-31")}
    want |= {easter(y) - dt.timedelta(days=2) for y in range(1990, 2041)}
    assert got == want


def test_business_days_roll_back(spark):
    bounds = spark.sql("SELECT DATE'2024-03-25' AS start, DATE'2024-04-02' AS end")
    back = {r.date: r.business_day for r in cal.previous_business_day(cal.days(bounds), cal.market_holidays(bounds)).collect()}
    assert back[dt.date(2024, 3, 29)] == dt.date(2024, 3, 28)  # Good Friday
    assert back[dt.date(2024, 3, 31)] == dt.date(2024, 3, 28)
    assert back[dt.date(2024, 4, 1)] == dt.date(2024, 4, 1)
