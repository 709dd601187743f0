"""Stored tables of bars: repeatable append by key, scan, bucketed layout, clone, key check."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from bourse.operators.series import Series, open_series
from bourse.session import stored, work_folder  # noqa: F401
from bourse.sources.bars import to_engine_names, to_storage_names

STORED = ["Date", "Ticker", "Open", "High", "Low", "Close", "Volume"]


def append_bars(bars: DataFrame, path: str, fmt: str = "parquet", replace: bool = False) -> None:
    """Add bars under their storage names to a table with one folder per year; (Ticker, Date) is its key.

    A key that is stored already keeps its row, so a load can be repeated, also one that broke off halfway; with
    `replace` the new row takes its place.  Rows of one batch that share a key count once, the first by their
    values.  Only the years of the batch are read, and of stored rows only the key: the batch is laid out by key
    once, for its own repeats and for the join.  `replace` writes the touched years anew and leaves the others
    alone.  A key is one row a day, so no partition is hot.
    """
    spark = bars.sparkSession
    out = to_storage_names(bars).select(*STORED).withColumn("Date", F.to_date("Date")).withColumn("Year", F.year("Date"))
    batch = stored(out, "append")
    if not batch.where("Ticker IS NULL OR Date IS NULL").isEmpty():
        raise ValueError("a bar without a ticker or a date has no key")
    # one row per calendar year
    years = [r.Year for r in batch.select("Year").distinct().collect()]
    if not years:
        return
    key = ["Ticker", "Date"]
    place = F.row_number().over(Window.partitionBy(*key).orderBy(*[c for c in STORED if c not in key]))
    new = batch.withColumn("_place", place).where("_place = 1").drop("_place")
    if has_table(spark, path):
        old = scan_table(spark, path, fmt).where(F.col("Year").isin(years))
        if replace:
            # stored before it is written over
            new = stored(new.unionByName(old.select(*new.columns).join(new.select(*key), key, "left_anti")), "append")
        else:
            new = new.join(old.select(*key), key, "left_anti")
    (new.hint("rebalance", "Year").sortWithinPartitions("Year", *key)
     .write.mode("overwrite" if replace else "append").option("partitionOverwriteMode", "dynamic")
     .partitionBy("Year").format(fmt).save(path))


def has_table(spark: SparkSession, path: str) -> bool:
    """Whether anything is stored below `path`."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    return fs.exists(folder) and any(f.getPath().getName().startswith("Year=") for f in fs.listStatus(folder))


def append_jdbc(bars: DataFrame, url: str, table: str, batch_rows: int = 10_000, **properties: str) -> None:
    """The same append into a relational table."""
    (to_storage_names(bars).select(*STORED)
     .write.mode("append").format("jdbc")
     .options(url=url, dbtable=table, batchsize=str(batch_rows), **properties).save())


def scan_table(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    return spark.read.format(fmt).load(path)


def scan_bars(spark: SparkSession, path: str, tickers=None, start=None, end=None, fmt: str = "parquet") -> DataFrame:
    """Stored bars of some tickers and dates, under the engine's column names.

    The date range also prunes the year folders.
    """
    df = scan_table(spark, path, fmt)
    if tickers is not None:
        df = df.where(F.col("Ticker").isin([tickers] if isinstance(tickers, str) else list(tickers)))
    if start is not None:
        df = df.where((F.col("Year") >= F.year(F.lit(start).cast("date"))) & (F.col("Date") >= F.lit(start).cast("date")))
    if end is not None:
        df = df.where((F.col("Year") <= F.year(F.lit(end).cast("date"))) & (F.col("Date") <= F.lit(end).cast("date")))
    return to_engine_names(df.select(*STORED))


def save_bucketed(bars: DataFrame, table: str, buckets: int, path: str | None = None, memory: int = 0,
                  chunk_rows: int | None = None) -> None:
    """A catalog table bucketed by series: window operators on it need no shuffle.

    Daily bars are bucketed by ticker.  A longer series (TIMESTAMP, or any with `chunk_rows`) is cut by time, each chunk with
    a copy of the `memory` rows before it, and bucketed by ticker and chunk, so the bars of a hot
    ticker lie in many buckets.  `bucketed_series` reads either.
    """
    s = open_series(bars, memory, chunk_rows=chunk_rows)
    w = (s.df.repartition(buckets, *s.keys).write.mode("overwrite")
         .bucketBy(buckets, *s.keys).sortBy(*s.keys, s.time))
    (w.option("path", path) if path else w).saveAsTable(table)


def bucketed_series(spark: SparkSession, table: str, time: str = "date") -> Series:
    """A table of `save_bucketed` as a series, ready for window columns; `close()` drops the copied rows."""
    df = spark.table(table)
    chunked = "_chunk" in df.columns
    return Series(df, ("ticker", "_chunk") if chunked else ("ticker",), time, chunked)


def scan_jdbc(spark: SparkSession, url: str, table: str, column: str | None = None, low=None, high=None,
              partitions: int = 1, **properties: str) -> DataFrame:
    """A relational table; with a numeric or date `column` and its range, read by `partitions` tasks."""
    reader = spark.read.format("jdbc").options(url=url, dbtable=table, **properties)
    if column is not None:
        reader = reader.options(partitionColumn=column, lowerBound=str(low), upperBound=str(high), numPartitions=str(partitions))
    return reader.load()


def duplicate_keys(df: DataFrame, *key: str) -> DataFrame:
    """Keys that occur more than once (empty when `key` is a primary key)."""
    return df.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def clone_table(spark: SparkSession, source: str, target: str, key=("Ticker", "Date"),
                fmt: str = "parquet") -> None:
    """Create a table like `source`, copy its rows, and require `key` to be unique.

    A table with year folders keeps them.
    """
    df = scan_table(spark, source, fmt)
    if not duplicate_keys(df, *key).isEmpty():
        raise ValueError(f"{source}: {key} is not unique, not cloned")
    if "Year" not in df.columns:
        df.write.mode("errorifexists").format(fmt).save(target)
        return
    (df.hint("rebalance", "Year").sortWithinPartitions("Year", *key)
     .write.mode("errorifexists").partitionBy("Year").format(fmt).save(target))
