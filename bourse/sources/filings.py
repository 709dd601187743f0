"""Filings: nested JSON statements -> flat `section.item.value` columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

HEADER = ["ticker", "cik", "company_name", "fiscal_year", "fiscal_period", "end_date", "filing_date"]


def statement_schema(sections: dict[str, tuple[str, ...]]) -> T.StructType:
    """STRUCT<section: STRUCT<item: STRUCT<value: DOUBLE>>>"""
    value = T.StructType([T.StructField("value", T.DoubleType())])
    return T.StructType([
        T.StructField(sec, T.StructType([T.StructField(i, value) for i in items]))
        for sec, items in sections.items()])


def flatten_filings(filings: DataFrame, sections: dict[str, tuple[str, ...]], column: str = "financials") -> DataFrame:
    """Parse the statement text once and select the items; absent items are NULL.

    The header stays in the same row, so no join by row position is needed.
    """
    parsed = filings.withColumn("_f", F.from_json(column, statement_schema(sections)))
    return parsed.select(
        *[c for c in filings.columns if c != column],
        *[F.col(f"_f.{sec}.{i}.value").alias(f"{sec}.{i}.value") for sec, items in sections.items() for i in items])


def filing_items(filings: DataFrame, column: str = "financials") -> DataFrame:
    """One row per item that a filing holds, whatever its name: header, section, item, value, unit.

    The text is parsed to a VARIANT and taken apart by its own keys, so nothing has to be declared.  A value that is
    no number, or an item without one, is NULL; a text that is no JSON, and a section that holds no items, give no rows.
    """
    spark, header = filings.sparkSession, [c for c in filings.columns if c != column]
    top = spark.tvf.variant_explode(F.try_parse_json(F.col(column)).outer()).toDF("_p", "section", "_items")
    low = spark.tvf.variant_explode(F.col("_items").outer()).toDF("_q", "item", "_fields")
    each = filings.lateralJoin(top).lateralJoin(low)
    named = F.col("item").isNotNull()  # an array has places instead of names
    return each.where(named).select(
        *header, "section", "item", F.try_variant_get("_fields", "$.value", "double").alias("value"),
        F.try_variant_get("_fields", "$.unit", "string").alias("unit"))


def item_names(items: DataFrame) -> dict[str, tuple[str, ...]]:
    """The sections and items that occur, by name: a vocabulary of columns, not of rows."""
    out: dict[str, list[str]] = {}
    for r in items.groupBy("section", "item").count().orderBy("section", "item").collect():
        out.setdefault(r.section, []).append(r.item)
    return {s: tuple(i) for s, i in out.items()}


def flat_items(items: DataFrame, key: list[str], sections: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """The `section.item.value` columns of `flatten_filings`, built from `filing_items`; by default all that occur.

    One aggregation by `key` with map-side partials; of repeated items of a key the highest value counts.
    """
    sections = item_names(items) if sections is None else sections
    at = lambda sec, i: (F.col("section") == sec) & (F.col("item") == i)
    return items.groupBy(*key).agg(*[F.max(F.when(at(sec, i), F.col("value"))).alias(f"{sec}.{i}.value")
                                     for sec, names in sections.items() for i in names])


def filed_between(filings: DataFrame, start, end) -> DataFrame:
    return filings.where(F.col("filing_date").between(F.lit(start).cast("date"), F.lit(end).cast("date")))


def value_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c.endswith(".value")]


def select_value_columns(df: DataFrame, key=("ticker", "fiscal_year", "fiscal_period")) -> DataFrame:
    return df.select(*key, *[F.col(f"`{c}`") for c in value_columns(df)])


def fill_zero(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Missing numbers -> 0."""
    cols = columns or value_columns(df)
    return df.withColumns({c: F.coalesce(F.col(f"`{c}`"), F.lit(0.0)) for c in cols})


def in_periods(df: DataFrame, periods) -> DataFrame:
    return df.where(F.col("fiscal_period").isin(list(periods)))


def line_items(df: DataFrame, items: list[str], key=("ticker",)) -> DataFrame:
    """The requested items that the table has; unknown names are left out."""
    return df.select(*key, *[F.col(f"`{i}`") for i in items if i in df.columns])
