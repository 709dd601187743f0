"""Registration of queries with their SQL oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from bourse.functions.columns import HALF_SHIFT, rnd

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(key: str, sql: str | None = None):
    """Register a query; without `sql` it is covered by a test instead of an oracle."""
    def add(fn: Query) -> Query:
        if key in QUERIES:
            raise ValueError(f"query {key!r} is registered twice")
        QUERIES[key] = fn
        if sql is not None:
            ORACLES[key] = sql
        return fn
    return add


def out(df: DataFrame, digits: int = 6, **by_column: int) -> DataFrame:
    """Round the double columns of a result (money columns to fewer digits)."""
    return df.select(*[
        rnd(f"`{f.name}`", by_column.get(f.name, digits)).alias(f.name) if isinstance(f.dataType, T.DoubleType) else f"`{f.name}`"
        for f in df.schema.fields])


def sql_round(expr: str, digits: int = 6) -> str:
    """The SQL form of `rnd`."""
    return f"round(({expr}) + {HALF_SHIFT * 10.0 ** -digits:.17e}, {digits}) + 0.0"


def sql(ctes: list[str] | str, select: str, doubles: str = "", digits: int = 6, **by_column: int) -> str:
    """WITH <ctes> <select>, the named double columns rounded like `out` does."""
    ctes = [ctes] if isinstance(ctes, str) else ctes
    names = doubles.split()
    rep = ", ".join(f"{sql_round(c, by_column.get(c, digits))} AS {c}" for c in names)
    body = f"SELECT * REPLACE ({rep}) FROM ({select}) res" if names else select
    return f"WITH RECURSIVE {', '.join(ctes)} {body}" if ctes else body
