"""Calendar tables from rules: day range, market holidays, business days."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def days(bounds: DataFrame, start: str = "start", end: str = "end") -> DataFrame:
    """Every calendar day of a one-row (start, end) table."""
    return bounds.select(F.explode(F.sequence(F.col(start), F.col(end))).alias("date"))


def easter(year: Column) -> Column:
    """Easter Sunday of the Gregorian calendar (Meeus/Jones/Butcher)."""
    div = lambda a, b: F.floor(a / b)
    a = year % 19
    b, c = div(year, 100), year % 100
    d, e = div(b, 4), b % 4
    g = div(8 * b + 13, 25)
    h = (19 * a + b - d - g + 15) % 30
    i, k = div(c, 4), c % 4
    m = (32 + 2 * e + 2 * i - h - k) % 7
    n = div(a + 11 * h + 22 * m, 451)
    p = h + m - 7 * n + 114
    return F.make_date(year.cast("int"), div(p, 31).cast("int"), ((p % 31) + 1).cast("int"))


def _nth_weekday(year: Column, month: int, day: str, nth: int) -> Column:
    before = F.date_sub(F.make_date(year, F.lit(month), F.lit(1)), 1)
    return F.date_add(F.next_day(before, day), 7 * (nth - 1))


def _last_weekday(year: Column, month: int, day: str) -> Column:
    return F.next_day(F.date_sub(F.last_day(F.make_date(year, F.lit(month), F.lit(1))), 7), day)


def _observed(date: Column) -> Column:
    """Saturday moves to Friday, Sunday to Monday."""
    wd = F.weekday(date)
    return F.when(wd == 5, F.date_sub(date, 1)).when(wd == 6, F.date_add(date, 1)).otherwise(date)


def _fixed(year: Column, month: int, day: int) -> Column:
    return _observed(F.make_date(year, F.lit(month), F.lit(day)))


# fixed value: US federal holidays, each with the first year it applies to
def _rules(y: Column) -> list[tuple[str, int, Column]]:
    return [
        ("New Year's Day", 0, _fixed(y, 1, 1)),
        ("Martin Luther King Jr. Day", 1986, _nth_weekday(y, 1, "Mon", 3)),
        ("Presidents Day", 1971, _nth_weekday(y, 2, "Mon", 3)),
        ("Good Friday", 0, F.date_sub(easter(y), 2)),
        ("Memorial Day", 1971, _last_weekday(y, 5, "Mon")),
        ("Juneteenth", 2021, _fixed(y, 6, 19)),
        ("Independence Day", 0, _fixed(y, 7, 4)),
        ("Labor Day", 0, _nth_weekday(y, 9, "Mon", 1)),
        ("Columbus Day", 0, _nth_weekday(y, 10, "Mon", 2)),
        ("Veterans Day", 0, _fixed(y, 11, 11)),
        ("Thanksgiving", 0, _nth_weekday(y, 11, "Thu", 4)),
        ("Christmas", 0, _fixed(y, 12, 25)),
    ]


def market_holidays(bounds: DataFrame, start: str = "start", end: str = "end") -> DataFrame:
    """(date, holiday) between the two dates of a one-row table.

    The year after the end is generated too: its New Year's Day may be observed
    on the last day of December.
    """
    years = bounds.select("*", F.explode(F.sequence(F.year(start), F.year(end) + 1)).alias("_y"))
    y = F.col("_y")
    entries = F.array(*[F.struct(F.when(y >= since, d).alias("date"), F.lit(n).alias("holiday"))
                        for n, since, d in _rules(y)])
    return (years.select(start, end, F.explode(entries).alias("h"))
            .where(F.col("h.date").between(F.col(start), F.col(end)))
            .select("h.date", "h.holiday"))


def business_days(calendar: DataFrame, holidays: DataFrame) -> DataFrame:
    """Weekdays that are not holidays (left anti join)."""
    return calendar.where(F.weekday("date") < 5).join(holidays.select("date"), "date", "left_anti")


def previous_business_day(calendar: DataFrame, holidays: DataFrame) -> DataFrame:
    """(date, business_day): each calendar day rolled back to a business day.

    The calendar holds one row per day, so ordering it in one window is small.
    """
    open_days = business_days(calendar, holidays).select("date", F.col("date").alias("_open"))
    w = Window.orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    return (calendar.join(open_days, "date", "left")
            .select("date", F.last("_open", ignorenulls=True).over(w).alias("business_day")))
