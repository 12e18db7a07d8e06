"""Dates: parsing, parts, labels and the season axis."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def parse_dmy(text: Column) -> Column:
    """``03-Feb-95`` to a date; years 70-99 fall in the 1900s, bad text is NULL."""
    day = F.try_to_date(text, "dd-MMM-yy")
    return F.when(F.year(day) >= 2070, F.add_months(day, -1200)).otherwise(day)


def parse_ymd(text: Column) -> Column:
    return F.try_to_date(text, "yyyy-MM-dd")


def date_from_parts(year: Column, month: Column, day: Column) -> Column:
    """A date, or NULL where the parts make none."""
    text = F.format_string("%04d-%02d-%02d", year, month, day)
    whole = year.isNotNull() & month.isNotNull() & day.isNotNull()
    return F.when(whole, F.try_to_date(text, "yyyy-MM-dd"))


def week_of_year(day: Column) -> Column:
    """Seven-day blocks counted from 1 January (1 to 53), not ISO weeks."""
    return F.floor((F.dayofyear(day) - 1) / 7).cast("int") + 1


def month_long(day: Column) -> Column:
    return F.date_format(day, "MMMM")


def month_short(day: Column) -> Column:
    return F.date_format(day, "MMM")


def weekday(day: Column) -> Column:
    return F.date_format(day, "EEEE")


def season_year(year: Column, jday: Column) -> Column:
    """Winter belongs to the year it began in; day 250 itself has no season."""
    return F.when(jday > 250, year - 1).when(jday < 250, year)


def season_day(jday: Column) -> Column:
    return F.when(jday < 250, jday).when(jday > 250, jday - 366)


def axis_date(jday: Column, origin: str = "2014-01-01") -> Column:
    return F.date_add(F.lit(origin).cast("date"), jday)


def long_label(day: Column) -> Column:
    return F.date_format(day, "EEEE, MMMM dd, yyyy")


def with_calendar(df: DataFrame, date: str) -> DataFrame:
    """Add the date parts every cleaned survey table carries."""
    d = F.col(date)
    return df.withColumns(
        {
            "day": F.day(d),
            "week": week_of_year(d),
            "month": F.month(d),
            "month_short": month_short(d),
            "month_long": month_long(d),
            "jday": F.dayofyear(d),
            "year": F.year(d),
            "date1": F.concat_ws(" ", month_short(d), F.day(d).cast("string")),
        }
    )
