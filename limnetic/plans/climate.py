"""Ice, weather, degree-days and the year-level feature matrix."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from limnetic.functions.calendar import (
    date_from_parts,
    month_long,
    season_day,
    season_year,
    with_calendar,
)
from limnetic.operators.aggregates import strict
from limnetic.operators.joins import natural_join
from limnetic.operators.ordered import running_total
from limnetic.operators.reshape import pivot_many, pivot_values, unpivot_long
from limnetic.operators.statistics import regression_summary

ICE_MONTHS = ("November", "December", "January", "February", "March", "April", "May", "June")
YEAR_MONTHS = (
    "January", "February", "March", "April", "May", "June", "July", "August", "September",
    "October", "November", "December",
)


def _month_name(month: Column) -> Column:
    return F.element_at(F.array(*[F.lit(m) for m in YEAR_MONTHS]), month)


def ice_long(wide: DataFrame, years: Sequence[str]) -> DataFrame:
    """Month-day rows by year columns to one row per day, on the season axis.

    Day numbers are those of a leap year's calendar of (month, day) rows.
    """
    key = F.regexp_replace("ice_year", "[^0-9]", "").cast("int")
    long = unpivot_long(wide, ["m", "d"], years, "ice_year", "ice_cover", key)
    jday = F.dayofyear(date_from_parts(F.lit(2000), F.col("m"), F.col("d")))
    long = long.withColumn("jday", jday)
    year = season_year(F.col("ice_year"), F.col("jday"))
    return long.select(
        "ice_year",
        F.col("m").alias("month"),
        _month_name(F.col("m")).alias("month_long"),
        "jday",
        year.alias("year"),
        season_day(F.col("jday")).alias("jday2"),
        date_from_parts(year, F.col("m"), F.col("d")).alias("date"),
        "ice_cover",
    )


def ice_monthly(long: DataFrame, from_year: int) -> DataFrame:
    return (
        long.filter(F.col("ice_year") >= from_year)
        .groupBy(F.col("ice_year").alias("year"), "month")
        .agg(
            F.min("ice_cover").alias("ice_min"),
            F.max("ice_cover").alias("ice_max"),
            F.avg("ice_cover").alias("ice_mean"),
        )
    )


def weather_monthly(weather: DataFrame) -> DataFrame:
    """Monthly wind and air temperature over all stations."""
    return weather.groupBy(F.year("date").alias("year"), F.month("date").alias("month")).agg(
        F.min("rwsp").alias("wspd_min"),
        F.max("rwsp").alias("wspd_max"),
        F.avg("rwsp").alias("wspd_mean"),
        F.sum("rwsp").alias("wspd_sum"),
        F.min("atmp").alias("airt_min"),
        F.max("atmp").alias("airt_max"),
        F.avg("atmp").alias("airt_mean"),
    )


def degree_days(daily: DataFrame) -> DataFrame:
    """Daily surface temperature and its running sum within the year."""
    days = with_calendar(daily.select("date", F.col("superior").alias("surft")), "date")
    return running_total(days, ["year"], "date", "surft", "surfdd")


def degree_days_monthly(days: DataFrame, from_year: int) -> DataFrame:
    return (
        days.filter(F.col("year") >= from_year)
        .groupBy("year", "month")
        .agg(
            *[
                fn(x).alias(f"{x}_{name}")
                for x in ("surft", "surfdd")
                for name, fn in (("min", F.min), ("max", F.max), ("mean", F.avg))
            ]
        )
    )


def dd_vs_length(days: DataFrame, density_months: DataFrame, length_months: DataFrame) -> DataFrame:
    """Largest degree-day sum of a month beside its mean density and mean length."""
    keys = ["year", "month_long"]
    months = days.groupBy(*keys).agg(strict(F.max, F.col("surfdd")).alias("max_dd"))
    out = natural_join(months, density_months, "left", keys)
    out = natural_join(out, length_months.select(*keys, "mean_l"), "left", keys)
    return out.dropna(subset=["noha_mean", "mean_l"])


def dd_length_daily(lengths: DataFrame, days: DataFrame) -> DataFrame:
    """Mean length of each sampling day beside its degree-days and temperature."""
    means = lengths.groupBy("date").agg(strict(F.avg, F.col("length")).alias("mean_l"))
    out = natural_join(means, days.select("date", "surfdd", "surft"), "left", ["date"], bounded=True)
    return out.select(
        "date", "mean_l", F.col("surfdd").alias("mean_dd"), F.col("surft").alias("mean_t"),
        F.month("date").alias("month"), F.year("date").alias("year"), month_long(F.col("date")).alias("month_long"),
    )


def dd_regressions(monthly: DataFrame, lengths: DataFrame, days: DataFrame) -> DataFrame:
    """Mean length against degree-days, by month and by sampling day."""
    dated = natural_join(
        lengths.groupBy("date").agg(strict(F.avg, F.col("length")).alias("mean_l")),
        days.select("date", "surfdd"),
        "left",
        ["date"],
    )
    a = regression_summary(monthly, [], F.col("max_dd"), F.col("mean_l")).withColumn("model", F.lit("month"))
    b = regression_summary(dated, [], F.col("surfdd"), F.col("mean_l")).withColumn("model", F.lit("day"))
    return a.unionByName(b)


FEATURES = ("ice_max", "wspd_mean", "airt_mean", "surft_mean", "surfdd_max")


def feature_matrix(
    weather: DataFrame,
    ice: DataFrame,
    temperature: DataFrame,
    density_months: DataFrame,
    skip_year: int,
    months: Sequence[str] = YEAR_MONTHS[:7],
) -> DataFrame:
    """One row per year: monthly climate in columns, spring densities as targets."""
    table = natural_join(weather, ice, "left", ["year", "month"])
    table = natural_join(table, temperature, "left", ["year", "month"])
    table = table.filter(F.col("month") <= len(months)).withColumn("name", _month_name(F.col("month")))
    wide = pivot_many(table.select("year", "name", *FEATURES), ["year"], "name", months, FEATURES)
    targets = pivot_values(density_months, ["year"], "month_long", ["May", "June", "July"], "noha_mean")
    return natural_join(wide, targets, "left", ["year"]).filter(F.col("year") != skip_year)


def tow_features(effort: DataFrame) -> DataFrame:
    """Tow-level numeric predictors; what is not known stays missing."""
    return effort.select(
        "op_id",
        F.col("jday").cast("double").alias("jday"),
        F.col("year").cast("double").alias("year"),
        "mid_depth",
        "mid_lat",
        "shore_distance",
    )
