"""Cleaning of tows, effort tables and fish density."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from limnetic.functions import scalars
from limnetic.functions.calendar import with_calendar
from limnetic.operators.aggregates import strict
from limnetic.operators.joins import lookup_join, natural_join
from limnetic.operators.reshape import first_per_key
from limnetic.sources.files import append_all

# The species counted as ciscoes, with the code for an empty tow.
CISCOES = (202, 203, 204, 206, 208, 210, 211, 217, 218)
CISCOES_OR_NONE = (0, *CISCOES)

EFFORT = [
    "op_id", "target", "date", "tow_time", "date1", "day", "week", "month", "month_short",
    "month_long", "jday", "year", "gear", "location", "mid_lat", "mid_lon", "mid_depth",
    "fishing_depth", "shore_distance",
]


def filled(tow: DataFrame) -> DataFrame:
    """Begin and end positions filled from one another, their midpoints, ``date``."""
    c = F.col
    pairs = {}
    for beg, end in (("beg_lat", "end_lat"), ("beg_lon", "end_lon")):
        pairs |= {beg: scalars.either(c(beg), c(end)), end: scalars.either(c(end), c(beg))}
    return (
        tow.withColumnRenamed("op_date", "date")
        .withColumns(pairs)
        .withColumns(
            {
                "mid_lat": scalars.midpoint(c("beg_lat"), c("end_lat")),
                "mid_lon": scalars.midpoint(c("beg_lon"), c("end_lon")),
            }
        )
    )


def neuston_tows(tow: DataFrame) -> DataFrame:
    """Surface tows: both depths must be known for a mid depth."""
    return filled(tow).withColumns(
        {
            "mid_depth": scalars.midpoint(F.col("beg_depth"), F.col("end_depth")),
            "fishing_depth": F.lit(0.5),
            "gear": F.lit("Neuston"),
        }
    )


def neuston_clean(tow: DataFrame, site: DataFrame) -> DataFrame:
    """Cleaned tows with distance from shore and date parts."""
    sited = lookup_join(neuston_tows(tow), site, "location", "shore_distance")
    return with_calendar(sited, "date")


def bt_daily(bt: DataFrame, from_year: int) -> DataFrame:
    """Bathythermograph means per station and day; one missing cast voids a mean."""
    means = {"tsurface": "surface_t", "t3m": "t3m", "chl_surface": "chl_surf", "chl3m": "chl3m"}
    return (
        bt.filter(F.year("date") >= from_year)
        .groupBy("location", "date")
        .agg(*[strict(F.avg, F.col(src)).alias(out) for out, src in means.items()])
        .withColumn("year", F.year("date"))
    )


def _effort(tows: DataFrame, site: DataFrame) -> DataFrame:
    """First row per tow on the measured columns; lookups and date parts come after."""
    keep = ["op_id", "target", "date", "tow_time", "gear", "location", "mid_lat", "mid_lon", "mid_depth", "fishing_depth"]
    once = first_per_key(tows.select(*keep), ["op_id"], ["date", "tow_time"])
    return with_calendar(lookup_join(once, site, "location", "shore_distance"), "date").select(*EFFORT)


def neuston_effort(tow: DataFrame, site: DataFrame) -> DataFrame:
    """One row per surface tow."""
    return _effort(neuston_tows(tow), site)


def effort_table(tow: DataFrame, site: DataFrame, daily: DataFrame) -> DataFrame:
    """Effort with the same-day, same-station temperatures."""
    return natural_join(neuston_effort(tow, site), daily, "left", ["location", "date", "year"])


def catch_density(
    tow: DataFrame, catch: DataFrame, site: DataFrame, species: DataFrame, daily: DataFrame
) -> DataFrame:
    """The nets of one sample composited, in fish per hectare, with lookups.

    Nets are summed per tow before anything is joined, and samples are summed on
    their keys alone; the attributes of a sample's first tow are joined to the
    finished sums, so wide rows are shuffled once per tow and not per catch row.
    """
    per_tow = catch.groupBy("op_id", "species").agg(strict(F.sum, F.col("n")).alias("fish"))
    tows = neuston_tows(tow)
    place = ["date", "tow_time", "location"]
    composite = (
        per_tow.join(tows.select("op_id", *place), "op_id", "left")
        .groupBy(*place, "species")
        .agg(strict(F.sum, F.col("fish")).alias("fish"), F.min("op_id").alias("op_id"))
    )
    keep = ["op_id", "target", "gear", "mid_lat", "mid_lon", "mid_depth", "fishing_depth", "distance"]
    composite = natural_join(composite, tows.select(*keep), "left", ["op_id"])
    composite = composite.withColumn(
        "fish_ha", scalars.fish_per_hectare(F.col("fish"), F.col("distance"))
    ).drop("distance")
    composite = lookup_join(composite, site, "location", "shore_distance")
    composite = lookup_join(composite, species, "species", "common_name")
    return natural_join(with_calendar(composite, "date"), daily, "left", ["location", "date", "year"])


def offshore(density: DataFrame, after_year: int) -> DataFrame:
    """Without the shallow sites of the special survey."""
    target = F.col("target")
    special = (target == 117) & (F.col("year") > after_year) & (F.col("mid_depth") > 80)
    return density.filter((target == 2) | (target == 118) | special)


def trawl_tows(tow: DataFrame, trawl: DataFrame) -> DataFrame:
    """Trawl tows: sentinels to missing, states recoded, depths and temperatures averaged."""
    c = F.col
    zeros = ["fishing_depth_raw", "surf_temp", "beg_surf", "end_surf", "beg_bottom", "end_bottom"]
    joined = filled(tow).drop("tow_time").join(trawl, "op_id")
    joined = joined.withColumns({z: scalars.zero_to_null(c(z)) for z in zeros}).withColumns(
        {
            "tow_time": scalars.zero_to_null(c("tow_time_raw")),
            "state": scalars.clean_state(c("state")),
            "mid_depth": scalars.row_mean(c("beg_depth"), c("end_depth")),
            "surface_temp": scalars.row_mean(c("surf_temp"), c("beg_surf"), c("end_surf")),
            "bottom_temp": scalars.row_mean(
                c("beg_bottom"), c("end_bottom"), c("temp_beg_bottom"), c("temp_end_bottom")
            ),
            "gear": scalars.gear(c("tr_design")),
        }
    )
    depth: Column = F.when(c("gear") == "Bottom trawl", c("mid_depth")).when(
        c("gear") == "Mid-water trawl", c("fishing_depth_raw")
    )
    return joined.withColumns({"fishing_depth": depth, "country": scalars.country(c("state"))})


def trawl_clean(tow: DataFrame, trawl: DataFrame, site: DataFrame) -> DataFrame:
    """Cleaned trawl tows with distance from shore and date parts."""
    sited = lookup_join(trawl_tows(tow, trawl), site, "location", "shore_distance")
    return with_calendar(sited, "date")


def trawl_effort(tow: DataFrame, trawl: DataFrame, site: DataFrame) -> DataFrame:
    """One row per trawl tow."""
    return _effort(trawl_tows(tow, trawl), site)


def effort_union(trawl: DataFrame, neuston: DataFrame) -> DataFrame:
    return append_all([trawl.select(*EFFORT), neuston.select(*EFFORT)])
