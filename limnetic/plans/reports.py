"""Site totals, annual summary, station means and sampling-effort charts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from limnetic.functions.calendar import month_long
from limnetic.functions.scalars import half_even, row_sum, united
from limnetic.operators import aggregates as A
from limnetic.operators.columns import across
from limnetic.operators.joins import aggregate_with_first, natural_join
from limnetic.operators.ordered import group_median
from limnetic.operators.reshape import first_per_key, pivot_values
from limnetic.session import written

from .effort import CISCOES, CISCOES_OR_NONE, offshore

SUMMER = ("May", "June", "July", "August", "September", "October")


def _is_cisco():
    return F.col("species").isin(*CISCOES)


def _flagged(density: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per key: does it hold an empty tow, does it hold ciscoes.

    Counting these rows replaces several distinct counts over the detail, which
    would multiply every row before the shuffle.
    """
    return density.groupBy(*keys).agg(
        F.bool_or(F.col("species") == 0).alias("absent"), F.bool_or(_is_cisco()).alias("present")
    )


def sites_overall(density: DataFrame) -> DataFrame:
    return _flagged(density, ["location"]).agg(
        A.rows().alias("all_sites"), F.count_if("present").alias("present_sites")
    )


def sites_by_location(density: DataFrame) -> DataFrame:
    return density.groupBy("location").agg(
        A.n_distinct(F.col("date"), F.col("tow_time")).alias("collections"),
        A.sum_where(_is_cisco(), F.col("fish")).alias("fish"),
    )


def sites_by_year(density: DataFrame) -> DataFrame:
    out = _flagged(density, ["year", "location"]).groupBy("year").agg(
        A.rows().alias("all_sites"),
        F.count_if("absent").alias("absent_sites"),
        F.count_if("present").alias("present_sites"),
    )
    return out.withColumn("sites", united(" / ", F.col("all_sites"), F.col("present_sites")))


def collections_by_year(density: DataFrame) -> DataFrame:
    """Collections (tows at a site, day and time) by what their first row holds."""
    keys = ["year", "location", "date", "tow_time"]
    once = first_per_key(density.select(*keys, "species", "op_id"), keys, ["species", "op_id"])
    per_op = once.groupBy("year", "op_id").agg(
        A.rows().alias("n"),
        F.bool_or(F.col("species") == 0).alias("absent"),
        F.bool_or(_is_cisco()).alias("present"),
    )
    out = per_op.groupBy("year").agg(
        F.sum("n").alias("all_rows"),
        A.rows().alias("all_collections"),
        F.count_if("absent").alias("absent_collections"),
        F.count_if("present").alias("present_collections"),
    )
    return out.withColumn(
        "collections", united(" / ", F.col("all_collections"), F.col("present_collections"))
    )


def site_totals(density: DataFrame) -> DataFrame:
    density = written(density.select("year", "location", "date", "tow_time", "species", "op_id"), "density")
    return natural_join(sites_by_year(density), collections_by_year(density), "left", ["year"])


def monthly_density(density: DataFrame) -> DataFrame:
    wanted = F.col("species").isin(*CISCOES_OR_NONE)
    return density.groupBy("year", "month_long").agg(
        F.avg(F.when(wanted, F.col("fish_ha"))).alias("noha_mean")
    )


def monthly_density_wide(density: DataFrame, months: Sequence[str] = SUMMER) -> DataFrame:
    return pivot_values(monthly_density(density), ["year"], "month_long", months, "noha_mean")


def length_months(lengths: DataFrame) -> DataFrame:
    return lengths.groupBy("year", "month_long").agg(
        A.rows().alias("n"), A.strict(F.avg, F.col("length")).alias("mean_l")
    )


def length_summary(lengths: DataFrame) -> DataFrame:
    """Annual length statistics up to July with monthly means beside, to one digit."""
    early = F.when(F.col("month") <= 7, F.col("length"))
    monthly = [
        F.avg(F.when(F.col("month_long") == m, F.col("length"))).alias(f"{m.lower()}_l")
        for m in ("May", "June", "July")
    ]
    out = lengths.groupBy("year").agg(
        F.count_if(F.col("month") <= 7).alias("n_l"),
        F.avg(early).alias("mean_l"),
        F.median(early).alias("median_l"),
        F.min(early).alias("min_l"),
        F.max(early).alias("max_l"),
        *monthly,
    )
    out = out.filter(F.col("n_l") > 0)
    return across(out, out.columns[2:], lambda c: half_even(c, 1).cast("double"))


def annual_summary(density: DataFrame, genetics: DataFrame, lengths: DataFrame) -> DataFrame:
    """One row per year: sites, collections, dates, catch, density, months, genetics, lengths.

    The density table feeds six aggregates, so it is written once and read back.
    Densities are continuous; their median goes through ``group_median``.
    """
    used = ["date", "tow_time", "location", "species", "op_id", "year", "month", "month_long", "fish", "fish_ha"]
    density = written(density.select(*used), "density")
    counted = F.col("species").isin(*CISCOES_OR_NONE)
    early = counted & (F.col("month") <= 7)
    fish, fish_ha = F.when(counted, F.col("fish")), F.when(counted, F.col("fish_ha"))
    year = density.groupBy("year").agg(
        F.min("date").alias("first"),
        F.max("date").alias("last"),
        F.min(fish).alias("catch_min"),
        A.sum_where(counted, F.col("fish")).alias("catch_total"),
        F.avg(F.when(early, F.col("fish_ha"))).alias("noha_mean"),
        F.max(fish_ha).alias("noha_max"),
    )
    median = group_median(density.filter(early), ["year"], "fish_ha", "noha_median")
    out = natural_join(year, median, "left", ["year"])
    out = natural_join(out, sites_by_year(density).select("year", "sites"), "left", ["year"])
    out = natural_join(out, collections_by_year(density).select("year", "collections"), "left", ["year"])
    out = natural_join(out, monthly_density_wide(density), "left", ["year"])
    out = natural_join(out, genetics, "left", ["year"])
    for name, d in (("date_min", F.col("first")), ("date_max", F.col("last"))):
        out = out.withColumn(name, united(" ", month_long(d), F.day(d)))
    out = out.select(
        "year", "sites", "collections", "date_min", "date_max", "catch_min", "catch_total",
        "noha_mean", "noha_median", "noha_max", *SUMMER, "genetics",
    )
    out = across(out, out.columns[7:16], lambda c: half_even(c, 0).cast("double"))
    return natural_join(out, length_summary(lengths), "left", ["year"])


def station_means(density: DataFrame, min_samples: int = 2) -> DataFrame:
    """Means across years per station up to July; one missing value voids a mean.

    The month label is that of the station's first row of all.
    """
    c = F.col
    counted = c("species").isin(*CISCOES_OR_NONE) & (c("month") <= 7)
    jday = F.when(counted, c("jday"))

    def whole_mean(name):
        x = F.when(counted, c(name))
        return F.when(F.count(x) == F.count_if(counted), F.avg(x)).alias(name)

    measures = ("mid_lat", "mid_lon", "shore_distance", "mid_depth", "fish_ha")
    out = aggregate_with_first(
        density,
        ["location"],
        [
            F.avg(jday).alias("jday_mean"),
            F.median(jday).alias("jday_median"),
            F.min(jday).alias("jday_min"),
            F.max(jday).alias("jday_max"),
            *[whole_mean(m) for m in measures],
            F.count_if(counted).alias("samples"),
        ],
        ["date", "tow_time", "species", "op_id"],
        ["month_long"],
    )
    out = out.withColumn("jday_range", c("jday_max") - c("jday_min"))
    return out.filter(c("samples") >= min_samples)


def station_date_ranges(stations: DataFrame) -> DataFrame:
    return stations.agg(
        F.avg("jday_range").alias("mean_range"), F.median("jday_range").alias("median_range")
    )


def offshore_summary(density: DataFrame, after_year: int) -> DataFrame:
    """Catch and density up to July, per year and per month, one row per site and day."""
    keys = ["date", "location"]
    kept = offshore(density, after_year).select(
        *keys, "tow_time", "species", "op_id", "year", "month", "fish", "fish_ha"
    )
    once = first_per_key(kept, keys, ["tow_time", "species", "op_id"]).filter(F.col("month") < 8)
    cells = once.groupBy("year", "month").agg(
        A.rows().alias("n"), F.sum("fish").alias("fish"), F.sum("fish_ha").alias("s"), F.count("fish_ha").alias("k")
    )
    parts = []
    for period in ("year", "month"):
        part = cells.groupBy(F.col(period).alias("value")).agg(
            F.sum("n").alias("n"),
            F.sum("fish").alias("fish_sum"),
            F.try_divide(F.sum("s"), F.sum("k")).alias("fish_mean"),
        )
        parts.append(part.withColumn("period", F.lit(period)))
    return parts[0].unionByName(parts[1])


def effort_pies(density: DataFrame, years: Sequence[int], months: Sequence[str] = SUMMER) -> DataFrame:
    """Per site, how its sampling days divide over months and its years over the survey.

    One pass per site and day, one per site; all slices sit side by side until
    the end.
    """
    days = aggregate_with_first(
        density, ["location", "date"], [], ["tow_time", "species", "op_id"], ["mid_lat", "mid_lon"]
    )
    day = F.col("date")
    slices = {("month", m): F.count_if(month_long(day) == m) for m in months}
    slices |= {("year", str(y)): F.max((F.year(day) == y).cast("bigint")) for y in years}
    wide = aggregate_with_first(
        days,
        ["location"],
        [n.alias("|".join(name)) for name, n in slices.items()],
        ["date"],
        ["mid_lat", "mid_lon"],
    )
    names = ["|".join(name) for name in slices]
    out = {}
    for kind in ("month", "year"):
        own = [n for n in names if n.startswith(kind)]
        total = row_sum(*[F.col(f"`{n}`") for n in own])
        out |= {n: F.try_divide(F.col(f"`{n}`"), total) for n in own}
    ids = ["location", "mid_lat", "mid_lon"]
    long = wide.select(*ids, *[share.alias(n) for n, share in out.items()]).unpivot(
        ids, [f"`{n}`" for n in names], "slice", "share"
    )
    kind, part = F.split("slice", r"\|")[0], F.split("slice", r"\|")[1]
    return long.withColumns({"kind": kind, "part": part}).drop("slice")
