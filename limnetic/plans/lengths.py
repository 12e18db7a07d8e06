"""Length sets, growth rates and length statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from limnetic.functions.calendar import with_calendar
from limnetic.operators.aggregates import length_statistics, rows, strict
from limnetic.operators.columns import with_levels
from limnetic.operators.joins import join_first, lookup_join, natural_join, spread_join
from limnetic.operators.statistics import growth_label, ols
from limnetic.session import written

LENGTH_SPECIES = (202, 203, 204, 206, 208, 210, 217, 218)
LARVAL_SPECIES = (202, 204, 206, 217)


def length_set(lengths: DataFrame, effort: DataFrame, species: DataFrame) -> DataFrame:
    """Larval lengths of 5 to 30 mm with species names and effort."""
    x = F.col("length")
    kept = lengths.select("op_id", "species", "length").filter(
        F.col("species").isin(*LENGTH_SPECIES) & (x < 30) & (x >= 5)
    )
    named = lookup_join(kept, species, "species", "common_name")
    return spread_join(named, effort, "op_id")


def annual_growth(lengths: DataFrame) -> DataFrame:
    """Growth per day of the year, per survey year, with its label."""
    return growth_label(ols(lengths, ["year"], F.col("jday"), F.col("length")), "year")


def with_annual_growth(lengths: DataFrame) -> DataFrame:
    lengths = written(lengths, "lengths")
    growth = annual_growth(lengths).drop("n")
    return natural_join(lengths, growth, "left", ["year"], bounded=True)


def length_by_station(lengths: DataFrame, effort: DataFrame, species: DataFrame) -> DataFrame:
    """Mean length per day, station and species beside the tows and temperatures there."""
    x = F.col("length")
    means = (
        lengths.filter((x < 30) & (x >= 8))
        .groupBy("date", "location", "species")
        .agg(strict(F.avg, x).alias("mean_l"))
    )
    out = natural_join(means, effort, "left", ["date", "location"])
    out = lookup_join(out, species, "species", "common_name")
    return with_levels(out, "month_long", ["May", "June", "July", "August", "September"], "month_no")


def growth_set(
    fish: DataFrame, kiyi_below: float | None = None, all_below: float | None = 140, codes: Sequence[int] = (202, 204)
) -> DataFrame:
    """Identified fish of ``codes`` and of 206 young enough for a growth line."""
    x, month = F.col("length"), F.col("month")
    code = F.col("genetics")
    wanted = code.isin(*codes) | ((code == 206) & (x < kiyi_below if kiyi_below else F.lit(True)))
    young = ((x <= 80) & (month <= 7)) | (month >= 8)
    kept = fish.dropna(subset=["genetics", "length"]).filter(wanted & young)
    return kept.filter(x < all_below) if all_below else kept


def species_growth(fish: DataFrame, year: int, **limits) -> DataFrame:
    """Growth per calendar day of one year, per species, with its label."""
    kept = growth_set(fish, **limits).filter(F.col("year") == year)
    return growth_label(
        ols(kept, ["genetics_name"], F.unix_date("date"), F.col("length")), "genetics_name"
    )


def with_species_growth(fish: DataFrame, year: int, **limits) -> DataFrame:
    """The fish behind ``species_growth`` beside the slope and label of their species, a fixed code list."""
    lines = species_growth(fish, year, **limits).select("genetics_name", "slope", "legend")
    kept = growth_set(fish, **limits).filter(F.col("year") == year)
    return natural_join(kept, lines, "inner", ["genetics_name"], bounded=True)


def daily_lengths(fish: DataFrame, **limits) -> DataFrame:
    """Length statistics per day and species with the day's labels."""
    stats = growth_set(fish, **limits).groupBy("date", "genetics_name").agg(*length_statistics("length"))
    return with_calendar(stats, "date").drop("day", "jday")


def weekly_lengths(
    larvae: DataFrame, effort: DataFrame, species: DataFrame, by_yolk: bool = False
) -> DataFrame:
    """Length statistics per week and species (and yolk sac), with the week's first tow."""
    keys = ["year", "week", "species"] + (["yolk_sac"] if by_yolk else [])
    kept = larvae.dropna(subset=["species", "length"]).filter(F.col("species").isin(*LARVAL_SPECIES))
    dated = spread_join(
        kept.select("op_id", "specimen_number", "species", "length", "yolk_sac"),
        effort.select("op_id", "year", "week"),
        "op_id",
    )
    stats = dated.groupBy(*keys).agg(*length_statistics("length"))
    stats = lookup_join(stats, species, "species", "common_name")
    first = effort.select("year", "week", "date", "op_id", "date1")
    return join_first(stats, first, ["year", "week"], ["date", "op_id"])


def expanded_daily_lengths(
    trawl_lengths: DataFrame,
    trawl_effort: DataFrame,
    larvae: DataFrame,
    neuston_effort: DataFrame,
    daily_temperature: DataFrame,
    year: int,
) -> DataFrame:
    """Length statistics per day over counted trawl fish and larvae, with temperature.

    A trawl row stands for ``exp_n`` fish; it enters every statistic with that
    weight instead of being repeated. Equal lengths of a tow are added up first.
    """
    x, w = F.col("length"), F.col("exp_n")
    wanted = F.col("species").isin(*LARVAL_SPECIES)
    keep = ["op_id", "date", "location", "gear"]
    counted = F.sum("exp_n").alias("exp_n")
    trawl = trawl_lengths.filter((w > 0) & wanted & (x < 130)).groupBy("op_id", "length").agg(counted)
    trawl = trawl.join(trawl_effort.filter((F.col("year") == year) & (F.col("month") > 7)).select(*keep), "op_id")
    small = larvae.filter(wanted & (x < 130)).groupBy("op_id", "length").agg(rows().alias("exp_n"))
    small = small.join(neuston_effort.filter(F.col("year") == year).select(*keep), "op_id")
    fish = trawl.unionByName(small)
    # Equal lengths of a day are one cell, and deviations are taken from the day's mean.
    cells = fish.groupBy("date", "length").agg(counted, F.min(F.struct("op_id", "location", "gear")).alias("first"))
    means = cells.groupBy("date").agg((F.sum(w * x) / F.sum(w)).alias("mean"))
    cells = natural_join(cells, means, "left", ["date"], bounded=True)
    n, away = F.sum(w), x - F.col("mean")
    stats = cells.groupBy("date").agg(
        n.alias("n"),
        F.min(x).alias("min_length"),
        F.max(x).alias("max_length"),
        F.min("mean").alias("mean_length"),
        F.percentile(x, F.lit(0.5), w).alias("median_length"),
        F.sqrt(F.try_divide(F.sum(w * away * away), F.nullif(n - 1, F.lit(0)))).alias("sd_length"),
        F.min("first").alias("first"),
    )
    stats = stats.withColumn("se_length", F.try_divide("sd_length", F.sqrt("n")))
    stats = stats.select("*", "first.op_id", "first.location", "first.gear").drop("first")
    return natural_join(stats, daily_temperature, "left", ["date"])
