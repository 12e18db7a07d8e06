"""Larval counts, processing backlog, hauls, temperature groups and lab throughput."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from limnetic.functions import scalars
from limnetic.functions.calendar import week_of_year, weekday
from limnetic.operators import aggregates as A
from limnetic.operators.columns import fill_missing_zero, level_number
from limnetic.operators.joins import lookup_join, natural_join
from limnetic.operators.reshape import first_per_key, pivot_counts
from limnetic.operators.statistics import mean_ci_normal

from .genetics import sampled_catch
from .lengths import LARVAL_SPECIES

WEEKLY_SPECIES = (202, 203, 204, 206, 217)
WORKDAYS = ("Monday", "Tuesday", "Wednesday", "Thursday", "Friday")
SEASONS = ("June", "July", "Aug/Sep")


def larval_counts(larvae: DataFrame, effort: DataFrame, species: DataFrame) -> DataFrame:
    """Larvae per tow and species with effort and names."""
    counts = larvae.dropna(subset=["species"]).groupBy("op_id", "species").agg(A.rows().alias("n"))
    return lookup_join(natural_join(counts, effort, "left", ["op_id"]), species, "species", "common_name")


def weekly_catch(counts: DataFrame) -> DataFrame:
    kept = counts.filter(F.col("species").isin(*WEEKLY_SPECIES))
    return kept.groupBy("year", "week", "common_name").agg(F.sum("n").alias("fish"))


def sized_larvae(larvae: DataFrame) -> DataFrame:
    """Larvae of the species that are aged, with a known length."""
    return larvae.dropna(subset=["length"]).filter(F.col("species").isin(*LARVAL_SPECIES))


def week_labels(counts: DataFrame) -> DataFrame:
    """The first tow of each week of any year, whose date labels the week axis."""
    return first_per_key(counts.select("week", "date", "op_id", "year", "date1"), ["week"], ["date", "op_id"])


def catch_by_distance(counts: DataFrame) -> DataFrame:
    return counts.select(
        "op_id", "species", "common_name",
        F.col("n").alias("tfish"), (F.col("shore_distance") / 1000).alias("shore_km"),
    )


def yolk_by_site(larvae: DataFrame, counts: DataFrame, effort: DataFrame) -> DataFrame:
    """Larvae with and without a yolk sac per year and site, at every tow made there."""
    kept = larvae.dropna(subset=["species", "length", "yolk_sac"]).filter(
        F.col("species").isin(*LARVAL_SPECIES)
    )
    per_tow = kept.groupBy("op_id", "yolk_sac").agg(A.rows().alias("n"))
    dated = per_tow.join(effort.select("op_id", "year", "location"), "op_id")
    keys = ["year", "location"]
    wide = pivot_counts(dated, keys, "yolk_sac", ["Y", "N"], weight="n")
    wide = wide.withColumnsRenamed({"Y": "yes", "N": "no"})
    fish = counts.groupBy(*keys).agg(F.sum("n").alias("fish"))
    wide = natural_join(wide, fish, "left", keys)
    # Every (year, location) comes from a tow, so the inner join loses none and
    # lets Spark split a site with very many tows on either side.
    return natural_join(effort.select(*keys, "op_id", "mid_lat", "mid_lon"), wide, "inner", keys)


def processing_backlog(density: DataFrame, counts: DataFrame, year: int, small: int = 200) -> DataFrame:
    """Collected and processed larvae per site and day, with the work that remains.

    A site and day without a rule gets no status, which prints as "0".
    """
    c = F.col
    keys = ["date", "location"]
    collected = sampled_catch(density, year, "collected").drop("mid_depth")
    done = counts.filter(c("year") == year).groupBy(*keys).agg(F.sum("n").alias("processed"))
    both = natural_join(done, collected, "right", keys).select(
        *keys, "mid_lat", "mid_lon", "collected", "processed"
    )
    both = both.fillna(0).withColumn("to_do", c("collected") - c("processed"))
    both = both.withColumns(
        {
            "work": F.when(c("to_do") <= 0, "Processed")
            .when((c("to_do") >= 1) & (c("location") > 500), "Processed")
            .when(c("to_do") <= 15, "Processed")
            .when(c("collected") <= small, "Processed")
            .when((c("to_do") > 0) & (c("location") < 500), "To do"),
            "could_do": F.when(
                (c("collected") > small) & (c("location") < 500), c("collected") - small
            ).when(c("collected") < small, F.lit(0)),
        }
    )
    open_fish = F.when((c("to_do") <= 15) | (F.coalesce(c("work"), F.lit("")) == "Processed"), 0)
    both = both.withColumn("remaining", open_fish.otherwise(c("to_do")))
    both = both.withColumns(
        {
            "remaining_shown": F.when(c("remaining") > 0, c("remaining")),
            "presence": F.when(c("collected") > 0, "present").when(c("collected") == 0, "absent"),
        }
    )
    return fill_missing_zero(both)


def backlog_status(backlog: DataFrame, extra_catch: int = 0) -> DataFrame:
    """Totals and the status sentence; ``extra_catch`` is a correction by hand."""
    totals = backlog.agg(
        F.sum("processed").alias("fish_done"),
        (F.sum("collected") + extra_catch).alias("fish_catch"),
        F.sum("could_do").alias("fish_extra"),
        F.sum("remaining").alias("fish_to_do"),
    )
    parts = [F.col("fish_done"), F.lit("fish processed of"), F.col("fish_catch"), F.lit("fish collected")]
    return totals.withColumn("status", F.concat_ws(" ", *[p.cast("string") for p in parts]))


def age0_hauls(
    tow: DataFrame, fish: DataFrame, site: DataFrame, species: DataFrame, names: Sequence[str]
) -> DataFrame:
    """Haul effort with habitat, all samples, and late small fish per ship species."""
    c = F.col
    near = c("location") < 500
    effort = tow.select(
        "op_id", "op_date", "location", "tr_design",
        scalars.row_mean(c("beg_lat"), c("end_lat")).alias("mid_lat"),
        scalars.row_mean(c("beg_lon"), c("end_lon")).alias("mid_lon"),
        scalars.row_mean(c("beg_depth"), c("end_depth")).alias("mid_depth"),
        F.year("op_date").alias("year"), F.month("op_date").alias("month"),
        week_of_year(c("op_date")).alias("week"),
        F.when(near, "nearshore").when(~near, "offshore").alias("habitat"),
    )
    effort = first_per_key(effort, ["op_id"], ["op_date"])
    effort = lookup_join(effort, site, "location", "shore_distance")
    known = fish.dropna(subset=["species"])
    samples = known.groupBy("op_id").agg(A.rows().alias("samples"))
    small = lookup_join(known.filter(c("length") < 150), species, "species", "common_name")
    small = small.groupBy("op_id", "common_name").agg(A.rows().alias("n"))
    late = small.join(effort.filter(c("month") >= 8).select("op_id"), "op_id", "left_semi")
    wide = pivot_counts(late, ["op_id"], "common_name", names, weight="n")
    wide = wide.withColumnsRenamed({n: n.lower().replace(" ", "_") for n in names})
    out = natural_join(samples, effort, "left", ["op_id"])
    return natural_join(out, wide, "left", ["op_id"])


def temperature_rows(bt: DataFrame, years: Sequence[int]) -> DataFrame:
    """Casts from June to October of selected years, grouped by season."""
    month = F.col("month")
    rows = bt.select(
        "sample", F.year("date").alias("year"), F.month("date").alias("month"), "date",
        F.col("t3m").alias("temperature"), "chl_surf", "chl3m",
    ).filter(F.col("year").isin(*years) & (month > 5) & (month < 11))
    group = F.when(month == 6, "June").when(month == 7, "July").when(month > 7, "Aug/Sep")
    return rows.withColumns({"group": group, "group_no": level_number(group, SEASONS)})


def temperature_days(rows: DataFrame) -> DataFrame:
    return rows.groupBy("date", "group", "group_no").agg(
        A.strict(F.avg, F.col("temperature")).alias("mean_temp"),
        A.strict(F.avg, F.col("chl_surf")).alias("mean_surf_chl"),
        A.strict(F.avg, F.col("chl3m")).alias("mean_chl3m"),
    )


def temp_vs_yolk(bt: DataFrame, proportion: DataFrame, year: int) -> DataFrame:
    """Daily mean temperature of one year beside that day's yolk-sac percent."""
    days = (
        bt.filter(F.year("date") == year)
        .groupBy("date")
        .agg(A.strict(F.avg, F.col("t3m")).alias("mean_temp"))
    )
    return natural_join(days, proportion, "left", ["date"])


def samples_per_day(lab: DataFrame, since: str) -> DataFrame:
    days = lab.filter(F.col("date") >= F.lit(since).cast("date")).groupBy("date").agg(A.rows().alias("processed"))
    return days.withColumn("day", weekday(F.col("date")))


def lab_throughput(days: DataFrame) -> DataFrame:
    """Samples per working day of the week: mean and its t interval."""
    ci = mean_ci_normal(days, ["day"], "processed")
    return ci.withColumn("day_no", level_number(F.col("day"), WORKDAYS))
