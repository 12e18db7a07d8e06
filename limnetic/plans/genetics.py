"""Genetic identifications joined to effort, and what is counted from them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from limnetic.functions import geo, scalars
from limnetic.operators import aggregates as A
from limnetic.operators.columns import level_number
from limnetic.operators.joins import (
    aggregate_with_first,
    join_first,
    lookup_join,
    natural_join,
    spread_join,
    with_group_size,
)
from limnetic.operators.reshape import first_per_key, pivot_counts
from limnetic.session import written
from limnetic.sources.files import append_all

NAMES = ("Bloater", "Cisco", "Kiyi", "Shortnose Cisco", "Lake Whitefish", "ciscoe hybrid")
GROUPS = ("July Bottom Trawl Survey", "August-October Mid-Water Trawl Survey")


def genetics_counts(specimen: DataFrame, effort: DataFrame) -> DataFrame:
    """Identified fish per year and species beside the year's total."""
    ids = specimen.filter(F.col("genetics").isNotNull())
    per_tow = ids.groupBy("op_id", "genetics").agg(A.rows().alias("n"))
    dated = per_tow.join(effort.select("op_id", "year"), "op_id")
    counts = dated.groupBy("year", scalars.genetic_name(F.col("genetics")).alias("genetics_name")).agg(
        F.sum("n").alias("genetics_fish")
    )
    total = counts.groupBy("year").agg(F.sum("genetics_fish").alias("genetics"))
    return natural_join(counts, total, "left", ["year"])


def genetics_per_year(specimen: DataFrame, effort: DataFrame) -> DataFrame:
    ids = specimen.filter(F.col("genetics").isNotNull())
    per_tow = ids.groupBy("op_id").agg(A.rows().alias("n"))
    return per_tow.join(effort.select("op_id", "year"), "op_id").groupBy("year").agg(F.sum("n").alias("genetics"))


def named_ids(specimen: DataFrame, species: DataFrame) -> DataFrame:
    """Identified fish with match flag and both names, not yet joined to effort."""
    ids = specimen.filter(F.col("genetics").isNotNull()).withColumns(
        {
            "match": scalars.match_flag(F.col("species"), F.col("genetics")),
            "genetics_name": scalars.genetic_name(F.col("genetics")),
        }
    )
    return lookup_join(ids, species, "species", "common_name")


def genetics_master(specimen: DataFrame, effort: DataFrame, species: DataFrame) -> DataFrame:
    """Every identified fish with match flag, effort and both names."""
    return spread_join(named_ids(specimen, species), effort, "op_id")


def strain_sites(specimen: DataFrame, effort: DataFrame, cut: float = 0.7) -> DataFrame:
    """Fish per site and strain, labelled with the strain's total, and metres to the inlet.

    Fish are counted per tow before the join; the distance is worked out once
    per site, not per fish.
    """
    gp = F.col("gp")
    strain = F.when(gp >= cut, "Grand Portage strain Cisco").when(gp < cut, "Typical Cisco")
    typed = specimen.filter((F.col("genetics") == 202) & gp.isNotNull())
    per_tow = typed.groupBy("op_id", strain.alias("gpq")).agg(A.rows().alias("n"))
    placed = per_tow.join(effort.select("op_id", "location", "mid_lat", "mid_lon"), "op_id", "left")
    keys = ["location", "gpq"]
    sites = aggregate_with_first(
        placed, keys, [F.sum("n").alias("fish")], ["op_id"], ["mid_lat", "mid_lon"]
    )
    totals = sites.groupBy("gpq").agg(F.sum("fish").alias("n"))
    sites = natural_join(sites, totals, "left", ["gpq"])
    sites = sites.withColumn("label1", scalars.united(", n=", F.col("gpq"), F.col("n")))
    return geo.with_geodesic_distance(sites, "mid_lon", "mid_lat", out="inlet_metres").orderBy(
        F.desc_nulls_last("gpq"), "location"
    )


def strain_fish(specimen: DataFrame, effort: DataFrame, cut: float = 0.7) -> DataFrame:
    """Every fish with a strain value: its site, strain labelled with the strain's total, and metres to the inlet.

    Metres are worked out once per tow, and the two strains' totals are broadcast.
    """
    gp = F.col("gp")
    strain = F.when(gp >= cut, "Grand Portage strain Cisco").when(gp < cut, "Typical Cisco")
    typed = specimen.filter((F.col("genetics") == 202) & gp.isNotNull())
    typed = typed.select("op_id", "specimen_number", "length", "gp", strain.alias("gpq"))
    totals = typed.groupBy("gpq").agg(A.rows().alias("n"))
    tows = effort.select("op_id", "year", "location", "mid_lat", "mid_lon")
    tows = geo.with_geodesic_distance(tows, "mid_lon", "mid_lat", out="inlet_metres")
    fish = natural_join(typed.join(tows, "op_id", "left"), totals, "left", ["gpq"], bounded=True)
    return fish.withColumn("label1", scalars.united(", n=", F.col("gpq"), F.col("n")))


def sampled_catch(density: DataFrame, year: int, out: str = "fish") -> DataFrame:
    """Unidentified larvae and empty tows of one year per day and site, with position.

    The position is that of the first row of any species there.
    """
    wanted = F.col("species").isin(217, 0)
    sampled = aggregate_with_first(
        density.filter(F.col("year") == year),
        ["date", "location"],
        [F.sum(F.when(wanted, F.col("fish"))).alias(out), F.count_if(wanted).alias("_rows")],
        ["tow_time", "species", "op_id"],
        ["mid_lat", "mid_lon", "mid_depth"],
    )
    return sampled.filter(F.col("_rows") > 0).drop("_rows")


def collections(density: DataFrame, specimen: DataFrame, effort: DataFrame, year: int) -> DataFrame:
    """Larval catch of one year and age-0 counts per site and day, with life stage.

    Fish are counted per tow before they meet the effort table.
    """
    c = F.col
    place = ["mid_lat", "mid_lon", "mid_depth"]
    keys = ["date", "location"]
    larval = sampled_catch(density, year).withColumn("gear", F.lit("Neuston"))

    ids = specimen.filter(c("genetics").isNotNull())
    per_tow = ids.groupBy("op_id").agg(F.count_if(c("length") <= 150).alias("n"))
    tows = written(per_tow.join(effort.select("op_id", "gear", *keys, *place), "op_id"), "tows")
    young = tows.filter((c("gear") != "Neuston") & (c("n") > 0))
    age0 = young.groupBy(*keys).agg(F.sum("n").alias("fish"))
    age0 = join_first(age0, tows.select("op_id", "location", *place), ["location"], ["op_id"])
    age0 = age0.withColumn(
        "gear", F.when(F.month("date") <= 7, "Bottom trawl").when(F.month("date") > 7, "Mid-Water trawl")
    )
    out = ["location", "date", "gear", *place, "fish"]
    stacked = append_all([larval.select(*out), age0.select(*out)])
    return stacked.withColumns(
        {
            "year": F.year("date"),
            "fish_type": F.when(c("gear") == "Neuston", "Larval").when(c("gear") != "Neuston", "Age-0+"),
        }
    )


def snake(name: str) -> str:
    return name.lower().replace(" ", "_")


def counts_by_species(among: Column, names: Sequence[str] = NAMES, prefix: str = "") -> list[Column]:
    """Fish of each named species, of any other, and of all, where ``among`` holds."""
    name = F.col("genetics_name")
    named = [F.count_if(among & (name == n)).alias(prefix + snake(n)) for n in names]
    other = among & (name.isNull() | ~name.isin(*names))
    return [*named, F.count_if(other).alias(f"{prefix}other"), F.count_if(among).alias(f"{prefix}total")]


def composition(fish: DataFrame, keys: Sequence[str], names: Sequence[str] = NAMES) -> DataFrame:
    """Fish per species in columns, those of other species, and the total of all fish."""
    return fish.groupBy(*keys).agg(*counts_by_species(F.lit(True), names))


def species_composition(ids: DataFrame, effort: DataFrame, year: int) -> DataFrame:
    """Composition per tow (all fish, age-0 fish) and per sample (larvae), with position.

    One pass counts all and small fish per tow; the three tables follow from it.
    """
    c = F.col
    names = [*(snake(n) for n in NAMES), "other", "total"]
    small = F.coalesce(c("length") <= 100, F.lit(False))
    wide = ids.groupBy("op_id").agg(*counts_by_species(F.lit(True)), *counts_by_species(small, prefix="small_"))
    place = ["date", "tow_time", "location", "mid_lat", "mid_lon"]
    effort = written(effort.select("op_id", "gear", "year", *place), "effort")
    tows = written(natural_join(wide, effort, "left", ["op_id"]), "tows")

    everything = tows.select("op_id", *names, *place)
    age0 = tows.filter((c("gear") != "Neuston") & (c("year") == year)).select(
        "op_id", *[c(f"small_{n}").alias(n) for n in names], *place
    )
    sample = ["date", "tow_time", "location"]
    sums = [F.sum(n).alias(n) for n in names]
    larvae = tows.filter(c("gear") == "Neuston").groupBy(*sample).agg(*sums)
    surface = effort.filter(c("gear") == "Neuston").select("op_id", *place)
    larvae = join_first(larvae, surface, sample, ["op_id"])
    tagged = {
        "all": everything,
        "age0": age0.filter(c("total") > 0),
        "larvae": larvae,
    }
    return append_all([df.withColumn("stage", F.lit(tag)) for tag, df in tagged.items()])


def yolk_lengths(fish: DataFrame, effort: DataFrame, by_species: bool = False) -> DataFrame:
    """Larval length per week and yolk sac; groups with any missing part are left out."""
    keys = ["year", "week"] + (["genetics_name"] if by_species else []) + ["yolk_sac"]
    x = F.col("length")
    stats = (
        fish.filter(F.col("gear") == "Neuston")
        .groupBy(*keys)
        .agg(
            A.rows().alias("n"),
            A.strict(F.avg, x).alias("mean_l"),
            A.strict(F.min, x).alias("min_l"),
            A.strict(F.max, x).alias("max_l"),
        )
    )
    first = first_per_key(
        effort.select("year", "week", "date", "op_id", "date1"), ["year", "week"], ["date", "op_id"]
    )
    first = first.drop("date", "op_id")
    return natural_join(stats, first, "left", ["year", "week"], bounded=True).dropna()


def yolk_proportion(fish: DataFrame, effort: DataFrame, name: str) -> DataFrame:
    """Percent of larvae with a yolk sac per day and species, with the day's first tow."""
    seen = fish.filter(F.col("yolk_sac").isNotNull())
    per_tow = seen.groupBy("op_id", name, "yolk_sac").agg(A.rows().alias("n"))
    dated = natural_join(per_tow, effort.select("op_id", "date"), "left", ["op_id"])
    wide = pivot_counts(dated, ["date", name], "yolk_sac", ["Y", "N"], weight="n")
    wide = wide.withColumn("yolks", scalars.percent_of_pair(F.col("Y"), F.col("N")))
    first = effort.select("date", "op_id", "location", "week", "year")
    return join_first(wide, first, ["date"], ["op_id"])


def yolk_presence(fish: DataFrame, effort: DataFrame, name: str) -> DataFrame:
    """Larvae with and without a yolk sac per day and species, as rows with labels and the day's first tow."""
    sac = F.col("yolk_sac")
    per_tow = fish.filter(sac.isNotNull()).groupBy("op_id", name, "yolk_sac").agg(A.rows().alias("n"))
    dated = natural_join(per_tow, effort.select("op_id", "date"), "left", ["op_id"])
    counts = dated.groupBy("date", name, "yolk_sac").agg(F.sum("n").alias("n"))
    counts = counts.withColumn("yolk", F.when(sac == "Y", "Present").when(sac == "N", "Absent"))
    return join_first(counts, effort.select("date", "op_id", "location", "week", "year"), ["date"], ["op_id"])


def weekly_first(proportion: DataFrame, name: str) -> DataFrame:
    return first_per_key(proportion, ["week"], ["date", name])


def id_agreement(ids: DataFrame) -> DataFrame:
    """Within each genetic species, the share of every ship identification."""
    known = ids.filter(F.col("species") != 217)
    sizes = known.groupBy("genetics_name").agg(A.rows().alias("group_size"))
    both = known.filter(F.col("genetics") != 217)
    table = A.share_within(both, ["genetics_name"], ["common_name"])
    return natural_join(table, sizes, "left", ["genetics_name"])


def match_map(ids: DataFrame, effort: DataFrame) -> DataFrame:
    """Matching and differing identifications per tow and species, with position."""
    known = ids.filter((F.col("genetics") != 217) & (F.col("species") != 217))
    wide = pivot_counts(known, ["op_id", "genetics_name"], "match", ["Yes", "No"])
    place = effort.select("op_id", "location", "mid_lat", "mid_lon", "mid_depth")
    out = natural_join(wide, place, "left", ["op_id"])
    return out.withColumn("fish", F.col("Yes") + F.col("No"))


def match_map_sites(ids: DataFrame, effort: DataFrame) -> DataFrame:
    """The same counts kept to the first fish of every tow (right join)."""
    wide = pivot_counts(ids, ["op_id", "genetics_name"], "match", ["Yes", "No"])
    first = first_per_key(
        ids.select("op_id", "specimen_number", "genetics_name"),
        ["op_id"],
        ["specimen_number", "genetics_name"],
    )
    out = natural_join(wide, first, "right", ["op_id", "genetics_name"])
    out = natural_join(out, effort.select("op_id", "location"), "left", ["op_id"])
    return out.withColumn("fish", F.col("Yes") + F.col("No"))


def compared_ids(specimen: DataFrame, species: DataFrame) -> DataFrame:
    """Age-0 and older fish under 200 mm: match, label of the pair and names."""
    c = F.col
    ids = specimen.select("op_id", "specimen_number", "species", "genetics", "length").dropna()
    ids = ids.filter(c("length") < 200).withColumns(
        {
            "match": scalars.match_flag(c("species"), c("genetics")),
            "comparison": scalars.pair_label(c("species"), c("genetics")),
            "genetics_name": F.when(
                c("genetics").isin(202, 204, 206, 208, 217, 218), scalars.genetic_name(c("genetics"))
            ),
        }
    )
    return lookup_join(ids, species, "species", "common_name")


def id_comparison(specimen: DataFrame, effort: DataFrame, species: DataFrame) -> DataFrame:
    """The compared fish with their trawl and the total of their genetic species."""
    ids = with_group_size(compared_ids(specimen, species), ["genetics_name"], "n", bounded=True)
    return spread_join(ids, effort, "op_id")


def survey_pies(ids: DataFrame, effort: DataFrame) -> DataFrame:
    """Composition per tow from July on, labelled with its survey."""
    month = F.col("month")
    wide = composition(ids.filter(F.col("length") < 150), ["op_id"])
    place = effort.filter(month >= 7).select("op_id", "month", "location", "mid_lat", "mid_lon")
    out = natural_join(wide, place, "inner", ["op_id"])
    group = F.when(month == 7, GROUPS[0]).when(month >= 8, GROUPS[1])
    return out.withColumns({"group": group, "group_no": level_number(group, GROUPS)})


def mismatch_by_catch(ids: DataFrame) -> DataFrame:
    """Percent of differing identifications against the size of the catch."""
    wide = pivot_counts(ids, ["op_id"], "match", ["Yes", "No"])
    return wide.select(
        "op_id",
        (F.col("No") + F.col("Yes")).alias("fish"),
        scalars.percent_of_pair(F.col("No"), F.col("Yes")).alias("mismatch"),
    )
