"""Filters, predicates and fills."""

from __future__ import annotations

from pyspark.sql import functions as F

from limnetic.functions import scalars
from limnetic.operators.columns import fill_missing_zero
from limnetic.operators.joins import lookup_join

from .registry import query


@query(
    "filter_range",
    "SELECT op_id, specimen_number, length FROM v_specimen WHERE length < 30 AND length >= 5",
)
def _(s):
    df = s.specimen.select("op_id", "specimen_number", "length")
    return df.filter(F.col("length") < 30).filter(F.col("length") >= 5)


@query("filter_isin", "SELECT op_id, net, species, n FROM v_catch WHERE species IN (202, 204, 206)")
def _(s):
    return s.catch.filter(F.col("species").isin(202, 204, 206))


@query(
    "filter_mixed_bool",
    """SELECT op_id, target FROM v_tow
       WHERE target = 2 OR target = 118 OR (target = 117 AND year(op_date) > 1996 AND beg_depth > 80)""",
)
def _(s):
    target = F.col("target")
    deep = (target == 117) & (F.year("op_date") > 1996) & (F.col("beg_depth") > 80)
    return s.tow.filter((target == 2) | (target == 118) | deep).select("op_id", "target")


@query("filter_not_null", "SELECT op_id, yolk_sac FROM v_specimen WHERE yolk_sac IS NOT NULL")
def _(s):
    return s.specimen.select("op_id", "yolk_sac").filter(F.col("yolk_sac").isNotNull())


@query(
    "drop_na_subset",
    """SELECT op_id, genetics, length, gp FROM v_specimen
       WHERE genetics IS NOT NULL AND length IS NOT NULL""",
)
def _(s):
    df = s.specimen.select("op_id", "genetics", "length", "gp")
    return df.dropna(subset=["genetics", "length"])


@query(
    "drop_na_all",
    """SELECT op_id, genetics, length, yolk_sac, gp FROM v_specimen
       WHERE genetics IS NOT NULL AND length IS NOT NULL AND yolk_sac IS NOT NULL AND gp IS NOT NULL""",
)
def _(s):
    return s.specimen.select("op_id", "genetics", "length", "yolk_sac", "gp").dropna()


@query("filter_not_equal", "SELECT op_id, state FROM v_tow WHERE state <> 'MI'")
def _(s):
    return s.tow.select("op_id", "state").filter(F.col("state") != "MI")


@query("filter_date", "SELECT op_id, op_date FROM v_tow WHERE op_date >= DATE '2000-10-01'")
def _(s):
    return s.tow.select("op_id", "op_date").filter(F.col("op_date") >= F.lit("2000-10-01").cast("date"))


@query(
    "censor_limits",
    """SELECT c.location, c.shore_distance, x.outside
       FROM v_site c, (SELECT count(*) AS outside FROM v_site
                       WHERE shore_distance IS NULL OR shore_distance NOT BETWEEN 0 AND 30000) x
       WHERE c.shore_distance BETWEEN 0 AND 30000""",
)
def _(s):
    inside = F.col("shore_distance").between(0, 30000)
    outside = s.site.agg(F.count_if(~F.coalesce(inside, F.lit(False)))).scalar()
    return s.site.filter(inside).withColumn("outside", outside)


@query(
    "replace_value",
    """SELECT op_id, nullif(tow_time_raw, 0) AS tow_time, nullif(fishing_depth_raw, 0) AS fishing_depth,
              CASE WHEN state = 'E' THEN 'ONT.E' WHEN state = 'W' THEN 'ONT.W' ELSE state END AS state
       FROM v_trawl JOIN (SELECT op_id, state FROM v_tow) USING (op_id)""",
)
def _(s):
    df = s.trawl.select("op_id", "tow_time_raw", "fishing_depth_raw")
    df = lookup_join(df, s.tow, "op_id", "state")
    state = F.col("state")
    return df.select(
        "op_id",
        scalars.zero_to_null(F.col("tow_time_raw")).alias("tow_time"),
        scalars.zero_to_null(F.col("fishing_depth_raw")).alias("fishing_depth"),
        F.when(state == "E", "ONT.E").when(state == "W", "ONT.W").otherwise(state).alias("state"),
    )


@query(
    "fill_na_zero",
    """SELECT op_id, coalesce(genetics, 0) AS genetics, coalesce(length, 0) AS length,
              coalesce(yolk_sac, '0') AS yolk_sac FROM v_specimen""",
)
def _(s):
    return fill_missing_zero(s.specimen.select("op_id", "genetics", "length", "yolk_sac"))


@query(
    "coalesce_pair",
    """SELECT op_id, coalesce(beg_lat, end_lat) AS beg_lat, coalesce(end_lat, beg_lat) AS end_lat FROM v_tow""",
)
def _(s):
    beg, end = F.col("beg_lat"), F.col("end_lat")
    return s.tow.select(
        "op_id", scalars.either(beg, end).alias("beg_lat"), scalars.either(end, beg).alias("end_lat")
    )
