"""Joins."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from limnetic.operators import aggregates as A
from limnetic.operators.joins import (
    aggregate_with_first,
    join_chain,
    join_first,
    lookup_join,
    natural_join,
    with_group_size,
)

from limnetic.session import shared_path
from limnetic.sources import files

from .registry import fix, query


@query(
    "natural_left_join",
    """SELECT a.op_id, a.tow_time, b.tows, R4(b.depth) AS depth FROM v_tow a
       LEFT JOIN (SELECT tow_time, count(*) AS tows, avg(beg_depth) AS depth FROM v_tow
                  WHERE tow_time IS NULL OR tow_time > 500 GROUP BY tow_time) b
       ON a.tow_time IS NOT DISTINCT FROM b.tow_time""",
)
def _(s):
    hours = s.tow.filter(F.col("tow_time").isNull() | (F.col("tow_time") > 500))
    hours = hours.groupBy("tow_time").agg(A.rows().alias("tows"), F.avg("beg_depth").alias("depth"))
    return fix(natural_join(s.tow.select("op_id", "tow_time"), hours, keys=["tow_time"]))


@query(
    "lookup_join",
    """SELECT c.op_id, c.net, c.species, s.common_name, d.shore_distance FROM v_catch c
       LEFT JOIN v_species s USING (species) LEFT JOIN v_tow t USING (op_id) LEFT JOIN v_site d USING (location)""",
)
def _(s):
    sited = lookup_join(s.tow.select("op_id", "location"), s.site, "location", "shore_distance")
    df = lookup_join(s.catch.drop("n"), s.species, "species", "common_name")
    return lookup_join(df, sited, "op_id", "shore_distance")


@query(
    "natural_right_join",
    """SELECT t.op_id, t.location, c.fish FROM (SELECT op_id, CAST(sum(n) AS BIGINT) AS fish FROM v_catch GROUP BY op_id) c
       RIGHT JOIN v_tow t ON c.op_id IS NOT DISTINCT FROM t.op_id""",
)
def _(s):
    fish = s.catch.groupBy("op_id").agg(F.sum("n").alias("fish"))
    return natural_join(fish, s.tow.select("op_id", "location"), "right", ["op_id"])


@query(
    "env_year_join",
    """SELECT t.op_id, t.op_date AS date, d.superior FROM v_tow t LEFT JOIN v_daily_temp d ON t.op_date = d.date
       WHERE t.target = 2 AND t.op_date >= DATE '1996-05-01' AND t.op_date < DATE '1997-08-01'""",
)
def _(s):
    """The readings lie in one folder per year; only the years of the tows asked for are opened."""
    path = files.write_by_year(s.daily_temp, shared_path(s.spark, "daily"), "date")
    daily = files.read_by_year(s.spark, path, s.daily_temp.schema)
    tows = s.tow.filter("target = 2 AND op_date >= DATE '1996-05-01' AND op_date < DATE '1997-08-01'")
    return files.same_day_join(tows.select("op_id", F.col("op_date").alias("date")), daily, []).select("op_id", "date", "superior")


def colocated(s, buckets: int = 8) -> dict:
    """Tow, catch and specimen tables, bucketed alike on the tow."""
    frames = {"tow": s.tow.select("op_id", "op_date", "location"), "catch": s.catch, "specimen": s.specimen.select("op_id", "genetics")}
    name = f"limnetic_{uuid.uuid4().hex[:12]}"
    return {k: files.write_bucketed(df, f"{name}_{k}", shared_path(s.spark, f"bucketed-{k}"), "op_id", buckets) for k, df in frames.items()}


def tow_totals(tow, catch, specimen):
    """Each tow with its catch and its identified specimens; plain equality of the key keeps the buckets in use."""
    fish = catch.groupBy("op_id").agg(F.sum("n").alias("fish"))
    ids = specimen.filter("genetics IS NOT NULL").groupBy("op_id").agg(A.rows().alias("specimens"))
    return tow.join(fish, "op_id", "left").join(ids, "op_id", "left")


@query(
    "colocated_joins",
    """SELECT t.op_id, t.op_date, t.location, c.fish, f.specimens FROM v_tow t
       LEFT JOIN (SELECT op_id, CAST(sum(n) AS BIGINT) AS fish FROM v_catch GROUP BY 1) c USING (op_id)
       LEFT JOIN (SELECT op_id, count(*) AS specimens FROM v_specimen WHERE genetics IS NOT NULL GROUP BY 1) f USING (op_id)""",
)
def _(s):
    return tow_totals(**colocated(s))


@query(
    "left_join_chain",
    """SELECT a.year, a.tows, b.fish, c.specimens, R4(d.warmth) AS warmth
       FROM (SELECT CAST(year(op_date) AS INT) AS year, count(*) AS tows FROM v_tow GROUP BY 1) a
       LEFT JOIN (SELECT CAST(year(op_date) AS INT) AS year, CAST(sum(n) AS BIGINT) AS fish
                  FROM v_catch JOIN v_tow USING (op_id) GROUP BY 1) b USING (year)
       LEFT JOIN (SELECT CAST(year(op_date) AS INT) AS year, count(*) AS specimens
                  FROM v_specimen JOIN v_tow USING (op_id) WHERE genetics IS NOT NULL GROUP BY 1) c USING (year)
       LEFT JOIN (SELECT CAST(year(date) AS INT) AS year, sum(superior) AS warmth FROM v_daily_temp
                  WHERE year(date) > 1996 GROUP BY 1) d USING (year)""",
)
def _(s):
    years = s.tow.select("op_id", F.year("op_date").alias("year"))
    per_op = s.catch.groupBy("op_id").agg(F.sum("n").alias("n"))
    fish = per_op.join(years, "op_id").groupBy("year").agg(F.sum("n").alias("fish"))
    ids = s.specimen.filter("genetics IS NOT NULL").groupBy("op_id").agg(A.rows().alias("n"))
    specimens = ids.join(years, "op_id").groupBy("year").agg(F.sum("n").alias("specimens"))
    days = s.daily_temp.withColumn("year", F.year("date")).filter("year > 1996")
    warmth = days.groupBy("year").agg(F.sum("superior").alias("warmth"))
    tows = years.groupBy("year").agg(A.rows().alias("tows"))
    return fix(join_chain(tows, fish, specimens, warmth, keys=["year"]))


@query(
    "agg_join_back",
    """SELECT a.op_id, a.fish, b.net, b.species, b.n FROM
         (SELECT op_id, CAST(sum(n) AS BIGINT) AS fish FROM v_catch GROUP BY op_id) a
         JOIN (SELECT *, row_number() OVER (PARTITION BY op_id ORDER BY net, species, n) AS k FROM v_catch) b
         ON a.op_id = b.op_id AND b.k = 1""",
)
def _(s):
    total = F.sum("n").alias("fish")
    keep = ["net", "species", "n"]
    return aggregate_with_first(s.catch, ["op_id"], [total], keep, keep)


@query(
    "group_size_join",
    """SELECT op_id, specimen_number, genetics, count(*) OVER (PARTITION BY genetics) AS group_size FROM v_specimen""",
)
def _(s):
    df = s.specimen.select("op_id", "specimen_number", "genetics")
    return with_group_size(df, ["genetics"], "group_size", bounded=True)


@query(
    "env_date_join",
    """SELECT t.op_id, t.op_date AS date, d.superior FROM v_tow t
       LEFT JOIN (SELECT * FROM v_daily_temp WHERE superior > 4) d ON t.op_date = d.date""",
)
def _(s):
    tows = s.tow.select("op_id", F.col("op_date").alias("date"))
    return natural_join(tows, s.daily_temp.filter("superior > 4"), keys=["date"], bounded=True)


@query(
    "join_dedup",
    """SELECT s.location, s.shore_distance, b.sample, b.date, b.t3m FROM v_site s LEFT JOIN
         (SELECT *, row_number() OVER (PARTITION BY location ORDER BY date, sample) AS k FROM v_bt) b
         ON s.location = b.location AND b.k = 1""",
)
def _(s):
    casts = s.bt.select("location", "date", "sample", "t3m")
    return join_first(s.site, casts, ["location"], ["date", "sample"])
