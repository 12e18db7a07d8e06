"""Tables that several queries start from, in DataFrames and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from limnetic.plans import climate, effort, genetics, larvae, lengths

from limnetic.session import written

from .registry import step

FROM_YEAR, YEAR, SKIP_YEAR, AFTER_YEAR = 1996, 2000, 1999, 1995
YEARS = (1995, 1996, 1997, 1998, 2000, 2001)
ICE_YEARS = tuple(f"y{y}" for y in range(1995, 2002))
SURFACE_DESIGN = 99  # tows of no trawl design are the surface tows


def bt_daily(s) -> DataFrame:
    return effort.bt_daily(s.bt, FROM_YEAR)


def tows(s) -> DataFrame:
    """Every tow taken as a surface tow."""
    return effort.neuston_effort(s.tow, s.site)


def density(s) -> DataFrame:
    return effort.catch_density(s.tow, s.catch, s.site, s.species, bt_daily(s))


def trawl_tows(s) -> DataFrame:
    trawled = s.tow.filter(F.col("tr_design") != SURFACE_DESIGN)
    return effort.trawl_effort(trawled, s.trawl, s.site)


def all_tows(s) -> DataFrame:
    surface = s.tow.filter(F.col("tr_design") == SURFACE_DESIGN)
    return effort.effort_union(trawl_tows(s), effort.neuston_effort(surface, s.site))


def fish(s) -> DataFrame:
    return genetics.genetics_master(s.specimen.drop("gp", "exp_n"), all_tows(s), s.species)


def effort_and_fish(s) -> tuple[DataFrame, DataFrame]:
    """The effort table, written once, and the identified fish joined to it."""
    effort_rows = written(all_tows(s), "effort")
    return effort_rows, genetics.genetics_master(s.specimen.drop("gp", "exp_n"), effort_rows, s.species)


def ids(s) -> DataFrame:
    return genetics.named_ids(s.specimen.drop("gp", "exp_n"), s.species)


def compared_ids(s) -> DataFrame:
    return genetics.compared_ids(s.specimen, s.species)


def length_rows(s) -> DataFrame:
    return lengths.length_set(s.specimen, tows(s), s.species)


def larval_counts(s) -> DataFrame:
    return larvae.larval_counts(s.specimen, tows(s), s.species)


def compared(s) -> DataFrame:
    return genetics.id_comparison(s.specimen, trawl_tows(s), s.species)


def degree_days(s) -> DataFrame:
    return climate.degree_days(s.daily_temp)


PARTS = """CAST(day({d}) AS INT) AS day, CAST((dayofyear({d}) - 1) // 7 + 1 AS INT) AS week,
  CAST(month({d}) AS INT) AS month, strftime({d}, '%b') AS month_short, monthname({d}) AS month_long,
  CAST(dayofyear({d}) AS INT) AS jday, CAST(year({d}) AS INT) AS year,
  strftime({d}, '%b') || ' ' || CAST(day({d}) AS VARCHAR) AS date1"""

step(
    "o_tow",
    f"""SELECT op_id, target, op_date AS date, tow_time, location, distance, tr_design, beg_depth, end_depth, state,
  coalesce(beg_lat, end_lat) AS beg_lat, coalesce(end_lat, beg_lat) AS end_lat,
  coalesce(beg_lon, end_lon) AS beg_lon, coalesce(end_lon, beg_lon) AS end_lon,
  (coalesce(beg_lat, end_lat) + coalesce(end_lat, beg_lat)) / 2 AS mid_lat,
  (coalesce(beg_lon, end_lon) + coalesce(end_lon, beg_lon)) / 2 AS mid_lon,
  (beg_depth + end_depth) / 2 AS mid_depth, 'Neuston' AS gear, CAST(0.5 AS DOUBLE) AS fishing_depth,
  shore_distance, {PARTS.format(d="op_date")}
FROM v_tow LEFT JOIN v_site USING (location)""",
)
step(
    "o_bt_daily",
    f"""SELECT location, date,
  CASE WHEN count(surface_t) = count(*) THEN avg(surface_t) END AS tsurface,
  CASE WHEN count(t3m) = count(*) THEN avg(t3m) END AS t3m,
  CASE WHEN count(chl_surf) = count(*) THEN avg(chl_surf) END AS chl_surface,
  CASE WHEN count(chl3m) = count(*) THEN avg(chl3m) END AS chl3m, CAST(year(date) AS INT) AS year
FROM v_bt WHERE year(date) >= {FROM_YEAR} GROUP BY location, date""",
)
step(
    "o_composite",
    """SELECT date, tow_time, location, species, CAST(sum(n) AS BIGINT) AS fish, min(op_id) AS op_id
FROM v_catch JOIN o_tow USING (op_id) GROUP BY date, tow_time, location, species""",
)
step(
    "o_density",
    """SELECT k.*, t.target, t.gear, t.mid_lat, t.mid_lon, t.mid_depth, t.fishing_depth, t.shore_distance,
  t.day, t.week, t.month, t.month_short, t.month_long, t.jday, t.year, t.date1, s.common_name,
  k.fish / nullif(t.distance * 5280 * 6.56168 / 107639.1, 0) AS fish_ha,
  b.tsurface, b.t3m, b.chl_surface, b.chl3m
FROM o_composite k JOIN o_tow t ON k.op_id = t.op_id LEFT JOIN v_species s ON k.species = s.species
LEFT JOIN o_bt_daily b ON b.location = k.location AND b.date = k.date""",
)
step(
    "o_trawl",
    """SELECT t.* EXCLUDE (tow_time, state, mid_depth, gear, fishing_depth),
  nullif(tow_time_raw, 0) AS tow_time,
  trim(CASE state WHEN 'E' THEN 'ONT.E' WHEN 'W' THEN 'ONT.W' ELSE state END) AS state,
  coalesce((beg_depth + end_depth) / 2, beg_depth, end_depth) AS mid_depth,
  CASE WHEN tr_design IN (4, 25) THEN 'Bottom trawl' WHEN tr_design IN (21, 45) THEN 'Mid-water trawl' END AS gear,
  CASE WHEN tr_design IN (4, 25) THEN coalesce((beg_depth + end_depth) / 2, beg_depth, end_depth)
       WHEN tr_design IN (21, 45) THEN nullif(fishing_depth_raw, 0) END AS fishing_depth,
  (SELECT avg(x) FROM unnest([nullif(surf_temp, 0), nullif(beg_surf, 0), nullif(end_surf, 0)]) u(x)) AS surface_temp,
  (SELECT avg(x) FROM unnest([nullif(beg_bottom, 0), nullif(end_bottom, 0), temp_beg_bottom, temp_end_bottom]) u(x)) AS bottom_temp
FROM o_tow t JOIN v_trawl w USING (op_id)""",
)
_EFFORT = ", ".join(effort.EFFORT)
step("o_trawl_effort", f"SELECT {_EFFORT} FROM o_trawl WHERE tr_design <> {SURFACE_DESIGN}")
step(
    "o_all_effort",
    f"""SELECT {_EFFORT} FROM o_trawl_effort UNION ALL
SELECT {_EFFORT} FROM o_tow WHERE tr_design = {SURFACE_DESIGN}""",
)
step(
    "o_fish",
    """SELECT f.op_id, f.specimen_number, f.species, f.genetics, f.length, f.yolk_sac,
  CASE WHEN f.species = f.genetics THEN 'Yes' WHEN f.species <> f.genetics THEN 'No' END AS match,
  e.* EXCLUDE (op_id), s.common_name, g.genetics_name
FROM v_specimen f LEFT JOIN o_all_effort e ON f.op_id = e.op_id LEFT JOIN v_species s ON f.species = s.species
LEFT JOIN o_genetic_names g ON f.genetics = g.genetics WHERE f.genetics IS NOT NULL""",
)
step(
    "o_lengths",
    """SELECT f.op_id, f.species, f.length, s.common_name, t.* EXCLUDE (op_id)
FROM v_specimen f LEFT JOIN v_species s ON f.species = s.species LEFT JOIN o_tow t ON f.op_id = t.op_id
WHERE f.species IN (202, 203, 204, 206, 208, 210, 217, 218) AND f.length < 30 AND f.length >= 5""",
)
step(
    "o_larval",
    """SELECT f.op_id, f.species, f.n, t.* EXCLUDE (op_id), s.common_name
FROM (SELECT op_id, species, count(*) AS n FROM v_specimen WHERE species IS NOT NULL GROUP BY op_id, species) f
LEFT JOIN o_tow t ON f.op_id = t.op_id LEFT JOIN v_species s ON f.species = s.species""",
)
step(
    "o_degree_days",
    f"""SELECT date, {PARTS.format(d="date")}, superior AS surft,
  sum(superior) OVER (PARTITION BY year(date) ORDER BY date) AS surfdd FROM v_daily_temp""",
)
