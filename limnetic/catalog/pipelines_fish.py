"""Pipelines on identified fish, larvae and lengths."""

from __future__ import annotations

from limnetic.plans import genetics, larvae, lengths
from limnetic.session import written

from . import base
from .registry import fix, query, step
from .scalars import PAIR_SQL

YEAR = base.YEAR


@query(
    "genetics_master",
    """SELECT op_id, specimen_number, species, genetics, length, yolk_sac, match, common_name, genetics_name, date, tow_time,
       location, gear, year, month, week, date1, R6(mid_lat) AS mid_lat, R6(mid_depth) AS mid_depth,
       R6(shore_distance) AS shore_distance FROM o_fish""",
)
def _(s):
    keep = [
        "op_id", "specimen_number", "species", "genetics", "length", "yolk_sac", "match", "common_name",
        "genetics_name", "date", "tow_time", "location", "gear", "year", "month", "week", "date1", "mid_lat",
        "mid_depth", "shore_distance",
    ]
    return fix(base.fish(s).select(*keep), 6)


step(
    "o_strain",
    """SELECT f.op_id, location, mid_lat, mid_lon,
  CASE WHEN gp >= 0.7 THEN 'Grand Portage strain Cisco' ELSE 'Typical Cisco' END AS gpq
FROM v_specimen f JOIN o_tow USING (op_id) WHERE genetics = 202 AND gp IS NOT NULL""",
)
step(
    "o_strain_sites",
    """SELECT a.*, b.mid_lat, b.mid_lon, t.n FROM (SELECT location, gpq, count(*) AS fish FROM o_strain GROUP BY ALL) a
  JOIN (SELECT *, row_number() OVER (PARTITION BY location, gpq ORDER BY op_id) AS k FROM o_strain) b
    ON a.location = b.location AND a.gpq = b.gpq AND b.k = 1
  JOIN (SELECT gpq, count(*) AS n FROM o_strain GROUP BY gpq) t ON t.gpq = a.gpq""",
)


def _inlet(source: str) -> str:
    from .scalars import vincenty_sql

    return vincenty_sql(source, "mid_lon", "mid_lat")


step("o_strain_points", "SELECT DISTINCT mid_lon, mid_lat FROM o_strain_sites WHERE mid_lon IS NOT NULL")
step("o_strain_metres", _inlet("o_strain_points"))


@query(
    "strain_sites",
    """SELECT location, gpq, fish, n, gpq || ', n=' || n AS label1, R4(s.mid_lat) AS mid_lat, R4(s.mid_lon) AS mid_lon,
       R1(metres) AS inlet_metres FROM o_strain_sites s
       LEFT JOIN o_strain_metres m ON m.mid_lon = s.mid_lon AND m.mid_lat = s.mid_lat""",
)
def _(s):
    df = genetics.strain_sites(s.specimen, base.tows(s))
    return fix(fix(df, 1, "inlet_metres"), 4, "mid_lat", "mid_lon")


step("o_strain_fish_points", "SELECT DISTINCT mid_lon, mid_lat FROM o_strain WHERE mid_lon IS NOT NULL")
step("o_strain_fish_metres", _inlet("o_strain_fish_points"))


@query(
    "strain_fish",
    """SELECT f.op_id, f.specimen_number, f.length, f.gp, t.year, t.location, R4(t.mid_lat) AS mid_lat, R4(t.mid_lon) AS mid_lon,
       g.gpq, g.n, g.gpq || ', n=' || g.n AS label1, R1(m.metres) AS inlet_metres FROM v_specimen f LEFT JOIN o_tow t ON t.op_id = f.op_id
       JOIN (SELECT gpq, count(*) AS n FROM (SELECT CASE WHEN gp >= 0.7 THEN 'Grand Portage strain Cisco' ELSE 'Typical Cisco' END AS gpq
             FROM v_specimen WHERE genetics = 202 AND gp IS NOT NULL) GROUP BY gpq) g
         ON g.gpq = CASE WHEN f.gp >= 0.7 THEN 'Grand Portage strain Cisco' ELSE 'Typical Cisco' END
       LEFT JOIN o_strain_fish_metres m ON m.mid_lon = t.mid_lon AND m.mid_lat = t.mid_lat
       WHERE f.genetics = 202 AND f.gp IS NOT NULL""",
)
def _(s):
    df = genetics.strain_fish(s.specimen, base.tows(s))
    return fix(fix(df, 1, "inlet_metres"), 4, "mid_lat", "mid_lon")


step(
    "o_larval_catch",
    f"""SELECT a.*, b.mid_lat, b.mid_lon, b.mid_depth FROM
  (SELECT date, location, CAST(sum(fish) AS BIGINT) AS fish FROM o_density WHERE year = {YEAR} AND species IN (217, 0) GROUP BY ALL) a
  LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY date, location ORDER BY tow_time NULLS FIRST, species, op_id) AS k
             FROM o_density) b ON a.date = b.date AND a.location = b.location AND b.k = 1""",
)


@query(
    "collections",
    """SELECT date, location, 'Neuston' AS gear, R4(mid_lat) AS mid_lat, R4(mid_lon) AS mid_lon, R4(mid_depth) AS mid_depth,
         fish, CAST(year(date) AS INT) AS year, 'Larval' AS fish_type FROM o_larval_catch
       UNION ALL
       SELECT a.date, a.location, CASE WHEN month(a.date) <= 7 THEN 'Bottom trawl' ELSE 'Mid-Water trawl' END,
         R4(b.mid_lat), R4(b.mid_lon), R4(b.mid_depth), a.fish, CAST(year(a.date) AS INT), 'Age-0+' FROM
       (SELECT date, location, count(*) AS fish FROM o_fish WHERE gear <> 'Neuston' AND length <= 150 GROUP BY ALL) a
       LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY location ORDER BY op_id) AS k FROM o_fish) b
       ON a.location = b.location AND b.k = 1""",
)
def _(s):
    return fix(genetics.collections(base.density(s), s.specimen, base.all_tows(s), YEAR))


_COUNTS = ", ".join(
    f"count(*) FILTER (genetics_name = '{n}') AS {genetics.snake(n)}" for n in genetics.NAMES
)
_OTHER = "count(*) FILTER (genetics_name IS NULL OR genetics_name NOT IN (" + ", ".join(f"'{n}'" for n in genetics.NAMES) + ")) AS other"
_COUNTS = f"{_COUNTS}, {_OTHER}, count(*) AS total"
_COLUMNS = ", ".join(f"c.{genetics.snake(n)}" for n in (*genetics.NAMES, "other", "total"))


@query(
    "species_composition",
    f"""SELECT c.*, e.date, e.tow_time, e.location, R4(e.mid_lat) AS mid_lat, R4(e.mid_lon) AS mid_lon FROM
       (SELECT 'all' AS stage, op_id, {_COUNTS} FROM o_fish GROUP BY op_id UNION ALL
        SELECT 'age0', op_id, {_COUNTS} FROM o_fish WHERE gear <> 'Neuston' AND length <= 100 AND year = {YEAR} GROUP BY op_id) c
       LEFT JOIN o_all_effort e ON e.op_id = c.op_id
       UNION ALL
       SELECT 'larvae', b.op_id, {_COLUMNS}, c.date, c.tow_time, c.location,
         R4(b.mid_lat), R4(b.mid_lon) FROM
       (SELECT date, tow_time, location, {_COUNTS} FROM o_fish WHERE gear = 'Neuston' GROUP BY ALL) c
       LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY date, tow_time, location ORDER BY op_id) AS k FROM o_all_effort WHERE gear = 'Neuston') b
       ON b.date = c.date AND b.tow_time IS NOT DISTINCT FROM c.tow_time AND b.location = c.location AND b.k = 1""",
)
def _(s):
    return fix(genetics.species_composition(base.ids(s), base.all_tows(s), YEAR))


step(
    "o_week_first",
    """SELECT year, week, date1 FROM (SELECT *, row_number() OVER (PARTITION BY year, week ORDER BY date, op_id) AS k
  FROM o_all_effort) WHERE k = 1""",
)


def yolk_lengths_sql(extra: str) -> str:
    return f"""SELECT f.year, f.week, {extra} yolk_sac, n, R4(mean_l) AS mean_l, min_l, max_l, date1 FROM
       (SELECT year, week, {extra} yolk_sac, count(*) AS n, avg(length) AS mean_l, min(length) AS min_l, max(length) AS max_l
        FROM o_fish WHERE gear = 'Neuston' GROUP BY ALL HAVING count(length) = count(*)) f
       LEFT JOIN o_week_first w ON w.year = f.year AND w.week = f.week WHERE yolk_sac IS NOT NULL"""


@query("yolk_lengths", yolk_lengths_sql(""))
def _(s):
    effort, fish = base.effort_and_fish(s)
    return fix(genetics.yolk_lengths(fish, effort))


@query("yolk_lengths_species", yolk_lengths_sql("genetics_name,"))
def _(s):
    effort, fish = base.effort_and_fish(s)
    return fix(genetics.yolk_lengths(fish, effort, by_species=True))


def yolk_sql(source: str, name: str) -> str:
    return f"""SELECT a.date, a.{name}, a.y, a.n, 100.0::DOUBLE * y / nullif(y + n, 0) AS yolks, b.op_id, b.location, b.week, b.year FROM
  (SELECT date, {name}, count(*) FILTER (yolk_sac = 'Y') AS y, count(*) FILTER (yolk_sac = 'N') AS n FROM {source}
   WHERE yolk_sac IS NOT NULL GROUP BY ALL) a
  LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY date ORDER BY op_id) AS k FROM o_tow) b ON a.date = b.date AND b.k = 1"""


step(
    "o_named_larvae",
    """SELECT f.*, s.common_name, t.date FROM v_specimen f LEFT JOIN v_species s USING (species) LEFT JOIN o_tow t USING (op_id)""",
)
step("o_yolk", yolk_sql("o_named_larvae", "common_name"))


def named(s):
    return s.specimen.join(s.species, "species", "left")


def yolk(s):
    return genetics.yolk_proportion(named(s), base.tows(s), "common_name")


@query(
    "yolk_proportion",
    """SELECT date, common_name, y AS "Y", n AS "N", R4(yolks) AS yolks, op_id, location, week, year FROM o_yolk""",
)
def _(s):
    return fix(yolk(s))


step(
    "o_filtered_larvae",
    "SELECT * FROM o_named_larvae WHERE species IN (202, 204, 206, 217) AND length IS NOT NULL",
)
step("o_yolk_filtered", yolk_sql("o_filtered_larvae", "common_name"))


def filtered(s):
    return larvae.sized_larvae(named(s))


@query(
    "yolk_proportion_filtered",
    """SELECT date, common_name, y AS "Y", n AS "N", R4(yolks) AS yolks, op_id, location, week, year FROM o_yolk_filtered""",
)
def _(s):
    return fix(genetics.yolk_proportion(filtered(s), base.tows(s), "common_name"))


@query(
    "yolk_presence",
    """SELECT a.date, a.common_name, a.yolk_sac, a.n, CASE a.yolk_sac WHEN 'Y' THEN 'Present' WHEN 'N' THEN 'Absent' END AS yolk,
       b.op_id, b.location, b.week, b.year FROM
       (SELECT date, common_name, yolk_sac, count(*) AS n FROM o_filtered_larvae WHERE yolk_sac IS NOT NULL GROUP BY ALL) a
       LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY date ORDER BY op_id) AS k FROM o_tow) b ON a.date = b.date AND b.k = 1""",
)
def _(s):
    return genetics.yolk_presence(filtered(s), base.tows(s), "common_name")


step("o_yolk_genetic", yolk_sql("o_fish", "genetics_name"))


@query(
    "yolk_proportion_genetic",
    """SELECT date, genetics_name, y AS "Y", n AS "N", R4(yolks) AS yolks, op_id, location, week, year FROM o_yolk_genetic""",
)
def _(s):
    return fix(genetics.yolk_proportion(base.ids(s), base.tows(s), "genetics_name"))


@query(
    "yolk_week_first",
    """SELECT week, date, common_name, R4(yolks) AS yolks FROM
       (SELECT *, row_number() OVER (PARTITION BY week ORDER BY date, common_name) AS k FROM o_yolk) WHERE k = 1""",
)
def _(s):
    df = genetics.weekly_first(yolk(s).select("week", "date", "common_name", "yolks"), "common_name")
    return fix(df)


@query(
    "id_agreement",
    """SELECT a.genetics_name, a.common_name, a.n, R6(a.n / sum(a.n) OVER (PARTITION BY a.genetics_name)) AS share,
       CAST(round(CAST(a.n / sum(a.n) OVER (PARTITION BY a.genetics_name) * 100 AS DECIMAL(28,10)), 1) AS VARCHAR) || '%' AS label,
       b.group_size FROM (SELECT genetics_name, common_name, count(*) AS n FROM o_fish WHERE species <> 217 AND genetics <> 217 GROUP BY ALL) a
       JOIN (SELECT genetics_name, count(*) AS group_size FROM o_fish WHERE species <> 217 GROUP BY ALL) b USING (genetics_name)""",
)
def _(s):
    return fix(genetics.id_agreement(base.ids(s)), 6)


@query(
    "match_map",
    """SELECT op_id, genetics_name, count(*) FILTER (match = 'Yes') AS "Yes", count(*) FILTER (match = 'No') AS "No",
       count(*) AS fish, min(location) AS location, R4(min(mid_lat)) AS mid_lat, R4(min(mid_lon)) AS mid_lon,
       R4(min(mid_depth)) AS mid_depth FROM o_fish WHERE species <> 217 AND genetics <> 217 GROUP BY op_id, genetics_name""",
)
def _(s):
    return fix(genetics.match_map(base.ids(s), base.all_tows(s)))


step(
    "o_compared",
    f"""SELECT *, {PAIR_SQL} AS comparison, CASE WHEN species = genetics THEN 'Yes' ELSE 'No' END AS match,
  count(*) OVER (PARTITION BY genetics_name) AS n FROM
  (SELECT f.op_id, f.specimen_number, f.species, f.genetics, f.length, s.common_name, e.* EXCLUDE (op_id),
     CASE f.genetics WHEN 202 THEN 'Cisco' WHEN 204 THEN 'Bloater' WHEN 206 THEN 'Kiyi' WHEN 208 THEN 'Shortnose Cisco'
                     WHEN 217 THEN 'unidentified ciscoe' WHEN 218 THEN 'ciscoe hybrid' END AS genetics_name
   FROM v_specimen f LEFT JOIN o_trawl_effort e ON e.op_id = f.op_id LEFT JOIN v_species s ON s.species = f.species
   WHERE f.genetics IS NOT NULL AND f.length < 200)""",
)


@query(
    "match_map_sites",
    """SELECT a.op_id, a.genetics_name, a.specimen_number, a.location, b.yes AS "Yes", b.no AS "No", b.yes + b.no AS fish FROM
       (SELECT *, row_number() OVER (PARTITION BY op_id ORDER BY specimen_number, genetics_name NULLS FIRST) AS k FROM o_compared) a
       LEFT JOIN (SELECT op_id, genetics_name, count(*) FILTER (match = 'Yes') AS yes, count(*) FILTER (match = 'No') AS no
                  FROM o_compared GROUP BY ALL) b
       ON a.op_id = b.op_id AND a.genetics_name IS NOT DISTINCT FROM b.genetics_name WHERE k = 1""",
)
def _(s):
    return genetics.match_map_sites(base.compared_ids(s), base.trawl_tows(s))


def growth_sql(source: str, extra: str) -> str:
    return f"""SELECT genetics_name, n, R2(intercept) AS intercept, CAST(s AS DOUBLE) AS slope,
       genetics_name || ', ' || regexp_replace(CAST(s AS VARCHAR), '\\.?0+$', '') || ' mm per day' AS legend FROM
       (SELECT genetics_name, regr_count(length, epoch)::BIGINT AS n, regr_intercept(length, epoch) AS intercept,
          round_even(CAST(regr_slope(length, epoch) AS DECIMAL(18,6)), 2) AS s FROM
         (SELECT *, date_diff('day', DATE '1970-01-01', date) AS epoch FROM {source}) WHERE length IS NOT NULL AND year = {YEAR}
          AND ((length <= 80 AND month <= 7) OR month >= 8) AND ({extra}) GROUP BY genetics_name)"""


@query("species_growth", growth_sql("o_fish", "genetics IN (202, 204, 206) AND length < 140"))
def _(s):
    return fix(lengths.species_growth(base.fish(s), YEAR), 2, "intercept")


@query(
    "species_growth_trawl",
    growth_sql("o_compared", "genetics IN (202, 204) OR (genetics = 206 AND length < 120)"),
)
def _(s):
    df = lengths.species_growth(base.compared(s), YEAR, kiyi_below=120, all_below=None)
    return fix(df, 2, "intercept")


def growth_fish_sql(source: str, extra: str) -> str:
    return f"""SELECT f.op_id, f.specimen_number, f.genetics_name, f.date, f.length, g.slope, g.legend FROM {source} f
       JOIN ({growth_sql(source, extra)}) g USING (genetics_name)
       WHERE f.length IS NOT NULL AND f.year = {YEAR} AND ((f.length <= 80 AND f.month <= 7) OR f.month >= 8) AND ({extra})"""


FISH_KEYS = ["op_id", "specimen_number", "genetics_name", "date", "length"]


@query("species_growth_fish", growth_fish_sql("o_fish", "genetics IN (202, 204, 206) AND length < 140"))
def _(s):
    df = lengths.with_species_growth(base.fish(s).select(*FISH_KEYS, "genetics", "year", "month"), YEAR)
    return df.select(*FISH_KEYS, "slope", "legend")


@query(
    "species_growth_trawl_fish",
    growth_fish_sql("o_compared", "genetics IN (202, 204) OR (genetics = 206 AND length < 120)"),
)
def _(s):
    rows = base.compared(s).select(*FISH_KEYS, "genetics", "year", "month")
    df = lengths.with_species_growth(rows, YEAR, kiyi_below=120, all_below=None)
    return df.select(*FISH_KEYS, "slope", "legend")


STATS = """count(*) AS n, min(length) AS min_length, max(length) AS max_length, R4(avg(length)) AS mean_length,
  R4(median(length)) AS median_length, R4(stddev_samp(length)) AS sd_length, R4(stddev_samp(length) / sqrt(count(*))) AS se_length"""


def daily_sql(source: str, extra: str) -> str:
    return f"""SELECT date, genetics_name, CAST(year(date) AS INT) AS year, CAST(month(date) AS INT) AS month,
       CAST((dayofyear(date) - 1) // 7 + 1 AS INT) AS week, strftime(date, '%b') AS month_short, monthname(date) AS month_long,
       strftime(date, '%b') || ' ' || day(date) AS date1, {STATS} FROM {source}
       WHERE ({extra}) AND length IS NOT NULL AND ((length <= 80 AND month <= 7) OR month >= 8) GROUP BY date, genetics_name"""


@query("daily_lengths", daily_sql("o_fish", "genetics IN (202, 204, 206) AND length < 140"))
def _(s):
    return fix(lengths.daily_lengths(base.fish(s)))


@query("daily_lengths_trawl", daily_sql("o_compared", "genetics IN (202, 204, 208) OR (genetics = 206 AND length < 120)"))
def _(s):
    return fix(lengths.daily_lengths(base.compared(s), codes=(202, 204, 208), kiyi_below=120, all_below=None))


step(
    "o_tow_week_first",
    """SELECT year, week, date, op_id, date1 FROM (SELECT *, row_number() OVER (PARTITION BY year, week ORDER BY date, op_id) AS k
  FROM o_tow) WHERE k = 1""",
)


def weekly_sql(extra: str) -> str:
    return f"""SELECT a.*, s.common_name, w.date, w.op_id, w.date1 FROM
       (SELECT t.year, t.week, f.species, {extra} {STATS} FROM v_specimen f LEFT JOIN o_tow t ON f.op_id = t.op_id
        WHERE f.species IN (202, 204, 206, 217) AND f.length IS NOT NULL GROUP BY ALL) a
       LEFT JOIN v_species s ON s.species = a.species LEFT JOIN o_tow_week_first w ON w.year = a.year AND w.week = a.week"""


@query("weekly_lengths", weekly_sql(""))
def _(s):
    effort = written(base.tows(s), "effort")
    return fix(lengths.weekly_lengths(s.specimen, effort, s.species))


@query("weekly_lengths_yolk", weekly_sql("f.yolk_sac,"))
def _(s):
    effort = written(base.tows(s), "effort")
    return fix(lengths.weekly_lengths(s.specimen, effort, s.species, by_yolk=True))


@query(
    "id_comparison",
    """SELECT op_id, specimen_number, species, genetics, length, match, comparison, genetics_name, common_name, location, date, n
       FROM o_compared""",
)
def _(s):
    return base.compared(s).select(
        "op_id", "specimen_number", "species", "genetics", "length", "match", "comparison", "genetics_name",
        "common_name", "location", "date", "n",
    )


@query(
    "survey_pies",
    f"""SELECT op_id, month, {_COUNTS}, min(location) AS location, R4(min(mid_lat)) AS mid_lat,
       R4(min(mid_lon)) AS mid_lon,
       CASE WHEN month = 7 THEN 'July Bottom Trawl Survey' ELSE 'August-October Mid-Water Trawl Survey' END AS "group",
       CASE WHEN month = 7 THEN 1 ELSE 2 END AS group_no FROM o_compared WHERE month >= 7 AND length < 150 GROUP BY op_id, month""",
)
def _(s):
    return fix(genetics.survey_pies(base.compared_ids(s), base.trawl_tows(s)))


@query(
    "mismatch_by_catch",
    """SELECT op_id, count(*) AS fish, R4(100.0::DOUBLE * count(*) FILTER (match = 'No') / count(*)) AS mismatch
       FROM o_compared GROUP BY op_id""",
)
def _(s):
    return fix(genetics.mismatch_by_catch(base.compared_ids(s)))


step(
    "o_season_temp",
    f"""SELECT CAST(year(date) AS INT) AS year, CAST(month(date) AS INT) AS month, date, t3m AS temperature, chl_surf, chl3m,
  CASE WHEN month(date) = 6 THEN 'June' WHEN month(date) = 7 THEN 'July' ELSE 'Aug/Sep' END AS "group",
  CASE WHEN month(date) = 6 THEN 1 WHEN month(date) = 7 THEN 2 ELSE 3 END AS group_no
FROM v_bt WHERE year(date) IN (1996, 1998, {YEAR}) AND month(date) BETWEEN 6 AND 10""",
)
step(
    "o_season_days",
    """SELECT date, "group", group_no, CASE WHEN count(temperature) = count(*) THEN avg(temperature) END AS mean_temp,
  CASE WHEN count(chl_surf) = count(*) THEN avg(chl_surf) END AS mean_surf_chl,
  CASE WHEN count(chl3m) = count(*) THEN avg(chl3m) END AS mean_chl3m FROM o_season_temp GROUP BY ALL""",
)


def season_days(s):
    return larvae.temperature_days(larvae.temperature_rows(s.bt, (1996, 1998, YEAR)))


@query(
    "temperature_groups",
    """SELECT date, "group", group_no, R4(mean_temp) AS mean_temp, R4(mean_surf_chl) AS mean_surf_chl, R4(mean_chl3m) AS mean_chl3m
       FROM o_season_days""",
)
def _(s):
    return fix(season_days(s))


@query(
    "temp_vs_yolk",
    f"""SELECT d.date, R4(mean_temp) AS mean_temp, common_name, R4(yolks) AS yolks FROM
       (SELECT date, CASE WHEN count(t3m) = count(*) THEN avg(t3m) END AS mean_temp FROM v_bt WHERE year(date) = {YEAR} GROUP BY date) d
       LEFT JOIN o_yolk y ON y.date = d.date""",
)
def _(s):
    df = larvae.temp_vs_yolk(s.bt, yolk(s), YEAR)
    return fix(df.select("date", "mean_temp", "common_name", "yolks"))


step(
    "o_expanded",
    f"""SELECT f.op_id, f.length, e.date, e.location, e.gear, f.exp_n AS w FROM v_specimen f JOIN o_trawl_effort e ON e.op_id = f.op_id
  WHERE f.exp_n > 0 AND e.year = {YEAR} AND e.month > 7 AND f.length < 130 AND f.species IN (202, 204, 206, 217)
UNION ALL
SELECT f.op_id, f.length, t.date, t.location, t.gear, 1 FROM v_specimen f JOIN o_tow t ON t.op_id = f.op_id
  WHERE t.year = {YEAR} AND t.tr_design = {base.SURFACE_DESIGN} AND f.length < 130 AND f.species IN (202, 204, 206, 217)""",
)
step(
    "o_expanded_first",
    """SELECT date, op_id, location, gear FROM (SELECT *, row_number() OVER (PARTITION BY date ORDER BY op_id) AS k FROM o_expanded)
WHERE k = 1""",
)


@query(
    "expanded_daily_lengths",
    f"""SELECT a.*, b.op_id, b.location, b.gear, R4(t.mean_temp) AS mean_temp FROM
       (SELECT date, {STATS} FROM o_expanded, generate_series(1, w) GROUP BY date) a
       JOIN o_expanded_first b USING (date) LEFT JOIN o_season_days t ON t.date = a.date""",
)
def _(s):
    surface = base.all_tows(s).filter("gear = 'Neuston'")
    df = lengths.expanded_daily_lengths(
        s.specimen, base.trawl_tows(s), s.specimen, surface, season_days(s).select("date", "mean_temp"), YEAR
    )
    return fix(df)
