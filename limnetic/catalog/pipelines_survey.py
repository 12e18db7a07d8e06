"""Climate, effort, density and annual pipelines."""

from __future__ import annotations

from pyspark.sql import functions as F

from limnetic.plans import climate, effort, genetics, lengths, reports
from limnetic.operators.statistics import regression_summary
from limnetic.session import shared_path, written
from limnetic.sources import sheets
from limnetic.sources.files import polygon_vertices
from limnetic.functions import geo

from . import base
from .columns import rings
from .registry import fix, query, step
from .scalars import inverse_mercator_sql

# -- climate -----------------------------------------------------------------

_ICE = "\nUNION ALL ".join(
    f"SELECT CAST(m AS INT) AS m, CAST(d AS INT) AS d, {y} AS ice_year, y{y} AS ice_cover FROM v_ice_wide"
    for y in range(1995, 2002)
)
step("o_ice_rows", _ICE)
step(
    "o_ice",
    """SELECT m, d, ice_year, ice_cover, j, CASE WHEN j > 250 THEN ice_year - 1 WHEN j < 250 THEN ice_year END AS year,
  CASE WHEN j < 250 THEN j WHEN j > 250 THEN j - 366 END AS jday2 FROM
  (SELECT *, CAST(dayofyear(make_date(2000, m, d)) AS INT) AS j FROM o_ice_rows)""",
)


def ice(s):
    return climate.ice_long(s.ice_wide, base.ICE_YEARS)


@query(
    "ice_season",
    """SELECT ice_year, m AS month, monthname(make_date(2000, m, d)) AS month_long, j AS jday, CAST(year AS INT) AS year,
       CAST(jday2 AS INT) AS jday2, try_cast(printf('%04d-%02d-%02d', year, m, d) AS DATE) AS date, ice_cover FROM o_ice""",
)
def _(s):
    return ice(s)


step(
    "o_ice_month",
    """SELECT CAST(ice_year AS INT) AS year, m AS month, min(ice_cover) AS ice_min, max(ice_cover) AS ice_max,
  avg(ice_cover) AS ice_mean FROM o_ice WHERE ice_year >= 1996 GROUP BY 1, 2""",
)


@query("ice_monthly", "SELECT year, month, ice_min, ice_max, R4(ice_mean) AS ice_mean FROM o_ice_month")
def _(s):
    return fix(climate.ice_monthly(ice(s), base.FROM_YEAR))


@query(
    "bt_daily",
    """SELECT location, date, year, R4(tsurface) AS tsurface, R4(t3m) AS t3m, R4(chl_surface) AS chl_surface,
       R4(chl3m) AS chl3m FROM o_bt_daily""",
)
def _(s):
    return fix(base.bt_daily(s))


step(
    "o_weather_month",
    """SELECT CAST(year(date) AS INT) AS year, CAST(month(date) AS INT) AS month, min(rwsp) AS wspd_min,
  max(rwsp) AS wspd_max, avg(rwsp) AS wspd_mean, sum(rwsp) AS wspd_sum, min(atmp) AS airt_min, max(atmp) AS airt_max,
  avg(atmp) AS airt_mean FROM v_weather GROUP BY 1, 2""",
)


@query(
    "weather_monthly",
    """SELECT year, month, R4(wspd_min) AS wspd_min, R4(wspd_max) AS wspd_max, R4(wspd_mean) AS wspd_mean,
       R4(wspd_sum) AS wspd_sum, R4(airt_min) AS airt_min, R4(airt_max) AS airt_max, R4(airt_mean) AS airt_mean
       FROM o_weather_month""",
)
def _(s):
    return fix(climate.weather_monthly(s.weather))


step(
    "o_dd_month",
    """SELECT year, month, min(surft) AS surft_min, max(surft) AS surft_max, avg(surft) AS surft_mean,
  min(surfdd) AS surfdd_min, max(surfdd) AS surfdd_max, avg(surfdd) AS surfdd_mean
FROM o_degree_days WHERE year >= 1996 GROUP BY year, month""",
)


@query(
    "degree_days",
    """SELECT year, month, surft_min, surft_max, R4(surft_mean) AS surft_mean, surfdd_min, surfdd_max,
       R4(surfdd_mean) AS surfdd_mean FROM o_dd_month""",
)
def _(s):
    return fix(climate.degree_days_monthly(base.degree_days(s), base.FROM_YEAR))


# -- effort and density ------------------------------------------------------


@query(
    "neuston_clean",
    """SELECT op_id, date, year, month, month_long, week, jday, date1, location, tow_time, gear, fishing_depth,
       R6(shore_distance) AS shore_distance, R6(beg_lat) AS beg_lat, R6(end_lon) AS end_lon, R6(mid_lat) AS mid_lat,
       R6(mid_lon) AS mid_lon, R6(mid_depth) AS mid_depth FROM o_tow""",
)
def _(s):
    df = effort.neuston_clean(s.tow, s.site).select(
        "op_id", "date", "year", "month", "month_long", "week", "jday", "date1", "location", "tow_time", "gear",
        "fishing_depth", "shore_distance", "beg_lat", "end_lon", "mid_lat", "mid_lon", "mid_depth",
    )
    return fix(df, 6)


@query(
    "effort_table",
    """SELECT op_id, t.date, t.location, t.year, R6(mid_lat) AS mid_lat, R6(shore_distance) AS shore_distance,
       R6(tsurface) AS tsurface, R6(t3m) AS t3m, R6(chl_surface) AS chl_surface, R6(chl3m) AS chl3m
       FROM o_tow t LEFT JOIN o_bt_daily b ON t.location = b.location AND t.date = b.date""",
)
def _(s):
    df = effort.effort_table(s.tow, s.site, base.bt_daily(s))
    keep = ["op_id", "date", "location", "year", "mid_lat", "shore_distance", "tsurface", "t3m", "chl_surface", "chl3m"]
    return fix(df.select(*keep), 6)


CATCH_DENSITY_SQL = """SELECT op_id, target, date, tow_time, date1, week, day, month, month_short, month_long, jday, year, gear, location,
       R4(mid_lat) AS mid_lat, R4(mid_lon) AS mid_lon, R4(mid_depth) AS mid_depth, R4(fishing_depth) AS fishing_depth,
       R4(shore_distance) AS shore_distance, species, common_name, fish, R4(fish_ha) AS fish_ha, R4(tsurface) AS tsurface,
       R4(t3m) AS t3m, R4(chl_surface) AS chl_surface, R4(chl3m) AS chl3m FROM o_density"""


@query("catch_density", CATCH_DENSITY_SQL)
def _(s):
    return fix(base.density(s))


@query("sheet_density", CATCH_DENSITY_SQL)
def _(s):
    """The same from sheets: written under their declared names and columns, and scanned by default schemas."""
    root = shared_path(s.spark, "books")
    caught = s.tow.join(s.catch.select("op_id", "species", "n"), "op_id")
    for (book, sheet), df in {
        ("neuston", "catch"): caught, ("shore", "distance"): s.site, ("species", "taxonomy"): s.species, ("bt", "sample"): s.bt,
    }.items():
        sheets.write_plan_table(df, root, book, sheet)
    tow, catch = sheets.tows_and_catch(s.spark, root, "neuston")
    site, species, bt = (sheets.plan_table(s.spark, root, *x) for x in (("shore", "distance"), ("species", "taxonomy"), ("bt", "sample")))
    density = effort.catch_density(
        tow, catch, site, species.select("species", "common_name"), effort.bt_daily(bt.drop("year"), base.FROM_YEAR)
    )
    return fix(density)


step(
    "o_genetics_year",
    """SELECT year, count(*) AS genetics FROM v_specimen JOIN o_tow USING (op_id) WHERE genetics IS NOT NULL GROUP BY year""",
)


@query(
    "genetics_counts",
    """SELECT year, genetics_name, c.n AS genetics_fish, y.genetics FROM
       (SELECT year, genetics_name, count(*) AS n FROM v_specimen JOIN o_tow USING (op_id) JOIN o_genetic_names USING (genetics)
        GROUP BY year, genetics_name) c JOIN o_genetics_year y USING (year)""",
)
def _(s):
    return genetics.genetics_counts(s.specimen, base.tows(s))


step("o_cisco_rows", "SELECT *, species IN (202, 203, 204, 206, 208, 210, 211, 217, 218) AS cisco FROM o_density")
step(
    "o_sites_year",
    """SELECT year, count(DISTINCT location) AS all_sites, count(DISTINCT CASE WHEN species = 0 THEN location END) AS absent_sites,
  count(DISTINCT CASE WHEN cisco THEN location END) AS present_sites FROM o_cisco_rows GROUP BY year""",
)
step(
    "o_collections_year",
    """SELECT year, count(*) AS all_rows, count(DISTINCT op_id) AS all_collections,
  count(DISTINCT CASE WHEN species = 0 THEN op_id END) AS absent_collections,
  count(DISTINCT CASE WHEN cisco THEN op_id END) AS present_collections FROM
  (SELECT *, row_number() OVER (PARTITION BY year, location, date, tow_time ORDER BY species, op_id) AS k FROM o_cisco_rows)
WHERE k = 1 GROUP BY year""",
)


@query(
    "site_totals",
    """SELECT *, all_sites || ' / ' || present_sites AS sites, all_collections || ' / ' || present_collections AS collections
       FROM o_sites_year JOIN o_collections_year USING (year)""",
)
def _(s):
    return reports.site_totals(base.density(s))


@query(
    "site_totals_overall",
    """SELECT count(DISTINCT location) AS all_sites, count(DISTINCT CASE WHEN cisco THEN location END) AS present_sites
       FROM o_cisco_rows""",
)
def _(s):
    return reports.sites_overall(base.density(s))


@query(
    "site_totals_location",
    """SELECT location, count(DISTINCT date::VARCHAR || coalesce(tow_time::VARCHAR, '')) AS collections,
       CAST(coalesce(sum(CASE WHEN cisco THEN fish END), 0) AS BIGINT) AS fish FROM o_cisco_rows GROUP BY location""",
)
def _(s):
    return reports.sites_by_location(base.density(s))


# -- lengths and the annual report ---------------------------------------------


@query(
    "length_set",
    """SELECT op_id, species, length, common_name, date, year, month, month_long, jday, location, R6(mid_lat) AS mid_lat FROM o_lengths""",
)
def _(s):
    keep = ["op_id", "species", "length", "common_name", "date", "year", "month", "month_long", "jday", "location", "mid_lat"]
    return fix(base.length_rows(s).select(*keep), 6)


def _even(x: str, digits: int) -> str:
    return f"CAST(round_even(CAST({x} AS DECIMAL(18,6)), {digits}) AS DOUBLE)"


_MONTH_L = ", ".join(
    f"{_even(f'avg(CASE WHEN month = {m} THEN length END)', 1)} AS {name}_l"
    for m, name in ((5, "may"), (6, "june"), (7, "july"))
)
step(
    "o_length_year",
    f"""SELECT year, n_l, mean_l, median_l, min_l, max_l, may_l, june_l, july_l FROM
  (SELECT year, count(*) AS n_l, {_even('avg(length)', 1)} AS mean_l, {_even('median(length)', 1)} AS median_l,
    {_even('min(length)', 1)} AS min_l, {_even('max(length)', 1)} AS max_l
   FROM o_lengths WHERE month <= 7 GROUP BY year) a
  LEFT JOIN (SELECT year, {_MONTH_L} FROM o_lengths GROUP BY year) b USING (year)""",
)


@query("length_summary", "SELECT * FROM o_length_year")
def _(s):
    return reports.length_summary(base.length_rows(s))


_NOHA = ", ".join(
    f"{_even(f'avg(CASE WHEN month = {i} THEN fish_ha END)', 0)} AS \"{m}\""
    for i, m in zip(range(5, 11), reports.SUMMER)
)


@query(
    "annual_summary",
    f"""SELECT a.*, y.genetics, s.all_sites || ' / ' || s.present_sites AS sites,
       c.all_collections || ' / ' || c.present_collections AS collections, l.* EXCLUDE (year) FROM
       (SELECT year, monthname(min(date)) || ' ' || day(min(date)) AS date_min, monthname(max(date)) || ' ' || day(max(date)) AS date_max,
          min(fish) AS catch_min, CAST(sum(fish) AS BIGINT) AS catch_total,
          {_even('avg(CASE WHEN month <= 7 THEN fish_ha END)', 0)} AS noha_mean,
          {_even('median(CASE WHEN month <= 7 THEN fish_ha END)', 0)} AS noha_median,
          {_even('max(fish_ha)', 0)} AS noha_max, {_NOHA}
        FROM o_cisco_rows WHERE cisco OR species = 0 GROUP BY year) a
       LEFT JOIN o_genetics_year y USING (year) LEFT JOIN o_sites_year s USING (year)
       LEFT JOIN o_collections_year c USING (year) LEFT JOIN o_length_year l ON l.year = a.year""",
)
def _(s):
    per_year = genetics.genetics_per_year(s.specimen, base.tows(s))
    return reports.annual_summary(base.density(s), per_year, base.length_rows(s))


step(
    "o_growth",
    f"""SELECT year, intercept, CAST(s AS DOUBLE) AS slope,
  year || ', ' || regexp_replace(CAST(s AS VARCHAR), '\\.?0+$', '') || ' mm per day' AS legend FROM
  (SELECT year, regr_intercept(length, jday) AS intercept,
          round_even(CAST(regr_slope(length, jday) AS DECIMAL(18,6)), 2) AS s FROM o_lengths GROUP BY year)""",
)


@query(
    "annual_growth",
    """SELECT op_id, species, length, jday, l.year, R4(intercept) AS intercept, slope, legend
       FROM o_lengths l LEFT JOIN o_growth USING (year)""",
)
def _(s):
    rows = base.length_rows(s).select("op_id", "species", "length", "jday", "year")
    return fix(lengths.with_annual_growth(rows))


@query(
    "length_by_station",
    """SELECT m.date, m.location, m.species, R4(m.mean_l) AS mean_l, t.op_id, s.common_name, R4(b.t3m) AS t3m,
       CASE WHEN t.month BETWEEN 5 AND 9 THEN t.month_long END AS month_long,
       CASE WHEN t.month BETWEEN 5 AND 9 THEN t.month - 4 END AS month_no FROM
       (SELECT date, location, species, avg(length) AS mean_l FROM o_lengths WHERE length >= 8 GROUP BY ALL) m
       LEFT JOIN o_tow t ON t.date = m.date AND t.location = m.location
       LEFT JOIN o_bt_daily b ON b.date = t.date AND b.location = t.location
       LEFT JOIN v_species s ON s.species = m.species""",
)
def _(s):
    table = effort.effort_table(s.tow, s.site, base.bt_daily(s))
    df = lengths.length_by_station(base.length_rows(s), table, s.species)
    return fix(df.select("date", "location", "species", "mean_l", "op_id", "common_name", "t3m", "month_long", "month_no"))


# -- stations, offshore, pies ------------------------------------------------------

step(
    "o_stations",
    """SELECT a.*, jday_max - jday_min AS jday_range, f.month_long FROM
  (SELECT location, avg(jday) AS jday_mean, median(jday) AS jday_median, min(jday) AS jday_min, max(jday) AS jday_max,
     CASE WHEN count(mid_lat) = count(*) THEN avg(mid_lat) END AS mid_lat,
     CASE WHEN count(mid_lon) = count(*) THEN avg(mid_lon) END AS mid_lon,
     CASE WHEN count(shore_distance) = count(*) THEN avg(shore_distance) END AS shore_distance,
     CASE WHEN count(mid_depth) = count(*) THEN avg(mid_depth) END AS mid_depth,
     CASE WHEN count(fish_ha) = count(*) THEN avg(fish_ha) END AS fish_ha, count(*) AS samples
   FROM o_cisco_rows WHERE (cisco OR species = 0) AND month <= 7 GROUP BY location HAVING count(*) >= 2) a
  LEFT JOIN (SELECT location, month_long, row_number() OVER (PARTITION BY location
               ORDER BY date, tow_time NULLS FIRST, species, op_id) AS k FROM o_density) f
  ON f.location = a.location AND f.k = 1""",
)


@query(
    "station_means",
    """SELECT location, R4(jday_mean) AS jday_mean, R4(jday_median) AS jday_median, jday_min, jday_max, jday_range,
       R4(mid_lat) AS mid_lat, R4(mid_lon) AS mid_lon, R4(shore_distance) AS shore_distance, R4(mid_depth) AS mid_depth,
       R4(fish_ha) AS fish_ha, samples, month_long FROM o_stations""",
)
def _(s):
    return fix(reports.station_means(base.density(s)))


@query(
    "station_date_ranges",
    "SELECT R4(avg(jday_range)) AS mean_range, R4(median(jday_range)) AS median_range FROM o_stations",
)
def _(s):
    return fix(reports.station_date_ranges(reports.station_means(base.density(s))))


step(
    "o_offshore",
    """SELECT * FROM o_density WHERE target = 2 OR target = 118 OR (target = 117 AND year > 1995 AND mid_depth > 80)""",
)
step(
    "o_offshore_once",
    """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY date, location ORDER BY tow_time NULLS FIRST, species, op_id) AS k
  FROM o_offshore) WHERE k = 1 AND month < 8""",
)


@query(
    "offshore_annual",
    """SELECT 'year' AS period, year AS value, count(*) AS n, CAST(sum(fish) AS BIGINT) AS fish_sum, R4(avg(fish_ha)) AS fish_mean
       FROM o_offshore_once GROUP BY year UNION ALL
       SELECT 'month', month, count(*), CAST(sum(fish) AS BIGINT), R4(avg(fish_ha)) FROM o_offshore_once GROUP BY month""",
)
def _(s):
    return fix(reports.offshore_summary(base.density(s), base.AFTER_YEAR))


step(
    "o_pie_rows",
    """SELECT DISTINCT location, 'month' AS kind, month_long AS part, date FROM o_density
  WHERE month BETWEEN 5 AND 10 UNION ALL
SELECT DISTINCT location, 'year', CAST(year AS VARCHAR), NULL::DATE FROM o_density WHERE year IN (1995, 1996, 1997, 1998, 2000, 2001)""",
)
step(
    "o_pie_parts",
    """SELECT 'month' AS kind, m AS part FROM (VALUES ('May'), ('June'), ('July'), ('August'), ('September'), ('October')) a(m)
UNION ALL SELECT 'year', y FROM (VALUES ('1995'), ('1996'), ('1997'), ('1998'), ('2000'), ('2001')) b(y)""",
)
step(
    "o_pie_first",
    """SELECT location, mid_lat, mid_lon FROM (SELECT *, row_number() OVER (PARTITION BY location
  ORDER BY date, tow_time NULLS FIRST, species, op_id) AS k FROM o_density) WHERE k = 1""",
)


@query(
    "effort_pies",
    """SELECT location, kind, part, R4(mid_lat) AS mid_lat, R4(mid_lon) AS mid_lon,
       R4(n / nullif(sum(n) OVER (PARTITION BY location, kind), 0)) AS share FROM
       (SELECT f.location, f.mid_lat, f.mid_lon, p.kind, p.part, count(r.location) AS n
        FROM o_pie_first f CROSS JOIN o_pie_parts p
        LEFT JOIN o_pie_rows r ON r.location = f.location AND r.kind = p.kind AND r.part = p.part GROUP BY ALL)""",
)
def _(s):
    return fix(reports.effort_pies(base.density(s), base.YEARS))


# -- degree-days against length and density -------------------------------------

step(
    "o_dd_length",
    """SELECT d.year, d.month_long, d.max_dd, n.noha_mean, l.mean_l FROM
  (SELECT year, month_long, max(surfdd) AS max_dd FROM o_degree_days GROUP BY ALL) d
  JOIN (SELECT year, month_long, avg(fish_ha) AS noha_mean FROM o_density WHERE month BETWEEN 5 AND 10 GROUP BY ALL) n
    USING (year, month_long)
  JOIN (SELECT year, month_long, avg(length) AS mean_l FROM o_lengths GROUP BY ALL) l USING (year, month_long)
  WHERE noha_mean IS NOT NULL AND mean_l IS NOT NULL""",
)


def monthly_dd(s, rows=None):
    months = reports.monthly_density(base.density(s)).filter(F.col("month_long").isin(*reports.SUMMER))
    rows = rows if rows is not None else base.length_rows(s)
    return climate.dd_vs_length(base.degree_days(s), months, reports.length_months(rows))


@query(
    "dd_vs_length",
    "SELECT year, month_long, R4(max_dd) AS max_dd, R4(noha_mean) AS noha_mean, R4(mean_l) AS mean_l FROM o_dd_length",
)
def _(s):
    return fix(monthly_dd(s))


def summary_sql(source: str, x: str, y: str, keys: str = "", extra: str = "") -> str:
    """Regression summary from the textbook sums of squares."""
    group = f"GROUP BY {keys}" if keys else ""
    lead = f"{keys}, " if keys else ""
    return f"""SELECT {lead}{extra} n, df, R4(intercept) AS intercept, R4(se0) AS intercept_se, R4(intercept / nullif(se0, 0)) AS intercept_t,
      R6(slope) AS slope, R6(se1) AS slope_se, R4(slope / nullif(se1, 0)) AS slope_t, R6(r2) AS r_squared,
      R6(1 - (1 - r2) * (n - 1) / nullif(df, 0)) AS adj_r_squared, R4(slope * slope / nullif(se1 * se1, 0)) AS f FROM
      (SELECT *, sqrt(mse / nullif(sxx, 0)) AS se1, sqrt(mse * (1.0 / n + mx * mx / nullif(sxx, 0))) AS se0 FROM
        (SELECT *, n - 2 AS df, CASE WHEN n > 2 THEN (syy - slope * sxy) / (n - 2) END AS mse FROM
          (SELECT {lead} regr_count({y}, {x})::BIGINT AS n, regr_slope({y}, {x}) AS slope, regr_intercept({y}, {x}) AS intercept,
             regr_sxx({y}, {x}) AS sxx, regr_sxy({y}, {x}) AS sxy, regr_syy({y}, {x}) AS syy, regr_avgx({y}, {x}) AS mx,
             regr_r2({y}, {x}) AS r2 FROM {source} {group})))"""


def rounded_summary(df):
    six = ["slope", "slope_se", "r_squared", "adj_r_squared"]
    four = [n for n, t in df.dtypes if t == "double" and n not in six]
    return fix(fix(df, 6, *six), 4, *four)


step(
    "o_dd_day",
    """SELECT l.mean_l, d.surfdd FROM (SELECT date, avg(length) AS mean_l FROM o_lengths GROUP BY date) l
  LEFT JOIN o_degree_days d USING (date)""",
)


@query(
    "dd_regression",
    f"""{summary_sql("o_dd_length", "max_dd", "mean_l", extra="'month' AS model,")}
    UNION ALL {summary_sql("o_dd_day", "surfdd", "mean_l", extra="'day' AS model,")}""",
)
def _(s):
    rows = written(base.length_rows(s).select("date", "year", "month_long", "length"), "lengths")
    days = base.degree_days(s)
    return rounded_summary(climate.dd_regressions(monthly_dd(s, rows), rows, days))


@query(
    "dd_length_daily",
    """SELECT l.date, R4(l.mean_l) AS mean_l, d.surfdd AS mean_dd, d.surft AS mean_t, CAST(month(l.date) AS INT) AS month,
       CAST(year(l.date) AS INT) AS year, monthname(l.date) AS month_long FROM
       (SELECT date, avg(length) AS mean_l FROM o_lengths GROUP BY date) l LEFT JOIN o_degree_days d USING (date)""",
)
def _(s):
    return fix(climate.dd_length_daily(base.length_rows(s), base.degree_days(s)), 4, "mean_l")


@query("regression_summary", summary_sql("o_lengths", "jday", "length", "year"))
def _(s):
    return rounded_summary(regression_summary(base.length_rows(s), ["year"], F.col("jday"), F.col("length")))


_MATRIX = ", ".join(
    f"R4(max(CASE WHEN w.month = {i} THEN {m} END)) AS {m}_{name}"
    for m in climate.FEATURES
    for i, name in enumerate(climate.YEAR_MONTHS[:7], start=1)
)


step(
    "o_year_matrix",
    f"""SELECT a.*, t."May", t."June", t."July" FROM
       (SELECT w.year, {_MATRIX} FROM o_weather_month w
        LEFT JOIN o_ice_month i ON w.year = i.year AND w.month = i.month
        LEFT JOIN o_dd_month d ON w.year = d.year AND w.month = d.month WHERE w.month < 8 GROUP BY w.year) a
       LEFT JOIN (SELECT year, R4(max(CASE WHEN month_long = 'May' THEN noha_mean END)) AS "May",
                    R4(max(CASE WHEN month_long = 'June' THEN noha_mean END)) AS "June",
                    R4(max(CASE WHEN month_long = 'July' THEN noha_mean END)) AS "July" FROM o_dd_length GROUP BY year) t
       ON a.year = t.year WHERE a.year <> 1999""",
)


@query("feature_matrix", "SELECT * FROM o_year_matrix")
def year_matrix(s):
    df = climate.feature_matrix(
        climate.weather_monthly(s.weather),
        climate.ice_monthly(ice(s), base.FROM_YEAR),
        climate.degree_days_monthly(base.degree_days(s), base.FROM_YEAR),
        monthly_dd(s),
        base.SKIP_YEAR,
    )
    return fix(df)


# -- trawls and outline --------------------------------------------------------------


@query(
    "trawl_clean",
    """SELECT op_id, date, tow_time, state, CASE WHEN state IN ('WI', 'MN', 'MI') THEN 'USA' WHEN state IN ('ONT.E', 'ONT.W') THEN 'Canada' END AS country,
       gear, R6(mid_lat) AS mid_lat, R6(mid_depth) AS mid_depth, R6(fishing_depth) AS fishing_depth, R6(surface_temp) AS surface_temp,
       R6(bottom_temp) AS bottom_temp, R6(shore_distance) AS shore_distance, week FROM o_trawl""",
)
def _(s):
    keep = ["op_id", "date", "tow_time", "state", "country", "gear", "mid_lat", "mid_depth", "fishing_depth",
            "surface_temp", "bottom_temp", "shore_distance", "week"]
    return fix(effort.trawl_clean(s.tow, s.trawl, s.site).select(*keep), 6)


@query(
    "effort_union",
    """SELECT * REPLACE (R6(mid_lat) AS mid_lat, R6(mid_lon) AS mid_lon, R6(mid_depth) AS mid_depth,
       R6(fishing_depth) AS fishing_depth, R6(shore_distance) AS shore_distance) FROM o_all_effort""",
)
def _(s):
    return fix(base.all_tows(s), 6)


step(
    "o_ring_points",
    """SELECT vertex_id, CAST(k AS INT) AS vertex_no, x + CASE WHEN k IN (2, 3) THEN 500 ELSE 0 END AS x,
  y + CASE WHEN k IN (3, 4) THEN 250 ELSE 0 END AS y FROM v_polygon, (VALUES (1), (2), (3), (4), (5)) AS c(k)""",
)
step("o_ring_lonlat", inverse_mercator_sql("o_ring_points", "vertex_id, vertex_no"))


@query("lake_outline", "SELECT vertex_id, vertex_no, R6(long) AS long, R6(lat) AS lat FROM o_ring_lonlat")
def _(s):
    points = polygon_vertices(rings(s), "vertex_id", "ring")
    return fix(geo.with_lonlat(points, "x", "y").select("vertex_id", "vertex_no", "long", "lat"), 6)
