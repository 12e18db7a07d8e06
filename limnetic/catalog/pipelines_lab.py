"""Larval counts, backlog, hauls and laboratory throughput."""

from __future__ import annotations

from limnetic.functions.dist import T975, Z975
from limnetic.operators.ordered import with_overall_mean
from limnetic.plans import larvae
from limnetic.sources.survey import SPECIES_NAMES

from . import base
from .registry import fix, query, step

YEAR = base.YEAR
SINCE = "2024-01-05"


@query(
    "weekly_catch",
    """SELECT year, week, common_name, CAST(sum(n) AS BIGINT) AS fish FROM o_larval
       WHERE species IN (202, 203, 204, 206, 217) GROUP BY ALL""",
)
def _(s):
    return larvae.weekly_catch(base.larval_counts(s))


@query(
    "week_labels",
    """SELECT week, date, op_id, year, date1 FROM
       (SELECT *, row_number() OVER (PARTITION BY week ORDER BY date NULLS FIRST, op_id) AS k FROM o_larval) WHERE k = 1""",
)
def _(s):
    return larvae.week_labels(base.larval_counts(s))


@query(
    "catch_by_distance",
    "SELECT op_id, species, common_name, n AS tfish, R4(shore_distance / 1000) AS shore_km FROM o_larval",
)
def _(s):
    return fix(larvae.catch_by_distance(base.larval_counts(s)))


@query(
    "yolk_by_site",
    """SELECT a.year, a.location, a.yes, a.no, f.fish, t.op_id, R4(t.mid_lat) AS mid_lat, R4(t.mid_lon) AS mid_lon FROM
       (SELECT t.year, t.location, count(*) FILTER (yolk_sac = 'Y') AS yes, count(*) FILTER (yolk_sac = 'N') AS no
        FROM v_specimen f JOIN o_tow t USING (op_id)
        WHERE species IN (202, 204, 206, 217) AND length IS NOT NULL AND yolk_sac IS NOT NULL GROUP BY ALL) a
       LEFT JOIN (SELECT year, location, CAST(sum(n) AS BIGINT) AS fish FROM o_larval GROUP BY ALL) f USING (year, location)
       LEFT JOIN o_tow t ON t.year = a.year AND t.location = a.location""",
)
def _(s):
    return fix(larvae.yolk_by_site(s.specimen, base.larval_counts(s), base.tows(s)))


step(
    "o_backlog_raw",
    f"""SELECT c.date, c.location, coalesce(c.mid_lat, 0) AS mid_lat, coalesce(c.mid_lon, 0) AS mid_lon, coalesce(c.fish, 0) AS collected,
  coalesce(p.n, 0) AS processed FROM o_larval_catch c LEFT JOIN
  (SELECT date, location, CAST(sum(n) AS BIGINT) AS n FROM o_larval WHERE year = {YEAR} GROUP BY ALL) p USING (date, location)""",
)
step(
    "o_backlog",
    """SELECT *, CASE WHEN to_do <= 15 OR work = 'Processed' THEN 0 ELSE to_do END AS remaining FROM
  (SELECT *, collected - processed AS to_do, CASE WHEN collected - processed <= 15 OR location > 500 OR collected <= 200 THEN 'Processed'
     WHEN location < 500 THEN 'To do' END AS work,
     CASE WHEN collected > 200 AND location < 500 THEN collected - 200 ELSE 0 END AS could_do FROM o_backlog_raw)""",
)


def backlog(s):
    return larvae.processing_backlog(base.density(s), base.larval_counts(s), YEAR)


@query(
    "processing_backlog",
    """SELECT date, location, R4(mid_lat) AS mid_lat, R4(mid_lon) AS mid_lon, collected, processed, to_do,
       coalesce(work, '0') AS work, could_do, remaining, remaining AS remaining_shown,
       CASE WHEN collected > 0 THEN 'present' ELSE 'absent' END AS presence FROM o_backlog""",
)
def _(s):
    return fix(backlog(s))


@query(
    "backlog_status",
    """SELECT *, fish_done || ' fish processed of ' || fish_catch || ' fish collected' AS status FROM
       (SELECT CAST(sum(processed) AS BIGINT) AS fish_done, CAST(sum(collected) AS BIGINT) AS fish_catch,
               CAST(sum(could_do) AS BIGINT) AS fish_extra, CAST(sum(remaining) AS BIGINT) AS fish_to_do FROM o_backlog)""",
)
def _(s):
    return larvae.backlog_status(backlog(s))


NAMES = tuple(name for code, name in SPECIES_NAMES.items() if code)
_COUNTS = ", ".join(
    f"count(*) FILTER (common_name = '{n}') AS {n.lower().replace(' ', '_')}" for n in NAMES
)


@query(
    "age0_hauls",
    f"""SELECT a.op_id, a.samples, t.op_date, t.location, t.tr_design, CAST(year(t.op_date) AS INT) AS year,
       CAST(month(t.op_date) AS INT) AS month, CAST((dayofyear(t.op_date) - 1) // 7 + 1 AS INT) AS week,
       CASE WHEN t.location < 500 THEN 'nearshore' ELSE 'offshore' END AS habitat, R4(d.shore_distance) AS shore_distance,
       R4(coalesce((beg_lat + end_lat) / 2, beg_lat, end_lat)) AS mid_lat, R4(coalesce((beg_lon + end_lon) / 2, beg_lon, end_lon)) AS mid_lon,
       R4(coalesce((beg_depth + end_depth) / 2, beg_depth, end_depth)) AS mid_depth, f.* EXCLUDE (op_id) FROM
       (SELECT op_id, count(*) AS samples FROM v_specimen GROUP BY op_id) a JOIN v_tow t USING (op_id) LEFT JOIN v_site d USING (location)
       LEFT JOIN (SELECT op_id, {_COUNTS} FROM v_specimen JOIN v_species USING (species) JOIN v_tow USING (op_id)
                  WHERE length < 150 AND month(op_date) >= 8 GROUP BY op_id) f ON f.op_id = a.op_id""",
)
def _(s):
    return fix(larvae.age0_hauls(s.tow, s.specimen, s.site, s.species, NAMES))


step(
    "o_lab_days",
    f"SELECT date, count(*) AS processed, dayname(date) AS day FROM v_lab WHERE date >= DATE '{SINCE}' GROUP BY date",
)
step(
    "o_t975",
    "SELECT * FROM (VALUES " + ", ".join(f"({i}, {t}::DOUBLE)" for i, t in enumerate(T975, 1)) + ") AS t(df, t975)",
)


def ci_sql(source: str, key: str, y: str, digits: int = 4) -> str:
    """Mean and t interval; beyond 30 degrees of freedom the point is expanded around z."""
    z = f"{Z975!r}::DOUBLE"
    far = (
        f"{z} + (power({z}, 3) + {z}) / 4 / (n - 1) + (5 * power({z}, 5) + 16 * power({z}, 3) + 3 * {z}) / 96 / power(n - 1, 2)"
        f" + (3 * power({z}, 7) + 19 * power({z}, 5) + 17 * power({z}, 3) - 15 * {z}) / 384 / power(n - 1, 3)"
    )
    return f"""SELECT {key}, n, R{digits}(m) AS mean, R{digits}(m - t * sd / sqrt(n)) AS lower, R{digits}(m + t * sd / sqrt(n)) AS upper FROM
      (SELECT a.*, CASE WHEN n > 31 THEN {far} ELSE t975 END AS t FROM
        (SELECT {key}, count({y}) AS n, avg({y}) AS m, stddev_samp({y}) AS sd FROM {source} GROUP BY {key}) a
       LEFT JOIN o_t975 ON df = n - 1)"""


@query(
    "lab_throughput",
    f"""SELECT *, CASE day WHEN 'Monday' THEN 1 WHEN 'Tuesday' THEN 2 WHEN 'Wednesday' THEN 3 WHEN 'Thursday' THEN 4
                           WHEN 'Friday' THEN 5 END AS day_no FROM ({ci_sql("o_lab_days", "day", "processed")})""",
)
def _(s):
    return fix(larvae.lab_throughput(larvae.samples_per_day(s.lab, SINCE)))


@query(
    "lab_days",
    "SELECT date, day, processed, R4(avg(processed) OVER ()) AS mean_processed FROM o_lab_days",
)
def _(s):
    return fix(with_overall_mean(larvae.samples_per_day(s.lab, SINCE), "processed", "mean_processed"))
