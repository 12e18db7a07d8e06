"""Distinct rows, pivots, appends, sorting, expansion and ordered windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from limnetic.operators import aggregates as A
from limnetic.operators import reshape as R
from limnetic.operators.ordered import numbered, running_total, with_overall_mean
from limnetic.sources.files import append_all

from .registry import fix, fixed, query, step

step(
    "o_ice_typed",
    "SELECT CAST(m AS INT) AS m, CAST(d AS INT) AS d, "
    + ", ".join(f"y{y}" for y in range(1995, 2002))
    + " FROM v_ice_wide",
)


@query(
    "distinct_first",
    """SELECT location, op_id, op_date, tow_time, state FROM
       (SELECT location, op_id, op_date, tow_time, state,
               row_number() OVER (PARTITION BY location ORDER BY op_date, tow_time NULLS FIRST, op_id) AS k FROM v_tow)
       WHERE k = 1""",
)
def _(s):
    df = s.tow.select("location", "op_id", "op_date", "tow_time", "state")
    return R.first_per_key(df, ["location"], ["op_date", "tow_time", "op_id"])


@query(
    "pivot_fill_zero",
    """SELECT op_id, count(*) FILTER (species = 202) AS "202", count(*) FILTER (species = 204) AS "204",
       count(*) FILTER (species = 206) AS "206", count(*) FILTER (species = 217) AS "217" FROM v_specimen GROUP BY op_id""",
)
def _(s):
    return R.pivot_counts(s.specimen, ["op_id"], "species", [202, 204, 206, 217])


@query(
    "pivot_wider",
    """SELECT year, max(CASE WHEN month = 5 THEN depth END) AS "5", max(CASE WHEN month = 6 THEN depth END) AS "6",
       max(CASE WHEN month = 9 THEN depth END) AS "9" FROM
       (SELECT CAST(year(op_date) AS INT) AS year, month(op_date) AS month, R4(avg(end_depth)) AS depth
        FROM v_tow GROUP BY 1, 2) GROUP BY year""",
)
def _(s):
    monthly = s.tow.groupBy(F.year("op_date").alias("year"), F.month("op_date").alias("month")).agg(
        fixed(F.avg("end_depth")).alias("depth")
    )
    return R.pivot_values(monthly, ["year"], "month", [5, 6, 9], "depth")


@query(
    "pivot_multi_value",
    """SELECT year, max(CASE WHEN m = 5 THEN wind END) AS wind_May, max(CASE WHEN m = 6 THEN wind END) AS wind_June,
       max(CASE WHEN m = 5 THEN air END) AS air_May, max(CASE WHEN m = 6 THEN air END) AS air_June FROM
       (SELECT CAST(year(date) AS INT) AS year, month(date) AS m, R4(avg(rwsp)) AS wind, R4(avg(atmp)) AS air
        FROM v_weather GROUP BY 1, 2) GROUP BY year""",
)
def _(s):
    monthly = s.weather.groupBy(
        F.year("date").alias("year"), F.date_format("date", "MMMM").alias("month")
    ).agg(fixed(F.avg("rwsp")).alias("wind"), fixed(F.avg("atmp")).alias("air"))
    return R.pivot_many(monthly, ["year"], "month", ["May", "June"], ["wind", "air"])


@query(
    "unpivot_long",
    "\nUNION ALL ".join(
        f"SELECT m, d, {y} AS ice_year, y{y} AS ice_cover FROM o_ice_typed" for y in range(1995, 2002)
    ),
)
def _(s):
    years = [f"y{y}" for y in range(1995, 2002)]
    key = F.substring("ice_year", 2, 4).cast("int")
    return R.unpivot_long(s.ice_wide, ["m", "d"], years, "ice_year", "ice_cover", key)


@query(
    "bind_rows",
    """SELECT op_id, location, NULL::INT AS n FROM v_tow UNION ALL
       SELECT op_id, NULL::INT, n FROM v_catch""",
)
def _(s):
    return append_all([s.tow.select("op_id", "location"), s.catch.select("op_id", "n")])


@query(
    "sort_desc",
    """SELECT location, shore_distance, CAST(row_number() OVER (ORDER BY shore_distance DESC NULLS LAST, location) AS BIGINT) AS rank
       FROM v_site""",
)
def _(s):
    missing = F.col("shore_distance").isNull().cast("int")
    df = s.site.withColumns(
        {"_last": missing, "_down": F.coalesce(-F.col("shore_distance"), F.lit(0.0))}
    )
    ranked = numbered(df, ["_last", "_down", "location"], out="rank").drop("_last", "_down")
    return ranked.orderBy(F.desc_nulls_last("shore_distance"), "location")


@query(
    "expand_by_count",
    "SELECT op_id, specimen_number, exp_n FROM v_specimen, generate_series(1, exp_n) WHERE exp_n > 0",
)
def _(s):
    return R.expand_rows(s.specimen.select("op_id", "specimen_number", "exp_n"), "exp_n")


@query(
    "cumulative_sum",
    """SELECT date, daily, CASE WHEN sum(CASE WHEN daily IS NULL THEN 1 ELSE 0 END) OVER w = 0
                               THEN R4(sum(daily) OVER w) END AS cumulative
       FROM (SELECT date, nullif(superior, 13) AS daily FROM v_daily_temp)
       WINDOW w AS (PARTITION BY year(date) ORDER BY date)""",
)
def _(s):
    days = s.daily_temp.select(
        "date", F.year("date").alias("year"), F.nullif("superior", F.lit(13.0)).alias("daily")
    )
    return fix(running_total(days, ["year"], "date", "daily", "cumulative").drop("year"))


@query(
    "row_number_id",
    """SELECT op_id, specimen_number, length,
       row_number() OVER (ORDER BY op_id, specimen_number, length NULLS FIRST) AS id FROM v_specimen""",
)
def _(s):
    df = s.specimen.select("op_id", "specimen_number", "length")
    return numbered(df, ["op_id", "specimen_number"], ["length"])


@query(
    "overall_mean_line",
    """SELECT date, processed, R4(avg(processed) OVER ()) AS mean_processed
       FROM (SELECT date, count(*) AS processed FROM v_lab GROUP BY date)""",
)
def _(s):
    days = s.lab.groupBy("date").agg(A.rows().alias("processed"))
    return fix(with_overall_mean(days, "processed", "mean_processed"))
