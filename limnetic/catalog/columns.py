"""Sources, sinks and column operators."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from limnetic.operators.columns import across, level_number, select_positions
from limnetic.operators.reshape import first_per_key
from limnetic.functions import scalars
from limnetic.session import shared_path
from limnetic.sources import files

from .registry import fixed, query


@query("scan_csv", "SELECT op_id, tow_time, beg_lat, distance, state FROM v_tow")
def _(s):
    df = s.tow.select("op_id", "tow_time", "beg_lat", "distance", "state")
    path = files.write_summary(df, shared_path(s.spark, "scan_csv"), "csv")
    return files.scan_csv(s.spark, path, df.schema)


# Every 50th distance is no number, every 70th tow time neither, and every 90th row has a field too many.
@query(
    "scan_csv_quarantine",
    """SELECT 'rows' AS field, count(*) AS rows FROM v_tow WHERE op_id % 90 <> 0 UNION ALL
       SELECT 'known distance', count(distance) FILTER (op_id % 50 <> 0 AND op_id % 90 <> 0) FROM v_tow UNION ALL
       SELECT * FROM (SELECT 'distance' AS field, count(*) AS rows FROM v_tow WHERE op_id % 50 = 0 AND op_id % 90 <> 0 UNION ALL
         SELECT 'tow_time', count(*) FROM v_tow WHERE op_id % 70 = 0 AND op_id % 90 <> 0 UNION ALL
         SELECT 'line', count(*) FROM v_tow WHERE op_id % 90 = 0) WHERE rows > 0""",
)
def _(s):
    df = s.tow.select("op_id", "tow_time", "distance")
    missing = lambda c, n, bad: F.when(F.col("op_id") % n == 0, bad).otherwise(F.coalesce(F.col(c).cast("string"), F.lit("NA")))
    fields = [F.col("op_id").cast("string"), missing("tow_time", 70, "noon"), missing("distance", 50, "1;5")]
    line = F.concat_ws(",", *fields, F.when(F.col("op_id") % 90 == 0, "more"))
    path = shared_path(s.spark, "scan_csv")
    df.select(line.alias("value")).write.text(path)
    rows, counts = files.scan_csv_checked(s.spark, path, df.schema, shared_path(s.spark, "quarantine"), header=False)
    known = rows.agg(F.count(F.lit(1)).alias("rows"), F.count("distance").alias("known"))
    both = known.select(F.explode(F.array(
        F.struct(F.lit("rows").alias("field"), F.col("rows").alias("rows")), F.struct(F.lit("known distance").alias("field"), F.col("known").alias("rows"))
    )).alias("x")).select("x.*")
    return both.unionByName(counts)


@query("scan_sheet", "SELECT sample, location, date, surface_t, t3m FROM v_bt")
def _(s):
    df = s.bt.select("sample", "location", "date", "surface_t", "t3m")
    root = shared_path(s.spark, "books")
    files.write_summary(df, f"{root}/bt/sample")
    return files.scan_sheet(s.spark, root, "bt", "sample", df.schema)


@query("scan_multi_sheet", "SELECT date, station, rwsp, wdir FROM v_weather")
def _(s):
    root = shared_path(s.spark, "books")
    keep = ["date", "station", "rwsp", "wdir"]
    halves = {"readings1": s.weather.filter("part = 'F'"), "readings2": s.weather.filter("part <> 'F'")}
    for sheet, half in halves.items():
        files.write_summary(half.select(*keep), f"{root}/weather/{sheet}")
    schema = s.weather.select(*keep).schema
    return files.scan_sheets(s.spark, root, "weather", list(halves), schema)


def rings(s):
    """A closed rectangle around each surveyed point, one ring per row."""
    corners = [(0, 0), (500, 0), (500, 250), (0, 250), (0, 0)]
    ring = F.array(
        *[F.struct((F.col("x") + dx).alias("x"), (F.col("y") + dy).alias("y")) for dx, dy in corners]
    )
    return s.polygon.select("vertex_id", ring.alias("ring"))


RINGS_SQL = """
SELECT vertex_id, CAST(k AS INT) AS vertex_no,
       x + CASE WHEN k IN (2, 3) THEN 500 ELSE 0 END AS x,
       y + CASE WHEN k IN (3, 4) THEN 250 ELSE 0 END AS y
FROM v_polygon, (VALUES (1), (2), (3), (4), (5)) AS c(k)
"""


@query("polygon_vertices", RINGS_SQL)
def _(s):
    return files.polygon_vertices(rings(s), "vertex_id", "ring")


@query(
    "sink_summary",
    """SELECT station, count(*) AS n, R4(avg(rwsp)) AS mean_wind FROM v_weather GROUP BY station""",
)
def _(s):
    df = s.weather.groupBy("station").agg(
        F.count(F.lit(1)).alias("n"), fixed(F.avg("rwsp")).alias("mean_wind")
    )
    path = files.write_summary(df, shared_path(s.spark, "summary"))
    return s.spark.read.schema(df.schema).parquet(path)


@query(
    "sink_chart_data",
    """SELECT station, CAST(year(date) AS INT) AS year, R4(avg(atmp)) AS mean_air
       FROM v_weather GROUP BY station, year(date)""",
)
def _(s):
    df = s.weather.groupBy("station", F.year("date").alias("year")).agg(
        fixed(F.avg("atmp")).alias("mean_air")
    )
    path = files.write_chart_data(df, shared_path(s.spark, "chart"), ["station"])
    return s.spark.read.schema(df.schema).parquet(path)


@query(
    "sink_chart_facet",
    """SELECT station, CAST(year(date) AS INT) AS year, R4(avg(atmp) + CASE WHEN station = 'A' THEN 100 ELSE 0 END) AS mean_air
       FROM v_weather GROUP BY station, year(date)""",
)
def _(s):
    """All facets, then one of them again with other values."""
    df = s.weather.groupBy("station", F.year("date").alias("year")).agg(fixed(F.avg("atmp")).alias("mean_air"))
    path = files.write_chart_data(df, shared_path(s.spark, "chart"), ["station"])
    again = s.weather.filter("station = 'A'").groupBy("station", F.year("date").alias("year")).agg(fixed(F.avg("atmp") + 100).alias("mean_air"))
    files.write_chart_data(again, path, ["station"], keep_others=True)
    return s.spark.read.schema(df.schema).parquet(path)


@query("select_columns", "SELECT location, op_id, op_date FROM v_tow")
def _(s):
    return s.tow.select("location", "op_id", "op_date")


@query(
    "select_positional",
    "SELECT op_id, location, beg_lat, end_lat, beg_lon, end_lon, distance FROM v_tow",
)
def _(s):
    return select_positions(s.tow, 1, (5, 9), 12)


@query("drop_columns", "SELECT op_id, net, species FROM v_catch")
def _(s):
    return s.catch.drop("n")


@query(
    "rename_columns",
    """SELECT sample, t3m AS "Temp.3m", chl_surf AS "Chl (surface)" FROM v_bt""",
)
def _(s):
    odd = s.bt.select("sample", F.col("t3m").alias("d<3mT"), "chl_surf")
    return odd.withColumnsRenamed({"d<3mT": "Temp.3m", "chl_surf": "Chl (surface)"})


@query(
    "derive_columns",
    """SELECT op_id, CAST(year(op_date) AS INT) AS year, CAST(year(op_date) - 1900 AS INT) AS short_year,
              distance * 1609.344 AS metres, distance * 1609.344 / 1000 AS km FROM v_tow""",
)
def _(s):
    return (
        s.tow.select("op_id", "op_date", "distance")
        .withColumns({"year": F.year("op_date"), "metres": F.col("distance") * 1609.344})
        .withColumns({"short_year": F.col("year") - 1900, "km": F.col("metres") / 1000})
        .drop("op_date", "distance")
    )


@query("tag_constant", "SELECT op_id, 'Neuston' AS gear, 0.5::DOUBLE AS fishing_depth FROM v_tow")
def _(s):
    return s.tow.select("op_id").withColumns(
        {"gear": F.lit("Neuston"), "fishing_depth": F.lit(0.5)}
    )


@query(
    "across_round",
    """SELECT op_id, CAST(round_even(CAST(beg_lat AS DECIMAL(18,6)), 1) AS DOUBLE) AS beg_lat,
              CAST(round_even(CAST(end_lat AS DECIMAL(18,6)), 1) AS DOUBLE) AS end_lat,
              CAST(round_even(CAST(distance AS DECIMAL(18,6)), 1) AS DOUBLE) AS distance FROM v_tow""",
)
def _(s):
    df = s.tow.select("op_id", "beg_lat", "end_lat", "distance")
    cols = ["beg_lat", "end_lat", "distance"]
    return across(df, cols, lambda c: scalars.half_even(c, 1).cast("double"))


@query(
    "cast_category",
    """SELECT op_id, net, CAST(species AS VARCHAR) AS species_label, CAST(species AS INT) AS species_code
       FROM v_catch""",
)
def _(s):
    label = F.col("species").cast("string")
    return s.catch.select(
        "op_id", "net", label.alias("species_label"), label.cast("int").alias("species_code")
    )


MONTHS = ["May", "June", "July", "August", "September", "October"]


@query(
    "ordered_levels",
    """SELECT op_id, CASE WHEN m IN ('May','June','July','August','September','October') THEN m END AS month_long,
              CASE m WHEN 'May' THEN 1 WHEN 'June' THEN 2 WHEN 'July' THEN 3 WHEN 'August' THEN 4
                     WHEN 'September' THEN 5 WHEN 'October' THEN 6 END AS month_no
       FROM (SELECT op_id, monthname(op_date) AS m FROM v_tow)""",
)
def _(s):
    month = F.date_format("op_date", "MMMM")
    return s.tow.select(
        "op_id",
        F.when(month.isin(*MONTHS), month).alias("month_long"),
        level_number(month, MONTHS).alias("month_no"),
    )


@query(
    "convert_types",
    """SELECT op_id, CAST(op_date AS VARCHAR) AS date_text, CAST(tow_time AS VARCHAR) AS time_text,
              CAST(op_date AS DATE) AS date_back, TRY_CAST(state AS INT) AS state_code,
              CAST(distance * 100 AS INT) AS hundredths FROM v_tow""",
)
def _(s):
    text = F.col("op_date").cast("string")
    return s.tow.select(
        "op_id",
        text.alias("date_text"),
        F.col("tow_time").cast("string").alias("time_text"),
        text.cast("date").alias("date_back"),
        F.col("state").try_cast("int").alias("state_code"),
        F.round(F.col("distance") * 100).cast("int").alias("hundredths"),
    )
