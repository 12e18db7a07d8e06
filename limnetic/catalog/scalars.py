"""Scalar functions."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from limnetic.functions import calendar as cal
from limnetic.functions import geo, scalars
from limnetic.operators.joins import lookup_join
from limnetic.operators.reshape import pivot_counts

from .aggregates import net_density
from .registry import fix, fixed, query, step


@query(
    "case_when",
    """SELECT op_id, CASE WHEN tr_design IN (4, 5, 25, 26, 27, 44) THEN 'Bottom trawl'
                          WHEN tr_design IN (21, 22, 28, 41, 45) THEN 'Mid-water trawl' END AS gear FROM v_tow""",
)
def _(s):
    return s.tow.select("op_id", scalars.gear(F.col("tr_design")).alias("gear"))


@query(
    "if_else",
    """SELECT op_id, CASE WHEN tow_time IS NULL THEN NULL WHEN tow_time < 500 THEN 'nearshore' ELSE 'offshore' END AS habitat
       FROM v_tow""",
)
def _(s):
    near = F.col("tow_time") < 500
    return s.tow.select("op_id", F.when(near, "nearshore").when(~near, "offshore").alias("habitat"))


step(
    "o_genetic_names",
    """SELECT * FROM (VALUES (202, 'Cisco'), (203, 'Lake Whitefish'), (204, 'Bloater'), (206, 'Kiyi'),
  (208, 'Shortnose Cisco'), (210, 'Pygmy Whitefish'), (217, 'unidentified ciscoe'), (218, 'ciscoe hybrid'))
  AS g(genetics, genetics_name)""",
)


@query(
    "map_code_name",
    """SELECT op_id, specimen_number, genetics, genetics_name FROM v_specimen LEFT JOIN o_genetic_names USING (genetics)""",
)
def _(s):
    df = s.specimen.select("op_id", "specimen_number", "genetics")
    return df.withColumn("genetics_name", scalars.genetic_name(F.col("genetics")))


PAIR_SQL = """CASE WHEN species IN (202, 204, 206) AND genetics IN (202, 204, 206, 208, 218) THEN
  CASE species WHEN 202 THEN 'Cisco' WHEN 204 THEN 'Bloater' ELSE 'Kiyi' END || '/' ||
  CASE WHEN genetics = 218 AND species = 202 THEN 'Unknown' WHEN genetics = 218 THEN 'hybrid'
       WHEN genetics = 202 THEN 'Cisco' WHEN genetics = 204 THEN 'Bloater' WHEN genetics = 206 THEN 'Kiyi'
       ELSE 'Shortnose' END END"""


@query("pair_label", f"SELECT op_id, specimen_number, species, genetics, {PAIR_SQL} AS comparison FROM v_specimen")
def _(s):
    df = s.specimen.select("op_id", "specimen_number", "species", "genetics")
    return df.withColumn("comparison", scalars.pair_label(F.col("species"), F.col("genetics")))


@query(
    "match_flag",
    """SELECT op_id, specimen_number, CASE WHEN species = genetics THEN 'Yes' WHEN species <> genetics THEN 'No' END AS match
       FROM v_specimen""",
)
def _(s):
    flag = scalars.match_flag(F.col("species"), F.col("genetics"))
    return s.specimen.select("op_id", "specimen_number", flag.alias("match"))


@query(
    "parse_dmy",
    """SELECT op_id, CASE WHEN op_id % 19 = 0 THEN NULL ELSE op_date END AS op_date FROM v_tow""",
)
def _(s):
    text = F.when(F.col("op_id") % 19 == 0, "no date").otherwise(F.date_format("op_date", "dd-MMM-yy"))
    return s.tow.select("op_id", cal.parse_dmy(text).alias("op_date"))


@query(
    "parse_ymd",
    """SELECT op_id, try_cast(CASE WHEN op_id % 19 = 0 THEN 'no date' ELSE strftime(op_date, '%Y-%m-%d') END AS DATE) AS op_date
       FROM v_tow""",
)
def _(s):
    text = F.when(F.col("op_id") % 19 == 0, "no date").otherwise(F.col("op_date").cast("string"))
    return s.tow.select("op_id", cal.parse_ymd(text).alias("op_date"))


@query(
    "make_date",
    """SELECT op_id, try_cast(printf('%04d-%02d-%02d', year(op_date), op_id % 14, op_id % 32) AS DATE) AS made FROM v_tow""",
)
def _(s):
    month, day = (F.col("op_id") % 14).cast("int"), (F.col("op_id") % 32).cast("int")
    return s.tow.select("op_id", cal.date_from_parts(F.year("op_date"), month, day).alias("made"))


@query(
    "date_parts",
    """SELECT op_id, CAST(day(op_date) AS INT) AS day, CAST(month(op_date) AS INT) AS month,
       CAST(year(op_date) AS INT) AS year, CAST(dayofyear(op_date) AS INT) AS jday FROM v_tow""",
)
def _(s):
    d = F.col("op_date")
    return s.tow.select(
        "op_id",
        F.day(d).alias("day"),
        F.month(d).alias("month"),
        F.year(d).alias("year"),
        F.dayofyear(d).alias("jday"),
    )


@query(
    "week_of_year",
    "SELECT op_id, CAST(((dayofyear(op_date) - 1) // 7) + 1 AS INT) AS week FROM v_tow",
)
def _(s):
    return s.tow.select("op_id", cal.week_of_year(F.col("op_date")).alias("week"))


@query(
    "month_names",
    "SELECT op_id, monthname(op_date) AS month_long, strftime(op_date, '%b') AS month_short FROM v_tow",
)
def _(s):
    d = F.col("op_date")
    return s.tow.select(
        "op_id", cal.month_long(d).alias("month_long"), cal.month_short(d).alias("month_short")
    )


@query("weekday_name", "SELECT op_id, dayname(op_date) AS weekday FROM v_tow")
def _(s):
    return s.tow.select("op_id", cal.weekday(F.col("op_date")).alias("weekday"))


@query(
    "season_year",
    """SELECT op_id, CAST(CASE WHEN j > 250 THEN y - 1 WHEN j < 250 THEN y END AS INT) AS season_year,
       CAST(CASE WHEN j < 250 THEN j WHEN j > 250 THEN j - 366 END AS INT) AS season_day
       FROM (SELECT op_id, year(op_date) AS y, dayofyear(op_date) AS j FROM v_tow)""",
)
def _(s):
    jday = F.dayofyear("op_date")
    return s.tow.select(
        "op_id",
        cal.season_year(F.year("op_date"), jday).alias("season_year"),
        cal.season_day(jday).alias("season_day"),
    )


@query(
    "doy_axis_date",
    "SELECT op_id, CAST(DATE '2014-01-01' + CAST(dayofyear(op_date) AS INT) AS DATE) AS axis_date FROM v_tow",
)
def _(s):
    return s.tow.select("op_id", cal.axis_date(F.dayofyear("op_date")).alias("axis_date"))


@query(
    "asof_label",
    """SELECT op_id, 'Work completed as of ' || strftime(op_date, '%A, %B %d, %Y') AS label FROM v_tow""",
)
def _(s):
    label = F.concat_ws(" ", F.lit("Work completed as of"), cal.long_label(F.col("op_date")))
    return s.tow.select("op_id", label.alias("label"))


@query(
    "unite_columns",
    """SELECT op_id, coalesce(CAST(tow_time AS VARCHAR), 'NA') || ' / ' || CAST(location AS VARCHAR) AS collection,
       strftime(op_date, '%b') || ' ' || CAST(day(op_date) AS VARCHAR) AS date1 FROM v_tow""",
)
def _(s):
    d = F.col("op_date")
    return s.tow.select(
        "op_id",
        scalars.united(" / ", F.col("tow_time"), F.col("location")).alias("collection"),
        scalars.united(" ", cal.month_short(d), F.day(d)).alias("date1"),
    )


@query(
    "status_text",
    """SELECT CAST(count(yolk_sac) AS VARCHAR) || ' fish processed of ' || CAST(count(*) AS VARCHAR) || ' fish collected' AS status
       FROM v_specimen""",
)
def _(s):
    done, all_fish = F.count("yolk_sac").cast("string"), F.count(F.lit(1)).cast("string")
    text = F.concat_ws(" ", done, F.lit("fish processed of"), all_fish, F.lit("fish collected"))
    return s.specimen.agg(text.alias("status"))


@query(
    "trim_text",
    """SELECT op_id, trim(CASE state WHEN 'E' THEN 'ONT.E' WHEN 'W' THEN 'ONT.W' ELSE state END) AS state FROM v_tow""",
)
def _(s):
    return s.tow.select("op_id", scalars.clean_state(F.col("state")).alias("state"))


@query(
    "round_half_even",
    """SELECT op_id, CAST(round_even(CAST(beg_depth / 4 AS DECIMAL(18,6)), 0) AS DOUBLE) AS whole,
       CAST(round_even(CAST(beg_depth / 8 AS DECIMAL(18,6)), 1) AS DOUBLE) AS tenth FROM v_tow""",
)
def _(s):
    depth = F.col("beg_depth")
    return s.tow.select(
        "op_id",
        scalars.half_even(depth / 4, 0).cast("double").alias("whole"),
        scalars.half_even(depth / 8, 1).cast("double").alias("tenth"),
    )


@query(
    "row_mean",
    """SELECT op_id, R6((coalesce(temp_beg_bottom, 0) + coalesce(temp_end_bottom, 0) + coalesce(b, 0))
         / nullif((CASE WHEN temp_beg_bottom IS NULL THEN 0 ELSE 1 END) + (CASE WHEN temp_end_bottom IS NULL THEN 0 ELSE 1 END)
           + (CASE WHEN b IS NULL THEN 0 ELSE 1 END), 0)) AS bottom
       FROM (SELECT *, nullif(beg_bottom, 0) AS b FROM v_trawl)""",
)
def _(s):
    beg = scalars.zero_to_null(F.col("beg_bottom"))
    mean = scalars.row_mean(F.col("temp_beg_bottom"), F.col("temp_end_bottom"), beg)
    return s.trawl.select("op_id", fixed(mean, 6).alias("bottom"))


@query("row_sum", "SELECT op_id, temp_beg_bottom + temp_end_bottom + beg_surf + end_surf AS total FROM v_trawl")
def _(s):
    cols = [F.col(c) for c in ("temp_beg_bottom", "temp_end_bottom", "beg_surf", "end_surf")]
    return s.trawl.select("op_id", scalars.row_sum(*cols).alias("total"))


@query(
    "midpoint",
    "SELECT op_id, R6((beg_lat + end_lat) / 2) AS mid_lat, R6((beg_depth + end_depth) / 2) AS mid_depth FROM v_tow",
)
def _(s):
    return s.tow.select(
        "op_id",
        fixed(scalars.midpoint(F.col("beg_lat"), F.col("end_lat")), 6).alias("mid_lat"),
        fixed(scalars.midpoint(F.col("beg_depth"), F.col("end_depth")), 6).alias("mid_depth"),
    )


@query("density_per_area", "SELECT op_id, net, species, R4(fish_ha) AS fish_ha FROM o_net_density")
def _(s):
    return fix(net_density(s).select("op_id", "net", "species", "fish_ha"))


@query(
    "percent_of_pair",
    """SELECT op_id, R4(CAST(y AS DOUBLE) / nullif(y + n, 0) * 100) AS percent FROM
       (SELECT op_id, count(*) FILTER (yolk_sac = 'Y') AS y, count(*) FILTER (yolk_sac = 'N') AS n
        FROM v_specimen GROUP BY op_id)""",
)
def _(s):
    wide = pivot_counts(s.specimen, ["op_id"], "yolk_sac", ["Y", "N"])
    percent = scalars.percent_of_pair(F.col("Y"), F.col("N"))
    return wide.select("op_id", fixed(percent).alias("percent"))


@query("unit_scale", "SELECT location, R6(shore_distance / 1000) AS shore_km FROM v_site")
def _(s):
    return s.site.select("location", fixed(F.col("shore_distance") / 1000, 6).alias("shore_km"))


@query(
    "log_bins",
    """SELECT op_id, net, species, R6(CASE WHEN fish_ha > 0 THEN ln(fish_ha) END) AS log_density,
       CASE WHEN fish_ha > 0 THEN CASE WHEN fish_ha < 1 THEN 0 WHEN fish_ha < 100 THEN 1 WHEN fish_ha < 1000 THEN 2
            WHEN fish_ha < 25000 THEN 3 WHEN fish_ha < 75000 THEN 4 ELSE 5 END END AS bin FROM o_net_density""",
)
def _(s):
    x = F.col("fish_ha")
    return net_density(s).select(
        "op_id",
        "net",
        "species",
        fixed(scalars.log_value(x), 6).alias("log_density"),
        scalars.break_interval(x).alias("bin"),
    )


def vincenty_sql(source: str, lon: str, lat: str) -> str:
    """Chained selects of the inverse problem towards the fixed inlet."""
    a, f = "6378137.0::DOUBLE", "(1 / 298.257223563::DOUBLE)"
    b = f"({a} * (1 - {f}))"
    u2 = f"atan((1 - {f}) * tan(radians(47.999::DOUBLE)))"
    q = f"""SELECT *, radians(-89.570::DOUBLE - {lon}) AS el, atan((1 - {f}) * tan(radians({lat}))) AS u1, {u2} AS u2,
        radians(-89.570::DOUBLE - {lon}) AS lam FROM {source}"""
    for _ in range(6):
        q = f"""SELECT * EXCLUDE (lam), sqrt(power(cos(u2) * sin(lam), 2)
            + power(cos(u1) * sin(u2) - sin(u1) * cos(u2) * cos(lam), 2)) AS ss_,
            sin(u1) * sin(u2) + cos(u1) * cos(u2) * cos(lam) AS cs_, lam FROM ({q})"""
        q = f"""SELECT *, CASE WHEN ss_ = 0 THEN 0 ELSE cos(u1) * cos(u2) * sin(lam) / ss_ END AS sa_, atan2(ss_, cs_) AS sig_ FROM ({q})"""
        q = f"""SELECT *, coalesce(cs_ - 2 * sin(u1) * sin(u2) / nullif(1 - sa_ * sa_, 0), 0) AS cm_,
            {f} / 16 * (1 - sa_ * sa_) * (4 + {f} * (4 - 3 * (1 - sa_ * sa_))) AS k_ FROM ({q})"""
        q = f"""SELECT * EXCLUDE (lam, ss_, cs_, sa_, sig_, cm_, k_), ss_ AS ss, cs_ AS cs, sa_ AS sa, sig_ AS sig, cm_ AS cm,
            el + (1 - k_) * {f} * sa_ * (sig_ + k_ * ss_ * (cm_ + k_ * cs_ * (2 * cm_ * cm_ - 1))) AS lam FROM ({q})"""
        keep = q
        q = f"SELECT * EXCLUDE (ss, cs, sa, sig, cm) FROM ({q})"
    return f"""SELECT {lon}, {lat}, {b} * big_a * (sig - big_b * ss * (cm + big_b / 4 * (cs * (2 * cm * cm - 1)
          - big_b / 6 * cm * (4 * ss * ss - 3) * (4 * cm * cm - 3)))) AS metres FROM
        (SELECT *, 1 + w / 16384 * (4096 + w * (-768 + w * (320 - 175 * w))) AS big_a,
          w / 1024 * (256 + w * (-128 + w * (74 - 47 * w))) AS big_b FROM
          (SELECT *, (1 - sa * sa) * ({a} * {a} - {b} * {b}) / ({b} * {b}) AS w FROM ({keep})))"""


step("o_points", "SELECT DISTINCT beg_lon, beg_lat FROM v_tow WHERE beg_lon IS NOT NULL")
step("o_inlet_metres", vincenty_sql("o_points", "beg_lon", "beg_lat"))


@query(
    "geodesic_distance",
    """SELECT t.op_id, R1(p.metres) AS metres FROM v_tow t
       LEFT JOIN o_inlet_metres p ON t.beg_lon = p.beg_lon AND t.beg_lat = p.beg_lat""",
)
def _(s):
    tows = s.tow.select("op_id", "beg_lon", "beg_lat")
    points = tows.select("beg_lon", "beg_lat").dropna().distinct()
    metres = geo.with_geodesic_distance(points, "beg_lon", "beg_lat", out="metres")
    out = tows.join(metres, ["beg_lon", "beg_lat"], "left")
    return out.select("op_id", fixed("metres", 1).alias("metres"))


def inverse_mercator_sql(source: str, keep: str) -> str:
    """Footpoint-latitude series of the inverse transverse Mercator projection."""
    a = 6378137.0
    f = 1 / 298.257222101
    e2 = 2 * f - f * f
    ep2 = e2 / (1 - e2)
    e1 = (1 - math.sqrt(1 - e2)) / (1 + math.sqrt(1 - e2))
    j = (
        3 * e1 / 2 - 27 * e1**3 / 32,
        21 * e1**2 / 16 - 55 * e1**4 / 32,
        151 * e1**3 / 96,
        1097 * e1**4 / 512,
    )
    m0 = 1 - e2 / 4 - 3 * e2**2 / 64 - 5 * e2**3 / 256
    series = " + ".join(f"({c!r}::DOUBLE) * sin({2 * (i + 1)} * mu)" for i, c in enumerate(j))
    e2s, ep2s, a_s = f"{e2!r}::DOUBLE", f"({ep2!r}::DOUBLE)", f"{a!r}::DOUBLE"
    return f"""SELECT {keep},
      -87 + degrees((d - (1 + 2 * t1 + c1) * power(d, 3) / 6
        + (5 - 2 * c1 + 28 * t1 - 3 * c1 * c1 + 8 * {ep2s} + 24 * t1 * t1) * power(d, 5) / 120) / cos(phi1)) AS long,
      degrees(phi1 - n1 * tan(phi1) / r1 * (d * d / 2
        - (5 + 3 * t1 + 10 * c1 - 4 * c1 * c1 - 9 * {ep2s}) * power(d, 4) / 24
        + (61 + 90 * t1 + 298 * c1 + 45 * t1 * t1 - 252 * {ep2s} - 3 * c1 * c1) * power(d, 6) / 720)) AS lat
    FROM (SELECT *, (x - 500000) / (n1 * 0.9996::DOUBLE) AS d FROM
      (SELECT *, {ep2s} * cos(phi1) * cos(phi1) AS c1, tan(phi1) * tan(phi1) AS t1,
              {a_s} / sqrt(1 - {e2s} * sin(phi1) * sin(phi1)) AS n1,
              {a_s} * (1 - {e2s}) / power(1 - {e2s} * sin(phi1) * sin(phi1), 1.5) AS r1 FROM
        (SELECT *, mu + {series} AS phi1 FROM
          (SELECT *, y / 0.9996::DOUBLE / ({a_s} * {m0!r}::DOUBLE) AS mu FROM {source}))))"""


step("o_lonlat", inverse_mercator_sql("v_polygon", "vertex_id"))


@query("utm_to_lonlat", "SELECT vertex_id, R6(long) AS long, R6(lat) AS lat FROM o_lonlat")
def _(s):
    df = geo.with_lonlat(s.polygon.select("vertex_id", "x", "y"), "x", "y")
    return fix(df.select("vertex_id", "long", "lat"), 6)
