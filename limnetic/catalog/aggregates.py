"""Aggregations."""

from __future__ import annotations

from pyspark.sql import functions as F

from limnetic.functions import scalars
from limnetic.functions.calendar import week_of_year
from limnetic.operators import aggregates as A
from limnetic.operators.ordered import group_median
from limnetic.operators.reshape import pivot_counts, shares

from .registry import fix, fixed, query, step

step(
    "o_net_density",
    """SELECT c.op_id, c.net, c.species, c.n, t.op_date, t.location,
       c.n / nullif(t.distance * 5280 * 6.56168 / 107639.1, 0) AS fish_ha
FROM v_catch c JOIN v_tow t USING (op_id)""",
)


def net_density(s):
    tows = s.tow.select("op_id", "op_date", "location", "distance")
    df = s.catch.join(tows, "op_id")
    density = scalars.fish_per_hectare(F.col("n"), F.col("distance"))
    return df.withColumn("fish_ha", density).drop("distance")


@query("group_count", "SELECT species, genetics, count(*) AS n FROM v_specimen GROUP BY species, genetics")
def _(s):
    return s.specimen.groupBy("species", "genetics").agg(A.rows().alias("n"))


@query(
    "agg_skip_na",
    """SELECT CAST(year(date) AS INT) AS year, CAST(month(date) AS INT) AS month, min(rwsp) AS wind_min,
       max(rwsp) AS wind_max, R4(avg(rwsp)) AS wind_mean, R4(sum(rwsp)) AS wind_sum FROM v_weather GROUP BY 1, 2""",
)
def _(s):
    return s.weather.groupBy(F.year("date").alias("year"), F.month("date").alias("month")).agg(
        F.min("rwsp").alias("wind_min"),
        F.max("rwsp").alias("wind_max"),
        fixed(F.avg("rwsp")).alias("wind_mean"),
        fixed(F.sum("rwsp")).alias("wind_sum"),
    )


@query(
    "agg_strict_na",
    """SELECT op_id, CASE WHEN count(length) = count(*) THEN R4(avg(length)) END AS mean_length,
       CASE WHEN count(length) = count(*) THEN min(length) END AS min_length,
       CASE WHEN count(length) = count(*) THEN max(length) END AS max_length,
       CASE WHEN count(length) = count(*) THEN R4(sum(length)) END AS sum_length FROM v_specimen GROUP BY op_id""",
)
def _(s):
    x = F.col("length")
    return s.specimen.groupBy("op_id").agg(
        fixed(A.strict(F.avg, x)).alias("mean_length"),
        A.strict(F.min, x).alias("min_length"),
        A.strict(F.max, x).alias("max_length"),
        fixed(A.strict(F.sum, x)).alias("sum_length"),
    )


@query(
    "agg_median",
    "SELECT species, yolk_sac, R4(median(length)) AS median_length FROM v_specimen GROUP BY species, yolk_sac",
)
def _(s):
    return s.specimen.groupBy("species", "yolk_sac").agg(fixed(F.median("length")).alias("median_length"))


@query(
    "agg_median_continuous",
    """SELECT species, R4(median(fish_ha)) AS median_density FROM o_net_density
       WHERE fish_ha IS NOT NULL GROUP BY species""",
)
def _(s):
    return fix(group_median(net_density(s), ["species"], "fish_ha", "median_density"))


# SQL has no such sketch; it states what must hold of every group, and its rows.
@query(
    "agg_median_sketch",
    "SELECT species, count(*) AS n, true AS within FROM o_net_density WHERE fish_ha IS NOT NULL GROUP BY species",
)
def _(s):
    ranks = A.sketch_ranks(net_density(s), ["species"], "fish_ha")
    return ranks.select("species", "n", (F.col("rank_error") <= A.RANK_ERROR).alias("within"))


@query(
    "agg_sd_se",
    """SELECT species, genetics, R4(stddev_samp(length)) AS sd, R4(stddev_samp(length) / sqrt(count(length))) AS se
       FROM v_specimen GROUP BY species, genetics""",
)
def _(s):
    x = F.col("length")
    return s.specimen.groupBy("species", "genetics").agg(
        fixed(F.stddev_samp(x)).alias("sd"), fixed(A.standard_error(x)).alias("se")
    )


@query(
    "agg_derived",
    """SELECT location, jday_min, jday_max, jday_max - jday_min AS jday_range FROM
       (SELECT location, CAST(min(dayofyear(op_date)) AS INT) AS jday_min,
               CAST(max(dayofyear(op_date)) AS INT) AS jday_max FROM v_tow GROUP BY location)""",
)
def _(s):
    jday = F.dayofyear("op_date")
    out = s.tow.groupBy("location").agg(F.min(jday).alias("jday_min"), F.max(jday).alias("jday_max"))
    return out.withColumn("jday_range", F.col("jday_max") - F.col("jday_min"))


@query(
    "count_distinct",
    """SELECT target, count(DISTINCT coalesce(tow_time, -1)) AS times, count(DISTINCT location) AS sites
       FROM v_tow GROUP BY target""",
)
def _(s):
    return s.tow.groupBy("target").agg(
        A.n_distinct(F.col("tow_time")).alias("times"), A.n_distinct(F.col("location")).alias("sites")
    )


@query(
    "count_distinct_multi",
    """SELECT location, count(*) AS collections FROM (SELECT DISTINCT location, op_date, tow_time FROM v_tow)
       GROUP BY location""",
)
def _(s):
    pair = A.n_distinct(F.col("op_date"), F.col("tow_time"))
    return s.tow.groupBy("location").agg(pair.alias("collections"))


@query(
    "conditional_agg",
    """SELECT op_id, CAST(coalesce(sum(CASE WHEN species IN (202, 204) THEN n END), 0) AS BIGINT) AS fish,
       min(CASE WHEN species IN (202, 204) THEN n END) AS fish_min,
       max(CASE WHEN species IN (202, 204) THEN n END) AS fish_max,
       R4(avg(CASE WHEN species IN (202, 204) THEN n END)) AS fish_mean,
       R4(median(CASE WHEN species IN (202, 204) THEN n END)) AS fish_median FROM v_catch GROUP BY op_id""",
)
def _(s):
    wanted = F.col("species").isin(202, 204)
    n = F.when(wanted, F.col("n"))
    return s.catch.groupBy("op_id").agg(
        A.sum_where(wanted, F.col("n")).alias("fish"),
        F.min(n).alias("fish_min"),
        F.max(n).alias("fish_max"),
        fixed(F.avg(n)).alias("fish_mean"),
        fixed(F.median(n)).alias("fish_median"),
    )


@query(
    "conditional_distinct",
    """SELECT CAST(year(op_date) AS INT) AS year, count(DISTINCT CASE WHEN species = 0 THEN location END) AS absent,
       count(DISTINCT CASE WHEN species IN (202, 204, 206, 217) THEN location END) AS present
       FROM o_net_density GROUP BY 1""",
)
def _(s):
    site, species = F.col("location"), F.col("species")
    return net_density(s).groupBy(F.year("op_date").alias("year")).agg(
        A.n_distinct_where(species == 0, site).alias("absent"),
        A.n_distinct_where(species.isin(202, 204, 206, 217), site).alias("present"),
    )


@query(
    "global_agg",
    """SELECT count(*) AS nets, CAST(sum(n) AS BIGINT) AS fish, count(DISTINCT species) AS kinds,
       R4(avg(n)) AS mean_fish FROM v_catch""",
)
def _(s):
    return s.catch.agg(
        A.rows().alias("nets"),
        F.sum("n").alias("fish"),
        A.n_distinct(F.col("species")).alias("kinds"),
        fixed(F.avg("n")).alias("mean_fish"),
    )


@query(
    "two_level_agg",
    """SELECT target, R4(avg(span)) AS mean_span, R4(max(depth)) AS deepest FROM
       (SELECT target, location, max(dayofyear(op_date)) - min(dayofyear(op_date)) AS span, avg(beg_depth) AS depth
        FROM v_tow GROUP BY target, location) GROUP BY target""",
)
def _(s):
    jday = F.dayofyear("op_date")
    sites = s.tow.groupBy("target", "location").agg(
        (F.max(jday) - F.min(jday)).alias("span"), F.avg("beg_depth").alias("depth")
    )
    return fix(sites.groupBy("target").agg(F.avg("span").alias("mean_span"), F.max("depth").alias("deepest")))


@query(
    "agg_date_range",
    "SELECT location, min(op_date) AS first_date, max(op_date) AS last_date FROM v_tow GROUP BY location",
)
def _(s):
    return s.tow.groupBy("location").agg(
        F.min("op_date").alias("first_date"), F.max("op_date").alias("last_date")
    )


@query(
    "value_frequency",
    "SELECT species, length, yolk_sac, count(*) AS bars FROM v_specimen WHERE length IS NOT NULL GROUP BY ALL",
)
def _(s):
    df = s.specimen.filter(F.col("length").isNotNull())
    return df.groupBy("species", "length", "yolk_sac").agg(A.rows().alias("bars"))


@query(
    "weighted_frequency",
    """SELECT CAST(floor((dayofyear(op_date) - 1) / 7) AS INT) + 1 AS week, species, CAST(sum(n) AS BIGINT) AS fish
       FROM o_net_density GROUP BY ALL""",
)
def _(s):
    per_tow = s.catch.groupBy("op_id", "species").agg(F.sum("n").alias("n"))
    dated = per_tow.join(s.tow.select("op_id", week_of_year(F.col("op_date")).alias("week")), "op_id")
    return dated.groupBy("week", "species").agg(F.sum("n").alias("fish"))


@query(
    "share_within_group",
    """SELECT genetics, species, n, R6(n / sum(n) OVER (PARTITION BY genetics)) AS share,
       CAST(round(CAST(n / sum(n) OVER (PARTITION BY genetics) * 100 AS DECIMAL(28,10)), 1) AS VARCHAR) || '%' AS label
       FROM (SELECT genetics, species, count(*) AS n FROM v_specimen WHERE genetics IS NOT NULL GROUP BY ALL)""",
)
def _(s):
    df = s.specimen.filter(F.col("genetics").isNotNull())
    return fix(A.share_within(df, ["genetics"], ["species"]), 6)


step(
    "o_net_kinds",
    """SELECT op_id, count(*) FILTER (species = 202) AS cisco, count(*) FILTER (species = 204) AS bloater,
       count(*) FILTER (species = 206) AS kiyi FROM v_catch GROUP BY op_id""",
)


@query(
    "pie_shares",
    """SELECT op_id, 'cisco' AS part, R6(cisco / nullif(cisco + bloater + kiyi, 0)) AS share FROM o_net_kinds
       UNION ALL SELECT op_id, 'bloater', R6(bloater / nullif(cisco + bloater + kiyi, 0)) FROM o_net_kinds
       UNION ALL SELECT op_id, 'kiyi', R6(kiyi / nullif(cisco + bloater + kiyi, 0)) FROM o_net_kinds""",
)
def _(s):
    wide = pivot_counts(s.catch, ["op_id"], "species", [202, 204, 206])
    wide = wide.withColumnsRenamed({"202": "cisco", "204": "bloater", "206": "kiyi"})
    return fix(shares(wide, ["op_id"], ["cisco", "bloater", "kiyi"]), 6)
