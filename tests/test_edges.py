"""Hand-made edge rows with known results."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from limnetic.functions import calendar as cal
from limnetic.functions import geo, scalars
from limnetic.operators import aggregates as A
from limnetic.operators.columns import level_number, select_positions, with_levels
from limnetic.operators.joins import join_first, natural_join
from limnetic.operators.ordered import running_total
from limnetic.operators.reshape import expand_rows, first_per_key, shares
from limnetic.operators.statistics import growth_label, mean_ci_normal, ols
from limnetic.plans.larvae import backlog_status, processing_backlog


def one(df):
    return tuple(df.first())


def col(df, name):
    return [r[name] for r in df.collect()]


def test_season_year(spark):
    df = spark.createDataFrame([(2015, 249), (2015, 250), (2015, 251)], "y int, j int")
    out = df.select("j", cal.season_year(F.col("y"), F.col("j")).alias("s"), cal.season_day(F.col("j")).alias("d"))
    assert [tuple(r) for r in out.orderBy("j").collect()] == [
        (249, 2015, 249), (250, None, None), (251, 2014, -115),
    ]


def test_week_blocks(spark):
    days = [(dt.date(2021, 1, 1),), (dt.date(2021, 1, 7),), (dt.date(2021, 1, 8),), (dt.date(2021, 12, 31),)]
    df = spark.createDataFrame(days, "d date").orderBy("d")
    assert col(df.select(cal.week_of_year(F.col("d")).alias("w")), "w") == [1, 1, 2, 53]


@pytest.mark.parametrize(
    "text, day",
    [
        ("03-Feb-95", dt.date(1995, 2, 3)),
        ("29-Feb-96", dt.date(1996, 2, 29)),
        ("01-Jun-22", dt.date(2022, 6, 1)),
        ("31-Dec-69", dt.date(2069, 12, 31)),
        ("01-Jan-70", dt.date(1970, 1, 1)),
        ("32-Jan-20", None),
        ("", None),
        (None, None),
    ],
)
def test_parse_dmy(spark, text, day):
    df = spark.createDataFrame([(text,)], "t string")
    assert one(df.select(cal.parse_dmy(F.col("t")))) == (day,)


def test_invalid_date_parts(spark):
    df = spark.createDataFrame([(2021, 2, 29), (2020, 2, 29), (2020, 13, 1), (2020, None, 1)], "y int, m int, d int")
    made = df.select(cal.date_from_parts(F.col("y"), F.col("m"), F.col("d")).alias("x"))
    assert col(made, "x") == [None, dt.date(2020, 2, 29), None, None]


def test_density(spark):
    df = spark.createDataFrame([(10, 0.5), (10, 0.0), (None, 0.5)], "n int, d double")
    got = col(df.select(scalars.fish_per_hectare(F.col("n"), F.col("d")).alias("x")), "x")
    assert got[0] == pytest.approx(62.1375, abs=1e-3) and got[1:] == [None, None]


def test_row_mean_and_pairs(spark):
    df = spark.createDataFrame([(2.0, None), (None, None), (1.0, 2.0)], "a double, b double")
    a, b = F.col("a"), F.col("b")
    assert col(df.select(scalars.row_mean(a, b).alias("m")), "m") == [2.0, None, 1.5]
    both = df.select(scalars.either(a, b).alias("x"), scalars.either(b, a).alias("y"))
    assert [tuple(r) for r in both.collect()] == [(2.0, 2.0), (None, None), (1.0, 2.0)]


def test_strict_against_skipping(spark):
    df = spark.createDataFrame([(1.0,), (None,), (3.0,)], "x double")
    assert one(df.agg(A.strict(F.avg, F.col("x")), F.avg("x"))) == (None, 2.0)


def test_running_sum_stops_at_a_gap(spark):
    rows = [(2000, 1, 1.0), (2000, 2, None), (2000, 3, 2.0), (2001, 1, 5.0)]
    df = running_total(spark.createDataFrame(rows, "y int, d int, x double"), ["y"], "d", "x", "c")
    assert col(df.orderBy("y", "d"), "c") == [1.0, None, None, 5.0]


def test_missing_keys_match(spark):
    a = spark.createDataFrame([(None, 1), (1, 2), (9, 3)], "k int, a int")
    b = spark.createDataFrame([(None, "x"), (1, "y")], "k int, b string")
    assert sorted(tuple(r)[1:] for r in natural_join(a, b).collect()) == [(1, "x"), (2, "y"), (3, None)]
    assert natural_join(a, b, "right").count() == 2


def test_natural_join_states_its_keys(spark):
    a = spark.createDataFrame([(1, 1)], "k int, extra int")
    with pytest.raises(ValueError):
        natural_join(a, a, keys=["k"])
    with pytest.raises(ValueError):
        natural_join(a, a.withColumnsRenamed({"k": "p", "extra": "q"}))


def test_join_first_keeps_left_rows(spark):
    a = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    b = spark.createDataFrame([(1, 5), (1, 3), (1, 4)], "k int, o int")
    assert sorted(tuple(r) for r in join_first(a, b, ["k"], ["o"]).collect()) == [(1, "a", 3), (2, "b", None)]


def test_united_prints_missing(spark):
    df = spark.createDataFrame([(None, "x")], "a int, b string")
    assert one(df.select(scalars.united(", ", F.col("a"), F.col("b")))) == ("NA, x",)


def test_half_even(spark):
    df = spark.createDataFrame([(0.5,), (1.5,), (2.5,)], "x double")
    assert [float(v) for v in col(df.select(scalars.half_even(F.col("x"), 0).alias("r")), "r")] == [0, 2, 2]


def test_single_row_has_no_spread(spark):
    df = spark.createDataFrame([(1, 5.0)], "g int, x double")
    assert one(df.agg(F.stddev_samp("x"), A.standard_error(F.col("x")))) == (None, None)
    assert one(mean_ci_normal(df, ["g"], "x")) == (1, 1, 5.0, None, None)


def test_labels(spark):
    df = spark.createDataFrame([(202, 202), (202, 204), (None, 202), (202, 218), (204, 218), (210, 202)], "a int, b int")
    a, b = F.col("a"), F.col("b")
    got = [tuple(r) for r in df.select(scalars.match_flag(a, b), scalars.pair_label(a, b)).collect()]
    assert got == [
        ("Yes", "Cisco/Cisco"), ("No", "Cisco/Bloater"), (None, None),
        ("No", "Cisco/Unknown"), ("No", "Bloater/hybrid"), ("No", None),
    ]


def test_percent_of_pair(spark):
    df = spark.createDataFrame([(1, 3), (0, 2), (0, 0)], "y int, n int")
    assert col(df.select(scalars.percent_of_pair(F.col("y"), F.col("n")).alias("p")), "p") == [25.0, 0.0, None]


def test_pie_shares(spark):
    df = spark.createDataFrame([(1, 0, 0, 0), (2, 1, 1, 2)], "k int, a int, b int, c int")
    got = {(r["k"], r["part"]): r["share"] for r in shares(df, ["k"], ["a", "b", "c"]).collect()}
    assert got == {
        (1, "a"): None, (1, "b"): None, (1, "c"): None, (2, "a"): 0.25, (2, "b"): 0.25, (2, "c"): 0.5,
    }


def backlog_inputs(spark, collected, location=10):
    day = dt.date(2022, 6, 1)
    density = spark.createDataFrame(
        [(day, location, 800, 217, 1, 2022, n, 46.0, -90.0, 9.0) for n in collected],
        "date date, location int, tow_time int, species int, op_id long, year int, fish long,"
        "mid_lat double, mid_lon double, mid_depth double",
    )
    counts = spark.createDataFrame([], "date date, location int, year int, n long")
    return processing_backlog(density, counts, 2022)


@pytest.mark.parametrize(
    "collected, could, work", [(250, 50, "To do"), (200, 0, "Processed"), (0, 0, "Processed")]
)
def test_backlog(spark, collected, could, work):
    row = backlog_inputs(spark, [collected]).first()
    assert (row["could_do"], row["work"]) == (could, work)
    assert row["presence"] == ("present" if collected else "absent")


def test_backlog_status(spark):
    out = backlog_status(backlog_inputs(spark, [250]), extra_catch=5).first()
    assert out["status"] == "0 fish processed of 255 fish collected"


def test_backlog_without_rule(spark):
    row = backlog_inputs(spark, [250], location=500).first()
    assert row["work"] == "0" and row["remaining"] == 250


def test_expand(spark):
    df = spark.createDataFrame([(1, 3), (2, 1), (3, 0), (4, None)], "k int, n int")
    assert sorted(col(expand_rows(df, "n"), "k")) == [1, 1, 1, 2]


def test_regression_and_label(spark):
    df = spark.createDataFrame([(1, 1.0, 2.0), (1, 2.0, 4.0), (1, 3.0, 6.0)], "g int, x double, y double")
    fit = ols(df, ["g"], F.col("x"), F.col("y"))
    assert one(fit) == (1, 3, pytest.approx(0), pytest.approx(2))
    assert growth_label(fit, "g").first()["legend"] == "1, 2 mm per day"


def test_first_row_order(spark):
    df = spark.createDataFrame([(1, 2, "b"), (1, None, "z"), (1, 1, "a")], "k int, o int, v string")
    assert one(first_per_key(df, ["k"], ["o"])) == (1, None, "z")


def test_levels(spark):
    df = spark.createDataFrame([("June",), ("May",), ("X",), (None,)], "m string")
    assert col(df.select(level_number(F.col("m"), ["May", "June"]).alias("n")), "n") == [2, 1, None, None]
    assert col(with_levels(df, "m", ["May", "June"], "n"), "m") == ["June", "May", None, None]


def test_positions(spark):
    df = spark.createDataFrame([(1, 2, 3, 4, 5)], "a int, b int, c int, d int, e int")
    assert select_positions(df, 1, (3, 4)).columns == ["a", "c", "d"]


def test_geodesic_distance(spark):
    df = spark.createDataFrame([(1.0, 0.0), (0.0, 0.0), (None, 0.0)], "lon double, lat double")
    got = col(geo.with_geodesic_distance(df, "lon", "lat", target=(0.0, 0.0)), "distance")
    assert got[0] == pytest.approx(111319.49, abs=0.01) and got[1] == 0 and got[2] is None


def test_geodesic_symmetry(spark):
    a, b = (-90.1, 46.7), (-87.3, 47.9)
    there = geo.with_geodesic_distance(spark.createDataFrame([a], "lon double, lat double"), "lon", "lat", b)
    back = geo.with_geodesic_distance(spark.createDataFrame([b], "lon double, lat double"), "lon", "lat", a)
    assert there.first()["distance"] == pytest.approx(back.first()["distance"], abs=1e-4)


def test_projection_origin(spark):
    df = spark.createDataFrame([(500000.0, 0.0)], "x double, y double")
    row = geo.with_lonlat(df, "x", "y").first()
    assert (row["long"], row["lat"]) == (pytest.approx(-87), pytest.approx(0, abs=1e-12))
