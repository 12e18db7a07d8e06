"""Hot keys, blocks and plans."""

import random
import statistics as st

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from limnetic.operators.joins import natural_join, spread_join, with_group_size
from limnetic.operators.ordered import group_median, numbered, prefix_sums
from limnetic.operators.reshape import pivot_counts, pivot_values, unpivot_long
from limnetic.operators.aggregates import length_statistics
from limnetic.operators.reshape import expand_rows
from limnetic.plans.lengths import expanded_daily_lengths


def skewed(spark, n=3000):
    """A third of the rows under one key, some without a key."""
    rows = [(7 if i % 3 == 0 else None if i % 50 == 1 else i % 400, i, float(i * 37 % 101)) for i in range(n)]
    return rows, spark.createDataFrame(rows, "k int, id long, v double")


def test_spread_join_equals_plain_join(spark):
    _, left = skewed(spark)
    right = spark.createDataFrame([(k, f"n{k}") for k in range(0, 390)] + [(None, "none")], "k int, name string")
    a = sorted(map(tuple, spread_join(left, right, "k").collect()), key=str)
    b = sorted(map(tuple, natural_join(left, right).collect()), key=str)
    assert a == b and len(a) == 3000


def test_spread_join_splits_equal_rows_of_a_hot_key(spark, tmp_path):
    """4,000 equal left rows under one key end up in several tasks."""
    path = str(tmp_path / "left")
    spark.range(4000).select(F.lit(7).alias("k"), F.lit("v" * 200).alias("v")).repartition(8).write.parquet(path)
    left = spark.read.parquet(path)
    right = spark.createDataFrame([(7, "seven"), (8, "eight")], "k int, name string")
    small = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "100",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "100",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1",
    }
    for name, value in small.items():
        spark.conf.set(name, value)
    try:
        per_task = spread_join(left, right, "k").groupBy(F.spark_partition_id().alias("p")).count().collect()
        assert sum(r["count"] for r in per_task) == 4000 and max(r["count"] for r in per_task) <= 1000
    finally:
        for name in small:
            spark.conf.unset(name)


def test_prefix_sums(spark):
    rnd = random.Random(1)
    cells = {(rnd.choice([1, 1, 1, 2, None]), rnd.randint(0, 10**6) ** 2): rnd.randint(1, 9) for _ in range(800)}
    df = spark.createDataFrame([(g, x, n) for (g, x), n in cells.items()], "g int, x long, n long")
    for r in prefix_sums(df, ["g"], "x", ["n"]).collect():
        own = [(x, n) for (g, x), n in cells.items() if g == r["g"]]
        assert r["cum_n"] == sum(n for x, n in own if x <= r["x"])
        assert r["total_n"] == sum(n for _, n in own)


def test_group_median(spark):
    rnd = random.Random(2)
    rows = [(rnd.choice("aaab"), rnd.expovariate(1) ** 4) for _ in range(1001)] + [("c", 3.0), ("d", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    got = {r["g"]: r["median"] for r in group_median(df, ["g"], "v").collect()}
    assert got == pytest.approx({g: st.median(v for h, v in rows if h == g) for g in "abc"})
    everything = st.median(v for _, v in rows if v is not None)
    assert group_median(df, [], "v").first()["median"] == pytest.approx(everything)


def test_weighted_median_equals_expanded(spark):
    rows = [(1, float(i % 17), i % 5) for i in range(200)]
    df = spark.createDataFrame(rows, "g int, v double, w int")
    a = group_median(df, ["g"], "v", weight="w").first()["median"]
    assert a == expand_rows(df, "w").agg(F.median("v")).first()[0]


def test_numbered(spark):
    _, df = skewed(spark)
    rows = numbered(df.dropna(), ["k", "id"]).orderBy("k", "id").collect()
    assert [r["id"] for r in numbered(df.dropna(), ["k"], ["id"], "no").orderBy("no").collect()] == [
        r[1] for r in sorted((r["k"], r[1]) for r in df.dropna().collect())
    ]
    assert len(rows) == df.dropna().count()


def test_group_size(spark):
    rows, df = skewed(spark)
    got = {r["k"]: r["n"] for r in with_group_size(df, ["k"]).collect()}
    assert got[7] == sum(r[0] == 7 for r in rows) and got[None] == sum(r[0] is None for r in rows)


def test_unpivot_undoes_pivot(spark):
    rows = [(i, m, float(i * 10 + j)) for i in range(5) for j, m in enumerate(["a", "b", "c"])]
    df = spark.createDataFrame(rows, "i int, m string, v double")
    wide = pivot_values(df, ["i"], "m", ["a", "b", "c"], "v")
    back = unpivot_long(wide, ["i"], ["a", "b", "c"], "m", "v")
    assert sorted(map(tuple, back.collect())) == sorted(rows)


def test_pivot_counts_missing_level(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b"), (3, None)], "i int, m string")
    got = sorted(map(tuple, pivot_counts(df, ["i"], "m", ["a", "z"]).collect()))
    assert got == [(1, 2, 0), (2, 0, 0), (3, 0, 0)]


def test_weighted_lengths_equal_expanded(spark):
    rnd = random.Random(5)
    fish = [(rnd.randint(1, 4), 202, float(rnd.randint(20, 60)), rnd.randint(0, 6)) for _ in range(300)]
    lengths = spark.createDataFrame(fish, "op_id long, species int, length double, exp_n int")
    effort = spark.sql(
        "SELECT id AS op_id, DATE '2022-09-01' + CAST(id % 2 AS INT) AS date, 1 AS location, 'Bottom trawl' AS gear,"
        " 2022 AS year, 9 AS month FROM range(1, 5)"
    )
    none = spark.createDataFrame([], "date date, mean_temp double")
    got = expanded_daily_lengths(lengths, effort, lengths.limit(0), effort.limit(0), none, 2022)
    want = expand_rows(lengths, "exp_n").join(effort, "op_id").groupBy("date").agg(*length_statistics("length"))
    a = {r["date"]: r for r in got.collect()}
    for r in want.collect():
        for name in ("n", "min_length", "max_length", "mean_length", "median_length", "sd_length", "se_length"):
            assert a[r["date"]][name] == pytest.approx(r[name])


def plan(spark, small, key):
    return entry.queries()[key](spark, small)._jdf.queryExecution().executedPlan().toString()


def test_species_lookup_is_broadcast(spark, small):
    assert "BroadcastHashJoin" in plan(spark, small, "lookup_join")


def test_filter_and_columns_reach_the_scan(spark, small):
    text = plan(spark, small, "filter_date")
    assert "PushedFilters: [" in text.replace("PushedFilters: []", "") or "DataFilters: [" in text
    assert "o_totalprice" not in text


def test_weather_reads_only_its_columns(spark, small):
    assert "l_extendedprice" not in plan(spark, small, "weather_monthly")
