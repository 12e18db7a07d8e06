"""Scans that check what they parse, sinks that can be repeated, and tables laid out for pruning and joins."""

import glob
import os
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from limnetic import session
from limnetic.catalog import joins
from limnetic.session import shared_path
from limnetic.sources import files
from limnetic.sources.survey import Survey


def plan_of(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


SCHEMA = T.StructType([
    T.StructField("id", T.LongType()), T.StructField("day", T.DateType()), T.StructField("length", T.DoubleType()), T.StructField("name", T.StringType()),
])


def test_checked_scan(spark, tmp_path):
    text = "id,day,length,name\n1,2001-05-06,1.5,a\n2,NA,NA,NA\nx,2001-13-40,2,b\n4,2001-05-06\n5,2001-05-06,3,c,more\n6,2001-05-07,1,5\n7,2001-05-06,two,\"quoted, text\"\n"
    path, bad = str(tmp_path / "rows.csv"), str(tmp_path / "bad")
    with open(path, "w") as f:
        f.write(text)
    rows, counts = files.scan_csv_checked(spark, path, SCHEMA, bad)
    found = {r["name"]: (r["id"], str(r["day"]), r["length"]) for r in rows.collect()}
    assert found == {"a": (1, "2001-05-06", 1.5), None: (2, "None", None), "b": (None, "None", 2.0), "5": (6, "2001-05-07", 1.0), "quoted, text": (7, "2001-05-06", None)}
    assert {r["field"]: r["rows"] for r in counts.collect()} == {"id": 1, "day": 1, "length": 1, "line": 2}
    kept = spark.read.parquet(bad).collect()
    assert sorted(r["line"] for r in kept if r["line"]) == ["4,2001-05-06", "5,2001-05-06,3,c,more"]
    assert {(r["id"], tuple(r["bad_fields"])) for r in kept if not r["line"]} == {("x", ("id", "day")), ("7", ("length",))}
    assert rows.schema == SCHEMA


def test_checked_scan_of_clean_and_empty_files(spark, tmp_path):
    for name, text, n in (("clean", "id,day,length,name\n1,2001-05-06,1.5,a\n", 1), ("empty", "id,day,length,name\n", 0)):
        path = str(tmp_path / f"{name}.csv")
        with open(path, "w") as f:
            f.write(text)
        rows, counts = files.scan_csv_checked(spark, path, SCHEMA, str(tmp_path / f"{name}-bad"))
        assert rows.count() == n and counts.count() == 0


def test_one_facet_is_written_again_alone(spark, tmp_path):
    path = str(tmp_path / "chart")
    df = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "facet string, n int")
    files.write_chart_data(df, path, ["facet"])
    stamps = {p: os.stat(p).st_mtime_ns for f in "ac" for p in glob.glob(f"{path}/facet={f}/*.parquet")}
    files.write_chart_data(spark.createDataFrame([("b", 20), ("d", 4)], df.schema), path, ["facet"], keep_others=True)
    assert {p: os.stat(p).st_mtime_ns for f in "ac" for p in glob.glob(f"{path}/facet={f}/*.parquet")} == stamps and len(stamps) == 2
    assert sorted(map(tuple, spark.read.schema(df.schema).parquet(path).select("facet", "n").collect())) == [("a", 1), ("b", 20), ("c", 3), ("d", 4)]
    files.write_chart_data(df, path, ["facet"])
    assert spark.read.parquet(path).count() == 3


def test_only_the_years_of_the_tows_are_read(spark, small):
    s = Survey(spark, small)
    path = files.write_by_year(s.bt, shared_path(spark, "bt"), "date")
    by_year = files.read_by_year(spark, path, s.bt.schema)
    tows = s.tow.filter("op_date >= DATE '1997-01-01' AND op_date < DATE '1998-01-01'").select("op_id", "location", F.col("op_date").alias("date"))
    joined = files.same_day_join(tows, by_year.select("location", "date", "_year", "surface_t"), ["location"])
    plan = plan_of(joined)
    assert "dynamicpruning" in plan.lower()
    scan = next(x for x in joined._jdf.queryExecution().executedPlan().toString().split("\n") if "FileScan parquet" in x and "_year" in x)
    assert "PartitionFilters" in scan
    plain = tows.join(s.bt.select("location", "date", "surface_t"), ["location", "date"], "left")
    assert sorted(map(str, joined.collect())) == sorted(map(str, plain.select(joined.columns).collect()))
    years = len(glob.glob(f"{path.removeprefix('file:')}/_year=*"))
    metrics = files_read(joined)
    assert years > 4 and 0 < metrics <= files.YEAR_FILES


def files_read(df):
    """Files that the scan of the year table opened."""
    nodes, total = [df._jdf.queryExecution().executedPlan()], 0
    while nodes:
        node = nodes.pop()
        if node.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
            nodes.append(node.executedPlan())
            continue
        if hasattr(node, "plan") and node.getClass().getSimpleName().endswith("QueryStageExec"):
            nodes.append(node.plan())
            continue
        children = node.children()
        nodes += [children.apply(i) for i in range(children.size())]
        if node.getClass().getSimpleName() == "FileSourceScanExec" and "_year" in node.toString():
            total += node.metrics().apply("numFiles").value()
    return total


def test_bucketed_tables_are_joined_without_an_exchange(spark, small):
    s = Survey(spark, small)
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = plan_of(joins.tow_totals(**joins.colocated(s, 4)))
        assert "Exchange" not in plan and "SortMergeJoin" in plan
        assert "Exchange" in plan_of(joins.tow_totals(s.tow.select("op_id", "op_date", "location"), s.catch, s.specimen.select("op_id", "genetics")))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)


def test_a_cluster_needs_a_shared_folder(spark):
    class Conf:
        def __init__(self, **values):
            self.values = values

        def get(self, key, default=None):
            return self.values.get(key, default)

    def seen(master, **conf):
        context = SimpleNamespace(master=master, applicationId="app")
        return SimpleNamespace(conf=Conf(**conf), sparkContext=context, _jvm=spark._jvm, _jsc=spark._jsc)

    with pytest.raises(ValueError):
        session.shared_path(seen("spark://host:7077", **{"spark.sql.warehouse.dir": "file:/tmp/warehouse"}), "x")
    with pytest.raises(ValueError):
        session.shared_path(seen("yarn", **{"spark.sql.warehouse.dir": "/tmp/warehouse"}), "x")
    shared = {"spark.checkpoint.dir": "file:/tmp/shared", "spark.sql.warehouse.dir": "file:/tmp/warehouse"}
    assert session.shared_path(seen("spark://host:7077", **shared), "x").startswith("file:/tmp/shared/limnetic/app/x-")
    assert session.shared_path(seen("local[2]", **{"spark.sql.warehouse.dir": "file:/tmp/warehouse"}), "x").startswith("file:/tmp/warehouse/")
