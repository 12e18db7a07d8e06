"""Scans and sinks. A workbook is a folder, each of its sheets a sub-folder."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .schemas import SCHEMAS

# The partition column of tables by year, and the files of one year at most.
YEAR, YEAR_FILES = "_year", 8


def scan_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """CSV with a header row and ``NA`` for missing; bad fields become NULL."""
    return spark.read.schema(schema).csv(path, header=True, nullValue="NA", mode="PERMISSIVE")


def scan_csv_checked(spark: SparkSession, path: str, schema: T.StructType, quarantine: str, header: bool = True) -> tuple[DataFrame, DataFrame]:
    """``scan_csv``, with what did not parse written beside it and counted.

    Fields are read as text and cast one by one, so one bad field costs no other. Rows of too
    few or too many fields, and rows with a field that is not of its declared type, go to the
    Parquet folder ``quarantine`` with their fields as text, ``line`` (the row as it stands,
    where its number of fields is wrong) and ``bad_fields``. Returns the typed rows (a bad field
    is NULL; rows of the wrong length are left out) and the counts (field, rows): one row for
    each field with a bad value, and ``line`` for rows of the wrong length.
    """
    names, bad = schema.names, "bad_fields"
    text = T.StructType([T.StructField(n, T.StringType()) for n in names] + [T.StructField("line", T.StringType())])
    # Every field is parsed whatever is asked for, so that a row's length is always seen.
    reader = spark.read.schema(text).option("columnPruning", False)
    raw = reader.csv(path, header=header, nullValue="NA", mode="PERMISSIVE", columnNameOfCorruptRecord="line")
    cast = {f.name: F.col(f"`{f.name}`").try_cast(f.dataType) for f in schema.fields}
    wrong = [F.when(F.col(f"`{n}`").isNotNull() & cast[n].isNull(), F.lit(n)) for n in names]
    checked = raw.withColumn(bad, F.when(F.col("line").isNull(), F.array_compact(F.array(*wrong))).otherwise(F.array(F.lit("line"))))
    checked.filter(F.size(bad) > 0).write.mode("overwrite").parquet(quarantine)
    counts = spark.read.parquet(quarantine).select(F.explode(bad).alias("field")).groupBy("field").agg(F.count(F.lit(1)).alias("rows"))
    return checked.filter(~F.array_contains(bad, "line")).select(*[cast[n].alias(n) for n in names]), counts


def scan_sheet(
    spark: SparkSession, root: str, book: str, sheet: str, schema: T.StructType | None = None
) -> DataFrame:
    schema = schema or SCHEMAS[(book, sheet)]
    return spark.read.schema(schema).parquet(f"{root}/{book}/{sheet}")


def scan_sheets(
    spark: SparkSession, root: str, book: str, sheets: list[str], schema: T.StructType
) -> DataFrame:
    """Same-schema sheets appended in one scan."""
    return spark.read.schema(schema).parquet(*[f"{root}/{book}/{sheet}" for sheet in sheets])


def polygon_vertices(df: DataFrame, group: str, ring: str) -> DataFrame:
    """Flatten ``array<struct<x,y>>`` rings to ordered vertex rows (1-based)."""
    return df.select(group, F.posexplode(ring).alias("pos", "v")).select(
        group, (F.col("pos") + 1).alias("vertex_no"), F.col("v.x").alias("x"), F.col("v.y").alias("y")
    )


def write_summary(df: DataFrame, path: str, fmt: str = "parquet") -> str:
    text = {"header": True, "nullValue": "NA"}
    text |= {"ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    options = text if fmt == "csv" else {}
    df.write.mode("overwrite").format(fmt).options(**options).save(path)
    return path


def write_chart_data(df: DataFrame, path: str, facets: list[str], keep_others: bool = False) -> str:
    """The table behind a faceted chart, one folder per facet value.

    With ``keep_others`` only the folders of facets that ``df`` has are replaced: a rerun for
    one facet leaves the files of the others untouched.
    """
    mode = "dynamic" if keep_others else "static"
    df.write.mode("overwrite").option("partitionOverwriteMode", mode).partitionBy(*facets).parquet(path)
    return path


def write_by_year(df: DataFrame, path: str, date: str) -> str:
    """A dated table in one folder per year, so that scans of some years open their files only."""
    df.withColumn(YEAR, F.year(date)).repartition(YEAR, F.xxhash64(*df.columns) % YEAR_FILES).write.mode("overwrite").partitionBy(YEAR).parquet(path)
    return path


def read_by_year(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A table of ``write_by_year``, with its column ``_year``."""
    return spark.read.schema(T.StructType([*schema.fields, T.StructField(YEAR, T.IntegerType())])).parquet(path)


def same_day_join(left: DataFrame, by_year: DataFrame, keys: list[str], date: str = "date") -> DataFrame:
    """Left join on ``keys`` and the date; of ``by_year`` only the years that ``left`` has are read.

    Spark finds these years from the left side as it runs, where that side is filtered, and
    prunes the folders before they are opened.
    """
    on = [*keys, date, YEAR]
    return left.withColumn(YEAR, F.year(date)).join(by_year, on, "left").drop(YEAR)


def write_bucketed(df: DataFrame, table: str, path: str, key: str, buckets: int) -> DataFrame:
    """A table of the session's catalog, dealt to ``buckets`` by ``key`` and sorted inside them.

    Tables bucketed alike are joined and grouped on the key without an exchange. Rows are
    dealt out first, so there is one file a bucket.
    """
    df.repartition(buckets, key).write.mode("overwrite").bucketBy(buckets, key).sortBy(key).option("path", path).saveAsTable(table)
    return df.sparkSession.table(table)


def append_all(frames: list[DataFrame]) -> DataFrame:
    """Stack tables; a column missing from one of them is NULL there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
