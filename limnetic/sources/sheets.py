"""From the declared sheets to the tables that the plans read, and back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from limnetic.functions.calendar import parse_dmy
from limnetic.operators.reshape import first_per_key

from .files import scan_sheet, write_summary
from .schemas import SCHEMAS

# Column names of the sheets and of the plans. Columns not named here keep theirs in lower case.
NAMES = {
    "OP_DATE": "op_date", "TIME": "tow_time", "BEG_LATITUDE_DD": "beg_lat", "END_LATITUDE_DD": "end_lat",
    "BEG_LONGITUDE_DD": "beg_lon", "END_LONGITUDE_DD": "end_lon", "ShoreDistance": "shore_distance",
    "SurfaceT": "surface_t", "d<3mT": "t3m", "ChlSurf": "chl_surf", "YolkSac": "yolk_sac", "Superior": "superior",
}


def plan_name(column: str) -> str:
    return NAMES.get(column, column.lower())


def plan_table(spark: SparkSession, root: str, book: str, sheet: str) -> DataFrame:
    """A declared sheet under the plans' column names, day texts parsed."""
    scanned = scan_sheet(spark, root, book, sheet)
    out = scanned.select(*[F.col(f"`{c}`").alias(plan_name(c)) for c in scanned.columns])
    text = dict(scanned.dtypes).get("OP_DATE") == "string"
    return out.withColumn("op_date", parse_dmy(F.col("op_date"))) if text else out


def write_plan_table(df: DataFrame, root: str, book: str, sheet: str) -> None:
    """Write a plan table as a declared sheet; columns that it lacks are missing there."""
    have = set(df.columns)
    cells = []
    for field in SCHEMAS[(book, sheet)].fields:
        name = plan_name(field.name)
        value = F.col(name) if name in have else F.lit(None)
        if field.name == "OP_DATE" and field.dataType.simpleString() == "string":
            value = F.date_format(value, "dd-MMM-yy")
        cells.append(value.cast(field.dataType).alias(field.name))
    write_summary(df.select(*cells), f"{root}/{book}/{sheet}")


def tows_and_catch(spark: SparkSession, root: str, book: str) -> tuple[DataFrame, DataFrame]:
    """The tows of a catch sheet, one row each, and its catch rows."""
    rows = plan_table(spark, root, book, "catch")
    catch = rows.select("op_id", "species", "n")
    return first_per_key(rows.drop("species", "n"), ["op_id"], ["op_date"]), catch
