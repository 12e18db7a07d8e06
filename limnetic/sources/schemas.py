"""Declared schemas of the survey inputs. Nothing is inferred at read time."""

from __future__ import annotations

from pyspark.sql import types as T

_TYPES = {
    "int": T.IntegerType(),
    "long": T.LongType(),
    "double": T.DoubleType(),
    "string": T.StringType(),
    "date": T.DateType(),
}


def _schema(text: str) -> T.StructType:
    fields = (item.split(":") for item in text.split())
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in fields])


_TOW = (
    "OP_ID:long TARGET:int OP_DATE:string TIME:int LOCATION:int "
    "BEG_LATITUDE_DD:double END_LATITUDE_DD:double "
    "BEG_LONGITUDE_DD:double END_LONGITUDE_DD:double "
    "BEG_DEPTH:double END_DEPTH:double DISTANCE:double SPECIES:int N:int"
)

# (book, sheet) -> schema; a CSV file is a book with one sheet.
SCHEMAS = {
    ("ice", "wide"): _schema(
        "date:date " + " ".join(f"{year}:double" for year in range(1973, 2023))
    ),
    ("bt", "sample"): _schema(
        "Sample:string Year:int LOCATION:int Date:date SurfaceT:double "
        "d<3mT:double ChlSurf:double Chl3m:double"
    ),
    ("weather", "location"): _schema("Longitude:double Latitude:double"),
    ("weather", "readings"): _schema(
        "Date:date Station:string RWSP:double ATMP:double WDIR:double"
    ),
    ("species", "taxonomy"): _schema("SPECIES:int COMMON_NAME:string SCIENTIFIC_NAME:string"),
    ("neuston", "catch"): _schema(_TOW),
    ("neuston", "lengths"): _schema("OP_ID:long SPECIES:int LENGTH:double"),
    ("shore", "distance"): _schema("LOCATION:int ShoreDistance:double"),
    ("genetics", "genomics"): _schema(
        "OP_ID:long SPECIES:int GENETICS:int Length:double Weight:double YolkSac:string"
    ),
    ("genetics", "strain"): _schema(
        "OP_ID:long SPECIMEN_NUMBER:long GENETICS:int Length:double GP:double"
    ),
    ("genetics", "larvae"): _schema(
        "OP_ID:long SPECIES:int GENETICS:int Length:double YolkSac:string"
    ),
    ("genetics", "age0"): _schema("OP_ID:long SPECIES:int GENETICS:int Length:double"),
    ("water", "daily"): _schema("date:date Superior:double"),
    ("trawl", "catch"): _schema(
        _TOW
        + " TOW_TIME:double FISHING_DEPTH:double SURF_TEMP:double BEG_SURF:double"
        " END_SURF:double BEG_BOTTOM:double END_BOTTOM:double TEMP_BEG_BOTTOM:double"
        " TEMP_END_BOTTOM:double TR_DESIGN:int STATE:string M_UNIT:string"
    ),
    ("trawl", "lengths"): _schema("OP_ID:long SPECIES:int LENGTH:double EXP_N:int"),
    ("lab", "sheet"): _schema(
        "OP_ID:long OP_DATE:date LOCATION:int SPECIES:int LENGTH:double "
        "BEG_LATITUDE_DD:double END_LATITUDE_DD:double "
        "BEG_LONGITUDE_DD:double END_LONGITUDE_DD:double "
        "BEG_DEPTH:double END_DEPTH:double TR_DESIGN:int"
    ),
    ("lab", "samples"): _schema("Date:date"),
}
