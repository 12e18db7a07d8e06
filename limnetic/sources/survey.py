"""The driver's tables seen as survey tables (tows, catch, specimens, ...).

Each view is plain SQL that Spark and the SQL oracle both accept, so that both
start from the same rows. NULLs, zero distances and several nets per tow come
from the expressions on purpose.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Species codes and common names.
SPECIES_NAMES = {
    0: "No fish",
    202: "Cisco",
    203: "Lake Whitefish",
    204: "Bloater",
    206: "Kiyi",
    208: "Shortnose Cisco",
    210: "Pygmy Whitefish",
    217: "Unidentified Coregonid",
    218: "ciscoe hybrid",
}

_SPECIES_ROWS = ",\n  ".join(f"({code}, '{name}')" for code, name in SPECIES_NAMES.items())

VIEWS = {
    "v_species": f"SELECT * FROM (VALUES {_SPECIES_ROWS}) AS t(species, common_name)",
    "v_site": """
SELECT CAST(c_custkey AS INT) AS location,
       CASE WHEN c_custkey % 17 = 0 THEN NULL ELSE abs(c_acctbal) * 5 END AS shore_distance
FROM {customer}""",
    "v_tow": """
SELECT o_orderkey AS op_id,
       CASE o_orderstatus WHEN 'P' THEN 2 WHEN 'F' THEN 117 ELSE 118 END AS target,
       CAST(o_orderdate AS DATE) AS op_date,
       CAST(nullif(o_orderkey % 24, 0) * 100 AS INT) AS tow_time,
       CAST(o_custkey AS INT) AS location,
       CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE 4.65E1 + (o_custkey % 250) / 1.0E2 END AS beg_lat,
       CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE 4.651E1 + (o_custkey % 250) / 1.0E2 END AS end_lat,
       CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE -9.2E1 + (o_custkey % 700) / 1.0E2 END AS beg_lon,
       CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE -9.199E1 + (o_custkey % 700) / 1.0E2 END AS end_lon,
       CAST(o_orderkey % 200 AS DOUBLE) AS beg_depth,
       CAST(nullif((o_orderkey * 7) % 200, 0) AS DOUBLE) AS end_depth,
       (o_orderkey % 30) / 1.0E2 AS distance,
       CASE o_orderkey % 5 WHEN 0 THEN 4 WHEN 1 THEN 25 WHEN 2 THEN 21 WHEN 3 THEN 45 ELSE 99 END AS tr_design,
       CASE o_orderkey % 6 WHEN 0 THEN 'WI ' WHEN 1 THEN ' MN' WHEN 2 THEN 'MI' WHEN 3 THEN 'E' WHEN 4 THEN 'W' ELSE NULL END AS state
FROM {orders}""",
    "v_trawl": """
SELECT o_orderkey AS op_id, CAST(o_orderkey % 24 AS INT) * 100 AS tow_time_raw,
       CAST(o_orderkey % 40 AS DOUBLE) AS fishing_depth_raw,
       CAST(o_orderkey % 9 AS DOUBLE) AS surf_temp, CAST(o_orderkey % 8 AS DOUBLE) AS beg_surf,
       CAST(o_orderkey % 7 AS DOUBLE) AS end_surf, CAST(o_orderkey % 6 AS DOUBLE) AS beg_bottom,
       CAST(o_orderkey % 5 AS DOUBLE) AS end_bottom,
       CAST(nullif(o_orderkey % 4, 0) AS DOUBLE) AS temp_beg_bottom,
       CAST(nullif(o_orderkey % 3, 0) AS DOUBLE) AS temp_end_bottom
FROM {orders}""",
    "v_catch": """
SELECT l_orderkey AS op_id, l_linenumber AS net,
       CASE l_partkey % 6 WHEN 0 THEN 0 WHEN 1 THEN 202 WHEN 2 THEN 204 WHEN 3 THEN 206 WHEN 4 THEN 217 ELSE 203 END AS species,
       CASE WHEN l_partkey % 6 = 0 THEN 0 ELSE CAST(l_quantity AS INT) END AS n
FROM {lineitem}""",
    "v_specimen": """
SELECT l_orderkey AS op_id, l_linenumber AS specimen_number,
       CASE l_partkey % 4 WHEN 0 THEN 202 WHEN 1 THEN 204 WHEN 2 THEN 206 ELSE 217 END AS species,
       CASE l_suppkey % 7 WHEN 0 THEN 202 WHEN 1 THEN 203 WHEN 2 THEN 204 WHEN 3 THEN 206
                          WHEN 4 THEN 208 WHEN 5 THEN CASE l_linenumber WHEN 1 THEN 210 WHEN 2 THEN 217 ELSE 218 END ELSE NULL END AS genetics,
       CASE WHEN l_quantity = 25 THEN NULL ELSE CAST(floor(l_extendedprice / 5.0E2) AS DOUBLE) END AS length,
       CASE l_returnflag WHEN 'A' THEN 'Y' WHEN 'N' THEN 'N' ELSE NULL END AS yolk_sac,
       CASE WHEN l_discount = 0 THEN NULL ELSE l_discount * 1.0E1 END AS gp,
       CAST(l_linenumber - 1 AS INT) AS exp_n
FROM {lineitem}""",
    "v_daily_temp": """
SELECT CAST(o_orderdate AS DATE) AS date, CAST(count(*) AS DOUBLE) AS superior
FROM {orders} GROUP BY CAST(o_orderdate AS DATE)""",
    "v_weather": """
SELECT CAST(l_shipdate AS DATE) AS date, l_returnflag AS station,
       nullif(l_quantity, 25) AS rwsp, l_discount * 100 AS atmp, l_tax * 1000 AS wdir, l_linestatus AS part
FROM {lineitem}""",
    "v_ice_wide": "SELECT month(CAST(o_orderdate AS DATE)) AS m, day(CAST(o_orderdate AS DATE)) AS d,\n"
    + ",\n".join(
        f"  CAST(sum(CASE WHEN year(CAST(o_orderdate AS DATE)) = {y} THEN 1 END) AS DOUBLE) AS y{y}"
        for y in range(1995, 2002)
    )
    + "\nFROM {orders} GROUP BY month(CAST(o_orderdate AS DATE)), day(CAST(o_orderdate AS DATE))",
    "v_bt": """
SELECT o_orderkey AS sample, CAST(o_custkey AS INT) AS location, CAST(o_orderdate AS DATE) AS date,
       CAST(nullif(o_orderkey % 20, 0) AS DOUBLE) AS surface_t, CAST(nullif(o_orderkey % 15, 0) AS DOUBLE) AS t3m,
       CAST(o_orderkey % 7 AS DOUBLE) AS chl_surf, CAST(o_orderkey % 9 AS DOUBLE) AS chl3m
FROM {orders}""",
    "v_lab": "SELECT event_id, CAST(ts AS DATE) AS date FROM {events}",
    "v_polygon": """
SELECT s_nationkey AS grp, s_suppkey AS vertex_id,
       3.0E5 + (s_suppkey % 400) * 1.0E3 AS x, 5.2E6 + (s_suppkey % 700) * 5.0E2 AS y
FROM {supplier}""",
}

# Declared schemas: reading needs no pass over file footers.
SCHEMAS = {
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
    "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
    "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, "
    "l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
}
TABLES = tuple(SCHEMAS)


class Survey:
    """Survey tables over one folder of Parquet tables."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root, self._views = spark, root, {}

    def table(self, name: str) -> DataFrame:
        return self.spark.read.schema(SCHEMAS[name]).parquet(f"{self.root}/{name}.parquet")

    def view(self, name: str) -> DataFrame:
        if name not in self._views:
            text = VIEWS[name]
            frames = {t: self.table(t) for t in TABLES if "{" + t + "}" in text}
            self._views[name] = self.spark.sql(text, **frames)
        return self._views[name]

    def __getattr__(self, name: str) -> DataFrame:
        if "v_" + name in VIEWS:
            return self.view("v_" + name)
        raise AttributeError(name)
