"""Drainage tables derived from the driver's tables, without randomness."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

OMIT_TYPES = {"MACHINERY": "primary", "BUILDING": "residential", "AUTOMOBILE": "footway", "HOUSEHOLD": "tertiary"}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def nodes(spark: SparkSession, d: str) -> DataFrame:
    """node_id, x, y, surface_elevation, contributing_area."""
    orders = read(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"))
    return read(spark, d, "customer").join(orders, "c_custkey", "left").select(
        F.col("c_custkey").alias("node_id"),
        (F.col("c_custkey") % 40 * 50).cast("double").alias("x"),
        (F.floor(F.col("c_custkey") / 40) * 50).cast("double").alias("y"),
        (F.lit(10.0) + F.col("c_acctbal") / 1000.0).alias("surface_elevation"),
        (F.coalesce("n", F.lit(0)) * 100).cast("double").alias("contributing_area"),
    )


def edges(spark: SparkSession, d: str) -> DataFrame:
    """u, v, id, length, highway, lanes of the grid between neighbours; one equi-join checks that v exists."""
    c = read(spark, d, "customer")
    u = F.col("c_custkey")
    highway = F.coalesce(F.create_map(*[F.lit(x) for kv in OMIT_TYPES.items() for x in kv])[F.col("c_mktsegment")], F.lit("track"))
    out = c.select(u.alias("u"), highway.alias("highway"), F.explode(F.filter(F.array(F.when(u % 40 < 39, u + 1), u + 40), lambda v: v.isNotNull())).alias("v"))
    return out.join(c.select(u.alias("v")), "v", "left_semi").select(
        "u", "v", F.concat_ws("-", F.col("u").cast("string"), F.col("v").cast("string")).alias("id"), F.lit(50.0).alias("length"), "highway",
        F.element_at(F.array(F.lit("2"), F.lit("2;1"), F.lit("1,2")), (F.col("u") % 3 + 1).cast("int")).alias("lanes"),
    )


def rivers(spark: SparkSession, d: str) -> DataFrame:
    """river_id, x, y0, y1: vertical lines."""
    return read(spark, d, "nation").where("n_nationkey < 4").select(F.col("n_nationkey").cast("long").alias("river_id"), (F.lit(225.0) + F.col("n_nationkey") * 500).alias("x"), F.lit(-25.0).alias("y0"), F.lit(100000.0).alias("y1"))


def ponds(spark: SparkSession, d: str) -> DataFrame:
    """pond_id, x, y, area_m2, water."""
    k = F.col("s_suppkey")
    return read(spark, d, "supplier").select(
        (k + 1_000_000).alias("pond_id"), (k * 137 % 1950 + F.lit(12.5)).alias("x"), (k * 91 % 1850 + F.lit(12.5)).alias("y"), (F.lit(500.0) + (F.col("s_acctbal") + 1000.0) * 8.0).alias("area_m2"),
        F.get(F.array(F.lit("lake"), F.lit("pond"), F.lit("reservoir"), F.lit("basin"), F.lit(None)), F.col("s_nationkey") % 5).alias("water"),
    )


def subs(spark: SparkSession, d: str) -> DataFrame:
    """sub_id, outlet_id, area, rc, slope."""
    k = F.col("c_custkey")
    return read(spark, d, "customer").select(k.alias("sub_id"), (F.floor(k / 4) * 4).cast("long").alias("outlet_id"), F.lit(2500.0).alias("area"), ((F.col("c_acctbal") + 1000.0) / 110.0).alias("rc"), (F.abs("c_acctbal") / 1000.0).alias("slope"))


def dem(spark: SparkSession, d: str) -> DataFrame:
    """row_, col_, value: cells of an elevation grid, null where there is no data."""
    k = F.col("p_partkey")
    return read(spark, d, "part").select((F.floor(k / 50)).cast("long").alias("row_"), (k % 50).alias("col_"), F.when(F.col("p_size") != 50, F.col("p_size") + F.col("p_retailprice") / 100.0).alias("value"))


def rain(spark: SparkSession, d: str) -> DataFrame:
    """rain_gage, date_, value."""
    e = read(spark, d, "events").where("event_type = 'view'")
    return e.groupBy(F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("date_")).agg(F.sum("value").alias("value")).select(F.lit(1).alias("rain_gage"), "date_", "value")


def results(spark: SparkSession, d: str) -> DataFrame:
    """name, attr, ts, value: series of simulated elements."""
    return read(spark, d, "events").select(F.concat(F.lit("J"), (F.col("user_id") % 20).cast("string")).alias("name"), F.col("event_type").alias("attr"), "ts", "value")


#: The same as DuckDB SQL, in the order of dependence.
SQL = {
    "fx_nodes": """SELECT c_custkey AS node_id, CAST(c_custkey % 40 * 50 AS DOUBLE) AS x, CAST(floor(c_custkey / 40.0) * 50 AS DOUBLE) AS y,
        CAST(10 AS DOUBLE) + c_acctbal / CAST(1000 AS DOUBLE) AS surface_elevation, CAST(coalesce(n, 0) * 100 AS DOUBLE) AS contributing_area
        FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) ON o_custkey = c_custkey""",
    "fx_edges": """SELECT a.c_custkey AS u, b.c_custkey AS v, a.c_custkey || '-' || b.c_custkey AS id, CAST(50 AS DOUBLE) AS length,
        CASE a.c_mktsegment WHEN 'MACHINERY' THEN 'primary' WHEN 'BUILDING' THEN 'residential' WHEN 'AUTOMOBILE' THEN 'footway' WHEN 'HOUSEHOLD' THEN 'tertiary' ELSE 'track' END AS highway,
        CASE a.c_custkey % 3 WHEN 0 THEN '2' WHEN 1 THEN '2;1' ELSE '1,2' END AS lanes
        FROM customer a JOIN customer b ON b.c_custkey = a.c_custkey + 40 OR (b.c_custkey = a.c_custkey + 1 AND a.c_custkey % 40 < 39)""",
    "fx_rivers": "SELECT CAST(n_nationkey AS BIGINT) AS river_id, CAST(225 + 500 * n_nationkey AS DOUBLE) AS x, CAST(-25 AS DOUBLE) AS y0, CAST(100000 AS DOUBLE) AS y1 FROM nation WHERE n_nationkey < 4",
    "fx_ponds": """SELECT s_suppkey + 1000000 AS pond_id, s_suppkey * 137 % 1950 + CAST(12.5 AS DOUBLE) AS x, s_suppkey * 91 % 1850 + CAST(12.5 AS DOUBLE) AS y,
        CAST(500 AS DOUBLE) + (s_acctbal + CAST(1000 AS DOUBLE)) * CAST(8 AS DOUBLE) AS area_m2, CASE s_nationkey % 5 WHEN 0 THEN 'lake' WHEN 1 THEN 'pond' WHEN 2 THEN 'reservoir' WHEN 3 THEN 'basin' END AS water FROM supplier""",
    "fx_subs": """SELECT c_custkey AS sub_id, CAST(floor(c_custkey / 4.0) * 4 AS BIGINT) AS outlet_id, CAST(2500 AS DOUBLE) AS area,
        (c_acctbal + CAST(1000 AS DOUBLE)) / CAST(110 AS DOUBLE) AS rc, abs(c_acctbal) / CAST(1000 AS DOUBLE) AS slope FROM customer""",
    "fx_dem": """SELECT CAST(floor(p_partkey / 50.0) AS BIGINT) AS row_, p_partkey % 50 AS col_, CASE WHEN p_size <> 50 THEN p_size + p_retailprice / CAST(100 AS DOUBLE) END AS value FROM part""",
    "fx_rain": "SELECT 1 AS rain_gage, CAST(date_trunc('hour', ts) AS TIMESTAMP) AS date_, sum(value) AS value FROM events WHERE event_type = 'view' GROUP BY 2",
    "fx_results": "SELECT 'J' || (user_id % 20) AS name, event_type AS attr, ts, value FROM events",
}
