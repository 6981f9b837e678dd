"""Domain-shaped views of the given tables, in Spark and in SQL.

The tables have no coordinates, so both sides derive them from the keys by the
same integer arithmetic. The views always cover the whole table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

AS_OF = "2025-01-01"
SNAP_M = 500.0
POINT_M = 2000.0
LINE_M = 50.0


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _scatter(key: Column, lat_step: int, lon_step: int) -> tuple[Column, Column]:
    lat = F.lit(40.4) + (key * lat_step % 60000) / F.lit(100000.0)
    lon = F.lit(-74.3) + (key * lon_step % 70000) / F.lit(100000.0)
    return lat, lon


def crashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as crash records."""
    k = F.get_json_object("props", "$.k").cast("int")
    lat, lon = _scatter(F.col("event_id"), 104729, 15485863)
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("collision_id"),
        F.col("ts").alias("crash_date"),
        F.date_format("ts", "H:mm").alias("crash_time"),
        lat.alias("latitude"),
        lon.alias("longitude"),
        (k % 4).cast("double").alias("number_of_persons_injured"),
        (k % 25 == 0).cast("double").alias("number_of_persons_killed"),
        (k % 3).cast("double").alias("number_of_pedestrians_injured"),
        (k % 50 == 0).cast("double").alias("number_of_pedestrians_killed"),
        (k % 5 == 1).cast("double").alias("number_of_cyclist_injured"),
        (k % 50 == 25).cast("double").alias("number_of_cyclist_killed"),
        (k % 2).cast("double").alias("number_of_motorist_injured"),
        F.col("event_type").alias("contributing_factor_vehicle_1"),
        F.col("user_id"),
    )


CRASH_SQL = """
SELECT event_id AS collision_id, ts AS crash_date,
  40.4::double + (event_id * 104729 % 60000) / 100000.0::double AS latitude,
  -74.3::double + (event_id * 15485863 % 70000) / 100000.0::double AS longitude,
  (k % 4)::double AS number_of_persons_injured,
  (k % 25 = 0)::int::double AS number_of_persons_killed,
  (k % 3)::double AS number_of_pedestrians_injured,
  (k % 50 = 0)::int::double AS number_of_pedestrians_killed,
  (k % 5 = 1)::int::double AS number_of_cyclist_injured,
  (k % 50 = 25)::int::double AS number_of_cyclist_killed,
  (k % 2)::double AS number_of_motorist_injured,
  event_type AS contributing_factor_vehicle_1, user_id
FROM (SELECT *, json_extract_string(props, '$.k')::int AS k FROM events)
"""


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``part`` as street nodes."""
    lat, lon = _scatter(F.col("p_partkey"), 7919, 32452843)
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("NODEID"), lat.alias("latitude"), lon.alias("longitude")
    )


NODE_SQL = """
SELECT p_partkey AS nodeid,
  40.4::double + (p_partkey * 7919 % 60000) / 100000.0::double AS latitude,
  -74.3::double + (p_partkey * 32452843 % 70000) / 100000.0::double AS longitude
FROM part
"""


def street_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``part`` as street edges between a node and the one numbered like its size."""
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("NodeIDFrom"),
        F.col("p_size").cast("bigint").alias("NodeIDTo"),
        F.concat_ws(" ", "p_brand", "p_type").alias("Street"),
    )


EDGE_SQL = """
SELECT p_partkey AS node_from, p_size::bigint AS node_to, concat_ws(' ', p_brand, p_type) AS street
FROM part
"""


def point_layer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``supplier`` as a point layer."""
    lat, lon = _scatter(F.col("s_suppkey") + 5000, 7919, 32452843)
    return table(spark, sf_dir, "supplier").select(
        "s_suppkey", "s_nationkey", lat.alias("lat"), lon.alias("long")
    )


POINT_LAYER_SQL = """
SELECT s_suppkey, s_nationkey,
  40.4::double + ((s_suppkey + 5000) * 7919 % 60000) / 100000.0::double AS lat,
  -74.3::double + ((s_suppkey + 5000) * 32452843 % 70000) / 100000.0::double AS lon
FROM supplier
"""


def segment_layer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as a layer of short segments with a rating."""
    lat, lon = _scatter(F.col("event_id"), 104729, 15485863)
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("segment_id"),
        lat.alias("fromlatitude"),
        lon.alias("fromlongitude"),
        (lat + (F.col("event_id") % 7 - 3) * F.lit(0.001)).alias("tolatitude"),
        (lon + (F.col("event_id") % 5 - 2) * F.lit(0.001)).alias("tolongitude"),
        (F.col("value") / 10).alias("systemrating"),
    )


SEGMENT_LAYER_SQL = """
SELECT event_id AS segment_id, lat AS a_lat, lon AS a_lon,
  lat + (event_id % 7 - 3) * 0.001::double AS b_lat,
  lon + (event_id % 5 - 2) * 0.001::double AS b_lon,
  value / 10 AS systemrating
FROM (SELECT *,
  40.4::double + (event_id * 104729 % 60000) / 100000.0::double AS lat,
  -74.3::double + (event_id * 15485863 % 70000) / 100000.0::double AS lon
FROM events)
"""


def haversine_sql(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    return (
        f"2 * 6371008.8 * asin(sqrt(least(1.0::double, pow(sin(radians({lat2} - {lat1}) / 2), 2)"
        f" + cos(radians({lat1})) * cos(radians({lat2})) * pow(sin(radians({lon2} - {lon1}) / 2), 2))))"
    )


def segment_sql(lat: str, lon: str, s: str = "s") -> str:
    """Point-to-segment metres as nested SQL expressions."""
    per_lat = "(6371008.8::double * pi() / 180)"
    per_lon = f"(cos(radians({lat})) * {per_lat})"
    ax, ay = f"(({s}.a_lon - {lon}) * {per_lon})", f"(({s}.a_lat - {lat}) * {per_lat})"
    dx = f"(({s}.b_lon - {s}.a_lon) * {per_lon})"
    dy = f"(({s}.b_lat - {s}.a_lat) * {per_lat})"
    u = (
        f"least(greatest(coalesce(-({ax} * {dx} + {ay} * {dy})"
        f" / nullif({dx} * {dx} + {dy} * {dy}, 0), 0), 0), 1)"
    )
    return f"sqrt(pow({ax} + {u} * {dx}, 2) + pow({ay} + {u} * {dy}, 2))"


def multipoint_layer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``supplier`` as a layer of multipoints with three points each."""
    spots = [_scatter(F.col("s_suppkey") + shift, 7919, 32452843) for shift in (5000, 6000, 7000)]
    return table(spark, sf_dir, "supplier").select(
        "s_suppkey", F.array(*[F.array(lon, lat) for lat, lon in spots]).alias("coordinates")
    )


MULTIPOINT_LAYER_SQL = """
SELECT s_suppkey,
  40.4::double + ((s_suppkey + shift) * 7919 % 60000) / 100000.0::double AS lat,
  -74.3::double + ((s_suppkey + shift) * 32452843 % 70000) / 100000.0::double AS lon
FROM supplier CROSS JOIN (VALUES (5000), (6000), (7000)) AS shifts(shift)
"""

LINE_STEPS = [(0.0, 0.0), (0.01, 0.005), (0.015, -0.01), (0.03, 0.02)]


def line_layer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``supplier`` as streets: a polyline of three segments each."""
    lat, lon = _scatter(F.col("s_suppkey") + 5000, 7919, 32452843)
    vertices = [F.array(lon + F.lit(dx), lat + F.lit(dy)) for dy, dx in LINE_STEPS]
    return table(spark, sf_dir, "supplier").select(
        "s_suppkey",
        F.concat(F.lit("Street "), F.col("s_nationkey")).alias("stname_lab"),
        F.array(*vertices).alias("coordinates"),
    )


_LEGS = ", ".join(
    f"({ay}::double, {ax}::double, {by}::double, {bx}::double)"
    for (ay, ax), (by, bx) in zip(LINE_STEPS, LINE_STEPS[1:])
)
LINE_LAYER_SQL = f"""
SELECT s_suppkey, 'Street ' || s_nationkey AS stname_lab, lat + ay AS a_lat, lon + ax AS a_lon,
  lat + by_ AS b_lat, lon + bx AS b_lon
FROM ({POINT_LAYER_SQL}) CROSS JOIN (VALUES {_LEGS}) AS legs(ay, ax, by_, bx)
"""
