"""Geometry derived from the star-schema tables by exact binary fractions, in Spark and as SQL text for the oracle.

The tables hold no coordinates. Keys give them: all ordinates are multiples of 1/64 (or 1/128), so both engines agree to the bit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import model


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _by_nation(n: Column, values: tuple[int, int, int]) -> Column:
    return F.when(n % 3 == 0, values[0]).when(n % 3 == 1, values[1]).otherwise(values[2])


def _nation_point(k: Column, n: Column, a: int, b: int) -> tuple[Column, Column]:
    s, h = _by_nation(n, (16, 96, 352)), _by_nation(n, (12, 64, 160))
    lon = F.lit(-176) + (n * 5) % (F.lit(353) - s) + ((k * a) % (s * 64)) / 64
    lat = F.lit(-80) + (n * 3) % (F.lit(161) - h) + ((k * b) % (h * 64)) / 64
    return lon, lat


def _world_point(k: Column) -> tuple[Column, Column]:
    return ((k * 37) % 23040) / 64 - 180, ((k * 53) % 10880) / 64 - 85


def customer_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """k, n, lon, lat"""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.col("c_nationkey").cast("long").alias("n"))
    lon, lat = _nation_point(F.col("k"), F.col("n"), 37, 53)
    return c.select("k", "n", lon.alias("lon"), lat.alias("lat"))


def supplier_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_nationkey").cast("long").alias("n"))
    lon, lat = _nation_point(F.col("k"), F.col("n"), 101, 211)
    return c.select("k", "n", lon.alias("lon"), lat.alias("lat"))


def nations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """n, n_name, r_name"""
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("n"), "n_name", F.col("n_regionkey").alias("r"))
    r = table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("r"), "r_name")
    return n.join(r, "r").select("n", "n_name", "r_name")


def square(x: Column, y: Column, side: Column) -> Column:
    """A closed counter-clockwise ring."""
    return F.array(*[model.position(a, b) for a, b in ((x, y), (x + side, y), (x + side, y + side), (x, y + side), (x, y))])


def part_squares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """k, brand, x, y, side, hole, rings, geom: odd keys wind clockwise, every fifth size has a hole of half the side."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), F.col("p_brand").alias("brand"), (F.col("p_size") / 64).alias("side"), (F.col("p_size") % 5 == 0).alias("hole"))
    x, y = _world_point(F.col("k"))
    s = F.col("side")
    odd = F.col("k") % 2 == 1
    turn = lambda r: F.when(odd, F.reverse(r)).otherwise(r)
    outer, inner = turn(square(F.col("x"), F.col("y"), s)), turn(square(F.col("x") + s / 4, F.col("y") + s / 4, s / 2))
    placed = p.withColumns({"x": x, "y": y}).withColumn("rings", F.when(F.col("hole"), F.array(outer, inner)).otherwise(F.array(outer)))
    return placed.withColumn("geom", model.polygon(F.col("rings")))


def event_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id, ts, user_id, lon, lat, z (the value, on even ids)"""
    e = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", F.when(F.col("event_id") % 2 == 0, F.col("value")).alias("z"))
    lon, lat = _world_point(F.col("event_id"))
    return e.withColumns({"lon": lon, "lat": lat})


def user_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """user_id, path, geom"""
    e = event_points(spark, sf_dir)
    ordered = F.array_sort(F.collect_list(F.struct("ts", "event_id", "lon", "lat")))
    path = F.transform(ordered, lambda p: model.position(p["lon"], p["lat"]))
    return e.groupBy("user_id").agg(path.alias("path")).withColumn("geom", model.line(F.col("path")))


def nation_multipoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """n, geom"""
    c = customer_points(spark, sf_dir)
    ordered = F.array_sort(F.collect_list(F.struct("k", "lon", "lat")))
    return c.groupBy("n").agg(F.transform(ordered, lambda p: model.position(p["lon"], p["lat"])).alias("path")).withColumn("geom", model.multi_point(F.col("path")))


# The same sets as SQL: each is a CTE.


def _nation_sql(a: int, b: int) -> str:
    s = "CASE n % 3 WHEN 0 THEN 16 WHEN 1 THEN 96 ELSE 352 END"
    h = "CASE n % 3 WHEN 0 THEN 12 WHEN 1 THEN 64 ELSE 160 END"
    return f"-176 + (n * 5) % (353 - {s}) + ((k * {a}) % (({s}) * 64)) / 64 AS lon, -80 + (n * 3) % (161 - {h}) + ((k * {b}) % (({h}) * 64)) / 64 AS lat"


_WORLD_SQL = "(({k} * 37) % 23040) / 64 - 180 AS {x}, (({k} * 53) % 10880) / 64 - 85 AS {y}"
CUST = f"cust AS (SELECT k, n, {_nation_sql(37, 53)} FROM (SELECT c_custkey AS k, CAST(c_nationkey AS BIGINT) AS n FROM customer))"
SUPP = f"supp AS (SELECT k, n, {_nation_sql(101, 211)} FROM (SELECT s_suppkey AS k, CAST(s_nationkey AS BIGINT) AS n FROM supplier))"
NAT = "nat AS (SELECT CAST(n_nationkey AS BIGINT) AS n, n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey)"
SQUARES = "sq AS (SELECT p_partkey AS k, p_brand AS brand, p_size / 64 AS side, p_size % 5 = 0 AS hole, p_partkey % 2 = 1 AS odd, " + _WORLD_SQL.format(k="p_partkey", x="x", y="y") + " FROM part)"
EVENTS = "ev AS (SELECT event_id, ts, user_id, CASE WHEN event_id % 2 = 0 THEN value END AS z, " + _WORLD_SQL.format(k="event_id", x="lon", y="lat") + " FROM events)"


def num(x: str) -> str:
    """SQL: the text of a double of moderate size."""
    return f"regexp_replace(CAST({x} AS VARCHAR), '\\.0$', '')"


def ring_sql(x: str, y: str, side: str, reverse: str = "odd") -> str:
    """SQL: the text of a square's positions, without brackets."""
    corners = [(x, y), (f"{x} + {side}", y), (f"{x} + {side}", f"{y} + {side}"), (x, f"{y} + {side}"), (x, y)]
    one = lambda cs: " || ', ' || ".join(f"{num(a)} || ' ' || {num(b)}" for a, b in cs)
    return f"CASE WHEN {reverse} THEN {one(corners[::-1])} ELSE {one(corners)} END"


POLYGON_SQL = f"'POLYGON ((' || {ring_sql('x', 'y', 'side')} || CASE WHEN hole THEN '), (' || {ring_sql('x + side / 4', 'y + side / 4', 'side / 2')} ELSE '' END || '))'"
