"""Queries over schema inference, scalars, layers and formats."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ... import formats, progress
from ...functions import geometry as G
from ...functions import text as X
from ...model import PROPERTIES, scalar
from ...operators import layers as L
from ...operators import schema as S
from ...operators.order import numbered
from .. import fixtures as fx
from ..catalogue import query

_LITERALS = ["42", "-7", "+5", "1.5", "1e3", "1d", "true", "FALSE", "abc", "", " 12 ", "0.00001", "-0.5", "1e21", "9223372036854775808", "TRUE ", "0x1F", ".5", "5."]


def _prop(key: str, value: Column) -> Column:
    return F.struct(F.lit(key).alias("key"), value.alias("value"))


def _double(c: Column) -> Column:
    return F.struct(F.lit("double").alias("t"), X.fmt_double(c).alias("s"))


def _null() -> Column:
    return F.struct(F.lit("null").alias("t"), F.lit(None).cast("string").alias("s"))


def customer_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feature rows whose properties differ by row: keys, types and nulls."""
    c = fx.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), "c_name", "c_acctbal", "c_mktsegment")
    k = F.col("k")
    props = F.array_compact(
        F.array(
            _prop("name", scalar("string", F.col("c_name"))),
            F.when(k % 3 == 0, _prop("balance", F.when(k % 2 == 0, scalar("long", k)).otherwise(_double(F.col("c_acctbal"))))),
            F.when(k % 5 == 0, _prop("segment", scalar("string", F.col("c_mktsegment")))),
            _prop("flag", F.when(k == 0, _null()).otherwise(scalar("bool", F.when(k % 2 == 0, "true").otherwise("false")))),
            F.when(k % 7 == 0, _prop("vip", scalar("bool", F.lit("true")))),
            F.when(k % 11 == 0, _prop("code", F.when(k % 22 == 0, scalar("string", F.lit("x"))).otherwise(scalar("long", k)))),
        )
    ).cast(PROPERTIES)
    return c.select(F.array().cast("array<int>").alias("layer_ord"), k.alias("seq"), props.alias("props"))


@query("SELECT * FROM (VALUES ('name', 0), ('balance', 1), ('segment', 2), ('flag', 3), ('vip', 4), ('code', 5)) AS t(key, ord)")
def csv_key_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.key_union(customer_features(spark, sf_dir))


@query(
    """WITH v AS (SELECT 'name' AS key, 0 AS ord, 'string' AS kind UNION ALL SELECT 'flag', 3, 'string' UNION ALL SELECT 'balance', 1, CASE WHEN bool_or(c_custkey % 6 = 3) AND bool_or(c_custkey % 6 = 0) THEN 'double' END FROM customer
    UNION ALL SELECT 'segment', 2, 'string' UNION ALL SELECT 'vip', 4, 'bool' UNION ALL SELECT 'code', 5, 'string') SELECT * FROM v"""
)
def widen_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.widened(customer_features(spark, sf_dir))


@query(
    f"""WITH b AS (SELECT CASE WHEN c_custkey % 2 = 0 THEN CAST(c_custkey AS VARCHAR) ELSE {fx.num("c_acctbal")} END AS s FROM customer WHERE c_custkey % 3 = 0),
    p AS (SELECT max(length(s)) AS n, max(CASE WHEN contains(s, '.') THEN length(split_part(s, '.', 2)) ELSE 0 END) AS d FROM b)
    SELECT 'name' AS key, 0 AS ord, 'C' AS kind, CAST(max(length(c_name)) AS INTEGER) AS length, 0 AS decimals FROM customer
    UNION ALL SELECT 'flag', 3, 'L', 1, 0 UNION ALL SELECT 'balance', 1, 'N', CAST(greatest(d + 2, least(n, 19)) AS INTEGER), CAST(d AS INTEGER) FROM p
    UNION ALL SELECT 'segment', 2, 'C', CAST(max(length(c_mktsegment)) AS INTEGER), 0 FROM customer WHERE c_custkey % 5 = 0 UNION ALL SELECT 'vip', 4, 'L', 1, 0
    UNION ALL SELECT 'code', 5, 'C', CAST(max(length(CASE WHEN c_custkey % 22 = 0 THEN 'x' ELSE CAST(c_custkey AS VARCHAR) END)) AS INTEGER), 0 FROM customer WHERE c_custkey % 11 = 0"""
)
def dbf_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.dbf_fields(customer_features(spark, sf_dir))


_LONG_NAMES = """c AS (SELECT DISTINCT 'c_' || lower(c_mktsegment) || '_' || (c_nationkey % 3) AS key FROM customer), f AS (SELECT key, lower(left(key, 10)) AS short, row_number() OVER (ORDER BY key) AS i FROM c)"""


@query(
    f"""WITH {_LONG_NAMES}, n AS (SELECT key, left(key, 10) AS base, row_number() OVER (PARTITION BY short ORDER BY i) - 1 AS n FROM f)
    SELECT key, CASE WHEN n = 0 THEN base ELSE left(base, 10 - length('_' || n)) || '_' || n END AS field FROM n"""
)
def dbf_unique_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Field names of ten characters for the market segments, three of each."""
    c = fx.table(spark, sf_dir, "customer").select(F.concat(F.lit("c_"), F.lower("c_mktsegment"), F.lit("_"), (F.col("c_nationkey") % 3).cast("string")).alias("key"))
    keys = [r["key"] for r in c.distinct().orderBy("key").collect()]  # columns of a table, not rows
    return spark.createDataFrame(list(zip(keys, S.dbf_names(keys), strict=True)), "key string, field string")


_INT = r"'^[ \t\n\x0b\x0c\r]*[+-]?[0-9]+[ \t\n\x0b\x0c\r]*$'"
_NUM = r"'^[ \t\n\x0b\x0c\r]*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?[ \t\n\x0b\x0c\r]*$'"


@query(
    "WITH v(text) AS (VALUES " + ", ".join(f"('{x}')" for x in _LITERALS) + f"""), u AS (SELECT text FROM v UNION ALL SELECT DISTINCT event_type FROM events UNION ALL SELECT DISTINCT source FROM documents),
    k AS (SELECT text, CASE WHEN regexp_full_match(text, {_INT}) AND try_cast(trim(text) AS BIGINT) IS NOT NULL THEN 'long' WHEN regexp_full_match(text, {_NUM}) THEN 'double' WHEN lower(text) IN ('true', 'false') THEN 'bool' ELSE 'string' END AS kind FROM u)
    SELECT text, kind, CASE kind WHEN 'long' THEN CAST(CAST(trim(text) AS BIGINT) AS VARCHAR) WHEN 'bool' THEN lower(text) WHEN 'string' THEN text
      ELSE CASE text WHEN '1.5' THEN '1.5' WHEN '1e3' THEN '1000' WHEN '0.00001' THEN '1E-05' WHEN '-0.5' THEN '-0.5' WHEN '1e21' THEN '1E+21' WHEN '.5' THEN '0.5' WHEN '5.' THEN '5' WHEN '9223372036854775808' THEN '9.223372036854776E+18' END END AS value FROM k"""
)
def scalar_infer(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = spark.createDataFrame([(x,) for x in _LITERALS], "text string")
    v = v.union(fx.table(spark, sf_dir, "events").select("event_type").distinct()).union(fx.table(spark, sf_dir, "documents").select("source").distinct())
    s = v.select("text", X.scalar_infer(F.col("text")).alias("s"))
    return s.select("text", F.col("s.t").alias("kind"), F.col("s.s").alias("value"))


@query(f"SELECT l_orderkey, l_linenumber, {fx.num('l_extendedprice')} AS price, {fx.num('l_discount')} AS discount FROM lineitem")
def scalar_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Doubles of every line item as round-trip text."""
    li = fx.table(spark, sf_dir, "lineitem")
    return li.select("l_orderkey", "l_linenumber", X.fmt_double(F.col("l_extendedprice")).alias("price"), X.fmt_double(F.col("l_discount")).alias("discount"))


_PATHS = ["a.geojson", "b.JSON", "c.topojson", "dir/d.SHP", "e.fgb", "f.kml", "g.kmz", "h.gpx", "i.wkt", "j.wkb", "k.csv", "l.parquet", "m.geoparquet", "n.png", "o.txt"]


@query(
    "SELECT * FROM (VALUES ('a.geojson', 'geojson'), ('b.JSON', 'geojson'), ('c.topojson', 'topojson'), ('dir/d.SHP', 'shapefile'), ('e.fgb', 'flatgeobuf'), ('f.kml', 'kml'), ('g.kmz', 'kmz'), ('h.gpx', 'gpx'), ('i.wkt', 'wkt'), ('j.wkb', 'wkb'), ('k.csv', 'csv'), ('l.parquet', 'geoparquet'), ('m.geoparquet', 'geoparquet'), ('n.png', 'png'), ('o.txt', NULL)) AS t(path, format)"
)
def format_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Formats by extension, as a join with the catalogue."""
    known = formats.catalogue(spark).select(F.col("name").alias("format"), F.explode("extensions").alias("ext"))
    paths = spark.createDataFrame([(p,) for p in _PATHS], "path string").withColumn("ext", F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1)))
    return paths.join(F.broadcast(known), "ext", "left").select("path", "format")


@query(
    """WITH c AS (SELECT c_custkey AS k, CAST(c_nationkey AS BIGINT) AS n, n_regionkey AS r FROM customer JOIN nation ON c_nationkey = n_nationkey),
    o AS (SELECT *, CASE WHEN k % 10 = 0 THEN -1 ELSE r END AS a, CASE WHEN k % 10 = 0 OR k % 3 = 0 THEN -1 ELSE n END AS b FROM c) SELECT k, n, r, CAST(row_number() OVER (ORDER BY a, b, k) AS INTEGER) AS place FROM o"""
)
def layer_flatten_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Root features, then each region's own, then its nations': the order of a depth-first walk over layer_ord."""
    c = fx.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.col("c_nationkey").cast("long").alias("n"))
    n = fx.table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("n"), F.col("n_regionkey").alias("r"))
    k, r = F.col("k"), F.col("r").cast("int")
    order = F.when(k % 10 == 0, F.array().cast("array<int>")).when(k % 3 == 0, F.array(r)).otherwise(F.array(r, F.col("n").cast("int")))
    rows = c.join(F.broadcast(n), "n").select("k", "n", "r", order.alias("layer_ord"), k.alias("seq"))
    return numbered(rows, ["layer_ord", "seq"], "place", start=1).select("k", "n", "r", F.col("place").cast("int").alias("place"))


@query(f"WITH {fx.CUST}, {fx.SUPP}, u AS (SELECT 0 AS rank, k FROM supp UNION ALL SELECT 1, k FROM cust) SELECT rank, k, CAST(row_number() OVER (ORDER BY rank, k) AS INTEGER) AS paint FROM u")
def stack_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = L.stacked([fx.supplier_points(spark, sf_dir), fx.customer_points(spark, sf_dir)])
    return numbered(s.select("rank", "k"), ["rank", "k"], "paint", start=1).withColumn("paint", F.col("paint").cast("int"))


@query(
    """WITH e AS (SELECT event_id, CASE event_id % 5 WHEN 0 THEN NULL WHEN 1 THEN 'tracks' WHEN 2 THEN 'waypoints' WHEN 3 THEN 'routes' ELSE 'other' END AS layer FROM events)
    SELECT event_id, layer, CAST(CASE WHEN layer IS NULL THEN 0 WHEN layer = 'waypoints' THEN 1 WHEN layer = 'routes' THEN 2 WHEN layer = 'tracks' THEN 3 ELSE 4 END AS INTEGER) AS rank FROM e"""
)
def gpx_category_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id") % 5
    e = fx.table(spark, sf_dir, "events").select("event_id", F.when(i == 1, "tracks").when(i == 2, "waypoints").when(i == 3, "routes").when(i == 4, "other").alias("layer"))
    return e.select("event_id", "layer", L.category_rank(F.col("layer"), F.lit(True)).alias("rank"))


@query("SELECT o_orderkey, round(CASE WHEN o_custkey % 3 > 0 THEN least(1.0::DOUBLE, greatest(0.0::DOUBLE, o_orderkey / (o_custkey * (o_custkey % 3)))) WHEN o_custkey % 2 > 0 THEN least(1.0::DOUBLE, greatest(0.0::DOUBLE, o_totalprice / 65536)) END, 6) AS fraction FROM orders")
def progress_fraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features first, then bytes, within 0 and 1, else null."""
    o = fx.table(spark, sf_dir, "orders")
    c = F.col("o_custkey")
    f = progress.fraction(F.col("o_orderkey"), c * (c % 3), F.col("o_totalprice"), F.when(c % 2 > 0, 65536).otherwise(0))
    return o.select("o_orderkey", F.round(f, 6).alias("fraction"))


@query(
    f"""WITH {fx.SQUARES}, {fx.CUST}, a AS (SELECT 'part ' || k AS label, side * side AS priority FROM sq UNION ALL SELECT 'customer ' || k, 0.0 FROM cust)
    SELECT label, CAST(row_number() OVER (ORDER BY priority DESC, label) AS INTEGER) AS place FROM a"""
)
def label_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The order in which labels are tried: larger features first, ties by text."""
    from ... import model

    p = fx.part_squares(spark, sf_dir).select(F.concat(F.lit("part "), F.col("k").cast("string")).alias("label"), "geom", "k")
    c = fx.customer_points(spark, sf_dir).select(F.concat(F.lit("customer "), F.col("k").cast("string")).alias("label"), model.point(model.position(F.col("lon"), F.col("lat"))).alias("geom"), "k")
    both = p.unionByName(c).select("label", F.round(G.label_priority(F.col("geom")), 9).alias("priority"))
    return numbered(both, [F.desc("priority"), "label"], "place", start=1).select("label", F.col("place").cast("int").alias("place"))


@query("SELECT 'Unknown' AS kind, 'MultiPoint,Polygon' AS types")
def common_geometry_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = fx.part_squares(spark, sf_dir).select("geom").unionByName(fx.nation_multipoints(spark, sf_dir).select("geom"))
    return S.common_type(both).select("kind", F.array_join("types", ",").alias("types"))


@query("SELECT CAST(c_custkey AS BIGINT) AS seq, c_name AS name, CASE WHEN c_custkey % 3 = 0 THEN CASE WHEN c_custkey % 2 = 0 THEN CAST(c_custkey AS DOUBLE) ELSE c_acctbal END END AS balance, CASE WHEN c_custkey % 7 = 0 THEN 'true' END AS vip FROM customer")
def wide_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed columns projected from tagged properties."""
    c = customer_features(spark, sf_dir).withColumns({"layer_path": F.array().cast("array<string>"), "geom": F.lit(None).cast("string")})
    return S.wide(c, [("name", "string"), ("balance", "double"), ("vip", "bool")]).select("seq", "name", "balance", F.col("vip").cast("string").alias("vip"))
