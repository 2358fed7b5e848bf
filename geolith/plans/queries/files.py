"""Queries that write files of each format and read them back, the renderer, and streams."""

from __future__ import annotations

import uuid
import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ... import model, streaming
from ...functions import text as X
from ...functions.udfs import register
from ...model import PROPERTIES, scalar
from ...session import scratch, ship
from ...sources.files import read_files, write_files
from ...sources.geoparquet import read_geoparquet, write_geoparquet
from .. import fixtures as fx
from ..catalogue import query
from ..render import Options, Style, render_png


def point_features(spark: SparkSession, sf_dir: str, named: bool = True) -> DataFrame:
    """Customers as feature rows with two properties, in layers by region where the format has layers."""
    c = fx.customer_points(spark, sf_dir).join(fx.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), "c_name"), "k")
    prop = lambda key, value: F.struct(F.lit(key).alias("key"), value.alias("value"))
    props = F.array(prop("name", scalar("string", F.col("c_name"))), prop("k", scalar("long", F.col("k")))).cast(PROPERTIES)
    return c.select(
        F.lit(None).cast("string").alias("source_file"), F.array().cast("array<string>").alias("layer_path"), F.array().cast("array<int>").alias("layer_ord"), F.col("k").alias("seq"), F.lit(None).cast(model.SCALAR).alias("id"), props.alias("props"), model.point(model.position(F.col("lon"), F.col("lat"))).alias("geom")
    )


def _value(key: str):
    return F.get(F.filter("props", lambda p: p["key"] == key), F.lit(0))["value"]["s"]


_POINT = f"'POINT (' || {fx.num('lon')} || ' ' || {fx.num('lat')} || ')'"
_NAMED = f"WITH {fx.CUST} SELECT c_name AS name, {{k}}{_POINT} AS wkt FROM cust JOIN customer ON c_custkey = k"


def _trip(fmt: str, ext: str, keyed: bool):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        path = f"{scratch(spark, fmt)}/points{ext}"
        write_files(point_features(spark, sf_dir), path, fmt)
        back = read_files(spark, path, fmt)
        k = [_value("k").cast("long").alias("k")] if keyed else []
        return back.select(_value("name").alias("name"), *k, X.wkt_format(F.col("geom")).alias("wkt"))

    run.__doc__ = f"{fmt}: written, and read back with its properties."
    query(_NAMED.format(k="k, " if keyed else ""), name=f"roundtrip_{fmt}")(run)


for _fmt, _ext, _keyed in (("geojson", ".geojson", True), ("topojson", ".topojson", True), ("csv", ".csv", True), ("kml", ".kml", True), ("kmz", ".kmz", True), ("gpx", ".gpx", False), ("flatgeobuf", ".fgb", True), ("geoparquet", ".parquet", True), ("shapefile", ".shp", True)):
    _trip(_fmt, _ext, _keyed)


def _bare(fmt: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        path = f"{scratch(spark, fmt)}/squares.{fmt}"
        s = fx.part_squares(spark, sf_dir).select(F.array().cast("array<string>").alias("layer_path"), F.array().cast("array<int>").alias("layer_ord"), F.col("k").alias("seq"), "geom")
        write_files(s, path, fmt)
        return read_files(spark, path, fmt).select("seq", X.wkt_format(F.col("geom")).alias("wkt"))

    run.__doc__ = f"{fmt}: geometry alone, in order."
    query(f"WITH {fx.SQUARES} SELECT row_number() OVER (ORDER BY k) - 1 AS seq, {fx.POLYGON_SQL} AS wkt FROM sq", name=f"roundtrip_{fmt}")(run)


for _fmt in ("wkt", "wkb"):
    _bare(_fmt)


@query(f"WITH {fx.CUST}, {fx.NAT} SELECT r_name, n_name, count(*) AS n FROM cust JOIN nat USING (n) GROUP BY 1, 2")
def kml_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Folders of folders: regions hold nations, and the tree survives."""
    path = f"{scratch(spark, 'kml')}/layers.kml"
    placed = fx.nations(spark, sf_dir).withColumn("place", F.expr("dense_rank() OVER (ORDER BY r_name) - 1"))  # a row per nation
    c = fx.customer_points(spark, sf_dir).join(placed, "n")
    order = F.array(F.col("place").cast("int"), F.col("n").cast("int"))
    rows = c.select(F.array("r_name", "n_name").alias("layer_path"), order.alias("layer_ord"), F.col("k").alias("seq"), model.point(model.position(F.col("lon"), F.col("lat"))).alias("geom"))
    write_files(rows, path, "kml")
    back = read_files(spark, path, "kml").select(F.col("layer_path")[0].alias("r_name"), F.col("layer_path")[1].alias("n_name"))
    return back.groupBy("r_name", "n_name").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {fx.SQUARES} SELECT brand, count(*) AS n, min(x) AS minx, max(x + side) AS maxx FROM sq WHERE x + side > 0 AND x < 90 AND y + side > -45 AND y < 45 GROUP BY 1")
def geoparquet_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A GeoParquet table with extent columns: the window reaches the scan as pushed filters, and geometry is never decoded."""
    from ...operators.spatial import bbox_filter

    path = f"{scratch(spark, 'geoparquet')}/parts"
    write_geoparquet(fx.part_squares(spark, sf_dir).select("k", "brand", "geom"), path)
    return bbox_filter(read_geoparquet(spark, path), 0, -45, 90, 45).groupBy("brand").agg(F.count(F.lit(1)).alias("n"), F.min("minx").alias("minx"), F.max("maxx").alias("maxx"))


@query(f"WITH {fx.SQUARES} SELECT k, 'Polygon' AS kind, CAST(CASE WHEN hole THEN 10 ELSE 5 END AS INTEGER) AS vertices, x AS minx, y AS miny, round(CASE WHEN odd THEN -side * side ELSE side * side END, 9) AS area FROM sq")
def sql_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The st_ functions called from SQL."""
    ship(spark)
    register(spark)
    fx.part_squares(spark, sf_dir).select("k", "geom").createOrReplaceTempView("geolith_parts")
    return spark.sql("SELECT k, geo_st_geometrytype(geom) AS kind, geo_st_npoints(geom) AS vertices, geo_st_xmin(geom) AS minx, geo_st_ymin(geom) AS miny, round(geo_st_ringarea(geo_st_exteriorring(geom)), 9) AS area FROM geolith_parts")


@query()
def render_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part squares and labelled nations on one map; a checksum and the ink of each row of the image."""
    from ..render import png

    squares = fx.part_squares(spark, sf_dir).select(F.lit(0).alias("rank"), F.array().cast("array<string>").alias("layer_path"), F.array().cast("array<int>").alias("layer_ord"), F.col("k").alias("seq"), F.array().cast(PROPERTIES).alias("props"), "geom")
    nations = fx.nation_multipoints(spark, sf_dir).join(fx.nations(spark, sf_dir), "n")
    label = F.array(F.struct(F.lit("name").alias("key"), scalar("string", F.col("n_name")).alias("value"))).cast(PROPERTIES)
    top = nations.select(F.lit(1).alias("rank"), F.array(F.lit("nations")).alias("layer_path"), F.array(F.lit(0)).alias("layer_ord"), F.col("n").alias("seq"), label.alias("props"), "geom")
    options = Options(max_dimension=512, projection="Goode", ocean=(215, 232, 245, 255), layers={"nations": Style(stroke=(180, 30, 30, 255), point_radius=1.5, label="name", label_size=9.0)})
    image = png.decode(render_png(squares.unionByName(top), options))
    rows = [(y, int(zlib.crc32(image[y].tobytes())), int((image[y] != np.array(options.background)).any(1).sum())) for y in range(len(image))]
    return spark.createDataFrame(rows, "y int, crc long, ink int")


@query("SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H') AS hour, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def stream_event_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a stream of files, counted per hour and type, run until it is used up."""
    path = f"{sf_dir}/events.parquet"
    schema = spark.read.parquet(path).schema
    events = spark.readStream.schema(schema).parquet(f"{sf_dir}/events*.parquet" if path.endswith(".parquet") else path)
    name, folder = f"geolith_stream_counts_{uuid.uuid4().hex}", scratch(spark, "stream")
    counts = streaming.windowed_counts(events.withColumn("ts", F.col("ts").cast("timestamp")), "ts", "event_type", "1 hour", "3650 days")
    q = counts.writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", folder).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name).select(F.date_format("start", "yyyy-MM-dd HH").alias("hour"), "event_type", "n")
