"""Geometry of every kind through each document format: polygons with holes, tracks, multipoints, points with elevation, and features without geometry."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ... import model
from ...functions import geometry as G
from ...functions import text as X
from ...model import PROPERTIES, scalar
from ...session import scratch
from ...sources.files import read_files, write_files
from .. import fixtures as fx
from ..catalogue import query


def _rows(df: DataFrame, kind: int, key: Column, name: Column, geom: Column) -> DataFrame:
    props = F.array(F.struct(F.lit("name").alias("key"), scalar("string", name).alias("value"))).cast(PROPERTIES)
    seq = F.lit(kind) * F.lit(1 << 40).cast("long") + key
    return df.select(F.array().cast("array<string>").alias("layer_path"), F.array().cast("array<int>").alias("layer_ord"), seq.alias("seq"), props.alias("props"), geom.alias("geom"))


def squares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rows(fx.part_squares(spark, sf_dir), 0, F.col("k"), F.concat(F.lit("part "), F.col("k")), F.col("geom"))


def tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rows(fx.user_tracks(spark, sf_dir), 1, F.col("user_id"), F.concat(F.lit("user "), F.col("user_id")), F.col("geom"))


def sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = fx.nation_multipoints(spark, sf_dir).join(fx.nations(spark, sf_dir), "n")
    return _rows(named, 2, F.col("n"), F.concat(F.lit("sites of "), F.col("n_name")), F.col("geom"))


def summits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as points, with an elevation of a sixteenth of the key."""
    at = model.point(model.position(F.col("lon"), F.col("lat"), F.col("k") / 16))
    return _rows(fx.supplier_points(spark, sf_dir), 3, F.col("k"), F.concat(F.lit("supplier "), F.col("k")), at)


def blanks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions, which have no geometry."""
    r = fx.table(spark, sf_dir, "region")
    return _rows(r, 4, F.col("r_regionkey"), F.concat(F.lit("région "), F.col("r_name")), F.lit(None).cast(model.GEOMETRY))


_RING = f"'POLYGON ((' || {fx.ring_sql('x', 'y', 'side', 'false')} || CASE WHEN hole THEN '), (' || {fx.ring_sql('x + side / 4', 'y + side / 4', 'side / 2', 'true')} ELSE '' END || '))'"
_AT = f"{fx.num('lon')} || ' ' || {fx.num('lat')}"
#: Each set with the CTEs it needs and its rows in SQL; {z} and {up} are an elevation's tag and text.
SETS = {
    squares: ((fx.SQUARES,), f"SELECT 'part ' || k AS name, {_RING} AS wkt FROM sq"),
    tracks: ((fx.EVENTS,), f"SELECT 'user ' || user_id, 'LINESTRING (' || string_agg({_AT}, ', ' ORDER BY ts, event_id) || ')' FROM ev GROUP BY user_id"),
    sites: ((fx.CUST, fx.NAT), f"SELECT 'sites of ' || n_name, 'MULTIPOINT (' || string_agg('(' || {_AT} || ')', ', ' ORDER BY k) || ')' FROM cust JOIN nat USING (n) GROUP BY n_name"),
    summits: ((fx.SUPP,), f"SELECT 'supplier ' || k, 'POINT{{z}} (' || {_AT} || {{up}} || ')' FROM supp"),
    blanks: ((), "SELECT 'région ' || r_name, CAST(NULL AS VARCHAR) FROM region"),
}


def _oracle(sets: tuple, z: bool) -> str:
    ctes = ", ".join(c for s in sets for c in SETS[s][0])
    rows = " UNION ALL ".join(f"({SETS[s][1]})" for s in sets)
    return f"WITH {ctes}, made(name, wkt) AS ({rows.format(z=' Z' if z else '', up=chr(39) + ' ' + chr(39) + ' || ' + fx.num('k / 16') if z else chr(39) * 2)}) SELECT name, wkt FROM made"


def _trip(fmt: str, ext: str, z: bool, sets: tuple):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        path = f"{scratch(spark, fmt)}/kinds{ext}"
        write_files(reduce(DataFrame.unionByName, [s(spark, sf_dir) for s in sets]), path, fmt)
        back = read_files(spark, path, fmt)
        name = F.get(F.filter("props", lambda p: p["key"] == "name"), F.lit(0))["value"]["s"]
        geom = F.col("geom")  # formats disagree on the winding of rings; it is made one here
        return back.select(name.alias("name"), F.when(geom.isNotNull(), X.wkt_format(G.orient_geometry(geom, exterior_clockwise=False))).alias("wkt"))

    run.__doc__ = f"{fmt}: {', '.join(s.__name__ for s in sets)} in one document, written and read back."
    query(_oracle(sets, z), name=f"kinds_{fmt}")(run)


_ALL = (squares, tracks, sites, summits, blanks)
for _fmt, _ext, _z, _sets in (
    ("geojson", ".geojson", True, _ALL),
    ("topojson", ".topojson", False, _ALL),
    ("csv", ".csv", True, _ALL),
    ("kml", ".kml", True, _ALL),
    ("kmz", ".kmz", True, _ALL),
    ("flatgeobuf", ".fgb", False, _ALL),
    ("geoparquet", ".parquet", True, _ALL),
    ("gpx", ".gpx", True, (tracks, summits)),
    ("shapefile", ".shp", False, (squares, blanks)),
):
    _trip(_fmt, _ext, _z, _sets)
