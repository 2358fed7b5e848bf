"""Parsing and writing of geometries inside DataFrames: Arrow UDFs, a batch at a time."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .. import model
from ..codecs import columnar, geojson, wkb, wkt

GEOMETRY = model.schema(f"g {model.GEOMETRY}").fields[0].dataType
_ARROW = to_arrow_type(GEOMETRY)


def _column(geoms: list) -> pa.Array:
    return columnar.column(geoms).cast(_ARROW)


@F.arrow_udf(GEOMETRY)
def st_geomfromtext(text: pa.Array) -> pa.Array:
    return _column([None if t is None else wkt.parse(t) for t in text.to_pylist()])


@F.arrow_udf(GEOMETRY)
def st_geomfromwkb(data: pa.Array) -> pa.Array:
    return _column([None if d is None else wkb.parse(d) for d in data.to_pylist()])


@F.arrow_udf(GEOMETRY)
def st_geomfromgeojson(text: pa.Array) -> pa.Array:
    return _column([None if t is None else geojson.parse(geojson.load(t.encode())) for t in text.to_pylist()])


@F.arrow_udf(T.StringType())
def st_astext(geom: pa.Array) -> pa.Array:
    return pa.array([None if g is None else wkt.dump(g) for g in columnar.geometries(geom)], pa.string())


@F.arrow_udf(T.BinaryType())
def st_asbinary(geom: pa.Array) -> pa.Array:
    return pa.array([None if g is None else wkb.dump(g) for g in columnar.geometries(geom)], pa.binary())


@F.arrow_udf(T.StringType())
def st_asgeojson(geom: pa.Array) -> pa.Array:
    import json

    return pa.array([None if g is None else json.dumps(geojson.dump(g), separators=(",", ":")) for g in columnar.geometries(geom)], pa.string())


def register(spark: SparkSession) -> None:
    """The st_ functions in SQL: parsers and writers as Arrow UDFs, measures as SQL functions that Catalyst puts in line."""
    for name in ("st_geomfromtext", "st_geomfromwkb", "st_geomfromgeojson", "st_astext", "st_asbinary", "st_asgeojson"):
        spark.udf.register(f"geo_{name}", globals()[name])
    positions = "flatten(transform(g.members, m -> flatten(flatten(m.parts))))"
    ring = "aggregate(zip_with(r, concat(slice(r, 2, greatest(size(r) - 1, 0)), slice(r, 1, 1)), (p, q) -> p.x * q.y - q.x * p.y), 0D, (a, v) -> a + v) / 2"
    geom, path = f"g {model.GEOMETRY}", f"r array<{model.POSITION}>"
    functions = {
        f"geo_st_geometrytype({geom}) RETURNS STRING": "g.type",
        f"geo_st_npoints({geom}) RETURNS INT": f"size({positions})",
        f"geo_st_isempty({geom}) RETURNS BOOLEAN": f"size({positions}) = 0",
        f"geo_st_hasz({geom}) RETURNS BOOLEAN": f"exists({positions}, p -> p.z IS NOT NULL)",
        f"geo_st_hasm({geom}) RETURNS BOOLEAN": f"exists({positions}, p -> p.m IS NOT NULL)",
        f"geo_st_xmin({geom}) RETURNS DOUBLE": f"array_min(transform({positions}, p -> p.x))",
        f"geo_st_ymin({geom}) RETURNS DOUBLE": f"array_min(transform({positions}, p -> p.y))",
        f"geo_st_xmax({geom}) RETURNS DOUBLE": f"array_max(transform({positions}, p -> p.x))",
        f"geo_st_ymax({geom}) RETURNS DOUBLE": f"array_max(transform({positions}, p -> p.y))",
        f"geo_st_ringarea({path}) RETURNS DOUBLE": f"CASE WHEN size(r) < 3 THEN 0D ELSE {ring} END",
        f"geo_st_exteriorring({geom}) RETURNS array<{model.POSITION}>": "get(get(get(g.members, 0).parts, 0), 0)",
    }
    for head, body in functions.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
