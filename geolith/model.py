"""The data model: positions, geometries and features as nested columns.

A geometry is ``struct<type, members>``. Members are its non-collection parts with their place in the tree of collections (``path``,
empty unless the geometry is a collection); a collection that holds nothing is a member of its own. ``parts`` nests part, ring, position:
one part for points, lines and polygons, one per member of a Multi type; an empty geometry has no parts.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

POSITION = "struct<x:double,y:double,z:double,m:double>"
PARTS = f"array<array<array<{POSITION}>>>"
MEMBER = f"struct<path:array<int>,type:string,parts:{PARTS}>"
GEOMETRY = f"struct<type:string,members:array<{MEMBER}>>"
SCALAR = "struct<t:string,s:string>"
PROPERTIES = f"array<struct<key:string,value:{SCALAR}>>"
ENVELOPE = "struct<minx:double,miny:double,maxx:double,maxy:double>"
#: A row per feature. (layer_ord, seq) is the order of a depth-first walk; props keep their order; t is null, string, long, double, bool or json.
FEATURE = f"source_file string, layer_path array<string>, layer_ord array<int>, seq bigint, id {SCALAR}, props {PROPERTIES}, geom {GEOMETRY}"
#: A row per layer, the root included ([]): layers may be empty, and carry properties.
LAYER = f"source_file string, layer_ord array<int>, name string, props {PROPERTIES}"

TYPES = ("Point", "LineString", "Polygon", "MultiPoint", "MultiLineString", "MultiPolygon", "GeometryCollection")


_PLAIN = {"string": T.StringType, "double": T.DoubleType, "int": T.IntegerType, "bigint": T.LongType, "long": T.LongType, "binary": T.BinaryType, "boolean": T.BooleanType}


def _split(text: str) -> list[str]:
    """Parts between the commas outside of brackets."""
    parts, depth, start = [], 0, 0
    for i, c in enumerate(text):
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            parts.append(text[start:i])
            start = i + 1
    return [p.strip() for p in [*parts, text[start:]]]


def data_type(text: str) -> T.DataType:
    """The type that a DDL string names. Needs no session, so tasks can call it."""
    kind, _, inner = text.strip().partition("<")
    if kind == "array":
        return T.ArrayType(data_type(inner[:-1]))
    if kind == "struct":
        return T.StructType([T.StructField(n.strip(), data_type(t)) for n, _, t in (f.partition(":") for f in _split(inner[:-1]))])
    return _PLAIN[kind.lower()]()


def schema(ddl: str) -> T.StructType:
    return T.StructType([T.StructField(n, data_type(t)) for n, _, t in (f.partition(" ") for f in _split(ddl))])


def _double(c: Column | float | None) -> Column:
    return (c if isinstance(c, Column) else F.lit(c)).cast("double")


def position(x, y, z=None, m=None) -> Column:
    return F.struct(_double(x).alias("x"), _double(y).alias("y"), _double(z).alias("z"), _double(m).alias("m"))


def geometry(kind: str, parts: Column) -> Column:
    member = F.struct(F.array().cast("array<int>").alias("path"), F.lit(kind).alias("type"), parts.cast(PARTS).alias("parts"))
    return F.struct(F.lit(kind).alias("type"), F.array(member).alias("members"))


def point(p: Column) -> Column:
    return geometry("Point", F.when(F.isnan(p["x"]) & F.isnan(p["y"]), F.array().cast(PARTS)).otherwise(F.array(F.array(F.array(p)))))


def line(positions: Column) -> Column:
    return geometry("LineString", F.when(F.size(positions) > 0, F.array(F.array(positions))).otherwise(F.array().cast(PARTS)))


def polygon(rings: Column) -> Column:
    return geometry("Polygon", F.when(F.size(rings) > 0, F.array(rings)).otherwise(F.array().cast(PARTS)))


def multi_point(positions: Column) -> Column:
    return geometry("MultiPoint", F.transform(positions, lambda p: F.array(F.array(p))))


def multi_line(lines: Column) -> Column:
    return geometry("MultiLineString", F.transform(lines, lambda p: F.array(p)))


def multi_polygon(polygons: Column) -> Column:
    return geometry("MultiPolygon", polygons)


def scalar(kind: str, text: Column) -> Column:
    return F.struct(F.lit(kind).alias("t"), text.cast("string").alias("s"))
