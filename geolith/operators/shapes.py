"""Shapefile records as relations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as G


def content_bytes(geom: Column) -> Column:
    """Bytes of a record's contents: 4 for a null shape, 20 for a point, 40 and 16 a position for multipoints, 44 with 4 a part for the others."""
    rings = F.flatten(F.transform(geom["members"], lambda m: F.flatten(m["parts"])))
    n, parts = G.vertex_count(geom), F.size(rings)
    kind = G.shape_category(geom)
    return F.when(geom.isNull() | G.is_empty(geom), 4).when(kind == 1, 20).when(kind == 8, 40 + 16 * n).otherwise(44 + 4 * parts + 16 * n)


def record_offsets(df: DataFrame) -> DataFrame:
    """seq, words, offset: where each record starts, in 16-bit words; a running sum from 50."""
    words = (content_bytes(F.col("geom")) / 2).cast("long")
    w = Window.partitionBy("source_file").orderBy("layer_ord", "seq").rowsBetween(Window.unboundedPreceding, -1)
    return df.select("source_file", "layer_ord", "seq", words.alias("words")).withColumn("offset", F.lit(50) + F.coalesce(F.sum(F.col("words") + 4).over(w), F.lit(0)))


def category_check(df: DataFrame) -> DataFrame:
    """shape_type, valid: a file holds one category; no geometry at all is type 1, collections are no category."""
    kinds = df.where("geom IS NOT NULL").agg(F.collect_set(G.shape_category(F.col("geom"))).alias("k"))
    return kinds.select(F.when(F.size("k") == 0, 1).when(F.size("k") == 1, F.col("k")[0]).otherwise(-1).alias("shape_type"), ((F.size("k") == 0) | ((F.size("k") == 1) & (F.col("k")[0] > 0))).alias("valid"))


def group_rings(rings: Column) -> Column:
    """Polygons of a record's rings, by a fold: a clockwise ring opens one; another is a hole if its box lies in the open one's exterior box, else opens one."""
    box = lambda r: G.envelope(*[f(F.transform(r, g)) for f, g in ((F.array_min, _x), (F.array_min, _y), (F.array_max, _x), (F.array_max, _y))])
    kind = "array<array<array<struct<x:double,y:double,z:double,m:double>>>>"

    def step(found: Column, ring: Column) -> Column:
        last = F.get(found, F.size(found) - 1)
        hole = (F.size(found) > 0) & ~G.is_clockwise(ring) & F.coalesce(G.bbox_contains(box(last[0]), box(ring)), F.lit(False))
        return F.when(hole, F.concat(F.slice(found, 1, F.size(found) - 1), F.array(F.concat(last, F.array(ring))))).otherwise(F.concat(found, F.array(F.array(ring))))

    return F.aggregate(rings, F.array().cast(kind), step)


def _x(p: Column) -> Column:
    return p["x"]


def _y(p: Column) -> Column:
    return p["y"]


def zip_rows(shapes: DataFrame, rows: DataFrame, compat_deleted_shift: bool = True) -> DataFrame:
    """shapes: file, i, ...; rows: file, i, deleted, props. The i-th shape meets the i-th row; shapes without a row keep no properties.

    With ``compat_deleted_shift``, rows flagged deleted are taken out before they are counted, so later rows move up.
    """
    if compat_deleted_shift:
        w = Window.partitionBy("file").orderBy("i")
        rows = rows.where(~F.col("deleted")).withColumn("i", F.row_number().over(w) - 1)
    else:
        rows = rows.withColumn("props", F.when(~F.col("deleted"), F.col("props")))
    return shapes.join(rows.drop("deleted"), ["file", "i"], "left")
