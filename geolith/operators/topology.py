"""TopoJSON as relations: arcs decoded by a running sum, stitched by an index join, numbered on writing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import let
from .order import numbered


def decode_arc(deltas: Column, scale: tuple[float, float], translate: tuple[float, float]) -> Column:
    """Positions of a quantised arc: truncated deltas, summed up, scaled and moved. One fold within the row."""

    def step(acc: Column, d: Column) -> Column:
        x, y = acc["x"] + d[0].cast("long"), acc["y"] + d[1].cast("long")
        at = F.struct((x * scale[0] + translate[0]).alias("x"), (y * scale[1] + translate[1]).alias("y"))
        return F.struct(x.alias("x"), y.alias("y"), F.concat(acc["out"], F.array(at)).alias("out"))

    start = F.struct(F.lit(0).cast("long").alias("x"), F.lit(0).cast("long").alias("y"), F.array().cast("array<struct<x:double,y:double>>").alias("out"))
    return F.aggregate(deltas, start, step, lambda acc: acc["out"])


def decode_arcs(points: DataFrame, scale: tuple[float, float], translate: tuple[float, float]) -> DataFrame:
    """points: arc, i, dx, dy -> arc, i, x, y, by a window: for arcs too long for a row."""
    w = Window.partitionBy("arc").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    total = lambda c: F.sum(F.col(c).cast("long")).over(w)
    return points.select("arc", "i", (total("dx") * scale[0] + translate[0]).alias("x"), (total("dy") * scale[1] + translate[1]).alias("y"))


def stitch(uses: DataFrame, arcs: DataFrame) -> DataFrame:
    """uses: line, indexes; arcs: arc, path -> line, path. ~i is arc i backwards; all arcs but the first lose their first position."""
    each = uses.select("line", F.posexplode("indexes").alias("pos", "index")).withColumn("arc", F.when(F.col("index") < 0, -F.col("index") - 1).otherwise(F.col("index")))
    path = let(F.when(F.col("index") < 0, F.reverse("path")).otherwise(F.col("path")), lambda p: F.when(F.col("pos") > 0, F.slice(p, 2, F.greatest(F.size(p) - 1, F.lit(0)))).otherwise(p))
    joined = each.join(arcs, "arc").select("line", "pos", path.alias("path"))
    ordered = F.array_sort(F.collect_list(F.struct("pos", "path")))
    return joined.groupBy("line").agg(F.flatten(F.transform(ordered, lambda p: p["path"])).alias("path"))


def number_arcs(df: DataFrame) -> DataFrame:
    """Features (layer_ord, seq, geom) -> a row per line or ring with its arc number, from 0 in writing order."""
    flat = df.select("layer_ord", "seq", F.posexplode(F.flatten(F.transform("geom.members", lambda m: F.transform(m["parts"], lambda p: F.transform(p, lambda r: F.struct(m["type"].alias("type"), r.alias("ring")))))) ).alias("part", "rings"))
    rings = flat.select("layer_ord", "seq", "part", F.posexplode("rings").alias("ring", "r")).where(~F.col("r.type").endswith("Point"))
    placed = numbered(rings, ["layer_ord", "seq", "part", "ring"], "arc")
    return placed.select("layer_ord", "seq", "part", "ring", "arc", F.col("r.ring").alias("path"))
