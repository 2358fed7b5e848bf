"""Joins by extent. Boxes are dealt to grid cells, so a join moves each box to the few cells it covers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import bbox_intersects


def _cells(e: Column, size: float) -> Column:
    span = lambda lo, hi: F.sequence(F.floor(lo / size).cast("long"), F.floor(hi / size).cast("long"))
    return F.flatten(F.transform(span(e["minx"], e["maxx"]), lambda i: F.transform(span(e["miny"], e["maxy"]), lambda j: F.struct(i.alias("i"), j.alias("j")))))


def bbox_join(left: DataFrame, right: DataFrame, left_box: str, right_box: str, cell: float = 1.0) -> DataFrame:
    """Pairs whose boxes (envelope columns) intersect, strictly; a box without extent is a point inside or not.

    A pair that meets in several cells counts in the cell that holds the lower left corner of its overlap. A crowded cell is split by
    Spark's skew join, as both sides are plain equi-join inputs.
    """
    a = left.where(F.col(left_box).isNotNull()).withColumn("_cell", F.explode(_cells(F.col(left_box), cell)))
    b = right.where(F.col(right_box).isNotNull()).withColumn("_cell2", F.explode(_cells(F.col(right_box), cell)))
    la, lb = F.col(left_box), F.col(right_box)
    home = (F.floor(F.greatest(la["minx"], lb["minx"]) / cell).cast("long") == F.col("_cell.i")) & (F.floor(F.greatest(la["miny"], lb["miny"]) / cell).cast("long") == F.col("_cell.j"))
    meet = (F.col("_cell.i") == F.col("_cell2.i")) & (F.col("_cell.j") == F.col("_cell2.j"))
    return a.join(b, meet).where(home & bbox_intersects(la, lb)).drop("_cell", "_cell2")


def bbox_filter(df: DataFrame, minx: float, miny: float, maxx: float, maxy: float) -> DataFrame:
    """Rows whose plain columns minx, miny, maxx, maxy meet the window. Plain conjuncts reach the Parquet scan as pushed filters."""
    return df.where((F.col("maxx") > minx) & (F.col("minx") < maxx) & (F.col("maxy") > miny) & (F.col("miny") < maxy))
