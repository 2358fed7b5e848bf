"""Layers: order, flattening, stacking, categories."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CATEGORIES = ("waypoints", "routes", "tracks")


def flattened(df: DataFrame) -> DataFrame:
    """Depth-first order: a layer's own features, then each child. Arrays compare element by element and a prefix comes first, which is that order."""
    return df.orderBy("layer_ord", "seq")


def nested(df: DataFrame, key: str, order: str) -> DataFrame:
    """Features as children named by a column, in the order of ``order`` (small: a row per layer)."""
    names = df.groupBy(key).agg(F.min(order).alias("_o"))
    ranked = names.selectExpr(f"`{key}` AS _k", "CAST(row_number() OVER (ORDER BY _o) - 1 AS INT) AS _i")
    return df.join(F.broadcast(ranked), F.col(key).eqNullSafe(F.col("_k"))).withColumns({"layer_path": F.array(F.col(key)), "layer_ord": F.array("_i")}).drop("_k", "_i")


def stacked(frames: list[DataFrame]) -> DataFrame:
    """Collections one over the other: ``rank`` comes before all else in paint order."""
    return reduce(DataFrame.unionByName, [f.withColumn("rank", F.lit(i)) for i, f in enumerate(frames)])


def category_rank(layer: Column, has_categories: Column) -> Column:
    """Place in a GPX file: root features, waypoints, routes, tracks, others; all alike where no layer is a category."""
    ranked = F.when(layer.isNull(), 0)
    for i, c in enumerate(CATEGORIES):
        ranked = ranked.when(layer == c, i + 1)
    return F.when(has_categories, ranked.otherwise(len(CATEGORIES) + 1)).otherwise(0)
