"""Global numbering without a global window: one distributed sort, offsets of its ranges, a place within each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut


def numbered(df: DataFrame, order: list[Column | str], name: str, start: int = 0) -> DataFrame:
    """df with its rows numbered from ``start`` in the order; ties in any order.

    The sorted rows are written to the checkpoint folder once, so that counts and rows agree on the ranges; the table of ranges has a row
    per sort partition.
    """
    rows = cut(df.orderBy(*order).withColumn("_at", F.monotonically_increasing_id()))
    counts = rows.groupBy(F.shiftright("_at", 33).alias("_run")).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_run", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    found = rows.withColumn("_run", F.shiftright("_at", 33)).join(F.broadcast(offsets), "_run")
    return found.withColumn(name, F.col("_start") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + start).drop("_run", "_at", "_start")
