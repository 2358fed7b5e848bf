"""Rasterisation as relations: the reference form of the renderer's numpy, for small canvases and for checks in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def fill_spans(edges: DataFrame, width: int, height: int) -> DataFrame:
    """edges: poly, x0, y0, x1, y1 in pixels -> poly, y, x0, x1: runs of pixels inside, even-odd at the middle of each row.

    Edges explode to the rows they cross, crossings are ordered per row, and odd ones pair with the next.
    """
    lo, hi = F.least("y0", "y1"), F.greatest("y0", "y1")
    first = F.greatest(F.lit(0), F.ceil(lo - 0.5)).cast("long")
    last = F.least(F.lit(height - 1), F.ceil(hi - 0.5) - 1).cast("long")
    rows = edges.withColumns({"a": first, "b": last}).where("a <= b AND y0 <> y1").select("poly", "x0", "y0", "x1", "y1", F.explode(F.sequence("a", "b")).alias("y"))
    x = F.col("x0") + (F.col("y") + 0.5 - F.col("y0")) / (F.col("y1") - F.col("y0")) * (F.col("x1") - F.col("x0"))
    w = Window.partitionBy("poly", "y").orderBy("x")
    paired = rows.select("poly", "y", x.alias("x")).withColumns({"i": F.row_number().over(w), "x2": F.lead("x").over(w)}).where("i % 2 = 1 AND x2 IS NOT NULL")
    return paired.select("poly", "y", F.greatest(F.lit(0), F.ceil(F.col("x") - 0.5)).cast("long").alias("x0"), F.least(F.lit(width - 1), F.floor(F.col("x2") - 0.5)).cast("long").alias("x1")).where("x0 <= x1")


def stroke_pixels(segments: DataFrame, width: int, height: int) -> DataFrame:
    """segments: id, x0, y0, x1, y1, size, alpha -> id, x, y, a: pixels with a share of the line, a the alpha left of it."""
    outer = F.greatest(F.col("size") / 2, F.lit(0.5)) + 0.5
    span = lambda a, b, most: F.sequence(F.greatest(F.lit(0), F.floor(F.least(a, b) - outer)).cast("long"), F.least(F.lit(most - 1), F.ceil(F.greatest(a, b) + outer)).cast("long"))
    on = segments.where(f"greatest(x0, x1) > -9 AND greatest(y0, y1) > -9 AND least(x0, x1) < {width + 9} AND least(y0, y1) < {height + 9}").withColumn("outer", outer)
    grid = on.withColumn("y", F.explode(span(F.col("y0"), F.col("y1"), height))).withColumn("x", F.explode(span(F.col("x0"), F.col("x1"), width)))
    dx, dy = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    square = dx * dx + dy * dy
    t = F.when(square == 0, 0.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), ((F.col("x") - F.col("x0")) * dx + (F.col("y") - F.col("y0")) * dy) / square)))
    far = F.sqrt(F.pow(F.col("x") - (F.col("x0") + t * dx), 2) + F.pow(F.col("y") - (F.col("y0") + t * dy), 2))
    faded = F.floor(F.col("alpha") * F.least(F.col("size"), F.lit(1.0)))
    a = F.floor(faded * F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("outer") - far))).cast("int")
    return grid.select("id", "x", "y", a.alias("a")).where("a > 0")


def blend(dst: Column, src: Column) -> Column:
    """Source over destination, both struct(r, g, b, a) of 0 to 255; channels are cut to whole numbers, so order counts."""
    a = src["a"] / 255.0
    mix = lambda c: F.floor(src[c] * a + dst[c] * (1 - a)).cast("int").alias(c)
    over = F.struct(mix("r"), mix("g"), mix("b"), F.floor(src["a"] + dst["a"] * (1 - a)).cast("int").alias("a"))
    return F.when(src["a"] == 255, src).when(src["a"] == 0, dst).otherwise(over)


def blend_pixels(paint: DataFrame, background: tuple[int, int, int, int]) -> DataFrame:
    """paint: x, y, ord, color struct -> x, y, color: an ordered fold per pixel."""
    bg = F.struct(*[F.lit(v).alias(n) for v, n in zip(background, "rgba", strict=True)])
    stack = F.array_sort(F.collect_list(F.struct("ord", "color")))
    return paint.groupBy("x", "y").agg(F.aggregate(stack, bg, lambda d, p: blend(d, p["color"])).alias("color"))


def png_filter_scores(rows: DataFrame) -> DataFrame:
    """rows: y, bytes (array of 0 to 255) -> y, scores of the five filters, and the first of the smallest."""
    before = F.lag("bytes").over(Window.orderBy("y"))  # an image's rows: bounded by its height
    above = F.transform("bytes", lambda _, i: F.coalesce(F.get("before", i), F.lit(0)))  # as long as the row
    shift = lambda v: F.slice(F.concat(F.array(*[F.lit(0)] * 4), v), 1, F.size(v))
    wide = rows.withColumn("before", before).withColumn("above", above).withColumns({"left": shift(F.col("bytes")), "corner": shift(F.col("above"))})
    cells = F.zip_with(F.zip_with("bytes", "above", lambda x, b: F.struct(x.alias("x"), b.alias("b"))), F.zip_with("left", "corner", lambda a, c: F.struct(a.alias("a"), c.alias("c"))), lambda p, q: F.struct(p["x"].alias("x"), p["b"].alias("b"), q["a"].alias("a"), q["c"].alias("c")))

    def paeth(v: Column) -> Column:
        p = v["a"] + v["b"] - v["c"]
        da, db, dc = F.abs(p - v["a"]), F.abs(p - v["b"]), F.abs(p - v["c"])
        return F.when((da <= db) & (da <= dc), v["a"]).when(db <= dc, v["b"]).otherwise(v["c"])

    guesses = [lambda v: F.lit(0), lambda v: v["a"], lambda v: v["b"], lambda v: F.floor((v["a"] + v["b"]) / 2).cast("int"), paeth]

    def total(guess) -> Column:
        signed = F.transform("cells", lambda v: F.pmod(v["x"] - guess(v), F.lit(256)))
        return F.aggregate(signed, F.lit(0), lambda s, b: s + F.when(b < 128, b).otherwise(256 - b))

    scored = wide.withColumn("cells", cells).select("y", F.array(*[total(g) for g in guesses]).alias("scores"))
    return scored.select("y", "scores", (F.array_position("scores", F.array_min("scores")) - 1).cast("int").alias("filter"))
