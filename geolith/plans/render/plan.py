"""The plan: features become paint commands, commands are dealt to bands of rows, a task paints its bands in order.

Painting is not associative, so a pixel's commands must meet in order; a band is the unit that keeps them together while other bands go
on elsewhere. A task holds one band of pixels and reads its commands as a stream, so memory does not grow with the features. Commands whose
pixels miss the canvas are left out before the shuffle. The image itself (width x height x 4 bytes) is what comes back to the driver.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ...codecs.base import Geom
from ...errors import GeoError
from ...functions import geometry as G
from ...session import ship
from ...sources.files import rows_of
from . import png
from .frame import Frame, clip_ring, frame, ocean, split_path, stroke_chains
from .labels import Labeller
from .options import Options, Style
from .raster import Canvas

BAND = 64
_FILL, _STROKE, _DISC = 0, 1, 2


def _pack(kind: int, color, width: float, paths: list[np.ndarray]) -> bytes:
    head = struct.pack("<B4Bdi", kind, *color, width, len(paths)) + struct.pack(f"<{len(paths)}i", *map(len, paths))
    return head + b"".join(np.ascontiguousarray(p, "<f8").tobytes() for p in paths)


def _paint(canvas: Canvas, data: bytes) -> None:
    kind, *color, width, n = struct.unpack_from("<B4Bdi", data)
    at = struct.calcsize("<B4Bdi")
    sizes = struct.unpack_from(f"<{n}i", data, at)
    at += 4 * n
    paths = []
    for s in sizes:
        paths.append(np.frombuffer(data, "<f8", 2 * s, at).reshape(s, 2))
        at += 16 * s
    color = tuple(color)
    if kind == _FILL:
        canvas.fill(paths, color)
    elif kind == _DISC:
        for p in paths:
            for x, y in p:
                canvas.disc(x, y, width, color)
    else:
        for p in paths:
            for (x0, y0), (x1, y1) in zip(p, p[1:], strict=False):
                canvas.stroke(x0, y0, x1, y1, width, color)


def commands(g: Geom, f: Frame, style: Style, stroke_scale: float) -> Iterator[tuple[bytes, float, float, float, float]]:
    """(command, its box in pixels) of a geometry, in the order they are painted."""
    width, radius = style.stroke_width * stroke_scale, style.point_radius * (stroke_scale + 1) / 2

    def ready(kind: int, color, size: float, paths: list[np.ndarray]):
        paths = [p for p in paths if len(p)]
        if not paths:
            return
        every = np.concatenate(paths)
        every = every[np.isfinite(every).all(1)]
        if len(every):
            reach = {_FILL: 1.0, _STROKE: max(size / 2, 0.5) + 2, _DISC: max(size, 0.5) + 2}[kind]
            lo, hi = every.min(0) - reach, every.max(0) + reach
            yield _pack(kind, color, size, paths), *lo, *hi

    xy = lambda ring: np.array([p[:2] for p in ring], float).reshape(-1, 2)
    if g.kind == "GeometryCollection":
        for c in g.children:
            yield from commands(c, f, style, stroke_scale)
    for part in g.parts:
        if g.kind.endswith("Point"):
            yield from ready(_DISC, style.stroke, radius, [f.pixels(xy(part[0]))])
        elif g.kind.endswith("LineString"):
            path = xy(part[0])
            for pixels in [f.lobe_pixels(p, lobe) for lobe, p in split_path(path)] if f.kind == "Goode" else [f.pixels(path)]:
                yield from ready(_STROKE, style.stroke, width, [pixels])
        elif f.kind != "Goode":
            rings = [f.pixels(xy(r)) for r in part]
            yield from ready(_FILL, style.fill, 0.0, rings)
            yield from ready(_STROKE, style.stroke, width, rings)
        else:
            from ...functions.projections import LOBES

            for lobe, (_, rects) in enumerate(LOBES):
                fills, chains = [], []
                for r in part:
                    for rect in rects:
                        ps, tags = clip_ring(xy(r), rect)
                        if len(ps) >= 3:
                            pixels = f.lobe_pixels(ps, lobe)
                            fills.append(pixels)
                            chains += stroke_chains(pixels, tags)
                if fills:
                    yield from ready(_FILL, style.fill, 0.0, fills)
                    yield from ready(_STROKE, style.stroke, width, chains)


def table_bounds(df: DataFrame, geom: str = "geom") -> tuple | None:
    """Envelope per row, then a partial aggregation."""
    e = df.select(G.bounds_any(F.col(geom)).alias("e"))
    row = e.agg(F.min("e.minx"), F.min("e.miny"), F.max("e.maxx"), F.max("e.maxy")).first()
    return None if row[0] is None else tuple(row)


def paint(df: DataFrame, f: Frame, options: Options) -> DataFrame:
    """band, pixels: rows of the image, compressed. df: feature rows; rank orders stacked collections, if there is one."""
    scale = f.stroke_multiplier() if options.stroke_auto_scale else 1.0
    n_bands = -(-f.height // BAND)
    styles = {name: options.style(name) for name in (options.layers or {})}
    base = options.base

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("band", pa.int32()), ("rank", pa.int32()), ("layer_ord", pa.list_(pa.int32())), ("seq", pa.int64()), ("sub", pa.int32()), ("paint", pa.binary())])
        for b in batches:
            out = []
            for r in rows_of(b):
                if r["geom"] is None:
                    continue
                name = (r["layer_path"] or [""])[-1]
                for sub, (data, x0, y0, x1, y1) in enumerate(commands(r["geom"], f, styles.get(name, base), scale)):
                    if x1 < 0 or y1 < 0 or x0 > f.width or y0 > f.height:
                        continue
                    for band in range(max(0, int(y0) // BAND), min(n_bands - 1, int(y1) // BAND) + 1):
                        out.append({"band": band, "rank": r["rank"], "layer_ord": r["layer_ord"] or [], "seq": r["seq"], "sub": sub, "paint": data})
            if out:
                yield pa.RecordBatch.from_pylist(out, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zlib

        now, canvas = None, None

        def done():
            return pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([zlib.compress(canvas.pixels.tobytes(), 1)], pa.binary())], ["band", "pixels"])

        for b in batches:
            for band, data in zip(b.column("band").to_pylist(), b.column("paint").to_pylist(), strict=True):
                if band != now:
                    if canvas is not None:
                        yield done()
                    now, canvas = band, _blank(f, options, band)
                _paint(canvas, data)
        if canvas is not None:
            yield done()

    rows = df.withColumn("rank", F.col("rank") if "rank" in df.columns else F.lit(0)).select(F.col("rank").cast("int").alias("rank"), "layer_path", "layer_ord", F.col("seq").cast("long").alias("seq"), "geom")
    made = rows.mapInArrow(make, "band int, rank int, layer_ord array<int>, seq long, sub int, paint binary")
    return made.repartition("band").sortWithinPartitions("band", "rank", "layer_ord", "seq", "sub").select("band", "paint").mapInArrow(run, "band int, pixels binary")


def _blank(f: Frame, options: Options, band: int) -> Canvas:
    top = band * BAND
    canvas = Canvas(f.width, min(BAND, f.height - top), options.background, top)
    if options.ocean:
        rings, paths = ocean(f)
        for r in rings:
            canvas.fill([r], options.ocean)
        width = options.base.stroke_width * (f.stroke_multiplier() if options.stroke_auto_scale else 1.0)
        for p in paths:
            for (x0, y0), (x1, y1) in zip(p, p[1:], strict=False):
                canvas.stroke(x0, y0, x1, y1, width, options.base.stroke)
    return canvas


def label_rows(df: DataFrame, options: Options, f: Frame) -> DataFrame:
    """Labels in the order they are tried: by layer, largest first, then by text. Anchors and priorities are column expressions.

    Columns ``label`` and ``label_priority`` of df, if there are such, take the place of the properties that styles name.
    """
    names = {"": options.base, **{n: options.style(n) for n in (options.layers or {})}}
    layer = F.coalesce(F.element_at(F.when(F.size("layer_path") > 0, F.col("layer_path")).otherwise(F.array(F.lit(""))), -1), F.lit(""))

    def own(prop: str):
        key = F.lit(getattr(options.base, prop)).cast("string")
        for n, s in names.items():
            key = F.when(layer == n, F.lit(getattr(s, prop)).cast("string")).otherwise(key)
        return key

    value = lambda key: F.get(F.filter("props", lambda p: p["key"] == key), F.lit(0))["value"]["s"]
    b = f.bounds
    anchored = df.withColumn("rank", F.col("rank") if "rank" in df.columns else F.lit(0)).where("geom IS NOT NULL").select(
        "rank", "layer_ord", layer.alias("layer"), (F.col("label").cast("string") if "label" in df.columns else value(own("label"))).alias("text"), G.label_anchor(F.col("geom")).alias("a"), F.coalesce(F.col("label_priority").cast("double") if "label_priority" in df.columns else value(own("label_priority")).try_cast("double"), G.label_priority(F.col("geom"))).alias("priority"), F.col("geom.type").isin("Point", "MultiPoint").alias("dot")
    )
    inside = (F.col("a.x") >= b[0]) & (F.col("a.x") <= b[2]) & (F.col("a.y") >= b[1]) & (F.col("a.y") <= b[3])
    return anchored.where((F.col("text") != "") & F.col("a").isNotNull() & (inside if f.kind == "PlateCarree" and options.padding == 0 else F.lit(True))).orderBy("rank", "layer_ord", F.desc("priority"), "text")


def render_png(df: DataFrame, options: Options | None = None) -> bytes:
    """The image of feature rows (source order; an optional ``rank`` column stacks collections)."""
    options = options or Options()
    ship(df.sparkSession)
    f = frame(options, options.bounds or table_bounds(df))
    import zlib

    canvas = Canvas(f.width, f.height, options.background)
    seen = set()
    for row in paint(df, f, options).toLocalIterator():  # band by band
        top = row["band"] * BAND
        rows = min(BAND, f.height - top)
        canvas.pixels[top : top + rows] = np.frombuffer(zlib.decompress(row["pixels"]), np.uint8).reshape(rows, f.width, 4)
        seen.add(row["band"])
    if options.ocean:
        for band in set(range(-(-f.height // BAND))) - seen:
            part = _blank(f, options, band)
            canvas.pixels[part.top : part.top + part.height] = part.pixels
    if "label" in df.columns or options.base.label or any(s.label for s in (options.layers or {}).values()):
        labeller, scale = Labeller(canvas), f.stroke_multiplier() if options.stroke_auto_scale else 1.0
        for r in label_rows(df, options, f).toLocalIterator():  # in order, a partition at a time; placed labels are as many as fit
            style = options.style(r["layer"])
            x, y = f.pixels(np.array([[r["a"]["x"], r["a"]["y"]]]))[0]
            labeller.place(r["text"], float(x), float(y), style.point_radius * scale + 2 if r["dot"] else 0.0, style)
    if canvas.width * canvas.height == 0:
        raise GeoError("empty canvas")
    return png.encode(canvas.pixels, options.compression)
