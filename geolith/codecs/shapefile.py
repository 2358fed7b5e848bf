"""Shapefiles: geometry, index, attributes and projection side by side."""

from __future__ import annotations

import struct

from ..errors import GeoError
from . import dbf
from .base import Feature, Geom, Layer, area, keys_of, line, multi_line, multi_point, multi_polygon, point, polygon, wound

PRJ = (
    'GEOGCS["GCS_WGS_1984",DATUM["D_WGS_1984",SPHEROID["WGS_1984",6378137.0,298.257223563]],'
    'PRIMEM["Greenwich",0.0],UNIT["Degree",0.0174532925199433]]'
)
_SHAPES = {0: None, 1: "point", 11: "point", 21: "point", 8: "points", 18: "points", 28: "points", 3: "lines", 13: "lines", 23: "lines", 5: "rings", 15: "rings", 25: "rings"}


def category(g: Geom | None) -> int:
    return {"Point": 1, "MultiPoint": 8, "LineString": 3, "MultiLineString": 3, "Polygon": 5, "MultiPolygon": 5}.get(g.kind if g else "", 0)


def _box(ring: list) -> tuple:
    xs, ys = [p[0] for p in ring], [p[1] for p in ring]
    return min(xs), min(ys), max(xs), max(ys)


def polygons_of(rings: list) -> list:
    """Clockwise rings open polygons; a counter-clockwise one is a hole if its box lies in the open polygon's, else it opens one too."""
    found: list = []
    for ring in rings:
        hole = False
        if found and area(ring) >= 0 and ring and found[-1][0]:
            a, b = _box(found[-1][0]), _box(ring)
            hole = a[0] <= b[0] and a[1] <= b[1] and a[2] >= b[2] and a[3] >= b[3]
        if hole:
            found[-1].append(ring)
        else:
            found.append([ring])
    return found


def shape(record: bytes) -> Geom | None:
    if len(record) < 4:
        raise GeoError("shape record ends too early")
    code = struct.unpack_from("<i", record)[0]
    if code not in _SHAPES:
        raise GeoError(f"shape type {code}")
    kind = _SHAPES[code]
    try:
        at = lambda n, offset: [(*struct.unpack_from("<2d", record, offset + 16 * i), None, None) for i in range(n)]
        if kind is None:
            return None
        if kind == "point":
            return point(at(1, 4)[0])
        if kind == "points":
            return multi_point(at(struct.unpack_from("<i", record, 36)[0], 40))
        parts, n = struct.unpack_from("<2i", record, 36)
        starts = [*struct.unpack_from(f"<{parts}i", record, 44), n]
        ps = at(n, 44 + 4 * parts)
    except struct.error as e:
        raise GeoError("shape record ends too early") from e
    lines = [ps[a:b] for a, b in zip(starts, starts[1:], strict=False)]
    if kind == "lines":
        return line(lines[0]) if len(lines) == 1 else multi_line(lines)
    found = polygons_of(lines)
    return polygon(found[0]) if len(found) == 1 else multi_polygon(found)


def records(shp: bytes) -> list[bytes]:
    """The contents of whole records; a cut one at the end is left out."""
    out, at = [], 100
    while at + 8 <= len(shp):
        size = 2 * struct.unpack_from(">i", shp, at + 4)[0]
        if size < 0 or at + 8 + size > len(shp):
            break
        out.append(shp[at + 8 : at + 8 + size])
        at += 8 + size
    return out


def encoding(cpg: bytes | None) -> str:
    text = (cpg or b"").decode("latin-1").upper()
    return "utf-8" if "UTF" in text and "8" in text else "latin-1"


def read(shp: bytes, table: bytes | None = None, cpg: bytes | None = None, compat_deleted_shift: bool = True, name: str | None = None) -> Layer:
    """The i-th shape has the i-th row. Rows flagged deleted are taken out first, so later ones move up, unless ``compat_deleted_shift`` is false."""
    rows = dbf.read(table, encoding(cpg), keep_deleted=not compat_deleted_shift) if table else []
    return Layer(name, features=[Feature(shape(r), dict(rows[i]) if i < len(rows) else {}) for i, r in enumerate(records(shp))])


def _content(code: int, g: Geom | None) -> bytes:
    if g is None or g.empty:
        return struct.pack("<i", 0)
    if code == 1:
        return struct.pack("<i2d", 1, *g.parts[0][0][0][:2])
    box = g.bounds()
    if box is None:
        return struct.pack("<i", 0)
    if code == 8:
        return struct.pack("<i4di", 8, *box, len(g.parts)) + b"".join(struct.pack("<2d", *p[0][0][:2]) for p in g.parts)
    parts = [p[0] for p in g.parts] if code == 3 else [r for p in g.parts for r in wound(p, exterior_clockwise=True)]
    starts, n = [], 0
    for p in parts:
        starts.append(n)
        n += len(p)
    return struct.pack(f"<i4d2i{len(parts)}i", code, *box, len(parts), n, *starts) + b"".join(struct.pack("<2d", *q[:2]) for p in parts for q in p)


def shape_type(layer: Layer) -> int:
    codes = {category(f.geom) for f in layer.walk() if f.geom is not None}
    if len(codes) > 1:
        raise GeoError("a shapefile holds one kind of geometry")
    code = codes.pop() if codes else 1
    if code == 0:
        raise GeoError("a shapefile cannot hold geometry collections")
    return code


def write(layer: Layer) -> dict[str, bytes]:
    """Bytes by extension: shp, shx, dbf, prj."""
    code = shape_type(layer)
    contents = [_content(code, f.geom) for f in layer.walk()]
    boxes = [b for f in layer.walk() if f.geom is not None and (b := f.geom.bounds())]
    box = [min(b[0] for b in boxes), min(b[1] for b in boxes), max(b[2] for b in boxes), max(b[3] for b in boxes)] if boxes else [0.0] * 4
    head = lambda size: struct.pack(">i20xi", 9994, size // 2) + struct.pack("<2i8d", 1000, code, *box, 0, 0, 0, 0)
    shp, shx, at = [], [], 50
    for i, c in enumerate(contents):
        words = len(c) // 2
        shp.append(struct.pack(">2i", i + 1, words) + c)
        shx.append(struct.pack(">2i", at, words))
        at += 4 + words
    keys = keys_of(layer)
    return {"shp": head(2 * at) + b"".join(shp), "shx": head(100 + 8 * len(shx)) + b"".join(shx), "dbf": dbf.write(keys, layer), "prj": PRJ.encode()}


def write_directory(layer: Layer) -> dict[str, bytes]:
    """Files of a bundle by name: root features as ``data``, each child by its name or ``layer_{i}``."""
    parts = ([("data", Layer(features=layer.features))] if layer.features else []) + [(c.name or f"layer_{i}", c) for i, c in enumerate(layer.children)]
    return {f"{name}.{ext}": data for name, part in parts for ext, data in write(part).items()}
