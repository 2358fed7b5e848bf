"""Well-known binary: ISO little-endian out; ISO and EWKB of either byte order in."""

from __future__ import annotations

import math
import struct

from ..errors import GeoError
from .base import Feature, Geom, Layer, collection, line, multi_line, multi_point, multi_polygon, point, polygon

KINDS = ("Point", "LineString", "Polygon", "MultiPoint", "MultiLineString", "MultiPolygon", "GeometryCollection")


class _Cursor:
    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def take(self, form: str):
        size = struct.calcsize(form)
        if self.at + size > len(self.data):
            raise GeoError("WKB ends too early")
        out = struct.unpack_from(form, self.data, self.at)
        self.at += size
        return out

    def geometry(self, inside: str | None = None) -> Geom:
        order = self.take("B")[0]
        if order > 1:
            raise GeoError(f"WKB byte order {order}")
        e = "<" if order else ">"
        code = self.take(e + "I")[0]
        z, m = bool(code & 0x80000000), bool(code & 0x40000000)
        if code & 0x20000000:
            self.take(e + "I")  # SRID
        flagged = code & 0xE0000000
        base = code & 0xFF if flagged else code
        if not flagged:
            z, m, base = z or base // 1000 in (1, 3), m or base // 1000 in (2, 3), base % 1000
        if not 1 <= base <= 7 or not flagged and code >= 4000:
            raise GeoError(f"WKB geometry type {code}")
        kind = KINDS[base - 1]
        if inside and kind != inside:
            raise GeoError(f"WKB holds {kind} where {inside} belongs")
        width = 2 + z + m

        def positions(n: int) -> list:
            if n * width * 8 > len(self.data) - self.at:
                raise GeoError("WKB ends too early")
            v = self.take(f"{e}{n * width}d")
            return [(v[i], v[i + 1], v[i + 2] if z else None, v[i + width - 1] if m else None) for i in range(0, n * width, width)]

        count = lambda: self.take(e + "I")[0]
        if kind == "Point":
            return point(positions(1)[0])
        if kind == "LineString":
            return line(positions(count()))
        if kind == "Polygon":
            return polygon([positions(count()) for _ in range(count())])
        n = count()
        if kind == "GeometryCollection":
            return collection([self.geometry() for _ in range(n)])
        members = [self.geometry(kind[5:]) for _ in range(n)]
        if kind == "MultiPoint":
            return multi_point([g.parts[0][0][0] if g.parts else (math.nan, math.nan, None, None) for g in members])
        if kind == "MultiLineString":
            return multi_line([g.parts[0][0] if g.parts else [] for g in members])
        return multi_polygon([g.parts[0] if g.parts else [] for g in members])


def parse(data: bytes) -> Geom:
    c = _Cursor(bytes(data))
    g = c.geometry()
    if c.at != len(c.data):
        raise GeoError("bytes after the WKB geometry")
    return g


def dump(g: Geom) -> bytes:
    def head(kind: str, z: bool, m: bool) -> bytes:
        return struct.pack("<BI", 1, KINDS.index(kind) + 1 + 1000 * z + 2000 * m)

    def coordinates(ps: list, z: bool, m: bool) -> bytes:
        flat = [v for p in ps for v in (p[0], p[1], *([p[2] or 0.0] if z else []), *([p[3] or 0.0] if m else []))]
        return struct.pack(f"<{len(flat)}d", *flat)

    def dims(ps) -> tuple[bool, bool]:
        ps = list(ps)
        return any(p[2] is not None for p in ps), any(p[3] is not None for p in ps)

    def path(ps: list, z: bool, m: bool) -> bytes:
        return struct.pack("<I", len(ps)) + coordinates(ps, z, m)

    z, m = g.has_z, g.has_m
    out = head(g.kind, z, m)
    if g.kind == "Point":
        return out + coordinates([g.parts[0][0][0] if g.parts else (math.nan, math.nan, None, None)], z, m)
    if g.kind == "LineString":
        return out + path(g.parts[0][0] if g.parts else [], z, m)
    if g.kind == "Polygon":
        rings = g.parts[0] if g.parts else []
        return out + struct.pack("<I", len(rings)) + b"".join(path(r, z, m) for r in rings)
    if g.kind == "GeometryCollection":
        return out + struct.pack("<I", len(g.children)) + b"".join(map(dump, g.children))
    out += struct.pack("<I", len(g.parts))
    for part in g.parts:
        z, m = dims(p for ring in part for p in ring)
        out += head(g.kind[5:], z, m)
        if g.kind == "MultiPoint":
            out += coordinates(part[0], z, m)
        elif g.kind == "MultiLineString":
            out += path(part[0], z, m)
        else:
            out += struct.pack("<I", len(part)) + b"".join(path(r, z, m) for r in part)
    return out


def read(data: bytes) -> Layer:
    c, found = _Cursor(bytes(data)), []
    while c.at < len(c.data):
        found.append(Feature(c.geometry()))
    return Layer(features=found)


def write(layer: Layer) -> bytes:
    return b"".join(dump(f.geom) for f in layer.walk() if f.geom is not None)
