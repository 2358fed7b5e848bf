"""Well-known text: one geometry a line."""

from __future__ import annotations

import math
import re

from ..errors import GeoError
from .base import Feature, Geom, Layer, collection, fmt, line, multi_line, multi_point, multi_polygon, point, polygon

_TOKEN = re.compile(r"\s*(?:([A-Za-z]+)|([+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?)|([(),])|$)")
_KINDS = {k.upper(): k for k in ("Point", "LineString", "Polygon", "MultiPoint", "MultiLineString", "MultiPolygon", "GeometryCollection")}
_TAGS = {"Z": (True, False), "M": (False, True), "ZM": (True, True), "MZ": (True, True)}


class _Reader:
    def __init__(self, text: str):
        self.text, self.tokens, at = text, [], 0
        while at < len(text):
            m = _TOKEN.match(text, at)
            if not m or m.end() == at:
                raise GeoError(f"invalid WKT at position {at}: {text[at : at + 20]!r}")
            if m.lastindex:
                self.tokens.append((m.lastindex, m.group(m.lastindex), m.start(m.lastindex)))
            at = m.end()
        self.i = 0

    def peek(self) -> tuple:
        return self.tokens[self.i] if self.i < len(self.tokens) else (0, "", len(self.text))

    def take(self, kind: int, what: str = "") -> str:
        k, value, at = self.peek()
        if k != kind or what and value != what:
            raise GeoError(f"invalid WKT at position {at}: expected {what or ('a word', 'a number')[kind - 1]}")
        self.i += 1
        return value

    def comma(self) -> bool:
        if self.peek()[:2] == (3, ","):
            self.i += 1
            return True
        return False

    def listed(self, item) -> list:
        self.take(3, "(")
        out = [item()]
        while self.comma():
            out.append(item())
        self.take(3, ")")
        return out

    def geometry(self) -> Geom:
        word = self.take(1).upper()
        dims = None
        for tag in ("ZM", "MZ", "Z", "M"):  # POINTZ and POINT Z
            if word not in _KINDS and word.endswith(tag) and word[: -len(tag)] in _KINDS:
                word, dims = word[: -len(tag)], _TAGS[tag]
        if word not in _KINDS:
            raise GeoError(f"unknown WKT geometry {word}")
        kind = _KINDS[word]
        if self.peek()[0] == 1 and self.peek()[1].upper() in _TAGS:
            dims = _TAGS[self.take(1).upper()]
        if self.peek()[0] == 1 and self.peek()[1].upper() == "EMPTY":
            self.i += 1
            return Geom(kind)
        coordinate = lambda: self.coordinate(dims)
        path = lambda: self.listed(coordinate)
        rings = lambda: self.listed(path)
        bracketed = lambda: self.listed(coordinate)[0] if self.peek()[:2] == (3, "(") else coordinate()
        match kind:
            case "Point":
                self.take(3, "(")
                p = coordinate()
                self.take(3, ")")
                return point(p)
            case "LineString":
                return line(path())
            case "Polygon":
                return polygon(rings())
            case "MultiPoint":
                return multi_point(self.listed(bracketed))
            case "MultiLineString":
                return multi_line(rings())
            case "MultiPolygon":
                return multi_polygon(self.listed(rings))
        return collection(self.listed(self.geometry))

    def coordinate(self, dims) -> tuple:
        v = [float(self.take(2)), float(self.take(2))]
        if dims is None:
            while len(v) < 4 and self.peek()[0] == 2:
                v.append(float(self.take(2)))
            return (v[0], v[1], v[2] if len(v) > 2 else None, v[3] if len(v) > 3 else None)
        z = float(self.take(2)) if dims[0] else None
        return (v[0], v[1], z, float(self.take(2)) if dims[1] else None)


def parse(text: str) -> Geom:
    r = _Reader(text)
    g = r.geometry()
    if r.peek()[0]:
        raise GeoError(f"invalid WKT: text after the geometry at position {r.peek()[2]}")
    return g


def dump(g: Geom) -> str:
    z, m = g.has_z, g.has_m
    head = g.kind.upper() + (" ZM" if z and m else " Z" if z else " M" if m else "")
    if g.empty:
        return head + " EMPTY"
    if g.kind == "GeometryCollection":
        return f"{head} ({', '.join(map(dump, g.children))})"

    def ring(ps: list) -> str:
        return "(" + ", ".join(" ".join([fmt(p[0]), fmt(p[1]), *([fmt(p[2] or 0.0)] if z else []), *([fmt(p[3] or 0.0)] if m else [])]) for p in ps) + ")" if ps else "EMPTY"

    rings = lambda part: "(" + ", ".join(map(ring, part)) + ")"
    if g.kind in ("Point", "LineString"):
        return f"{head} {ring(g.parts[0][0])}"
    if g.kind == "Polygon":
        return f"{head} {rings(g.parts[0])}"
    return f"{head} ({', '.join(rings(p) if g.kind == 'MultiPolygon' else ring(p[0]) for p in g.parts)})"


def read(data: bytes) -> Layer:
    return Layer(features=[Feature(parse(x.strip())) for x in re.split(r"\r\n|\r|\n", data.decode("utf-8-sig")) if x.strip()])


def write(layer: Layer) -> bytes:
    return "".join(dump(f.geom) + "\n" for f in layer.walk() if f.geom is not None).encode()


def nan_point(g: Geom) -> tuple:
    return g.parts[0][0][0] if g.parts else (math.nan, math.nan, None, None)
