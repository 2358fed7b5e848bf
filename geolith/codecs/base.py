"""What codecs read and write: layers of features, and their form as rows."""

from __future__ import annotations

import math
import re
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from ..errors import GeoError

Position = tuple  # (x, y, z or None, m or None)


class JsonRaw(str):
    """Nested JSON text, kept as it is."""


@dataclass
class Geom:
    """parts: part, ring, position; children: members of a collection."""

    kind: str
    parts: list = field(default_factory=list)
    children: list[Geom] = field(default_factory=list)

    def positions(self):
        for part in self.parts:
            for ring in part:
                yield from ring
        for child in self.children:
            yield from child.positions()

    @property
    def empty(self) -> bool:
        if self.kind == "GeometryCollection":
            return all(c.empty for c in self.children)
        if self.kind.endswith("Polygon"):
            return not any(part and part[0] for part in self.parts)
        return not any(ring for part in self.parts for ring in part)

    @property
    def has_z(self) -> bool:
        return any(p[2] is not None for p in self.positions())

    @property
    def has_m(self) -> bool:
        return any(p[3] is not None for p in self.positions())

    def bounds(self) -> tuple[float, float, float, float] | None:
        xy = [(p[0], p[1]) for p in self.positions() if math.isfinite(p[0]) and math.isfinite(p[1])]
        return (min(x for x, _ in xy), min(y for _, y in xy), max(x for x, _ in xy), max(y for _, y in xy)) if xy else None


def point(p: Position | None) -> Geom:
    return Geom("Point", [] if p is None or math.isnan(p[0]) and math.isnan(p[1]) else [[[p]]])


def line(ps: list) -> Geom:
    return Geom("LineString", [[ps]] if ps else [])


def polygon(rings: list) -> Geom:
    return Geom("Polygon", [rings] if rings else [])


def multi_point(ps: list) -> Geom:
    return Geom("MultiPoint", [[[p]] for p in ps])


def multi_line(lines: list) -> Geom:
    return Geom("MultiLineString", [[x] for x in lines])


def multi_polygon(polygons: list) -> Geom:
    return Geom("MultiPolygon", polygons)


def collection(children: list[Geom]) -> Geom:
    return Geom("GeometryCollection", [], children)


def singles(g: Geom) -> list[Geom]:
    """Members of a Multi geometry as geometries of their own."""
    make = {"MultiPoint": lambda p: point(p[0][0]), "MultiLineString": lambda p: line(p[0]), "MultiPolygon": polygon}
    return [make[g.kind](p) for p in g.parts]


def gathered(members: list[Geom]) -> Geom:
    """A Multi geometry of members of one kind, else a collection; no members make a collection."""
    kinds = {m.kind for m in members}
    if kinds in ({"Point"}, {"LineString"}, {"Polygon"}):
        return Geom("Multi" + kinds.pop(), [m.parts[0] if m.parts else [[]] for m in members])
    return collection(members)


@dataclass
class Feature:
    geom: Geom | None = None
    props: dict[str, Any] = field(default_factory=dict)
    id: Any = None


@dataclass
class Layer:
    name: str | None = None
    props: dict[str, Any] = field(default_factory=dict)
    features: list[Feature] = field(default_factory=list)
    children: list[Layer] = field(default_factory=list)

    def walk(self):
        """Own features, then each child's: depth first."""
        yield from self.features
        for child in self.children:
            yield from child.walk()

    def layers(self, order: tuple[int, ...] = ()):
        yield order, self
        for i, child in enumerate(self.children):
            yield from child.layers((*order, i))


# numbers and scalars as text

_INT = re.compile(r"[ \t\n\x0b\x0c\r]*[+-]?[0-9]+[ \t\n\x0b\x0c\r]*", re.ASCII)
_FLOAT = re.compile(r"[ \t\n\x0b\x0c\r]*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?[ \t\n\x0b\x0c\r]*|[+-]?(Infinity|NaN)", re.ASCII)


def fmt(v: float) -> str:
    """Shortest text that reads back; an exponent from 15 digits before the point on, and from the fifth zero after it."""
    if math.isnan(v):
        return "NaN"
    if math.isinf(v):
        return "Infinity" if v > 0 else "-Infinity"
    sign = "-" if math.copysign(1, v) < 0 else ""
    mantissa, _, power = f"{abs(v)!r}".partition("e")
    whole, _, part = mantissa.partition(".")
    part = part if part != "0" else ""
    raw = whole + part
    digits = raw.lstrip("0")
    exponent = len(whole) - 1 + int(power or 0) - (len(raw) - len(digits))
    digits = digits.rstrip("0")
    if not digits:
        return sign + "0"
    n = len(digits)
    if exponent + 1 > max(n, 15) or exponent <= -5:
        return f"{sign}{digits[0]}{'.' + digits[1:] if n > 1 else ''}E{'-' if exponent < 0 else '+'}{abs(exponent):02d}"
    if exponent < 0:
        return f"{sign}0.{'0' * (-exponent - 1)}{digits}"
    return sign + (digits + "0" * (exponent + 1 - n) if exponent + 1 >= n else f"{digits[: exponent + 1]}.{digits[exponent + 1 :]}")


def text_of(v: Any) -> str:
    if v is None:
        return ""
    if isinstance(v, bool):
        return "true" if v else "false"
    return fmt(v) if isinstance(v, float) else str(v)


def infer(text: str | None) -> Any:
    """long, else double, else bool, else the text."""
    if not text:
        return text
    if _INT.fullmatch(text) and -(1 << 63) <= int(text) < 1 << 63:
        return int(text)
    if _FLOAT.fullmatch(text):
        return float(text)
    return {"true": True, "false": False}.get(text.lower(), text)


def number(text: str) -> float | None:
    return float(text) if _FLOAT.fullmatch(text or "") else None


# rows


def tag(v: Any) -> dict:
    if v is None:
        return {"t": "null", "s": None}
    kind = "json" if isinstance(v, JsonRaw) else "bool" if isinstance(v, bool) else "long" if isinstance(v, int) else "double" if isinstance(v, float) else "string"
    return {"t": kind, "s": text_of(v)}


def untag(v: dict | None) -> Any:
    if v is None or v["t"] == "null" or v["s"] is None:
        return None
    s = v["s"]
    return {"json": JsonRaw, "bool": lambda x: x == "true", "long": int, "double": lambda x: float(x.replace("∞", "inf"))}.get(v["t"], str)(s)


def props_rows(props: dict) -> list[dict]:
    return [{"key": k, "value": tag(v)} for k, v in props.items()]


def geom_row(g: Geom | None) -> dict | None:
    if g is None:
        return None
    members: list[dict] = []

    def add(c: Geom, path: list[int]) -> None:
        if c.kind == "GeometryCollection" and c.children:
            for i, child in enumerate(c.children):
                add(child, [*path, i])
        else:
            parts = [[[{"x": p[0], "y": p[1], "z": p[2], "m": p[3]} for p in ring] for ring in part] for part in c.parts]
            members.append({"path": path, "type": c.kind, "parts": parts})

    add(g, [])
    return {"type": g.kind, "members": members}


def geom_of(row: dict | None) -> Geom | None:
    if row is None:
        return None
    make = lambda m: Geom(m["type"], [[[(p["x"], p["y"], p["z"], p["m"]) for p in ring] for ring in part] for part in m["parts"]])
    if row["type"] != "GeometryCollection":
        return make(row["members"][0])

    def build(members: list[dict], depth: int) -> Geom:
        groups: dict[int, list[dict]] = {}
        for m in members:
            if len(m["path"]) > depth:
                groups.setdefault(m["path"][depth], []).append(m)
        return collection([make(g[0]) if len(g[0]["path"]) == depth + 1 else build(g, depth + 1) for _, g in sorted(groups.items())])

    return build(row["members"], 0)


def feature_row(f: Feature, source: str, path: list[str], order: list[int], seq: int, geom: Callable = geom_row) -> dict:
    return {"source_file": source, "layer_path": path, "layer_ord": order, "seq": seq, "id": None if f.id is None else tag(f.id), "props": props_rows(f.props), "geom": geom(f.geom)}


def feature_rows(layer: Layer, source: str, geom: Callable = geom_row) -> list[dict]:
    """Rows of the features in walking order; geom gives a geometry's form in them."""
    rows: list[dict] = []

    def add(x: Layer, path: list[str], order: list[int]) -> None:
        for f in x.features:
            rows.append(feature_row(f, source, path, order, len(rows), geom))
        for i, child in enumerate(x.children):
            add(child, [*path, child.name or ""], [*order, i])

    add(layer, [], [])
    return rows


def layer_rows(layer: Layer, source: str) -> list[dict]:
    return [{"source_file": source, "layer_ord": list(o), "name": x.name, "props": props_rows(x.props)} for o, x in layer.layers()]


def at(root: Layer, order: list[int]) -> Layer:
    """The layer of an order below root, made if it isn't there."""
    x = root
    for i in order:
        while len(x.children) <= i:
            x.children.append(Layer())
        x = x.children[i]
    return x


def place(root: Layer, order: list[int], path: list[str] | None) -> Layer:
    """The layer of a row; layers above it that have no name yet get theirs from its path."""
    x = at(root, order)
    for depth, name in enumerate((path or [])[: len(order)]):
        node = at(root, order[: depth + 1])
        node.name = node.name if node.name is not None else name or None
    return x


def feature_of(r: dict) -> Feature:
    return Feature(r["geom"] if isinstance(r["geom"], Geom) else geom_of(r["geom"]), {p["key"]: untag(p["value"]) for p in r.get("props") or []}, untag(r.get("id")))


def layer_of(rows: list[dict], layers: list[dict] = ()) -> Layer:
    """The tree that feature rows (and rows of its layers, if known) describe."""
    root = Layer()
    for r in sorted(layers, key=lambda r: r["layer_ord"]):
        x = at(root, r["layer_ord"])
        x.name, x.props = r["name"], {p["key"]: untag(p["value"]) for p in r["props"] or []}
    for r in sorted(rows, key=lambda r: (r.get("layer_ord") or [], r.get("seq") or 0)):
        place(root, r.get("layer_ord") or [], r.get("layer_path")).features.append(feature_of(r))
    return root


# rings


def area(ring: list) -> float:
    if len(ring) < 3:
        return 0.0
    return sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, [*ring[1:], ring[0]], strict=True)) / 2


def wound(rings: list, exterior_clockwise: bool) -> list:
    return [r if (area(r) < 0) == ((i == 0) == exterior_clockwise) else r[::-1] for i, r in enumerate(rings)]


def keys_of(layer: Layer) -> list[str]:
    """Property names in the order they are first seen."""
    return list(dict.fromkeys(k for f in layer.walk() for k in f.props))


def widened(layer: Layer) -> dict[str, str]:
    """bool, long, double or string for each key. A null seen first fixes string; later nulls are passed over."""
    kinds: dict[str, str] = {}
    for f in layer.walk():
        for k, v in f.props.items():
            kind = "bool" if isinstance(v, bool) else "long" if isinstance(v, int) else "double" if isinstance(v, float) else "string"
            if k not in kinds:
                kinds[k] = kind
            elif v is not None and kinds[k] != kind:
                kinds[k] = "double" if {kinds[k], kind} == {"long", "double"} else "string"
    return kinds


def fail(message: str) -> None:
    raise GeoError(message)
