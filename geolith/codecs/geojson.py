"""GeoJSON."""

from __future__ import annotations

import json
import math
from collections.abc import Iterable, Iterator
from typing import Any

from ..errors import GeoError
from .base import Feature, Geom, JsonRaw, Layer, collection, line, multi_line, multi_point, multi_polygon, point, polygon, wound
from .stream import Json, of_layer


def value_in(v: Any) -> Any:
    if isinstance(v, dict | list):
        return JsonRaw(json.dumps(v, ensure_ascii=False, separators=(",", ":")))
    if isinstance(v, int) and not isinstance(v, bool) and not -(1 << 63) <= v < 1 << 63:
        return float(v)
    return v


def value_out(v: Any) -> Any:
    if isinstance(v, JsonRaw):
        return json.loads(v)
    if isinstance(v, float):
        return None if not math.isfinite(v) else int(v) if v.is_integer() and abs(v) < 1 << 53 else v
    return v


def ordinate(v: float) -> float | int:
    if not math.isfinite(v):
        raise GeoError("JSON has no NaN or infinite coordinates")
    return int(v) if float(v).is_integer() and abs(v) < 1 << 53 else v


def load(data: bytes) -> Any:
    return json.loads(data.decode("utf-8-sig"))


def _position(c: list) -> tuple:
    return (float(c[0]), float(c[1]), float(c[2]) if len(c) > 2 else None, None)


def _positions(c: list) -> list:
    return [_position(p) for p in c]


def _rings(c: list) -> list:
    return [_positions(r) for r in c]


def parse(g: dict) -> Geom:
    kind = g.get("type")
    if kind == "GeometryCollection":
        return collection([parse(x) for x in g.get("geometries", []) if x is not None])
    read = {"Point": lambda c: point(_position(c) if c else None), "LineString": lambda c: line(_positions(c)), "Polygon": lambda c: polygon(_rings(c)), "MultiPoint": lambda c: multi_point(_positions(c)), "MultiLineString": lambda c: multi_line(_rings(c)), "MultiPolygon": lambda c: multi_polygon([_rings(x) for x in c])}.get(kind)
    if not read:
        raise GeoError(f"unknown GeoJSON geometry {kind}")
    return read(g.get("coordinates", []))


def _feature(f: dict) -> Feature:
    g, props = f.get("geometry"), f.get("properties")
    return Feature(parse(g) if g is not None else None, {k: value_in(v) for k, v in props.items()} if isinstance(props, dict) else {}, value_in(f.get("id")))


def read(data: bytes) -> Layer:
    root = load(data)
    kind = root.get("type") if isinstance(root, dict) else None
    if kind is None:
        raise GeoError("GeoJSON without a type")
    if kind == "FeatureCollection":
        return Layer(features=[_feature(f) for f in root.get("features", [])])
    return Layer(features=[_feature(root) if kind == "Feature" else Feature(parse(root))])


def features(chunks: Iterable[bytes]) -> Iterator[tuple[list, list, int, str]]:
    """(order, path, seq, text) of the features of a document in chunks; ``one`` reads the text. They are given out before the end is seen, so a type that comes after them must be
    FeatureCollection, and there is one list of them."""
    json_, root, given = Json(chunks), {}, False
    if json_.peek() != "{":
        json_.value()
        raise GeoError("GeoJSON without a type")
    for key in json_.members():
        if key == "features" and root.get("type") in (None, "FeatureCollection"):
            if given:
                raise GeoError("GeoJSON with two lists of features")
            given = True
            for n, _ in enumerate(json_.elements()):
                yield [], [], n, json_.text()
        else:
            v = json_.value()
            if key in ("type", "id", "geometry", "properties", "coordinates", "geometries"):
                root[key] = v
    json_.end()
    kind = root.get("type")
    if kind is None:
        raise GeoError("GeoJSON without a type")
    if given and kind != "FeatureCollection":
        raise GeoError(f"GeoJSON {kind} after a list of features")
    if kind != "FeatureCollection":
        yield [], [], 0, json.dumps(root if kind == "Feature" else {"geometry": root})


def one(text: str) -> Feature:
    return _feature(json.loads(text))


def dump(g: Geom | None) -> dict | None:
    if g is None:
        return None
    if g.kind == "GeometryCollection":
        return {"type": g.kind, "geometries": [dump(c) for c in g.children]}
    at = lambda p: [ordinate(v) for v in p[:3] if v is not None]
    ring = lambda r: [at(p) for p in r]
    rings = lambda part: [ring(r) for r in wound(part, exterior_clockwise=False)]
    first = g.parts[0] if g.parts else []
    coordinates = {
        "Point": lambda: at(first[0][0]) if first else [],
        "LineString": lambda: ring(first[0]) if first else [],
        "Polygon": lambda: rings(first),
        "MultiPoint": lambda: [at(p[0][0]) for p in g.parts],
        "MultiLineString": lambda: [ring(p[0]) for p in g.parts],
        "MultiPolygon": lambda: [rings(p) for p in g.parts],
    }[g.kind]()
    return {"type": g.kind, "coordinates": coordinates}


def feature(f: Feature) -> dict:
    return {"type": "Feature", **({} if f.id is None else {"id": value_out(f.id)}), "geometry": dump(f.geom), "properties": {k: value_out(v) for k, v in f.props.items()}}


def nested(v: Any, indent: str) -> str:
    """Lists of numbers as ``json.dumps`` indents them, whose indenting encoder is slow."""
    if not isinstance(v, list):
        return repr(v)
    if not v:
        return "[]"
    inner = indent + "  "
    if not isinstance(v[0], list):
        return f"[{inner}" + f",{inner}".join(map(repr, v)) + f"{indent}]"
    return f"[{inner}" + f",{inner}".join([nested(x, inner) for x in v]) + f"{indent}]"


def fragment(f: Feature, depth: int = 0) -> tuple[str, str]:
    """A feature as it stands in the document."""
    made = feature(f)
    g = made["geometry"]
    if g and "coordinates" in g:
        made["geometry"] = None
        head, tail = (json.dumps(made, indent=2, allow_nan=False).replace("\n", "\n    ")).split('"geometry": null', 1) if f.id is None else (None, None)
        if head is not None:
            return f'{head}"geometry": {{\n        "type": "{g["type"]}",\n        "coordinates": {nested(g["coordinates"], chr(10) + " " * 8)}\n      }}{tail}', ""
        made["geometry"] = g
    return json.dumps(made, indent=2, allow_nan=False).replace("\n", "\n    "), ""


def document(layer: Layer, features: Iterator) -> Iterator[str]:
    """The text of a document of (order, fragment) in walking order."""
    yield '{\n  "type": "FeatureCollection",\n  "features": ['
    n = 0
    for n, (_, (text, _)) in enumerate(features, 1):
        yield ("," if n > 1 else "") + "\n    " + text
    yield ("\n  " if n else "") + "]\n}"


def write(layer: Layer) -> bytes:
    return "".join(document(layer, of_layer(layer, fragment))).encode()
