"""TopoJSON: arcs shared by index on reading, one arc a line or ring on writing."""

from __future__ import annotations

import json
import os
import tempfile
from array import array
from collections.abc import Iterable, Iterator
from itertools import accumulate

from ..errors import GeoError
from .base import Feature, Geom, Layer, line, multi_line, multi_point, multi_polygon, point, polygon
from .geojson import load, nested, ordinate, value_in, value_out
from .stream import Json, Spool, of_layer


def _decode(arcs: list, transform: dict | None) -> list:
    if not transform:
        return [[(float(p[0]), float(p[1]), None, None) for p in arc] for arc in arcs]
    (sx, sy), (tx, ty) = transform["scale"], transform["translate"]
    walk = lambda arc, i: accumulate(int(p[i]) for p in arc)
    return [[(x * sx + tx, y * sy + ty, None, None) for x, y in zip(walk(arc, 0), walk(arc, 1), strict=True)] for arc in arcs]


def stitch(indexes: list, arcs: list) -> list:
    """Arcs end to end; ~i is arc i backwards, and the first position of each arc but the first is left out."""
    out: list = []
    for i in indexes:
        if not -len(arcs) <= i < len(arcs):
            raise GeoError(f"TopoJSON has no arc {i}")
        arc = arcs[i] if i >= 0 else arcs[~i][::-1]
        out += arc[1:] if out else arc
    return out


def _leaves(o: dict) -> list[dict]:
    return [x for y in o.get("geometries", []) for x in _leaves(y)] if o.get("type") == "GeometryCollection" else [o]


def _feature(o: dict, arcs: list, transform: dict | None) -> Feature:
    def place(c: list) -> tuple:
        x, y = float(c[0]), float(c[1])
        if transform:
            x, y = x * transform["scale"][0] + transform["translate"][0], y * transform["scale"][1] + transform["translate"][1]
        return (x, y, None, None)

    def geometry(o: dict) -> Geom:
        kind, a, c = o.get("type"), o.get("arcs", []), o.get("coordinates", [])
        rings = lambda p: [stitch(r, arcs) for r in p]
        read = {
            "Point": lambda: point(place(c) if c else None),
            "MultiPoint": lambda: multi_point([place(p) for p in c]),
            "LineString": lambda: line(stitch(a, arcs)),
            "MultiLineString": lambda: multi_line(rings(a)),
            "Polygon": lambda: polygon(rings(a)),
            "MultiPolygon": lambda: multi_polygon([rings(p) for p in a]),
        }.get(kind)
        if not read:
            raise GeoError(f"unknown TopoJSON geometry {kind}")
        return read()

    props = o.get("properties")
    return Feature(geometry(o) if o.get("type") is not None else None, {k: value_in(v) for k, v in props.items()} if isinstance(props, dict) else {}, value_in(o.get("id")))


def read(data: bytes) -> Layer:
    root = load(data)
    if not isinstance(root, dict) or root.get("type") != "Topology":
        raise GeoError("not a TopoJSON topology")
    transform = root.get("transform")
    arcs = _decode(root.get("arcs", []), transform)

    return Layer(children=[Layer(name, features=[_feature(x, arcs, transform) for x in _leaves(o)]) for name, o in root.get("objects", {}).items()])


class _Some(dict):
    """Some of the arcs by number."""

    total = 0

    def __len__(self) -> int:
        return self.total


def _used(a: list) -> set[int]:
    """The numbers in nested lists of arcs, those of backward ones too."""
    return {i for x in a for i in (_used(x) if isinstance(x, list) else (x if x >= 0 else ~x,))}


def features(chunks: Iterable[bytes]) -> Iterator[tuple[list, list, int, str]]:
    """(order, path, seq, text) of the features of a document in chunks; ``one`` reads the text, which has the feature's arcs. Members may come in
    any order, so texts of features and arcs are spooled on disk; a number is held for each arc. Each object is named once."""
    json_, kind, transform, names, skipped = Json(chunks), None, None, [], set()
    spool, lines, ends = Spool(), tempfile.TemporaryFile(), array("q", [0])

    def put(n: int, v: dict, text: str | None = None) -> None:
        for x in _leaves(v):
            used = _used(x.get("arcs", [])) if x.get("type") is not None else set()
            spool.add((n, json.dumps(x) if text is None or x is not v else text, sorted(used)))

    if json_.peek() != "{":
        raise GeoError("not a TopoJSON topology")
    for key in json_.members():
        if key == "objects":
            for name in json_.members():
                if name in names:
                    raise GeoError(f"TopoJSON with two objects {name!r}")
                names.append(name)
                n, o, given = len(names) - 1, {}, False
                for k in json_.members():
                    if k == "geometries" and o.get("type") in (None, "GeometryCollection") and not given:
                        given = True
                        for _ in json_.elements():
                            v, text = json_.pair()
                            put(2 * n, v, text)
                    else:
                        o[k] = json_.value()
                if o.get("type") != "GeometryCollection":
                    skipped.add(2 * n)  # these were no features
                    put(2 * n + 1, o)
        elif key == "arcs":
            if len(ends) > 1:
                raise GeoError("TopoJSON with two lists of arcs")
            for _ in json_.elements():
                ends.append(ends[-1] + lines.write(json_.pair()[1].encode()))
        else:
            v = json_.value()
            kind, transform = v if key == "type" else kind, v if key == "transform" else transform
    json_.end()
    if kind != "Topology":
        raise GeoError("not a TopoJSON topology")
    lines.flush()
    total, seq, frame = len(ends) - 1, 0, json.dumps(transform)
    for n, text, used in spool:
        if n in skipped:
            continue
        if used and used[-1] >= total:
            raise GeoError(f"TopoJSON has no arc {used[-1]}")
        held = ",".join(f'"{i}":{os.pread(lines.fileno(), ends[i + 1] - ends[i], ends[i]).decode()}' for i in used)
        yield [n // 2], [names[n // 2]], seq, f'{{"total":{total},"transform":{frame},"arcs":{{{held}}},"feature":{text}}}'
        seq += 1


def one(text: str) -> Feature:
    held = json.loads(text)
    arcs = _Some((int(i), _decode([a], held["transform"])[0]) for i, a in held["arcs"].items())
    arcs.total = held["total"]
    return _feature(held["feature"], arcs, held["transform"])


def object_names(children: list[str | None]) -> list[str]:
    """Unique names of the children; ``data`` is taken from the start, whether root features use it or not."""
    used, out = {"data"}, []
    for i, name in enumerate(children):
        base = key = name or f"layer_{i}"
        n = 0
        while key in used:
            n += 1
            key = f"{base}_{n}"
        used.add(key)
        out.append(key)
    return out


def fragment(f: Feature, depth: int = 0) -> tuple[str, str]:
    """A feature as it stands in the document, a zero byte for each number of an arc, and its arcs."""
    arcs: list[str] = []
    at = lambda p: [ordinate(p[0]), ordinate(p[1])]

    def arc(ps: list) -> int:
        arcs.append(nested([at(p) for p in ps], "\n    "))
        return 0

    def geometry(g: Geom | None) -> dict:
        if g is None:
            return {"type": None}
        first = g.parts[0] if g.parts else []
        rings = lambda part: [[arc(r)] for r in part]
        body = {
            "Point": lambda: {"coordinates": at(first[0][0]) if first else []},
            "MultiPoint": lambda: {"coordinates": [at(p[0][0]) for p in g.parts]},
            "LineString": lambda: {"arcs": [arc(first[0] if first else [])]},
            "MultiLineString": lambda: {"arcs": [[arc(p[0])] for p in g.parts]},
            "Polygon": lambda: {"arcs": rings(first)},
            "MultiPolygon": lambda: {"arcs": [rings(p) for p in g.parts]},
        }.get(g.kind)
        if not body:
            raise GeoError("TopoJSON cannot hold a geometry collection here")
        return {"type": g.kind, **body()}

    inner = "\n" + " " * 10
    dump = lambda v: json.dumps(v, indent=2, allow_nan=False).replace("\n", inner)
    g = geometry(f.geom)
    members = [("type", dump(g["type"]))]
    if f.id is not None:
        members.append(("id", dump(value_out(f.id))))
    if "coordinates" in g:
        members.append(("coordinates", nested(g["coordinates"], inner)))
    if "arcs" in g:
        members.append(("arcs", nested(g["arcs"], inner).replace("0", "\0")))
    members.append(("properties", dump({k: value_out(v) for k, v in f.props.items()})))
    return "{" + inner + f",{inner}".join(f'"{k}": {v}' for k, v in members) + "\n" + " " * 8 + "}", ",\n    ".join(arcs)


def document(layer: Layer, features: Iterator) -> Iterator[str]:
    """The text of a document of (order, fragment) in walking order; arcs are spooled until the objects are through."""
    arcs, n = Spool(), 0
    ahead = next(features, None)
    entries = [(-1, "data")] if ahead and not ahead[0] or not layer.children else []
    yield '{\n  "type": "Topology",\n  "objects": {'
    some = False
    while True:
        for i, name in entries:
            yield f'{"," if some else ""}\n    {json.dumps(name)}: {{\n      "type": "GeometryCollection",\n      "geometries": ['
            some, first = True, True
            while ahead and (ahead[0][0] if ahead[0] else -1) == i:
                head, tail = ahead[1]
                texts = head.split("\0")
                yield ("" if first else ",") + "\n        " + "".join(f"{t}{n + k}" for k, t in enumerate(texts[:-1])) + texts[-1]
                n, first = n + len(texts) - 1, False
                if tail:
                    arcs.add(tail)
                ahead = next(features, None)
            yield ("" if first else "\n      ") + "]\n    }"
        if entries and entries[-1][0] >= 0 or not layer.children:
            break
        entries = list(enumerate(object_names([c.name for c in layer.children])))
    yield '\n  },\n  "arcs": ['
    for k, tail in enumerate(arcs):
        yield ("," if k else "") + "\n    " + tail
    yield ("\n  " if n else "") + "]\n}"


def write(layer: Layer) -> bytes:
    return "".join(document(layer, of_layer(layer, fragment))).encode()
