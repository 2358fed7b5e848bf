"""GPX: waypoints, routes and tracks are three layers."""

from __future__ import annotations

import xml.etree.ElementTree as ET

from ..errors import GeoError
from .base import Feature, Geom, Layer, fmt, line, multi_line, number, point, text_of
from .xmlbase import kids, local, parse, text
from .xmlbase import write as write_xml

NAMESPACE = "http://www.topografix.com/GPX/1/1"
CATEGORIES = ("waypoints", "routes", "tracks")


def _position(e: ET.Element) -> tuple:
    lon, lat = number(e.get("lon") or ""), number(e.get("lat") or "")
    if lon is None or lat is None:
        raise GeoError("GPX point without lat and lon")
    z = None
    for c in kids(e, "ele"):
        z = number(text(c))
        if z is None:
            raise GeoError(f"invalid GPX elevation {text(c)!r}")
    return (lon, lat, z, None)


def _metadata(e: ET.Element) -> dict:
    return {{"desc": "description"}.get(local(c), local(c)): text(c) for c in kids(e, "name", "desc")}


def read(data: bytes) -> Layer:
    found: dict[str, list[Feature]] = {c: [] for c in CATEGORIES}
    for e in parse(data, "GPX"):
        path = lambda parent, name: [_position(p) for p in kids(parent, name)]
        match local(e):
            case "wpt":
                found["waypoints"].append(Feature(point(_position(e)), _metadata(e)))
            case "rte":
                found["routes"].append(Feature(line(path(e, "rtept")), _metadata(e)))
            case "trk":
                segments = [path(s, "trkpt") for s in kids(e, "trkseg")]
                found["tracks"].append(Feature(line(segments[0]) if len(segments) == 1 else multi_line(segments), _metadata(e)))
    return Layer(children=[Layer(c, features=fs) for c, fs in found.items() if fs])


def write(layer: Layer) -> bytes:
    root = ET.Element("gpx", {"version": "1.1", "creator": "geolith", "xmlns": NAMESPACE})

    def metadata(e: ET.Element, f: Feature) -> None:
        for key, name in (("name", "name"), ("description", "desc")):
            if f.props.get(key) is not None:
                ET.SubElement(e, name).text = text_of(f.props[key])

    def place(parent: ET.Element, name: str, p: tuple) -> ET.Element:
        e = ET.SubElement(parent, name, {"lat": fmt(p[1]), "lon": fmt(p[0])})
        if p[2] is not None:
            ET.SubElement(e, "ele").text = fmt(p[2])
        return e

    def track(f: Feature, segments: list) -> None:
        e = ET.SubElement(root, "trk")
        metadata(e, f)
        for s in segments:
            seg = ET.SubElement(e, "trkseg")
            for p in s:
                place(seg, "trkpt", p)

    def geometry(g: Geom | None, f: Feature, category: str | None) -> None:
        if g is None:
            return
        match g.kind:
            case "Point" | "MultiPoint":
                for part in g.parts:
                    metadata(place(root, "wpt", part[0][0]), f)
            case "LineString" if category == "routes":
                e = ET.SubElement(root, "rte")
                metadata(e, f)
                for p in g.parts[0][0] if g.parts else []:
                    place(e, "rtept", p)
            case "GeometryCollection":
                for c in g.children:
                    geometry(c, f, category)
            case _:  # lines and rings are segments
                track(f, [ring for part in g.parts for ring in part] or ([[]] if g.kind == "LineString" else []))

    if any(c.name in CATEGORIES for c in layer.children):
        order = [(f, None) for f in layer.features]
        for category in CATEGORIES:
            order += [(f, category) for c in layer.children if c.name == category for f in c.walk()]
        order += [(f, None) for c in layer.children if c.name not in CATEGORIES for f in c.walk()]
    else:
        order = [(f, None) for f in layer.walk()]
    for f, category in order:
        geometry(f.geom, f, category)
    return write_xml(root)
