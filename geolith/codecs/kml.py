"""KML and KMZ: containers are layers."""

from __future__ import annotations

import codecs
import io
import math
import re
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Iterable, Iterator
from itertools import chain
from xml.parsers import expat
from xml.sax.saxutils import quoteattr

from ..errors import GeoError
from .base import Feature, Geom, Layer, fmt, gathered, line, number, point, polygon, singles, text_of
from .stream import Spool, of_layer
from .xmlbase import kids, local, parse, text

NAMESPACE = "http://www.opengis.net/kml/2.2"
_CONTAINERS = ("Document", "Folder")
_GEOMETRIES = ("Point", "LineString", "LinearRing", "Polygon", "MultiGeometry")
_TAG = re.compile(rb"<([^\s/>]+)")
#: No entry of an archive may unpack to more.
MOST = 2**31 - 1


def _coordinates(e: ET.Element) -> list:
    found = []
    for c in kids(e, "coordinates"):
        for tuple_ in text(c).split():
            parts = tuple_.split(",")
            values = [number(p) for p in parts[:3]]
            if len(parts) < 2 or None in values:
                raise GeoError(f"invalid KML coordinates {tuple_!r}")
            found.append((values[0], values[1], values[2] if len(values) > 2 else None, None))
    return found


def _geometry(e: ET.Element) -> Geom:
    match local(e):
        case "Point":
            ps = _coordinates(e)
            return point(ps[0] if ps else None)
        case "LineString" | "LinearRing":
            return line(_coordinates(e))
        case "Polygon":
            return polygon([_coordinates(r) for b in kids(e, "outerBoundaryIs", "innerBoundaryIs") for r in kids(b, "LinearRing")])
    return gathered([_geometry(c) for c in kids(e, *_GEOMETRIES)])


def _placemark(e: ET.Element) -> Feature:
    f = Feature()
    for c in e:
        name = local(c)
        if name in ("name", "description"):
            f.props[name] = text(c)
        elif name == "ExtendedData":
            for d in kids(c, "Data"):
                v = kids(d, "value")
                if d.get("name") is not None:
                    f.props[d.get("name")] = text(v[0]) if v else None
        elif name in _GEOMETRIES and f.geom is None:
            f.geom = _geometry(c)
    return f


def _fill(e: ET.Element, layer: Layer, root: bool) -> None:
    for c in e:
        name = local(c)
        if name == "name":
            layer.name = text(c)
        elif name == "description":
            layer.props["description"] = text(c)
        elif name == "Placemark":
            layer.features.append(_placemark(c))
        elif name == "Document" and root:
            _fill(c, layer, False)
        elif name in _CONTAINERS:
            child = Layer()
            _fill(c, child, False)
            layer.children.append(child)


def read(data: bytes) -> Layer:
    layer, root = Layer(), parse(data, "KML")
    if local(root) == "Placemark":
        layer.features.append(_placemark(root))
    else:
        _fill(root, layer, local(root) not in _CONTAINERS)
    return layer


class _Cutter:
    """Finds placemarks and layers while a document goes by; a placemark's text gets the namespaces around it."""

    def __init__(self, encoding: str | None):
        self.parser = p = expat.ParserCreate(encoding, namespace_separator=" ")
        p.StartElementHandler, p.EndElementHandler, p.CharacterDataHandler = self._start, self._end, self._text
        p.StartDoctypeDeclHandler, p.XmlDeclHandler, p.StartNamespaceDeclHandler = self._refuse, self._declared, self._space
        self.encoding, self.given = encoding or "utf-8", encoding
        self.data, self.base, self.last = b"", 0, 0
        self.stack: list[tuple[Layer, tuple, bool, dict]] = []
        self.spaces: dict = {}
        self.depth, self.leaf, self.begin, self.texts = 0, "", 0, []
        self.root, self.counts, self.found = Layer(), {}, []

    def _refuse(self, *_) -> None:
        raise GeoError("KML with a document type")

    def _declared(self, version: str, encoding: str | None, standalone: int) -> None:
        if encoding and not self.given:
            self.encoding = encoding

    def _space(self, prefix: str | None, uri: str) -> None:
        self.spaces[prefix] = uri

    def _start(self, name: str, attributes: dict) -> None:
        self.last, spaces, self.spaces = self.parser.CurrentByteIndex, self.spaces, {}
        if self.depth:
            self.depth += 1
            return
        name = name.rpartition(" ")[2]
        layer, order, root, around = self.stack[-1] if self.stack else (self.root, (), False, {})
        if not self.stack and name != "Placemark":
            self.stack.append((layer, order, name not in _CONTAINERS, spaces))
        elif self.stack and name == "Document" and root:
            self.stack.append((layer, order, False, around | spaces))
        elif self.stack and name in _CONTAINERS:
            layer.children.append(Layer())
            self.stack.append((layer.children[-1], (*order, len(layer.children) - 1), False, around | spaces))
        else:
            self.depth, self.leaf, self.begin, self.texts = 1, name, self.last, []

    def _text(self, text: str) -> None:
        if self.depth and self.leaf == "name":
            self.texts.append(text)

    def _end(self, name: str) -> None:
        self.last = self.parser.CurrentByteIndex
        if not self.depth:
            self.stack.pop()
            return
        self.depth -= 1
        if self.depth:
            return
        layer, order, _, around = self.stack[-1] if self.stack else (self.root, (), False, {})
        if self.leaf == "name":
            layer.name = "".join(self.texts)
        elif self.leaf == "Placemark":
            a, b = self.begin - self.base, self.last - self.base
            tag = _TAG.match(self.data, a)[1]
            if self.data.startswith(b"</" + tag, b):  # else an empty element, which ends here
                b = self.data.index(b">", b) + 1
            spaces = "".join(f" xmlns{':' + p if p else ''}={quoteattr(u or '')}" for p, u in around.items())
            n = self.counts[order] = self.counts.get(order, 0) + 1
            self.found.append((order, n - 1, f"<r{spaces}>{self.data[a:b].decode(self.encoding)}</r>"))

    def feed(self, data: bytes, last: bool = False) -> list[tuple[tuple, int, str]]:
        keep = min(self.last, self.begin) if self.depth else self.last
        self.data, self.base = self.data[keep - self.base :] + data, keep
        try:
            self.parser.Parse(data, last)
        except expat.ExpatError as e:
            raise GeoError(f"invalid KML: {e}") from e
        found, self.found = self.found, []
        return found


def features(chunks: Iterable[bytes]) -> Iterator[tuple[list, list, int, str]]:
    """(order, path, seq, text) of the features of a document in chunks; ``one`` reads the text. Names and counts of layers may come late,
    so features below the root are spooled until the end."""
    chunks, start = iter(chunks), b""
    while len(start) < 4 and (more := next(chunks, None)) is not None:
        start += more
    chunks = chain([start], chunks)
    wide = start[:2] in (b"\xff\xfe", b"\xfe\xff") or b"\0" in start[:2]
    if wide:
        name = "utf-16" if start[0] > 60 else "utf-16-be" if start[0] == 0 else "utf-16-le"
        chunks = (x.encode() for x in codecs.iterdecode(chunks, name))
    cutter, spool = _Cutter("utf-8" if wide else None), Spool()
    for found in chain(map(cutter.feed, chunks), (cutter.feed(b"", True) for _ in range(1))):
        for order, n, text_ in found:
            if order:
                spool.add((order, n, text_))
            else:
                yield [], [], n, text_
    paths, offsets, seen = {(): []}, {}, 0
    for order, layer in cutter.root.layers():
        if order:
            paths[order] = [*paths[order[:-1]], layer.name or ""]
        offsets[order], seen = seen, seen + cutter.counts.get(order, 0)
    for order, n, text_ in spool:
        yield list(order), paths[order], offsets[order] + n, text_


def one(text: str) -> Feature:
    return _placemark(ET.fromstring(text)[0])


def _add(parent: ET.Element, tag: str, value: str | None = None, **attributes: str) -> ET.Element:
    e = ET.SubElement(parent, tag, attributes)
    e.text = value
    return e


def _write_coordinates(parent: ET.Element, ps: list) -> None:
    _add(parent, "coordinates", " ".join(",".join(fmt(v) for v in p[:3] if v is not None) for p in ps))


def _write_geometry(parent: ET.Element, g: Geom) -> None:
    if g.kind == "Point":
        _write_coordinates(_add(parent, "Point"), [g.parts[0][0][0] if g.parts else (math.nan, math.nan, None, None)])
    elif g.kind == "LineString":
        _write_coordinates(_add(parent, "LineString"), g.parts[0][0] if g.parts else [])
    elif g.kind == "Polygon":
        e = _add(parent, "Polygon")
        for i, ring in enumerate(g.parts[0] if g.parts else []):
            _write_coordinates(_add(_add(e, "innerBoundaryIs" if i else "outerBoundaryIs"), "LinearRing"), ring)
    else:
        e = _add(parent, "MultiGeometry")
        for c in g.children if g.kind == "GeometryCollection" else singles(g):
            _write_geometry(e, c)


def fragment(f: Feature, depth: int = 0) -> tuple[str, str]:
    """A feature as it stands in a layer of that depth."""
    e = ET.Element("Placemark")
    for key in ("name", "description"):
        if f.props.get(key) is not None:
            _add(e, key, text_of(f.props[key]))
    others = [(k, v) for k, v in f.props.items() if k not in ("name", "description")]
    if others:
        data = _add(e, "ExtendedData")
        for k, v in others:
            _add(_add(data, "Data", name=k), "value", text_of(v))
    if f.geom is not None:
        _write_geometry(e, f.geom)
    ET.indent(e, level=depth + 2)
    return ET.tostring(e, encoding="unicode"), ""


def _container(tag: str, layer: Layer, order: tuple, ahead: list, features: Iterator) -> Iterator[str]:
    """A layer's element; ahead holds the next (order, fragment)."""
    pad = "\n" + "  " * (len(order) + 1)
    texts = [(key, v) for key, v in (("name", layer.name), ("description", layer.props.get("description"))) if v is not None]
    held = ahead[0] and ahead[0][0][: len(order)] == order
    if not (texts or held or layer.children):
        yield f"{pad}<{tag} />"
        return
    yield f"{pad}<{tag}>"
    for key, v in texts:
        e = ET.Element(key)
        e.text = text_of(v)
        yield f"{pad}  {ET.tostring(e, encoding='unicode')}"
    while ahead[0] and ahead[0][0] == order:
        yield f"{pad}  {ahead[0][1][0]}"
        ahead[0] = next(features, None)
    for n, child in enumerate(layer.children):
        yield from _container("Folder", child, (*order, n), ahead, features)
    yield f"{pad}</{tag}>"


def document(layer: Layer, features: Iterator) -> Iterator[str]:
    """The text of a document of (order, fragment) in walking order."""
    yield f'<?xml version="1.0" encoding="utf-8"?>\n<kml xmlns="{NAMESPACE}">'
    yield from _container("Document", layer, (), [next(features, None)], features)
    yield "\n</kml>"


def write(layer: Layer) -> bytes:
    return "".join(document(layer, of_layer(layer, fragment))).encode()


def read_kmz(data: bytes) -> Layer:
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        entries = [i for i in z.infolist() if i.filename.lower().endswith(".kml")]
        if not entries:
            raise GeoError("KMZ without a KML entry")
        if any(i.file_size > MOST for i in entries):
            raise GeoError("KMZ entry too large")
        layers = [read(z.read(i)) for i in entries]
    if len(layers) == 1:
        return layers[0]
    for i, x in zip(entries, layers, strict=True):
        x.name = x.name or i.filename.rpartition("/")[2][:-4]
    return Layer(children=layers)


def write_kmz(layer: Layer, level: int = 6) -> bytes:
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w") as z:
        entry = zipfile.ZipInfo("doc.kml", date_time=(1980, 1, 1, 0, 0, 0))  # the same bytes every time
        z.writestr(entry, write(layer), zipfile.ZIP_DEFLATED if level else zipfile.ZIP_STORED, level or None)
    return held.getvalue()
