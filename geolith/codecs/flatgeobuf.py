"""FlatGeobuf: size-prefixed FlatBuffers, header first. The reader walks tables in place; the writer lays them out back to front."""

from __future__ import annotations

import math
import struct
from typing import Any

from ..errors import GeoError
from .base import Feature, Geom, Layer, collection, line, multi_line, multi_point, multi_polygon, point, polygon, text_of, widened, wound

MAGIC = bytes([0x66, 0x67, 0x62, 0x03, 0x66, 0x67, 0x62, 0x00])
KINDS = ("Unknown", "Point", "LineString", "Polygon", "MultiPoint", "MultiLineString", "MultiPolygon", "GeometryCollection")
_NUMBERS = {0: "b", 1: "B", 3: "h", 4: "H", 5: "i", 6: "I", 7: "q", 8: "Q", 9: "f", 10: "d"}
_CODES = {"bool": 2, "long": 7, "double": 10, "string": 11}


class _Table:
    def __init__(self, buf: bytes, at: int):
        self.buf, self.at = buf, at
        self.vt = at - struct.unpack_from("<i", buf, at)[0]
        self.size = struct.unpack_from("<H", buf, self.vt)[0]

    def place(self, field: int) -> int:
        slot = 4 + 2 * field
        offset = struct.unpack_from("<H", self.buf, self.vt + slot)[0] if slot < self.size else 0
        return self.at + offset if offset else 0

    def scalar(self, field: int, form: str, default: int = 0):
        p = self.place(field)
        return struct.unpack_from("<" + form, self.buf, p)[0] if p else default

    def ref(self, field: int) -> int:
        p = self.place(field)
        return p + struct.unpack_from("<I", self.buf, p)[0] if p else 0

    def vector(self, field: int, form: str) -> tuple:
        p = self.ref(field)
        return struct.unpack_from(f"<{struct.unpack_from('<I', self.buf, p)[0]}{form}", self.buf, p + 4) if p else ()

    def raw(self, field: int) -> bytes:
        p = self.ref(field)
        return self.buf[p + 4 : p + 4 + struct.unpack_from("<I", self.buf, p)[0]] if p else b""

    def table(self, field: int) -> _Table | None:
        p = self.ref(field)
        return _Table(self.buf, p) if p else None

    def tables(self, field: int) -> list[_Table]:
        p = self.ref(field)
        n = struct.unpack_from("<I", self.buf, p)[0] if p else 0
        return [_Table(self.buf, q + struct.unpack_from("<I", self.buf, q)[0]) for q in range(p + 4, p + 4 + 4 * n, 4)]


def index_size(count: int, node: int) -> int:
    """Bytes of the packed R-tree: 40 for each node of each level. Nodes hold two or more, whatever the header says."""
    node, total, level = max(node, 2), count, count
    while level != 1:
        level = -(-level // node)
        total += level
    return 40 * total


def _geometry(t: _Table, fallback: int) -> Geom:
    code = t.scalar(6, "B") or fallback
    if not 1 <= code <= 7:
        raise GeoError(f"FlatGeobuf geometry type {code}")
    kind, xy = KINDS[code], t.vector(1, "d")
    ps = [(xy[i], xy[i + 1], None, None) for i in range(0, len(xy) - 1, 2)]
    if kind == "Point":
        return point(ps[0] if ps else None)
    if kind == "LineString":
        return line(ps)
    if kind == "MultiPoint":
        return multi_point(ps)
    parts = t.tables(7)
    if kind == "MultiPolygon":
        return multi_polygon([(_geometry(p, 3).parts or [[]])[0] for p in parts])
    if kind == "GeometryCollection":
        return collection([_geometry(p, 0) for p in parts])
    ends = t.vector(0, "I") or (len(ps),)
    rings = [ps[a:b] for a, b in zip((0, *ends), ends, strict=False)]
    return polygon(rings) if kind == "Polygon" else multi_line(rings)


def _properties(data: bytes, columns: list[tuple[str, int]]) -> dict[str, Any]:
    out, at = {}, 0
    while at + 2 <= len(data):
        i = struct.unpack_from("<H", data, at)[0]
        at += 2
        if i >= len(columns):
            raise GeoError(f"FlatGeobuf has no column {i}")
        name, kind = columns[i]
        if kind == 2:
            out[name] = data[at] != 0
            at += 1
        elif kind in _NUMBERS:
            out[name] = struct.unpack_from("<" + _NUMBERS[kind], data, at)[0]
            at += struct.calcsize(_NUMBERS[kind])
        else:
            n = struct.unpack_from("<I", data, at)[0]
            out[name] = data[at + 4 : at + 4 + n].decode("utf-8", "replace")
            at += 4 + n
    return out


def read(data: bytes) -> Layer:
    data = bytes(data)
    if data[:8] != MAGIC:
        raise GeoError("not a FlatGeobuf file of version 3")
    try:
        size = struct.unpack_from("<I", data, 8)[0]
        head = _Table(data, 12 + struct.unpack_from("<I", data, 12)[0])
        columns = [(c.raw(0).decode() or f"field{i}", c.scalar(1, "B") if c.place(1) else 0) for i, c in enumerate(head.tables(7))]
        kind, count, node = head.scalar(2, "B"), head.scalar(8, "Q"), head.scalar(9, "H", 16)
        at = 12 + size + (index_size(count, node) if node and count else 0)
        found = []
        while at + 4 <= len(data):
            size = struct.unpack_from("<I", data, at)[0]
            if at + 4 + size > len(data):
                raise GeoError("FlatGeobuf ends too early")
            t = _Table(data, at + 4 + struct.unpack_from("<I", data, at + 4)[0])
            g = t.table(0)
            found.append(Feature(_geometry(g, kind) if g else None, _properties(t.raw(1), columns)))
            at += 4 + size
        return Layer(features=found)
    except struct.error as e:
        raise GeoError("FlatGeobuf ends too early") from e


class _Builder:
    """Bytes written from the end: ``tail`` holds what is laid out, offsets count from its end."""

    def __init__(self):
        self.tail = bytearray()  # reversed chunks would cost copies; features are small

    def _prepend(self, raw: bytes) -> int:
        self.tail[:0] = raw
        return len(self.tail)

    def _align(self, size: int, extra: int) -> None:
        pad = -(len(self.tail) + extra) % size
        if pad:
            self._prepend(bytes(pad))

    def vector(self, form: str, values) -> int:
        raw = struct.pack(f"<{len(values)}{form}", *values)
        self._align(max(4, struct.calcsize(form)), len(raw))
        self._prepend(raw)
        return self._prepend(struct.pack("<I", len(values)))

    def text(self, s: str) -> int:
        raw = s.encode()
        self._align(4, len(raw) + 1)
        self._prepend(raw + b"\0")
        return self._prepend(struct.pack("<I", len(raw)))

    def offsets(self, targets: list[int]) -> int:
        self._align(4, 4 * len(targets))
        for t in reversed(targets):
            here = len(self.tail) + 4
            self._prepend(struct.pack("<I", here - t))
        return self._prepend(struct.pack("<I", len(targets)))

    def table(self, fields: dict[int, tuple[str, Any]]) -> int:
        """fields: by number, (format, value), or ("ref", offset)."""
        sizes = {f: 4 if form == "ref" else struct.calcsize(form) for f, (form, _) in fields.items()}
        order = sorted(fields, key=lambda f: -sizes[f])
        place, at = {}, 4
        for f in order:
            at += -at % sizes[f]
            place[f] = at
            at += sizes[f]
        self._align(8, at - 0)
        end = len(self.tail) + at  # the table starts here, counted from the end
        body = bytearray(at - 4)
        for f in order:
            form, value = fields[f]
            raw = struct.pack("<I", end - place[f] - value) if form == "ref" else struct.pack("<" + form, value)
            body[place[f] - 4 : place[f] - 4 + len(raw)] = raw
        slots = [place.get(i, 0) for i in range(max(fields, default=-1) + 1)]
        vt = struct.pack(f"<2H{len(slots)}H", 4 + 2 * len(slots), at, *slots)
        self._prepend(struct.pack("<i", len(vt)) + bytes(body))
        self._prepend(vt)
        return end

    def finish(self, root: int) -> bytes:
        self._align(8, 4)
        self._prepend(struct.pack("<I", len(self.tail) + 4 - root))
        return struct.pack("<I", len(self.tail)) + bytes(self.tail)


def _write_geometry(b: _Builder, g: Geom) -> int:
    code = KINDS.index(g.kind)
    flat = lambda ps: [v for p in ps for v in p[:2]]

    def simple(kind: int, ps: list) -> int:
        xy = b.vector("d", flat(ps))
        return b.table({1: ("ref", xy), 6: ("B", kind)})

    def ringed(kind: int, rings: list) -> int:
        xy = b.vector("d", flat([p for r in rings for p in r]))
        fields = {1: ("ref", xy), 6: ("B", kind)}
        if len(rings) > 1:
            ends, n = [], 0
            for r in rings:
                n += len(r)
                ends.append(n)
            fields[0] = ("ref", b.vector("I", ends))
        return b.table(fields)

    match g.kind:
        case "Point":
            return simple(code, [g.parts[0][0][0] if g.parts else (math.nan, math.nan)])
        case "LineString":
            return simple(code, g.parts[0][0] if g.parts else [])
        case "MultiPoint":
            return simple(code, [p[0][0] for p in g.parts])
        case "Polygon":
            return ringed(code, wound(g.parts[0], False) if g.parts else [])
        case "MultiLineString":
            return ringed(code, [p[0] for p in g.parts])
        case "MultiPolygon":
            parts = [ringed(3, wound(p, False)) for p in g.parts]
        case _:
            parts = [_write_geometry(b, c) for c in g.children]
    return b.table({7: ("ref", b.offsets(parts)), 6: ("B", code)})


def _write_properties(f: Feature, columns: dict[str, str]) -> bytes:
    out = []
    for i, (k, kind) in enumerate(columns.items()):
        v = f.props.get(k)
        if v is None:
            continue
        out.append(struct.pack("<H", i))
        if kind == "bool":
            out.append(bytes([bool(v)]))
        elif kind in ("long", "double"):
            out.append(struct.pack("<q" if kind == "long" else "<d", v))
        else:
            raw = text_of(v).encode()
            out.append(struct.pack("<I", len(raw)) + raw)
    return b"".join(out)


def common_type(layer: Layer) -> int:
    kinds = {f.geom.kind for f in layer.walk() if f.geom is not None}
    return KINDS.index(kinds.pop()) if len(kinds) == 1 else 0


def write(layer: Layer) -> bytes:
    columns = widened(layer)
    features = list(layer.walk())
    boxes = [x for f in features if f.geom is not None and (x := f.geom.bounds())]
    b = _Builder()
    tables = [b.table({0: ("ref", b.text(name)), 1: ("B", _CODES[kind])}) for name, kind in columns.items()]
    fields: dict[int, tuple[str, Any]] = {2: ("B", common_type(layer)), 8: ("Q", len(features)), 9: ("H", 0)}
    if tables:
        fields[7] = ("ref", b.offsets(tables))
    if boxes:
        fields[1] = ("ref", b.vector("d", [min(x[0] for x in boxes), min(x[1] for x in boxes), max(x[2] for x in boxes), max(x[3] for x in boxes)]))
    out = [MAGIC, b.finish(b.table(fields))]
    for f in features:
        b = _Builder()
        fields = {}
        if f.geom is not None:
            fields[0] = ("ref", _write_geometry(b, f.geom))
        raw = _write_properties(f, columns)
        if raw:
            fields[1] = ("ref", b.vector("B", raw))
        out.append(b.finish(b.table(fields)))
    return b"".join(out)
