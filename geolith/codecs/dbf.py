"""dBASE tables: the attributes of shapefiles."""

from __future__ import annotations

import struct
from dataclasses import dataclass
from typing import Any

from ..errors import GeoError
from .base import _INT, Layer, number, text_of


@dataclass
class Field:
    name: str
    kind: str
    length: int
    decimals: int


def _value(f: Field, raw: str) -> Any:
    s = raw.replace("\0", " ").strip()
    if not s:
        return None
    if f.kind == "L":
        return True if s[0] in "TtYy" else False if s[0] in "FfNn" else None
    if f.kind in "NF":
        if f.decimals == 0 and _INT.fullmatch(s) and -(1 << 63) <= int(s) < 1 << 63:
            return int(s)
        return number(s)
    return s


def read(data: bytes, encoding: str = "latin-1", keep_deleted: bool = False) -> list[dict]:
    """Rows. Those flagged deleted are left out, as the reference layout has it, unless ``keep_deleted``: then pairing with shapes holds."""
    if len(data) < 32:
        raise GeoError("DBF ends too early")
    count, head, width = struct.unpack_from("<IHH", data, 4)
    fields, at = [], 32
    while at + 32 <= len(data) and data[at] != 0x0D:
        fields.append(Field(data[at : at + 11].split(b"\0")[0].decode(encoding), chr(data[at + 11]), data[at + 16], data[at + 17]))
        at += 32
    rows = []
    for i in range(count):
        start = head + i * width
        if start + width > len(data):
            break
        if data[start] == 0x2A and not keep_deleted:
            continue
        row, at = {}, start + 1
        for f in fields:
            row[f.name] = _value(f, data[at : at + f.length].decode(encoding, "replace"))
            at += f.length
        rows.append(row)
    return rows


def unique_names(keys: list[str]) -> list[str]:
    """At most ten characters, unique without regard to case: ``_1`` to ``_999`` after a shorter prefix where needed."""
    used: set[str] = set()
    out = []
    for key in keys:
        options = [key[:10], *(f"{key[: 10 - len(f'_{n}')]}_{n}" for n in range(1, 1000))]
        name = next((o for o in options if o.upper() not in used), None)
        if name is None:
            raise GeoError(f"no unique DBF name for {key!r}")
        used.add(name.upper())
        out.append(name)
    return out


def _decimals(v: Any) -> int:
    if isinstance(v, bool) or isinstance(v, int):
        return 0
    return len(f"{v:.15f}".rstrip("0").partition(".")[2]) if abs(v) < 1e300 else 0


def plan(keys: list[str], layer: Layer) -> list[Field]:
    """L, N or C with length and decimals for each key, by all its values."""
    out = []
    values: dict[str, list] = {k: [] for k in keys}
    for f in layer.walk():
        for k, v in f.props.items():
            if v is not None and k in values:
                values[k].append(v)
    for name, key in zip(unique_names(keys), keys, strict=True):
        vs = values[key]
        longest = max((len(text_of(v)) for v in vs), default=0)
        clamp = lambda n, lo, hi: max(lo, min(n, hi))
        if vs and all(isinstance(v, bool) for v in vs):
            out.append(Field(name, "L", 1, 0))
        elif vs and all(isinstance(v, int) and not isinstance(v, bool) for v in vs):
            out.append(Field(name, "N", clamp(longest, 1, 18), 0))
        elif vs and all(isinstance(v, int | float) and not isinstance(v, bool) for v in vs):
            decimals = min(max(map(_decimals, vs)), 15)
            out.append(Field(name, "N", clamp(longest, decimals + 2, 19), decimals))
        else:
            out.append(Field(name, "C", clamp(longest, 1, 254), 0))
    return out


def _cell(f: Field, v: Any) -> bytes:
    if f.kind == "L":
        return b"?" if not isinstance(v, bool) else b"T" if v else b"F"
    if f.kind == "N":
        s = "" if v is None else f"{float(v):.{f.decimals}f}" if f.decimals else str(int(v))
        return s[: f.length].rjust(f.length).encode("latin-1", "replace")
    return text_of(v)[: f.length].ljust(f.length).encode("latin-1", "replace")


def write(keys: list[str], layer: Layer) -> bytes:
    fields = plan(keys, layer)
    features = list(layer.walk())
    head, width = 32 + 32 * len(fields) + 1, 1 + sum(f.length for f in fields)
    out = [struct.pack("<BBBBIHH20x", 3, 80, 1, 1, len(features), head, width)]
    out += [struct.pack("<11sc4xBB14x", f.name.encode("latin-1", "replace"), f.kind.encode(), f.length, f.decimals) for f in fields]
    out.append(b"\r")
    for x in features:
        out.append(b" " + b"".join(_cell(f, x.props.get(k)) for f, k in zip(fields, keys, strict=True)))
    out.append(b"\x1a")
    return b"".join(out)
