"""CSV with a WKT column, or with x and y columns."""

from __future__ import annotations

from .base import Feature, Layer, keys_of, number, point, text_of
from .base import infer as infer_scalar
from .wkt import dump, parse

WKT_NAMES = ("wkt", "geometry", "geom", "the_geom")
X_NAMES = ("x", "lon", "lng", "long", "longitude")
Y_NAMES = ("y", "lat", "latitude")


def lex(text: str) -> list[list[str]]:
    """Rows of fields. A quote opens or closes anywhere in a field, a doubled one inside is itself; CR, LF or CRLF ends a row."""
    rows: list[list[str]] = []
    row: list[str] = []
    cell: list[str] = []
    quoted, i, n = False, 0, len(text)
    while i < n:
        c = text[i]
        if quoted:
            if c == '"' and text[i + 1 : i + 2] == '"':
                cell.append(c)
                i += 1
            elif c == '"':
                quoted = False
            else:
                cell.append(c)
        elif c == '"':
            quoted = True
        elif c == ",":
            row.append("".join(cell))
            cell = []
        elif c in "\r\n":
            if text[i : i + 2] == "\r\n":
                i += 1
            rows.append([*row, "".join(cell)])
            row, cell = [], []
        else:
            cell.append(c)
        i += 1
    if row or cell:
        rows.append([*row, "".join(cell)])
    return rows


def columns(header: list[str]) -> tuple[int, int, int]:
    """Places of the WKT, x and y columns; -1 where there is none. With WKT, x and y are ordinary."""
    names = [h.strip().lower() for h in header]
    first = lambda wanted: next((i for i, h in enumerate(names) if h in wanted), -1)
    w = first(WKT_NAMES)
    return (w, -1, -1) if w >= 0 else (-1, first(X_NAMES), first(Y_NAMES))


def read(data: bytes) -> Layer:
    rows = lex(data.decode("utf-8-sig"))
    if not rows:
        return Layer()
    header = rows[0]
    w, x, y = columns(header)
    use_xy = x >= 0 and y >= 0
    found = []
    for row in rows[1:]:
        geom = None
        if 0 <= w < len(row) and row[w]:
            geom = parse(row[w])
        elif w < 0 and use_xy:
            a, b = (number(row[i]) if i < len(row) else None for i in (x, y))
            geom = point((a, b, None, None)) if a is not None and b is not None else None
        props = {h: infer_scalar(v) for i, (h, v) in enumerate(zip(header, row, strict=False)) if v != "" and i != w and not (use_xy and i in (x, y))}
        found.append(Feature(geom, props))
    return Layer(features=found)


def escape(field: str) -> str:
    return '"' + field.replace('"', '""') + '"' if any(c in field for c in ',"\n\r') else field


def write(layer: Layer) -> bytes:
    keys = keys_of(layer)
    lines = [["WKT", *keys], *([dump(f.geom) if f.geom else "", *(text_of(f.props.get(k)) for k in keys)] for f in layer.walk())]
    return "".join(",".join(map(escape, r)) + "\n" for r in lines).encode()
