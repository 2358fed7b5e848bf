"""XML without DTDs: elements by local name."""

from __future__ import annotations

import xml.etree.ElementTree as ET
from xml.parsers import expat

from ..errors import GeoError


def parse(data: bytes, what: str) -> ET.Element:
    """The root element. Document types, and so entities, are refused before anything is expanded."""

    def refuse(*_):
        raise GeoError(f"{what} with a document type")

    try:
        guard = expat.ParserCreate()
        guard.StartDoctypeDeclHandler = refuse
        guard.Parse(data, True)
        return ET.fromstring(data)
    except (ET.ParseError, expat.ExpatError) as e:
        raise GeoError(f"invalid {what}: {e}") from e


def local(e: ET.Element) -> str:
    return e.tag.rpartition("}")[2]


def kids(e: ET.Element, *names: str) -> list[ET.Element]:
    return [c for c in e if not names or local(c) in names]


def text(e: ET.Element | None) -> str:
    return "".join(e.itertext()) if e is not None else ""


def write(root: ET.Element) -> bytes:
    ET.indent(root)
    return b'<?xml version="1.0" encoding="utf-8"?>\n' + ET.tostring(root, encoding="unicode").encode()
