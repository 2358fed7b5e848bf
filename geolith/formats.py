"""The formats by name, extension and alias."""

from __future__ import annotations

from dataclasses import dataclass

from .errors import GeoError


@dataclass(frozen=True)
class Format:
    name: str
    extensions: tuple[str, ...]
    aliases: tuple[str, ...]
    mime: str
    reads: bool = True
    writes: bool = True
    streams: bool = True  # shapefiles are several files


FORMATS = (
    Format("geojson", (".geojson", ".json"), ("geojson", "json"), "application/geo+json"),
    Format("topojson", (".topojson",), ("topojson", "topo"), "application/json"),
    Format("shapefile", (".shp",), ("shapefile", "shp"), "application/octet-stream", streams=False),
    Format("flatgeobuf", (".fgb",), ("flatgeobuf", "fgb"), "application/octet-stream"),
    Format("kml", (".kml",), ("kml",), "application/vnd.google-earth.kml+xml"),
    Format("kmz", (".kmz",), ("kmz",), "application/vnd.google-earth.kmz"),
    Format("gpx", (".gpx",), ("gpx",), "application/gpx+xml"),
    Format("wkt", (".wkt",), ("wkt",), "text/plain"),
    Format("wkb", (".wkb",), ("wkb",), "application/octet-stream"),
    Format("csv", (".csv",), ("csv",), "text/csv"),
    Format("geoparquet", (".parquet", ".geoparquet"), ("geoparquet", "parquet"), "application/vnd.apache.parquet"),
    Format("png", (".png",), ("png",), "image/png", reads=False),
)
BY_NAME = {f.name: f for f in FORMATS}


def try_detect(path: str) -> str | None:
    lower = path.lower().rstrip("/")
    return next((f.name for f in FORMATS for e in f.extensions if lower.endswith(e)), None)


def detect(path: str) -> str:
    found = try_detect(path)
    if not found:
        raise GeoError(f"cannot tell the format of {path!r} from its extension")
    return found


def named(alias: str) -> str:
    found = next((f.name for f in FORMATS if alias.lower() in f.aliases), None)
    if not found:
        raise GeoError(f"unknown format {alias!r}")
    return found


def catalogue(spark):
    """The formats as a DataFrame."""
    rows = [(f.name, list(f.extensions), list(f.aliases), f.mime, f.reads, f.writes, f.streams) for f in FORMATS]
    return spark.createDataFrame(rows, "name string, extensions array<string>, aliases array<string>, mime string, reads boolean, writes boolean, streams boolean")
