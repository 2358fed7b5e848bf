"""GeoParquet files as single files; ``sources.geoparquet`` reads and writes them as Spark tables."""

from __future__ import annotations

import io
import json
from typing import Any

import pyarrow as pa
import pyarrow.parquet as pq

from ..errors import GeoError
from . import wkb
from .base import Feature, Layer, text_of, widened

_ARROW = {"bool": pa.bool_(), "long": pa.int64(), "double": pa.float64(), "string": pa.string()}


def geo_of(metadata: dict | None) -> dict:
    """The ``geo`` entry of a file's key-value metadata, checked."""
    raw = (metadata or {}).get(b"geo")
    if raw is None:
        raise GeoError("Parquet file without geo metadata")
    geo = json.loads(raw)
    name = geo.get("primary_column")
    column = geo.get("columns", {}).get(name)
    if name is None or column is None:
        raise GeoError("geo metadata without a primary column")
    if str(column.get("encoding", "")).upper() != "WKB":
        raise GeoError(f"geometry encoding {column.get('encoding')}")
    return geo


def geo_metadata(types: list[str], box: tuple | None, column: str = "geometry") -> bytes:
    entry: dict[str, Any] = {"encoding": "WKB", "geometry_types": sorted(set(types))}
    if box:
        entry["bbox"] = list(box)
    return json.dumps({"version": "1.1.0", "primary_column": column, "columns": {column: entry}}).encode()


def read(data: bytes) -> Layer:
    if data[:4] != b"PAR1" or data[-4:] != b"PAR1":
        raise GeoError("not a Parquet file")
    f = pq.ParquetFile(io.BytesIO(data))
    name = geo_of(f.schema_arrow.metadata)["primary_column"]
    if name not in f.schema_arrow.names:
        raise GeoError(f"no column {name}")
    found = []
    for group in range(f.num_row_groups):
        for row in f.read_row_group(group).to_pylist():
            raw = row.pop(name)
            found.append(Feature(wkb.parse(raw) if raw is not None else None, {k: v.decode("utf-8", "replace") if isinstance(v, bytes) else v for k, v in row.items() if v is not None}))
    return Layer(features=found)


def write(layer: Layer, compression: str = "snappy", level: int | None = None) -> bytes:
    codec = compression.lower()
    if codec not in ("snappy", "gzip", "none", "uncompressed"):
        raise GeoError(f"cannot write {compression} Parquet")
    kinds, features = widened(layer), list(layer.walk())
    convert = {"bool": bool, "long": int, "double": float, "string": text_of}
    column = "geometry"
    while column in kinds:
        column = "_" + column
    arrays = [pa.array([None if f.geom is None else wkb.dump(f.geom) for f in features], pa.binary())]
    for k, kind in kinds.items():
        arrays.append(pa.array([None if f.props.get(k) is None else convert[kind](f.props[k]) for f in features], _ARROW[kind]))
    boxes = [b for f in features if f.geom is not None and (b := f.geom.bounds())]
    box = (min(b[0] for b in boxes), min(b[1] for b in boxes), max(b[2] for b in boxes), max(b[3] for b in boxes)) if boxes else None
    schema = pa.schema([pa.field(n, a.type) for n, a in zip([column, *kinds], arrays, strict=True)], metadata={b"geo": geo_metadata([f.geom.kind for f in features if f.geom is not None], box, column)})
    held = io.BytesIO()
    with pq.ParquetWriter(held, schema, compression=None if codec in ("none", "uncompressed") else codec, compression_level=level) as w:
        if features:
            w.write_table(pa.Table.from_arrays(arrays, schema=schema))
    return held.getvalue()
