"""Files of every format as feature rows, and feature rows as files."""

from __future__ import annotations

import posixpath
import uuid
from collections.abc import Callable, Iterable, Iterator
from itertools import groupby

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from .. import model
from ..codecs import columnar, csvgeo, flatgeobuf, geojson, geoparquet, gpx, kml, shapefile, topojson, wkb, wkt
from ..codecs.base import Feature, Geom, Layer, feature_of, feature_row, feature_rows, layer_of, layer_rows
from ..codecs.stream import Spool, planned
from ..errors import GeoError
from ..formats import BY_NAME, detect
from ..session import ship

READERS: dict[str, Callable[[bytes], Layer]] = {
    "geojson": geojson.read, "topojson": topojson.read, "flatgeobuf": flatgeobuf.read, "kml": kml.read, "kmz": kml.read_kmz,
    "gpx": gpx.read, "wkt": wkt.read, "wkb": wkb.read, "csv": csvgeo.read, "geoparquet": geoparquet.read,
}
WRITERS: dict[str, Callable[..., bytes]] = {
    "geojson": geojson.write, "topojson": topojson.write, "flatgeobuf": flatgeobuf.write, "kml": kml.write, "kmz": kml.write_kmz,
    "gpx": gpx.write, "wkt": wkt.write, "wkb": wkb.write, "csv": csvgeo.write, "geoparquet": geoparquet.write,
}
#: Formats whose documents are read and written piece by piece: texts of features in chunks of bytes, the feature of a text, what most ends a piece.
STREAMS: dict[str, tuple[Callable[[Iterable[bytes]], Iterator[tuple]], Callable[[str], Feature], str]] = {"geojson": (geojson.features, geojson.one, "}"), "kml": (kml.features, kml.one, "Placemark"), "topojson": (topojson.features, topojson.one, "]")}
#: A feature's text, made in any task, and the text of a document of them, made in one.
DOCUMENTS: dict[str, tuple[Callable, Callable]] = {"geojson": (geojson.fragment, geojson.document), "kml": (kml.fragment, kml.document), "topojson": (topojson.fragment, topojson.document)}
MODES = ("FAILFAST", "PERMISSIVE", "DROPMALFORMED")


def decode(fmt: str, data: bytes) -> Layer:
    """The layer that the bytes of one file hold. Whatever a parser raises on bad data becomes one kind of error."""
    if fmt not in READERS:
        raise GeoError(f"{fmt} cannot be read from a stream")
    try:
        return READERS[fmt](data)
    except GeoError:
        raise
    except Exception as e:
        raise GeoError(f"invalid {fmt}: {e}") from e


def encode(fmt: str, layer: Layer, **options) -> bytes:
    if fmt not in WRITERS:
        raise GeoError(f"{fmt} cannot be written to a stream")
    return WRITERS[fmt](layer, **options)


def batch_of(rows: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    """Rows as a batch; the geometry column goes in whole."""
    if "geom" not in schema.names:
        return pa.RecordBatch.from_pylist(rows, schema)
    plain = pa.schema([f for f in schema if f.name != "geom"])
    rest = pa.RecordBatch.from_pylist([{k: v for k, v in r.items() if k != "geom"} for r in rows], plain)
    geom = columnar.column([r.get("geom") for r in rows]).cast(schema.field("geom").type)
    return pa.RecordBatch.from_arrays([geom if f.name == "geom" else rest.column(f.name) for f in schema], schema=schema)


def _vertices(g: Geom | None) -> int:
    return 0 if g is None else sum(len(ring) for part in g.parts for ring in part) + sum(_vertices(c) for c in g.children)


def batches_of(rows: Iterable[dict], schema: pa.Schema, most: int = 100_000) -> Iterator[pa.RecordBatch]:
    """Rows as batches of so many rows and vertices."""
    held, size = [], 0
    for r in rows:
        held.append(r)
        size += 1 + _vertices(r["geom"])
        if size >= most:
            yield batch_of(held, schema)
            held, size = [], 0
    if held:
        yield batch_of(held, schema)


def _slices(batches: Iterable[pa.RecordBatch], most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Batches of about so many bytes or of one row."""
    for b in batches:
        step = max(1, b.num_rows * most // max(most, b.nbytes))
        for a in range(0, b.num_rows, step):
            yield b.slice(a, step)


def rows_of(batch: pa.RecordBatch) -> list[dict]:
    """Rows of a batch, geometries as geometries."""
    rows = batch.drop_columns(["geom"]).to_pylist() if batch.num_columns > 1 else [{} for _ in range(batch.num_rows)]
    for r, g in zip(rows, columnar.geometries(batch.column("geom")), strict=True):
        r["geom"] = g
    return rows


def _stem(path: str) -> str:
    return posixpath.splitext(posixpath.basename(path))[0]


def _shapefiles(path: str) -> str:
    base = path if not path.lower().endswith(".shp") else path[:-4]
    return f"{base.rstrip('/')}/*.{{shp,dbf,cpg,SHP,DBF,CPG}}" if base == path else f"{base}.{{shp,dbf,cpg,SHP,DBF,CPG}}"


def _contents(spark: SparkSession, path: str, fmt: str) -> DataFrame:
    """path, parts: the files that make up each source, by extension."""
    if fmt != "shapefile":
        return spark.read.format("binaryFile").load(path).select("path", F.create_map(F.lit(fmt), F.col("content")).alias("parts"))
    files = spark.read.format("binaryFile").load(_shapefiles(path))
    ext = F.lower(F.element_at(F.split("path", r"\."), -1))
    named = files.select(F.regexp_replace("path", r"\.[^.]*$", "").alias("base"), F.struct(ext.alias("k"), F.col("content").alias("v")).alias("part"))
    grouped = named.groupBy("base").agg(F.map_from_entries(F.collect_list("part")).alias("parts"))
    return grouped.where(F.map_contains_key("parts", "shp")).select(F.concat("base", F.lit(".shp")).alias("path"), "parts")


def _pieces(spark: SparkSession, path: str, sep: str) -> DataFrame:
    """path, size, value: the files of a path cut at sep, the pieces of each in order in one task. No cell holds a whole file."""
    meta = lambda name: F.col(f"_metadata.{name}")
    cut = spark.read.text(path, lineSep=sep).select(F.url_decode(F.replace(meta("file_path"), F.lit("+"), F.lit("%2B"))).alias("path"), meta("file_size").alias("size"), meta("file_block_start").alias("start"), F.monotonically_increasing_id().alias("n"), F.col("value").cast("binary"))
    out = model.schema("path string, size bigint, start bigint, n bigint, value binary")
    arrow, end = to_arrow_schema(out), sep.encode()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:  # a batch has few files' pieces, and a piece may be some bytes
        for b in _slices(batches):
            heads = b.select(["path", "size", "start", "n"])
            first, last = heads.slice(0, 1).to_pylist()[0], heads.slice(b.num_rows - 1).to_pylist()[0]
            values = b.column("value").to_pylist()
            if (first["path"], first["start"]) == (last["path"], last["start"]):
                found = [first | {"value": end.join(values)}]
            else:
                rows = zip(heads.to_pylist(), values, strict=True)
                found = []
                for _, group in groupby(rows, key=lambda r: (r[0]["path"], r[0]["start"])):
                    held = list(group)
                    found.append(held[0][0] | {"value": end.join(v for _, v in held)})
            yield pa.RecordBatch.from_pylist(found, arrow)

    if sep == "]":  # pieces are as small as positions
        cut = cut.mapInArrow(merge, out)
    return cut.repartition("path").sortWithinPartitions("path", "start", "n").select("path", "size", "value")


def _documents(batches: Iterator[pa.RecordBatch], sep: bytes) -> Iterator[tuple[str, Iterator[bytes]]]:
    """The path and the bytes of each file, in chunks."""

    def parts() -> Iterator[tuple[str, int, list[bytes]]]:
        for b in _slices(batches):
            rows = zip(b.column("path").to_pylist(), b.column("size").to_pylist(), b.column("value").to_pylist(), strict=True)
            for (one, size), found in groupby(rows, key=lambda r: r[:2]):
                yield one, size, [r[2] for r in found]

    def chunks(found: Iterator[tuple[str, int, list[bytes]]]) -> Iterator[bytes]:
        read, start = 0, b""
        for _, size, values in found:
            data = start + sep.join(values)
            read, start = read + len(data), sep
            yield data
        if size - read in (len(sep), len(sep) + 3):  # the file ends with it; Spark passes over a byte order mark
            read += len(sep)
            yield sep
        if size - read not in (0, 3):
            raise GeoError(f"{read} of {size} bytes read")

    for one, found in groupby(parts(), key=lambda p: p[0]):
        yield one, chunks(found)


def _guarded(fmt: str, found: Iterator) -> Iterator:
    try:
        yield from found
    except GeoError:
        raise
    except Exception as e:
        raise GeoError(f"invalid {fmt}: {e}") from e


def _read_stream(spark: SparkSession, path: str, fmt: str, mode: str, out, arrow: pa.Schema) -> DataFrame:
    """One task a file finds where its features are; their texts are dealt out and read in any task."""
    split, parse, sep = STREAMS[fmt]
    cut = model.schema("source_file string, layer_path array<string>, layer_ord array<int>, seq bigint, text string, _corrupt string")
    text_arrow = to_arrow_schema(cut)

    def row(r: dict) -> dict:
        try:
            return feature_row(parse(r["text"]), r["source_file"], r["layer_path"], r["layer_ord"], r["seq"], lambda g: g)
        except GeoError:
            raise
        except Exception as e:
            raise GeoError(f"invalid {fmt}: {e}") from e

    def texts(one: str, chunks: Iterator[bytes]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for order, names, seq, text in _guarded(fmt, split(chunks)):
            r = {"source_file": one, "layer_path": names, "layer_ord": order, "seq": seq, "text": text}
            if mode != "FAILFAST":
                row(r)  # a file counts as a whole or not at all
            held.append(r)
            size += 200 + len(text)
            if size > 4 << 20:
                yield pa.RecordBatch.from_pylist(held, text_arrow)
                held, size = [], 0
        if held:
            yield pa.RecordBatch.from_pylist(held, text_arrow)

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for one, chunks in _documents(batches, sep.encode()):
            if mode == "FAILFAST":
                yield from texts(one, chunks)
                continue
            held = Spool(1)
            try:
                for b in texts(one, chunks):
                    held.add(b)
            except GeoError as e:
                if mode == "PERMISSIVE":
                    yield pa.RecordBatch.from_pylist([{"source_file": one, "_corrupt": str(e)}], text_arrow)
                continue
            yield from held

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _slices(batches):
            found = b.to_pylist()
            yield from batches_of((row(r) for r in found if r["text"] is not None), arrow)
            if bad := [{"source_file": r["source_file"], "_corrupt": r["_corrupt"]} for r in found if r["text"] is None]:
                yield pa.RecordBatch.from_pylist(bad, arrow)

    return _pieces(spark, path, sep).mapInArrow(pieces, cut).repartition("source_file", "seq").mapInArrow(features, out)


def _layer(fmt: str, path: str, parts: dict, compat: bool) -> Layer:
    if fmt != "shapefile":
        return decode(fmt, parts[fmt])
    try:
        return shapefile.read(parts["shp"], parts.get("dbf"), parts.get("cpg"), compat)
    except GeoError:
        raise
    except Exception as e:
        raise GeoError(f"invalid shapefile {path}: {e}") from e


def _parsed(spark: SparkSession, path: str, fmt: str | None, schema: str, rows: Callable, mode: str, compat: bool) -> DataFrame:
    fmt = fmt or detect(path)
    if fmt not in BY_NAME or not BY_NAME[fmt].reads:
        raise GeoError(f"{fmt} cannot be read")
    if mode not in MODES:
        raise GeoError(f"mode {mode}")
    ship(spark)
    out = model.schema(schema + (", _corrupt string" if mode == "PERMISSIVE" else ""))
    arrow = to_arrow_schema(out)
    directory = fmt == "shapefile" and not path.lower().endswith(".shp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for one, parts in zip(b.column("path").to_pylist(), b.column("parts").to_pylist(), strict=True):
                try:
                    found = rows(_layer(fmt, one, dict(parts), compat), one)
                except GeoError as e:
                    if mode == "FAILFAST":
                        raise
                    if mode == "PERMISSIVE":
                        yield pa.RecordBatch.from_pylist([{"source_file": one, "_corrupt": str(e)}], arrow)
                    continue
                if directory:
                    for r in found:
                        r["layer_path"] = [_stem(one), *(r.get("layer_path") or [])]
                for a in range(0, len(found), 5000):
                    yield batch_of(found[a : a + 5000], arrow)

    if fmt in STREAMS and rows is whole_rows:
        return _read_stream(spark, path, fmt, mode, out, arrow)
    return _contents(spark, path, fmt).mapInArrow(run, out)


def whole_rows(layer: Layer, source: str) -> list[dict]:
    return feature_rows(layer, source, geom=lambda g: g)


def read_files(spark: SparkSession, path: str, fmt: str | None = None, mode: str = "FAILFAST", compat_deleted_shift: bool = True) -> DataFrame:
    """Feature rows of a file, a folder or a glob. Modes: FAILFAST raises, PERMISSIVE gives a row with ``_corrupt``, DROPMALFORMED passes over the file.

    Files of a shapefile folder are layers named by file, ordered by name when they are written or walked.
    """
    found = _parsed(spark, path, fmt, model.FEATURE, whole_rows, mode, compat_deleted_shift)
    if (fmt or detect(path)) == "shapefile" and not path.lower().endswith(".shp"):
        listed = spark.read.format("binaryFile").load(_shapefiles(path)).select("path").where("lower(path) LIKE '%.shp'")  # lists; contents are not read
        names = listed.select(F.regexp_replace("path", r"\.[^.]*$", ".shp").alias("source_file")).withColumn("_i", F.expr("row_number() OVER (ORDER BY source_file) - 1").cast("int"))  # a row per file
        found = found.join(F.broadcast(names), "source_file").withColumn("layer_ord", F.concat(F.array("_i"), F.coalesce("layer_ord", F.array().cast("array<int>")))).drop("_i")
    return found


def read_layers(spark: SparkSession, path: str, fmt: str | None = None) -> DataFrame:
    """A row per layer, so that empty layers, names and descriptions are kept."""
    return _parsed(spark, path, fmt, model.LAYER, layer_rows, "FAILFAST", True)


def _place(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    fs, inner = pyarrow.fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pyarrow.fs.LocalFileSystem(), path)
    fs.create_dir(posixpath.dirname(inner) or ".", recursive=True)
    return fs, inner


def _put(path: str, data: bytes) -> None:
    fs, inner = _place(path)
    with fs.open_output_stream(inner) as f:
        f.write(data)


def _put_pieces(path: str, pieces: Iterable[str]) -> int:
    """Write pieces of text; the file gets its name when all are written, so a failure leaves no part of one. Returns the bytes."""
    fs, inner = _place(path)
    folder, name = posixpath.split(inner)
    made, size = posixpath.join(folder, f".{name}.{uuid.uuid4().hex}"), 0
    try:
        with fs.open_output_stream(made) as f:
            for text in pieces:
                size += f.write(data := text.encode()) or len(data)
        if fs.type_name != "local" and fs.get_file_info(inner).type != pyarrow.fs.FileType.NotFound:
            fs.delete_file(inner)  # a local one is replaced
        fs.move(made, inner)
    except BaseException:
        if fs.get_file_info(made).type != pyarrow.fs.FileType.NotFound:
            fs.delete_file(made)
        raise
    return size


def _write_document(df: DataFrame, path: str, fmt: str, known: list[dict]) -> DataFrame:
    """One document: features become text where they are, and one task joins the texts in order."""
    fragment, document = DOCUMENTS[fmt]

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _slices(batches):
            found = []
            for r in rows_of(b):
                order = r.get("layer_ord") or []
                head, tail = fragment(feature_of(r), len(order))
                found.append({"layer_ord": order, "layer_path": r.get("layer_path"), "seq": r.get("seq") or 0, "head": head, "tail": tail})
            yield pa.RecordBatch.from_pylist(found, arrow)

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = 0

        def rows() -> Iterator[tuple]:
            nonlocal n
            for b in batches:
                for r in b.to_pylist():
                    n += 1
                    yield r["layer_ord"], r["layer_path"], (r["head"], r["tail"])

        layer = layer_of([], known)
        size = _put_pieces(path, document(layer, planned(rows(), layer)))
        yield pa.RecordBatch.from_pylist([{"path": path, "bytes": size, "features": n}], pa.schema([("path", pa.string()), ("bytes", pa.int64()), ("features", pa.int64())]))

    out = model.schema("layer_ord array<int>, layer_path array<string>, seq long, head string, tail string")
    arrow = to_arrow_schema(out)
    return df.repartition("layer_ord", "seq").mapInArrow(texts, out).repartition(1).sortWithinPartitions("layer_ord", "seq").mapInArrow(join, "path string, bytes long, features long")


def write_files(df: DataFrame, path: str, fmt: str | None = None, layers: list[dict] | None = None, single: bool = True, **options) -> DataFrame:
    """Write feature rows. ``single`` makes one file in the order (layer_ord, seq), in one task, as these formats are one document;
    otherwise each partition becomes a file of its own below ``path``, which is how large tables should go out.

    A file gets its name when all of it is encoded, so a failure leaves no part of a file. Returns path, bytes and features of what was written.
    """
    fmt = fmt or detect(path)
    if fmt not in BY_NAME or not BY_NAME[fmt].writes or fmt == "png":
        raise GeoError(f"{fmt} cannot be written here")
    ship(df.sparkSession)
    known = layers or []
    folder = fmt == "shapefile" and not path.lower().endswith(".shp")
    ext = BY_NAME[fmt].extensions[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        rows = [r for b in batches for r in rows_of(b)]
        if not rows and not single:
            return
        layer = layer_of(rows, known)
        if single:
            target = path
        else:
            target = f"{path.rstrip('/')}/part-{TaskContext.get().partitionId():05d}{ext}"
        if fmt == "shapefile":
            files = shapefile.write_directory(layer) if folder and single else {f"{_stem(target)}.{e}": d for e, d in shapefile.write(Layer(features=list(layer.walk()))).items()}
            base = target.rstrip("/") if folder and single else posixpath.dirname(target)
            out = [(f"{base}/{name}" if base else name, d) for name, d in files.items()]
        else:
            out = [(target, encode(fmt, layer, **options))]
        for name, data in out:
            _put(name, data)
        yield pa.RecordBatch.from_pylist([{"path": n, "bytes": len(d), "features": len(rows)} for n, d in out], pa.schema([("path", pa.string()), ("bytes", pa.int64()), ("features", pa.int64())]))

    ordered = df.repartition(1).sortWithinPartitions("layer_ord", "seq") if single else df
    written = _write_document(df, path, fmt, known) if single and fmt in DOCUMENTS and not options else ordered.mapInArrow(run, "path string, bytes long, features long")
    done = [tuple(r) for r in written.collect()]  # a row per file
    if single and not done:
        raise GeoError("nothing was written")
    return df.sparkSession.createDataFrame(done, "path string, bytes long, features long")
