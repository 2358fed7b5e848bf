"""The formats as Spark data sources: ``spark.read.format("geo_kml").load(path)``, ``df.write.format("geo_kml").save(path)``.

One input partition per file; files are found and opened with pyarrow's file systems, on the executors. Each write task makes one file.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.pandas.types import to_arrow_schema

from .. import model
from ..codecs import shapefile
from ..codecs.base import Layer, layer_of
from ..errors import GeoError
from ..formats import FORMATS, Format
from .files import _put, batch_of, decode, encode, rows_of, whole_rows


def _open(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pyarrow.fs.LocalFileSystem(), path)


def _bytes(path: str) -> bytes | None:
    fs, inner = _open(path)
    if fs.get_file_info(inner).type != pyarrow.fs.FileType.File:
        return None
    with fs.open_input_stream(inner) as f:
        return f.read()


class _Reader(DataSourceReader):
    def __init__(self, fmt: Format, path: str):
        self.fmt, self.path = fmt, path

    def partitions(self) -> list[InputPartition]:
        fs, inner = _open(self.path)
        info = fs.get_file_info(inner)
        if info.type == pyarrow.fs.FileType.NotFound:
            raise GeoError(f"no such file: {self.path}")
        if info.is_file:
            return [InputPartition(self.path)]
        found = sorted(i.path for i in fs.get_file_info(pyarrow.fs.FileSelector(inner)) if i.is_file and i.path.lower().endswith(self.fmt.extensions))
        prefix = self.path[: len(self.path) - len(inner)] if self.path.endswith(inner) else ""
        return [InputPartition(prefix + p) for p in found]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        path = partition.value
        if self.fmt.name == "shapefile":
            base = path[:-4]
            layer = shapefile.read(_bytes(path), _bytes(base + ".dbf"), _bytes(base + ".cpg"))
        else:
            layer = decode(self.fmt.name, _bytes(path))
        rows, schema = whole_rows(layer, path), to_arrow_schema(model.schema(model.FEATURE))
        for a in range(0, len(rows), 5000):
            yield batch_of(rows[a : a + 5000], schema)


class _Writer(DataSourceArrowWriter):
    def __init__(self, fmt: Format, path: str):
        self.fmt, self.path = fmt, path

    def write(self, batches: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        from pyspark import TaskContext

        rows = [r for b in batches for r in rows_of(b)]
        if rows:
            layer = layer_of(rows)
            base = f"{self.path.rstrip('/')}/part-{TaskContext.get().partitionId():05d}"
            files = shapefile.write(Layer(features=list(layer.walk()))) if self.fmt.name == "shapefile" else {self.fmt.extensions[0][1:]: encode(self.fmt.name, layer)}
            for ext, data in files.items():
                _put(f"{base}.{ext}", data)
        return WriterCommitMessage()


def _source(fmt: Format) -> type[DataSource]:
    class Source(DataSource):
        @classmethod
        def name(cls) -> str:
            return f"geo_{fmt.name}"

        def schema(self):
            return model.schema(model.FEATURE)

        def reader(self, schema):
            return _Reader(fmt, self.options["path"])

        def writer(self, schema, overwrite):
            return _Writer(fmt, self.options["path"])

    Source.__name__ = Source.__qualname__ = f"Geo{fmt.name.title()}"
    return Source


def register(spark: SparkSession) -> None:
    from ..session import ship

    ship(spark)
    for f in FORMATS:
        if f.reads:
            spark.dataSource.register(_source(f))
