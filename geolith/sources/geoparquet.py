"""GeoParquet as Spark tables: Spark's own reader, so filters and columns reach the scan; footers give the geometry column."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.parquet as pq
from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..codecs.geoparquet import geo_metadata, geo_of
from ..errors import GeoError
from ..functions import geometry as G
from ..functions.udfs import st_asbinary, st_geomfromwkb
from ..session import ship


def footer(spark: SparkSession, path: str) -> dict:
    """The ``geo`` entry of one of the files. Parquet's own reader fetches the footer alone, whatever the size of the file."""
    one = spark.read.format("binaryFile").load(path).where("lower(path) LIKE '%parquet'").select("path").first()  # lists; contents are not read
    if one is None:
        raise GeoError(f"no Parquet file in {path}")
    jvm, conf = spark._jvm, spark._jsparkSession.sessionState().newHadoopConf()
    try:
        reader = jvm.org.apache.parquet.hadoop.ParquetFileReader.open(jvm.org.apache.parquet.hadoop.util.HadoopInputFile.fromPath(jvm.org.apache.hadoop.fs.Path(one["path"]), conf))
    except Py4JJavaError as e:
        raise GeoError("not a Parquet file") from e
    try:
        geo = reader.getFooter().getFileMetaData().getKeyValueMetaData().get("geo")
    finally:
        reader.close()
    return geo_of(None if geo is None else {b"geo": geo.encode()})


def read_geoparquet(spark: SparkSession, path: str, column: str | None = None) -> DataFrame:
    """Typed columns and ``geom``. Columns minx, miny, maxx, maxy, if the writer left them, take pushed filters (``operators.spatial.bbox_filter``)."""
    ship(spark)
    column = column or footer(spark, path)["primary_column"]
    return spark.read.parquet(path).withColumn("geom", st_geomfromwkb(F.col(column))).drop(column)


def write_geoparquet(df: DataFrame, path: str, geom: str = "geom", compression: str = "snappy", bbox_columns: bool = True) -> None:
    """One file per partition below ``path``, each with its own types and bounds in the ``geo`` entry of its footer.

    Spark's writer cannot set footer keys, so tasks write with pyarrow, a row group per batch.
    """
    import pyarrow.fs

    if compression.lower() not in ("snappy", "gzip", "none", "uncompressed"):
        raise GeoError(f"cannot write {compression} Parquet")
    ship(df.sparkSession)
    e = G.bounds(F.col(geom))
    rows = df.withColumns({"_type": F.col(f"{geom}.type"), "_box": e, "geometry": st_asbinary(F.col(geom))})
    if bbox_columns:
        rows = rows.withColumns({c: F.col(f"_box.{c}") for c in ("minx", "miny", "maxx", "maxy")})
    rows = rows.drop(geom)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        writer, sink, types, boxes, n = None, None, set(), [], 0
        target = f"{path.rstrip('/')}/part-{TaskContext.get().partitionId():05d}.parquet"
        fs, inner = pyarrow.fs.FileSystem.from_uri(target) if "://" in target or target.startswith("file:") else (pyarrow.fs.LocalFileSystem(), target)
        for b in batches:
            types |= set(b.column("_type").drop_null().to_pylist())
            boxes += [x for x in b.column("_box").to_pylist() if x]
            boxes = [{k: f(x[k] for x in boxes) for k, f in (("minx", min), ("miny", min), ("maxx", max), ("maxy", max))}] if boxes else []
            table = pa.Table.from_batches([b]).drop_columns(["_type", "_box"])
            if writer is None:
                fs.create_dir(inner.rpartition("/")[0], recursive=True)
                sink = fs.open_output_stream(inner)
                writer = pq.ParquetWriter(sink, table.schema.remove_metadata(), compression=None if compression.lower() in ("none", "uncompressed") else compression.lower())
            writer.write_table(table.cast(writer.schema))
            n += b.num_rows
        if writer is not None:
            writer.add_key_value_metadata({"geo": geo_metadata(list(types), tuple(boxes[0].values()) if boxes else None)})
            writer.close()
            sink.close()
            yield pa.RecordBatch.from_arrays([pa.array([n])], ["n"])

    rows.mapInArrow(run, "n long").agg(F.sum("n")).first()
