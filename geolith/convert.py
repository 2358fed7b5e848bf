"""Read, write, convert: the whole of the library in three calls."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .formats import detect
from .plans.render import Options, render_png
from .sources.files import _put, read_files, read_layers, write_files


def read(spark: SparkSession, path: str, fmt: str | None = None, **options) -> DataFrame:
    return read_files(spark, path, fmt, **options)


def write(df: DataFrame, path: str, fmt: str | None = None, **options) -> None:
    fmt = fmt or detect(path)
    if fmt == "png":
        data = render_png(df, options.get("options") or Options())  # before any file is made
        _put(path, data)
    else:
        write_files(df, path, fmt, **options)


def convert(spark: SparkSession, source: str, target: str, source_format: str | None = None, target_format: str | None = None, **options) -> None:
    """Both formats come from the extensions unless they are given. Layers, empty ones too, go along."""
    source_format, target_format = source_format or detect(source), target_format or detect(target)
    df = read(spark, source, source_format)
    if target_format != "png" and source_format in ("kml", "kmz", "topojson", "gpx"):
        options["layers"] = [r.asDict(recursive=True) for r in read_layers(spark, source, source_format).collect()]  # a row per layer
    write(df, target, target_format, **options)
