"""Feature streams: folders watched for new files, and windowed counts over event time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from .. import model
from ..sources.files import batch_of, decode, whole_rows


def watch(spark: SparkSession, folder: str, fmt: str, max_files: int = 100) -> DataFrame:
    """A stream of feature rows from files of one format as they arrive in a folder. Exactly once per file, by Spark's file source."""
    schema = model.schema(model.FEATURE)
    arrow = to_arrow_schema(schema)
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("maxFilesPerTrigger", max_files).load(folder)

    def run(batches):
        for b in batches:
            for path, data in zip(b.column("path").to_pylist(), b.column("content").to_pylist(), strict=True):
                yield batch_of(whole_rows(decode(fmt, data), path), arrow)

    return files.select("path", "content").mapInArrow(run, schema)


def windowed_counts(events: DataFrame, time: str, key: str, width: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Counts per window and key; state older than the watermark is dropped, so it stays bounded."""
    return events.withWatermark(time, late).groupBy(F.window(time, width), key).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), key, "n")
