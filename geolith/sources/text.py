"""Line formats that Spark can split: well-known text and CSV."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import model
from ..codecs import csvgeo
from ..functions.text import scalar_infer
from ..functions.udfs import st_geomfromtext


def read_wkt(spark: SparkSession, path: str) -> DataFrame:
    """line, geom: one geometry per line that is not blank. The order of lines is that of the file within a split."""
    lines = spark.read.text(path).select(F.trim("value").alias("line")).where("line <> ''")
    return lines.withColumn("geom", st_geomfromtext(F.col("line")))


def write_wkt(df: DataFrame, path: str, geom: str = "geom") -> None:
    from ..functions.udfs import st_astext

    df.where(F.col(geom).isNotNull()).select(st_astext(F.col(geom)).alias("value")).write.text(path)


def read_csv(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """geom, props: CSV by Spark's own reader, split by lines unless ``multi_line``. Columns are found as ``codecs.csvgeo`` finds them.

    Blank lines are passed over and quotes inside a field are kept, which differs from the exact reader (``sources.files``).
    """
    rows = spark.read.csv(path, header=True, escape='"', multiLine=multi_line, inferSchema=False, enforceSchema=False)
    w, x, y = csvgeo.columns(rows.columns)
    quoted = lambda i: F.col(f"`{rows.columns[i]}`")
    used = {i for i in (w, x, y) if i >= 0} if w >= 0 or (x >= 0 and y >= 0) else set()
    cells = [F.when(F.coalesce(quoted(i), F.lit("")) != "", F.struct(F.lit(c).alias("key"), scalar_infer(quoted(i)).alias("value"))) for i, c in enumerate(rows.columns) if i not in used]
    props = F.array_compact(F.array(*cells)) if cells else F.array()
    if w >= 0:
        geom = st_geomfromtext(F.when(F.trim(quoted(w)) != "", quoted(w)))
    elif used:
        lon, lat = quoted(x).try_cast("double"), quoted(y).try_cast("double")
        geom = F.when(lon.isNotNull() & lat.isNotNull(), model.point(model.position(lon, lat)))
    else:
        geom = F.lit(None).cast(model.GEOMETRY)
    return rows.select(geom.alias("geom"), props.cast(model.PROPERTIES).alias("props"))
