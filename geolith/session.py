"""Making the package known to the executors."""

from __future__ import annotations

import functools
import io
import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import SparkSession

from .errors import GeoError


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once per application, as Spark does for --py-files."""
    context = spark.sparkContext
    if getattr(context, "_geolith_shipped", False):
        return
    root = Path(__file__).parent
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, f"{root.name}/{p.relative_to(root)}")
    path = os.path.join(tempfile.mkdtemp(prefix="geolith-"), "geolith-package.zip")  # Spark's file server hands it out from here
    Path(path).write_bytes(held.getvalue())
    context.addPyFile(path)
    context._geolith_shipped = True


def shipped(f: Callable) -> Callable:
    @functools.wraps(f)
    def run(spark: SparkSession, sf_dir: str):
        ship(spark)
        return f(spark, sf_dir)

    return run


def shared_root(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names. Only a local session may have none and gets one of this machine: on a cluster others could not see it."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise GeoError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return tempfile.mkdtemp(prefix="geolith-shared-")


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder for intermediate files, below the shared one."""
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df):
    """df written to the checkpoint folder and read from there: its partitions stay as they are, whoever is lost."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(shared_root(df.sparkSession))
    return df.checkpoint(eager=True)
