"""Session helpers and small column expressions that the operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_root

#: The characters that end a word: space and U+0009 to U+000D.
WORD_BREAKS = "\x20\x09\x0a\x0b\x0c\x0d"
#: The same as a regular expression of Java and DuckDB.
WORD_BREAK_RE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder the cluster names; a local session that names none (tests) gets its own, a cluster an error."""
    context = spark.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(shared_root(spark))
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """df written to the shared checkpoint folder: lineage ends here and survives lost executors."""
    checkpoint_root(df.sparkSession)
    return df.checkpoint(eager=True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def words(text: Column) -> Column:
    """The words of a text, in order; an array without nulls or empty strings."""
    return F.filter(F.split(text, WORD_BREAK_RE), lambda w: w != "")


def shielded(docs: DataFrame, added: tuple[str, ...] = ()) -> tuple[DataFrame, dict[str, str]]:
    """docs without columns named as ``added`` ones (those replace them), and with columns that begin like ours (``g_``) under other names.

    The second value tells what ``unshielded`` gives back.
    """
    docs = docs.drop(*[c for c in docs.columns if c.lower() in added])
    names = {c: f"own{i}_{c}" for i, c in enumerate(docs.columns) if c.lower().startswith("g_")}
    return docs.withColumnsRenamed(names), {v: k for k, v in names.items()}


def unshielded(df: DataFrame, names: dict[str, str]) -> DataFrame:
    return df.withColumnsRenamed(names)
