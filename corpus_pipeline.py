"""The corpus pipeline: five stages over ``documents``, each the whole of what the one before kept.

Each stage takes (spark, docs, sf_dir), applies one operator of ``geolith.llm`` and lets its decision take effect; all but the last
return the columns of documents. ``run`` writes each stage as Parquet under the checkpoint folder and reads it as the next one's docs.
"""

from __future__ import annotations

import functools
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from geolith.llm import mixing, packing, quality_model, simhash, substring_dedup
from geolith.llm.common import checkpoint_root, shielded, table, unshielded

#: SQL has neither boosted trees nor these hashes; tests/llm compares the stages with plain versions.
ORACLE_SQL = None


def stage(f):
    """Columns of docs that begin like those that stages add for themselves are out of their way meanwhile."""

    @functools.wraps(f)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        docs, names = shielded(docs)
        return unshielded(f(spark, docs, sf_dir), names)

    return run


@stage
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores at its threshold or over stay; the others go."""
    scored = quality_model.score(docs, quality_model.train(docs, table(spark, sf_dir, "labels")))
    return scored.where(F.col("g_score") >= quality_model.THRESHOLD).drop("g_score")


@stage
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near copies one row stays: that with the smallest doc_id; of those the one with the smallest text hash; of those the first by all its columns.

    Documents without a doc_id have no place in that order and stay; those without a word are no copies of each other and stay.
    """
    counted = F.col("doc_id").isNotNull() & F.coalesce(F.trim(F.translate("text", "\t\n\x0b\x0c\r", "     ")) != "", F.lit(False))
    classes = simhash.near_classes_wide(docs.where(counted).select("doc_id", "text"))
    first = (F.col("doc_id") == F.col("component_id")) & (F.col("tag") == F.col("first_tag"))
    gone = classes.where(~first).select(F.col("doc_id").alias("g_id"), F.col("tag").alias("g_tag"))  # texts of one doc_id are judged apart
    tagged = docs.where(counted).withColumn("g_hash", F.xxhash64("text"))
    kept = tagged.join(gone, (F.col("doc_id") == F.col("g_id")) & (F.col("g_hash") == F.col("g_tag")), "left_anti")
    place = F.row_number().over(Window.partitionBy("doc_id", "g_hash").orderBy(F.xxhash64(*docs.columns)))
    return kept.withColumn("g_place", place).where("g_place = 1").select(docs.columns).unionByName(docs.where(~counted))


@stage
def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words in windows of 50 that a smaller doc_id has too are cut; a text that loses none stays as it is."""
    cut = substring_dedup.remove_repeats(docs)
    text = F.when(F.col("n_removed") > 0, F.col("kept")).otherwise(F.col("text"))
    return cut.withColumn("text", text).withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)).select(docs.columns)


@stage
def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, in the order of its training positions."""
    keyed = docs.withColumn("g_key", F.xxhash64("text", "source"))
    mixed = mixing.mix(keyed, ["g_key"]).where("epochs > 0").groupBy("doc_id", "g_key").agg(F.max("positions").alias("g_positions")).withColumnRenamed("doc_id", "g_id").withColumnRenamed("g_key", "g_text")
    taken = keyed.join(mixed, F.col("doc_id").eqNullSafe(F.col("g_id")) & (F.col("g_key") == F.col("g_text")))
    return taken.select(*docs.columns, F.explode("g_positions").alias("g_position")).orderBy("g_position", "doc_id").select(docs.columns)


@stage
def best_fit(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document lies in the training sequences."""
    return packing.pack(docs)


STAGES = [
    ("quality classifier", quality),
    ("SimHash near-dedup", near_duplicates),
    ("substring dedup", substrings),
    ("mixing sources", mixture),
    ("best-fit packing", best_fit),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    folder = f"{checkpoint_root(spark)}/pipeline-{uuid.uuid4().hex}"
    for i, (_, step) in enumerate(STAGES):
        step(spark, docs, sf_dir).write.parquet(f"{folder}/{i}")
        docs = spark.read.parquet(f"{folder}/{i}")
    return docs
