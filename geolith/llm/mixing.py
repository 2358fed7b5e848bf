"""Mixing sources to target weights along a curriculum that changes over training time.

Targets. Each source's target is lambda times its weight, held at ``max_epochs`` times its own size, with lambda such that targets
sum to ``budget`` times all sizes. The closed form: with sources ordered by (cap / weight), the held ones are a prefix.

Taking. A source's target is whole epochs of all its documents plus a remainder: documents in the order of a hash of doc_id, as long
as half or more of the next document fits. The running sum is two-level (sums of 4,096 hash ranges, then rows within a range), so a
source with a third of all rows is spread over as many tasks.

Curriculum. A source's weight over training time t in [0, 1] is a straight line from ``2 - e`` to ``e`` times its mean weight (e = 0.5,
1 or 1.5 as its weight is of the first, second or third kind). Its integral is cumulative token demand; the offset of a document in its
source's stream, inverted through that integral, is the document's training position, and a range sort orders documents by it.

Defined results: a null or empty text has size 0, is taken 0 words and keeps no position; a null source is a source of its own, last in
the order; rows that repeat a doc_id are mixed one by one; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, table, text_or_empty, words

WEIGHTS = (5, 2, 1)
ENDS = (0.5, 1.0, 1.5)
BUDGET = (3, 2)
MAX_EPOCHS = 2
#: Hexadecimal digits of the hash that name a range: 4,096 ranges of each source.
RUN_DIGITS = 3


def _cycle(rank: Column, values: tuple) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (F.pmod(rank - 1, F.lit(len(values))) + 1).cast("int"))


def source_targets(sizes: DataFrame) -> DataFrame:
    """source, source_size, weight, target, ending; a row per source, made from a row per (task, source)."""
    sources = sizes.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    ranked = sources.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    weighed = ranked.withColumn("weight", _cycle(F.col("rank"), WEIGHTS).cast("long")).withColumn("cap", F.col("source_size") * MAX_EPOCHS)
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), "rank")
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    after = by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    whole = F.sum("source_size").over(Window.partitionBy()) * (BUDGET[0] / BUDGET[1])
    level = weighed.withColumn("level", (whole - F.coalesce(F.sum("cap").over(before), F.lit(0))) / F.sum("weight").over(after))
    held = level.withColumn("held", F.col("cap") < F.col("level") * F.col("weight"))  # true for a prefix in this order
    top = F.first(F.when(~F.col("held"), F.col("level")), ignorenulls=True).over(before.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return held.select("source", "source_size", "weight", F.when(F.col("held"), F.col("cap").cast("double")).otherwise(top * F.col("weight")).alias("target"), _cycle(F.col("rank"), ENDS).alias("ending"))


def demand_inverse(y: Column, ending: Column) -> Column:
    """The time t at which (2 - e) t + (e - 1) t^2, the integral of the weight line, reaches y."""
    a, c = 2 - ending, ending - 1
    return F.when(c == 0, y).otherwise((F.sqrt(a * a + 4 * c * y) - a) / (2 * c))


def mix(docs: DataFrame, carry: list[str] | None = None) -> DataFrame:
    """Every document with what the mix takes of it: doc_id, source, size, source_size, target, taken, epochs, positions, and the columns named in carry."""
    carry = carry or []
    sizes = cut(docs.select("doc_id", "source", *carry, F.size(words(text_or_empty())).cast("long").alias("size")))
    targets = source_targets(sizes).withColumnRenamed("source", "s")
    order = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    rows = sizes.withColumn("at", order).withColumn("run", F.substring("at", 1, RUN_DIGITS))
    runs = rows.groupBy("source", "run").agg(F.sum("size").alias("run_size"))
    starts = runs.select("source", "run", F.coalesce(F.sum("run_size").over(Window.partitionBy("source").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("run_start"))
    heads = starts.join(targets, F.col("source").eqNullSafe(F.col("s"))).select(F.col("source").alias("s"), F.col("run").alias("r"), "run_start", "source_size", "target", "ending")
    within = Window.partitionBy("source", "run").orderBy("at", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("before", F.coalesce(F.sum("size").over(within), F.lit(0))).join(heads, F.col("source").eqNullSafe(F.col("s")) & (F.col("run") == F.col("r")))
    offset = F.col("run_start") + F.col("before")
    full = F.when(F.col("source_size") > 0, F.least(F.lit(MAX_EPOCHS), F.floor(F.col("target") / F.col("source_size")))).otherwise(F.lit(0)).cast("long")
    rest = F.col("target") - full * F.col("source_size")
    extra = F.when((full < MAX_EPOCHS) & (F.col("size") > 0) & (offset + F.col("size") / 2 <= rest), 1).otherwise(0)
    epochs = F.when(F.col("size") > 0, full + extra).otherwise(F.lit(0)).cast("int")
    mixed = placed.select("doc_id", *carry, "source", "size", "source_size", "target", epochs.alias("epochs"), offset.alias("offset"), "ending")
    times = F.when(F.col("target") > 0, F.transform(F.sequence(F.lit(1), F.col("epochs")), lambda k: demand_inverse(F.least(F.lit(1.0), ((k - 1) * F.col("source_size") + F.col("offset")) / F.col("target")), F.col("ending"))))
    positions = F.when(F.col("epochs") > 0, times).otherwise(F.array().cast("array<double>"))
    return mixed.select("doc_id", *carry, "source", "size", "source_size", "target", (F.col("size") * F.col("epochs")).cast("long").alias("taken"), "epochs", positions.alias("positions"))


def training_order(mixed: DataFrame) -> DataFrame:
    """Range-sorted by first training position; doc_id breaks ties, so no range is bound to one position."""
    return mixed.withColumn("position", F.get("positions", F.lit(0))).orderBy(F.col("position").asc_nulls_last(), "doc_id")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return training_order(mix(table(spark, sf_dir, "documents"))).select("doc_id", "size", "source_size", "target", "taken", "epochs", "position")


OP1_SQL = r"""
WITH d AS (SELECT doc_id, source, CAST(len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY 1),
r AS (SELECT *, row_number() OVER (ORDER BY source ASC NULLS LAST) AS rank FROM s),
w AS (SELECT *, CASE (rank - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight, source_size * 2 AS cap, sum(source_size) OVER () * 1.5::DOUBLE AS whole FROM r),
l AS (SELECT *, (whole - coalesce(sum(cap) OVER (ORDER BY cap / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
  / sum(weight) OVER (ORDER BY cap / weight, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::DOUBLE AS level FROM w),
h AS (SELECT *, cap < level * weight AS held FROM l),
t AS (SELECT source, source_size, CASE WHEN held THEN CAST(cap AS DOUBLE) ELSE (SELECT arg_min(level, cap / weight) FROM h WHERE NOT held) * weight END AS target FROM h),
m AS (SELECT doc_id, size, source_size, target, CASE rank3 WHEN 0 THEN 0.5::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 1.5::DOUBLE END AS e,
  coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY md5(CAST(doc_id AS VARCHAR)), doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE AS o,
  CASE WHEN source_size > 0 THEN least(2, floor(target / source_size)) ELSE 0 END AS f
  FROM d JOIN (SELECT *, (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 AS rank3 FROM t) t ON d.source IS NOT DISTINCT FROM t.source),
k AS (SELECT *, CAST(CASE WHEN size > 0 THEN f + CASE WHEN f < 2 AND o + size / 2 <= target - f * source_size THEN 1 ELSE 0 END ELSE 0 END AS INTEGER) AS epochs, least(1.0, o / target) AS y FROM m)
SELECT doc_id, size, source_size, target, CAST(size * epochs AS BIGINT) AS taken, epochs,
  CASE WHEN epochs > 0 THEN CASE WHEN e = 1.0 THEN y ELSE (sqrt((2 - e) * (2 - e) + 4 * (e - 1) * y) - (2 - e)) / (2 * (e - 1)) END END AS position FROM k
"""
