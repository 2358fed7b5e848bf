"""Quality rules by host: rule failures are counted per domain, shrunk, and a domain's verdict reaches its documents.

The rules of a single document are column expressions over its whole text. Failure rates of domains (column
``source``) are shrunk towards the corpus with a beta prior whose two parameters are fitted to the domains' own rates
by the method of moments; a domain whose shrunk failure rate is over ``max_rate`` is rejected with all its documents.
Domains are pre-aggregated before the shuffle, so a domain with a third of all rows costs one row a task; the domain
table joins back by key, and Spark broadcasts it only where its measured size is under its own limit.

Repeated three-word windows: hashes of the windows are compared by a primitive sort of (34 hash bits, position), and
the few positions that meet there are compared again by all 64 bits, so the work stays n log n on any text.

Defined results: a null or empty text has no words and fails; a null domain is a domain; rows that repeat a doc_id are
judged one by one; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD_BREAKS, cut, table, text_or_empty, words

SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
MAX_HOST_RATE = 0.8
_POSITION_BITS = 30
_POSITION_MASK = (1 << _POSITION_BITS) - 1


def _let(value: Column, body) -> Column:
    """body(value), with value computed once."""
    return F.transform(F.array(value), body)[0]


def _but_last(x: Column) -> Column:
    return F.slice(x, 1, F.greatest(F.size(x) - 1, F.lit(0)))


def _but_first(x: Column) -> Column:
    return F.slice(x, 2, F.greatest(F.size(x) - 1, F.lit(0)))


def _pairs(x: Column, when, keep) -> Column:
    """keep(a, b) of neighbours a, b in x for which when(a, b) holds."""
    return F.array_compact(F.zip_with(_but_last(x), _but_first(x), lambda a, b: F.when(when(a, b), keep(a, b))))


def _windows(w: Column) -> Column:
    """Hashes of the three-word windows of word hashes w."""
    n = F.greatest(F.size(w) - 2, F.lit(0))
    two = F.zip_with(F.slice(w, 1, n), F.slice(w, 2, n), lambda a, b: F.xxhash64(a, b))
    return F.zip_with(two, F.slice(w, 3, n), lambda a, b: F.xxhash64(a, b))


def _suspects(s: Column) -> Column:
    """Positions in the sorted entries s that share their upper bits with a neighbour."""
    met = _pairs(s, lambda a, b: F.shiftright(a, _POSITION_BITS) == F.shiftright(b, _POSITION_BITS), F.array)
    return F.array_distinct(F.transform(F.flatten(met), lambda x: x.bitwiseAND(F.lit(_POSITION_MASK))))


def _repeated(positions: Column, h: Column) -> Column:
    """Of the positions, in order, those whose whole hash occurs twice or more."""
    s = F.array_sort(F.transform(positions, lambda p: F.struct(F.get(h, p.cast("int")).alias("h"), p.alias("p"))))
    return _let(s, lambda t: F.sort_array(F.array_distinct(F.flatten(_pairs(t, lambda a, b: a["h"] == b["h"], lambda a, b: F.array(a["p"], b["p"]))))))


def _covered(p: Column) -> Column:
    """Words that three-word windows at the sorted positions p cover."""
    gaps = F.zip_with(_but_last(p), _but_first(p), lambda a, b: F.least(F.lit(3).cast("long"), b - a))
    return F.when(F.size(p) == 0, F.lit(0).cast("long")).otherwise(F.aggregate(gaps, F.lit(3).cast("long"), lambda a, x: a + x))


def base_rules(docs: DataFrame) -> DataFrame:
    """doc_id, source and the measures of each document.

    Each step reads the arrays of the one before twice or more, so the optimizer computes them once.
    """
    text = docs.select("doc_id", "source", text_or_empty().alias("text"))
    lines = F.filter(F.split("text", "\n", -1), lambda x: F.translate(x, WORD_BREAKS, "") != "")
    split = text.select(
        "doc_id",
        "source",
        F.length(F.translate("text", WORD_BREAKS, "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        _let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        F.transform(words(F.col("text")), lambda w: F.xxhash64(w)).alias("w"),
    )
    counts = ["doc_id", "source", "n_words", "word_chars", "n_symbols", "n_dup_lines"]
    hashed = split.select(*counts[:2], F.size("w").cast("long").alias("n_words"), *counts[3:], _let(F.col("w"), _windows).alias("h"))
    packed = F.sort_array(F.transform("h", lambda x, i: x.bitwiseAND(F.lit(~_POSITION_MASK)).bitwiseOR(i.cast("long"))))
    ordered = hashed.select(*counts, "h", F.when(F.size(F.array_distinct("h")) < F.size("h"), packed).alias("s"))
    repeats = _let(_let(_suspects(F.col("s")), lambda c: _repeated(c, F.col("h"))), _covered)
    return ordered.select(*counts, F.when(F.col("s").isNull(), F.lit(0).cast("long")).otherwise(repeats).alias("n_repeat_words"))


def host_verdicts(base: DataFrame, max_rate: float = MAX_HOST_RATE) -> DataFrame:
    """source, n_docs, n_failed, shrunk_rate, host_kept; one row per domain, null included.

    With mean m and variance v of the domains' rates, the prior has strength a + b = m (1 - m) / v - 1 (held between 1 and
    10,000; with one domain or none spread, 10,000) and mean m.
    """
    hosts = base.groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"), F.count(F.when(F.col("base_failed"), 1)).alias("n_failed"))
    rate = F.col("n_failed") / F.col("n_docs")
    fitted = hosts.agg(F.avg(rate).alias("m"), F.var_samp(rate).alias("v"))
    m, v = F.col("m"), F.col("v")
    strength = F.when(v > 0, F.least(F.lit(10000.0), F.greatest(F.lit(1.0), m * (1 - m) / v - 1))).otherwise(F.lit(10000.0))
    prior = fitted.select(F.lit(1).alias("one"), m.alias("m"), strength.alias("strength"))  # one row, whatever the input
    shrunk = (F.col("n_failed") + F.col("m") * F.col("strength")) / (F.col("n_docs") + F.col("strength"))
    return hosts.withColumn("one", F.lit(1)).join(F.broadcast(prior), "one").select("source", "n_docs", "n_failed", shrunk.alias("shrunk_rate"), (shrunk <= max_rate).alias("host_kept"))


def judge(docs: DataFrame, max_rate: float = MAX_HOST_RATE) -> DataFrame:
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    base = cut(base_rules(docs).withColumn("base_failed", failed))
    hosts = host_verdicts(base, max_rate).select(F.col("source").alias("host"), "host_kept", "shrunk_rate")
    return base.join(hosts, F.col("source").eqNullSafe(F.col("host")), "left").select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & F.col("host_kept")).alias("kept"), F.col("source").alias("host"), F.col("shrunk_rate").alias("host_rate")
    )


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents")).drop("host", "host_rate")


OP6_SQL = r"""
WITH t AS (SELECT doc_id, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
  list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM t),
b AS (SELECT doc_id, source, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
  CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines FROM w),
g AS (SELECT doc_id, i, concat_ws(' ', w[i], w[i + 1], w[i + 2]) AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM w)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM g) WHERE c > 1),
m AS (SELECT doc_id, sum(least(3, coalesce(nx - i, 3))) AS n FROM (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nx FROM r) GROUP BY 1),
f AS (SELECT b.*, CAST(coalesce(m.n, 0) AS BIGINT) AS n_repeat_words, n_words < 50 OR 100 * coalesce(m.n, 0) > 50 * n_words AS base_failed FROM b LEFT JOIN m USING (doc_id)),
h AS (SELECT source, count(*) AS n, sum(CASE WHEN base_failed THEN 1 ELSE 0 END) AS k FROM f GROUP BY 1),
p AS (SELECT avg(k / n) AS m, var_samp(k / n) AS v FROM h),
s AS (SELECT source, (k + m * a) / (n + a) <= 0.8 AS ok FROM h, (SELECT m, CASE WHEN v > 0 THEN least(10000.0, greatest(1.0, m * (1 - m) / v - 1)) ELSE 10000.0 END AS a FROM p))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND ok AS kept
FROM f JOIN s ON f.source IS NOT DISTINCT FROM s.source
"""
