"""Sharding: documents in the order of a Hilbert curve over their metadata, cut into equal runs.

Each document is a cell in a cube of three quantised dimensions (source, lang, log2 of the size). Sources and
langs are quantised by their rank among the distinct values, spread over the axis, so cells keep the order of the
values; of more values than the axis has places, neighbours share one. The Hilbert index of the cell is computed
with column expressions, one distributed sort orders the documents by (index, text hash, doc_id), and a run of
consecutive ranks becomes a shard. Files written by shard then carry narrow min/max ranges in the three dimensions,
so a filter on any of them prunes files.

Texts are read once: sizes and hashes go to the checkpoint folder, and everything after that reads them there.

The law is ``rows``: shard counts differ by at most one, whatever the skew. The order ends in doc_id, so range
bounds can fall inside a hot source, cell or group of equal texts and no task holds it whole. Copies of one text
with the same source and lang are neighbours.

Defined results: a null text has size 8 and the CRC of no bytes; null source or lang is a value of its own;
rows that repeat a doc_id each get a slot; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.order import numbered
from .common import cut, table

BITS = 5
SHARDS = 24


def hilbert_index(dims: list[Column], bits: int) -> Column:
    """Index on the Hilbert curve of the point ``dims`` (each from 0 to 2**bits - 1), after J. Skilling (2004).

    One expression of constant size: an ``aggregate`` over the (bit, axis) steps folds the axes into the
    transposed index, a second one does the Gray coding, a third one weaves the bits.
    """
    n = len(dims)
    axes = F.array(*[d.cast("long") for d in dims])
    steps = F.array(*[F.struct(F.lit(1 << b).alias("q"), F.lit(i).alias("i")) for b in range(bits - 1, 0, -1) for i in range(n)])

    def untwist(x: Column, s: Column) -> Column:
        q, i = s["q"].cast("long"), s["i"]
        p = q - 1
        hit = x[i].bitwiseAND(q) != 0
        swap = x[0].bitwiseXOR(x[i]).bitwiseAND(p)
        return F.transform(
            x,
            lambda v, j: F.when(j == 0, F.when(hit, x[0].bitwiseXOR(p)).otherwise(x[0].bitwiseXOR(swap)))
            .when((j == i) & ~hit, v.bitwiseXOR(swap))
            .otherwise(v),
        )

    def gray(x: Column) -> Column:
        chain = F.transform(x, lambda v, j: F.aggregate(F.slice(x, 1, j + 1), F.lit(0).cast("long"), lambda a, y: a.bitwiseXOR(y)))
        return F.aggregate(
            F.array(chain),
            x,
            lambda _, g: F.transform(
                g,
                lambda v, j: v.bitwiseXOR(
                    F.aggregate(
                        F.array(*[F.lit(1 << b).cast("long") for b in range(bits - 1, 0, -1)]),
                        F.lit(0).cast("long"),
                        lambda t, q: F.when(g[n - 1].bitwiseAND(q) != 0, t.bitwiseXOR(q - 1)).otherwise(t),
                    )
                ),
            ),
        )

    turned = F.aggregate(steps, axes, untwist, gray)
    weave = F.array(*[F.struct(F.lit(b).alias("b"), F.lit(i).alias("i")) for b in range(bits - 1, -1, -1) for i in range(n)])
    return F.aggregate(
        F.array(turned),
        F.lit(0).cast("long"),
        lambda _, g: F.aggregate(
            weave, F.lit(0).cast("long"), lambda a, s: a * 2 + F.when(g[s["i"]].bitwiseAND(F.element_at(F.array(*[F.lit(1 << b).cast("long") for b in range(bits)]), s["b"] + 1)) != 0, 1).otherwise(0)
        ),
    )


def axis(rows: DataFrame, name: str, bits: int = BITS) -> Column:
    """The place of a column's value, from 1 to 2**bits - 1, in the order of the values; null: 0.

    The first value of each place is a literal of the expression: at most 2**bits - 1 values, however many there are.
    """
    top = (1 << bits) - 1
    values = cut(numbered(rows.where(F.col(name).isNotNull()).select(F.col(name).alias("value")).distinct(), ["value"], "rank"))
    n = values.count()
    if not n:
        return F.lit(0)
    firsts = values.groupBy(F.expr(f"rank * {top} DIV {n} + 1").alias("place")).agg(F.min("value").alias("value")).orderBy("place").collect()
    at = F.size(F.filter(F.array(*[F.lit(r["value"]) for r in firsts]), lambda v: v <= F.col(name)))
    return F.when(F.col(name).isNull(), 0).otherwise(F.element_at(F.array(*[F.lit(r["place"]) for r in firsts]), at))


def metadata_cell(rows: DataFrame, bits: int = BITS) -> list[Column]:
    """Three dimensions from 0 to 2**bits - 1: source and lang in order, and twice the log2 of the size, from 16 on."""
    doubled = F.length(F.bin(F.col("size") * F.col("size"))) - 1  # the whole part of 2 log2, exactly
    return [axis(rows, "source", bits), axis(rows, "lang", bits), F.greatest(F.lit(0), F.least(F.lit((1 << bits) - 1), doubled - 8))]


def hilbert_shards(docs: DataFrame, shards: int = SHARDS, bits: int = BITS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard (null: not a key law), hilbert."""
    text = F.encode(F.coalesce(F.col("text"), F.lit("")), "UTF-8")
    sized = docs.select("doc_id", "source", "lang", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text).cast("long").alias("text_crc32"))
    sized = cut(sized)
    keyed = sized.select("doc_id", "size", "text_crc32", hilbert_index(metadata_cell(sized, bits), bits).alias("hilbert"))
    total = max(1, sized.count())
    ranked = numbered(keyed, ["hilbert", "text_crc32", "doc_id"], "rank").withColumn("shard", F.expr(f"CAST(rank * {shards} DIV {total} AS INT)"))
    # rank r of n goes to shard floor(r * s / n), whose first rank is ceil(shard * n / s)
    return ranked.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        F.expr(f"rank - (CAST(shard AS BIGINT) * {total} + {shards - 1}) DIV {shards}").cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        "hilbert",
    )


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hilbert_shards(table(spark, sf_dir, "documents"))


def _hilbert_sql(rows: str, bits: int) -> str:
    """SQL of ``rows`` with columns x, y, z turned into the three transposed words of the Hilbert index."""
    for b in range(bits - 1, 0, -1):
        q = 1 << b
        rows = f"SELECT * REPLACE (CASE WHEN x & {q} <> 0 THEN xor(x, {q - 1}) ELSE x END AS x) FROM ({rows})"
        for c in "yz":
            both = f"xor(x, {c}) & {q - 1}"
            rows = f"SELECT * REPLACE (xor(x, CASE WHEN {c} & {q} <> 0 THEN {q - 1} ELSE {both} END) AS x, xor({c}, CASE WHEN {c} & {q} <> 0 THEN 0 ELSE {both} END) AS {c}) FROM ({rows})"
    rows = f"SELECT * REPLACE (xor(x, y) AS y, xor(xor(x, y), z) AS z) FROM ({rows})"
    turn = "0"
    for b in range(bits - 1, 0, -1):
        turn = f"xor({turn}, CASE WHEN z & {1 << b} <> 0 THEN {(1 << b) - 1} ELSE 0 END)"
    return f"SELECT * REPLACE (xor(x, t) AS x, xor(y, t) AS y, xor(z, t) AS z) FROM (SELECT *, {turn} AS t FROM ({rows}))"


_WOVEN = " + ".join(f"(({c} >> {b}) & 1) * {1 << (3 * b + 2 - i)}" for b in range(BITS) for i, c in enumerate("xyz"))
_TOP = (1 << BITS) - 1
OP10_SQL = f"""
WITH t AS (SELECT list_transform(range(256), lambda n: list_reduce(range(8), lambda a, k: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END, n)) AS t),
b AS (SELECT doc_id, source, lang, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda x: CAST('0x' || x AS BIGINT)) AS b FROM documents),
d AS (SELECT doc_id, source, lang, CAST(len(b) + 8 AS BIGINT) AS size, xor(list_reduce(b, lambda a, x: xor(a >> 8, t[xor(a & 255, x) + 1]), 4294967295), 4294967295) AS crc FROM b, t),
s AS (SELECT source, (row_number() OVER (ORDER BY source) - 1) * {_TOP} // count(*) OVER () + 1 AS p FROM (SELECT DISTINCT source FROM d WHERE source IS NOT NULL)),
l AS (SELECT lang, (row_number() OVER (ORDER BY lang) - 1) * {_TOP} // count(*) OVER () + 1 AS p FROM (SELECT DISTINCT lang FROM d WHERE lang IS NOT NULL)),
c AS (SELECT doc_id, size, crc, CAST(coalesce(s.p, 0) AS BIGINT) AS x, CAST(coalesce(l.p, 0) AS BIGINT) AS y, CAST(greatest(0, least({_TOP}, length(bin(size * size)) - 9)) AS BIGINT) AS z
  FROM d LEFT JOIN s USING (source) LEFT JOIN l USING (lang)),
h AS (SELECT doc_id, size, crc, {_WOVEN} AS hilbert FROM ({_hilbert_sql("SELECT * FROM c", BITS)})),
r AS (SELECT *, row_number() OVER (ORDER BY hilbert, crc, doc_id NULLS FIRST) - 1 AS r, count(*) OVER () AS n FROM h)
SELECT doc_id, size, crc AS text_crc32, 'rows' AS law, CAST(r * {SHARDS} // n AS INTEGER) AS shard, CAST(r - ((r * {SHARDS} // n) * n + {SHARDS - 1}) // {SHARDS} AS BIGINT) AS slot,
  CAST(NULL AS INTEGER) AS grown_shard, CAST(hilbert AS BIGINT) AS hilbert FROM r
"""
