r"""Chat formatting: logged snapshots of growing conversations collapse to the longest one, which is rendered.

A logger that saves a conversation after every turn leaves many prefixes of one dialogue. Rolling hashes over the ordered turns
give each conversation the digest of every prefix: a running sum of the SHA-256 (240 bits of it) of (place, role, text), so a turn adds
one number and a long conversation costs no more per turn than a short one. A conversation whose whole digest is a proper prefix of
another one is dropped by an anti-join, and of equal conversations the smallest conv_id stays. What remains is rendered as
``<|role|>\ntext<|end|>\n`` turns.

The set of prefixes is made distinct by a pre-aggregation in each task before its shuffle, so a first turn that a third of
the conversations share costs one row a task. A conversation becomes one row, as its rendered form is one value.

Texts cannot forge turns: in a text ``<|`` becomes ``<\|`` and ``<\`` becomes ``<\\``; in a role ``|`` becomes ``\|`` and ``\`` becomes ``\\``.

Defined results: a null role reads ``unknown``, a null text is empty; a null turn sorts first; equal turn numbers are ordered by
role and text; rows that repeat a turn whole count once; a row with a null conv_id is a conversation of one turn, and of equal ones a
null conv_id counts as larger than all others; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, table

#: Hexadecimal digits of each of the four numbers a SHA-256 gives.
PIECE = 15


def _numbers(place: Column) -> list[Column]:
    digest = F.sha2(F.concat_ws("\x1f", place, F.sha2("role", 256), F.sha2("text", 256)), 256)
    return [F.conv(F.substring(digest, 1 + i * PIECE, PIECE), 16, 10).cast("decimal(38,0)") for i in range(4)]


def _placed(conversations: DataFrame) -> DataFrame:
    """own (a conversation's key), conv_id, place, role, text, digest (of the turns up to this one)."""
    turns = conversations.select("conv_id", "turn", F.coalesce("role", F.lit("unknown")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    known = turns.where("conv_id IS NOT NULL")
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    same = [F.col(c).eqNullSafe(F.lag(c).over(order)) for c in ("turn", "role", "text")]
    fresh = known.withColumn("again", reduce(Column.__and__, same) & (F.row_number().over(order) > 1)).where("NOT again")
    placed = fresh.withColumn("place", F.row_number().over(order)).withColumn("own", F.concat(F.lit("c"), F.col("conv_id").cast("string")))
    single = turns.where("conv_id IS NULL").select("conv_id", "role", "text").distinct()
    single = single.select("conv_id", F.lit(None).cast(turns.schema["turn"].dataType).alias("turn"), "role", "text", F.lit(1).alias("place"), F.concat(F.lit("n"), F.sha2("role", 256), F.sha2("text", 256)).alias("own"))
    numbered = placed.select(*[c for c in placed.columns if c != "again"], *[n.alias(f"n{i}") for i, n in enumerate(_numbers(F.col("place")))])
    running = [F.sum(f"n{i}").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)).alias(f"n{i}") for i in range(4)]
    rolled = numbered.select("own", "conv_id", "place", "role", "text", *running)
    rolled = rolled.unionByName(single.select("own", "conv_id", "place", "role", "text", *[n.alias(f"n{i}") for i, n in enumerate(_numbers(F.col("place")))]))
    return rolled.select("own", "conv_id", "place", "role", "text", F.sha2(F.concat_ws(",", "place", "n0", "n1", "n2", "n3"), 256).alias("digest"))


def maximal_conversations(conversations: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns (ordered role and text) of the conversations that no longer one begins with."""
    turn = F.struct("place", "role", "text", "digest")
    gathered = cut(_placed(conversations).groupBy("own", "conv_id").agg(F.array_sort(F.collect_list(turn)).alias("turns")))
    whole = F.element_at("turns", -1)["digest"]
    first = gathered.groupBy(whole.alias("digest")).agg(F.min(F.struct(F.col("conv_id").isNull().alias("unknown"), "conv_id", "own"))["own"].alias("kept"))
    proper = gathered.select(F.explode(F.slice(F.transform("turns", lambda t: t["digest"]), 1, F.size("turns") - 1)).alias("digest")).distinct()
    longest = first.join(proper, "digest", "left_anti").select("kept")
    return gathered.join(longest, F.col("own") == F.col("kept"), "left_semi").select("conv_id", F.size("turns").alias("n_turns"), "turns")


def _escaped(c: Column, pairs: tuple[tuple[str, str], ...]) -> Column:
    for old, new in pairs:
        c = F.replace(c, F.lit(old), F.lit(new))
    return c


def render(maximal: DataFrame) -> DataFrame:
    role = lambda t: _escaped(t["role"], (("\\", "\\\\"), ("|", "\\|")))
    text = lambda t: _escaped(t["text"], (("<\\", "<\\\\"), ("<|", "<\\|")))
    piece = F.transform("turns", lambda t: F.concat(F.lit("<|"), role(t), F.lit("|>\n"), text(t), F.lit("<|end|>\n")))
    return maximal.select("conv_id", "n_turns", F.array_join(piece, "").alias("rendered"))


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return render(maximal_conversations(table(spark, sf_dir, "conversations")))


OP7_SQL = r"""
WITH d AS (SELECT DISTINCT conv_id, CASE WHEN conv_id IS NOT NULL THEN turn END AS turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text FROM conversations),
o AS (SELECT *, CASE WHEN conv_id IS NULL THEN 'n' || sha256(role) || sha256(text) ELSE 'c' || conv_id END AS own,
  '<|' || replace(replace(role, '\', '\\'), '|', '\|') || '|>' || chr(10) || replace(replace(text, '<\', '<\\'), '<|', '<\|') || '<|end|>' || chr(10) AS r FROM d),
c AS (SELECT own, conv_id, count(*) AS n, string_agg(r, '' ORDER BY turn NULLS FIRST, role, text) AS s,
  list(sha256(role) || sha256(text) ORDER BY turn NULLS FIRST, role, text) AS t FROM o GROUP BY 1, 2),
p AS (SELECT DISTINCT array_to_string(t[1:i], ',') AS k FROM (SELECT t, unnest(range(1, len(t))) AS i FROM c)),
f AS (SELECT *, row_number() OVER (PARTITION BY array_to_string(t, ',') ORDER BY conv_id NULLS LAST, own) AS nth FROM c)
SELECT conv_id, CAST(n AS INTEGER) AS n_turns, s AS rendered FROM f WHERE nth = 1 AND array_to_string(t, ',') NOT IN (SELECT k FROM p)
"""
