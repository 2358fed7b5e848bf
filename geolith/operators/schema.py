"""Schema of feature tables: ordered key union, type widening, DBF field plans. Partial aggregation over exploded properties."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..codecs.dbf import unique_names
from ..functions.text import scalar_format


def exploded(df: DataFrame) -> DataFrame:
    """at (the place of the property in reading order), key, value."""
    p = df.select("layer_ord", "seq", F.posexplode("props").alias("pos", "p"))
    return p.select(F.struct("layer_ord", "seq", "pos").alias("at"), F.col("p.key").alias("key"), F.col("p.value").alias("value"))


def key_union(df: DataFrame) -> DataFrame:
    """key, ord: every key, numbered from 0 in the order they are first seen. The window is over one row per key."""
    first = exploded(df).groupBy("key").agg(F.min("at").alias("at"))
    return first.select("key", (F.row_number().over(Window.orderBy("at")) - 1).alias("ord"))


def widened(df: DataFrame) -> DataFrame:
    """key, ord, kind (bool, long, double, string). A null seen first fixes string; later nulls are passed over."""
    t = F.when(F.col("value.t") == "json", "string").otherwise(F.col("value.t"))
    per = exploded(df).groupBy("key").agg(F.min("at").alias("at"), F.min_by(t, F.col("at")).alias("first"), F.array_sort(F.collect_set(F.when(t != "null", t))).alias("kinds"))
    kind = F.when((F.col("first") == "null") | (F.size("kinds") == 0), "string").when(F.size("kinds") == 1, F.col("kinds")[0]).when(F.col("kinds") == F.array(F.lit("double"), F.lit("long")), "double").otherwise("string")
    return per.select("key", (F.row_number().over(Window.orderBy("at")) - 1).alias("ord"), kind.alias("kind"))


def dbf_fields(df: DataFrame) -> DataFrame:
    """key, ord, kind (L, N, C), length, decimals: one pass over all values."""
    v = F.col("value")
    seen = v["t"] != "null"
    text = scalar_format(v)
    places = F.length(F.regexp_extract(F.format_string("%.15f", v["s"].try_cast("double")), r"\.([0-9]*?)0*$", 1))
    number = v["t"].isin("long", "double")
    per = exploded(df).groupBy("key").agg(
        F.min("at").alias("at"),
        F.count(F.when(seen, 1)).alias("n"),
        F.coalesce(F.bool_and(F.when(seen, v["t"] == "bool")), F.lit(False)).alias("is_bool"),
        F.coalesce(F.bool_and(F.when(seen, v["t"] == "long")), F.lit(False)).alias("is_int"),
        F.coalesce(F.bool_and(F.when(seen, number)), F.lit(False)).alias("is_number"),
        F.coalesce(F.max(F.when(seen, F.length(text))), F.lit(0)).alias("longest"),
        F.coalesce(F.max(F.when(v["t"] == "double", places)), F.lit(0)).alias("places"),
    )
    clamp = lambda c, lo, hi: F.greatest(lo if not isinstance(lo, int) else F.lit(lo), F.least(c, F.lit(hi)))
    kind = F.when(F.col("is_bool"), "L").when(F.col("is_number"), "N").otherwise("C")
    decimals = F.when(F.col("is_number") & ~F.col("is_int") & ~F.col("is_bool"), F.least("places", F.lit(15))).otherwise(0)
    length = F.when(F.col("is_bool"), 1).when(F.col("is_int"), clamp(F.col("longest"), 1, 18)).when(F.col("is_number"), clamp(F.col("longest"), decimals + 2, 19)).otherwise(clamp(F.col("longest"), 1, 254))
    return per.select("key", (F.row_number().over(Window.orderBy("at")) - 1).alias("ord"), kind.alias("kind"), length.alias("length"), decimals.alias("decimals"))


def dbf_names(keys: list[str]) -> list[str]:
    """Field names of ordered keys; the keys are columns of a table, so they are few."""
    return unique_names(keys)


def common_type(df: DataFrame) -> DataFrame:
    """kind: the one type of all geometries, or Unknown; nulls are passed over. types: all of them, sorted."""
    g = df.where("geom IS NOT NULL").agg(F.array_sort(F.collect_set("geom.type")).alias("types"))
    return g.select(F.when(F.size("types") == 1, F.col("types")[0]).otherwise("Unknown").alias("kind"), "types")


def wide(df: DataFrame, kinds: list[tuple[str, str]]) -> DataFrame:
    """Typed columns of the keys, from the tagged properties; a value that does not fit its column's type is its text or null."""
    sql = {"bool": "boolean", "long": "long", "double": "double", "string": "string"}
    value = lambda k: F.get(F.filter("props", lambda p: p["key"] == k), F.lit(0))["value"]
    column = lambda k, kind: (scalar_format(value(k)) if kind == "string" else value(k)["s"].try_cast(sql[kind])).alias(k)
    return df.select("layer_path", "layer_ord", "seq", "geom", *[F.when(value(k)["t"] != "null", column(k, kind)).alias(k) for k, kind in kinds])
