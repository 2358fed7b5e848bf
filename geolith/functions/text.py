"""Numbers and scalars as text, and well-known text, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .geometry import let

_INTEGER = r"^[ \t\n\x0b\x0c\r]*[+-]?[0-9]+[ \t\n\x0b\x0c\r]*$"
_NUMBER = r"^[ \t\n\x0b\x0c\r]*([+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?|[+-]?(Infinity|NaN|∞))[ \t\n\x0b\x0c\r]*$"


def fmt_double(value: Column) -> Column:
    """Round-trip text: ``1``, ``0.1``, ``1E+15``, ``1E-05``. An exponent is written from 15 digits before the point and from the fifth zero after it."""

    def write(text: Column) -> Column:
        sign = F.when(text.startswith("-"), "-").otherwise("")
        mantissa = F.substring_index(F.regexp_replace(text, "^-", ""), "E", 1)
        power = F.when(text.contains("E"), F.substring_index(text, "E", -1).cast("int")).otherwise(0)
        whole, part = F.substring_index(mantissa, ".", 1), F.regexp_replace(F.substring_index(mantissa, ".", -1), "0+$", "")
        raw = F.concat(whole, part)
        digits = F.regexp_replace(raw, "^0+", "")  # significant, no leading zero
        exponent = F.length(whole) - 1 + power - (F.length(raw) - F.length(digits))
        parts = F.struct(sign.alias("sign"), F.regexp_replace(digits, "0+$", "").alias("d"), exponent.alias("e"))

        def join(p: Column) -> Column:
            d, e, n = p["d"], p["e"], F.length(p["d"])
            scientific = F.concat(F.substring(d, 1, 1), F.when(n > 1, F.concat(F.lit("."), d.substr(F.lit(2), n))).otherwise(""), F.when(e < 0, "E-").otherwise("E+"), F.lpad(F.abs(e).cast("string"), F.greatest(F.lit(2), F.length(F.abs(e).cast("string"))), F.lit("0")))
            small = F.concat(F.lit("0."), F.repeat(F.lit("0"), -e - 1), d)
            large = F.when(e + 1 >= n, F.concat(d, F.repeat(F.lit("0"), e + 1 - n))).otherwise(F.concat(d.substr(F.lit(1), e + 1), F.lit("."), d.substr(e + 2, n)))
            return F.concat(p["sign"], F.when(n == 0, "0").when((e + 1 > F.greatest(n, F.lit(15))) | (e <= -5), scientific).when(e < 0, small).otherwise(large))

        return F.when(text.isin("NaN", "Infinity", "-Infinity"), text).otherwise(let(parts, join))

    value = value.cast("double")
    text, size = value.cast("string"), F.abs(value)
    plain = F.when(text.endswith(".0"), F.substring_index(text, ".", 1)).otherwise(text)  # the JVM writes no exponent in this range
    return F.when((size >= 1e-3) & (size < 1e7), plain).otherwise(let(text, write))


def scalar_format(value: Column) -> Column:
    """Text of a tagged scalar; doubles in round-trip form, null empty."""
    return F.when(value.isNull() | (value["t"] == "null"), "").when(value["t"] == "double", fmt_double(value["s"].cast("double"))).otherwise(F.coalesce(value["s"], F.lit("")))


def scalar_infer(text: Column) -> Column:
    """The tagged scalar a text stands for: long, else double, else bool, else string; null stays null."""
    tag = lambda t, s: F.struct(F.lit(t).alias("t"), s.alias("s"))
    trimmed = F.regexp_replace(text, r"^[ \t\n\x0b\x0c\r]+|[ \t\n\x0b\x0c\r]+$", "")
    whole = F.when(text.rlike(_INTEGER), trimmed.try_cast("long"))
    number = F.when(text.rlike(_NUMBER), F.regexp_replace(trimmed, "∞", "Infinity").try_cast("double"))
    return (
        F.when(text.isNull(), F.lit(None).cast("struct<t:string,s:string>"))
        .when(whole.isNotNull(), tag("long", whole.cast("string")))
        .when(number.isNotNull(), tag("double", fmt_double(number)))
        .when(F.lower(text).isin("true", "false"), tag("bool", F.lower(text)))
        .otherwise(tag("string", text))
    )


def _ordinates(p: Column, z: Column, m: Column) -> Column:
    """Numbers of a position; a missing Z or M is 0 where another position has one."""
    more = lambda on, c: F.when(on, F.array(F.coalesce(c, F.lit(0.0)))).otherwise(F.array().cast("array<double>"))
    return F.array_join(F.transform(F.concat(F.array(p["x"], p["y"]), more(z, p["z"]), more(m, p["m"])), fmt_double), " ")


def _in_brackets(items: Column) -> Column:
    return F.concat(F.lit("("), F.array_join(items, ", "), F.lit(")"))


def _tag(positions: Column, then) -> Column:
    """then(has Z, has M, the tag for them)."""
    dims = F.struct(F.exists(positions, lambda p: p["z"].isNotNull()).alias("z"), F.exists(positions, lambda p: p["m"].isNotNull()).alias("m"))
    return let(dims, lambda d: then(d["z"], d["m"], F.when(d["z"] & d["m"], " ZM").when(d["z"], " Z").when(d["m"], " M").otherwise("")))


def wkt_member(m: Column) -> Column:
    """Well-known text of a geometry that is no collection. Each position is written once; the kind only decides on brackets."""
    kind, parts = m["type"], m["parts"]
    flat = F.flatten(F.flatten(parts))

    def write(z: Column, m_: Column, tag: Column) -> Column:
        rings = F.transform(parts, lambda part: F.transform(part, lambda r: _in_brackets(F.transform(r, lambda p: _ordinates(p, z, m_)))))

        def join(t: Column) -> Column:
            return (
                F.when(kind.isin("Point", "LineString"), F.get(F.get(t, F.lit(0)), F.lit(0)))
                .when(kind == "Polygon", _in_brackets(F.get(t, F.lit(0))))
                .when(kind == "MultiPolygon", _in_brackets(F.transform(t, _in_brackets)))
                .otherwise(_in_brackets(F.transform(t, lambda part: F.get(part, F.lit(0)))))
            )

        return F.concat(F.upper(kind), tag, F.when(F.size(flat) == 0, " EMPTY").otherwise(F.concat(F.lit(" "), let(rings, join))))

    return _tag(flat, write)


def wkt_format(geom: Column) -> Column:
    """Well-known text. Collections are written one level deep here; ``functions.udfs.st_astext`` writes nested ones."""
    flat = F.flatten(F.transform(geom["members"], lambda m: F.flatten(F.flatten(m["parts"]))))

    def write(members: Column) -> Column:
        body = F.when(F.size(flat) == 0, " EMPTY").otherwise(F.concat(F.lit(" "), _in_brackets(members)))
        collection = _tag(flat, lambda z, m, tag: F.concat(F.lit("GEOMETRYCOLLECTION"), tag, body))
        return F.when(geom["type"] == "GeometryCollection", collection).otherwise(members[0])

    return let(F.transform(geom["members"], wkt_member), write)
