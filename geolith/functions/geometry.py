"""Geometry functions as column expressions: no Python runs on the executors.

``let`` computes a value once where it is used several times. Rings and lines are arrays of positions.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..model import ENVELOPE, TYPES


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    return F.transform(F.array(value), body)[0]


def _but_last(x: Column) -> Column:
    return F.slice(x, 1, F.greatest(F.size(x) - 1, F.lit(0)))


def _but_first(x: Column) -> Column:
    return F.slice(x, 2, F.greatest(F.size(x) - 1, F.lit(0)))


def _zero() -> Column:
    return F.lit(0.0)


def _total(x: Column) -> Column:
    return F.aggregate(x, _zero(), lambda a, v: a + v)


def positions(geom: Column) -> Column:
    """All positions, in order."""
    return F.flatten(F.transform(geom["members"], lambda m: F.flatten(F.flatten(m["parts"]))))


def geometry_type(geom: Column) -> Column:
    return geom["type"]


def is_empty(geom: Column) -> Column:
    """Null or without a position; a polygon with an empty exterior is empty, whatever its holes."""
    part_full = lambda m: lambda p: F.when(m["type"].endswith("Polygon"), F.size(F.get(p, F.lit(0))) > 0).otherwise(F.exists(p, lambda r: F.size(r) > 0))
    return F.coalesce(~F.exists(geom["members"], lambda m: F.exists(m["parts"], part_full(m))), F.lit(True))


def has_z(geom: Column) -> Column:
    return F.exists(positions(geom), lambda p: p["z"].isNotNull())


def has_m(geom: Column) -> Column:
    return F.exists(positions(geom), lambda p: p["m"].isNotNull())


def vertex_count(geom: Column) -> Column:
    return F.size(positions(geom))


def envelope(minx, miny, maxx, maxy) -> Column:
    return F.struct(minx.alias("minx"), miny.alias("miny"), maxx.alias("maxx"), maxy.alias("maxy"))


def _finite(c: Column) -> Column:
    return ~F.isnan(c) & (F.abs(c) < float("inf"))


def envelope_is_empty(e: Column) -> Column:
    """Null, or with a component that is not finite."""
    return F.coalesce(~(_finite(e["minx"]) & _finite(e["miny"]) & _finite(e["maxx"]) & _finite(e["maxy"])), F.lit(True))


def envelope_expand(e: Column, x: Column, y: Column) -> Column:
    """An empty envelope starts anew at (x, y); a NaN ordinate makes the result empty."""
    low = lambda a, b: F.when(F.isnan(a) | F.isnan(b), F.lit(float("nan"))).otherwise(F.least(a, b))
    wide = envelope(low(e["minx"], x), low(e["miny"], y), F.greatest(e["maxx"], x), F.greatest(e["maxy"], y))
    return F.when(envelope_is_empty(e), envelope(x, y, x, y)).otherwise(wide).cast(ENVELOPE)


def envelope_union(a: Column, b: Column) -> Column:
    both = envelope(F.least(a["minx"], b["minx"]), F.least(a["miny"], b["miny"]), F.greatest(a["maxx"], b["maxx"]), F.greatest(a["maxy"], b["maxy"]))
    return F.when(envelope_is_empty(a), b).when(envelope_is_empty(b), a).otherwise(both)


def envelope_width(e: Column) -> Column:
    return F.when(envelope_is_empty(e), 0.0).otherwise(e["maxx"] - e["minx"])


def envelope_height(e: Column) -> Column:
    return F.when(envelope_is_empty(e), 0.0).otherwise(e["maxy"] - e["miny"])


def bounds(geom: Column) -> Column:
    """The envelope, or null if empty. Finite input; ``bounds_any`` takes NaN as well."""
    def box(p: Column) -> Column:
        xs, ys = F.transform(p, lambda q: q["x"]), F.transform(p, lambda q: q["y"])
        return F.when(F.size(p) > 0, envelope(F.array_min(xs), F.array_min(ys), F.array_max(xs), F.array_max(ys)))

    return let(positions(geom), box)


def bounds_any(geom: Column) -> Column:
    """The envelope by a fold over each part, so that a NaN ordinate empties what was gathered in its part; null if empty."""
    nothing = F.lit(None).cast(ENVELOPE)
    fold = lambda ps: F.aggregate(ps, nothing, lambda e, p: envelope_expand(e, p["x"], p["y"]))
    per_member = lambda m: F.when(m["type"] == "MultiPoint", F.array(fold(F.flatten(F.flatten(m["parts"]))))).otherwise(F.transform(m["parts"], lambda part: fold(F.flatten(part))))
    whole = F.aggregate(F.flatten(F.transform(geom["members"], per_member)), nothing, envelope_union)
    return let(whole, lambda e: F.when(~envelope_is_empty(e), e))


def bbox_contains(outer: Column, inner: Column) -> Column:
    inside = (outer["minx"] <= inner["minx"]) & (outer["miny"] <= inner["miny"]) & (outer["maxx"] >= inner["maxx"]) & (outer["maxy"] >= inner["maxy"])
    return F.when(envelope_is_empty(outer) | envelope_is_empty(inner), F.lit(False)).otherwise(inside)


def bbox_intersects(a: Column, b: Column) -> Column:
    """Touching boxes do not intersect."""
    return (a["maxx"] > b["minx"]) & (a["minx"] < b["maxx"]) & (a["maxy"] > b["miny"]) & (a["miny"] < b["maxy"])


def _crosses(ring: Column) -> Column:
    """struct(x: sum of both x, y, cross) of each edge, the closing one included."""
    nxt = F.concat(_but_first(ring), F.slice(ring, 1, 1))
    return F.zip_with(ring, nxt, lambda p, q: F.struct((p["x"] + q["x"]).alias("x"), (p["y"] + q["y"]).alias("y"), (p["x"] * q["y"] - q["x"] * p["y"]).alias("c")))


def signed_area(ring: Column) -> Column:
    """Shoelace area, positive counter-clockwise; 0 under three vertices."""
    return let(ring, lambda r: F.when(F.size(r) < 3, 0.0).otherwise(_total(F.transform(_crosses(r), lambda e: e["c"])) / 2))


def is_clockwise(ring: Column) -> Column:
    return signed_area(ring) < 0


def orient_ring(ring: Column, clockwise: Column | bool) -> Column:
    want = clockwise if isinstance(clockwise, Column) else F.lit(clockwise)
    return let(ring, lambda r: F.when(is_clockwise(r) == want, r).otherwise(F.reverse(r)))


def orient_rings(rings: Column, exterior_clockwise: bool) -> Column:
    """Exterior one way, holes the other."""
    return F.transform(rings, lambda r, i: orient_ring(r, (i == 0) == F.lit(exterior_clockwise)))


def orient_rfc7946(rings: Column) -> Column:
    return orient_rings(rings, exterior_clockwise=False)


def orient_shapefile(rings: Column) -> Column:
    return orient_rings(rings, exterior_clockwise=True)


def orient_geometry(geom: Column, exterior_clockwise: bool) -> Column:
    turned = lambda m: F.when(m["type"].endswith("Polygon"), F.transform(m["parts"], lambda rings: orient_rings(rings, exterior_clockwise))).otherwise(m["parts"])
    return geom.withField("members", F.transform(geom["members"], lambda m: m.withField("parts", turned(m))))


def exterior_ring(geom: Column) -> Column:
    return geom["members"][0]["parts"][0][0]


def interior_rings(geom: Column) -> Column:
    return _but_first(geom["members"][0]["parts"][0])


def segment_length(a: Column, b: Column) -> Column:
    dx, dy = b["x"] - a["x"], b["y"] - a["y"]
    return F.sqrt(dx * dx + dy * dy)


def _segments(path: Column) -> Column:
    return F.zip_with(_but_last(path), _but_first(path), lambda a, b: F.struct(a.alias("a"), b.alias("b"), segment_length(a, b).alias("n")))


def path_length(path: Column) -> Column:
    return let(path, lambda p: _total(F.transform(_segments(p), lambda s: s["n"])))


def _xy(x: Column, y: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


_XY = "struct<x:double,y:double>"


def line_midpoint(path: Column) -> Column:
    """Point at half the length; the first position of a path without length; null without positions."""

    def walk(p: Column) -> Column:
        def on(segments: Column) -> Column:
            def at_half(total: Column) -> Column:
                start = F.struct(_zero().alias("gone"), F.lit(None).cast(_XY).alias("hit"), F.lit(1).alias("k"))

                def step(acc: Column, s: Column) -> Column:
                    gone = acc["gone"] + s["n"]
                    t = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (total / 2 - acc["gone"]) / s["n"]))
                    here = _xy(s["a"]["x"] + t * (s["b"]["x"] - s["a"]["x"]), s["a"]["y"] + t * (s["b"]["y"] - s["a"]["y"]))
                    reached = acc["hit"].isNull() & ((gone >= total / 2) | (acc["k"] == F.size(segments)))
                    return F.struct(gone.alias("gone"), F.when(reached, here).otherwise(acc["hit"]).alias("hit"), (acc["k"] + 1).alias("k"))

                return F.when(total == 0, _xy(p[0]["x"], p[0]["y"])).otherwise(F.aggregate(segments, start, step, lambda acc: acc["hit"]))

            return let(_total(F.transform(segments, lambda s: s["n"])), at_half)

        return F.when(F.size(p) == 0, F.lit(None).cast(_XY)).when(F.size(p) == 1, _xy(F.get(p, F.lit(0))["x"], F.get(p, F.lit(0))["y"])).otherwise(let(_segments(p), on))

    return let(path, walk)


def ring_centroid(ring: Column) -> Column:
    """Area-weighted centroid; the mean of the vertices where there is no area; null under three vertices."""

    def of(r: Column) -> Column:
        def weigh(e: Column) -> Column:
            area = _total(F.transform(e, lambda s: s["c"]))
            mean = _xy(_total(F.transform(r, lambda p: p["x"])) / F.size(r), _total(F.transform(r, lambda p: p["y"])) / F.size(r))
            return let(area, lambda a: F.when(F.abs(a) < 1e-12, mean).otherwise(_xy(_total(F.transform(e, lambda s: s["x"] * s["c"])) / (3 * a), _total(F.transform(e, lambda s: s["y"] * s["c"])) / (3 * a))))

        return F.when(F.size(r) < 3, F.lit(None).cast(_XY)).otherwise(let(_crosses(r), weigh))

    return let(ring, of)


def _first_max(items: Column, measure: Callable[[Column], Column]) -> Column:
    """The first of the items whose measure no other exceeds."""
    return F.aggregate(
        F.transform(items, lambda v: F.struct(measure(v).alias("n"), v.alias("v"))), F.get(F.transform(items, lambda v: F.struct(F.lit(-1.0).alias("n"), v.alias("v"))), F.lit(0)), lambda best, v: F.when(v["n"] > best["n"], v).otherwise(best)
    )["v"]


def _member_anchor(m: Column) -> Column:
    kind, parts = m["type"], m["parts"]
    return (
        F.when(F.size(parts) == 0, F.lit(None).cast(_XY))
        .when(kind.isin("Point", "MultiPoint"), _xy(parts[0][0][0]["x"], parts[0][0][0]["y"]))
        .when(kind.isin("LineString", "MultiLineString"), line_midpoint(_first_max(F.transform(parts, lambda p: p[0]), path_length)))
        .when(kind.isin("Polygon", "MultiPolygon"), ring_centroid(_first_max(F.transform(parts, lambda p: p[0]), lambda r: F.abs(signed_area(r)))))
    )


def label_anchor(geom: Column) -> Column:
    """Where a label goes, in longitude and latitude: by type, the first position, the middle of the longest line or the centroid of the largest polygon."""
    return F.get(F.filter(F.transform(geom["members"], _member_anchor), lambda a: a.isNotNull()), F.lit(0))


def label_priority(geom: Column) -> Column:
    """Area of exteriors, length of lines, 0 for points; the largest member of a collection."""
    one = lambda m: F.when(m["type"].endswith("Polygon"), _total(F.transform(m["parts"], lambda p: F.abs(signed_area(p[0]))))).when(m["type"].endswith("LineString"), _total(F.transform(m["parts"], lambda p: path_length(p[0])))).otherwise(0.0)
    return F.coalesce(F.array_max(F.transform(geom["members"], one)), F.lit(0.0))


def shape_category(geom: Column) -> Column:
    """1 point, 8 multipoint, 3 lines, 5 polygons, 0 others."""
    kind = geom["type"]
    return F.when(kind == "Point", 1).when(kind == "MultiPoint", 8).when(kind.endswith("LineString"), 3).when(kind.endswith("Polygon"), 5).otherwise(0)


def type_code(geom: Column) -> Column:
    """The place of the type in the model's order, from 0."""
    return F.array_position(F.array(*[F.lit(t) for t in TYPES]), geom["type"]).cast("int") - 1
