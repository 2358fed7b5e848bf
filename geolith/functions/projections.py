"""Map projections of longitude and latitude in degrees, to degree-sized units, as column expressions."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from .geometry import envelope_height, envelope_width, let

MERCATOR_LIMIT = 85.05112877980659
POLE_LIMIT = 89.999
GOODE_BAND = 40.7368
WORLD = (-180.0, -85.0511, 180.0, 85.0511)

KINDS = ("Auto", "PlateCarree", "WebMercator", "Lambert", "Goode")

#: Central meridian and rectangles (lon from, to, lat from, to) of each lobe, in order.
LOBES = (
    (-100.0, ((-180.0, -40.0, 0.0, 60.0), (-180.0, -10.0, 60.0, 90.0))),
    (30.0, ((-40.0, 180.0, 0.0, 60.0), (-10.0, 180.0, 60.0, 90.0))),
    (-160.0, ((-180.0, -100.0, -90.0, 0.0),)),
    (-60.0, ((-100.0, -20.0, -90.0, 0.0),)),
    (20.0, ((-20.0, 80.0, -90.0, 0.0),)),
    (140.0, ((80.0, 180.0, -90.0, 0.0),)),
)


def auto_projection(e: Column) -> Column:
    """Goode for the world, PlateCarree for a continent, Lambert below."""
    w, h = envelope_width(e), envelope_height(e)
    return F.when((w >= 180) | (h >= 90), "Goode").when((w >= 90) | (h >= 60), "PlateCarree").otherwise("Lambert")


def _clamp(c: Column, limit: float) -> Column:
    return F.least(F.lit(limit), F.greatest(F.lit(-limit), c))


def _degrees(c: Column) -> Column:
    return c * 180 / math.pi


def mercator_y(lat: Column) -> Column:
    return _degrees(F.log(F.tan(math.pi / 4 + _clamp(lat, MERCATOR_LIMIT) * math.pi / 180 / 2)))


@dataclass(frozen=True)
class Lambert:
    """A conformal cone for an extent, computed once on the driver; ``fit`` gives none where the cone is a cylinder."""

    lon0: float
    n: float
    scale: float
    rho0: float

    @staticmethod
    def fit(minx: float, miny: float, maxx: float, maxy: float) -> Lambert | None:
        sixth = (maxy - miny) / 6
        one, two, mid, lon0 = (math.radians(v) for v in (miny + sixth, maxy - sixth, (miny + maxy) / 2, (minx + maxx) / 2))
        stretch = lambda phi: math.tan(math.pi / 4 + phi / 2)
        try:
            n = math.sin(one) if abs(one - two) < 1e-10 else math.log(math.cos(one) / math.cos(two)) / math.log(stretch(two) / stretch(one))
            if not math.isfinite(n) or abs(n) < 1e-6:
                return None
            scale = math.cos(one) * stretch(one) ** n / n
            return Lambert(lon0, n, scale, scale / stretch(mid) ** n)
        except (ValueError, ZeroDivisionError, OverflowError):
            return None

    def project(self, lon: Column, lat: Column) -> tuple[Column, Column]:
        phi = _clamp(lat, POLE_LIMIT) * math.pi / 180
        rho = self.scale / F.pow(F.tan(math.pi / 4 + phi / 2), F.lit(self.n))
        turn = self.n * (lon * math.pi / 180 - self.lon0)
        return _degrees(rho * F.sin(turn)), _degrees(self.rho0 - rho * F.cos(turn))


def _theta(phi: float) -> float:
    t = math.asin(2 * phi / math.pi)
    for _ in range(8):
        t -= (2 * t + math.sin(2 * t) - math.pi * math.sin(phi)) / (4 * math.cos(t) ** 2)
    return t


_BAND = GOODE_BAND * math.pi / 180
_SHIFT = math.sqrt(2) * math.sin(_theta(_BAND)) - _BAND


def mollweide_theta(phi: Column) -> Column:
    """Newton's method, eight steps from asin(2 phi / pi)."""
    step = lambda t, _: t - (2 * t + F.sin(2 * t) - math.pi * F.sin(phi)) / (4 * F.cos(t) * F.cos(t))
    return F.aggregate(F.sequence(F.lit(1), F.lit(8)), F.asin(2 * phi / math.pi), step)


def goode_in_lobe(lon: Column, lat: Column, meridian: Column) -> Column:
    """struct(x, y) of the homolosine in the lobe with that central meridian."""

    def of(phi: Column) -> Column:
        turn = (lon - meridian) * math.pi / 180

        def cap(theta: Column) -> Column:
            y = math.sqrt(2) * F.sin(theta)
            return F.struct(_degrees(2 * math.sqrt(2) / math.pi * turn * F.cos(theta)).alias("x"), _degrees(F.when(phi >= 0, y - _SHIFT).otherwise(y + _SHIFT)).alias("y"))

        band = F.struct(_degrees(turn * F.cos(phi)).alias("x"), _degrees(phi).alias("y"))
        return let(F.when(F.abs(phi) <= _BAND, band).otherwise(let(mollweide_theta(phi), cap)), lambda p: F.struct((p["x"] + meridian).alias("x"), p["y"].alias("y")))

    return let(_clamp(lat, POLE_LIMIT) * math.pi / 180, of)


def lobe_of(lon: Column, lat: Column) -> Column:
    """Index of the first lobe with a rectangle that holds the point; outside of all, the nearest meridian of the hemisphere."""
    found = F.lit(None).cast("int")
    for i, (_, rects) in reversed(list(enumerate(LOBES))):
        for a, b, c, d in rects:
            found = F.when((lon >= a) & (lon <= b) & (lat >= c) & (lat <= d), i).otherwise(found)
    nearest = F.array_min(F.array(*[F.when((lat >= 0) == F.lit(rects[0][2] >= 0), F.struct(F.abs(lon - cm).alias("d"), F.lit(i).alias("i"))) for i, (cm, rects) in enumerate(LOBES)]))["i"]
    return F.coalesce(found, nearest)


def lobe_meridian(lobe: Column) -> Column:
    return F.element_at(F.array(*[F.lit(cm) for cm, _ in LOBES]), lobe + 1)


def goode(lon: Column, lat: Column) -> Column:
    return goode_in_lobe(lon, lat, lobe_meridian(lobe_of(lon, lat)))


def project(kind: str, lon: Column, lat: Column, extent: tuple[float, float, float, float] | None = None) -> Column:
    """struct(x, y). Lambert needs the extent it is fitted to, and falls back to PlateCarree where it cannot be."""
    if kind == "WebMercator":
        return F.struct(lon.alias("x"), mercator_y(lat).alias("y"))
    if kind == "Goode":
        return goode(lon, lat)
    if kind == "Lambert" and (cone := Lambert.fit(*extent)):
        x, y = cone.project(lon, lat)
        return F.struct(x.alias("x"), y.alias("y"))
    return F.struct(lon.alias("x"), lat.alias("y"))


def project_envelope(kind: str, e: Column, samples: int = 16) -> Column:
    """Envelope of the projected extent: corners for straight projections, 17 points an edge for curved ones."""
    if kind in ("PlateCarree", "WebMercator"):
        y = mercator_y if kind == "WebMercator" else lambda c: c
        return F.struct(e["minx"].alias("minx"), y(e["miny"]).alias("miny"), e["maxx"].alias("maxx"), y(e["maxy"]).alias("maxy"))
    steps = F.transform(F.sequence(F.lit(0), F.lit(samples)), lambda i: i / samples)
    lon, lat = lambda t: e["minx"] + t * (e["maxx"] - e["minx"]), lambda t: e["miny"] + t * (e["maxy"] - e["miny"])
    at = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    edges = F.flatten(F.transform(steps, lambda t: F.array(at(lon(t), e["miny"]), at(lon(t), e["maxy"]), at(e["minx"], lat(t)), at(e["maxx"], lat(t)))))

    def box(ps: Column) -> Column:
        xs, ys = F.transform(ps, lambda p: p["x"]), F.transform(ps, lambda p: p["y"])
        return F.struct(F.array_min(xs).alias("minx"), F.array_min(ys).alias("miny"), F.array_max(xs).alias("maxx"), F.array_max(ys).alias("maxy"))

    return let(F.transform(edges, lambda p: goode(p["x"], p["y"])), box)


def canvas_fit(width: Column, height: Column, *, out_width: int = 2048, out_height: int = 0, max_dimension: int = 0, padding: int = 8) -> Column:
    """struct(w, h, scale, dx, dy) for projected extents; halves round to even, and an extent of 0 counts as 1."""

    def of(s: Column) -> Column:
        w, h = s["w"], s["h"]
        side = lambda n, a, b: F.greatest(F.lit(1), F.bround(F.lit(float(n)) * a / b).cast("int"))
        if max_dimension > 0:
            cw, ch = F.when(w >= h, F.lit(max_dimension)).otherwise(side(max_dimension, w, h)), F.when(w >= h, side(max_dimension, h, w)).otherwise(F.lit(max_dimension))
        else:
            cw, ch = F.lit(out_width), F.lit(out_height) if out_height > 0 else side(out_width, h, w)

        def place(c: Column) -> Column:
            inner = lambda n: F.greatest(F.lit(1), n - 2 * padding)
            scale = F.least(inner(c["w"]) / w, inner(c["h"]) / h)
            return let(scale, lambda k: F.struct(c["w"].alias("w"), c["h"].alias("h"), k.alias("scale"), ((c["w"] - w * k) / 2).alias("dx"), ((c["h"] - h * k) / 2).alias("dy")))

        return let(F.struct(cw.alias("w"), ch.alias("h")), place)

    one = lambda c: F.when(c > 0, c).otherwise(1.0)
    return let(F.struct(one(width).alias("w"), one(height).alias("h")), of)


def to_pixel(p: Column, e: Column, fit: Column) -> Column:
    """Pixel of a projected point; rows count down from the top."""
    return F.struct((fit["dx"] + (p["x"] - e["minx"]) * fit["scale"]).alias("x"), (fit["h"] - fit["dy"] - (p["y"] - e["miny"]) * fit["scale"]).alias("y"))


def stroke_multiplier(width: Column, height: Column, e: Column) -> Column:
    """Scale of strokes by zoom: sqrt(2) to the (zoom - 10), from 0.1 to 6; zoom by the input extent."""
    zoom = F.log2(F.least(width / envelope_width(e), height / envelope_height(e)) * 360.0 / 256)
    return F.least(F.lit(6.0), F.greatest(F.lit(0.1), F.pow(F.lit(math.sqrt(2)), zoom - 10)))


def point_multiplier(stroke: Column) -> Column:
    return (stroke + 1) / 2
