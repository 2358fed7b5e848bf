"""From longitude and latitude to pixels, in numpy: projection, canvas, lobes."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np

from ...errors import GeoError
from ...functions.projections import LOBES, MERCATOR_LIMIT, POLE_LIMIT, _BAND, _SHIFT, Lambert
from .options import Options

#: Outline of each lobe, as corners from the east end of its equator edge on.
OUTLINES = (
    ((-40, 0), (-180, 0), (-180, 90), (-10, 90), (-10, 60), (-40, 60)),
    ((180, 0), (-40, 0), (-40, 60), (-10, 60), (-10, 90), (180, 90)),
    ((-100, 0), (-180, 0), (-180, -90), (-100, -90)),
    ((-20, 0), (-100, 0), (-100, -90), (-20, -90)),
    ((80, 0), (-20, 0), (-20, -90), (80, -90)),
    ((180, 0), (80, 0), (80, -90), (180, -90)),
)


def _even_round(v: float) -> int:
    return round(v)  # halves to even


def find_lobe(lon: np.ndarray, lat: np.ndarray) -> np.ndarray:
    found = np.full(lon.shape, -1)
    for i, (_, rects) in enumerate(LOBES):
        for a, b, c, d in rects:
            found[(found < 0) & (lon >= a) & (lon <= b) & (lat >= c) & (lat <= d)] = i
    for j in np.flatnonzero(found < 0):
        same = [(abs(lon[j] - cm), i) for i, (cm, rects) in enumerate(LOBES) if (lat[j] >= 0) == (rects[0][2] >= 0)]
        found[j] = min(same)[1]
    return found


def _theta(phi: np.ndarray) -> np.ndarray:
    t = np.arcsin(2 * phi / np.pi)
    for _ in range(8):
        t = t - (2 * t + np.sin(2 * t) - np.pi * np.sin(phi)) / (4 * np.cos(t) ** 2)
    return t


def homolosine(lon: np.ndarray, lat: np.ndarray, meridian) -> tuple[np.ndarray, np.ndarray]:
    phi = np.radians(np.clip(lat, -POLE_LIMIT, POLE_LIMIT))
    turn = np.radians(lon - meridian)
    t = _theta(phi)
    band = np.abs(phi) <= _BAND
    x = np.where(band, turn * np.cos(phi), 2 * math.sqrt(2) / np.pi * turn * np.cos(t))
    y = np.where(band, phi, math.sqrt(2) * np.sin(t) - np.where(phi >= 0, _SHIFT, -_SHIFT))
    return np.degrees(x) + meridian, np.degrees(y)


@dataclass
class Frame:
    """Everything a task needs to place geometry on the canvas."""

    kind: str
    bounds: tuple[float, float, float, float]
    cone: Lambert | None
    width: int = 0
    height: int = 0
    scale: float = 1.0
    dx: float = 0.0
    dy: float = 0.0
    minx: float = 0.0
    miny: float = 0.0

    def project(self, lon: np.ndarray, lat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if self.kind == "WebMercator":
            return lon, np.degrees(np.log(np.tan(np.pi / 4 + np.radians(np.clip(lat, -MERCATOR_LIMIT, MERCATOR_LIMIT)) / 2)))
        if self.kind == "Lambert":
            c = self.cone
            rho = c.scale / np.tan(np.pi / 4 + np.radians(np.clip(lat, -POLE_LIMIT, POLE_LIMIT)) / 2) ** c.n
            turn = c.n * (np.radians(lon) - c.lon0)
            return np.degrees(rho * np.sin(turn)), np.degrees(c.rho0 - rho * np.cos(turn))
        if self.kind == "Goode":
            return homolosine(lon, lat, np.array([cm for cm, _ in LOBES])[find_lobe(lon, lat)])
        return lon, lat

    def place(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        return np.stack([self.dx + (x - self.minx) * self.scale, self.height - self.dy - (y - self.miny) * self.scale], 1)

    def pixels(self, ps: np.ndarray) -> np.ndarray:
        return self.place(*self.project(ps[:, 0], ps[:, 1]))

    def lobe_pixels(self, ps: np.ndarray, lobe: int) -> np.ndarray:
        return self.place(*homolosine(ps[:, 0], ps[:, 1], LOBES[lobe][0]))

    def stroke_multiplier(self) -> float:
        w, h = self.bounds[2] - self.bounds[0], self.bounds[3] - self.bounds[1]
        per_degree = min(self.width / w if w else math.inf, self.height / h if h else math.inf)
        zoom = math.log2(per_degree * 360 / 256) if math.isfinite(per_degree) else math.inf
        return min(6.0, max(0.1, math.sqrt(2) ** (zoom - 10))) if math.isfinite(zoom) else 6.0


def frame(options: Options, bounds: tuple[float, float, float, float] | None) -> Frame:
    """Checks before any pixel is made: an empty extent or a width that is not positive is an error."""
    if bounds is None or not all(map(math.isfinite, bounds)):
        raise GeoError("nothing to render: the extent is empty")
    if options.max_dimension <= 0 and options.width <= 0:
        raise GeoError("the width must be positive")
    w, h = bounds[2] - bounds[0], bounds[3] - bounds[1]
    kind = options.projection
    if kind == "Auto":
        kind = "Goode" if w >= 180 or h >= 90 else "PlateCarree" if w >= 90 or h >= 60 else "Lambert"
    cone = Lambert.fit(*bounds) if kind == "Lambert" else None
    if kind == "Lambert" and cone is None:
        kind = "PlateCarree"
    f = Frame(kind, bounds, cone)
    t = np.linspace(0, 1, 17)
    lon, lat = bounds[0] + t * w, bounds[1] + t * h
    if kind in ("Lambert", "Goode"):
        x, y = f.project(np.concatenate([lon, lon, np.full(17, bounds[0]), np.full(17, bounds[2])]), np.concatenate([np.full(17, bounds[1]), np.full(17, bounds[3]), lat, lat]))
    else:
        x, y = f.project(np.array([bounds[0], bounds[2]]), np.array([bounds[1], bounds[3]]))
    f.minx, f.miny = float(x.min()), float(y.min())
    pw, ph = float(x.max()) - f.minx or 1.0, float(y.max()) - f.miny or 1.0
    if options.max_dimension > 0:
        n = options.max_dimension
        f.width, f.height = (n, max(1, _even_round(n * ph / pw))) if pw >= ph else (max(1, _even_round(n * pw / ph)), n)
    else:
        f.width = options.width
        f.height = options.height if options.height > 0 else max(1, _even_round(options.width * ph / pw))
    f.scale = min(max(1, f.width - 2 * options.padding) / pw, max(1, f.height - 2 * options.padding) / ph)
    f.dx, f.dy = (f.width - pw * f.scale) / 2, (f.height - ph * f.scale) / 2
    return f


# clipping to lobes


def clip_ring(ring: np.ndarray, rect: tuple[float, float, float, float]) -> tuple[np.ndarray, np.ndarray]:
    """The ring inside the rectangle and, for each vertex, the side (1, 2, 4, 8) that made it, or 0. Sides are dealt with in that order;
    edges along a side get fifteen points between, so that they can bend with the projection."""
    ps, tags = np.asarray(ring, float).reshape(-1, 2), np.zeros(len(ring), int)
    if not len(ps):
        return ps, tags
    (x0, y0), (x1, y1) = ps.min(0), ps.max(0)
    if x1 < rect[0] or x0 > rect[1] or y1 < rect[2] or y0 > rect[3]:
        return ps[:0], tags[:0]
    if x0 >= rect[0] and x1 <= rect[1] and y0 >= rect[2] and y1 <= rect[3]:
        return ps, tags
    for axis, limit, sign, tag in ((0, rect[0], 1, 1), (0, rect[1], -1, 2), (1, rect[2], 1, 4), (1, rect[3], -1, 8)):
        if not len(ps):
            break
        before, tag_in = np.roll(ps, 1, 0), (ps[:, axis] - limit) * sign >= 0
        crossing = tag_in != np.roll(tag_in, 1)
        with np.errstate(divide="ignore", invalid="ignore"):
            t = (limit - before[:, axis]) / (ps[:, axis] - before[:, axis])
            hit = before + t[:, None] * (ps - before)
        hit[:, axis] = limit
        both = np.stack([hit, ps], 1).reshape(-1, 2)
        both_tags = np.stack([np.full(len(ps), tag), tags], 1).ravel()
        keep = np.stack([crossing, tag_in], 1).ravel()
        ps, tags = both[keep], both_tags[keep]
    if not len(ps):
        return ps, tags
    after, after_tags = np.roll(ps, -1, 0), np.roll(tags, -1)
    out, out_tags = [], []
    steps = np.arange(1, 16)[:, None] / 16
    for p, q, a, b in zip(ps, after, tags, after_tags, strict=True):
        out.append(p[None])
        out_tags.append([a])
        if a & b:
            out.append(p + steps * (q - p))
            out_tags.append([a & b] * 15)
    return np.concatenate(out), np.concatenate(out_tags)


def stroke_chains(points: np.ndarray, tags: np.ndarray) -> list[np.ndarray]:
    """Runs of edges that do not lie along a side; a run does not go on past the start of the ring."""
    along = (tags & np.roll(tags, -1)) != 0
    chains, start = [], 0
    n = len(points)
    for i in range(n):
        if along[i]:
            if i > start:
                chains.append(points[start : i + 1])
            start = i + 1
    if start < n:
        chains.append(np.concatenate([points[start:], points[:1]]))
    return [c for c in chains if len(c) >= 2]


def split_path(path: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """(lobe, positions) of the stretches of a path; the point on the border ends one and begins the next."""
    if len(path) < 2:
        return []
    lobes = find_lobe(path[:, 0], path[:, 1])
    out, now = [], [path[0]]
    for i in range(1, len(path)):
        a, b = path[i - 1], path[i]
        if lobes[i] != lobes[i - 1]:
            one, two = LOBES[lobes[i - 1]][1], LOBES[lobes[i]][1]
            if (one[0][2] >= 0) != (two[0][2] >= 0):
                p = np.array([a[0] + (0 - a[1]) / (b[1] - a[1]) * (b[0] - a[0]), 0.0])
            else:
                lo, hi = min(a[0], b[0]), max(a[0], b[0])
                shared = [m for r in one for m in r[:2] if lo <= m <= hi and any(m in s[:2] for s in two)]
                x = shared[0] if shared else (lo + hi) / 2
                p = np.array([x, a[1] + (x - a[0]) / (b[0] - a[0]) * (b[1] - a[1])]) if b[0] != a[0] else np.array([x, (a[1] + b[1]) / 2])
            out.append((int(lobes[i - 1]), np.array([*now, p])))
            now = [p]
        now.append(b)
    out.append((int(lobes[-1]), np.array(now)))
    return out


def sample(corners, per_edge: int, closed: bool = True) -> np.ndarray:
    ps = np.array(corners, float)
    after = np.roll(ps, -1, 0) if closed else ps[1:]
    ps = ps if closed else ps[:-1]
    t = np.arange(per_edge)[:, None] / per_edge
    walk = np.concatenate([p + t * (q - p) for p, q in zip(ps, after, strict=True)])
    return walk if closed else np.concatenate([walk, after[-1:]])


def ocean(f: Frame) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """(rings to fill, paths to stroke) of the world or of each lobe that meets the extent; no stroke along the equator."""
    b = f.bounds
    if f.kind != "Goode":
        ring = f.pixels(sample([(b[0], b[1]), (b[2], b[1]), (b[2], b[3]), (b[0], b[3])], 16))
        return [ring], [np.concatenate([ring, ring[:1]])]
    rings, paths = [], []
    for i, (_, rects) in enumerate(LOBES):
        if any(r[1] > b[0] and r[0] < b[2] and r[3] > b[1] and r[2] < b[3] for r in rects):
            o = OUTLINES[i]
            rings.append(f.lobe_pixels(sample(o, 32), i))
            paths.append(f.lobe_pixels(sample([*o[1:], o[0]], 32, closed=False), i))  # the first edge is the equator
    return rings, paths
