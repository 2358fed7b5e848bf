"""A canvas of straight-alpha pixels and what is painted on it, rows ``top`` to ``top + height`` of the image."""

from __future__ import annotations

import math

import numpy as np


class Canvas:
    def __init__(self, width: int, height: int, background, top: int = 0):
        self.width, self.height, self.top = width, height, top
        self.pixels = np.empty((height, width, 4), np.uint8)
        self.pixels[:] = background

    def blend(self, region, color, alpha: np.ndarray) -> None:
        """Source over destination with an alpha per pixel, truncated as it goes: order counts."""
        dst = self.pixels[region]
        a = alpha[..., None] / 255.0
        src = np.empty(dst.shape)
        src[..., :3] = np.array(color[:3], float) * a
        src[..., 3] = alpha
        out = (src + dst * (1 - a)).astype(np.uint8)
        full = alpha == 255
        out[full] = (*color[:3], 255)
        out[alpha == 0] = dst[alpha == 0]
        self.pixels[region] = out

    def _window(self, x0: float, y0: float, x1: float, y1: float):
        """Whole pixels of the box on this canvas, or None."""
        if not all(map(math.isfinite, (x0, y0, x1, y1))):
            return None
        a, b = max(0, math.floor(x0)), min(self.width - 1, math.ceil(x1))
        c, d = max(self.top, math.floor(y0)), min(self.top + self.height - 1, math.ceil(y1))
        return (a, b, c, d) if a <= b and c <= d else None

    def _paint(self, window, color, distance, outer: float) -> None:
        a, b, c, d = window
        x, y = np.arange(a, b + 1, dtype=float)[None, :], np.arange(c, d + 1, dtype=float)[:, None]
        coverage = np.clip(outer - distance(x, y), 0, 1)
        alpha = np.floor(color[3] * coverage).astype(np.int64)
        self.blend((slice(c - self.top, d + 1 - self.top), slice(a, b + 1)), color, alpha)

    def disc(self, cx: float, cy: float, radius: float, color) -> None:
        outer = max(radius, 0.5) + 0.5
        window = self._window(cx - outer, cy - outer, cx + outer, cy + outer)
        if window:
            self._paint(window, color, lambda x, y: np.sqrt((x - cx) ** 2 + (y - cy) ** 2), outer)

    def stroke(self, x0: float, y0: float, x1: float, y1: float, width: float, color) -> None:
        """A round-capped line; one thinner than a pixel fades instead."""
        color = (*color[:3], int(color[3] * min(width, 1.0)))
        radius = max(width / 2, 0.5)
        dx, dy = x1 - x0, y1 - y0
        square = dx * dx + dy * dy
        if square == 0:
            self.disc(x0, y0, radius, color)
            return
        outer = radius + 0.5
        window = self._window(min(x0, x1) - outer, min(y0, y1) - outer, max(x0, x1) + outer, max(y0, y1) + outer)
        if not window:
            return

        def distance(x, y):
            t = np.clip(((x - x0) * dx + (y - y0) * dy) / square, 0, 1)
            return np.sqrt((x - (x0 + t * dx)) ** 2 + (y - (y0 + t * dy)) ** 2)

        self._paint(window, color, distance, outer)

    def fill(self, rings: list[np.ndarray], color) -> None:
        """Even-odd over all rings together, at the middle of each row."""
        rings = [r for r in rings if len(r)]
        if not rings or color[3] == 0:
            return
        a = np.concatenate(rings)
        b = np.concatenate([np.roll(r, -1, 0) for r in rings])
        if not np.isfinite(a).all():
            return
        low, high = a[:, 1].min(), a[:, 1].max()
        for y in range(max(self.top, math.ceil(low)), min(self.top + self.height - 1, math.floor(high)) + 1):
            scan = y + 0.5
            hit = ((a[:, 1] <= scan) & (b[:, 1] > scan)) | ((b[:, 1] <= scan) & (a[:, 1] > scan))
            p, q = a[hit], b[hit]
            xs = np.sort(p[:, 0] + (scan - p[:, 1]) / (q[:, 1] - p[:, 1]) * (q[:, 0] - p[:, 0]))
            for s, e in zip(xs[::2], xs[1::2], strict=False):
                s, e = max(math.ceil(s - 0.5), 0), min(math.floor(e - 0.5), self.width - 1)
                if s <= e:
                    self.blend((y - self.top, slice(s, e + 1)), color, np.full(e + 1 - s, color[3]))

    def rect(self, x0: float, y0: float, x1: float, y1: float, color) -> None:
        a, b = max(0, math.floor(x0)), min(self.width - 1, math.ceil(x1) - 1)
        c, d = max(self.top, math.floor(y0)), min(self.top + self.height - 1, math.ceil(y1) - 1)
        if color[3] and a <= b and c <= d:
            self.blend((slice(c - self.top, d + 1 - self.top), slice(a, b + 1)), color, np.full((d + 1 - c, b + 1 - a), color[3]))
