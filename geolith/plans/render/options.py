"""What a map looks like."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, fields, replace
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ...errors import GeoError

Color = tuple[int, int, int, int]


def parse_color(text: str) -> Color:
    """``#RRGGBB`` or ``#RRGGBBAA``."""
    digits = text.removeprefix("#")
    if len(digits) not in (6, 8) or not text.startswith("#"):
        raise GeoError(f"invalid colour {text!r}")
    try:
        values = tuple(bytes.fromhex(digits))
    except ValueError as e:
        raise GeoError(f"invalid colour {text!r}") from e
    return (*values, 255)[:4]


@dataclass(frozen=True)
class Style:
    """Overrides of a layer; None inherits. ``label`` names a property."""

    stroke: Any = None
    fill: Any = None
    stroke_width: float | None = None
    point_radius: float | None = None
    label: str | None = None
    label_size: float | None = None
    label_color: Color | None = None
    label_halo: Color | None = None
    label_knockout: Color | None = None
    label_priority: str | None = None

    def over(self, base: Style) -> Style:
        return replace(base, **{f.name: v for f in fields(self) if (v := getattr(self, f.name)) is not None})


@dataclass(frozen=True)
class Options:
    width: int = 2048
    height: int = 0
    max_dimension: int = 0
    padding: int = 8
    bounds: tuple[float, float, float, float] | None = None
    projection: str = "Auto"
    background: Color = (255, 255, 255, 255)
    ocean: Color | None = None
    stroke_auto_scale: bool = True
    compression: int = 6
    base: Style = Style((30, 30, 30, 255), (70, 130, 180, 120), 2.0, 4.0, None, 14.0, (20, 20, 20, 255), (255, 255, 255, 200))
    #: By layer name; the empty name is the root.
    layers: Mapping[str, Style] = None  # type: ignore[assignment]

    def style(self, layer: str) -> Style:
        own = (self.layers or {}).get(layer)
        return own.over(self.base) if own else self.base


def resolve_styles(df: DataFrame, key: str, styles: Mapping[str, Style], base: Style) -> DataFrame:
    """df with a column per property that base sets: the layer's own value, else base's. The style table is as small as its mapping."""
    names = [f.name for f in fields(Style) if getattr(base, f.name) is not None]
    value = lambda v: F.lit(v)
    for n in names:
        own = F.lit(None)
        for layer, s in styles.items():
            if getattr(s, n) is not None:
                own = F.when(F.col(key) == layer, value(getattr(s, n))).otherwise(own)
        df = df.withColumn(n, F.coalesce(own, value(getattr(base, n))))
    return df
