"""``python -m geolith input output``: conversion from the command line."""

from __future__ import annotations

import argparse
import sys

from .errors import GeoError
from .formats import FORMATS, detect, named

PROJECTIONS = {
    "auto": "Auto", "automatic": "Auto", "plate-carree": "PlateCarree", "platecarree": "PlateCarree", "equirectangular": "PlateCarree", "web-mercator": "WebMercator", "webmercator": "WebMercator",
    "mercator": "WebMercator", "lambert": "Lambert", "lcc": "Lambert", "goode": "Goode", "homolosine": "Goode",
}


def parse_size(text: str) -> tuple[int, int]:
    """``W`` or ``WxH``, positive."""
    parts = text.lower().split("x")
    if len(parts) > 2 or not all(p.isdigit() and int(p) > 0 for p in parts):
        raise GeoError(f"invalid size {text!r}")
    return int(parts[0]), int(parts[1]) if len(parts) == 2 else 0


def parse_bounds(text: str) -> tuple[float, float, float, float]:
    try:
        values = tuple(float(p) for p in text.split(","))
    except ValueError as e:
        raise GeoError(f"invalid bbox {text!r}") from e
    if len(values) != 4:
        raise GeoError(f"invalid bbox {text!r}")
    return values


def parse_projection(text: str) -> str:
    if text.lower() not in PROJECTIONS:
        raise GeoError(f"unknown projection {text!r}")
    return PROJECTIONS[text.lower()]


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser("geolith", description="Convert between geospatial formats. Formats come from the extensions unless --from and --to name them.")
    p.add_argument("paths", nargs="*", metavar="input output")
    for name, text in (("from", "format of the input"), ("to", "format of the output"), ("bbox", "minX,minY,maxX,maxY to render"), ("size", "WIDTH[xHEIGHT] of the image"), ("projection", "auto, plate-carree, web-mercator, lambert or goode"), ("label", "property to label features with"), ("label-color", "#RRGGBB[AA]"), ("label-halo", "#RRGGBB[AA] or none"), ("label-knockout", "#RRGGBB[AA] or none")):
        p.add_argument(f"--{name}", dest=name.replace("-", "_"), help=text)
    p.add_argument("--max-dimension", type=int, default=0, help="longer side of the image")
    p.add_argument("--label-size", type=float, help="cap height of labels in pixels")
    p.add_argument("--list", action="store_true", help="list the formats")
    return p


def options_of(a: argparse.Namespace):
    from .plans.render import Options, Style, parse_color

    base = Options().base
    color = lambda t: None if t is None else (0, 0, 0, 0) if t == "none" else parse_color(t)
    if a.label_size is not None and not a.label_size > 0:
        raise GeoError("invalid label size")
    if a.max_dimension < 0:
        raise GeoError("invalid max dimension")
    style = Style(label=a.label, label_size=a.label_size, label_color=color(a.label_color), label_halo=color(a.label_halo), label_knockout=None if a.label_knockout == "none" else color(a.label_knockout)).over(base)
    width, height = parse_size(a.size) if a.size else (Options.width, 0)
    return Options(width=width, height=height, max_dimension=a.max_dimension, bounds=parse_bounds(a.bbox) if a.bbox else None, projection=parse_projection(a.projection or "auto"), base=style)


def run(args: list[str], spark=None, out=None, err=None) -> int:
    """0: done; 1: bad data or no such file; 2: wrong usage."""
    out, err = out or sys.stdout, err or sys.stderr
    p, joined = parser(), []
    valued = {o for x in p._actions if x.nargs is None and x.option_strings for o in x.option_strings}
    for x in args:  # a value may begin with a minus
        if joined and joined[-1] in valued and not x.startswith("--"):
            joined[-1] += f"={x}"
        else:
            joined.append(x)
    try:
        a = p.parse_args(joined)
    except SystemExit as e:
        return 0 if e.code == 0 else 2
    if a.list:
        for f in FORMATS:
            print(f"{f.name:<11}{' '.join(f.extensions)}{'' if f.reads else ' (write only)'}", file=out)
        return 0
    try:
        if len(a.paths) != 2:
            raise GeoError("give an input and an output")
        source, target = a.paths
        formats = (named(a.__dict__["from"]) if a.__dict__["from"] else detect(source)), (named(a.to) if a.to else detect(target))
        options = options_of(a)
    except GeoError as e:
        print(e, file=err)
        return 2
    from pyspark.errors import PySparkException
    from pyspark.sql import SparkSession

    from .convert import convert

    spark = spark or SparkSession.builder.appName("geolith").getOrCreate()
    try:
        convert(spark, source, target, *formats, **({"options": options} if formats[1] == "png" else {}))
    except (GeoError, PySparkException) as e:
        print(str(e).strip().splitlines()[-1] if isinstance(e, PySparkException) else e, file=err)
        return 1
    print(f"{source} -> {target}", file=out)
    return 0
