"""Maps: features to pixels as a DataFrame plan that ends in a PNG."""

from .options import Options, Style, parse_color, resolve_styles
from .plan import render_png

__all__ = ["Options", "Style", "parse_color", "render_png", "resolve_styles"]
