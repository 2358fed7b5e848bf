"""A single-stroke font on a grid: columns 0 to 4, rows 0 (baseline) to 6 (cap height), below 0 as letters a (-1) and b (-2).

Each glyph is polylines of column-row pairs. Lower case is upper case at three quarters of its height. Combining marks sit above.
"""

from __future__ import annotations

import unicodedata

CAP = 14.0  # units
TOP = 17.0
BOTTOM = -4.0
TRACKING = 2.0
_CELL = CAP / 6
_NARROW = 0.75

_GLYPHS = {
    "A": "00032643 40|0242", "B": "0006364534330333 42410030 00|0333", "C": "4535160501103041".replace(" ", ""), "D": "0006264442200 0", "E": "46060040|0333",
    "F": "460600|0333", "G": "45361605011030414323", "H": "0006|4640|0343", "I": "1636|2620|1030", "J": "3631201001", "K": "0006|4603|1340", "L": "060040",
    "M": "0006234640", "N": "00064046", "O": "1636453110010516", "P": "0006364534330 3", "Q": "163645411001 0516|2240", "R": "000636453433 03|2340",
    "S": "4536160514334230100 1", "T": "0646|2620", "U": "060110304146", "V": "062046", "W": "0610233046", "X": "0046|0640", "Y": "0623|4623|2320", "Z": "06460040",
    "0": "1636454130100105 16|0145", "1": "152620|1030", "2": "05163645440040", "3": "0516364534234241301001|2333", "4": "30360242", "5": "460603334241301001", "6": "4536160501103041423302",
    "7": "064610", "8": "1636454433130405 16|1333424130100102 13", "9": "01103041453616050413 33 44",
    "!": "2622|2120", "?": "051636454323 22|2120", ".": "2021", ",": "211a", ":": "2425|2122", ";": "2425|211a", "-": "1333", "_": "0040", "+": "1333|2422", "=": "1434|1232",
    "/": "0046", "\\": "0640", "|": "2620", "(": "3625213 0", ")": "1625211 0", "[": "36161030", "]": "16363010", "{": "36252413222 130", "}": "162524332221 10", "<": "351331", ">": "153311",
    "'": "2624", '"': "1614|3634", "*": "1531|3511|2521", "#": "1016|3036|0444|0242", "%": "0046|0605|4140", "&": "40051635030 1103042", "@": "3433232132343 645160501103 0", "$": "4535150414334231 1101|2620",
    "^": "142634", "`": "1625", "~": "03143243", " ": "",
}
#: Strokes of combining marks, by what Unicode calls them, in units from the left edge and the baseline.
_MARKS = {
    "̀": [(3, 16.5), (5, 15)], "́": [(5, 15), (7, 16.5)], "̂": [(3, 15), (5, 16.5), (7, 15)], "̃": [(2, 15), (4, 16.2), (6, 15.2), (8, 16.5)],
    "̄": [(3, 15.5), (7, 15.5)], "̈": [(3, 15.5), (3.2, 15.5), (6.8, 15.5), (7, 15.5)], "̊": [(4, 15.5), (5, 16.5), (6, 15.5), (5, 15), (4, 15.5)], "̌": [(3, 16.5), (5, 15), (7, 16.5)], "̧": [(5, 0), (5, -2), (4, -3)],
}


def _polylines(code: str) -> list[list[tuple[float, float]]]:
    out = []
    for line in code.replace(" ", "").split("|"):
        pairs = [(int(line[i]), {"a": -1, "b": -2}.get(line[i + 1]) if line[i + 1] in "ab" else int(line[i + 1])) for i in range(0, len(line) - 1, 2)]
        if pairs:
            out.append([(x * 2.5, y * _CELL) for x, y in pairs])
    return out


def _glyph(c: str) -> tuple[float, list[list[tuple[float, float]]]]:
    """(advance, polylines); an unknown character is a question mark."""
    if c.islower() and c.upper() in _GLYPHS:
        return 10 * _NARROW, [[(x * _NARROW, y * _NARROW) for x, y in p] for p in _polylines(_GLYPHS[c.upper()])]
    code = _GLYPHS.get(c, _GLYPHS["?"])
    return (5.0 if c in " .,:;!|'" else 10.0), _polylines(code)


def strokes(text: str) -> tuple[float, list[list[tuple[float, float]]]]:
    """(width, polylines) of a text in units. A mark without a base, or of a kind not drawn, is left out."""
    x, out, base = 0.0, [], None
    for c in unicodedata.normalize("NFD", text):
        if unicodedata.combining(c):
            if base is not None and c in _MARKS:
                drop = 0 if base[1] else (1 - _NARROW) * CAP
                mark = _MARKS[c]
                shift = base[0] + (0 if base[1] else -1.25)
                points = [(shift + a, b - (drop if b > 0 else 0)) for a, b in mark]
                out += [points[:2], points[2:]] if c == "̈" else [points]
            continue
        if base is not None:
            x += TRACKING
        advance, lines = _glyph(c)
        out += [[(x + a, b) for a, b in p] for p in lines]
        base = (x, not c.islower())
        x += advance
    return x, out


def measure(text: str, size: float) -> float:
    return strokes(text)[0] * size / CAP
