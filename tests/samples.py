"""Features that the tests share, made by rules from keys, as the queries make geometry from the star schema."""

from geolith.codecs.base import Feature, Layer, collection, line, multi_line, multi_point, multi_polygon, point, polygon


def p(x, y, z=None, m=None):
    return (float(x), float(y), None if z is None else float(z), None if m is None else float(m))


def square(x, y, n):
    return [p(x, y), p(x + n, y), p(x + n, y + n), p(x, y + n), p(x, y)]


def spot(k, z=None):
    """The place of key k: eighths of a degree, spread by multiples of 37 and 53."""
    return p((k * 37 % 160) / 8, (k * 53 % 120) / 8, z)


def plot(k, hole=False):
    """Rings of part k: a square of side 1 + k mod 4, and in its middle one of half the side."""
    (x, y, *_), n = spot(k), 1 + k % 4
    return [square(x, y, n)] + ([square(x + n / 4, y + n / 4, n / 2)] if hole else [])


def track(k, n, z=None):
    return [spot(k + i, None if z is None else z + i) for i in range(n)]


def trade() -> Layer:
    """A customer, a track of events and a part, with properties of different types and keys."""
    rows = [
        (point(spot(7)), {"name": "Customer#000000007", "orders": 12, "c_acctbal": 711.56}),
        (line(track(3, 5)), {"name": "user 3", "clicks": 5}),
        (polygon(plot(10, True)), {"name": "Brand#10", "returned": False}),
    ]
    return Layer(features=[Feature(g, props) for g, props in rows])


def parts() -> Layer:
    rows = [(polygon(plot(6, True)), 6), (multi_polygon([plot(9), plot(30)]), 9)]
    return Layer(features=[Feature(g, {"name": f"Brand#{k}", "p_price": 900 + k / 8, "p_partkey": k}) for g, k in rows])


def regions() -> Layer:
    """Nations as layers below a region: one with two customers, one with a layer of its own below it, and a feature of the region itself."""
    customer = lambda k: Feature(point(spot(k)), {"name": f"Customer#{k}"})
    suppliers = Layer("suppliers", features=[Feature(line(track(40, 3)), {"name": "Supplier#40"})])
    return Layer("ASIA", {"description": "a region"}, [customer(21)], [Layer("CHINA", features=[customer(k) for k in (22, 23)]), Layer("INDIA", children=[suppliers])])


def recorded() -> Layer:
    """What a device records, in the three layers that GPX names."""
    layer = lambda name, g, k: Layer(name, features=[Feature(g, {"name": f"event {k}"})])
    return Layer(children=[layer("waypoints", point(spot(11, 88)), 11), layer("routes", line(track(12, 4)), 12), layer("tracks", line(track(16, 3, 5)), 16)])


def kinds() -> list:
    """One geometry of each kind; the point has a height."""
    return [point(spot(1, 4)), line(track(2, 3)), polygon(plot(5, True)), multi_point(track(8, 3)), multi_line([track(13, 2), track(15, 4)]), multi_polygon([plot(18), plot(19, True)]), collection([multi_point(track(24, 2)), polygon(plot(26))])]
