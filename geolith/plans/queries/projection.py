"""Queries over projections, canvas fit, lobes and styles. Transcendental results are rounded to six places in both engines."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ...functions import projections as P
from .. import fixtures as fx
from ..catalogue import query


def _points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.event_points(spark, sf_dir).select("event_id", "lon", "lat")


def _rounded(df: DataFrame, p: str = "p") -> DataFrame:
    return df.select("event_id", F.round(f"{p}.x", 6).alias("x"), (F.round(f"{p}.y", 6) + 0.0).alias("y"))


_CLAMP = "least({m}, greatest(-{m}, lat))"


@query(f"WITH {fx.EVENTS} SELECT event_id, round(lon, 6) AS x, round(ln(tan(pi() / 4 + {_CLAMP.format(m=P.MERCATOR_LIMIT)} * pi() / 180 / 2)) * 180 / pi(), 6) + 0.0 AS y FROM ev")
def proj_web_mercator(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(_points(spark, sf_dir).withColumn("p", P.project("WebMercator", F.col("lon"), F.col("lat"))))


@query(f"WITH {fx.EVENTS} SELECT event_id, round(lon, 6) AS x, round(lat, 6) AS y FROM ev")
def proj_plate_carree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(_points(spark, sf_dir).withColumn("p", P.project("PlateCarree", F.col("lon"), F.col("lat"))))


_EXTENT = (-20.0, 30.0, 50.0, 72.0)
_RAD = "pi() / 180"
_LAMBERT = f"""l AS (SELECT *, (minlat + (maxlat - minlat) / 6) * {_RAD} AS p1, (maxlat - (maxlat - minlat) / 6) * {_RAD} AS p2, (minlat + maxlat) / 2 * {_RAD} AS p0, (minlon + maxlon) / 2 * {_RAD} AS l0
    FROM (SELECT {_EXTENT[0]}::DOUBLE AS minlon, {_EXTENT[1]}::DOUBLE AS minlat, {_EXTENT[2]}::DOUBLE AS maxlon, {_EXTENT[3]}::DOUBLE AS maxlat)),
  c AS (SELECT *, ln(cos(p1) / cos(p2)) / ln(tan(pi() / 4 + p2 / 2) / tan(pi() / 4 + p1 / 2)) AS n FROM l),
  s AS (SELECT *, cos(p1) * pow(tan(pi() / 4 + p1 / 2), n) / n AS f FROM c), k AS (SELECT *, f / pow(tan(pi() / 4 + p0 / 2), n) AS rho0 FROM s),
  q AS (SELECT event_id, f / pow(tan(pi() / 4 + {_CLAMP.format(m=P.POLE_LIMIT)} * {_RAD} / 2), n) AS rho, n * (lon * {_RAD} - l0) AS th, rho0 FROM ev, k)"""


@query(f"WITH {fx.EVENTS}, {_LAMBERT} SELECT event_id, round(rho * sin(th) * 180 / pi(), 6) AS x, round((rho0 - rho * cos(th)) * 180 / pi(), 6) AS y FROM q")
def proj_lambert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(_points(spark, sf_dir).withColumn("p", P.project("Lambert", F.col("lon"), F.col("lat"), _EXTENT)))


_LOBE = "CASE " + " ".join(f"WHEN lon BETWEEN {a} AND {b} AND lat BETWEEN {c} AND {d} THEN {i}" for i, (_, rects) in enumerate(P.LOBES) for a, b, c, d in rects) + " END"
_MERIDIAN = "CASE lobe " + " ".join(f"WHEN {i} THEN {cm}::DOUBLE" for i, (cm, _) in enumerate(P.LOBES)) + " END"
_NEWTON = reduce(lambda cte, i: cte + f", t{i + 1} AS (SELECT * EXCLUDE (t), t - (2 * t + sin(2 * t) - pi() * sin(phi)) / (4 * cos(t) * cos(t)) AS t FROM t{i})", range(8), "t0 AS (SELECT *, asin(2 * phi / pi()) AS t FROM lb)")


@query(
    f"""WITH {fx.EVENTS}, la AS (SELECT event_id, lon, {_CLAMP.format(m=P.POLE_LIMIT)} * {_RAD} AS phi, CAST({_LOBE} AS INTEGER) AS lobe FROM ev), lb AS (SELECT *, {_MERIDIAN} AS cm FROM la), {_NEWTON}
    SELECT event_id, lobe, round(CASE WHEN abs(phi) <= {P._BAND!r} THEN (lon - cm) * {_RAD} * cos(phi) ELSE 2 * sqrt(2) / pi() * (lon - cm) * {_RAD} * cos(t) END * 180 / pi() + cm, 6) AS x,
    round(CASE WHEN abs(phi) <= {P._BAND!r} THEN phi WHEN phi >= 0 THEN sqrt(2) * sin(t) - {P._SHIFT!r} ELSE sqrt(2) * sin(t) + {P._SHIFT!r} END * 180 / pi(), 6) AS y FROM t8"""
)
def proj_goode(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _points(spark, sf_dir)
    lobe = P.lobe_of(F.col("lon"), F.col("lat"))
    p = e.select("event_id", lobe.alias("lobe"), P.goode(F.col("lon"), F.col("lat")).alias("p"))
    return p.select("event_id", "lobe", F.round("p.x", 6).alias("x"), F.round("p.y", 6).alias("y"))


@query(f"WITH {fx.CUST}, l AS (SELECT CAST({_LOBE} AS INTEGER) AS lobe FROM cust) SELECT lobe, count(*) AS n FROM l GROUP BY 1")
def goode_lobe_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points per lobe as a range join with the table of rectangles (eight rows), the first hit winning."""
    rects = [(i, r, *map(float, box)) for r, (i, box) in enumerate((i, box) for i, (_, boxes) in enumerate(P.LOBES) for box in boxes)]
    lobes = spark.createDataFrame(rects, "lobe int, rank int, a double, b double, c double, d double")
    hit = fx.customer_points(spark, sf_dir).join(F.broadcast(lobes), F.expr("lon BETWEEN a AND b AND lat BETWEEN c AND d"))
    first = hit.groupBy("k").agg(F.min(F.struct("rank", "lobe"))["lobe"].alias("lobe"))
    return first.groupBy("lobe").agg(F.count(F.lit(1)).alias("n"))


_EDGES = """s AS (SELECT unnest(generate_series(0, 16)) / 16 AS t), ev AS (
    SELECT n AS event_id, minx + t * (maxx - minx) AS lon, miny AS lat FROM b, s UNION ALL SELECT n, minx + t * (maxx - minx), maxy FROM b, s UNION ALL SELECT n, minx, miny + t * (maxy - miny) FROM b, s UNION ALL SELECT n, maxx, miny + t * (maxy - miny) FROM b, s)"""


@query(
    f"""WITH {fx.CUST}, b AS (SELECT n, min(lon) AS minx, min(lat) AS miny, max(lon) AS maxx, max(lat) AS maxy FROM cust GROUP BY 1), {_EDGES},
    la AS (SELECT event_id, lon, {_CLAMP.format(m=P.POLE_LIMIT)} * {_RAD} AS phi, CAST({_LOBE} AS INTEGER) AS lobe FROM ev), lb AS (SELECT *, {_MERIDIAN} AS cm FROM la), {_NEWTON},
    p AS (SELECT event_id, CASE WHEN abs(phi) <= {P._BAND!r} THEN (lon - cm) * {_RAD} * cos(phi) ELSE 2 * sqrt(2) / pi() * (lon - cm) * {_RAD} * cos(t) END * 180 / pi() + cm AS x,
    CASE WHEN abs(phi) <= {P._BAND!r} THEN phi WHEN phi >= 0 THEN sqrt(2) * sin(t) - {P._SHIFT!r} ELSE sqrt(2) * sin(t) + {P._SHIFT!r} END * 180 / pi() AS y FROM t8)
    SELECT event_id AS n, round(min(x), 6) AS minx, round(min(y), 6) AS miny, round(max(x), 6) AS maxx, round(max(y), 6) AS maxy FROM p GROUP BY 1"""
)
def project_envelope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extent of each nation on the homolosine, from 17 points an edge."""
    e = _fitted(spark, sf_dir).select("n", P.project_envelope("Goode", F.col("e")).alias("p"))
    return e.select("n", *[F.round(f"p.{c}", 6).alias(c) for c in ("minx", "miny", "maxx", "maxy")])


_BOX = f"WITH {fx.CUST}, b AS (SELECT n, min(lon) AS minx, min(lat) AS miny, max(lon) AS maxx, max(lat) AS maxy FROM cust GROUP BY 1), s AS (SELECT *, maxx - minx AS w0, maxy - miny AS h0 FROM b), z AS (SELECT *, CASE WHEN w0 > 0 THEN w0 ELSE 1 END AS w, CASE WHEN h0 > 0 THEN h0 ELSE 1 END AS h FROM s)"
_FIT = ", f AS (SELECT *, CASE WHEN w >= h THEN 1024 ELSE greatest(1, CAST(round_even(1024::DOUBLE * w / h, 0) AS INTEGER)) END AS cw, CASE WHEN w >= h THEN greatest(1, CAST(round_even(1024::DOUBLE * h / w, 0) AS INTEGER)) ELSE 1024 END AS ch FROM z), g AS (SELECT *, least(greatest(1, cw - 16) / w, greatest(1, ch - 16) / h) AS scale FROM f)"


def _fitted(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = fx.customer_points(spark, sf_dir)
    b = c.groupBy("n").agg(F.min("lon").alias("minx"), F.min("lat").alias("miny"), F.max("lon").alias("maxx"), F.max("lat").alias("maxy")).select("n", F.struct("minx", "miny", "maxx", "maxy").alias("e"))
    return b.withColumn("f", P.canvas_fit(F.col("e.maxx") - F.col("e.minx"), F.col("e.maxy") - F.col("e.miny"), max_dimension=1024))


@query(f"{_BOX}{_FIT} SELECT n, cw AS width, ch AS height, round(scale, 6) AS scale, round((cw - w * scale) / 2, 6) AS dx, round((ch - h * scale) / 2, 6) AS dy FROM g")
def canvas_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _fitted(spark, sf_dir)
    return f.select("n", F.col("f.w").alias("width"), F.col("f.h").alias("height"), F.round("f.scale", 6).alias("scale"), F.round("f.dx", 6).alias("dx"), F.round("f.dy", 6).alias("dy"))


@query(f"{_BOX}{_FIT} SELECT cust.k, round((cw - w * scale) / 2 + (lon - minx) * scale, 6) AS x, round(ch - (ch - h * scale) / 2 - (lat - miny) * scale, 6) AS y FROM cust JOIN g USING (n)")
def to_pixel(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = fx.customer_points(spark, sf_dir).join(_fitted(spark, sf_dir), "n").withColumn("p", P.to_pixel(F.struct(F.col("lon").alias("x"), F.col("lat").alias("y")), F.col("e"), F.col("f")))
    return p.select("k", F.round("p.x", 6).alias("x"), F.round("p.y", 6).alias("y"))


@query(f"{_BOX}{_FIT}, m AS (SELECT n, least(6.0::DOUBLE, greatest(0.1::DOUBLE, pow(sqrt(2::DOUBLE), log2(least(cw / w0, ch / h0) * 360 / 256) - 10))) AS m FROM g) SELECT n, round(m, 6) AS stroke, round((m + 1) / 2, 6) AS point FROM m")
def stroke_multiplier(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = _fitted(spark, sf_dir).select("n", P.stroke_multiplier(F.col("f.w"), F.col("f.h"), F.col("e")).alias("m"))
    return m.select("n", F.round("m", 6).alias("stroke"), F.round(P.point_multiplier(F.col("m")), 6).alias("point"))


@query(
    f"""{_BOX}, k AS (SELECT n, CASE WHEN w0 >= 180 OR h0 >= 90 THEN 'Goode' WHEN w0 >= 90 OR h0 >= 60 THEN 'PlateCarree' ELSE 'Lambert' END AS kind FROM s)
    SELECT kind, count(*) AS n FROM k GROUP BY 1"""
)
def proj_auto(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fitted(spark, sf_dir).groupBy(P.auto_projection(F.col("e")).alias("kind")).agg(F.count(F.lit(1)).alias("n"))


@query(
    f"""WITH {fx.NAT}, style(r_name, stroke, width) AS (VALUES ('AFRICA', 255, 3.0::DOUBLE), ('ASIA', NULL, 1.0::DOUBLE), ('EUROPE', 128, NULL))
    SELECT n_name, CAST(coalesce(stroke, 30) AS INTEGER) AS stroke, coalesce(width, 2.0::DOUBLE) AS width FROM nat LEFT JOIN style USING (r_name)"""
)
def style_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Layer styles override options one property at a time; a null inherits."""
    from ..render import Style, resolve_styles

    styles = {"AFRICA": Style(stroke=255, stroke_width=3.0), "ASIA": Style(stroke_width=1.0), "EUROPE": Style(stroke=128)}
    r = resolve_styles(fx.nations(spark, sf_dir), "r_name", styles, Style(stroke=30, stroke_width=2.0))
    return r.select("n_name", F.col("stroke"), F.col("stroke_width").alias("width"))
