"""Queries over the geometry functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ... import model
from ...functions import geometry as G
from ...functions import text as X
from ...operators.spatial import bbox_join
from .. import fixtures as fx
from ..catalogue import query

_AUTO = "CASE WHEN {w} >= 180 OR {h} >= 90 THEN 'Goode' WHEN {w} >= 90 OR {h} >= 60 THEN 'PlateCarree' ELSE 'Lambert' END"
_TRACK = f"WITH {fx.EVENTS}, o AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i, lead(lon) OVER w AS lon2, lead(lat) OVER w AS lat2 FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))"


@query(
    f"""WITH {fx.CUST}, {fx.NAT}, b AS (SELECT n, count(*) AS n_points, min(lon) AS minx, min(lat) AS miny, max(lon) AS maxx, max(lat) AS maxy FROM cust GROUP BY 1)
    SELECT r_name, n_name, n_points, minx, miny, maxx, maxy, {_AUTO.format(w="(maxx - minx)", h="(maxy - miny)")} AS projection FROM b JOIN nat USING (n)"""
)
def nation_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extent, count and automatic projection of each nation's customers: one aggregation, then the small dimension."""
    from ...functions.projections import auto_projection

    c = fx.customer_points(spark, sf_dir)
    box = c.groupBy("n").agg(F.count(F.lit(1)).alias("n_points"), F.min("lon").alias("minx"), F.min("lat").alias("miny"), F.max("lon").alias("maxx"), F.max("lat").alias("maxy"))
    named = box.join(fx.nations(spark, sf_dir), "n")
    return named.select("r_name", "n_name", "n_points", "minx", "miny", "maxx", "maxy", auto_projection(F.struct("minx", "miny", "maxx", "maxy")).alias("projection"))


@query(f"WITH {fx.CUST} SELECT k, 'POINT (' || {fx.num('lon')} || ' ' || {fx.num('lat')} || ')' AS wkt FROM cust")
def point_wkt(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = fx.customer_points(spark, sf_dir)
    return c.select("k", X.wkt_format(model.point(model.position(F.col("lon"), F.col("lat")))).alias("wkt"))


@query(f"WITH {fx.EVENTS} SELECT user_id, 'LINESTRING (' || string_agg({fx.num('lon')} || ' ' || {fx.num('lat')}, ', ' ORDER BY ts, event_id) || ')' AS wkt FROM ev GROUP BY 1")
def line_wkt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.user_tracks(spark, sf_dir).select("user_id", X.wkt_format(F.col("geom")).alias("wkt"))


@query(f"WITH {fx.SQUARES} SELECT k, {fx.POLYGON_SQL} AS wkt FROM sq")
def polygon_wkt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.part_squares(spark, sf_dir).select("k", X.wkt_format(F.col("geom")).alias("wkt"))


@query(f"WITH {fx.CUST} SELECT n, 'MULTIPOINT (' || string_agg('(' || {fx.num('lon')} || ' ' || {fx.num('lat')} || ')', ', ' ORDER BY k) || ')' AS wkt FROM cust GROUP BY 1")
def multipoint_wkt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.nation_multipoints(spark, sf_dir).select("n", X.wkt_format(F.col("geom")).alias("wkt"))


@query(
    f"WITH {fx.EVENTS} SELECT event_id, 'POINT' || CASE WHEN z IS NULL THEN '' ELSE ' Z' END || ' (' || {fx.num('lon')} || ' ' || {fx.num('lat')} || CASE WHEN z IS NULL THEN '' ELSE ' 7.5' END || ')' AS wkt, z IS NOT NULL AS has_z, false AS has_m, false AS is_empty, 'Point' AS kind, CAST(0 AS INTEGER) AS code FROM ev"
)
def geom_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = fx.event_points(spark, sf_dir).withColumn("g", model.point(model.position(F.col("lon"), F.col("lat"), F.when(F.col("z").isNotNull(), 7.5))))
    g = F.col("g")
    return e.select("event_id", X.wkt_format(g).alias("wkt"), G.has_z(g).alias("has_z"), G.has_m(g).alias("has_m"), G.is_empty(g).alias("is_empty"), G.geometry_type(g).alias("kind"), G.type_code(g).alias("code"))


@query(f"WITH {fx.SQUARES} SELECT k, round(CASE WHEN odd THEN -side * side ELSE side * side END, 9) AS area, odd AS clockwise, CAST(CASE WHEN hole THEN 2 ELSE 1 END AS INTEGER) AS rings, CAST(CASE WHEN hole THEN 10 ELSE 5 END AS INTEGER) AS vertices FROM sq")
def ring_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, ring = fx.part_squares(spark, sf_dir), G.exterior_ring(F.col("geom"))
    return s.select("k", F.round(G.signed_area(ring), 9).alias("area"), G.is_clockwise(ring).alias("clockwise"), (1 + F.size(G.interior_rings(F.col("geom")))).alias("rings"), G.vertex_count(F.col("geom")).alias("vertices"))


def _oriented_sql(exterior_reversed: str) -> str:
    hole_reversed = "true" if exterior_reversed == "false" else "false"
    return f"WITH {fx.SQUARES} SELECT k, 'POLYGON ((' || {fx.ring_sql('x', 'y', 'side', exterior_reversed)} || CASE WHEN hole THEN '), (' || {fx.ring_sql('x + side / 4', 'y + side / 4', 'side / 2', hole_reversed)} ELSE '' END || '))' AS wkt FROM sq"


@query(_oriented_sql("false"))
def ring_orient_rfc7946(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.part_squares(spark, sf_dir).select("k", X.wkt_format(G.orient_geometry(F.col("geom"), False)).alias("wkt"))


@query(_oriented_sql("true"))
def ring_orient_shapefile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.part_squares(spark, sf_dir).select("k", X.wkt_format(G.orient_geometry(F.col("geom"), True)).alias("wkt"))


@query(
    f"{_TRACK}, s AS (SELECT *, CASE WHEN lon2 IS NULL THEN 0.0 ELSE sqrt((lon2 - lon) * (lon2 - lon) + (lat2 - lat) * (lat2 - lat)) END AS n FROM o) SELECT user_id, count(*) AS n_points, round(sum(n), 6) AS length FROM s GROUP BY 1"
)
def line_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.user_tracks(spark, sf_dir).select("user_id", F.size("path").cast("long").alias("n_points"), F.round(G.path_length(F.col("path")), 6).alias("length"))


@query(
    f"""{_TRACK}, s AS (SELECT *, sqrt((lon2 - lon) * (lon2 - lon) + (lat2 - lat) * (lat2 - lat)) AS n FROM o WHERE lon2 IS NOT NULL),
    c AS (SELECT *, sum(n) OVER (PARTITION BY user_id ORDER BY i) AS gone, sum(n) OVER (PARTITION BY user_id) AS total FROM s),
    h AS (SELECT user_id, arg_min(lon, i) AS lon, arg_min(lat, i) AS lat, arg_min(lon2, i) AS lon2, arg_min(lat2, i) AS lat2, arg_min(n, i) AS n, arg_min(gone, i) AS gone, any_value(total) AS total FROM c WHERE gone >= total / 2 GROUP BY 1),
    m AS (SELECT user_id, least(1.0, greatest(0.0, (total / 2 - (gone - n)) / n)) AS t, * EXCLUDE (user_id) FROM h),
    one AS (SELECT user_id, min(lon) AS lon, min(lat) AS lat FROM ev GROUP BY 1 HAVING count(*) = 1)
    SELECT user_id, round(lon + t * (lon2 - lon), 6) AS x, round(lat + t * (lat2 - lat), 6) AS y FROM m UNION ALL SELECT user_id, lon, lat FROM one"""
)
def line_midpoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = fx.user_tracks(spark, sf_dir).select("user_id", G.line_midpoint(F.col("path")).alias("m"))
    return m.select("user_id", F.round("m.x", 6).alias("x"), F.round("m.y", 6).alias("y"))


@query(f"WITH {fx.SQUARES} SELECT k, round(x + side / 2, 6) AS x, round(y + side / 2, 6) AS y FROM sq")
def polygon_centroid(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = fx.part_squares(spark, sf_dir).select("k", G.ring_centroid(G.exterior_ring(F.col("geom"))).alias("c"))
    return c.select("k", F.round("c.x", 6).alias("x"), F.round("c.y", 6).alias("y"))


@query(
    f"""WITH {fx.SQUARES}, {fx.CUST} SELECT 'part' AS src, k, round(x + side / 2, 6) AS x, round(y + side / 2, 6) AS y, round(side * side, 6) AS priority FROM sq
    UNION ALL SELECT 'nation', n, arg_min(lon, k), arg_min(lat, k), 0.0 FROM cust GROUP BY 2"""
)
def label_anchor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anchor and priority by type: centroid and area of polygons, first position and 0 of multipoints."""
    both = fx.part_squares(spark, sf_dir).select(F.lit("part").alias("src"), "k", "geom").unionByName(fx.nation_multipoints(spark, sf_dir).select(F.lit("nation").alias("src"), F.col("n").alias("k"), "geom"))
    a = both.select("src", "k", G.label_anchor(F.col("geom")).alias("a"), G.label_priority(F.col("geom")).alias("p"))
    return a.select("src", "k", F.round("a.x", 6).alias("x"), F.round("a.y", 6).alias("y"), F.round("p", 6).alias("priority"))


@query(f"WITH {fx.SQUARES} SELECT k, x AS minx, y AS miny, x + side AS maxx, y + side AS maxy, side AS width, side AS height, true AS outer_holds, false AS inner_holds FROM sq")
def bbox_contains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Envelope of each square, by the exact fold; it holds the box of half its side, not the other way round."""
    s = fx.part_squares(spark, sf_dir).withColumn("e", G.bounds_any(F.col("geom")))
    q = F.col("side") / 4
    inner = F.struct((F.col("x") + q).alias("minx"), (F.col("y") + q).alias("miny"), (F.col("x") + 3 * q).alias("maxx"), (F.col("y") + 3 * q).alias("maxy"))
    e = F.col("e")
    return s.select("k", "e.*", G.envelope_width(e).alias("width"), G.envelope_height(e).alias("height"), G.bbox_contains(e, inner).alias("outer_holds"), G.bbox_contains(inner, e).alias("inner_holds"))


@query(f"WITH {fx.SQUARES}, {fx.CUST} SELECT sq.k AS part, cust.k AS customer FROM sq JOIN cust ON x + side > lon AND x < lon AND y + side > lat AND y < lat")
def bbox_intersects_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = fx.part_squares(spark, sf_dir).select(F.col("k").alias("part"), G.bounds(F.col("geom")).alias("a"))
    c = fx.customer_points(spark, sf_dir).select(F.col("k").alias("customer"), F.struct(F.col("lon").alias("minx"), F.col("lat").alias("miny"), F.col("lon").alias("maxx"), F.col("lat").alias("maxy")).alias("b"))
    return bbox_join(s, c, "a", "b").select("part", "customer")


@query(f"WITH {fx.CUST} SELECT n, min(lon) AS minx, min(lat) AS miny, max(lon) AS maxx, max(lat) AS maxy, count(*) AS vertices FROM cust GROUP BY 1")
def bounds_over_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bounds and vertex counts of features, folded over a layer: envelopes per row, then partial aggregation."""
    m = fx.nation_multipoints(spark, sf_dir).select("n", G.bounds(F.col("geom")).alias("e"), G.vertex_count(F.col("geom")).alias("v"))
    return m.groupBy("n").agg(F.min("e.minx").alias("minx"), F.min("e.miny").alias("miny"), F.max("e.maxx").alias("maxx"), F.max("e.maxy").alias("maxy"), F.sum("v").alias("vertices"))
