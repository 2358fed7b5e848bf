"""Queries over TopoJSON and shapefile relations, clipping and rasterisation."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ... import model
from ...functions import geometry as G
from ...functions.udfs import st_asbinary, st_asgeojson, st_astext, st_geomfromgeojson, st_geomfromtext, st_geomfromwkb
from ...functions import text as X
from ...operators import raster as R
from ...operators import shapes, topology
from .. import fixtures as fx
from ..catalogue import query

_ARCS = "a AS (SELECT l_orderkey AS arc, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, CAST(l_quantity AS BIGINT), l_partkey % 41) AS INTEGER) AS i, CAST(l_quantity AS BIGINT) - 25 AS dx, l_partkey % 41 - 20 AS dy FROM lineitem)"


def _arcs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantised arcs: the lines of each order as deltas."""
    li = fx.table(spark, sf_dir, "lineitem")
    i = F.expr("CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, CAST(l_quantity AS BIGINT), l_partkey % 41) AS INT)")
    return li.select(F.col("l_orderkey").alias("arc"), i.alias("i"), (F.col("l_quantity").cast("long") - 25).alias("dx"), (F.col("l_partkey") % 41 - 20).alias("dy"))


@query(f"WITH {_ARCS} SELECT arc, i, sum(dx) OVER w * 0.125 + 10 AS x, sum(dy) OVER w * 0.25 - 5 AS y FROM a WINDOW w AS (PARTITION BY arc ORDER BY i)".replace("* 0.125 + 10", "* 0.125::DOUBLE + 10").replace("* 0.25 - 5", "* 0.25::DOUBLE - 5"))
def topojson_arcs_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same arcs by a window and by a fold within a row; the fold's positions are returned."""
    deltas = F.transform(F.array_sort(F.collect_list(F.struct("i", "dx", "dy"))), lambda p: F.array(p["dx"], p["dy"]))
    rows = _arcs(spark, sf_dir).groupBy("arc").agg(deltas.alias("deltas"), F.array_sort(F.collect_list("i")).alias("order"))
    decoded = rows.select("arc", "order", topology.decode_arc(F.col("deltas"), (0.125, 0.25), (10.0, -5.0)).alias("path"))
    return decoded.select("arc", F.explode(F.arrays_zip("order", "path")).alias("p")).select("arc", F.col("p.order").alias("i"), F.col("p.path.x").alias("x"), F.col("p.path.y").alias("y"))


@query(f"WITH {_ARCS} SELECT arc, i, sum(dx) OVER w * 0.125::DOUBLE + 10 AS x, sum(dy) OVER w * 0.25::DOUBLE - 5 AS y FROM a WINDOW w AS (PARTITION BY arc ORDER BY i)")
def topojson_arcs_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topology.decode_arcs(_arcs(spark, sf_dir), (0.125, 0.25), (10.0, -5.0))


@query(
    """WITH p AS (SELECT arc, list(v ORDER BY i) AS path FROM (SELECT l_orderkey AS arc, l_linenumber AS i, CAST(l_orderkey * 8 + l_linenumber AS DOUBLE) AS v FROM lineitem) GROUP BY 1),
    u AS (SELECT o_custkey AS line, list(CASE WHEN o_orderkey % 2 = 1 THEN list_reverse(path) ELSE path END ORDER BY o_orderkey) AS parts FROM orders JOIN p ON arc = o_orderkey GROUP BY 1)
    SELECT line, array_to_string(list_transform(flatten(list_transform(parts, lambda x, i: CASE WHEN i = 1 THEN x ELSE x[2:] END)), lambda v: CAST(CAST(v AS BIGINT) AS VARCHAR)), ',') AS path FROM u"""
)
def topojson_stitch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer's line is the arcs of its orders, odd ones backwards."""
    li = fx.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("arc"), F.col("l_linenumber").alias("i"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).cast("double").alias("v"))
    arcs = li.groupBy("arc").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda p: p["v"]).alias("path"))
    o = fx.table(spark, sf_dir, "orders").join(arcs, F.col("arc") == F.col("o_orderkey"), "left_semi")
    index = F.when(F.col("o_orderkey") % 2 == 1, -F.col("o_orderkey") - 1).otherwise(F.col("o_orderkey"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", index.alias("index")))), lambda p: p["index"])
    uses = o.groupBy(F.col("o_custkey").alias("line")).agg(ordered.alias("indexes"))
    s = topology.stitch(uses, arcs)
    return s.select("line", F.array_join(F.transform("path", lambda v: v.cast("long").cast("string")), ",").alias("path"))


@query(f"WITH {fx.SQUARES}, r AS (SELECT k, hole, unnest(CASE WHEN hole THEN [0, 1] ELSE [0] END) AS ring FROM sq) SELECT k AS seq, CAST(ring AS INTEGER) AS ring, row_number() OVER (ORDER BY k, ring) - 1 AS arc FROM r")
def topojson_arc_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = fx.part_squares(spark, sf_dir).select(F.array().cast("array<int>").alias("layer_ord"), F.col("k").alias("seq"), "geom")
    return topology.number_arcs(s).select("seq", "ring", "arc")


@query("SELECT * FROM (VALUES (0, 'roads'), (1, 'data_1'), (2, 'layer_2'), (3, 'roads_1'), (4, 'data_2')) AS t(i, name)")
def topojson_object_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ...codecs.topojson import object_names

    return spark.createDataFrame(list(enumerate(object_names(["roads", "data", None, "roads", "data"]))), "i int, name string")


@query(
    f"""WITH {fx.SQUARES}, w AS (SELECT k, CASE WHEN hole THEN (44 + 8 + 160) / 2 ELSE (44 + 4 + 80) / 2 END AS words FROM sq)
    SELECT k AS seq, CAST(words AS BIGINT) AS words, CAST(50 + coalesce(sum(words + 4) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset" FROM w"""
)
def shp_record_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = fx.part_squares(spark, sf_dir).select(F.lit("parts.shp").alias("source_file"), F.array().cast("array<int>").alias("layer_ord"), F.col("k").alias("seq"), "geom")
    return shapes.record_offsets(s).select("seq", "words", "offset")


@query("SELECT * FROM (VALUES ('mixed', -1, false), ('none', 1, true), ('parts', 5, true), ('points', 1, true), ('tracks', 3, true)) AS t(src, shape_type, valid)")
def shp_category_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts, tracks = fx.part_squares(spark, sf_dir).select("geom"), fx.user_tracks(spark, sf_dir).select("geom")
    points = fx.customer_points(spark, sf_dir).select(model.point(model.position(F.col("lon"), F.col("lat"))).alias("geom"))
    sets = {"parts": parts, "tracks": tracks, "points": points, "mixed": parts.unionByName(tracks), "none": parts.where("false")}
    out = None
    for name, df in sets.items():
        one = shapes.category_check(df).withColumn("src", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out.select("src", "shape_type", "valid")


@query(f"WITH {fx.SQUARES} SELECT k, CAST(2 AS INTEGER) AS polygons, CAST(CASE WHEN hole THEN 3 ELSE 2 END AS INTEGER) AS rings FROM sq")
def shp_ring_grouping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rings of a record: the square clockwise, its hole the other way, and a square far off that opens a polygon of its own."""
    s = fx.part_squares(spark, sf_dir)
    far = F.reverse(fx.square(F.col("x") + 200, F.col("y"), F.col("side")))
    rings = F.concat(G.orient_shapefile(F.col("rings")), F.array(far))
    p = s.select("k", shapes.group_rings(rings).alias("p"))
    return p.select("k", F.size("p").alias("polygons"), F.size(F.flatten("p")).alias("rings"))


@query(
    """WITH s AS (SELECT c_nationkey AS file, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS i, c_custkey AS k FROM customer),
    r AS (SELECT file, k, row_number() OVER (PARTITION BY file ORDER BY i) - 1 AS i FROM s WHERE k % 9 <> 0) SELECT s.file, s.k, coalesce(r.k, -1) AS attributes FROM s LEFT JOIN r USING (file, i)"""
)
def shp_dbf_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shapes meet rows by position; rows flagged deleted (every ninth key) are gone first, so later ones move up."""
    c = fx.table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("file"), F.col("c_custkey").alias("k"))
    c = c.withColumn("i", F.expr("row_number() OVER (PARTITION BY file ORDER BY k) - 1"))
    rows = c.select("file", "i", (F.col("k") % 9 == 0).alias("deleted"), F.col("k").alias("props"))
    return shapes.zip_rows(c, rows).select("file", "k", F.coalesce("props", F.lit(-1)).alias("attributes"))


@query(f"WITH {fx.SQUARES} SELECT k, {fx.POLYGON_SQL} AS wkt FROM sq")
def wkt_parse_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = fx.part_squares(spark, sf_dir).select("k", st_astext("geom").alias("text"))
    return t.select("k", st_astext(st_geomfromtext("text")).alias("wkt"))


@query(f"WITH {fx.CUST} SELECT k, upper(hex(st_aswkb(CAST('POINT (' || lon || ' ' || lat || ')' AS GEOMETRY)))) AS wkb FROM cust")
def wkb_point_hex(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = fx.customer_points(spark, sf_dir)
    return c.select("k", F.hex(st_asbinary(model.point(model.position(F.col("lon"), F.col("lat"))))).alias("wkb"))


@query(f"WITH {fx.SQUARES} SELECT k, {fx.POLYGON_SQL} AS wkt FROM sq")
def wkb_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.part_squares(spark, sf_dir).select("k", st_geomfromwkb(st_asbinary("geom")).alias("g")).select("k", X.wkt_format(F.col("g")).alias("wkt"))


@query(f"WITH {fx.CUST} SELECT k, '{{\"type\":\"Point\",\"coordinates\":[' || {fx.num('lon')} || ',' || {fx.num('lat')} || ']}}' AS geojson FROM cust")
def geojson_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = fx.customer_points(spark, sf_dir)
    return c.select("k", st_asgeojson(model.point(model.position(F.col("lon"), F.col("lat")))).alias("geojson"))


@query(f"WITH {fx.CUST} SELECT k, 'POINT Z (' || {fx.num('lon')} || ' ' || {fx.num('lat')} || ' 7)' AS wkt FROM cust")
def geojson_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = fx.customer_points(spark, sf_dir)
    text = F.format_string('{"type":"Point","coordinates":[%s,%s,7,99]}', F.col("lon").cast("string"), F.col("lat").cast("string"))
    return c.select("k", st_geomfromgeojson(text).alias("g")).select("k", X.wkt_format(F.col("g")).alias("wkt"))


@query(f"WITH {fx.SQUARES} SELECT 'Polygon' AS types, min(x) AS minx, min(y) AS miny, max(x + side) AS maxx, max(y + side) AS maxy, count(*) AS n FROM sq")
def geoparquet_types_bbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the footer of a GeoParquet file says: distinct types and the extent, in one aggregation."""
    s = fx.part_squares(spark, sf_dir).select("geom", G.bounds(F.col("geom")).alias("e"))
    return s.agg(F.array_join(F.array_sort(F.collect_set("geom.type")), ",").alias("types"), F.min("e.minx").alias("minx"), F.min("e.miny").alias("miny"), F.max("e.maxx").alias("maxx"), F.max("e.maxy").alias("maxy"), F.count(F.lit(1)).alias("n"))


# rasterisation: squares on a canvas of 640 x 320, two pixels a degree or so

_PIX = "px AS (SELECT k, (x + 180) * 1.75 AS x0, (85 - y) * 1.75 AS y0, side * 64 * 0.75 AS n FROM sq)".replace("1.75", "1.75::DOUBLE").replace("0.75 AS n", "0.75::DOUBLE AS n")
_EDGES = "e AS (SELECT k, x0, y0, x0 + n AS x1, y0 + n / 2 AS y1 FROM px UNION ALL SELECT k, x0 + n, y0 + n / 2, x0 + n / 4, y0 + n FROM px UNION ALL SELECT k, x0 + n / 4, y0 + n, x0, y0 FROM px)"


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A triangle for every part."""
    s = fx.part_squares(spark, sf_dir).select("k", ((F.col("x") + 180) * 1.75).alias("x0"), ((85 - F.col("y")) * 1.75).alias("y0"), (F.col("side") * 64 * 0.75).alias("n"))
    x, y, n = F.col("x0"), F.col("y0"), F.col("n")
    corners = [(x, y), (x + n, y + n / 2), (x + n / 4, y + n)]
    edge = lambda a, b: F.struct(a[0].alias("x0"), a[1].alias("y0"), b[0].alias("x1"), b[1].alias("y1"))
    return s.select(F.col("k").alias("poly"), F.explode(F.array(*[edge(corners[i], corners[(i + 1) % 3]) for i in range(3)])).alias("e")).select("poly", "e.*")


@query(
    f"""WITH {fx.SQUARES}, {_PIX}, {_EDGES}, r AS (SELECT k, x0, y0, x1, y1, unnest(generate_series(CAST(greatest(0, ceil(least(y0, y1) - 0.5)) AS BIGINT), CAST(least(319, ceil(greatest(y0, y1) - 0.5) - 1) AS BIGINT))) AS y FROM e WHERE y0 <> y1),
    c AS (SELECT k, y, x0 + (y + 0.5 - y0) / (y1 - y0) * (x1 - x0) AS x FROM r), o AS (SELECT *, row_number() OVER w AS i, lead(x) OVER w AS x2 FROM c WINDOW w AS (PARTITION BY k, y ORDER BY x))
    SELECT k AS poly, y, CAST(greatest(0, ceil(x - 0.5)) AS BIGINT) AS x0, CAST(least(639, floor(x2 - 0.5)) AS BIGINT) AS x1 FROM o WHERE i % 2 = 1 AND x2 IS NOT NULL AND greatest(0, ceil(x - 0.5)) <= least(639, floor(x2 - 0.5))"""
)
def fill_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.fill_spans(_edges(spark, sf_dir), 640, 320)


@query(
    f"""WITH {fx.SQUARES}, {_PIX}, {_EDGES}, s AS (SELECT k AS id, x0, y0, x1, y1 FROM e), y AS (SELECT *, unnest(generate_series(CAST(greatest(0, floor(least(y0, y1) - 2)) AS BIGINT), CAST(least(319, ceil(greatest(y0, y1) + 2)) AS BIGINT))) AS y FROM s),
    g AS (SELECT *, unnest(generate_series(CAST(greatest(0, floor(least(x0, x1) - 2)) AS BIGINT), CAST(least(639, ceil(greatest(x0, x1) + 2)) AS BIGINT))) AS x FROM y),
    t AS (SELECT *, least(1.0::DOUBLE, greatest(0.0::DOUBLE, ((x - x0) * (x1 - x0) + (y - y0) * (y1 - y0)) / ((x1 - x0) * (x1 - x0) + (y1 - y0) * (y1 - y0)))) AS t FROM g),
    d AS (SELECT id, x, y, sqrt(pow(x - (x0 + t * (x1 - x0)), 2) + pow(y - (y0 + t * (y1 - y0)), 2)) AS d FROM t),
    a AS (SELECT id, x, y, CAST(floor(200 * greatest(0.0::DOUBLE, least(1.0::DOUBLE, 2.0 - d))) AS INTEGER) AS a FROM d)
    SELECT id, x, y, count(*) AS n FROM a WHERE a > 1 GROUP BY ALL"""
)
def pixel_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pixels that strokes three wide touch, per triangle."""
    e = _edges(spark, sf_dir).withColumnRenamed("poly", "id").withColumns({"size": F.lit(3.0), "alpha": F.lit(200)})
    return R.stroke_pixels(e, 640, 320).where("a > 1").groupBy("id", "x", "y").agg(F.count(F.lit(1)).alias("n"))


@query(
    """WITH RECURSIVE p AS (SELECT event_id % 97 AS x, event_id % 89 AS y, event_id AS ord, CAST(event_id * 7 % 256 AS INTEGER) AS c, CAST(CASE WHEN event_id % 13 = 0 THEN 255 ELSE event_id * 11 % 256 END AS INTEGER) AS a FROM events),
    o AS (SELECT *, row_number() OVER (PARTITION BY x, y ORDER BY ord) AS i, count(*) OVER (PARTITION BY x, y) AS n FROM p),
    f(x, y, i, r, al) AS (SELECT x, y, 0::BIGINT, 250, 255 FROM o WHERE i = 1 UNION ALL SELECT f.x, f.y, o.i, CASE WHEN o.a = 255 THEN o.c WHEN o.a = 0 THEN f.r ELSE CAST(floor(o.c * (o.a / 255) + f.r * (1 - o.a / 255)) AS INTEGER) END,
      CASE WHEN o.a = 255 THEN 255 WHEN o.a = 0 THEN f.al ELSE CAST(floor(o.a + f.al * (1 - o.a / 255)) AS INTEGER) END FROM f JOIN o ON o.x = f.x AND o.y = f.y AND o.i = f.i + 1)
    SELECT f.x, f.y, r, al AS a FROM f JOIN (SELECT x, y, max(i) AS n FROM o GROUP BY 1, 2) m ON m.x = f.x AND m.y = f.y AND m.n = f.i"""
)
def blend_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Source over destination, cut to whole numbers at each step, in order."""
    e = fx.table(spark, sf_dir, "events").select((F.col("event_id") % 97).alias("x"), (F.col("event_id") % 89).alias("y"), F.col("event_id").alias("ord"), (F.col("event_id") * 7 % 256).cast("int").alias("c"), F.when(F.col("event_id") % 13 == 0, 255).otherwise(F.col("event_id") * 11 % 256).cast("int").alias("al"))
    paint = e.select("x", "y", "ord", F.struct(F.col("c").alias("r"), F.col("c").alias("g"), F.col("c").alias("b"), F.col("al").alias("a")).alias("color"))
    return R.blend_pixels(paint, (250, 250, 250, 255)).select("x", "y", F.col("color.r").alias("r"), F.col("color.a").alias("a"))


@query(
    """WITH b AS (SELECT o_custkey % 40 AS y, o_orderkey AS i, CAST(o_orderkey * 37 % 256 AS INTEGER) AS v FROM orders), n AS (SELECT *, row_number() OVER (PARTITION BY y ORDER BY i) AS x FROM b), k AS (SELECT * FROM n),
    w AS (SELECT c.y, c.v AS x, coalesce(u.v, 0) AS b, coalesce(l.v, 0) AS a, coalesce(q.v, 0) AS c FROM k c LEFT JOIN k u ON u.y = c.y - 1 AND u.x = c.x LEFT JOIN k l ON l.y = c.y AND l.x = c.x - 4 LEFT JOIN k q ON q.y = c.y - 1 AND q.x = c.x - 4),
    f AS (SELECT y, x, x - a AS f1, x - b AS f2, x - (a + b) // 2 AS f3, x - CASE WHEN abs(b - c) <= abs(a - c) AND abs(b - c) <= abs(a + b - 2 * c) THEN a WHEN abs(a - c) <= abs(a + b - 2 * c) THEN b ELSE c END AS f4 FROM w),
    m AS (SELECT y, (x + 256) % 256 AS g0, (f1 + 256) % 256 AS g1, (f2 + 256) % 256 AS g2, (f3 + 256) % 256 AS g3, (f4 + 256) % 256 AS g4 FROM f),
    s AS (SELECT y, [sum(least(g0, 256 - g0)), sum(least(g1, 256 - g1)), sum(least(g2, 256 - g2)), sum(least(g3, 256 - g3)), sum(least(g4, 256 - g4))] AS s FROM m GROUP BY 1)
    SELECT y, array_to_string(list_transform(s, lambda v: CAST(CAST(v AS BIGINT) AS VARCHAR)), ',') AS scores, CAST(list_position(s, list_min(s)) - 1 AS INTEGER) AS filter FROM s"""
)
def png_filter_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = fx.table(spark, sf_dir, "orders").select((F.col("o_custkey") % 40).alias("y"), F.col("o_orderkey").alias("i"), (F.col("o_orderkey") * 37 % 256).cast("int").alias("v"))
    rows = o.groupBy("y").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda p: p["v"]).alias("bytes"))
    s = R.png_filter_scores(rows)
    return s.select("y", F.array_join(F.transform("scores", lambda v: v.cast("string")), ",").alias("scores"), "filter")


# clipping


@query(
    f"""WITH {fx.SQUARES}, c AS (SELECT k, greatest(x, -20) AS a, least(x + side, 80) AS b, greatest(y, -90) AS c, least(y + side, 0) AS d, side FROM sq) SELECT k, CASE WHEN a < b AND c < d THEN round((b - a) * (d - c), 9) ELSE 0 END AS area FROM c"""
)
def clip_ring_rect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Area of each square inside a lobe's rectangle, after Sutherland-Hodgman with points put in along the sides."""
    from ..render.frame import clip_ring

    def area(r: list) -> float:
        ps, _ = clip_ring(np.array([[p["x"], p["y"]] for p in r]), (-20.0, 80.0, -90.0, 0.0))
        q = np.roll(ps, -1, 0)
        return abs(float((ps[:, 0] * q[:, 1] - q[:, 0] * ps[:, 1]).sum())) / 2 if len(ps) >= 3 else 0.0

    def run(batches):
        import pyarrow as pa

        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("k"), pa.array([area(r) for r in b.column("ring").to_pylist()], pa.float64())], ["k", "area"])

    rings = fx.part_squares(spark, sf_dir).select("k", G.exterior_ring(F.col("geom")).alias("ring"))
    return rings.mapInArrow(run, "k long, area double").select("k", F.round("area", 9).alias("area"))


@query()
def path_split_lobes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stretches of each user's track by lobe, and their positions."""
    from ..render.frame import split_path

    def split(batches):
        import pyarrow as pa

        for b in batches:
            out = [(u, i, lobe, len(p)) for u, path in zip(b.column("user_id").to_pylist(), b.column("path").to_pylist(), strict=True) for i, (lobe, p) in enumerate(split_path(np.array([[q["x"], q["y"]] for q in path])))]
            yield pa.RecordBatch.from_pylist([dict(zip(("user_id", "part", "lobe", "n"), r, strict=True)) for r in out], pa.schema([("user_id", pa.int64()), ("part", pa.int32()), ("lobe", pa.int32()), ("n", pa.int32())]))

    return fx.user_tracks(spark, sf_dir).select("user_id", "path").mapInArrow(split, "user_id long, part int, lobe int, n int")


@query()
def stroke_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Open chains of each square's outline inside each lobe rectangle."""
    from ...functions.projections import LOBES
    from ..render.frame import clip_ring
    from ..render.frame import stroke_chains as chains

    def run(batches):
        import pyarrow as pa

        for b in batches:
            out = []
            for k, ring in zip(b.column("k").to_pylist(), b.column("ring").to_pylist(), strict=True):
                xy = np.array([[p["x"], p["y"]] for p in ring])
                for lobe, (_, rects) in enumerate(LOBES):
                    for r in rects:
                        ps, tags = clip_ring(xy, r)
                        out += [{"k": k, "lobe": lobe, "n": len(c)} for c in (chains(ps, tags) if len(ps) >= 3 else [])]
            yield pa.RecordBatch.from_pylist(out, pa.schema([("k", pa.int64()), ("lobe", pa.int32()), ("n", pa.int32())]))

    return fx.part_squares(spark, sf_dir).select("k", G.exterior_ring(F.col("geom")).alias("ring")).mapInArrow(run, "k long, lobe int, n int")
