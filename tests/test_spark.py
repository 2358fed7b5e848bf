import os
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from geolith import cli, convert, formats, model, progress
from geolith.codecs import base, wkt
from geolith.codecs.base import Feature, Layer, line, point, polygon
from geolith.errors import GeoError
from geolith.functions import geometry as G
from geolith.functions import projections as P
from geolith.functions import text as X
from geolith.operators import layers as L
from geolith.operators import raster as R
from geolith.operators import schema as S
from geolith.operators import shapes
from geolith.operators.spatial import bbox_filter, bbox_join
from geolith.plans.render import Options, Style, parse_color, render_png
from geolith.plans.render import font, png
from geolith.plans.render.frame import clip_ring, find_lobe, frame, ocean, split_path, stroke_chains
from geolith.plans.render.labels import Labeller, candidates
from geolith.plans.render.raster import Canvas
from geolith.sources import datasource
from geolith.sources.files import encode, read_files, read_layers, write_files
from geolith.sources.geoparquet import footer, read_geoparquet, write_geoparquet

from .samples import kinds, p, parts, regions, square, trade

VALID = ["POINT (1 2)", "POINT Z (1 2 3)", "POINT M (1 2 4)", "LINESTRING (0 0, 1 1, 1 4)", "POLYGON ((0 0, 4 0, 4 4, 0 4, 0 0), (1 1, 2 1, 2 2, 1 2, 1 1))", "MULTIPOINT ((0 0), (1 1))", "MULTILINESTRING ((0 0, 1 1), (2 2, 3 9))", "MULTIPOLYGON (((0 0, 1 0, 1 1, 0 0)), ((5 5, 9 5, 9 9, 5 5)))", "GEOMETRYCOLLECTION (POINT (1 2), LINESTRING (0 0, 5 5))", "POINT EMPTY", "POLYGON EMPTY", "GEOMETRYCOLLECTION EMPTY"]


@pytest.fixture(scope="module")
def geoms(spark):
    rows = [(i, base.geom_row(wkt.parse(t))) for i, t in enumerate(VALID)]
    return spark.createDataFrame(rows, f"i int, g {model.GEOMETRY}").cache()


def column(df, c):
    return [r[0] for r in df.select(c.alias("v"), "i").orderBy("i").select("v").collect()]


def test_native_wkt_is_the_codec_wkt(geoms):
    assert column(geoms, X.wkt_format(F.col("g"))) == VALID


def test_flags_match_the_plain_model(geoms):
    plain = [wkt.parse(t) for t in VALID]
    assert column(geoms, G.is_empty(F.col("g"))) == [g.empty for g in plain]
    assert column(geoms, G.has_z(F.col("g"))) == [g.has_z for g in plain]
    assert column(geoms, G.has_m(F.col("g"))) == [g.has_m for g in plain]
    for f in (G.bounds, G.bounds_any):
        assert [None if b is None else tuple(b) for b in column(geoms, f(F.col("g")))] == [g.bounds() for g in plain]
    assert column(geoms, G.vertex_count(F.col("g"))) == [len(list(g.positions())) for g in plain]
    assert column(geoms, G.shape_category(F.col("g"))) == [1, 1, 1, 3, 5, 8, 3, 5, 0, 1, 5, 0]


def test_anchors(geoms):
    anchors = [None if a is None else (round(a.x, 6), round(a.y, 6)) for a in column(geoms, G.label_anchor(F.col("g")))]
    assert anchors[0] == (1, 2) and anchors[4] == (2, 2) and anchors[5] == (0, 0) and anchors[8] == (1, 2) and anchors[9] is None and anchors[11] is None
    assert anchors[7] == (round(23 / 3, 6), round(19 / 3, 6))
    half = (2**0.5 + 3) / 2
    assert anchors[3] == (1.0, round(1 + half - 2**0.5, 6))
    assert column(geoms, G.label_priority(F.col("g")))[4:8] == [16.0, 0.0, pytest.approx(2**0.5 + 50**0.5), 8.5]


def test_partial_nan_empties_an_envelope(spark):
    nan = float("nan")
    ps = [[(nan, 1.0), (2.0, 3.0)], [(2.0, 3.0), (nan, 5.0)], [(2.0, 3.0), (nan, 5.0), (7.0, 8.0)]]
    rows = [(i, [{"x": x, "y": y, "z": None, "m": None} for x, y in q]) for i, q in enumerate(ps)]
    df = spark.createDataFrame(rows, f"i int, p array<{model.POSITION}>").select("i", model.line(F.col("p")).alias("g"))
    assert [None if b is None else tuple(b) for b in column(df, G.bounds_any(F.col("g")))] == [(2, 3, 2, 3), None, (7, 8, 7, 8)]


@pytest.mark.parametrize("v", [1.0, 0.1, 1e14, 1e15, 1e-5, 1e-4, 1e21, -0.0, 1e7, 12345678.9, 1.5e300, -3.25, 123456789012.5])
def test_native_numbers(spark, v):
    assert spark.range(1).select(X.fmt_double(F.lit(v))).first()[0] == base.fmt(v)


def test_native_scalars(spark):
    texts = ["42", "+5", " 12 ", "1e3", "1d", "TRUE", "", "x", "NaN", "-Infinity", "9223372036854775808", None]
    got = [r[0] for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(X.scalar_infer(F.col("t"))).collect()]
    assert [None if r is None else r.asDict() for r in got] == [None if t is None else base.tag(base.infer(t)) for t in texts]


def test_orientation(spark):
    g = spark.createDataFrame([(0, base.geom_row(polygon([square(0, 0, 4)[::-1], square(1, 1, 1)])))], f"i int, g {model.GEOMETRY}")
    out = g.select(X.wkt_format(G.orient_geometry(F.col("g"), False)), X.wkt_format(G.orient_geometry(F.col("g"), True))).first()
    assert out[0].startswith("POLYGON ((0 0, 4 0") and out[1].startswith("POLYGON ((0 0, 0 4")


# projections, in columns and in numpy


@pytest.mark.parametrize("kind", ["PlateCarree", "WebMercator", "Lambert", "Goode"])
def test_columns_and_numpy_agree(spark, kind):
    extent = (-10.0, 35.0, 30.0, 60.0)
    f = frame(Options(projection=kind, max_dimension=500), extent)
    pts = [(x * 7.3 - 178, y * 6.1 - 88) for x in range(48) for y in range(28)]
    df = spark.createDataFrame([(i, *q) for i, q in enumerate(pts)], "i int, lon double, lat double")
    got = np.array([tuple(r) for r in column(df, P.project(kind, F.col("lon"), F.col("lat"), extent))])
    x, y = f.project(*np.array(pts).T)
    assert np.allclose(got, np.stack([x, y], 1), rtol=1e-9, atol=1e-9)


def test_auto_and_fit():
    assert [frame(Options(), (0, 0, w, h)).kind for w, h in ((200, 10), (10, 95), (100, 10), (10, 65), (20, 20))] == ["Goode", "Goode", "PlateCarree", "PlateCarree", "Lambert"]
    assert frame(Options(projection="Lambert"), (0, -5, 10, 5)).kind == "PlateCarree"  # the cone is a cylinder
    f = frame(Options(projection="PlateCarree", max_dimension=100), (0, 0, 40, 25))
    assert (f.width, f.height) == (100, 62)  # 62.5 goes to even
    assert tuple(f.pixels(np.array([[0.0, 25.0]]))[0]) == pytest.approx((f.dx, f.dy))
    with pytest.raises(GeoError):
        frame(Options(), None)
    with pytest.raises(GeoError):
        frame(Options(width=0), (0, 0, 1, 1))


def test_lobes():
    assert find_lobe(np.array([-40.0, -30.0, -30.0, -150.0, 0.0, 200.0]), np.array([30.0, 30.0, 70.0, -10.0, -10.0, 10.0])).tolist() == [0, 1, 0, 2, 4, 1]
    paths = split_path(np.array([[-50.0, 10.0], [-30.0, 20.0], [-30.0, -10.0]]))
    assert [lobe for lobe, _ in paths] == [0, 1, 3] and paths[0][1][-1].tolist() == [-40.0, 15.0] and paths[1][1][-1][1] == 0
    ring, tags = clip_ring(np.array([[-10, -10], [10, -10], [10, 10], [-10, 10]], float), (-20, 80, -90, 0))
    assert ring[:, 1].max() == 0 and (tags == 8).sum() == 17
    chains = stroke_chains(ring, tags)
    assert all((c[:, 1] < 0).any() for c in chains) and len(clip_ring(np.array([[1, 1], [2, 1], [2, 2]], float), (-20, 80, -90, 0))[0]) == 0


# pixels


def test_fill_is_even_odd():
    c = Canvas(20, 20, (0, 0, 0, 255))
    c.fill([np.array([[2, 2], [12, 2], [12, 12], [2, 12]], float), np.array([[5, 5], [9, 5], [9, 9], [5, 9]], float)], (255, 255, 255, 255))
    ink = c.pixels[..., 0] > 0
    assert ink.sum() == 100 - 16 and not ink[6, 6] and ink[2, 2] and not ink[12, 12]


def test_bands_paint_as_one_canvas():
    whole = Canvas(60, 60, (250, 250, 250, 255))
    parts = [Canvas(60, 20, (250, 250, 250, 255), top) for top in (0, 20, 40)]
    for c in (whole, *parts):
        c.fill([np.array([[3, 4], [55, 10], [30, 58]], float)], (10, 200, 30, 90))
        c.stroke(1, 1, 58, 57, 3.3, (200, 0, 0, 180))
        c.stroke(1, 30, 58, 30, 0.4, (0, 0, 200, 255))
        c.disc(30, 20, 6.5, (0, 0, 0, 130))
    assert (np.concatenate([c.pixels for c in parts]) == whole.pixels).all()


def test_relational_raster_agrees_with_numpy(spark):
    tri = [(2.3, 1.7), (27.9, 9.2), (11.4, 28.8)]
    edges = [(1, *tri[i], *tri[(i + 1) % 3]) for i in range(3)]
    spans = R.fill_spans(spark.createDataFrame(edges, "poly int, x0 double, y0 double, x1 double, y1 double"), 30, 30).collect()
    c = Canvas(30, 30, (0, 0, 0, 255))
    c.fill([np.array(tri)], (255, 255, 255, 255))
    mask = np.zeros((30, 30), bool)
    for s in spans:
        mask[s.y, s.x0 : s.x1 + 1] = True
    assert (mask == (c.pixels[..., 0] > 0)).all()
    seg = spark.createDataFrame([(1, 3.2, 4.1, 22.7, 19.3, 2.5, 200)], "id int, x0 double, y0 double, x1 double, y1 double, size double, alpha int")
    alpha = np.zeros((30, 30), int)
    for r in R.stroke_pixels(seg, 30, 30).collect():
        alpha[r.y, r.x] = r.a
    c = Canvas(30, 30, (0, 0, 0, 0))
    c.stroke(3.2, 4.1, 22.7, 19.3, 2.5, (255, 255, 255, 200))
    assert (alpha == c.pixels[..., 3]).all()


def test_blend_order_counts(spark):
    layers = [(10, 20, 30, 77), (200, 100, 50, 128), (0, 255, 0, 255), (9, 9, 9, 0), (90, 80, 70, 201)]
    for order in (layers, layers[::-1]):
        c = Canvas(1, 1, (250, 250, 250, 255))
        for col in order:
            c.blend((slice(0, 1), slice(0, 1)), col, np.array([[col[3]]]))
        paint = spark.createDataFrame([(0, 0, i, dict(zip("rgba", col, strict=True))) for i, col in enumerate(order)], "x int, y int, ord int, color struct<r:int,g:int,b:int,a:int>")
        assert tuple(R.blend_pixels(paint, (250, 250, 250, 255)).first()["color"]) == tuple(c.pixels[0, 0])


def test_png():
    r = np.random.default_rng(0)
    image = r.integers(0, 256, (13, 9, 4), dtype=np.uint8)
    image[4:8] = image[4]
    assert (png.decode(png.encode(image)) == image).all()
    assert png.score(np.array([0, 1, 255, 128], np.uint8)) == 130


def test_font_and_labels():
    for c in map(chr, range(32, 127)):
        assert font.strokes(c)[0] > 0
    assert font.measure("é", 14) == font.measure("e", 14) and font.measure("AB", 28) == 2 * font.measure("AB", 14)
    assert font.strokes("́")[1] == [] and font.strokes("漢") == font.strokes("?")
    c = Canvas(200, 100, (255, 255, 255, 255))
    place = Labeller(c)
    style = Options().base
    assert place.place("one", 60, 50, 6, style) and place.place("two", 60, 50, 6, style)  # the second goes elsewhere on the ring
    assert not place.place("far", -50, 50, 0, style) and not place.place("", 60, 50, 0, style)
    assert len(candidates(0, 0, 10, 10, 5)) == 8 and candidates(0, 0, 10, 10, 0) == [(-5, 5)]


def features(spark, layer, n=None):
    df = spark.createDataFrame(base.feature_rows(layer, "mem"), model.FEATURE)
    return df if n is None else df.repartition(n)


def test_render_does_not_depend_on_partitions(spark):
    layer = Layer(children=[Layer("a", features=parts().features), Layer("b", features=[Feature(line([p(0, 0), p(20, 20)]), {"name": "x"}), Feature(point(p(5, 15)), {"name": "dot"})])])
    for kind in ("PlateCarree", "Goode", "Lambert", "WebMercator"):
        o = Options(max_dimension=150, projection=kind, ocean=(200, 220, 255, 255), bounds=(-5, -5, 25, 25), layers={"b": Style(stroke=(200, 0, 0, 255), label="name")})
        images = {zlib.crc32(png.decode(render_png(features(spark, layer, n), o)).tobytes()) for n in (1, 4, 9)}
        assert len(images) == 1
    image = png.decode(render_png(features(spark, layer), Options(max_dimension=150, projection="PlateCarree", bounds=(-5, -5, 25, 25))))
    assert image.shape == (150, 150, 4) and len(np.unique(image.reshape(-1, 4), axis=0)) > 3


def test_ocean_paths():
    f = frame(Options(max_dimension=200), (-180, -85, 180, 85))
    rings, paths = ocean(f)
    assert len(rings) == len(paths) == 6 and all(np.isfinite(r).all() for r in rings)


# sources, sinks and the rest


@pytest.mark.parametrize("fmt, ext", [("geojson", "geojson"), ("kml", "kml"), ("flatgeobuf", "fgb"), ("geoparquet", "parquet"), ("topojson", "topojson"), ("csv", "csv"), ("wkt", "wkt"), ("wkb", "wkb"), ("kmz", "kmz"), ("gpx", "gpx")])
def test_files_by_spark(spark, tmp_path, fmt, ext):
    path = str(tmp_path / f"x.{ext}")
    write_files(features(spark, trade(), 3), path)
    assert open(path, "rb").read() == encode(fmt, trade()) or fmt in ("kmz", "geoparquet")
    back = read_files(spark, path).orderBy("seq").collect()
    assert len(back) == 3 and all(r.geom.type in ("Point", "LineString", "Polygon", "MultiLineString") for r in back)


def test_line_formats(spark, tmp_path):
    from geolith.sources.text import read_csv, read_wkt, write_wkt

    out = str(tmp_path / "wkt")
    df = spark.createDataFrame([(base.geom_row(g),) for g in kinds()] + [(None,)], f"geom {model.GEOMETRY}")
    write_wkt(df, out)
    assert sorted(r.line for r in read_wkt(spark, out).collect()) == sorted(wkt.dump(g) for g in kinds())
    (tmp_path / "a.csv").write_text('name,WKT,n\n"x, ""y""",POINT (1 2),5\nz,,\n')
    (tmp_path / "b.csv").write_text("lon,lat,ok\n1,2,true\nbad,2,\n")
    a, b = (read_csv(spark, str(tmp_path / n)).collect() for n in ("a.csv", "b.csv"))
    plain = lambda rows: [(None if r.geom is None else wkt.dump(base.geom_of(r.geom.asDict(True))), {p_.key: base.untag(p_.value.asDict()) for p_ in r.props}) for r in rows]
    assert plain(a) == [("POINT (1 2)", {"name": 'x, "y"', "n": 5}), (None, {"name": "z"})]
    assert plain(b) == [("POINT (1 2)", {"ok": True}), (None, {})]


def test_shapefile_folders(spark, tmp_path):
    bundle = Layer(children=[Layer("Brand#6", features=parts().features[:1]), Layer("Brand#9", features=parts().features[1:])])
    folder = str(tmp_path / "bundle")
    write_files(features(spark, bundle), folder, "shapefile")
    assert sorted(n for n in os.listdir(folder) if n.endswith(".shp")) == ["Brand#6.shp", "Brand#9.shp"]
    got = read_files(spark, folder, "shapefile").orderBy("layer_ord", "seq").collect()
    assert [(r.layer_path, r.layer_ord) for r in got] == [(["Brand#6"], [0]), (["Brand#9"], [1])]
    one = read_files(spark, f"{folder}/Brand#9.shp").first()
    assert one.geom.type == "MultiPolygon" and one.layer_path == []


def test_layers_and_conversion(spark, tmp_path):
    a, b, c = (str(tmp_path / n) for n in ("a.kml", "b.kmz", "c.png"))
    open(a, "wb").write(encode("kml", regions()))
    convert.convert(spark, a, b)
    assert [r.name for r in read_layers(spark, b).orderBy("layer_ord").collect()] == ["ASIA", "CHINA", "INDIA", "suppliers"]
    assert [r.props[0]["value"]["s"] for r in L.flattened(read_files(spark, b)).collect()] == [f.props["name"] for f in regions().walk()]
    convert.convert(spark, b, c, options=Options(max_dimension=64))
    assert png.decode(open(c, "rb").read()).shape[1] <= 64


def test_modes(spark, tmp_path):
    (tmp_path / "ok.geojson").write_bytes(encode("geojson", trade()))
    (tmp_path / "bad.geojson").write_bytes(b"{")
    folder = str(tmp_path / "*.geojson")
    assert read_files(spark, folder, "geojson", mode="DROPMALFORMED").count() == 3
    kept = read_files(spark, folder, "geojson", mode="PERMISSIVE").collect()
    assert len(kept) == 4 and sum(r["_corrupt"] is not None for r in kept) == 1
    with pytest.raises(Exception, match="invalid geojson"):
        read_files(spark, folder, "geojson").collect()
    with pytest.raises(GeoError):
        read_files(spark, "x.png")
    with pytest.raises(GeoError):
        read_files(spark, "x.txt")


def test_data_sources(spark, tmp_path):
    datasource.register(spark)
    out = str(tmp_path / "out")
    features(spark, trade(), 1).write.format("geo_geojson").mode("append").save(out)
    back = spark.read.format("geo_geojson").load(out)
    assert back.where("geom.type = 'Point'").count() == 1 and back.count() == 3
    features(spark, parts(), 1).write.format("geo_shapefile").mode("append").save(out + "s")
    assert spark.read.format("geo_shapefile").load(out + "s").count() == 2


def test_geoparquet_tables(spark, tmp_path):
    path = str(tmp_path / "gp")
    df = spark.createDataFrame([(i, base.geom_row(g)) for i, g in enumerate(kinds())], f"k int, geom {model.GEOMETRY}")
    write_geoparquet(df, path)
    assert footer(spark, path)["version"] == "1.1.0"
    back = read_geoparquet(spark, path)
    assert {r.k: r.t for r in back.select("k", X.wkt_format(F.col("geom")).alias("t")).collect()} == {i: wkt.dump(g) for i, g in enumerate(kinds())}
    plan = bbox_filter(back, 4, 4, 9, 9)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "GreaterThan(maxx" in plan


def test_bbox_join_matches_brute_force(spark):
    r = np.random.default_rng(4)
    box = lambda n, s: [(i, (float(x), float(y), float(x + w), float(y + h))) for i, (x, y, w, h) in enumerate(zip(*r.uniform(-5, 5, (2, n)), *r.uniform(0, s, (2, n)), strict=True))]
    a, b = box(80, 3), box(60, 1) + [(99, (1.0, 1.0, 1.0, 1.0))]
    schema = f"k int, e {model.ENVELOPE}"
    got = bbox_join(spark.createDataFrame(a, schema).toDF("a", "ea"), spark.createDataFrame(b, schema).toDF("b", "eb"), "ea", "eb").select("a", "b").collect()
    want = {(i, j) for i, p_ in a for j, q in b if p_[2] > q[0] and p_[0] < q[2] and p_[3] > q[1] and p_[1] < q[3]}
    assert len(got) == len(want) and {tuple(x) for x in got} == want


def test_schema_inference_matches_the_codecs(spark):
    layer = Layer(features=[Feature(None, {"z": None, "a": 1, "m": True}), Feature(None, {"b": 2.5, "a": 3.75, "z": 4, "m": 5}), Feature(None, {"c": "x", "f": False})])
    df = features(spark, layer, 3)
    assert [r.key for r in S.key_union(df).orderBy("ord").collect()] == base.keys_of(layer)
    assert {r.key: r.kind for r in S.widened(df).collect()} == base.widened(layer)
    from geolith.codecs import dbf

    plan = dbf.plan(base.keys_of(layer), layer)
    got = S.dbf_fields(df).orderBy("ord").collect()
    assert [(r.kind, r.length, r.decimals) for r in got] == [(f.kind, f.length, f.decimals) for f in plan]


def test_shape_rows(spark):
    from geolith.codecs import shapefile

    layer = Layer(features=[Feature(g) for g in kinds() if g.kind.endswith("Polygon")] + [Feature(None)])
    df = features(spark, layer)
    sizes = [len(c) for c in shapefile.records(shapefile.write(layer)["shp"])]
    assert [r.words * 2 for r in shapes.record_offsets(df).orderBy("seq").collect()] == sizes
    assert shapes.category_check(features(spark, trade())).first().valid is False


def test_progress(spark):
    assert [progress.Progress("reading", *v).fraction for v in ((5, 10), (20, 10), (5, None, 1, 4), (0,))] == [0.5, 1.0, 0.25, None]
    df, watch = progress.observed(features(spark, trade()), "writing")
    df.count()
    assert watch.get["features"] == 3


def test_nested_layers(spark):
    df = features(spark, Layer(features=trade().features)).withColumn("name", F.col("props")[0]["value"]["s"])
    got = L.nested(df, "name", "seq").orderBy("layer_ord").collect()
    assert [(r.layer_path, r.layer_ord) for r in got] == [([f.props["name"]], [i]) for i, f in enumerate(trade().features)]


def test_streamed_folder(spark, tmp_path):
    from geolith import streaming

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.geojson").write_bytes(encode("geojson", trade()))
    q = streaming.watch(spark, str(tmp_path / "in"), "geojson").writeStream.format("memory").queryName("watched").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("watched").count() == 3


# command line


def test_cli(spark, tmp_path, capsys):
    a, b = str(tmp_path / "a.geojson"), str(tmp_path / "b.wkt")
    open(a, "wb").write(encode("geojson", trade()))
    assert cli.run([a, b], spark) == 0 and open(b).read().startswith(wkt.dump(trade().features[0].geom))
    assert cli.run([a, str(tmp_path / "c.png"), "--size", "50x40", "--label", "name", "--label-halo", "none", "--bbox", "-1,-1,5,5", "--projection", "mercator"], spark) == 0
    assert cli.run(["--list"], spark) == 0 and "flatgeobuf" in (out := capsys.readouterr().out), out
    assert cli.run([str(tmp_path / "none.geojson"), b], spark) == 1
    bad = str(tmp_path / "bad.geojson")
    open(bad, "w").write("{")
    assert cli.run([bad, b], spark) == 1


@pytest.mark.parametrize("args", [[], ["a.geojson"], ["a.xyz", "b.kml"], ["a.kml", "b.png", "--size", "0"], ["a.kml", "b.png", "--size", "1x2x3"], ["a.kml", "b.png", "--bbox", "1,2,3"], ["a.kml", "b.png", "--bbox", "a,b,c,d"], ["a.kml", "b.png", "--projection", "flat"], ["a.kml", "b.png", "--label-color", "red"], ["a.kml", "b.png", "--label-size", "-1"], ["a.kml", "b.png", "--from", "xls"], ["a.kml", "b.png", "--max-dimension", "x"], ["--nope"]])
def test_cli_usage(args):
    assert cli.run(args) == 2


def test_colours_and_formats(spark):
    assert parse_color("#01020304") == (1, 2, 3, 4) and parse_color("#ffffff") == (255, 255, 255, 255)
    for bad in ("ffffff", "#fff", "#gggggg"):
        with pytest.raises(GeoError):
            parse_color(bad)
    assert formats.named("TOPO") == "topojson" and formats.try_detect("x.unknown") is None and formats.detect("A.FGB") == "flatgeobuf"
    assert formats.catalogue(spark).where("NOT reads").first().name == "png"


def test_entry(spark, sf_dir):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 25
    assert set(e.oracle_sql()) <= set(e.queries())


def test_queries_run(spark, sf_dir):
    from geolith.plans import catalogue

    for name, f in catalogue.load()[0].items():
        assert f(spark, sf_dir).count() > 0 or name == "geoparquet_window", name  # no part lies in the window at this size


def whole(sql):
    """The rows of a query's SQL at sf0.001."""
    import duckdb

    con = duckdb.connect()
    for name in ("part", "customer", "orders"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '/root/testdata/sf0.001/{name}.parquet'")
    return sorted(con.execute(sql).fetchall())


@pytest.mark.parametrize("name", ["fill_spans", "pixel_coverage"])
def test_raster_takes_every_part(spark, sf_dir, name):
    from geolith.plans import catalogue

    queries, sql = catalogue.load()
    got = sorted(map(tuple, queries[name](spark, sf_dir).collect()))
    assert got == whole(sql[name])
    assert len({r[0] for r in got}) > 100  # of 200 parts; some triangles are too small or off the canvas for a span


def test_png_scores_take_whole_rows(spark):
    rows = [(0, [1, 255] * 60), (1, [7] * 5), (2, [3, 200, 90] * 50)]
    got = {r.y: r for r in R.png_filter_scores(spark.createDataFrame(rows, "y int, bytes array<int>")).collect()}
    above = []
    for y, row in rows:
        totals = [0] * 5
        for i, v in enumerate(row):
            a, b, c = (row[i - 4] if i >= 4 else 0), (above[i] if i < len(above) else 0), (above[i - 4] if 4 <= i < len(above) + 4 else 0)
            near = min((abs(b - c), 0, a), (abs(a - c), 1, b), (abs(a + b - 2 * c), 2, c))[2]
            for k, guess in enumerate((0, a, b, (a + b) // 2, near)):
                d = (v - guess) % 256
                totals[k] += min(d, 256 - d)
        assert (list(got[y].scores), got[y]["filter"]) == (totals, totals.index(min(totals)))
        above = row


def test_png_query_scores_every_order(spark, sf_dir, tmp_path):
    import duckdb
    from geolith.plans import catalogue

    duckdb.sql(f"COPY (SELECT o_orderkey + 10000 * g AS o_orderkey, o_custkey FROM '{sf_dir}/orders.parquet', range(4) t(g)) TO '{tmp_path}/orders.parquet'")
    queries, sql = catalogue.load()
    con = duckdb.connect()
    con.execute(f"CREATE VIEW orders AS SELECT * FROM '{tmp_path}/orders.parquet'")
    want = con.execute(sql["png_filter_scores"]).fetchall()
    assert sorted(map(tuple, queries["png_filter_scores"](spark, str(tmp_path)).collect())) == sorted(want)


def test_label_rank_takes_every_label(spark, sf_dir):
    from geolith.plans import catalogue

    queries, sql = catalogue.load()
    got = sorted(map(tuple, queries["label_rank"](spark, sf_dir).collect()))
    assert got == whole(sql["label_rank"])
    assert len(got) == 200 + 150


def test_a_cluster_without_a_shared_folder_is_refused():
    from types import SimpleNamespace

    from geolith.session import shared_root

    session = lambda master, named: SimpleNamespace(conf=SimpleNamespace(get=lambda key, default: named), sparkContext=SimpleNamespace(master=master))
    for master in ("spark://host:7077", "yarn", "local-cluster[2,1,1024]"):
        assert shared_root(session(master, "hdfs:/shared/")) == "hdfs:/shared"
        with pytest.raises(GeoError):
            shared_root(session(master, None))
    assert os.path.isdir(shared_root(session("local[8]", None)))


def test_footer_errors(spark, tmp_path):
    (tmp_path / "bad.parquet").write_bytes(b"not so")
    with pytest.raises(GeoError):
        footer(spark, str(tmp_path / "bad.parquet"))
    spark.range(3).write.parquet(str(tmp_path / "plain"))
    with pytest.raises(GeoError):
        footer(spark, str(tmp_path / "plain"))
