import json
import re
import struct
import zipfile
from io import BytesIO

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from geolith.codecs import base, csvgeo, dbf, flatgeobuf, geojson, geoparquet, gpx, kml, shapefile, topojson, wkb, wkt
from geolith.codecs.base import Feature, Geom, JsonRaw, Layer, collection, line, multi_line, point, polygon
from geolith.errors import GeoError
from geolith.sources.files import decode, encode

from .samples import kinds, p, parts, recorded, regions, square, trade


def texts(layer):
    return [None if f.geom is None else wkt.dump(f.geom) for f in layer.walk()]


def props(layer):
    return [f.props for f in layer.walk()]


@pytest.mark.parametrize("value, text", [(1.0, "1"), (0.1, "0.1"), (1e14, "100000000000000"), (1e15, "1E+15"), (1e-5, "1E-05"), (1e-4, "0.0001"), (1e21, "1E+21"), (-0.0, "-0"), (1.2345678901234568e17, "1.2345678901234568E+17"), (1234567890123456.0, "1234567890123456"), (float("nan"), "NaN"), (1.5e300, "1.5E+300")])
def test_numbers(value, text):
    assert base.fmt(value) == text


@given(st.floats(allow_nan=False, allow_infinity=False))
def test_numbers_read_back(v):
    assert float(base.fmt(v)) == v


@pytest.mark.parametrize("text, value", [("42", 42), ("+5", 5), ("-7", -7), (" 12 ", 12), ("1.5", 1.5), ("1e3", 1000.0), ("1d", "1d"), ("true", True), ("FALSE", False), ("", ""), ("abc", "abc"), ("9223372036854775808", 9223372036854775808.0), (None, None)])
def test_infer(text, value):
    got = base.infer(text)
    assert got == value and type(got) is type(value)


# WKT and WKB

VALID = ["POINT (1 2)", "POINT Z (1 2 3)", "POINT M (1 2 4)", "POINT ZM (1 2 3 4)", "LINESTRING (0 0, 1 1)", "POLYGON ((0 0, 4 0, 4 4, 0 0))", "MULTIPOINT ((0 0), (1 1))", "MULTILINESTRING ((0 0, 1 1), (2 2, 3 3))", "MULTIPOLYGON (((0 0, 1 0, 1 1, 0 0)))", "GEOMETRYCOLLECTION (POINT (1 2), GEOMETRYCOLLECTION (POINT (3 4)))", *(f"{k} EMPTY" for k in ("POINT", "LINESTRING", "POLYGON", "MULTIPOINT", "MULTILINESTRING", "MULTIPOLYGON", "GEOMETRYCOLLECTION"))]


@pytest.mark.parametrize("text", VALID)
def test_wkt_and_wkb_round_trip(text):
    g = wkt.parse(text)
    assert wkt.dump(g) == text and wkt.dump(wkb.parse(wkb.dump(g))) == text
    assert wkt.dump(base.geom_of(base.geom_row(g))) == text


@pytest.mark.parametrize("text, want", [("point(1 2 3)", "POINT Z (1 2 3)"), ("POINT(1 2 3 4)", "POINT ZM (1 2 3 4)"), ("MULTIPOINT (0 0, 1 1)", "MULTIPOINT ((0 0), (1 1))"), ("Point z (1e1 .5 -2)", "POINT Z (10 0.5 -2)")])
def test_wkt_forms(text, want):
    assert wkt.dump(wkt.parse(text)) == want


def broken(text):
    """Texts that each lack or have one thing too much: a parenthesis, the keyword, a digit in a number, the rest after a comma."""
    yield from (text.replace(c, "", 1) for c in "()" if c in text)
    yield from (text + more for more in (" POINT", ")", " 7"))
    yield text[text.index("(") :] if "(" in text else "X" + text
    yield "NO" + text
    yield from (text[: m.start()] + bad + text[m.end() :] for m in re.finditer(r"[0-9]", text) for bad in ("-", "e4", "1_", "0x"))
    yield from (text[: m.end()] for m in re.finditer(",", text))


@pytest.mark.parametrize("text", sorted({b for t in VALID for b in broken(t)}))
def test_wkt_errors(text):
    with pytest.raises(GeoError):
        wkt.parse(text)


def test_wkb_forms():
    ewkb = struct.pack("<BII2d", 1, 0x20000001, 4326, 1, 2)
    assert wkt.dump(wkb.parse(ewkb)) == "POINT (1 2)"
    assert wkt.dump(wkb.parse(struct.pack(">BI3d", 0, 0x80000001, 1, 2, 3))) == "POINT Z (1 2 3)"
    for bad in (b"", b"\x01\x01", struct.pack("<BI", 1, 99), struct.pack("<BII", 1, 2, 1 << 30), wkb.dump(point(p(1, 2))) + b"x"):
        with pytest.raises(GeoError):
            wkb.parse(bad)


@settings(max_examples=50)
@given(st.recursive(st.builds(lambda ps: line([p(*q) for q in ps]), st.lists(st.tuples(st.integers(-180, 180), st.integers(-90, 90)), max_size=4)), lambda c: st.builds(collection, st.lists(c, min_size=1, max_size=3)), max_leaves=6))
def test_nested_collections_survive_rows(g: Geom):
    assert wkt.dump(base.geom_of(base.geom_row(g))) == wkt.dump(g)


# every format with every type

KEEPS = {"geojson": set(), "wkt": set(), "wkb": set(), "kml": set(), "kmz": set(), "flatgeobuf": {"z"}, "geoparquet": set(), "csv": set(), "topojson": {"z", "collection"}}


@pytest.mark.parametrize("fmt", KEEPS)
def test_types_survive(fmt):
    geoms = [g for g in kinds() if not ("collection" in KEEPS[fmt] and g.kind == "GeometryCollection")]
    back = decode(fmt, encode(fmt, Layer(features=[Feature(g) for g in geoms])))
    assert [f.geom.kind for f in back.walk()] == [g.kind for g in geoms]
    assert next(back.walk()).geom.has_z == ("z" not in KEEPS[fmt])


@pytest.mark.parametrize("fmt", ["geojson", "topojson", "csv", "flatgeobuf", "geoparquet"])
def test_properties_survive(fmt):
    assert props(decode(fmt, encode(fmt, trade()))) == props(trade())


def test_xml_properties_are_text():
    assert props(decode("kml", encode("kml", trade()))) == [{k: base.text_of(v) for k, v in f.items()} for f in props(trade())]


def test_geojson_details():
    out = json.loads(geojson.write(Layer(features=[Feature(polygon([square(0, 0, 4)[::-1]]), {"raw": JsonRaw('{"a":[1]}'), "nan": float("nan"), "n": 2.0}, "id7"), Feature(None, {}, 5), Feature(point(None))])))
    first, second, third = out["features"]
    assert list(first) == ["type", "id", "geometry", "properties"] and first["id"] == "id7" and first["properties"] == {"raw": {"a": [1]}, "nan": None, "n": 2}
    assert first["geometry"]["coordinates"][0][1] == [4, 0]  # counter-clockwise
    assert second["geometry"] is None and third["geometry"]["coordinates"] == []
    with pytest.raises(GeoError):
        geojson.write(Layer(features=[Feature(point(p(float("inf"), 0)))]))
    bare = geojson.read(b'{"type":"Point","coordinates":[1,2,3,4]}')
    assert texts(bare) == ["POINT Z (1 2 3)"]
    assert geojson.read(b'{"type":"FeatureCollection"}').features == []
    assert props(geojson.read(b'{"type":"Feature","geometry":null,"properties":{"big":9223372036854775808,"x":{"y":1}}}')) == [{"big": 9223372036854775808.0, "x": '{"y":1}'}]
    for bad in (b"{}", b'{"type":"Blob"}', b"nope"):
        with pytest.raises(GeoError):
            decode("geojson", bad)


def test_topojson_quantised_and_shared_arcs():
    t = {"type": "Topology", "transform": {"scale": [0.5, 2], "translate": [10, 20]}, "arcs": [[[0, 0], [2, 1]], [[2, 1], [2, 0]]], "objects": {"a": {"type": "LineString", "arcs": [0, 1], "id": 3}, "b": {"type": "GeometryCollection", "properties": {"lost": 1}, "geometries": [{"type": "LineString", "arcs": [-1]}, {"type": "Point", "coordinates": [2, 1]}]}}}
    back = topojson.read(json.dumps(t).encode())
    assert [c.name for c in back.children] == ["a", "b"] and next(back.walk()).id == 3
    assert texts(back) == ["LINESTRING (10 20, 11 22, 12 22)", "LINESTRING (11 22, 10 20)", "POINT (11 22)"]


def test_topojson_names_and_limits():
    assert topojson.object_names(["data", None, "data", "x", "x"]) == ["data_1", "layer_1", "data_2", "x", "x_1"]
    assert list(json.loads(topojson.write(regions()))["objects"]) == ["data", "CHINA", "INDIA"]
    assert json.loads(topojson.write(trade()))["arcs"][0] == [list(q[:2]) for q in trade().features[1].geom.parts[0][0]]
    with pytest.raises(GeoError):
        topojson.write(Layer(features=[Feature(collection([point(p(1, 1))]))]))
    assert texts(decode("topojson", topojson.write(Layer(features=[Feature(None, {"a": 1}), Feature(point(p(1, 2)))])))) == [None, "POINT (1 2)"]


def test_layers_survive():
    for fmt in ("kml", "kmz"):
        back = decode(fmt, encode(fmt, regions()))
        assert back.name == "ASIA" and back.props == {"description": "a region"} and [c.name for c in back.children] == ["CHINA", "INDIA"] and back.children[1].children[0].name == "suppliers"
        assert [f.props["name"] for f in back.walk()] == [f.props["name"] for f in regions().walk()]
    back = gpx.read(gpx.write(recorded()))
    assert [c.name for c in back.children] == ["waypoints", "routes", "tracks"] and texts(back) == texts(recorded()) and [f.geom.has_z for f in back.walk()] == [True, False, True]
    rows = base.feature_rows(regions(), "x")
    again = base.layer_of(rows, base.layer_rows(regions(), "x"))
    assert [f.props for f in again.walk()] == [f.props for f in regions().walk()] and again.name == "ASIA" and again.children[1].children[0].name == "suppliers"


def test_gpx_details():
    poly = Layer(features=[Feature(polygon([square(0, 0, 4), square(1, 1, 1)]), {"name": "x", "other": 1}), Feature(None), Feature(collection([point(p(1, 1)), multi_line([[p(0, 0), p(1, 1)]])]))])
    out = gpx.write(poly).decode()
    assert out.count("<trk>") == 2 and out.count("<trkseg>") == 3 and out.count("<wpt") == 1 and "other" not in out
    for bad in (b'<gpx><wpt lat="x" lon="1"/></gpx>', b'<gpx><wpt lat="1" lon="1"><ele>q</ele></wpt></gpx>', b"<gpx>", b'<!DOCTYPE a [<!ENTITY b "c">]><gpx/>'):
        with pytest.raises(GeoError):
            decode("gpx", bad)


def test_kml_details():
    body = b"""<kml xmlns="http://www.opengis.net/kml/2.2"><Document><Style/><Placemark><name>n</name><MultiGeometry><Point><coordinates>1,2,3</coordinates></Point><LineString><coordinates>0,0 1,1</coordinates></LineString></MultiGeometry><Point><coordinates>9,9</coordinates></Point></Placemark>
    <Placemark><MultiGeometry/></Placemark><Placemark><Point><coordinates></coordinates></Point></Placemark></Document></kml>"""
    assert texts(kml.read(body)) == ["GEOMETRYCOLLECTION Z (POINT Z (1 2 3), LINESTRING (0 0, 1 1))", "GEOMETRYCOLLECTION EMPTY", "POINT EMPTY"]
    with pytest.raises(GeoError):
        kml.read(b"<kml><Placemark><Point><coordinates>1,x</coordinates></Point></Placemark></kml>")
    held = BytesIO()
    with zipfile.ZipFile(held, "w") as z:
        z.writestr("a.kml", kml.write(trade()))
        z.writestr("sub/b.KML", kml.write(regions()))
    back = kml.read_kmz(held.getvalue())
    assert [c.name for c in back.children] == ["a", "ASIA"]
    assert kml.write_kmz(trade()) == kml.write_kmz(trade())
    with pytest.raises(GeoError):
        decode("kmz", b"PK")


def test_csv_details():
    assert props(csvgeo.read(b"a,b\r\n1,x\r2,\n\n\"q\"\"z,\n\",y")) == [{"a": 1, "b": "x"}, {"a": 2}, {}, {"a": 'q"z,\n', "b": "y"}]
    assert texts(csvgeo.read(b"lon,lat,name\n1,2,A\nbad,2,B\n")) == ["POINT (1 2)", None]
    back = csvgeo.read(b"Name, WKT ,x,y\nA,POINT (1 2),7,8,extra\n")
    assert texts(back) == ["POINT (1 2)"] and props(back) == [{"Name": "A", "x": 7, "y": 8}]
    with pytest.raises(GeoError):
        csvgeo.read(b"WKT,a\n  ,1\n")  # blank, but not empty
    assert csvgeo.lex('x"y"z,1') == [["xyz", "1"]]
    assert props(csvgeo.read(b"a,a\n1,2")) == [{"a": 2}]
    out = csvgeo.write(Layer(features=[Feature(None, {"k": 'a,"b"\n'}), Feature(point(p(1, 2)), {"j": 2.5})])).decode()
    assert out == 'WKT,k,j\n,"a,""b""\n",\nPOINT (1 2),,2.5\n'


# shapefiles


def test_shapefile_round_trip():
    files = shapefile.write(parts())
    assert set(files) == {"shp", "shx", "dbf", "prj"}
    back = shapefile.read(files["shp"], files["dbf"])
    assert [f.geom.kind for f in back.walk()] == ["Polygon", "MultiPolygon"] and props(back) == props(parts())
    ring = next(back.walk()).geom.parts[0]
    assert base.area(ring[0]) < 0 < base.area(ring[1])  # clockwise outside
    offsets = [2 * struct.unpack_from(">i", files["shx"], 100 + 8 * i)[0] for i in range(2)]
    assert [struct.unpack_from(">i", files["shp"], o)[0] for o in offsets] == [1, 2]
    assert len(shapefile.records(files["shp"][:-5])) == 1


def test_shapefile_limits():
    with pytest.raises(GeoError):
        shapefile.write(trade())
    with pytest.raises(GeoError):
        shapefile.write(Layer(features=[Feature(collection([]))]))
    nulls = shapefile.write(Layer(features=[Feature(None, {"a": None}), Feature(point(None))]))
    assert texts(shapefile.read(nulls["shp"], nulls["dbf"])) == [None, None] and struct.unpack_from("<i", nulls["shp"], 32)[0] == 1
    assert [len(x) for x in shapefile.records(nulls["shp"])] == [4, 4]
    bundle = shapefile.write_directory(Layer(features=[Feature(point(p(1, 2)))], children=[Layer("Brand#6", features=parts().features), Layer(features=[])]))
    assert {n for n in bundle if n.endswith(".shp")} == {"data.shp", "Brand#6.shp", "layer_1.shp"}


def test_stray_counter_clockwise_ring_opens_a_polygon():
    rings = [square(0, 0, 4)[::-1], square(1, 1, 1), square(50, 50, 2)]
    assert [len(x) for x in shapefile.polygons_of(rings)] == [2, 1]


def test_deleted_rows_shift_unless_told_otherwise():
    files = shapefile.write(Layer(features=[Feature(point(p(i, i)), {"n": i}) for i in range(3)]))
    table = bytearray(files["dbf"])
    head, width = struct.unpack_from("<HH", table, 8)
    table[head] = 0x2A
    assert [f.props.get("n") for f in shapefile.read(files["shp"], bytes(table)).walk()] == [1, 2, None]
    assert [f.props.get("n") for f in shapefile.read(files["shp"], bytes(table), compat_deleted_shift=False).walk()] == [0, 1, 2]


def test_dbf_plan():
    rows = [{"flag": True, "n": 7, "r": 1.25, "s": "abc", "e": None, "mix": True}, {"flag": False, "n": -123, "r": 10, "s": "ü", "e": None, "mix": 3}]
    layer = Layer(features=[Feature(None, r) for r in rows])
    got = {f.name: (f.kind, f.length, f.decimals) for f in dbf.plan(base.keys_of(layer), layer)}
    assert got == {"flag": ("L", 1, 0), "n": ("N", 4, 0), "r": ("N", 4, 2), "s": ("C", 3, 0), "e": ("C", 1, 0), "mix": ("C", 4, 0)}
    back = dbf.read(dbf.write(base.keys_of(layer), layer))
    assert back[0] == {"flag": True, "n": 7, "r": 1.25, "s": "abc", "e": None, "mix": "true"} and back[1]["s"] == "ü"
    assert dbf.unique_names(["l_extendedprice", "l_extendedtax", "L_EXTENDED"]) == ["l_extended", "l_extend_1", "L_EXTEND_2"]
    assert shapefile.encoding(b"UTF-8") == "utf-8" and shapefile.encoding(b"1252") == shapefile.encoding(None) == "latin-1"


# FlatGeobuf and GeoParquet


def test_flatgeobuf_details():
    layer = Layer(features=[Feature(None, {"a": 1}), Feature(point(None), {"b": "é"}), *(Feature(g) for g in kinds())])
    back = flatgeobuf.read(flatgeobuf.write(layer))
    assert texts(back)[:2] == [None, "POINT EMPTY"] and props(back)[:2] == [{"a": 1}, {"b": "é"}]
    assert flatgeobuf.index_size(2, 16) == 120
    assert flatgeobuf.index_size(5, 1) == flatgeobuf.index_size(5, 0) == flatgeobuf.index_size(5, 2) == 40 * (5 + 3 + 2 + 1)
    data = flatgeobuf.write(parts())
    for at in (3, 7):  # another version, another patch of it
        with pytest.raises(GeoError):
            flatgeobuf.read(data[:at] + bytes([data[at] + 1]) + data[at + 1 :])
    for bad in (b"nope", flatgeobuf.MAGIC, flatgeobuf.write(trade())[:-3]):
        with pytest.raises(GeoError):
            decode("flatgeobuf", bad)


def test_flatgeobuf_against_the_public_runtime():
    flatbuffers = pytest.importorskip("flatbuffers")
    data = flatgeobuf.write(parts())
    head = flatbuffers.table.Table(data[12:], flatbuffers.encode.Get(flatbuffers.packer.uoffset, data, 12))
    o = head.Offset(4 + 2 * 8)
    assert head.Get(flatbuffers.number_types.Uint64Flags, o + head.Pos) == 2
    assert head.VectorLen(head.Offset(4 + 2 * 7)) == 3


def test_widening():
    layer = Layer(features=[Feature(None, {"e": None, "num": 1, "mixed": "x", "late": True}), Feature(None, {"e": 5, "num": 2.5, "mixed": 3, "late": None})])
    assert base.widened(layer) == {"e": "string", "num": "double", "mixed": "string", "late": "bool"}


def test_geoparquet_details():
    data = geoparquet.write(trade())
    f = pq.ParquetFile(BytesIO(data))
    geo = json.loads(f.schema_arrow.metadata[b"geo"])
    assert geo["columns"]["geometry"]["geometry_types"] == ["LineString", "Point", "Polygon"] and geo["columns"]["geometry"]["bbox"] == [f(q[i] for g in trade().walk() for q in g.geom.positions()) for f in (min, max) for i in (0, 1)]
    assert pq.ParquetFile(BytesIO(geoparquet.write(Layer()))).num_row_groups == 0
    for codec in ("zstd", "lzma"):
        with pytest.raises(GeoError):
            geoparquet.write(trade(), codec)
    held = BytesIO()
    pq.write_table(pa.table({"a": [1]}), held)
    for bad in (held.getvalue(), b"PAR1", b"nope"):
        with pytest.raises(GeoError):
            decode("geoparquet", bad)
    held = BytesIO()
    table = pa.table({"geometry": [wkb.dump(point(p(1, 2)))], "i": pa.array([3], pa.int32()), "d": pa.array(["x"]).dictionary_encode()}).replace_schema_metadata({"geo": geoparquet.geo_metadata(["Point"], None)})
    pq.write_table(table, held, compression="zstd")
    assert props(geoparquet.read(held.getvalue())) == [{"i": 3, "d": "x"}]


def test_columns_hold_what_rows_hold():
    from geolith.codecs import columnar

    geoms = [wkt.parse(t) for t in VALID] + [None, *kinds()]
    column = columnar.column(geoms)
    assert column.to_pylist() == [base.geom_row(g) for g in geoms]
    for c in (column, column.slice(3, 9), column.slice(len(geoms) - 5)):
        back = columnar.geometries(c)
        assert [None if g is None else wkt.dump(g) for g in back] == [None if r is None else wkt.dump(base.geom_of(r)) for r in c.to_pylist()]
    assert columnar.geometries(columnar.column([])) == []
