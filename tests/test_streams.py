"""Documents are taken and made piece by piece: none is held whole, and the result is that of the whole."""

import os

import pytest

from geolith.codecs import base, geojson, kml, topojson, wkt
from geolith.codecs.base import Feature, Layer
from geolith.sources.files import DOCUMENTS, STREAMS, _pieces, decode, encode, read_files, write_files

from .samples import kinds, parts, regions, trade

FORMATS = ["geojson", "kml", "topojson"]


def plain(f):
    return None if f.geom is None else wkt.dump(f.geom), f.props, f.id


def taken(fmt, data, step):
    split, parse = STREAMS[fmt][:2]
    found = split(data[a : a + step] for a in range(0, len(data), step))
    return sorted((seq, list(order), list(path), plain(parse(text))) for order, path, seq, text in found)


def whole(fmt, data):
    rows = base.feature_rows(decode(fmt, data), "", geom=lambda g: None if g is None else wkt.dump(g))
    return [(r["seq"], r["layer_ord"], r["layer_path"], (r["geom"], {p["key"]: base.untag(p["value"]) for p in r["props"]}, base.untag(r["id"]))) for r in rows]


@pytest.mark.parametrize("fmt", FORMATS)
@pytest.mark.parametrize("step", [1, 7, 64, 1 << 20])
def test_chunks_give_what_the_whole_gives(fmt, step):
    named = Layer(features=[Feature(g, {"name": 'a "}" \\ Placemark é', "n": i}) for i, g in enumerate(kinds()[:6])] + [Feature(None, {"name": None})])
    for layer in (trade(), parts(), regions(), named, Layer()):
        data = encode(fmt, layer)
        assert taken(fmt, data, step) == whole(fmt, data)


@pytest.mark.parametrize("fmt", FORMATS)
def test_features_come_before_the_end_is_read(fmt):
    read = []
    data = encode(fmt, Layer(features=[Feature(g, {"i": i}) for i in range(14_000) for g in kinds()[1:2]]))
    chunks = (read.append(a) or data[a : a + 10_000] for a in range(0, len(data), 10_000))
    if fmt == "topojson":  # arcs come last: see test_topojson_forms
        return
    next(iter(STREAMS[fmt][0](chunks)))
    assert len(data) > 3_000_000 and len(read) * 10_000 < len(data) / 2


@pytest.mark.parametrize("fmt", FORMATS)
def test_no_cell_holds_a_file_and_no_byte_is_lost(spark, tmp_path, fmt):
    layer = Layer(features=[Feature(g, {"name": f"{i} }} Placemark"}) for i in range(50) for g in kinds()[:6]])
    path = str(tmp_path / f"a b%20+é.{fmt}")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20k")
    try:
        open(path, "wb").write(encode(fmt, layer))
        rows = _pieces(spark, path, STREAMS[fmt][2]).collect()
        back = read_files(spark, path, fmt).orderBy("seq").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert max(len(r.value) for r in rows) < os.path.getsize(path) / 5
    assert [wkt.dump(base.geom_of(r.geom.asDict(True))) for r in back] == [wkt.dump(f.geom) for f in decode(fmt, encode(fmt, layer)).walk()]
    assert {r.source_file for r in back} == {spark.read.format("binaryFile").load(path).select("path").first().path}


@pytest.mark.parametrize("fmt", FORMATS)
def test_odd_files(spark, tmp_path, fmt):
    (tmp_path / "marked").write_bytes(b"\xef\xbb\xbf" + encode(fmt, trade()))
    (tmp_path / "cut").write_bytes(encode(fmt, trade())[:-30])
    rows = read_files(spark, str(tmp_path), fmt, mode="PERMISSIVE").collect()
    assert sorted(os.path.basename(r.source_file) for r in rows if r["_corrupt"]) == ["cut"] and len(rows) == 4
    assert read_files(spark, str(tmp_path), fmt, mode="DROPMALFORMED").count() == 3


def test_geojson_forms():
    read = lambda text: [plain(geojson.one(t)) for *_, t in geojson.features([text.encode()])]
    point = '{"type":"Feature","geometry":{"type":"Point","coordinates":[1,2]},"properties":{}}'
    assert read(f'{{"features":[{point}],"bbox":[1,2],"type":"FeatureCollection"}}') == read(point) == read('{"coordinates":[1,2],"type":"Point","features":[1]}')
    assert read('{"type":"FeatureCollection"}') == []
    for bad in ("[]", "{}", '{"features":[]}', f'{{"type":"FeatureCollection","features":[{point}]}} x', f'{{"type":"FeatureCollection","features":[{point},]}}', '{"type":"FeatureCollection","features":null}', f'{{"features":[{point}],"type":"Feature"}}'):
        with pytest.raises((base.GeoError, ValueError)):
            read(bad)


@pytest.mark.parametrize("fmt", FORMATS)
def test_joined_texts_are_the_document(spark, tmp_path, fmt):
    from .test_spark import features

    fragment, document = DOCUMENTS[fmt]
    for i, layer in enumerate((trade(), parts(), regions())):
        write_files(features(spark, layer), path := str(tmp_path / f"{i}.{fmt}"), fmt)
        assert whole(fmt, open(path, "rb").read()) == whole(fmt, encode(fmt, layer))
    assert [n for n in os.listdir(tmp_path) if n.startswith(".") and not n.endswith(".crc")] == []


def test_kml_forms():
    head = '<?xml version="1.0" encoding="iso-8859-1"?>'
    body = """<k:kml xmlns:k="http://www.opengis.net/kml/2.2" xmlns:g="urn:g"><k:Document><k:Folder><k:Placemark/><k:Folder><k:Placemark ><k:name>a/></k:name></k:Placemark></k:Folder>
    <k:Placemark><g:x/><k:name>\xe9 &amp; <![CDATA[</k:Placemark>]]></k:name><!-- </k:Placemark> --><k:Point><k:coordinates>1,2,3</k:coordinates></k:Point></k:Placemark ><k:name>late</k:name></k:Folder>
    <k:Placemark><k:name>root</k:name></k:Placemark><k:Other><k:Placemark/></k:Other></k:Document></k:kml>"""
    for data in ((head + body).encode("latin-1"), body.encode(), b"\xef\xbb\xbf" + body.encode(), body.encode("utf-16"), b"<Placemark><name>x</name></Placemark>", b"<Folder><Document><Placemark/></Document></Folder>"):
        for step in (1, 5, 1000):
            assert taken("kml", data, step) == whole("kml", data)
    for bad in (b"", b"<kml>", b"<kml/>x", b"<kml><a:Placemark/></kml>", b"<!DOCTYPE kml [<!ENTITY a 'b'>]><kml><Placemark><name>&a;</name></Placemark></kml>"):
        with pytest.raises(base.GeoError):
            list(kml.features([bad]))


def test_topojson_forms():
    arcs = '"arcs":[[[0,0],[1,2]],[[1,2],[3,0]],[[9,9],[8,8]]]'
    objects = """"objects":{"b":{"geometries":[{"type":"LineString","arcs":[0,1],"id":5},{"type":"GeometryCollection","geometries":[{"type":"Point","coordinates":[1,2]},{"type":null}]},
    {"type":"Polygon","arcs":[[0,-2,0]],"properties":{"}":"}"}}],"type":"GeometryCollection"},"a":{"type":"MultiLineString","arcs":[[-1],[1]],"geometries":[{"type":"Point"}]},"c":{"geometries":[{"type":"Point"}],"type":"LineString","arcs":[2]},"d":{"type":"GeometryCollection"}}"""
    scale = '"transform":{"scale":[0.5,2],"translate":[10,20]}'
    for members in ((arcs, objects), (objects, arcs), (objects, arcs, scale), (scale, arcs, objects)):
        data = ("{" + ",".join((*members, '"type":"Topology"')) + "}").encode()
        for step in (1, 11, 1000):
            assert taken("topojson", data, step) == whole("topojson", data)
    for bad in (b"{", b"[]", b'{"type":"X"}', b'{"type":"Topology","objects":{"a":{"type":"LineString","arcs":[0]}}}'):
        with pytest.raises((base.GeoError, ValueError)):
            list(topojson.features([bad]))
