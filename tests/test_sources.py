from __future__ import annotations

import struct

import numpy as np
import pytest

from pyspark.sql import functions as F

from plumbline.sources import dxf, las, sinks, tables


def put(path, text):
    path.write_text(text, encoding="utf-8")
    return str(path)


@pytest.mark.parametrize("header", ["PointID,Northing,Easting,Elevation,Description", "﻿point_id,n,e,z,code", "Name;North;East;Elev;Desc", "pt\ty\tx\theight\tcode"])
def test_canonical_headers(spark, tmp_path, header):
    sep = next(c for c in ",;\t" if c in header)
    path = put(tmp_path / "p.csv", "\n".join([header, *[sep.join(r) for r in (("001", "1.5", "2.5", "", "MH"), ("100A", "3", "4", "5", ""))]]))
    rows = sorted(tuple(r) for r in tables.canonical_points(spark, path).collect())
    assert [r[:4] for r in rows] == [("001", 1.5, 2.5, None), ("100A", 3.0, 4.0, 5.0)]


@pytest.mark.parametrize("row", ["1,nan,2,3,x", "1,inf,2,3,x", "1,bad,2,3,x", ",1,2,3,x", "1,1,2,bad,x"])
def test_canonical_rejects(spark, tmp_path, row):
    path = put(tmp_path / "p.csv", "point_id,northing,easting,elevation,code\n" + row)
    with pytest.raises(ValueError):
        tables.canonical_points(spark, path)


def test_ambiguous_headers_are_rejected(spark, tmp_path):
    path = put(tmp_path / "p.csv", "point_id,point,northing,easting\n1,2,3,4")
    with pytest.raises(ValueError):
        tables.canonical_points(spark, path)


def test_staging_and_commit(spark, tmp_path):
    path = put(tmp_path / "p.csv", "point_id,point,northing,y,easting\nA,B,100,9,200\nA,B,101,9,201\nC,D,bad,9,1\nE,F,1,9,1\n")
    staged = tables.staged_points(spark, path)
    assert sorted((r.point_id, r.status) for r in staged.collect()) == [("A", "DUPLICATE"), ("A", "VALID"), ("C", "INVALID"), ("E", "VALID")]
    assert [r.point_id for r in tables.commit_staged(spark.createDataFrame([("E",)], "point_id string"), staged).collect()] == ["A"]


def test_whitespace_points(spark, tmp_path):
    path = put(tmp_path / "p.txt", "1 10.0 20.0 5.5 EP edge left\n\n2\t11 21 6\n")
    assert sorted(tuple(r) for r in tables.whitespace_points(spark, path).collect()) == [("1", 10.0, 20.0, 5.5, "EP edge left"), ("2", 11.0, 21.0, 6.0, "")]


def test_xml_family(spark, tmp_path):
    land = put(tmp_path / "a.xml", '<LandXML><CgPoints><CgPoint name="1" code="EP">10.5 20.5 3.25</CgPoint><CgPoint name="2" code="">1 2</CgPoint></CgPoints></LandXML>')
    rows = {r.point_id: r for r in tables.landxml_points(spark, land).collect()}
    assert (rows["1"].northing, rows["2"].elevation) == (10.5, None)
    job = put(tmp_path / "b.jxl", "<JOBFile><Reductions><Point><Name>7</Name><Code>C</Code><Grid><North>1</North><East>2</East><Elevation>3</Elevation></Grid></Point><Point><Name>8</Name></Point></Reductions></JOBFile>")
    assert [tuple(r) for r in tables.jobxml_points(spark, job).collect()] == [("7", "C", 1.0, 2.0, 3.0)]
    kml = put(tmp_path / "c.kml", "<kml><Document><Placemark><name>a</name><Point><coordinates>-105.5,40.25,0</coordinates></Point></Placemark><Placemark><name>b</name></Placemark></Document></kml>")
    assert [tuple(r) for r in tables.kml_points(spark, kml).collect()] == [("a", -105.5, 40.25, 0.0)]


def test_geojson_and_schema(spark, tmp_path):
    path = put(tmp_path / "g.json", '{"type":"FeatureCollection","features":[{"type":"Feature","geometry":{"type":"Point","coordinates":[2.5,1.5]},"properties":{"a":"1","b":"x"}},{"type":"Feature","geometry":{"type":"LineString","coordinates":[[0,0],[1,1]]},"properties":{"a":"2.5","b":null}}]}')
    rows = tables.geojson_features(spark, path)
    assert sorted((r.kind, r.x, r.y) for r in rows.collect()) == [("LineString", None, None), ("Point", 2.5, 1.5)]
    assert {r.name: r.types for r in tables.feature_schema(rows).collect()} == {"a": ["integer", "number"], "b": ["null", "text"]}


DXF = "0\nSECTION\n2\nENTITIES\n0\nLINE\n8\nroad\n10\n0\n20\n0\n30\n0\n11\n10\n21\n5\n31\n1\n0\nLWPOLYLINE\n8\nlot\n70\n1\n10\n0\n20\n0\n10\n4\n20\n0\n10\n4\n20\n3\n0\nCIRCLE\n8\nc\n10\n1\n20\n1\n40\n2\n0\nSPLINE\n8\ns\n0\nENDSEC\n0\nEOF\n"


def test_dxf(spark, tmp_path):
    found = dxf.dxf_entities(spark, put(tmp_path / "d.dxf", DXF))
    rows = {r.kind: r for r in found.collect()}
    assert rows["LINE"].xs == [0, 10] and rows["LWPOLYLINE"].ys == [0, 0, 3, 0] and rows["SPLINE"].xs is None
    assert len(rows["CIRCLE"].xs) == 74 and abs(rows["CIRCLE"].xs[0] - 3) < 1e-12
    assert dxf.segments(found).where("kind = 'LWPOLYLINE'").count() == 3


def las_file(path, n=1000):
    head = bytearray(227)
    head[:4], head[24], head[25] = b"LASF", 1, 2
    struct.pack_into("<HI", head, 94, 227, 227)
    struct.pack_into("<BHI", head, 104, 0, 20, n)
    struct.pack_into("<12d", head, 131, 0.01, 0.01, 0.01, 1000, 2000, 0, 1, 0, 1, 0, 1, 0)
    xyz = np.zeros((n, 20), np.uint8)
    xyz[:, :12] = np.column_stack([np.arange(n), 2 * np.arange(n), 3 * np.arange(n)]).astype("<i4").view(np.uint8).reshape(n, 12)
    path.write_bytes(bytes(head) + xyz.tobytes())
    return str(path)


def test_las(spark, tmp_path):
    path = las_file(tmp_path / "a.las")
    h = las.las_headers(spark, path).first()
    assert (h.version, h.n_points, h.record_length, h.x_offset) == ("1.2", 1000, 20, 1000)
    spark.dataSource.register(las.LasSource)
    points = spark.read.format("las_points").option("rowsPerPartition", 300).load(path)
    assert points.rdd.getNumPartitions() == 4 and points.count() == 1000
    last = points.orderBy(points.record.desc()).first()
    assert (last.record, round(last.x, 6), round(last.y, 6)) == (999, 1009.99, 2019.98)
    with pytest.raises(ValueError):
        las.header(b"nope")


def test_exports_round_trip(spark, tmp_path):
    pts = spark.createDataFrame([("1", 1.5, 2.25, None, "=x"), ("2", 3.0, 4.0, 5.0, "ok")], "point_id string, northing double, easting double, elevation double, description string")
    assert sorted(r.value for r in sinks.pnezd(pts, 2).collect()) == ["1,1.50,2.25,,'=x", "2,3.00,4.00,5.00,ok"]
    sinks.write_landxml(pts, str(tmp_path / "x"))
    back = {r.point_id: r for r in tables.landxml_points(spark, str(tmp_path / "x")).collect()}
    assert (back["2"].northing, back["2"].elevation, back["1"].elevation) == (3.0, 5.0, None)
    sinks.write_points(pts, str(tmp_path / "c"), places=3)
    assert tables.canonical_points(spark, str(tmp_path / "c")).count() == 2
    lines = spark.createDataFrame([("a", 2, 0.0, 1.0), ("a", 1, 5.0, 6.0), ("b", 1, 0.0, 0.0)], "line_id string, seq int, easting double, northing double")
    assert [r.value for r in sinks.line_geojson(lines).collect()] == ['{"type":"Feature","geometry":{"type":"LineString","coordinates":[[5.0,6.0],[0.0,1.0]]},"properties":{"line_id":"a"}}']


def test_source_registration(spark, tmp_path):
    for name, text in (("a.bin", "same"), ("b.bin", "same"), ("c.bin", "other")):
        put(tmp_path / name, text)
    rows = tables.register_sources(spark, f"{tmp_path}/*.bin").collect()
    assert sum(r.path != r.original for r in rows) == 1


def test_map_and_table_sinks(spark, tmp_path):
    import json

    points = spark.createDataFrame([("1", 10.0, 20.0, None, "MH <a> & b"), ("2", None, 1.0, None, None), ("=3", 5.0, 6.0, 7.0, "=x")], "point_id string, northing double, easting double, elevation double, description string")
    found = [json.loads(r.value) for r in sinks.project_map(points, points.select(F.col("point_id").alias("structure_id"), "northing", "easting"), points.limit(0).withColumnRenamed("point_id", "control_id")).collect()]
    assert sorted((f["properties"]["kind"], f["properties"]["id"], f["geometry"]["coordinates"]) for f in found) == [
        ("survey_point", "1", [20.0, 10.0]), ("survey_point", "=3", [6.0, 5.0]), ("utility_structure", "1", [20.0, 10.0]), ("utility_structure", "=3", [6.0, 5.0]),
    ]
    sinks.write_table(points, f"{tmp_path}/t")
    assert {r.description for r in spark.read.csv(f"{tmp_path}/t", header=True).collect()} == {"MH <a> & b", None, "'=x"}
    geo = points.selectExpr("point_id", "easting AS lon", "northing AS lat", "elevation", "description")
    sinks.write_kml(geo, f"{tmp_path}/k")
    assert sorted((r.name, r.lon, r.lat) for r in tables.kml_points(spark, f"{tmp_path}/k").collect()) == [("1", 20.0, 10.0), ("=3", 6.0, 5.0)]
    body = "\n".join(r.value for r in sinks.dxf_points(points.where("northing is not null")).collect())
    drawing = tmp_path / "d.dxf"
    drawing.write_text(f"0\nSECTION\n2\nENTITIES\n{body}\n0\nENDSEC\n0\nEOF\n")
    assert sorted((r.layer, r.xs[0], r.ys[0]) for r in dxf.dxf_entities(spark, str(drawing)).collect()) == [("MH_a_b", 20.0, 10.0), ("_x", 6.0, 5.0)]
