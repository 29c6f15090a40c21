from __future__ import annotations

import json
import sqlite3
import struct

import numpy as np
import pyarrow as pa
import pytest

from plumbline.sources import geometry, shapefile


def wkb(order, code, body):
    return bytes([order == "<"]) + struct.pack(order + "I", code) + body


def numbers(order, *values):
    return struct.pack(f"{order}{len(values)}d", *values)


def count(order, n):
    return struct.pack(order + "I", n)


@pytest.mark.parametrize("order", ["<", ">"])
def test_hand_written_binaries(order):
    n, c = (lambda *v: numbers(order, *v)), (lambda k: count(order, k))
    ring, hole = c(4) + n(0, 0, 9, 0, 9, 9, 0, 0), c(4) + n(1, 1, 2, 1, 2, 2, 1, 1)
    cases = {
        "point": (wkb(order, 1, n(3, 4)), ("Point", [3], [4], None, [1], [1])),
        "point z": (wkb(order, 1001, n(3, 4, 5)), ("Point", [3], [4], [5], [1], [1])),
        "point zm": (wkb(order, 3001, n(3, 4, 5, 6)), ("Point", [3], [4], [5], [1], [1])),
        "point m": (wkb(order, 2001, n(3, 4, 6)), ("Point", [3], [4], None, [1], [1])),
        "high bit z": (wkb(order, 0x80000001, n(3, 4, 5)), ("Point", [3], [4], [5], [1], [1])),
        "empty point": (wkb(order, 1, n(float("nan"), float("nan"))), ("Point", [], [], None, [0], [1])),
        "line": (wkb(order, 2, c(2) + n(1, 2, 3, 4)), ("LineString", [1, 3], [2, 4], None, [2], [1])),
        "polygon": (wkb(order, 3, c(2) + ring + hole), ("Polygon", [0, 9, 9, 0, 1, 2, 2, 1], [0, 0, 9, 0, 1, 1, 2, 1], None, [4, 8], [2])),
        "points": (wkb(order, 4, c(2) + wkb(order, 1, n(1, 2)) + wkb(order, 1, n(3, 4))), ("MultiPoint", [1, 3], [2, 4], None, [1, 2], [1, 2])),
        "lines": (wkb(order, 5, c(2) + wkb(order, 2, c(1) + n(1, 2)) + wkb(order, 2, c(2) + n(3, 4, 5, 6))), ("MultiLineString", [1, 3, 5], [2, 4, 6], None, [1, 3], [1, 2])),
        "polygons": (wkb(order, 6, c(2) + wkb(order, 3, c(2) + ring + hole) + wkb(order, 3, c(1) + ring)), ("MultiPolygon", [0, 9, 9, 0, 1, 2, 2, 1, 0, 9, 9, 0], [0, 0, 9, 0, 1, 1, 2, 1, 0, 0, 9, 0], None, [4, 8, 12], [2, 3])),
        "collection": (wkb(order, 7, c(2) + wkb(order, 1, n(1, 2)) + wkb(order, 2, c(2) + n(3, 4, 5, 6))), ("GeometryCollection", [1, 3, 5], [2, 4, 6], None, [1, 3], [1, 2])),
    }
    for name, (blob, want) in cases.items():
        got = geometry.geometry(blob)
        assert (got[0], list(got[1]), list(got[2]), None if got[3] is None else list(got[3]), *got[4:6]) == want and got[7] is None, name
        if "m" not in name.split()[-1] and name not in ("high bit z", "empty point", "collection"):
            points = np.array([got[1], got[2]] + ([got[3]] if got[3] is not None else [])).T
            assert geometry.to_wkb(got[0], points, got[4], got[5], order) == blob, name


@pytest.mark.parametrize("order", ["<", ">"])
def test_headers_and_envelopes(order):
    for code, doubles in geometry.ENVELOPES.items():
        blob = b"GP\0" + bytes([(order == "<") | code << 1]) + struct.pack(order + "i", 4326) + numbers(order, *range(doubles)) + wkb(">", 1, numbers(">", 7, 8))
        got = geometry.geometry(blob)
        assert (got[0], got[1][0], got[2][0], got[6], got[7]) == ("Point", 7, 8, 4326, None)


def test_damaged_blobs_are_named():
    line = wkb("<", 2, count("<", 3) + numbers("<", 1, 2, 3, 4))
    cases = {b"": "early", b"GP\0": "early", b"GP\0\x0f" + bytes(8): "envelope", line: "early", wkb("<", 99, b""): "unsupported", b"\x07" + line[1:]: "byte order", wkb("<", 2, count("<", 1 << 31)): "early"}
    for blob, word in cases.items():
        got = geometry.geometry(blob)
        assert got[0] == "GeometryCollection" and word in got[7] and len(got[1]) == 0


def test_points_of_one_form_are_read_at_once():
    blobs = [geometry.to_wkb("Point", np.array([[k, -k, k / 2]]), [1], [1], ">", srs=5) for k in range(50)]
    fast = geometry._points(blobs)
    assert fast is not None
    slow = [geometry.geometry(b) for b in blobs]
    assert [c.to_pylist() for c in fast] == [pa.array([r[k] for r in slow], t).to_pylist() for k, t in enumerate(geometry._TYPES)]
    assert geometry._points([*blobs, None]) is None and geometry._points([blobs[0], blobs[1][:-8]]) is None


def package(path, rows):
    with sqlite3.connect(path) as db:
        db.execute("CREATE TABLE gpkg_spatial_ref_sys (srs_name TEXT, srs_id INTEGER, organization TEXT, organization_coordsys_id INTEGER, definition TEXT)")
        db.execute("INSERT INTO gpkg_spatial_ref_sys VALUES ('x', 2263, 'EPSG', 2263, 'undefined'), ('y', -1, 'NONE', -1, 'local grid')")
        db.execute("CREATE TABLE gpkg_geometry_columns (table_name TEXT, column_name TEXT, geometry_type_name TEXT, srs_id INTEGER)")
        db.execute("INSERT INTO gpkg_geometry_columns VALUES ('man\"holes', 'geom', 'GEOMETRY', 2263), ('empty', 'g', 'POINT', -1)")
        db.execute('CREATE TABLE "man""holes" (fid INTEGER PRIMARY KEY, geom BLOB, name TEXT, depth REAL, photo BLOB)')
        db.execute("CREATE TABLE empty (fid INTEGER PRIMARY KEY, g BLOB)")
        db.executemany('INSERT INTO "man""holes" VALUES (?, ?, ?, ?, ?)', rows)


def test_layers_and_ranges_of_row_ids(spark, tmp_path):
    path = str(tmp_path / "a.gpkg")
    point = lambda k: geometry.to_wkb("Point", np.array([[k, 2.0 * k]]), [1], [1], "<", srs=2263)
    rows = [(k, point(k), f"é{k}", k / 4, None) for k in range(1, 300)] + [(1000, None, "none", None, b"\x01"), (1001, b"GP\0\x01", "bad", 1.0, None)]
    package(path, rows)
    assert [tuple(r) for r in geometry.gpkg_layers(spark, path).collect()] == [("empty", "g", -1, "local grid", "POINT"), ('man"holes', "geom", 2263, "EPSG:2263", "GEOMETRY")]
    spark.dataSource.register(geometry.GeoPackageSource)
    read = spark.read.format("gpkg").option("layer", 'man"holes').option("rowsPerPartition", 70).load(path)
    assert read.rdd.getNumPartitions() == 15
    got = {r.fid: r for r in read.collect()}
    assert len(got) == 301 and all(got[k].xs == [k] and got[k].ys == [2 * k] and got[k].srs_id == 2263 and json.loads(got[k].properties)["name"] == f"é{k}" for k in range(1, 300))
    assert got[1000].kind is None and json.loads(got[1000].properties) == {"depth": None, "fid": 1000, "name": "none", "photo": {"__type__": "binary", "base64": "AQ=="}}
    assert got[1001].fault and got[1001].kind == "GeometryCollection"
    assert spark.read.format("gpkg").option("layer", "empty").load(path).count() == 0


def record(code, body):
    return struct.pack("<i", code) + body


def poly(code, parts, points, zs=None):
    xy = b"".join(struct.pack("<2d", *p) for p in points)
    body = struct.pack("<4d", 0, 0, 0, 0) + struct.pack("<2i", len(parts), len(points)) + struct.pack(f"<{len(parts)}i", *parts) + xy
    if zs:
        body += struct.pack("<2d", min(zs), max(zs)) + struct.pack(f"<{len(zs)}d", *zs)
    return record(code, body)


def write(stem, contents, attributes, encoding="latin-1", gap=0):
    shp, shx, at = b"", b"", 50
    for k, c in enumerate(contents):
        shx += struct.pack(">2i", at, len(c) // 2)
        shp += struct.pack(">2i", k + 1, len(c) // 2) + c + bytes(gap)
        at += (8 + len(c) + gap) // 2
    head = lambda n: struct.pack(">7i", 9994, 0, 0, 0, 0, 0, n) + struct.pack("<2i", 1000, 5) + bytes(64)
    (stem.parent / (stem.name + ".shp")).write_bytes(head(50 + len(shp) // 2) + shp)
    (stem.parent / (stem.name + ".shx")).write_bytes(head(50 + len(shx) // 2) + shx)
    fields = [("NAME", b"C", 8, 0), ("N", b"N", 5, 0), ("D", b"N", 7, 2), ("OK", b"L", 1, 0), ("DAY", b"D", 8, 0)]
    described = b"".join(n.encode().ljust(11, b"\0") + t + bytes(4) + bytes([size, d]) + bytes(14) for n, t, size, d in fields) + b"\r"
    width = 1 + sum(f[2] for f in fields)
    lines = b"".join((b"*" if a is None else b" ") + b"".join(v.encode(encoding).ljust(f[2]) for v, f in zip(a or ["", "", "", "", ""], fields)) for a in attributes)
    (stem.parent / (stem.name + ".dbf")).write_bytes(bytes([3, 24, 1, 1]) + struct.pack("<IHH", len(attributes), 32 + len(described), width) + bytes(20) + described + lines)
    (stem.parent / (stem.name + ".cpg")).write_text("1252")


OUTER, HOLE, FAR = [(0, 0), (0, 9), (9, 9), (9, 0), (0, 0)], [(1, 1), (2, 1), (2, 2), (1, 1)], [(20, 20), (20, 29), (29, 29), (20, 20)]


def test_shapes_attributes_and_code_page(spark, tmp_path):
    contents = [
        record(1, struct.pack("<2d", 3, 4)), record(11, struct.pack("<4d", 3, 4, 5, 0)), poly(3, [0, 2], [(0, 0), (1, 1), (5, 5), (6, 6)]), poly(5, [0, 5, 9], OUTER + FAR + HOLE), record(0, b""),
        record(8, struct.pack("<4d", 0, 0, 0, 0) + struct.pack("<i", 2) + struct.pack("<4d", 1, 2, 3, 4)), poly(13, [0], [(0, 0), (1, 1)], [7.0, 8.0]), record(31, bytes(40)), poly(3, [0], [(0, 0)] * 2)[:50] + bytes(2),
    ]
    attributes = [["Stra\xdfe", "12", "3.50", "T", "20240501"], ["", "", "***", "?", "00000000"], None] + [["x", "-1", "2", "f", "20231231"]] * 5
    write(tmp_path / "s", contents, attributes)
    spark.dataSource.register(shapefile.ShapefileSource)
    rows = {r.record: r for r in spark.read.format("shapefile").load(str(tmp_path / "s.shp")).collect()}
    told = lambda k: (rows[k].kind, rows[k].xs, rows[k].zs, rows[k].rings, rows[k].parts)
    assert told(0) == ("Point", [3], None, [1], [1]) and told(1) == ("Point", [3], [5], [1], [1])
    assert told(2) == ("MultiLineString", [0, 1, 5, 6], None, [2, 4], [1, 2])
    assert told(3) == ("MultiPolygon", [0, 0, 9, 9, 0, 1, 2, 2, 1, 20, 20, 29, 20], None, [5, 9, 13], [2, 3])
    assert told(4) == (None, None, None, None, None) and told(5)[0] == "MultiPoint" and told(6) == ("LineString", [0, 1], [7, 8], [2], [1])
    assert "unsupported" in rows[7].fault and rows[8].fault and rows[8].kind == "GeometryCollection"
    assert json.loads(rows[0].properties) == {"NAME": "Stra\xdfe", "N": 12, "D": 3.5, "OK": True, "DAY": {"__type__": "date", "value": "2024-05-01"}}
    assert set(json.loads(rows[1].properties).values()) == {"", None} and set(json.loads(rows[2].properties).values()) == {None} and set(json.loads(rows[8].properties).values()) == {None}


@pytest.mark.parametrize("gap", [0, 4000])
def test_ranges_of_records(spark, tmp_path, gap):
    n = 500
    write(tmp_path / "r", [record(1, struct.pack("<2d", k, -k)) for k in range(n)], [[f"p{k}", str(k), "", "", ""] for k in range(n)], gap=gap)
    spark.dataSource.register(shapefile.ShapefileSource)
    read = spark.read.format("shapefile").option("rowsPerPartition", 60).load(str(tmp_path / "r"))
    assert read.rdd.getNumPartitions() == 9
    assert sorted((r.record, r.xs[0], json.loads(r.properties)["N"]) for r in read.collect()) == [(k, float(k), k) for k in range(n)]
