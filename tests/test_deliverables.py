from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from plumbline.sources import deliverables as d

SCHEMA = "point_uuid string, point_id string, northing double, easting double, elevation double, description string, crs string, horizontal_units string, vertical_units string, source_id string"


def points(spark, rows):
    return spark.createDataFrame([(u, f"P{u}", 1.5, 2.5, z, text, "EPSG:2263", "meters", units, "s") for u, z, text, units in rows], SCHEMA)


ROWS = [("a", 10.0, "=SUM(A1)", "meters"), ("b", 20.0, 'said "x", y\nnext', "us_survey_feet"), ("c", None, " -5", "meters"), ("d", 40.0, "é", "fathoms")]


def test_parts_are_read_back_and_replaced(spark, tmp_path):
    rows = points(spark, ROWS).repartition(3)
    d.write_deliverable(rows, str(tmp_path), "accepted")
    got = {r.point_uuid: (r.elevation, r.description) for r in d.read_deliverable(spark, str(tmp_path), "accepted").collect()}
    assert got == {"a": (10.0, "'=SUM(A1)"), "b": (20.0, 'said "x", y\nnext'), "c": (None, "' -5"), "d": (40.0, "é")}
    d.write_deliverable(points(spark, [("z", 1.0, "n", "meters")]), str(tmp_path), "accepted", "append")
    assert d.read_deliverable(spark, str(tmp_path), "accepted").count() == 5
    d.write_deliverable(points(spark, ROWS[:1]), str(tmp_path), "accepted")
    assert [r.point_uuid for r in d.read_deliverable(spark, str(tmp_path), "accepted").collect()] == ["a"]
    d.write_deliverable(rows.limit(0), str(tmp_path), "accepted")
    assert d.read_deliverable(spark, str(tmp_path), "accepted").count() == 0
    with pytest.raises(FileNotFoundError):
        d.read_deliverable(spark, str(tmp_path), "reshoot")


def test_a_failed_task_leaves_nothing_to_be_seen(spark, tmp_path):
    good = points(spark, ROWS)
    broken = spark.range(0, 4000, 1, 4).select(F.when(F.col("id") == 3999, F.raise_error(F.lit("lost"))).otherwise(F.col("id").cast("string")).alias("point_uuid"))
    with pytest.raises(Exception, match="lost"):
        d.write_deliverable(broken, str(tmp_path), "table")
    assert d.manifest(str(tmp_path), "table") is None
    d.write_deliverable(good, str(tmp_path), "table")
    with pytest.raises(Exception, match="lost"):
        d.write_deliverable(broken, str(tmp_path), "table")
    assert d.read_deliverable(spark, str(tmp_path), "table").count() == 4


def test_cut_off_manifests_and_damaged_parts(spark, tmp_path):
    d.write_deliverable(points(spark, ROWS).coalesce(1), str(tmp_path), "table")
    (tmp_path / "table.manifest-000002.json").write_text('{"deliverable": "ta')
    assert d.manifest(str(tmp_path), "table")["number"] == 1
    d.write_deliverable(points(spark, ROWS[:2]).coalesce(1), str(tmp_path), "table")
    told = d.manifest(str(tmp_path), "table")
    assert told["number"] == 3 and sum(p["rows"] for p in told["parts"]) == 2
    file = tmp_path / told["parts"][0]["file"]
    file.write_bytes(file.read_bytes()[:-3])
    with pytest.raises(ValueError, match="whole"):
        d.read_deliverable(spark, str(tmp_path), "table")
    assert json.loads((tmp_path / "table.manifest-000003.json").read_text())["columns"] == list(d.COLUMNS)


def changed(spark, rows):
    return spark.createDataFrame(rows, "point_uuid string, offset double")


def test_corrections_fall_once(spark):
    table = points(spark, ROWS)
    copy, evidence = d.corrected_points(table, changed(spark, [("a", -0.5), ("b", 2.0)]))
    assert {r.point_uuid: r.elevation for r in copy.collect()} == {"a": 9.5, "b": 22.0, "c": None, "d": 40.0}
    assert sorted((r.point_uuid, r.elevation, r.offset, r.corrected_elevation) for r in evidence.collect()) == [("a", 10.0, -0.5, 9.5), ("b", 20.0, 2.0, 22.0)]
    assert {r.point_uuid: r.elevation for r in table.collect()}["a"] == 10.0
    assert d.corrected_points(table, changed(spark, []))[0].count() == 4


@pytest.mark.parametrize("rows, word", [([("a", 1.0), ("a", 1.0)], "once"), ([("x", 1.0)], "existing"), ([("c", 1.0)], "finite elevation"), ([("d", 1.0)], "units"), ([("a", float("inf"))], "finite"), ([("a", None)], "finite")])
def test_faulty_corrections_fail_whole(spark, tmp_path, rows, word):
    for part in d.corrected_points(points(spark, ROWS), changed(spark, [("b", 1.0), *rows])):
        with pytest.raises(Exception, match=word):
            d.write_deliverable(part, str(tmp_path), "corrected")
        assert d.manifest(str(tmp_path), "corrected") is None
