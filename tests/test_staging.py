from __future__ import annotations

from plumbline.sources import tables


def test_the_first_line_of_an_id_counts(spark, tmp_path):
    path = tmp_path / "s.csv"
    path.write_text("Point,North,East,Elev\n5,9,9,1\n 5 ,1,1,2\n6,x,1,\n6,2,2,\n,3,3,\n7,4,4,z\n6,0,0,\n")
    got = [(r.point_id, r.northing, r.elevation, r.status) for r in tables.staged_points(spark, str(path)).orderBy("seq").collect()]
    assert got == [("5", 9.0, 1.0, "VALID"), ("5", 1.0, 2.0, "DUPLICATE"), ("6", None, None, "INVALID"), ("6", 2.0, None, "VALID"), (None, 3.0, None, "INVALID"), ("7", 4.0, None, "VALID"), ("6", 0.0, None, "DUPLICATE")]


def test_existing_ids_become_conflicts(spark, tmp_path):
    path = tmp_path / "s.csv"
    path.write_text("Point,North,East\n5,9,9\n6,1,1\n6,2,2\n7,4,4\nx,,\n")
    staged, existing = tables.staged_points(spark, str(path)), spark.createDataFrame([(7,), (9,)], "point_id int")
    assert sorted(r.point_id for r in tables.commit_staged(existing, staged).collect()) == ["5", "6"]
    assert {r.point_id: r["rows"] for r in tables.commit_conflicts(existing, staged).collect()} == {"6": 1, "7": 1}
    assert tuple(tables.commit_summary(existing, staged).first()) == (2, 2, 1, "COMMITTED_WITH_REVIEW")
    clean = staged.where("point_id = '5'")
    assert tuple(tables.commit_summary(existing, clean).first()) == (1, 0, 0, "COMMITTED")
    assert tuple(tables.commit_summary(existing, clean.limit(0)).first()) == (0, 0, 0, "COMMITTED")
