from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from plumbline.functions import ids
from plumbline.operators import keyed, records
from plumbline.plans.registry import QUERIES

POINT = "point_id string, seq int, northing double, easting double, elevation double, code string"


def test_first_point_wins_and_others_are_issues(spark):
    rows = [("1", 1, 0.0, 0.0, None, "MH"), ("1", 2, 0.0, 0.0, None, " mh "), ("1", 3, 0.0, 0.1, None, "MH"), ("2", 4, None, 0.0, 1.0, None), ("2", 5, None, 0.0, 1.0, "")]
    frame = spark.createDataFrame(rows, POINT)
    assert sorted((r.point_id, r.seq) for r in records.merged_points(frame).collect()) == [("1", 1), ("2", 4)]
    assert [tuple(r) for r in records.merge_issues(frame).collect()] == [("1", 3, 1)]
    assert records.merged_points(frame.limit(0)).count() == records.merge_issues(frame.limit(0)).count() == 0


def test_users_of_one_point_differ_as_the_sql_says(spark, tmp_path):
    rows = [(0, 5), (12, 905), (24, 905), (13, 905), (36, 1805)]
    spark.createDataFrame(rows, "event_id long, user_id long").write.parquet(f"{tmp_path}/events.parquet")
    assert [tuple(r) for r in QUERIES["d23_merge_issues"](spark, str(tmp_path)).collect()] == [(5, 13, 0)]


def test_overlay_and_changes(spark):
    rows = [("1", 0.0, 0.0, "A", "m"), ("2", float("nan"), 0.0, "A", "m"), ("3", 0.0, 0.0, None, "m"), ("4", 0.0, None, "A", "m"), ("5", 0.0, 0.0, "A", "ft")]
    frame = spark.createDataFrame(rows, "point_id string, northing double, easting double, crs string, horizontal_units string")
    assert [r.point_id for r in records.overlay_points(frame, "A", "m").collect()] == ["1"]
    assert tuple(records.overlay_excluded(frame, "A", "m").first()) == (1, 4)
    other = spark.createDataFrame([("1",), ("9",), (None,)], "point_id string")
    assert {tuple(r) for r in records.id_changes(frame, other).collect()} == {("2", "removed"), ("3", "removed"), ("4", "removed"), ("5", "removed"), ("9", "added")}


def test_events_are_carried_on_from_their_tail(spark):
    events = spark.createDataFrame([("a", 2, "x", 1), ("a", 1, "y", None), ("b", 1, "z", 3), (None, 1, "n", 1)], "chain string, place int, action string, extra int")
    none = spark.createDataFrame([], "chain string, seq long, event_hash string")
    first = records.append_events(none, events, "chain", "place", "action", "extra")
    tails = first.where("chain is not null").groupBy("chain").agg(F.max("seq").alias("seq"), F.max_by("event_hash", "seq").alias("event_hash"))
    more = records.append_events(tails, spark.createDataFrame([("a", 9, "w", 5)], events.schema), "chain", "place", "action", "extra")
    rows = first.unionByName(more)
    assert sorted((r.chain, r.seq, r.action) for r in rows.where("chain is not null").collect()) == [("a", 1, "y"), ("a", 2, "x"), ("a", 3, "w"), ("b", 1, "z")]
    assert {r.chain: (r.n_events, r.broken_at) for r in keyed.verify_chain(rows.where("chain is not null"), "chain", "seq", "action", "extra").collect()} == {"a": (3, None), "b": (1, None)}


def test_returns_selections_and_attachments(spark):
    keys = "request_id int, control_id string, point_id string"
    want = spark.createDataFrame([(1, "7", "7D"), (1, "7", "7E"), (2, "8", "8D"), (3, "9", "9D")], keys)
    came = spark.createDataFrame([(1, "7", "7d"), (1, "7", " 7E"), (1, "7", "other"), (2, "X", "8D"), (3, "9", "9D"), (3, "9", "9d")], keys)
    assert {r.request_id: (r.status, r.ignored) for r in records.return_faults(want, came).collect()} == {1: ("COMPLETE", 1), 2: ("OTHER_CONTROL", 0), 3: ("INCOMPLETE", 0)}
    points = spark.createDataFrame([("a", 0.0, 0.0, 1.0), ("b", 3.0, 0.0, 2.0), ("c", 0.0, 3.0, 3.0), ("d", 0.0, 0.0, None), ("e", 0.0, 0.0, 1.0), ("e", 0.0, 0.0, 1.0)], "point_id string, northing double, easting double, elevation double")
    chosen = spark.createDataFrame([(1, "a", "b", "c"), (2, "a", "b", "a"), (3, "a", "b", "d"), (4, "a", "b", "e"), (5, "a", "b", None)], "selection_id int, point_a string, point_b string, point_c string")
    out = {r.selection_id: (r.status, r.mean_n, r.mean_z) for r in records.manual_selections(points, chosen).collect()}
    assert out == {1: ("OK", 1.0, 2.0), **{k: ("INVALID", None, None) for k in (2, 3, 4, 5)}}
    files = "object_id int, sha256 string, path string"
    got = records.attach_once(spark.createDataFrame([(1, "x", "old")], files), spark.createDataFrame([(1, "x", "p"), (1, "y", "q"), (1, "y", "a"), (2, "x", "p")], files))
    assert {tuple(r) for r in got.collect()} == {(1, "y", "a"), (2, "x", "p")}
    kept = records.replace_by_source(spark.createDataFrame([(1, "x", "old"), (2, "z", "old")], files), spark.createDataFrame([(9, "x", "new")], files), "sha256")
    assert {tuple(r) for r in kept.collect()} == {(9, "x", "new"), (2, "z", "old")}


@pytest.mark.parametrize("name, key", [("Job 1234 Survey Points.csv", "job 1234"), ("/a/b/Smith_FieldBook_page_12.pdf", "smith"), ("p photo 12 77.jpg", "77"), ("page 12345.png", "12345"), (".hidden", "hidden"), ("", "")])
def test_job_keys(spark, name, key):
    assert spark.range(1).select(ids.job_key(F.lit(name)).alias("k")).first().k == key


def test_pipe_rows(spark):
    rows = spark.createDataFrame([("a", [(1.0, "PVC"), (2.0, None)]), ("b", []), ("c", None)], "point_id string, pipes array<struct<dip:double,material:string>>")
    assert [tuple(r) for r in records.pipe_rows(rows).collect()] == [("a", 1, 1.0, "PVC"), ("a", 2, 2.0, None)]


def test_a_refresh_that_brings_nothing_takes_rows_and_children(spark):
    current = spark.createDataFrame([(1, "fieldbook", "a"), (2, "manual", "b"), (3, None, "c"), (4, "gis", "d")], "id int, source string, value string")
    none, names = current.limit(0), spark.createDataFrame([("fieldbook",), ("absent",)], "source string")
    assert sorted(r.id for r in records.replace_by_source(current, none, refreshed=names).collect()) == [2, 3, 4]
    assert sorted(r.id for r in records.replace_by_source(current, none).collect()) == [1, 2, 3, 4]
    pipes = spark.createDataFrame([(1, 1, "PVC"), (1, 2, "RCP"), (2, 1, "DIP"), (9, 1, "CMP")], "id int, pipe_index int, material string")
    fresh = spark.createDataFrame([(7, 1, "HDPE")], pipes.schema)
    assert sorted((r.id, r.pipe_index) for r in records.replace_children(pipes, current, fresh, names, "id").collect()) == [(2, 1), (7, 1), (9, 1)]


def test_a_returned_shot_without_control_is_refused(spark):
    schema = "request_id int, control_id string, point_id string"
    want = spark.createDataFrame([(1, "CP1", "10A"), (1, "CP1", "10B"), (2, "CP2", "20A"), (3, "CP3", "30A")], schema)
    came = spark.createDataFrame([(1, "cp1", "10a"), (1, None, "10B"), (2, "  ", "20A"), (3, "CP3 ", " 30a"), (3, None, "31A")], schema)
    assert {r.request_id: (r.status, r.other_control, r.ignored) for r in records.return_faults(want, came).collect()} == {1: ("OTHER_CONTROL", 1, 0), 2: ("OTHER_CONTROL", 1, 0), 3: ("COMPLETE", 0, 1)}


def test_every_call_attaches_and_equal_files_are_stored_once(spark):
    files = spark.createDataFrame([(1, "x", "p"), (1, "y", "q"), (1, "y", "a"), (2, "x", "p"), (1, "y", "a")], "object_id int, sha256 string, path string")
    kept = spark.createDataFrame([(1, "x", "stored/x"), (1, "x", "later/x")], "object_id int, sha256 string, stored_path string")
    got = sorted((r.object_id, r.sha256, r.path, r.stored_path, r.copied) for r in records.attachments(kept, files).collect())
    assert got == [(1, "x", "p", "later/x", False), (1, "y", "a", "a", True), (1, "y", "a", "a", True), (1, "y", "q", "a", False), (2, "x", "p", "p", True)]


def test_manual_selections_with_tolerances(spark):
    points = spark.createDataFrame([("a", 0.0, 0.0, 1.0), ("b", 0.3, 0.0, 1.0), ("c", 0.0, 0.3, 1.3), ("d", 9.0, 0.0, 1.0), ("e", 0.0, 0.0, None), ("b2", 0.0, 0.0, 1.0), ("b2", 0.0, 0.0, 1.0)], "point_id string, northing double, easting double, elevation double")
    chosen = spark.createDataFrame([(1, "a", "b", "c"), (2, "a", "b", "d"), (3, "a", "b", "e"), (4, "a", "b", "b2"), (5, "a", "a", "b"), (6, "a", "b", "gone")], "selection_id int, point_a string, point_b string, point_c string")
    got = {r.selection_id: (r.status, None if r.max_v is None else round(r.max_v, 6)) for r in records.manual_selections(points, chosen, 0.25, 0.21).collect()}
    assert got == {1: ("PASS", 0.2), 2: ("REVIEW", 0.0), 3: ("INVALID", None), 4: ("INVALID", None), 5: ("INVALID", None), 6: ("INVALID", None)}
    tight = {r.selection_id: r.status for r in records.manual_selections(points, chosen, 0.25, 0.15).collect()}
    assert tight[1] == "REVIEW"
    with pytest.raises(ValueError):
        records.manual_selections(points, chosen, 0.25)
