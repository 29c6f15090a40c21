from __future__ import annotations

import pytest

from plumbline.streaming import upserts

SCHEMA = "page string, point string, revision int, seq long, value string"


def log(spark, tmp_path, **more):
    return upserts.UpsertLog(spark, f"file://{tmp_path}/table", ["page", "point"], "revision", "seq", **more)


def rows(spark, values):
    return spark.createDataFrame(values, SCHEMA)


def content(t):
    return sorted((tuple(r) for r in t.table().collect()), key=repr)


A = [("p1", "7", 1, 1, "a"), ("p1", "8", 1, 2, "b"), (None, "7", 1, 3, "n"), ("p1", "7", 1, 4, "a2")]
B = [("p1", "7", 2, 5, "a3"), ("p2", "9", 2, 6, "c")]
C = [("p1", "7", 1, 9, "stale"), ("p2", "9", 2, 7, "c2"), ("p2", "9", 2, 7, "c2")]
WANT = sorted([("p1", "7", 2, 5, "a3"), ("p1", "8", 1, 2, "b"), (None, "7", 1, 3, "n"), ("p2", "9", 2, 7, "c2")], key=repr)


def test_batches_in_any_order_and_again_give_the_same_table(spark, tmp_path):
    for k, order in enumerate([(A, B, C), (C, A, B), (B, C, A)]):
        t = log(spark, tmp_path / str(k))
        assert t.table() is None
        for batch, values in enumerate(order):
            t.write(rows(spark, values), batch)
        t.write(rows(spark, order[1]), 1)
        t.write(rows(spark, order[0]), 0)
        assert content(t) == WANT


def test_a_lost_run_is_never_read(spark, tmp_path, monkeypatch):
    t = log(spark, tmp_path)
    t.write(rows(spark, A), 0)
    before = content(t)
    monkeypatch.setattr(t, "_put", lambda *_: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError):
        t.write(rows(spark, B), 1)
    monkeypatch.undo()
    assert content(t) == before and len(list((tmp_path / "table" / "data").iterdir())) == 2
    t.write(rows(spark, B), 1)
    t.write(rows(spark, C), 2)
    assert content(t) == WANT


def test_compaction_changes_nothing(spark, tmp_path):
    t = log(spark, tmp_path)
    t.write(rows(spark, A), 0)
    t.write(rows(spark, B), 1)
    t.compact()
    assert [c["kind"] for c in t.commits()] == ["base"]
    t.write(rows(spark, [("p1", "8", 9, 9, "again")]), 1)
    t.write(rows(spark, C), 2)
    assert content(t) == WANT and [c["kind"] for c in t.commits()] == ["base", "batch"]
    t.compact()
    t.compact()
    assert content(t) == WANT


def test_stale_against_the_table(spark, tmp_path):
    t = log(spark, tmp_path, stale="table")
    for k, values in enumerate((A, B, C)):
        t.write(rows(spark, values), k)
    assert content(t) == sorted([("p1", "7", 2, 5, "a3"), ("p2", "9", 2, 7, "c2")])
    new = upserts.published(t, rows(spark, [("p1", "7", 2, 1, "x"), ("p1", "8", 2, 1, "y"), (None, "7", 2, 1, "z")]))
    assert sorted(r.value for r in new.collect()) == ["y", "z"]
    with pytest.raises(ValueError):
        log(spark, tmp_path, stale="never")


def test_a_stream_that_restarts(spark, tmp_path):
    folder = str(tmp_path / "in")
    t = log(spark, tmp_path)

    def run(values):
        rows(spark, values).coalesce(1).write.mode("append").parquet(folder)
        events = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(folder)
        t.start(events, str(tmp_path / "cp"), compact_every=2, availableNow=True).awaitTermination(120)

    run(A)
    run(B)
    run(C)
    assert content(t) == WANT and any(c["kind"] == "base" for c in t.commits())


def gate(spark, tmp_path, batches, interval=60):
    folder = tmp_path / "events"
    for k, values in enumerate(batches):
        spark.createDataFrame(values, "project string, t string, body string").selectExpr("project", "cast(t as timestamp) at", "body").coalesce(1).write.parquet(str(folder / f"b{k}"))
    # One folder a batch, in order of their names.
    import os
    import time

    for k in range(len(batches)):
        for f in (folder / f"b{k}").glob("*.parquet"):
            os.utime(f, (time.time() - 100 + k, time.time() - 100 + k))
    events = spark.readStream.schema("project string, at timestamp, body string").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(folder))
    q = upserts.change_gate(events, "project", "at", "body", interval, "1 second").writeStream.format("memory").queryName("gate").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(180)
    return sorted((r.key, str(r.passed)[11:19], r.content, r.due) for r in spark.table("gate").collect())


def test_bursts_no_change_and_late_events(spark, tmp_path):
    day = "2024-05-01 "
    out = gate(spark, tmp_path, [
        [("a", day + "10:00:00", "one"), ("a", day + "10:00:10", "two"), ("a", day + "10:00:20", "three"), ("b", day + "10:00:00", "same")],
        [("a", day + "10:00:05", "late"), ("b", day + "10:02:00", "same"), ("b", day + "10:04:00", "same"), ("c", day + "10:04:00", "x"), ("c", day + "10:04:30", "y"), ("c", day + "10:04:40", "x")],
        [("b", day + "10:05:00", "other"), ("z", day + "11:00:00", "end")],
        [("z", day + "11:30:00", "end")],
    ])
    # a: the burst's last state passes when the interval ends.  b: only the change passes.  c: back to what it was, so nothing more.
    assert out == [("a", "10:00:00", "one", False), ("a", "10:00:20", "three", True), ("b", "10:00:00", "same", False), ("b", "10:05:00", "other", False), ("c", "10:04:00", "x", False), ("z", "11:00:00", "end", False)]
