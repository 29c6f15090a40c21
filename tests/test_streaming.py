from __future__ import annotations

from plumbline.streaming import live

SCHEMA = "page_id long, seq long, status string, ts timestamp"


def stream(spark, folder, batches):
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, "page_id long, seq long, status string, t string").selectExpr("page_id", "seq", "status", "cast(t as timestamp) ts").coalesce(1).write.mode("append").parquet(folder)
        del k
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(folder)


def finish(df, name, mode, tmp_path):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return df.sparkSession.table(name).collect()


ROWS = [[(1, 1, "RUNNING", "2024-01-01 00:00:00"), (2, 2, "RUNNING", "2024-01-01 00:01:00")], [(1, 3, "DONE", "2024-01-01 00:02:00"), (1, 3, "DONE", "2024-01-01 00:02:00")], [(2, 5, "DONE", "2024-01-01 02:00:00"), (2, 4, "RUNNING", "2024-01-01 01:50:00")]]


def test_deduplication(spark, tmp_path):
    df = live.deduplicated(stream(spark, str(tmp_path / "in"), ROWS), "seq", "ts")
    assert sorted(r.seq for r in finish(df, "dedup", "append", tmp_path)) == [1, 2, 3, 4, 5]


def test_ledger(spark, tmp_path):
    out = finish(live.ledger(stream(spark, str(tmp_path / "in"), ROWS)), "ledger", "update", tmp_path)
    last = {}
    for r in out:
        last[r.page_id] = (r.status, r.attempts, r.first_seq)
    assert last == {1: ("DONE", 1, 1), 2: ("DONE", 2, 2)}


def test_sessions(spark, tmp_path):
    rows = [*ROWS, [(9, 9, "X", "2024-01-02 00:00:00")]]
    out = finish(live.session_counts(stream(spark, str(tmp_path / "in"), rows), "page_id", "ts", "30 minutes"), "sessions", "append", tmp_path)
    assert sorted((r.page_id, r.n) for r in out) == [(1, 3), (2, 1), (2, 2)]
