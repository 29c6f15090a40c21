"""A keyed table that a stream keeps up to date, and a gate that lets changes through at intervals.

The table is a log: every batch writes the rows that it may change, once, into
a folder of its own, and one small commit names that folder.  Readers take the
newest row of each key from the committed folders, so a batch costs its own
rows and not the table's, a batch that runs again replaces its commit, and the
order in which rows arrive doesn't matter.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


class UpsertLog:
    """Rows by key under ``folder`` (any path that Spark reads), of which the one with the highest ``revision``, then ``sequence`` counts.

    ``key`` is a list of columns.  Ties of revision and sequence (an event
    that came twice) are equal rows or go by their JSON.  Null keys are a key
    like any other.  A row of a lower revision than the newest that the table
    knows is stale and ignored, with ``stale="table"`` whatever its key, with
    ``stale="key"`` only against its own key.
    """

    def __init__(self, spark: SparkSession, folder: str, key: list[str], revision: str, sequence: str, stale: str = "key"):
        if stale not in ("key", "table"):
            raise ValueError("stale is 'key' or 'table'")
        self.spark, self.folder, self.key, self.revision, self.sequence, self.stale = spark, folder.rstrip("/"), key, revision, sequence, stale

    def _fs(self, path: str):
        target = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return target, target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _put(self, path: str, text: str) -> None:
        target, fs = self._fs(path)
        out = fs.create(target, True)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()

    def commits(self) -> list[dict]:
        """Committed folders: those of batches that a base doesn't hold yet, and the newest base."""
        root, fs = self._fs(f"{self.folder}/log")
        if not fs.exists(root):
            return []
        found = []
        for status in fs.listStatus(root):
            with_name = status.getPath()
            stream = fs.open(with_name)
            try:
                text = bytes(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
            finally:
                stream.close()
            found.append(json.loads(text) | {"name": with_name.getName()})
        bases = [c for c in found if c["kind"] == "base"]
        base = max(bases, key=lambda c: c["upto"], default=None)
        upto = base["upto"] if base else -1
        return ([base] if base else []) + sorted((c for c in found if c["kind"] == "batch" and c["batch"] > upto), key=lambda c: c["batch"])

    def _newest(self, rows: DataFrame) -> DataFrame:
        """One row a key, by revision, sequence, then content; partial aggregation takes the heat out of hot keys."""
        others = [c for c in rows.columns if c not in self.key]
        whole = F.struct(*others)
        best = F.max_by(whole, F.struct(self.revision, self.sequence, F.to_json(whole)))
        named = rows.groupBy(*self.key).agg(best.alias("_row"))
        return named.select(*self.key, "_row.*").select(*rows.columns)

    def write(self, rows: DataFrame, batch_id: int) -> None:
        """Commit a batch.  What a lost run of it left is never read; a batch that a base already holds changes nothing."""
        base = next((c for c in self.commits() if c["kind"] == "base"), None)
        if base and batch_id <= base["upto"]:
            return
        data = f"{self.folder}/data/{batch_id:012d}-{uuid.uuid4().hex}"
        self._newest(rows).write.parquet(data)
        self._put(f"{self.folder}/log/batch-{batch_id:012d}.json", json.dumps({"kind": "batch", "batch": batch_id, "data": data, "schema": rows.schema.json()}))

    def table(self) -> DataFrame | None:
        """The table as of the last commit (None before the first)."""
        commits = self.commits()
        if not commits:
            return None
        from pyspark.sql.types import StructType

        schema = StructType.fromJson(json.loads(commits[-1]["schema"]))
        rows = self._newest(self.spark.read.schema(schema).parquet(*[c["data"] for c in commits]))
        if self.stale == "key":
            return rows
        newest = rows.agg(F.max(self.revision).alias("_newest"))
        return rows.join(F.broadcast(newest), F.col(self.revision).eqNullSafe(F.col("_newest"))).drop("_newest")

    def compact(self) -> None:
        """Write the table as one base; batches up to its last are then read from there.

        Run it where batches are written (between two of them).
        """
        commits = self.commits()
        if sum(c["kind"] == "batch" for c in commits) == 0:
            return
        upto = commits[-1]["batch"]
        rows = self.table()
        data = f"{self.folder}/data/base-{upto:012d}-{uuid.uuid4().hex}"
        rows.write.parquet(data)
        self._put(f"{self.folder}/log/base-{upto:012d}.json", json.dumps({"kind": "base", "upto": upto, "data": data, "schema": rows.schema.json()}))

    def start(self, events: DataFrame, checkpoint: str, compact_every: int | None = None, **trigger):
        """Start the stream that keeps the table; ``trigger`` as for ``DataStreamWriter.trigger``."""

        def put(rows: DataFrame, batch_id: int) -> None:
            self.write(rows, batch_id)
            if compact_every and batch_id % compact_every == compact_every - 1:
                self.compact()

        writer = events.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint)
        return (writer.trigger(**trigger) if trigger else writer).start()


def published(log: UpsertLog, live: DataFrame) -> DataFrame:
    """Rows of ``live`` that the table lacks: what a publication would add, keys compared null-safe."""
    known = log.table()
    if known is None:
        return live
    same = None
    for c in log.key:
        one = live[c].eqNullSafe(known[c])
        same = one if same is None else same & one
    return live.join(known.select(*log.key), same, "left_anti")


def change_gate(events: DataFrame, key: str, time: str, content: Callable | str, interval_seconds: int, delay: str = "1 minute") -> DataFrame:
    """Let a key's newest content through when it has changed and the interval since the last time is over.

    ``events`` is a stream; ``content`` a column with the state's text.  The
    first content of a key goes through at once.  Content that equals what
    went through last never does, whatever came between; a change inside the
    interval goes through when the interval ends by event time (the watermark,
    ``delay`` behind the newest event), without waiting for another event.
    Events older than the newest of their key are ignored.  Columns: key,
    passed (the event's time), content, due (whether the interval's end let
    it through).  One row of state a key.
    """
    if interval_seconds <= 0:
        raise ValueError("the interval is positive")
    rows = events.select(F.col(key).cast("string").alias("key"), F.col(time).alias("at"), F.coalesce(F.col(content).cast("string"), F.lit("")).alias("content")).withWatermark("at", delay)
    step = pd.Timedelta(seconds=interval_seconds)

    def update(group: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last_at, last, seen_at, seen = state.get if state.exists else (None, None, None, None)
        last_at, seen_at = (pd.Timestamp(v, unit="us") if v is not None else None for v in (last_at, seen_at))
        out = []

        def offer(at, text, due):
            nonlocal last_at, last
            if last_at is None or (at >= last_at + step and text != last):
                out.append((group[0], at if not due else seen_at, text, due))
                last_at, last = at, text

        if state.hasTimedOut:
            if last_at is not None and seen != last:
                offer(last_at + step, seen, True)
        else:
            for frame in batches:
                for at, text in frame.sort_values(["at", "content"])[["at", "content"]].itertuples(index=False):
                    if seen_at is not None and at < seen_at:
                        continue
                    if last_at is not None and seen != last and at >= last_at + step:
                        # The interval ended before this event; what was there then went through first.
                        offer(last_at + step, seen, True)
                    seen_at, seen = at, text
                    offer(at, text, False)
        micros = lambda v: None if v is None else int(v.value // 1000)
        state.update((micros(last_at), last, micros(seen_at), seen))
        if seen != last:
            state.setTimeoutTimestamp(max(int((last_at + step).value // 1_000_000), state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["key", "passed", "content", "due"])

    kept = "last_at long, last string, seen_at long, seen string"
    return rows.groupBy("key").applyInPandasWithState(update, "key string, passed timestamp, content string, due boolean", kept, "append", GroupStateTimeout.EventTimeTimeout)
