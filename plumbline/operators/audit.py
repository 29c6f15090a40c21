"""Tamper-evident audit chains: events appended with canonical hashes, and their verification.

An event's hash covers its fields, its place in the chain and the hash before
it, so nothing can be changed, taken out or put in without breaking the chain.
"""

from __future__ import annotations

import hashlib
import json

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.storage import in_order

#: Version of the payload, hash before the first event, and fields of an event with what stands for a missing one.
VERSION, GENESIS = 1, "0" * 64
FIELDS = {"event_id": "", "ts_utc": "", "actor": "", "module": "", "action": "", "object_type": "", "object_id": "", "revision": 0, "details_json": "{}"}


def event_hash(chain_id, seq: int, previous: str | None, event: dict) -> str:
    """SHA-256 of the canonical JSON (sorted names, no blanks, characters as they are) of an event in its place."""
    payload = {k: (int(event.get(k) or 0) if default == 0 else str(event.get(k) or default)) for k, default in FIELDS.items()}
    payload |= {"hash_version": VERSION, "chain_id": str(chain_id), "seq": int(seq), "prev_hash": previous or GENESIS}
    return hashlib.sha256(json.dumps(payload, ensure_ascii=False, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def _columns(events: DataFrame) -> DataFrame:
    kinds = {k: "bigint" if default == 0 else "string" for k, default in FIELDS.items()}
    return events.select(F.col("chain_id").cast("string").alias("chain_id"), *[c for c in events.columns if c in ("seq", "prev_hash", "event_hash", "place")], *[F.col(k).cast(kinds[k]).alias(k) for k in FIELDS])


_KINDS = "chain_id string, " + ", ".join(f"{k} {'long' if d == 0 else 'string'}" for k, d in FIELDS.items()) + ", seq long, prev_hash string, event_hash string"


def append(tails: DataFrame, events: DataFrame) -> DataFrame:
    """New events (chain_id, place and FIELDS) with seq, prev_hash and event_hash, carried on from each chain's tail.

    ``tails`` has chain_id, seq and event_hash of the last event of every chain
    that has one.  Events go by ``place``, then event_id.  Each hash needs the
    one before, so a chain is folded by one task in a stream that holds one
    hash.
    """
    rows = _columns(events).join(tails.select(F.col("chain_id").cast("string").alias("chain_id"), F.col("seq").alias("_seq"), F.col("event_hash").alias("_hash")), "chain_id", "left")
    ordered = in_order(rows, "chain_id", "place", "event_id")

    def fold(batches):
        at, seq, last = None, 0, GENESIS
        for batch in batches:
            out: list[list] = [[], [], []]
            for row in batch.to_pylist():
                if at != (row["chain_id"],):
                    at, seq, last = (row["chain_id"],), row["_seq"] or 0, row["_hash"] or GENESIS
                before, seq = last, seq + 1
                last = event_hash(row["chain_id"], seq, before, row)
                for column, value in zip(out, (seq, before, last)):
                    column.append(value)
            kept = ["chain_id", *FIELDS]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in kept), pa.array(out[0], pa.int64()), pa.array(out[1], pa.string()), pa.array(out[2], pa.string())], [*kept, "seq", "prev_hash", "event_hash"])

    return ordered.mapInArrow(fold, _KINDS)


def tails(events: DataFrame) -> DataFrame:
    """Last seq and hash of every chain."""
    return events.groupBy("chain_id").agg(F.max("seq").alias("seq"), F.max_by("event_hash", "seq").alias("event_hash"))


def verify(events: DataFrame) -> DataFrame:
    """One row a chain: chain_id, n_events, last_hash, and broken_at, the first seq that doesn't follow or whose hashes don't fit (null if none).

    Rows are hashed on their own, in any order; a window over the narrow
    result checks that places and hashes follow each other from the genesis on.
    """

    def own(batches):
        for batch in batches:
            fits = [row["event_hash"] == event_hash(row["chain_id"], row["seq"], row["prev_hash"], row) if row["seq"] is not None else False for row in batch.to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("chain_id", "seq", "prev_hash", "event_hash")), pa.array(fits)], ["chain_id", "seq", "prev_hash", "event_hash", "fits"])

    checked = _columns(events).mapInArrow(own, "chain_id string, seq long, prev_hash string, event_hash string, fits boolean")
    w = Window.partitionBy("chain_id").orderBy("seq")
    before, place = F.coalesce(F.lag("event_hash").over(w), F.lit(GENESIS)), F.coalesce(F.lag("seq").over(w), F.lit(0)) + 1
    ok = F.coalesce(F.col("fits") & (F.col("prev_hash") == before) & (F.col("seq") == place), F.lit(False))
    linked = checked.select("chain_id", "seq", "event_hash", ok.alias("ok"))
    return linked.groupBy("chain_id").agg(F.count(F.lit(1)).alias("n_events"), F.max_by("event_hash", "seq").alias("last_hash"), F.min(F.when(~F.col("ok"), F.coalesce("seq", F.lit(0)))).alias("broken_at"))
