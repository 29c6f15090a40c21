"""Live operators as Structured Streaming queries."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def deduplicated(events: DataFrame, key: str, time: str, delay: str = "1 hour") -> DataFrame:
    """The first event of each key; state older than ``delay`` behind the newest event is let go."""
    return events.withWatermark(time, delay).dropDuplicatesWithinWatermark([key])


def session_counts(events: DataFrame, key: str, time: str, gap: str, delay: str = "1 hour") -> DataFrame:
    """Sessions of each key, parted by ``gap``: begin, end and number of events."""
    s = F.session_window(time, gap)
    grouped = events.withWatermark(time, delay).groupBy(key, s.alias("session")).agg(F.count(F.lit(1)).alias("n"))
    return grouped.select(key, F.col("session.start").alias("begins"), F.col("session.end").alias("ends"), "n")


def windowed_values(events: DataFrame, time: str, width: str, slide: str, kind: str, value: str, delay: str = "1 hour") -> DataFrame:
    """Count and sum by sliding window and kind."""
    w = F.window(time, width, slide)
    grouped = events.withWatermark(time, delay).groupBy(w.alias("w"), kind).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"))
    return grouped.select(F.col("w.start").alias("begins"), kind, "n", "total")


_LEDGER = "page_id long, status string, attempts long, first_seq long"


def ledger(events: DataFrame) -> DataFrame:
    """Running state of each page from step events (page_id, seq, status): latest status, attempts, first sequence number.

    Events may come out of order within a trigger; one that is older than the
    state's newest changes nothing but the count of attempts.
    """

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        status, attempts, first, newest = state.get if state.exists else ("", 0, None, -1)
        for rows in batches:
            attempts += int((rows.status == "RUNNING").sum())
            first = int(rows.seq.min()) if first is None else min(first, int(rows.seq.min()))
            last = rows.loc[rows.seq.idxmax()]
            if int(last.seq) > newest:
                status, newest = str(last.status), int(last.seq)
        state.update((status, attempts, first, newest))
        yield pd.DataFrame([(key[0], status, attempts, first)], columns=["page_id", "status", "attempts", "first_seq"])

    state = "status string, attempts long, first_seq long, newest long"
    return events.groupBy("page_id").applyInPandasWithState(update, _LEDGER, state, "update", GroupStateTimeout.NoTimeout)
