"""Helpers for tasks that work on Arrow batches."""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def fold(doc_id: str | Column, modulus: int) -> Column:
    """crc32 of the decimal text of ``doc_id``, modulo ``modulus``; -1 for a null id."""
    column = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(column.cast("string").cast("binary")) % modulus, F.lit(-1)).cast("int")


def frugal(run):
    """A batch function that gives Arrow's unused memory back when its task ends; workers live on for other stages."""

    def bounded(batches):
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()

    return bounded


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and the n+1 offsets of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null("").cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    body = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return body, offsets


def parts(lengths: Iterable[int], most: int) -> Iterator[tuple[int, int]]:
    """Runs ``[a, b)`` of consecutive rows whose lengths add up to ``most`` at most (or are one row)."""
    start = total = end = 0
    for end, n in enumerate(lengths, 1):
        if total + n > most and end - 1 > start:
            yield start, end - 1
            start, total = end - 1, 0
        total += n
    if end > start:
        yield start, end


def crc(ids: np.ndarray) -> int:
    """crc32 of ids as unsigned little-endian 32-bit numbers."""
    return zlib.crc32(np.ascontiguousarray(ids, dtype="<u4").tobytes())
