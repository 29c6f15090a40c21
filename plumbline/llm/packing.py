"""Packing: bounded-space online best fit with a fixed number of open windows in each partition."""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.arrow import crc, frugal
from plumbline.llm.tokens import encode, vocabulary_paths
from plumbline.storage import materialise

CAPACITY = 1024
OPEN_WINDOWS = 64
#: Partitions whose last windows are merged together.
FAN_IN = 256
END = 0
_ROWS = 1 << 14
_LOCAL_BITS = 36
_MERGED = 1 << 62


class Packer:
    """Places token arrays in windows; holds at most ``windows`` open ones.

    A piece goes to the open window with the least sufficient room.  If none
    has room and a window may be opened, it is; else the fullest window is
    filled up with a cut of the piece and emitted, and the rest is placed
    again.  Full windows are emitted at once.
    """

    def __init__(self, emit, first_id: int, capacity: int = CAPACITY, windows: int = OPEN_WINDOWS):
        self.emit, self.next_id, self.capacity, self.windows = emit, first_id, capacity, windows
        self.room: list[tuple[int, int]] = []
        self.open: dict[int, list] = {}

    def add(self, doc, start: int, ids: np.ndarray, total: int) -> None:
        """Place ``ids``, which are the document's ids from ``start`` on."""
        while len(ids) >= self.capacity:
            self._put(self._new(), doc, start, ids[: self.capacity], total)
            start, ids = start + self.capacity, ids[self.capacity :]
        while len(ids):
            at = bisect_left(self.room, (len(ids), -1))
            if at < len(self.room):
                room, window = self.room.pop(at)
            elif len(self.room) < self.windows:
                room, window = self.capacity, self._new()
            else:
                room, window = self.room.pop(0)
            now, ids_left = ids[:room], ids[room:]
            self._put(window, doc, start, now, total)
            if room > len(now):
                insort(self.room, (room - len(now), window))
            start, ids = start + len(now), ids_left

    def _new(self) -> int:
        self.next_id += 1
        self.open[self.next_id - 1] = []
        return self.next_id - 1

    def _put(self, window: int, doc, start: int, ids: np.ndarray, total: int) -> None:
        pieces = self.open[window]
        offset = pieces[-1][4] + len(pieces[-1][2]) if pieces else 0
        pieces.append((doc, start, ids, total, offset))
        if offset + len(ids) == self.capacity:
            self.emit(window, self.open.pop(window), True)

    def close(self) -> None:
        """Merge what is still open, fullest first, into full windows and at most one that stays open."""
        left = [self.open[w] for _, w in self.room]
        self.room, self.open = [], {}
        for pieces in left:
            for doc, start, ids, total, _ in pieces:
                self.append(doc, start, ids, total)
        self.emit_open()

    def emit_open(self) -> None:
        """Emit the windows that are not full."""
        for window, pieces in self.open.items():
            self.emit(window, pieces, False)
        self.open = {}

    def append(self, doc, start: int, ids: np.ndarray, total: int) -> None:
        """Place ``ids`` at the end of the one open window, cutting where it is full."""
        while len(ids):
            window, room = next(((w, self.capacity - p[-1][4] - len(p[-1][2])) for w, p in self.open.items() if p), (None, self.capacity))
            if window is None:
                window = self._new()
            self._put(window, doc, start, ids[:room], total)
            start, ids = start + len(ids[:room]), ids[room:]


class _Rows:
    """Piece rows as Arrow batches."""

    def __init__(self, id_type: pa.DataType):
        self.id_type, self.columns = id_type, [[] for _ in range(8)]

    def add(self, window: int, pieces, closed: bool) -> None:
        doc_ids, start, length, crcs, total, seq, offset, left = self.columns
        for doc, s, ids, n, at in pieces:
            doc_ids.append(doc)
            start.append(s)
            length.append(len(ids))
            crcs.append(crc(ids))
            total.append(n)
            seq.append(window)
            offset.append(at)
            left.append(None if closed else np.ascontiguousarray(ids, "<u4").tobytes())

    def __len__(self) -> int:
        return len(self.columns[0])

    def take(self) -> pa.RecordBatch:
        kinds = [self.id_type, *[pa.int64()] * 6, pa.binary()]
        batch = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(self.columns, kinds)], _NAMES)
        self.columns = [[] for _ in range(8)]
        return batch


_NAMES = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "left"]
_SCHEMA = "doc_id {}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, left binary"


def pack(docs: DataFrame, paths: tuple[str, str] | None = None, capacity: int = CAPACITY, windows: int = OPEN_WINDOWS) -> DataFrame:
    """Pack all rows of ``docs`` into sequences of ``capacity`` tokens and return one row per piece.

    Columns: doc_id, start and length of the piece in its document's ids,
    ids_crc32, doc_tokens (with the closing id 0), sequence_id and the piece's
    offset there.  A null or empty text is one closing id; a null or repeated
    doc_id packs like any other; an empty table gives an empty result; other
    columns are not read.

    A task holds one document, ``windows`` open windows and one output batch.
    Its last window (under ``capacity`` tokens) is merged with those of
    FAN_IN - 1 other partitions, so padding is left only in one sequence for
    every FAN_IN partitions.
    """
    paths = paths or vocabulary_paths()
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        part = TaskContext.get().partitionId()
        rows, packer = None, None
        for batch in batches:
            if packer is None:
                rows = _Rows(batch.schema.field(0).type)
                packer = Packer(rows.add, part << _LOCAL_BITS, capacity, windows)
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = np.append(encode(text.as_py() or "", paths), np.uint32(END))
                packer.add(doc, 0, ids, len(ids))
                if len(rows) >= _ROWS:
                    yield rows.take()
        if packer is not None:
            packer.close()
            yield rows.take()

    placed = materialise(docs.select("doc_id", "text").mapInArrow(frugal(run), _SCHEMA.format(kind)), "pieces")
    done = placed.where("left is null").drop("left")
    group = F.shiftright("sequence_id", _LOCAL_BITS + FAN_IN.bit_length() - 1)
    merged = placed.where("left is not null").withColumn("part_group", group).groupBy("part_group").applyInArrow(_merger(capacity), _SCHEMA.format(kind)).drop("left")
    return done.unionByName(merged)


def _merger(capacity: int):
    def merge(key, table):
        rows = _Rows(table.schema.field("doc_id").type)
        packer = Packer(rows.add, _MERGED | key[0].as_py() << _LOCAL_BITS, capacity, 1)
        table = table.sort_by([("sequence_id", "ascending"), ("offset", "ascending")])
        for doc, start, total, left in zip(*[table.column(c).to_pylist() for c in ("doc_id", "start", "doc_tokens", "left")]):
            packer.append(doc, start, np.frombuffer(left, "<u4"), total)
        packer.emit_open()
        return pa.Table.from_batches([rows.take()])

    return merge
