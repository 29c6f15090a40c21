"""Media columns: archives in the shared folder, read by a custom Spark data source.

A payload is stored as a PNG image (8-bit grey samples, 192 to a row, deflate:
lossless) in an archive file: members one after another, then a directory of
fixed-width entries, then a footer.  The data source plans partitions as byte
ranges of those directories, reads members in runs, checks each against its
checksum, and retries a member by its own offset when a check or read fails.
"""

from __future__ import annotations

import hashlib
import struct
import time
import zlib
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from plumbline.storage import arrow_files, fresh_path

ROW = 192
LEVEL = 1
ARCHIVE_BYTES = 128 << 20
RANGE_BYTES = 16 << 20
RUN_BYTES = 4 << 20
RETRIES = 4
_SIGNATURE = b"\x89PNG\r\n\x1a\n"
_FOOTER = struct.Struct("<8sQQQ")
_MAGIC = b"PLMEDIA1"
_SEAL = struct.Struct("<8sI")
#: Number of an archive of a task, start of its directory, and its members: what planning needs to know, in one manifest for each task.
LISTED = np.dtype([("number", "<u4"), ("start", "<u8"), ("count", "<u8")])
READERS = 32
#: doc_id, whether it is null, offset and size of the member, unpadded bytes, crc32 of the member.
ENTRY = np.dtype([("doc_id", "<i8"), ("no_id", "u1"), ("offset", "<u8"), ("size", "<u8"), ("n_bytes", "<u8"), ("crc", "<u4")])


def payload_of(text: str | None) -> tuple[bytes, int]:
    """UTF-8 bytes padded with spaces to a positive multiple of ROW, and their number before padding."""
    raw = (text or "").encode("utf-8", "replace")
    return raw.ljust(max(1, -(-len(raw) // ROW)) * ROW), len(raw)


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(body, zlib.crc32(kind)))


def to_png(payload: bytes) -> bytes:
    """A grey image with ROW samples to a row; rows are unfiltered."""
    samples = np.frombuffer(payload, np.uint8).reshape(-1, ROW)
    rows = np.zeros((len(samples), ROW + 1), np.uint8)
    rows[:, 1:] = samples
    head = struct.pack(">IIBBBBB", ROW, len(samples), 8, 0, 0, 0, 0)
    return _SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(rows.tobytes(), LEVEL)) + _chunk(b"IEND", b"")


def from_png(media: bytes) -> np.ndarray:
    """Samples (rows x ROW) of what ``to_png`` made; anything damaged raises ValueError."""
    if media[:8] != _SIGNATURE:
        raise ValueError("not a PNG image")
    at, body, shape = 8, [], None
    while at < len(media):
        (size,) = struct.unpack_from(">I", media, at)
        kind, data = media[at + 4 : at + 8], media[at + 8 : at + 8 + size]
        if zlib.crc32(data, zlib.crc32(kind)) != struct.unpack_from(">I", media, at + 8 + size)[0]:
            raise ValueError("a chunk's checksum differs")
        if kind == b"IHDR":
            shape = struct.unpack(">IIBBBBB", data)
        elif kind == b"IDAT":
            body.append(data)
        at += 12 + size
    if shape is None or shape[0] != ROW or shape[2:] != (8, 0, 0, 0, 0):
        raise ValueError("not an 8-bit grey image of the expected width")
    rows = np.frombuffer(zlib.decompress(b"".join(body)), np.uint8).reshape(shape[1], ROW + 1)
    if rows[:, 0].any():
        raise ValueError("filtered rows")
    return rows[:, 1:]


def feature(samples: np.ndarray) -> str:
    """Average hash over an 8 x 8 grid (16 hex digits), then mean and standard deviation of all samples."""
    h = len(samples)
    across = samples.reshape(h, 8, ROW // 8).sum(axis=2, dtype=np.int64)
    total = np.vstack([np.zeros((1, 8), np.int64), np.cumsum(across, axis=0)])
    top = np.arange(8) * h // 8
    end = np.maximum((np.arange(8) + 1) * h // 8, top + 1)
    cell = (total[end] - total[top]) / ((end - top)[:, None] * (ROW // 8))
    mean = total[-1].sum() / (h * ROW)
    counts = np.bincount(samples.reshape(-1), minlength=256)
    spread = float(np.sqrt((counts * (np.arange(256) - mean) ** 2).sum() / (h * ROW)))
    bits = np.packbits((cell > mean).reshape(-1)).tobytes().hex()
    return f"{bits}:{mean:.4f}:{spread:.4f}"


class _Archive:
    """Writes one archive under a name of its own attempt; nothing reads it before a manifest names that attempt."""

    def __init__(self, files: pafs.FileSystem, path: str):
        self.out, self.entries, self.size = files.open_output_stream(path), [], 0

    def add(self, doc_id: int | None, n_bytes: int, media: bytes) -> None:
        self.out.write(media)
        self.entries.append((doc_id or 0, doc_id is None, self.size, len(media), n_bytes, zlib.crc32(media)))
        self.size += len(media)

    def close(self) -> None:
        directory = np.array(self.entries, ENTRY).tobytes()
        self.out.write(directory)
        self.out.write(_FOOTER.pack(_MAGIC, self.size, len(self.entries), zlib.crc32(directory)))
        self.out.close()


def _archive_path(stem: str, attempt: int, number: int) -> str:
    return f"{stem}.{attempt}-{number:06d}.arc"


def write_archives(docs: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES) -> int:
    """Store every row's payload in archives under ``folder`` (a URI that all executors reach); returns how many members were written.

    Every attempt of a task writes archives of its own and, when all are
    closed, one manifest of them.  Of a task's whole manifests the last
    attempt's counts, so a task that runs again, whether the first run was lost
    or had finished, is read once; nothing is renamed or replaced.
    Nulls: a null text is an empty one, a null doc_id is kept as null.
    """
    files, root = arrow_files(folder)
    files.create_dir(root, recursive=True)

    def run(batches):
        files, root = arrow_files(folder)
        context = TaskContext.get()
        stem, attempt = f"{root}/part-{context.partitionId():06d}", context.taskAttemptId()
        current, listed, members = None, [], 0

        def done():
            current.close()
            listed.append((len(listed), current.size, len(current.entries)))

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                if current is None:
                    current = _Archive(files, _archive_path(stem, attempt, len(listed)))
                payload, n_bytes = payload_of(text.as_py())
                current.add(doc_id, n_bytes, to_png(payload))
                members += 1
                if current.size >= archive_bytes:
                    done()
                    current = None
        if current is not None:
            done()
        if listed:
            write_manifest(files, stem, attempt, listed)
        yield pa.RecordBatch.from_arrays([pa.array([members], pa.int64())], ["members"])

    rows = docs.selectExpr("cast(doc_id as bigint) as doc_id", "text").mapInArrow(run, "members long")
    return int(rows.groupBy().sum("members").first()[0] or 0)


def write_manifest(files: pafs.FileSystem, stem: str, attempt: int, listed: list[tuple[int, int, int]]) -> None:
    """One file that lists an attempt's archives, with a checksum at its end that tells whether it is whole."""
    body = np.array(listed, LISTED).tobytes()
    with files.open_output_stream(f"{stem}.{attempt}.idx") as out:
        out.write(body + _SEAL.pack(_MAGIC, zlib.crc32(body)))


def read_manifest(body: bytes) -> np.ndarray | None:
    """What a manifest lists; None if it was cut off."""
    if len(body) < _SEAL.size or _SEAL.unpack(body[-_SEAL.size :]) != (_MAGIC, zlib.crc32(body[: -_SEAL.size])):
        return None
    return np.frombuffer(body[: -_SEAL.size], LISTED)


@dataclass
class DirectoryRange(InputPartition):
    """Bytes ``[begin, end)`` of the directory of one archive: whole entries."""

    path: str
    begin: int
    end: int


class ArchiveReader(DataSourceReader):
    def __init__(self, options: dict):
        self.folder = options["path"]
        self.range_bytes = int(options.get("rangeBytes", RANGE_BYTES))
        self.retries = int(options.get("retries", RETRIES))

    def partitions(self) -> list[DirectoryRange]:
        """One range for about ``rangeBytes`` of members.  Reads the tasks' manifests, many at once; no archive is opened."""
        files, root = arrow_files(self.folder)
        found = []
        for i in files.get_file_info(pafs.FileSelector(root)):
            stem, _, attempt = i.path.removesuffix(".idx").rpartition(".")
            if i.path.endswith(".idx") and attempt.isdigit():
                found.append((stem, int(attempt), i.path))

        def listed(path: str) -> np.ndarray | None:
            with files.open_input_file(path) as f:
                return read_manifest(f.read())

        whole: dict[str, tuple[int, np.ndarray]] = {}
        with ThreadPoolExecutor(READERS) as readers:
            for (stem, attempt, _), manifest in zip(sorted(found), readers.map(listed, [path for _, _, path in sorted(found)])):
                if manifest is not None:
                    whole[stem] = attempt, manifest
        out = []
        for stem, (attempt, manifest) in sorted(whole.items()):
            for number, start, count in manifest.tolist():
                step = max(1, count * self.range_bytes // max(1, start))
                archive = _archive_path(stem, attempt, number)
                out += [DirectoryRange(archive, start + a * ENTRY.itemsize, start + min(count, a + step) * ENTRY.itemsize) for a in range(0, count, step)]
        return out or [DirectoryRange("", 0, 0)]

    def read(self, partition: DirectoryRange) -> Iterator[pa.RecordBatch]:
        if partition.end <= partition.begin:
            return
        files, _ = arrow_files(self.folder)
        with files.open_input_file(partition.path) as f:
            entries = np.frombuffer(self._bytes(f, partition.begin, partition.end - partition.begin), ENTRY)
            ends = np.cumsum(entries["size"])
            at = 0
            while at < len(entries):
                before = int(ends[at - 1]) if at else 0
                stop = max(at + 1, int(np.searchsorted(ends, before + RUN_BYTES, side="right")))
                yield self._batch(f, entries[at:stop])
                at = stop

    def _batch(self, f, run: np.ndarray) -> pa.RecordBatch:
        first = int(run["offset"][0])
        try:
            block = f.read_at(int(run["offset"][-1] + run["size"][-1]) - first, first)
        except OSError:
            block = b""
        media = []
        for e in run:
            a = int(e["offset"]) - first
            member = block[a : a + int(e["size"])]
            media.append(member if len(member) == e["size"] and zlib.crc32(member) == e["crc"] else self._again(f, e))
        ids = pa.array(run["doc_id"].astype(np.int64), mask=run["no_id"].astype(bool))
        return pa.RecordBatch.from_arrays([ids, pa.array(run["n_bytes"].astype(np.int64)), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])

    def _again(self, f, entry) -> bytes:
        """One member by its own offset, until its checksum holds."""
        for k in range(self.retries):
            time.sleep(0.05 * 2**k * (k > 0))
            try:
                member = f.read_at(int(entry["size"]), int(entry["offset"]))
            except OSError:
                continue
            if len(member) == entry["size"] and zlib.crc32(member) == entry["crc"]:
                return member
        raise OSError(f"member at {int(entry['offset'])} can't be read whole")

    def _bytes(self, f, begin: int, size: int) -> bytes:
        for k in range(self.retries):
            time.sleep(0.05 * 2**k * (k > 0))
            try:
                data = f.read_at(size, begin)
            except OSError:
                continue
            if len(data) == size:
                return data
        raise OSError("the directory can't be read whole")


class ArchiveSource(DataSource):
    """``spark.read.format("media_archive").load(folder)``: doc_id, n_bytes and the stored bytes of every member."""

    @classmethod
    def name(cls) -> str:
        return "media_archive"

    def schema(self) -> str:
        return "doc_id long, n_bytes long, media binary"

    def reader(self, schema) -> ArchiveReader:
        return ArchiveReader(self.options)


def describe(media: DataFrame) -> DataFrame:
    """Digests and features of stored members (doc_id, n_bytes, media), decoded batch by batch."""

    def run(batches):
        for batch in batches:
            cols: list[list] = [[] for _ in range(6)]
            for stored in batch.column(2).to_pylist():
                samples = from_png(stored)
                payload = samples.tobytes()
                row = (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(stored), hashlib.sha256(stored).hexdigest(), feature(samples))
                for c, v in zip(cols, row):
                    c.append(v)
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *[pa.array(c, k) for c, k in zip(cols, kinds)]], _NAMES)

    return media.mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


_NAMES = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]


def media_columns(docs: DataFrame) -> DataFrame:
    """Store every text of ``docs`` in archives, read them back through the data source, and describe each member.

    Returns doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32,
    media_bytes, media_sha256, feature.  A null or empty text is one row of
    spaces; null and repeated doc_ids stay; doc_id must be integral; an empty
    table gives an empty result; other columns are not read.  Archives stay in
    the shared folder until the session's owner removes them.
    """
    spark = docs.sparkSession
    folder = fresh_path(spark, "media")
    write_archives(docs, folder)
    spark.dataSource.register(ArchiveSource)
    return describe(spark.read.format("media_archive").load(folder))
