"""LAS point clouds: headers, and records as a Spark data source over byte ranges."""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from plumbline.storage import arrow_files

_HEADER = "version string, point_format int, record_length int, data_offset long, n_points long, x_scale double, y_scale double, z_scale double, x_offset double, y_offset double, z_offset double, min_x double, min_y double, min_z double, max_x double, max_y double, max_z double"


def header(content: bytes) -> tuple:
    """Fields of a LAS 1.0 to 1.4 header, little-endian; raises ValueError for other files."""
    if content[:4] != b"LASF" or len(content) < 227:
        raise ValueError("not a LAS file")
    major, minor = content[24], content[25]
    (offset,) = struct.unpack_from("<I", content, 96)
    kind, length, count = struct.unpack_from("<BHI", content, 104)
    sx, sy, sz, ox, oy, oz, max_x, min_x, max_y, min_y, max_z, min_z = struct.unpack_from("<12d", content, 131)
    if (major, minor) >= (1, 4) and len(content) >= 255:
        count = struct.unpack_from("<Q", content, 247)[0] or count
    return f"{major}.{minor}", kind & 0x3F, length, offset, count, sx, sy, sz, ox, oy, oz, min_x, min_y, min_z, max_x, max_y, max_z


def las_headers(spark: SparkSession, pattern: str) -> DataFrame:
    """One row a file that ``pattern`` names; of each file only the head is read."""
    files = spark.read.format("binaryFile").load(pattern).select("path")

    def heads(batches):
        for batch in batches:
            found = []
            for path in batch.column(0).to_pylist():
                with _open(path) as f:
                    found.append((path, *header(f.read(375))))
            columns = [list(c) for c in zip(*found)] if found else [[] for _ in range(18)]
            kinds = [pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), *[pa.float64()] * 12]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["path", *[f.split()[0] for f in _HEADER.split(", ")]])

    return files.mapInArrow(heads, f"path string, {_HEADER}")


@dataclass
class _Range(InputPartition):
    path: str
    start: int
    stop: int


def _open(path: str):
    """A file by local path or by URI (file, hdfs, s3a, ...)."""
    files, inner = arrow_files(path)
    return files.open_input_file(inner)


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.step = options["path"], int(options.get("rowsPerPartition", 1 << 20))

    def partitions(self):
        with _open(self.path) as f:
            count = header(f.read(375))[4]
        return [_Range(self.path, a, min(count, a + self.step)) for a in range(0, count, self.step)] or [_Range(self.path, 0, 0)]

    def read(self, partition: _Range) -> Iterator[pa.RecordBatch]:
        with _open(partition.path) as f:
            h = header(f.read(375))
            length, offset = h[2], h[3]
            for a in range(partition.start, partition.stop, 1 << 16):
                n = min(partition.stop, a + (1 << 16)) - a
                raw = np.frombuffer(f.read_at(n * length, offset + a * length), np.uint8)
                if len(raw) < n * length:
                    raise ValueError("the file ends before its last record")
                xyz = raw.reshape(n, length)[:, :12].copy().view("<i4")
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(a, a + n)), *[pa.array(xyz[:, k] * h[5 + k] + h[8 + k]) for k in range(3)]], ["record", "x", "y", "z"])


class LasSource(DataSource):
    """``spark.read.format("las_points").load(path)``: record number and scaled x, y, z; ranges of records are partitions."""

    @classmethod
    def name(cls) -> str:
        return "las_points"

    def schema(self) -> str:
        return "record long, x double, y double, z double"

    def reader(self, schema) -> _Reader:
        return _Reader(self.options)
