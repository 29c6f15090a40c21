"""Shapefiles as a Spark data source: ranges of records planned from the index, geometry and attributes read together."""

from __future__ import annotations

import datetime as dt
import json
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from plumbline.sources.geometry import Shape, typed_json
from plumbline.storage import arrow_files

#: Shape types by their last digit, and from which number on they have heights or only measures.
TYPES = {0: "Null", 1: "Point", 3: "PolyLine", 5: "Polygon", 8: "MultiPoint"}
WITH_HEIGHTS, WITH_MEASURES = 10, 20
_COLUMNS = "record long, properties string, kind string, xs array<double>, ys array<double>, zs array<double>, rings array<int>, parts array<int>, fault string"
_TYPES = [pa.int64(), pa.string(), pa.string(), *[pa.list_(pa.float64())] * 3, *[pa.list_(pa.int32())] * 2, pa.string()]


def _area(points: np.ndarray) -> float:
    """Twice the signed area of a ring; below zero for a clockwise one."""
    x, y = points[:, 0], points[:, 1]
    return float((x * np.roll(y, -1) - np.roll(x, -1) * y).sum())


def _contains(ring: np.ndarray, point: np.ndarray) -> bool:
    a, b = ring, np.roll(ring, -1, axis=0)
    crosses = (a[:, 1] > point[1]) != (b[:, 1] > point[1])
    with np.errstate(divide="ignore", invalid="ignore"):
        at = a[:, 0] + (point[1] - a[:, 1]) / (b[:, 1] - a[:, 1]) * (b[:, 0] - a[:, 0])
    return bool((crosses & (point[0] < at)).sum() % 2)


def _polygons(rings: list[np.ndarray]) -> list[list[np.ndarray]]:
    """Clockwise rings are outer ones; another is a hole of the smallest outer ring around it, or, without one, a polygon of its own."""
    outer = [[r] for r in rings if _area(r) < 0]
    for hole in (r for r in rings if _area(r) >= 0):
        around = [p for p in outer if _contains(p[0], hole[0])]
        if around:
            min(around, key=lambda p: abs(_area(p[0]))).append(hole)
        else:
            outer.append([hole])
    return outer


def shape(content: bytes) -> tuple:
    """Kind, xs, ys, zs, rings, parts and fault of one record's content."""
    try:
        (code,) = struct.unpack_from("<i", content)
        base = TYPES.get(code % 10)
        if base is None or code >= 30 or code in (10, 20):
            raise ValueError(f"unsupported shape type {code}")
        heights = WITH_HEIGHTS < code < WITH_MEASURES
        if base == "Null":
            return (None,) * 7
        if base == "Point":
            xyz = np.frombuffer(content, "<f8", 3 if heights else 2, 4).reshape(1, -1)
            found = Shape("Point")
            found.ring(xyz)
            found.parts.append(1)
            return (*found.row(None)[:6], None)
        at = 36
        n_parts = 0
        if base != "MultiPoint":
            (n_parts,) = struct.unpack_from("<i", content, at)
            at += 4
        (n,) = struct.unpack_from("<i", content, at)
        at += 4
        starts = np.frombuffer(content, "<i4", n_parts, at).tolist()
        at += 4 * n_parts
        points = np.frombuffer(content, "<f8", 2 * n, at).reshape(n, 2)
        at += 16 * n
        if heights:
            points = np.column_stack([points, np.frombuffer(content, "<f8", n, at + 16)])
    except (struct.error, ValueError) as e:
        return (*Shape("GeometryCollection").row(None)[:6], str(e) or "the record ends early")
    if base == "MultiPoint":
        found = Shape("MultiPoint")
        for k in range(n):
            found.ring(points[k : k + 1])
            found.parts.append(k + 1)
        return (*found.row(None)[:6], None)
    lines = [points[a:b] for a, b in zip(starts, [*starts[1:], n])]
    members = [[line] for line in lines] if base == "PolyLine" else _polygons(lines)
    single = "LineString" if base == "PolyLine" else "Polygon"
    found = Shape(single if len(members) == 1 else "Multi" + single)
    for member in members:
        for ring in member:
            found.ring(ring)
        found.parts.append(len(found.rings))
    return (*found.row(None)[:6], None)


@dataclass
class Field:
    name: str
    kind: str
    size: int
    decimals: int

    def value(self, raw: bytes, encoding: str):
        text = raw.decode(encoding, "replace").strip("\0 ")
        if self.kind in "NF":
            if not text or set(text) <= {"*"}:
                return None
            try:
                return int(text) if self.kind == "N" and not self.decimals and "." not in text else float(text)
            except ValueError:
                return None
        if self.kind == "L":
            return {"T": True, "Y": True, "F": False, "N": False}.get(text.upper()[:1])
        if self.kind == "D":
            try:
                return dt.date(int(text[:4]), int(text[4:6]), int(text[6:8]))
            except ValueError:
                return None
        return text


def dbf_head(head: bytes, encoding: str) -> tuple[int, int, int, list[Field]]:
    """Records, size of the head, size of a record, and fields of a dBASE table."""
    n, size, width = struct.unpack_from("<IHH", head, 4)
    fields, at = [], 32
    while at + 32 <= size and head[at] != 0x0D:
        name = head[at : at + 11].split(b"\0")[0].decode(encoding, "replace").strip()
        fields.append(Field(name, chr(head[at + 11]), head[at + 16], head[at + 17]))
        at += 32
    return n, size, width, fields


@dataclass
class _Records(InputPartition):
    first: int
    stop: int


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        path = options["path"]
        self.stem = path[:-4] if path.lower().endswith(".shp") else path
        self.step, self.encoding = int(options.get("rowsPerPartition", 1 << 16)), options.get("encoding")

    def _open(self, extension: str):
        files, inner = arrow_files(self.stem + extension)
        return files.open_input_file(inner)

    def _code_page(self) -> str:
        """The given encoding, else that of the .cpg file, else UTF-8."""
        if self.encoding:
            return self.encoding
        import codecs

        try:
            with self._open(".cpg") as f:
                name = f.read(64).decode("ascii", "ignore").strip()
        except (FileNotFoundError, OSError):
            return "utf-8"
        for tried in (name, f"cp{name}", name.replace("ANSI ", "cp")):
            try:
                return codecs.lookup(tried).name
            except LookupError:
                continue
        return "utf-8"

    def partitions(self):
        with self._open(".shx") as f:
            head = f.read(100)
            if len(head) < 100 or struct.unpack_from(">i", head)[0] != 9994:
                raise ValueError(f"{self.stem}.shx is no shape index")
            n = (struct.unpack_from(">i", head, 24)[0] * 2 - 100) // 8
        return [_Records(a, min(a + self.step, n)) for a in range(0, n, self.step)] or [_Records(0, 0)]

    def read(self, partition: _Records) -> Iterator[pa.RecordBatch]:
        encoding = self._code_page()
        names = [c.split()[0] for c in _COLUMNS.split(", ")]
        with self._open(".shx") as index, self._open(".shp") as shapes, self._open(".dbf") as table:
            n, size, width, fields = dbf_head(table.read_at(struct.unpack("<H", table.read_at(2, 8))[0], 0), encoding)
            for a in range(partition.first, partition.stop, 2048):
                b = min(a + 2048, partition.stop)
                places = np.frombuffer(index.read_at(8 * (b - a), 100 + 8 * a), ">i4").reshape(-1, 2).astype(np.int64) * 2
                low, high = int(places[:, 0].min()), int((places[:, 0] + 8 + places[:, 1]).max())
                # Records mostly lie one after the other; where they don't, each is read by itself.
                whole = shapes.read_at(high - low, low) if high - low <= 2 * int(places[:, 1].sum() + 8 * (b - a)) else None
                lines = table.read_at(width * (min(b, n) - min(a, n)), size + width * min(a, n))
                rows = []
                for k, (at, length) in enumerate(places.tolist()):
                    content = whole[at + 8 - low : at + 8 - low + length] if whole is not None else shapes.read_at(length, at + 8)
                    line = lines[width * k : width * (k + 1)]
                    values, place = {}, 1
                    for f in fields:
                        values[f.name] = f.value(line[place : place + f.size], encoding) if len(line) == width and line[:1] != b"*" else None
                        place += f.size
                    rows.append((a + k, json.dumps({key: typed_json(v) for key, v in values.items()}, sort_keys=True, ensure_ascii=False), *shape(content)))
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(_TYPES)], names)


class ShapefileSource(DataSource):
    """``spark.read.format("shapefile").load("x.shp")``: record, properties (JSON), kind, xs, ys, zs, rings, parts, fault.

    Ranges of records are partitions.  Null shapes have a null kind, damaged
    ones a fault; deleted or missing attributes are null.
    """

    @classmethod
    def name(cls) -> str:
        return "shapefile"

    def schema(self) -> str:
        return _COLUMNS

    def reader(self, schema) -> _Reader:
        return _Reader(self.options)
