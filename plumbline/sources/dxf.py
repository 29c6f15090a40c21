"""ASCII DXF drawings: one row an entity, read as a stream of group lines and given out in Arrow batches."""

from __future__ import annotations

import io
import math
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

_ENTITY = "path string, layer string, kind string, xs array<double>, ys array<double>, zs array<double>"
_ROWS = 4096


@dataclass
class _Entity:
    kind: str
    groups: list[tuple[int, str]]

    def all(self, code: int) -> list[float]:
        return [float(v) for c, v in self.groups if c == code]

    def one(self, code: int, default: float = 0.0) -> float:
        return next((float(v) for c, v in self.groups if c == code), default)

    @property
    def layer(self) -> str:
        return next((v for c, v in self.groups if c == 8), "0")


def _entities(lines: Iterator[str]) -> Iterator[_Entity]:
    """Entities of the ENTITIES section; one is in memory at a time."""
    inside, current, before = False, None, None
    for code, value in zip(lines, lines):
        code, value = int(code.strip()), value.strip()
        if code == 2 and before == (0, "SECTION"):
            inside = value == "ENTITIES"
        elif code == 0:
            if current is not None:
                yield current
            current = _Entity(value, []) if inside and value not in ("ENDSEC", "EOF", "SECTION") else None
            inside = inside and value != "ENDSEC"
        elif current is not None:
            current.groups.append((code, value))
        before = (code, value)


def _arc_steps(sweep: float) -> int:
    return min(180, max(12, int(abs(sweep) / 5) + 1))


def _geometry(e: _Entity) -> tuple[list[float], list[float], list[float]] | None:
    if e.kind == "POINT":
        return [e.one(10)], [e.one(20)], [e.one(30)]
    if e.kind == "LINE":
        return [e.one(10), e.one(11)], [e.one(20), e.one(21)], [e.one(30), e.one(31)]
    if e.kind == "LWPOLYLINE":
        xs, ys = e.all(10), e.all(20)
        if int(e.one(70)) & 1 and xs:
            xs, ys = [*xs, xs[0]], [*ys, ys[0]]
        return xs, ys, [e.one(38)] * len(xs)
    if e.kind in ("ARC", "CIRCLE"):
        begin = e.one(50) if e.kind == "ARC" else 0.0
        sweep = (e.one(51) - begin) % 360 or 360.0 if e.kind == "ARC" else 360.0
        steps = _arc_steps(sweep)
        angles = [math.radians(begin + sweep * k / steps) for k in range(steps + 1)]
        return [e.one(10) + e.one(40) * math.cos(a) for a in angles], [e.one(20) + e.one(40) * math.sin(a) for a in angles], [e.one(30)] * (steps + 1)
    return None


def dxf_entities(spark: SparkSession, pattern: str):
    """Rows (path, layer, kind, xs, ys, zs) of all drawings that ``pattern`` names; arcs are sampled, unsupported kinds keep null coordinates.

    Files come through Spark's binary reader, so they may lie in any store
    that Spark reads; each is parsed in one task.
    """

    def run(batches):
        rows: list[tuple] = []

        def taken():
            names = [f.split()[0] for f in _ENTITY.split(", ")]
            kinds = [*[pa.string()] * 3, *[pa.list_(pa.float64())] * 3]
            columns = list(zip(*rows)) or [()] * 6
            batch = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)
            rows.clear()
            return batch

        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                lines = io.TextIOWrapper(io.BufferedReader(pa.BufferReader(content.as_buffer())), "utf-8", "replace")
                for e in _entities(iter(lines)):
                    rows.append((path, e.layer, e.kind, *(_geometry(e) or (None, None, None))))
                    if len(rows) >= _ROWS:
                        yield taken()
        yield taken()

    return spark.read.format("binaryFile").load(pattern).select("path", "content").mapInArrow(run, _ENTITY)


def segments(entities):
    """Consecutive vertices of each entity as segments."""
    at = F.posexplode(F.arrays_zip("xs", "ys", "zs")).alias("i", "a")
    rows = entities.where("xs is not null").select("path", "layer", "kind", "xs", "ys", "zs", at)
    nxt = lambda c: F.get(c, F.col("i") + 1)
    return rows.where(F.col("i") < F.size("xs") - 1).select("path", "layer", "kind", "i", F.col("a.ys").alias("n1"), F.col("a.xs").alias("e1"), nxt("ys").alias("n2"), nxt("xs").alias("e2"))
