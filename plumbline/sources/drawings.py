"""Modelspace and blocks of ASCII DXF drawings as records and blocks for ``operators.drawings``.

Drawings are read as streams of group lines from where they lie, one task a
file, and given out in Arrow batches; no file is held whole.
"""

from __future__ import annotations

import io
import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.storage import arrow_files

#: How far chords of curves may lie from them (meters), and the widest step.
CHORD, WIDEST = 0.001 * 0.3048, math.radians(15)
_ROWS = 4096
_POINT = pa.struct([(a, pa.float64()) for a in "xyz"])
_SCHEMA = pa.schema([
    ("path", pa.string()), ("block", pa.string()), ("seq", pa.int64()), ("handle", pa.string()), ("kind", pa.string()), ("layer", pa.string()), ("xs", pa.list_(pa.float64())), ("ys", pa.list_(pa.float64())), ("zs", pa.list_(pa.float64())),
    ("closed", pa.bool_()), ("curved", pa.bool_()), ("text", pa.string()), ("name", pa.string()), ("place", _POINT), ("factor", _POINT), ("rotation", pa.float64()), ("columns", pa.int32()), ("rows", pa.int32()), ("dx", pa.float64()), ("dy", pa.float64()), ("external", pa.bool_()),
])
_PLACE = "struct<x:double,y:double,z:double>"
_KINDS = f"path string, block string, seq long, handle string, kind string, layer string, xs array<double>, ys array<double>, zs array<double>, closed boolean, curved boolean, text string, name string, place {_PLACE}, factor {_PLACE}, rotation double, columns int, rows int, dx double, dy double, external boolean"
Groups = list[tuple[int, str]]


def _objects(lines: Iterator[str]) -> Iterator[tuple[str, Groups]]:
    """Kind and groups of every object that group 0 begins; one is in memory at a time."""
    kind, groups = None, []
    for code, value in zip(lines, lines):
        number, value = int(code), value.strip("\r\n")
        if number == 0:
            if kind is not None:
                yield kind, groups
            kind, groups = value.strip(), []
        elif kind is not None and number != 999:
            groups.append((number, value))
    if kind is not None:
        yield kind, groups


class _Groups:
    def __init__(self, groups: Groups):
        self.groups = groups

    def text(self, code: int, default: str = "") -> str:
        return next((v.strip() for c, v in self.groups if c == code), default)

    def number(self, code: int, default: float = 0.0) -> float:
        return float(self.text(code) or default)

    def point(self, first: int = 10, default: float = 0.0) -> tuple[float, float, float]:
        return self.number(first, default), self.number(first + 10, default), self.number(first + 20, default)


def _axes(groups: _Groups) -> tuple[tuple[float, ...], ...] | None:
    """World axes of an entity's own plane (None: the world's): its normal, and two axes by the arbitrary-axis rule."""
    n = (groups.number(210), groups.number(220), groups.number(230, 1.0))
    size = math.hypot(*n)
    n = tuple(v / size for v in n) if size else (0.0, 0.0, 1.0)
    if n == (0.0, 0.0, 1.0):
        return None
    near = abs(n[0]) < 1 / 64 and abs(n[1]) < 1 / 64
    x = (n[2], 0.0, -n[0]) if near else (-n[1], n[0], 0.0)
    size = math.hypot(*x)
    x = tuple(v / size for v in x)
    y = (n[1] * x[2] - n[2] * x[1], n[2] * x[0] - n[0] * x[2], n[0] * x[1] - n[1] * x[0])
    return x, y, n


def _to_world(points: list[tuple[float, float, float]], axes) -> list[tuple[float, float, float]]:
    if axes is None:
        return points
    return [tuple(sum(v * axis[k] for v, axis in zip(p, axes)) for k in range(3)) for p in points]


def _turns(radius: float, sweep: float) -> int:
    """Chords for a sweep, so that none lies further than CHORD from its arc."""
    step = min(WIDEST, 2 * math.acos(max(1 - CHORD / radius, -1.0))) if radius > CHORD else WIDEST
    return max(1, math.ceil(abs(sweep) / max(step, 1e-3)))


def _arc(center, radius: float, begin: float, sweep: float) -> list[tuple[float, float, float]]:
    n = _turns(radius, sweep)
    return [(center[0] + radius * math.cos(begin + sweep * k / n), center[1] + radius * math.sin(begin + sweep * k / n), center[2]) for k in range(n + 1)]


def _bulged(points: list[tuple[float, float, float, float]], closed: bool) -> tuple[list[tuple[float, float, float]], bool]:
    """Vertices (x, y, z, bulge) with arcs where a segment bulges; the bulge is the tangent of a quarter of the arc's angle."""
    out, curved = [p[:3] for p in points[:1]], False
    for a, b in zip(points, [*points[1:], *(points[:1] if closed else [])]):
        dx, dy = b[0] - a[0], b[1] - a[1]
        chord = math.hypot(dx, dy)
        if a[3] and chord:
            curved = True
            sweep = 4 * math.atan(a[3])
            radius = chord / 2 / math.sin(abs(sweep) / 2)
            # The centre lies on the chord's normal, to the left of a counter-clockwise arc of less than half a turn.
            height = chord / 2 / math.tan(sweep / 2)
            center = ((a[0] + b[0]) / 2 - dy / chord * height, (a[1] + b[1]) / 2 + dx / chord * height, a[2])
            out += _arc(center, radius, math.atan2(a[1] - center[1], a[0] - center[0]), sweep)[1:-1]
        out.append(b[:3])
    return out, curved


def _plain_text(value: str) -> str:
    """Text without formatting codes of multi-line text."""
    import re

    value = re.sub(r"\\P", "\n", value)
    return re.sub(r"\\[ACcfFHhLlOoQTWKk][^;\\{}]*;|[{}]|\\~", "", value)[:4000]


def _shape(kind: str, g: _Groups, vertices: list[_Groups]) -> dict:
    """Coordinates, closed and curved of an entity; null coordinates for kinds that have no linework."""
    axes, closed, curved, points = _axes(g), False, False, None
    if kind in ("TEXT", "ATTRIB", "ATTDEF"):
        points = _to_world([g.point()], axes)
    elif kind == "MTEXT":
        points = [g.point()]
    elif kind == "POINT":
        points = [g.point()]
    elif kind == "LINE":
        points = [g.point(), g.point(11)]
    elif kind == "LWPOLYLINE":
        closed, z, own = bool(int(g.number(70)) & 1), g.number(38), []
        for code, value in g.groups:
            if code == 10:
                own.append([float(value), 0.0, z, 0.0])
            elif code in (20, 42) and own:
                own[-1][1 if code == 20 else 3] = float(value)
        points, curved = _bulged([tuple(p) for p in own], closed)
        points = _to_world(points, axes)
    elif kind == "POLYLINE":
        flags = int(g.number(70))
        if not flags & (2 | 4 | 16 | 64):
            closed, flat = bool(flags & 1), not flags & 8
            own = [(*v.point()[:2], g.number(30) if flat else v.point()[2], v.number(42) if flat else 0.0) for v in vertices]
            points, curved = _bulged(own, closed)
            points = _to_world(points, axes) if flat else points
    elif kind in ("ARC", "CIRCLE"):
        curved, closed = True, kind == "CIRCLE"
        begin = 0.0 if closed else math.radians(g.number(50))
        sweep = math.tau if closed else (math.radians(g.number(51)) - begin) % math.tau or math.tau
        points = _to_world(_arc(g.point(), g.number(40), begin, sweep), axes)
    elif kind == "ELLIPSE":
        curved, c, major, ratio = True, g.point(), g.point(11), g.number(40, 1.0)
        begin, end = g.number(41), g.number(42, math.tau)
        sweep = (end - begin) % math.tau or math.tau
        closed = math.isclose(end - begin, math.tau, abs_tol=1e-12)
        normal = axes[2] if axes else (0.0, 0.0, 1.0)
        minor = tuple(ratio * (normal[(k + 1) % 3] * major[(k + 2) % 3] - normal[(k + 2) % 3] * major[(k + 1) % 3]) for k in range(3))
        n = _turns(math.hypot(*major), sweep)
        points = [tuple(c[k] + math.cos(t) * major[k] + math.sin(t) * minor[k] for k in range(3)) for t in (begin + sweep * i / n for i in range(n + 1))]
    xs, ys, zs = ([p[k] for p in points] for k in range(3)) if points is not None else (None, None, None)
    return {"xs": xs, "ys": ys, "zs": zs, "closed": closed, "curved": curved}


def _record(path: str, block: str | None, seq: int, kind: str, g: _Groups, vertices: list[_Groups]) -> dict:
    row = dict.fromkeys(_SCHEMA.names) | {"path": path, "block": block, "seq": seq, "handle": g.text(5) or None, "kind": kind, "layer": g.text(8, "0") or "0"}
    if kind == "INSERT":
        place = _to_world([g.point()], _axes(g))[0]
        mirrored = (_axes(g) or ((), (), (0, 0, 1.0)))[2][2] < 0
        fx, fy, fz = (g.number(c, 1.0) for c in (41, 42, 43))
        # A normal of -z mirrors the block's x and z.
        row |= {"factor": dict(zip("xyz", (-fx if mirrored else fx, fy, -fz if mirrored else fz))), "rotation": -g.number(50) if mirrored else g.number(50)}
        row |= {"name": g.text(2), "place": dict(zip("xyz", place)), "columns": max(1, int(g.number(70, 1))), "rows": max(1, int(g.number(71, 1)))}
        row |= {"dx": -g.number(44) if mirrored else g.number(44), "dy": g.number(45), "closed": False, "curved": False}
        return row
    text = "".join(v for c, v in g.groups if c == 3) + g.text(1) if kind in ("TEXT", "MTEXT", "ATTRIB", "ATTDEF") else ""
    return row | _shape(kind, g, vertices) | {"text": _plain_text(text)}


def parse(path: str, lines: Iterator[str]) -> Iterator[dict]:
    """Records of one drawing, in the order of the file; a BLOCK record gives a block's base and whether it is external.

    Sections other than BLOCKS and ENTITIES are passed over, and so are
    entities in paper space.  Sequence numbers count from zero in modelspace
    and in each block.
    """
    section = block = held = None
    counts: dict[str | None, int] = {}
    vertices: list[_Groups] = []

    def finished():
        if held is not None:
            seq = counts[block] = counts.get(block, -1) + 1
            yield _record(path, block, seq, *held, vertices)

    for kind, groups in _objects(lines):
        g = _Groups(groups)
        if kind == "VERTEX" and held is not None:
            vertices.append(g)
            continue
        yield from finished()
        held, vertices = None, []
        if kind == "SECTION":
            section = g.text(2)
        elif kind in ("ENDSEC", "EOF"):
            section = None
        elif kind == "BLOCK" and section == "BLOCKS":
            block = g.text(2)
            yield dict.fromkeys(_SCHEMA.names) | {"path": path, "block": block, "kind": "BLOCK", "place": dict(zip("xyz", g.point())), "external": bool(int(g.number(70)) & 4)}
        elif kind == "ENDBLK":
            block = None
        elif (section == "ENTITIES" and not int(g.number(67))) or (section == "BLOCKS" and block is not None):
            if kind != "SEQEND":
                held = (kind, g)
    yield from finished()


def read_drawings(spark: SparkSession, pattern: str) -> tuple[DataFrame, DataFrame]:
    """``(records, blocks)`` of all drawings that ``pattern`` names, for ``operators.drawings.modelspace``.

    Spark lists the files; each is opened where it lies and parsed as a stream
    in one task.  A line that is no group code fails the read.
    """

    def run(batches):
        for batch in batches:
            for path in batch.column(0).to_pylist():
                files, inner = arrow_files(path)
                rows: list[dict] = []
                with files.open_input_stream(inner) as source:
                    for row in parse(path, iter(io.TextIOWrapper(io.BufferedReader(source, 1 << 20), "utf-8", "replace"))):
                        rows.append(row)
                        if len(rows) >= _ROWS:
                            yield pa.RecordBatch.from_pylist(rows, _SCHEMA)
                            rows = []
                yield pa.RecordBatch.from_pylist(rows, _SCHEMA)

    paths = spark.read.format("binaryFile").load(pattern).select("path")
    every = paths.repartition(F.col("path")).mapInArrow(run, _KINDS)
    blocks = every.where("kind = 'BLOCK'").select("path", "block", F.col("place").alias("base"), "external")
    return every.where("kind != 'BLOCK'").drop("external"), blocks
