from __future__ import annotations

import math

import pytest

from plumbline.operators import drawings
from plumbline.sources import drawings as source


def dxf(blocks, entities):
    """A drawing from lists of group pairs."""
    out = ["0", "SECTION", "2", "HEADER", "9", "$INSUNITS", "70", "6", "0", "ENDSEC", "0", "SECTION", "2", "BLOCKS"]
    for name, base, contents in blocks:
        out += ["0", "BLOCK", "8", "0", "2", name, "70", "0", "10", str(base[0]), "20", str(base[1]), "30", "0"]
        for e in contents:
            out += [str(v) for pair in e for v in pair]
        out += ["0", "ENDBLK"]
    out += ["0", "ENDSEC", "0", "SECTION", "2", "ENTITIES"]
    for e in entities:
        out += [str(v) for pair in e for v in pair]
    return "\n".join([*out, "0", "ENDSEC", "0", "EOF", ""])


def point(x, y, z=0, layer="0", **more):
    return [(0, "POINT"), (8, layer), (10, x), (20, y), (30, z)]


def insert(name, x, y, layer="L", handle="A1", scale=(1, 1, 1), rotation=0, grid=(1, 1, 0, 0), normal=None):
    groups = [(0, "INSERT"), (5, handle), (8, layer), (2, name), (10, x), (20, y), (30, 0), (41, scale[0]), (42, scale[1]), (43, scale[2]), (50, rotation), (70, grid[0]), (71, grid[1]), (44, grid[2]), (45, grid[3])]
    return groups + ([(210, normal[0]), (220, normal[1]), (230, normal[2])] if normal else [])


def expanded(spark, tmp_path, text, **units):
    (tmp_path / "a.dxf").write_text(text, encoding="utf-8")
    entities, omitted = drawings.modelspace(*source.read_drawings(spark, str(tmp_path / "*.dxf")), **units)
    rows = {r.entity_id: r for r in entities.collect()}
    return rows, {r.entity_id: (r.kind, r.reason) for r in omitted.collect()}


def xy(row):
    return [(round(x, 9), round(y, 9)) for x, y in zip(row.xs, row.ys)]


def test_nested_rotated_scaled_and_mirrored_references(spark, tmp_path):
    """Hand-worked: inner has a point at (1, 0) from its base (1, 1) and a line; outer places inner twice."""
    blocks = [
        ("inner", (1, 1), [point(2, 1), [(0, "LINE"), (8, "own"), (10, 1), (20, 1), (11, 1), (21, 3)]]),
        ("outer", (0, 0), [insert("inner", 10, 0, layer="0", scale=(2, 2, 2)), insert("inner", 0, 5, layer="M", rotation=90)]),
    ]
    rows, omitted = expanded(spark, tmp_path, dxf(blocks, [insert("outer", 100, 200, layer="TOP", rotation=90, handle="F0"), insert("outer", 0, 0, layer="MIR", scale=(-1, 1, 1), handle="F1")]))
    assert omitted == {}
    # outer at (100, 200) turned by 90 degrees: (x, y) -> (100 - y, 200 + x).
    assert xy(rows["F0/0/0/0/0"]) == [(100, 212)] and xy(rows["F0/0/0/0/1"]) == [(100, 210), (96, 210)]
    assert xy(rows["F0/0/1/0/0"]) == [(94, 200)] and xy(rows["F0/0/1/0/1"]) == [(95, 200), (95, 198)]
    assert xy(rows["F1/0/0/0/0"]) == [(-12, 0)] and xy(rows["F1/0/1/0/1"]) == [(0, 5), (2, 5)]
    first = rows["F0/0/0/0/0"]
    assert (first.layer, first.block_path, first.handle, first.planar) == ("TOP", ["outer", "inner"], "F0", True)
    assert rows["F0/0/1/0/0"].layer == "M" and rows["F0/0/0/0/1"].layer == "own"


def test_arrays_units_and_plain_entities(spark, tmp_path):
    blocks = [("b", (0, 0), [point(0, 0, 1)])]
    rows, _ = expanded(spark, tmp_path, dxf(blocks, [insert("b", 1, 1, grid=(2, 3, 10, 5), rotation=90, handle="C"), [(0, "LINE"), (5, "D"), (8, "x"), (10, 0), (20, 0), (11, 1), (21, 0)]]), drawing_units="international_feet", project_units="meters")
    assert len(rows) == 7 and xy(rows["D"]) == [(0, 0), (0.3048, 0)]
    # The array's columns run along the turned x axis: up.
    assert xy(rows["C/1/0"]) == [(0.3048, round(11 * 0.3048, 9))] and xy(rows["C/2/0"]) == [(round(-4 * 0.3048, 9), 0.3048)] and rows["C/1/0"].zs == [0.3048]


def test_cycles_missing_blocks_and_unsupported_kinds_are_told(spark, tmp_path):
    blocks = [("a", (0, 0), [insert("b", 1, 0), point(0, 0)]), ("b", (0, 0), [insert("a", 1, 0)])]
    rows, omitted = expanded(spark, tmp_path, dxf(blocks, [insert("a", 0, 0, handle="1"), insert("none", 0, 0, handle="2"), [(0, "HATCH"), (5, "3")], [(0, "LWPOLYLINE"), (5, "4"), (70, 1)], [(0, "POINT"), (5, "5"), (10, 1e13), (20, 0)], [(0, "POINT"), (5, "6"), (67, 1), (10, 1), (20, 0)]]))
    assert set(rows) == {"1/0/1"}
    assert omitted == {"1/0/0/0/0": ("INSERT", drawings.RECURSIVE), "2": ("INSERT", drawings.MISSING), "3": ("HATCH", drawings.UNSUPPORTED), "4": ("LWPOLYLINE", drawings.EMPTY), "5": ("POINT", "Invalid or out-of-range coordinate.")}


def test_nesting_ends_after_twelve_levels(spark, tmp_path):
    blocks = [(f"n{k}", (0, 0), [insert(f"n{k + 1}", 1, 0), point(0, 0)]) for k in range(15)] + [("n15", (0, 0), [point(0, 0)])]
    rows, omitted = expanded(spark, tmp_path, dxf(blocks, [insert("n0", 0, 0, handle="1")]))
    assert len(rows) == 12 and xy(rows["1/0/0" + "/0/0" * 10 + "/0/1"]) == [(11, 0)]
    assert list(omitted.values()) == [("INSERT", drawings.RECURSIVE)]


def test_curves_bulges_text_and_planes(spark, tmp_path):
    entities = [
        [(0, "LWPOLYLINE"), (5, "P"), (8, "0"), (70, 1), (10, 0), (20, 0), (42, 1), (10, 2), (20, 0), (10, 2), (20, 2)],
        [(0, "ARC"), (5, "Q"), (10, 1), (20, 1), (40, 2), (50, 270), (51, 90)],
        [(0, "CIRCLE"), (5, "R"), (10, 5), (20, 0), (40, 1), (210, 0), (220, 0), (230, -1)],
        [(0, "ELLIPSE"), (5, "S"), (10, 0), (20, 0), (11, 2), (21, 0), (40, 0.5), (41, 0), (42, math.pi / 2)],
        [(0, "MTEXT"), (5, "T"), (10, 3), (20, 4), (3, "{\\fArial;long "), (1, "text\\Pend}")],
        [(0, "POLYLINE"), (5, "U"), (70, 8)], [(0, "VERTEX"), (10, 1), (20, 1), (30, 1)], [(0, "VERTEX"), (10, 2), (20, 2), (30, 3)], [(0, "SEQEND")],
        [(0, "POLYLINE"), (5, "V"), (70, 64)], [(0, "VERTEX"), (10, 1), (20, 1), (30, 1)], [(0, "SEQEND")],
    ]
    rows, omitted = expanded(spark, tmp_path, dxf([], entities))
    assert omitted == {"V": ("POLYLINE", drawings.UNSUPPORTED)}
    p = xy(rows["P"])
    assert p[0] == p[-1] == (0, 0) and rows["P"].closed and rows["P"].curved and (2, 2) in p
    # A bulge of one is a half circle below the chord from (0, 0) to (2, 0).
    assert all(math.isclose(math.hypot(x - 1, y), 1, abs_tol=1e-9) and y <= 1e-9 for x, y in p[: p.index((2, 0)) + 1]) and min(y for _, y in p) < -0.99
    q = xy(rows["Q"])
    assert q[0] == (1, -1) and q[-1] == (1, 3) and max(x for x, _ in q) > 2.999 and not rows["Q"].closed
    assert all(math.isclose(math.hypot(x + 5, y), 1, abs_tol=1e-9) for x, y in xy(rows["R"])) and rows["R"].closed
    assert xy(rows["S"])[0] == (2, 0) and xy(rows["S"])[-1] == (0, 1) and not rows["S"].closed
    assert rows["T"].text == "long text\nend" and xy(rows["T"]) == [(3, 4)]
    assert list(zip(rows["U"].xs, rows["U"].zs)) == [(1, 1), (2, 3)] and not rows["U"].planar


def test_mirrored_plane_of_a_reference(spark, tmp_path):
    """A normal of -z: x of the place and of the block run backwards."""
    rows, _ = expanded(spark, tmp_path, dxf([("b", (0, 0), [point(1, 2, 3)])], [insert("b", 10, 0, handle="1", normal=(0, 0, -1))]))
    assert xy(rows["1/0/0"]) == [(-11, 2)] and rows["1/0/0"].zs == [-3]


def test_empty_drawing_and_damaged_lines(spark, tmp_path):
    assert expanded(spark, tmp_path, dxf([], [])) == ({}, {})
    (tmp_path / "b.dxf").write_text("0\nSECTION\nx\ny\n", encoding="utf-8")
    with pytest.raises(Exception, match="invalid literal"):
        source.read_drawings(spark, str(tmp_path / "b.dxf"))[0].collect()
