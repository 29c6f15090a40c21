from __future__ import annotations

import random
from statistics import median

import pytest

from plumbline.operators import surfaces
from plumbline.sources import control_files

SCHEMA = "point_id int, northing double, easting double, elevation double"


def brute_components(rows, radius, vertical):
    parent = {r[0]: r[0] for r in rows}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    linked = set()
    for a in rows:
        for b in rows:
            if a[0] < b[0] and ((a[1] - b[1]) ** 2 + (a[2] - b[2]) ** 2) ** 0.5 <= radius and (a[3] is None or b[3] is None or abs(a[3] - b[3]) <= vertical):
                linked |= {a[0], b[0]}
                x, y = sorted((root(a[0]), root(b[0])))
                parent[y] = x
    return {k: root(k) for k in linked}


@pytest.mark.parametrize("seed", [1, 2])
def test_layers_equal_brute_force(spark, seed):
    rng = random.Random(seed)
    rows = [(k, float(rng.randrange(12)) * 0.5, float(rng.randrange(12)) * 0.5, None if rng.random() < 0.03 else rng.randrange(40) / 8) for k in range(400)]
    got = {r.node: r.component for r in surfaces.layered_clusters(spark.createDataFrame(rows, SCHEMA), 0.5, 0.125).collect()}
    want = brute_components(rows, 0.5, 0.125)
    # A point alone in its layer is its own component there, or has none.
    assert {k: v for k, v in got.items() if k in want} == want and all(got[k] == k for k in set(got) - set(want))
    assert len(set(want.values())) > 5


def test_thousands_of_coincident_shots(spark):
    """5,000 shots at each of two places: layers by height, and no pair is made of two of them."""
    rows = [(k, 0.0, 0.0 if k % 2 else 0.2, (k % 3) * 10.0) for k in range(10_000)] + [(20_000, 50.0, 50.0, 0.0), (20_001, 50.0, 50.1, None), (20_002, 50.1, 50.0, 99.0)]
    found = surfaces.layered_clusters(spark.createDataFrame(rows, SCHEMA), 0.25, 0.5)
    got = {r.node: r.component for r in found.collect()}
    assert all(got[k] == k % 3 for k in range(10_000)) and got[20_000] == got[20_002] == 20_000


def brute_busts(rows, radius):
    out = {}
    for a in rows:
        near = [(((a[1] - b[1]) ** 2 + (a[2] - b[2]) ** 2) ** 0.5, b[0], b[3]) for b in rows]
        near = [x for x in near if 0 < x[0] <= radius]
        if len(near) < 2:
            continue
        delta = a[3] - median(z for _, _, z in near)
        error, step = min((abs(abs(delta) - i), i) for i in (0.5, 1.0, 2.0))
        if abs(delta) >= 0.45 and error <= 0.08 and abs(delta) / min(near)[0] * 100 >= 8:
            out[a[0]] = (len(near), round(delta, 6), step)
    return out


def test_busts_beside_coincident_shots(spark):
    rng = random.Random(5)
    rows = [(k, float(rng.randrange(20)), float(rng.randrange(20)), 10.0 + rng.choice([0, 0, 0, 0.5, 1.0, 0.02])) for k in range(500)]
    got = {r.point: (r.n, round(r.delta, 6), r.increment) for r in surfaces.rod_busts(spark.createDataFrame(rows, SCHEMA), 2.0).collect()}
    assert got == brute_busts(rows, 2.0) and len(got) > 20
    hot = [(k, 0.0, 0.0, 11.0) for k in range(5000)] + [(9001, 1.0, 0.0, 10.0), (9002, 0.0, 1.0, 10.0)]
    out = surfaces.rod_busts(spark.createDataFrame(hot, SCHEMA), 2.0).collect()
    assert len(out) == 5002 and all(r.n == (2 if r.point < 9000 else 5001) for r in out)


def test_several_files_have_no_order(spark, tmp_path):
    for name in ("a", "b"):
        (tmp_path / f"{name}.csv").write_text("Station,BS,FS\nA,1,\nB,,2\n")
    assert control_files.level_book(spark, str(tmp_path / "a.csv")).count() == 2
    with pytest.raises(ValueError, match="one file"):
        control_files.level_book(spark, str(tmp_path))


def test_dense_points_look_no_farther_than_they_need(spark):
    import math
    import random

    rng = random.Random(8)
    at = [(rng.gauss(0, 3), rng.gauss(0, 3)) for _ in range(400)] + [(rng.uniform(-60, 60), rng.uniform(-60, 60)) for _ in range(80)] + [(1.0, 1.0)] * 9
    frame = spark.createDataFrame([(k, n, e, 0.0) for k, (n, e) in enumerate(at)], "point_id long, northing double, easting double, elevation double")
    found = surfaces.nearest_neighbours(frame, 20.0)
    want = set()
    for k, (n, e) in enumerate(at):
        near = sorted((d, j) for j, (y, x) in enumerate(at) if j != k and (d := math.sqrt((n - y) ** 2 + (e - x) ** 2)) <= 20)[:6]
        want |= {(k, place, j) for place, (_, j) in enumerate(near, 1)}
    assert {(r.point, r.place, r.neighbour) for r in found.collect()} == want
    # Within 20 there are some 150,000 pairs; the cells by which points meet are those of their own reach.
    assert "reach" in found._jdf.queryExecution().optimizedPlan().toString()


def test_the_nearest_of_many_segments_is_reduced_without_sorting_pairs(spark):
    points = spark.createDataFrame([(1, 0.0, 5.0), (2, 3.0, 5.0), (3, 90.0, 5.0), (4, 1.0, 5.0)], "point_id long, northing double, easting double")
    lines = spark.createDataFrame([(7, 0.0, 0.0, 0.0, 10.0, 100.0), (5, 2.0, 0.0, 2.0, 10.0, 200.0), (6, 2.0, 10.0, 2.0, 0.0, 300.0)], "seq long, n1 double, e1 double, n2 double, e2 double, station double")
    found = surfaces.station_offset(points, lines, 15.0)
    assert {tuple(r) for r in found.collect()} == {(1, 7, 105.0, 0.0), (2, 5, 205.0, 1.0), (4, 5, 205.0, -1.0)}
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "min(rounded" in plan


def test_crossings_are_made_once(spark):
    """Flat crossings pass many cells together: each is one pair, without a grouping of the pairs."""
    from plumbline.operators import surfaces

    rows = [(i, 0.0, 0.3 * i, 400.0, 3.0 - 0.3 * i) for i in range(11)] + [(50, 200.0, -10.0, 200.0, 10.0), (60, 0.0, 0.0, 400.0, 300.0)]
    out = surfaces.crossings(spark.createDataFrame(rows, "seq long, n1 double, e1 double, n2 double, e2 double"), 50.0)
    got = sorted((r.seq_a, r.seq_b) for r in out.collect())
    turn = lambda a, b, c: (b[1] - a[1]) * (c[0] - a[0]) - (b[0] - a[0]) * (c[1] - a[1])
    ends = [(r[0], r[1:3], r[3:5]) for r in rows]
    want = [(i, j) for i, a, b in ends for j, c, d in ends if i < j and turn(a, b, c) * turn(a, b, d) < 0 and turn(c, d, a) * turn(c, d, b) < 0]
    assert len(want) > 50 and got == sorted(want)
    assert "Aggregate" not in out._jdf.queryExecution().optimizedPlan().toString()
