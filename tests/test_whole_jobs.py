"""Queries whose work must follow the whole table."""

from __future__ import annotations

import math
import random

import numpy as np
from pyspark.sql import functions as F

from plumbline.operators import rodshift
from plumbline.plans import surface_queries
from plumbline.plans.bindings import QUERIES
from plumbline.plans.registry import ORACLE_SQL


def test_every_supplier_is_in_a_ring(spark):
    points, obs = surface_queries.rings(spark.range(1, 22).select(F.col("id").alias("s_suppkey")))
    sizes = {r.network_id: r["count"] for r in points.groupBy("network_id").count().collect()}
    assert sizes == {0: 8, 1: 13}
    assert obs.count() == 3 * 21 and obs.join(points.selectExpr("network_id", "point_id AS to_id"), ["network_id", "to_id"]).count() == 63


def orders(spark, folder):
    rows = spark.range(8990, 9050).unionByName(spark.range(1, 40)).selectExpr("id AS o_orderkey", "id % 7 AS o_custkey", "id * 1.5D AS o_totalprice", "'2-HIGH' AS o_orderpriority")
    rows.write.parquet(f"{folder}/orders.parquet")


def test_revisions_of_all_ids_are_matched(spark, tmp_path):
    orders(spark, tmp_path)
    got = {r.point_id: (r.n_base, r.n_revised, r.status) for r in QUERIES["d26_revision_match_all"](spark, str(tmp_path)).collect()}
    fold = lambda p: p // 2 if p % 5 == 0 else p
    ids = [*range(8990, 9050), *range(1, 40)]
    a, b = [fold(p) for p in ids if p % 13 != 1], [fold(p) for p in ids if p % 11 != 1]
    assert {p: n[:2] for p, n in got.items()} == {p: (a.count(p), b.count(p)) for p in {*a, *b}}
    assert {"ambiguous", "added", "removed", "changed", "unchanged"} == {n[2] for n in got.values()}
    assert "9000" not in ORACLE_SQL["d26_revision_match_all"]


def test_every_point_has_its_offset(spark, tmp_path):
    rng = random.Random(5)
    at = [(rng.uniform(0, 0.06), rng.uniform(0, 0.06)) for _ in range(60)]
    frame = spark.createDataFrame([(i, [n, e, 0.0], 1) for i, (n, e) in enumerate(at)], "vec_id long, embedding array<double>, label int")
    frame.write.parquet(f"{tmp_path}/embeddings.parquet")

    def away(p, a, b):
        (n, e), (n1, e1), (n2, e2) = ((1000 * x for x in q) for q in (p, a, b))
        dn, de = n2 - n1, e2 - e1
        t = min(1, max(0, ((n - n1) * dn + (e - e1) * de) / (dn * dn + de * de)))
        return math.hypot(n - n1 - t * dn, e - e1 - t * de)

    want = {}
    for i, p in enumerate(at):
        distance, seq = min((away(p, at[k], at[k + 10]), k) for k in range(3, 50, 10))
        if distance <= 15:
            want[i] = (seq, round(distance, 4))
    got = {r.point_id: (r.seq, abs(r.offset)) for r in QUERIES["d25_station_offset_all"](spark, str(tmp_path)).collect()}
    assert {i: v[0] for i, v in got.items()} == {i: v[0] for i, v in want.items()} and any(i % 3 for i in got)
    assert all(math.isclose(got[i][1], want[i][1], abs_tol=2e-4) for i in got)


def test_every_control_is_compared_with_its_import(spark, tmp_path):
    rows = spark.range(40).selectExpr(
        "id % 20 AS l_partkey", "id AS l_orderkey", "1 AS l_linenumber", "2 AS l_suppkey", "id * 10.0D AS l_extendedprice", "5.0D AS l_quantity", "0.1D AS l_discount", "0.0D AS l_tax", "'R' AS l_returnflag", "DATE'2020-01-01' AS l_shipdate"
    )
    rows.write.parquet(f"{tmp_path}/lineitem.parquet")
    got = {r.point_id: (r.matches, r.overlap) for r in QUERIES["d2_import_overlap_all"](spark, str(tmp_path)).collect()}
    assert got == {f"P{k}": (4, "conflict" if k % 3 == 0 else "exact") for k in range(20)}


def test_chains_are_streamed_and_grouped_by_row_ranges(spark, monkeypatch):
    rng, s = np.random.default_rng(3), rodshift.Settings(most_rows=25)
    chains = {}
    for c in (None, 1, 2):
        x = np.cumsum(rng.choice([10.0, 2000.0], 900, p=[0.98, 0.02]))
        chains[c] = x, 0.01 * x + rng.normal(0, 0.01, 900) + np.repeat(rng.choice([0.0, 1.83], 60), 15)
    rows = [(c, k, float(x), float(z)) for c, xz in chains.items() for k, (x, z) in enumerate(zip(*xz))]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")
    try:
        monkeypatch.setattr(rodshift, "START_BUCKET", 16)
        events = rodshift.shift_events(spark.createDataFrame(rows, "chain_id int, seq int, chainage double, elevation double"), s)
        plan = events._jdf.queryExecution().toString()
        got = [tuple(r) for r in events.collect()]
        groups = sorted((r.first_seq, r.last_seq, r.n_points) for r in rodshift.event_groups(events, 5).collect())
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = [(c, a, b - 1, b - a, shift, spread, ok) for c, xz in chains.items() for a, b, shift, spread, ok in rodshift.scan_chain(*xz, s)]
    assert len(want) > 30 and sorted(got, key=repr) == sorted(want, key=repr)
    assert "FlatMapGroups" not in plan
    expected, open_ = [], {}
    for e in sorted(want, key=lambda e: e[1:3]):
        size = math.floor(e[4] / 0.5 + 0.5) if e[4] > 0 else -math.floor(-e[4] / 0.5 + 0.5)
        if size not in open_ or e[1] - open_[size][1] > 5:
            open_[size] = [e[1], e[2], 0]
            expected.append(open_[size])
        open_[size][1] = max(open_[size][1], e[2])
        open_[size][2] += e[3]
    assert groups == sorted(map(tuple, expected))


def test_pipes_of_one_place_meet_other_places_once(spark, monkeypatch):
    """Coincident structures are one place: 8 places make at most 56 pairs, whatever lies on them; the edges are those of all pairs of structures."""

    from plumbline.operators import evidence

    rng = random.Random(5)
    spots = [(rng.randrange(300) * 1.0, rng.randrange(300) * 1.0) for _ in range(8)]
    at = [(i, *spots[rng.randrange(8)]) for i in range(120)]
    angle = lambda: rng.choice([None, float(rng.randrange(0, 360, 7))])
    pipes = [(i, k, angle(), angle(), rng.choice([None, None, "to 3"])) for i in range(120) for k in (1, 2)]
    written, sizes = evidence.materialise, []
    monkeypatch.setattr(evidence, "materialise", lambda df, *a, **k: (lambda out: sizes.append(out.count()) or out)(written(df, *a, **k)))
    out = evidence.network_edges(
        spark.createDataFrame(pipes, "point_id long, pipe_index int, azimuth_deg double, leader_deg double, connected_raw string"), spark.createDataFrame(at, "point_id long, northing double, easting double"), 150.0
    )
    found = {(r.from_point, r.pipe_index): (r.to_point, r.to_pipe_index, r.score, r.status) for r in out.collect()}
    assert sizes and max(sizes) <= 56

    off = lambda a, b: abs((a - b + 180) % 360 - 180)
    place, backs, wanted = {i: (n, e) for i, n, e in at}, {}, {}
    for i, k, az, lead, _ in pipes:
        if az is not None or lead is not None:
            backs.setdefault(i, []).append((az if az is not None else lead, k))
    for i, k, az, lead, raw in pipes:
        direction, best = az if az is not None else lead, None
        if raw is not None or direction is None:
            continue
        for t, (n, e) in place.items():
            dn, de = n - place[i][0], e - place[i][1]
            distance, bearing = math.hypot(dn, de), math.degrees(math.atan2(de, dn)) % 360
            error = off(bearing, direction)
            if not 0 < distance <= 150 or error > 25:
                continue
            turned, pipe = min(((off(bearing + 180, b), j) for b, j in backs.get(t, [])), default=(None, None))
            full = 100 * (0.52 * (1 - error / 25) + 0.33 * (0 if turned is None else max(0, 1 - turned / 25)) + 0.15 * (1 - distance / 150))
            status = "REVIEW" if turned is not None and turned > 25 else "STRONG" if turned is not None and full >= 78 else "SUGGESTED"
            best = min(best or (1,), (-round(full + 1e-9, 1), t, pipe, status))
        if best:
            wanted[i, k] = (best[1], best[2], -best[0], best[3])
    assert {k: (found.get(k), wanted.get(k)) for k in found.keys() | wanted.keys() if found.get(k) != wanted.get(k)} == {}
    assert len(wanted) > 40


def test_clusters_keep_one_link_of_two_cells(spark, monkeypatch):
    """600 places in a small square are a few cells; the links between them don't grow with the places."""
    from plumbline.operators import graph, surfaces

    rng = random.Random(2)
    rows = [(i, rng.uniform(0, 20), rng.uniform(0, 20), None) for i in range(600)] + [(1000 + i, 100.0 + 20 * i, 0.0, None) for i in range(3)]
    written, sizes = graph.materialise, {}
    monkeypatch.setattr(graph, "materialise", lambda df, tag, **k: (lambda out: sizes.setdefault(tag, out.count()) and out)(written(df, tag, **k)))
    found = {r.node: r.component for r in surfaces.clusters(spark.createDataFrame(rows, "point_id long, northing double, easting double, elevation double"), 8.0).collect()}
    assert {k: v for k, v in found.items() if k < 1000} == dict.fromkeys(range(600), 0)
    assert sizes["edges"] < 800


def test_regroup_ranks_no_whole_cluster(spark):
    """The first free shot of a letter takes it, the later ones don't, and no window gathers a cluster's shots."""
    from plumbline.operators import control

    rows = [(i, "7A", 0.0) for i in range(5)] + [(i, "8B", 0.0) for i in (9, 7, 8)] + [(20, "8A", 0.0), (30, "9C", 500.0)]
    obs = spark.createDataFrame([(i, None, p, n, 0.0, None) for i, p, n in rows], "observation_id long, control_id string, point_id string, northing double, easting double, elevation double")
    out = control.regroup(obs, 1.0)
    got = {r.observation_id: (r.point_id, r.flag) for r in out.collect()}
    assert got[7] == ("7B", "PROBABLE_MISNUMBER") and {got[8], got[9]} == {("8B", "SPATIAL_ID_CONFLICT")} and got[20] == ("8A", "SPATIAL_ID_CONFLICT") and got[30] == ("9C", None)
    assert "observation_id" not in "".join(line for line in out._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Window" in line)


def test_small_networks_are_solved_in_several_tasks(spark):
    """Networks are few bytes, so that partitions joined by their size would leave one task to solve them all."""
    from plumbline.operators import networks, reference_networks

    rings = surface_queries.rings(spark.range(1, 161).select(F.col("id").alias("s_suppkey")))
    for solve, most in ((networks.snoop, 20), (networks.adjust_control, 20), (reference_networks.compare_adjustments, 20)):
        rows = solve(*rings).select("network_id", F.spark_partition_id().alias("task")).distinct().collect()
        assert len({r.network_id for r in rows}) == most and len({r.task for r in rows}) > 4
