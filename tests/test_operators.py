from __future__ import annotations

import math
import random

import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from plumbline.operators import control, evidence, graph, keyed, networks, quality, rodshift, sequential, surfaces

OBS = "control_id string, observation_id string, point_id string, northing double, easting double, elevation double, h_sigma double, v_sigma double, include boolean, observed timestamp"


def observations(spark, rows):
    import datetime

    start = datetime.datetime(2024, 1, 1)
    return spark.createDataFrame([(c, f"o{k:03d}", c, n, e, z, h, None, inc, start + datetime.timedelta(hours=2 * k)) for k, (c, n, e, z, h, inc) in enumerate(rows)], OBS)


def test_control_mean_and_pass(spark):
    rows = [("CP1", 100.00, 200.00, 10.00, None, True), ("CP1", 100.04, 200.00, 10.04, None, True), ("CP1", 100.02, 200.02, None, None, True), ("CP1", 999.0, 0.0, 0.0, None, False)]
    r = control.control_solutions(observations(spark, rows), htol=0.05, vtol=0.05).first()
    assert (r.n, round(r.mean_n, 6), round(r.mean_z, 6), r.passes) == (3, 100.02, 10.02, True)


def test_bad_sigmas_weigh_one(spark):
    rows = [("A", 0.0, 0.0, 0.0, 0.5, True), ("A", 1.0, 0.0, 0.0, -1.0, True), ("A", 2.0, 0.0, 0.0, float("nan"), True)]
    assert math.isclose(control.control_means(observations(spark, rows), weighted=True).first().mean_n, 3 / 6)


def test_best_triplets(spark):
    rows = [("7", 100, 200, 10), ("7", 100.020, 200.010, 10.010), ("7", 99.990, 199.995, 9.995), ("7", 100.2, 200.2, 10.2), ("8", 500, 600, 20), ("8", 500.12, 600, 20), ("8", 500, 600.12, 20.12), ("9", 1, 1, 1)]
    out = {r.control_id: r for r in control.best_triplets(observations(spark, [(c, float(n), float(e), float(z), None, True) for c, n, e, z in rows])).collect()}
    assert (out["7"].status, out["7"].id_a, out["7"].id_b, out["7"].id_c) == ("PASS", "o000", "o001", "o002")
    assert out["8"].status == out["9"].status == "RESHOOT" and out["9"].id_a is None


def test_too_many_combinations_need_review(spark):
    obs = observations(spark, [("A", float(i), 0.0, 0.0, None, True) for i in range(6)])
    assert control.best_triplets(obs, most=10).first().status == "REVIEW"


def gap_rows(spark, ids, *args, **kw):
    rows = spark.createDataFrame([(i,) for i in ids], "id long")
    return sorted(tuple(r) for r in keyed.gaps(rows, "id", *args, **kw).collect())


def test_gaps(spark):
    assert gap_rows(spark, [1, 2, 5, 8], 1, 10) == [(3, 4, 2), (6, 7, 2), (9, 10, 2)]
    assert gap_rows(spark, [1, 10_000_000_000]) == [(2, 9_999_999_999, 9_999_999_998)]
    assert gap_rows(spark, [], 100, 105) == [(100, 105, 6)]
    assert gap_rows(spark, [5, 5, None, -3], 7, 3) == [(3, 4, 2), (6, 7, 2)]


@settings(max_examples=4, deadline=None)
@given(st.sets(st.integers(0, 5_000_000), min_size=1, max_size=40))
def test_gaps_and_ids_tile_the_range(spark, ids):
    low, high = min(ids), max(ids)
    gaps = gap_rows(spark, ids, low, high)
    assert sum(n for _, _, n in gaps) + len(ids) == high - low + 1
    assert all(not any(a <= i <= b for i in ids) for a, b, _ in gaps)


def test_crew_ranges(spark):
    ids = spark.createDataFrame([(i,) for a, b in ((4000, 4434), (5000, 6090), (6215, 10664), (11000, 11500)) for i in range(a, b + 1)], "id long")
    out = {(r.first_id, r.last_id): (r.n_ids, r.priority) for r in keyed.crew_ranges(ids, "id").collect()}
    assert out == {(4435, 4999): (565, "Large gap"), (6091, 6214): (124, "Usable"), (10665, 10999): (335, "Recommended"), (12000, None): (None, "Safest")}


def test_point_diff(spark):
    p = "point_id string, northing double, easting double, elevation double, description string"
    base = spark.createDataFrame([("1", 0.0, 0.0, None, "a"), ("2", 1.0, 1.0, 1.0, None), ("5", 1.0, 1.0, None, None)], p)
    new = spark.createDataFrame([("1", 0.1, 0.0, None, "a"), ("3", 5.0, 5.0, 5.0, None), ("5", 1.0005, 1.0, 3.0, "")], p)
    assert {r.point_id: r.status for r in keyed.point_diff(base, new).collect()} == {"1": "changed", "2": "removed", "3": "added", "5": "unchanged"}


def test_hash_chain_finds_the_first_break(spark):
    import hashlib
    import json

    prev, rows = "", []
    for k in range(6):
        own = hashlib.sha256((prev + json.dumps({"action": f"a\"{k}é", "seq": k}, separators=(",", ":"), ensure_ascii=False)).encode()).hexdigest()
        rows.append(("p", k, f"a\"{k}é", prev, own))
        prev = own
    frame = lambda r: spark.createDataFrame(r, "project string, seq int, action string, prev_hash string, event_hash string")
    verify = lambda r: keyed.verify_chain(frame(r), "project", "seq", "seq", "action").first().broken_at
    assert verify(rows) is None
    assert verify([(*r[:2], "edited", *r[3:]) if r[1] == 3 else r for r in rows]) == 3


def test_overlaps_report_each_pair_once(spark):
    rnd = random.Random(1)
    make = lambda n: [(i, a := rnd.randint(0, 500), a + rnd.randint(0, 80)) for i in range(n)]
    a, b = make(60), make(60)
    frame = lambda r: spark.createDataFrame(r, "id long, start_id long, end_id long")
    got = sorted((r.id_a, r.id_b) for r in keyed.overlaps(frame(a), frame(b), 16).collect())
    assert got == sorted((x[0], y[0]) for x in a for y in b if x[1] <= y[2] and x[2] >= y[1])


def test_upsert_and_latest(spark):
    s = "k string, v int, version int"
    out = keyed.upsert(spark.createDataFrame([("a", 1, 1), ("b", 2, 1)], s), spark.createDataFrame([("b", 3, 2), ("c", 4, 1)], s), "k", "version")
    assert sorted(tuple(r) for r in out.collect()) == [("a", 1, 1), ("b", 3, 2), ("c", 4, 1)]


LEVEL = "run_id string, seq int, backsight double, foresight double, distance_bs double, distance_fs double"


def test_level_setups(spark):
    rows = spark.createDataFrame([("r", 1, 1.5, 1.0, None, None), ("r", 2, 1.0, 1.4, None, None)], LEVEL)
    out = sequential.level_setups(rows, 100.0, 100.05, "setups").orderBy("seq").collect()
    assert math.isclose(out[0].closure, 0.05, abs_tol=1e-9) and math.isclose(out[1].elevation, 100.05, abs_tol=1e-9)


def test_level_stations(spark):
    rows = spark.createDataFrame([("r", 1, 1.5, None, 30.0, None), ("r", 2, 2.0, 1.0, 30.0, 30.0), ("r", 3, None, 1.2, None, 30.0)], LEVEL)
    out = sequential.level_stations(rows, 100.0, 101.31, "setups").orderBy("seq").collect()
    assert [round(r.raw_elevation, 6) for r in out] == [100, 100.5, 101.3] and math.isclose(out[2].elevation, 101.31)


def test_level_separate(spark):
    rows = spark.createDataFrame([("r", 1, 1.5, None, None, None), ("r", 2, None, 1.0, None, None)], LEVEL)
    out = sequential.level_separate(rows, 100.0).orderBy("seq").collect()
    assert [(r.raw_elevation, r.role, r.closure) for r in out] == [(101.5, "HEIGHT_OF_INSTRUMENT", None), (100.5, "POINT", None)]


@pytest.mark.parametrize("method", ["bowditch", "transit"])
def test_traverse_closes(spark, method):
    rows = spark.createDataFrame([("t", k, float(a), d) for k, (a, d) in enumerate([(90, 100.0), (180, 100.0), (270, 100.0), (0, 99.9)])], "run_id string, seq int, azimuth_deg double, distance double")
    last = sequential.traverse(rows, 0.0, 0.0, method=method).orderBy("seq").collect()[-1]
    assert math.isclose(last.linear_closure, 0.1, abs_tol=1e-9) and abs(last.northing) < 1e-9 and abs(last.easting) < 1e-9


def test_a_bad_row_breaks_the_jump_chain(spark):
    rows = [("s", 1, 0.0, 0.0, 0.0), ("s", 2, 1.0, 0.0, None), ("s", 3, 2.0, 0.0, 5.0), ("s", 4, 3.0, 0.0, 9.0)]
    out = sequential.elevation_jumps(spark.createDataFrame(rows, "source_id string, seq int, northing double, easting double, elevation double"), 3.0, 10.0)
    assert [r.seq for r in out.collect()] == [4]


def test_linework(spark):
    """A line that is begun again before its end is REVIEW; curve faults are flags beside the status."""
    rows = [("500", k, c) for k, c in enumerate(["BS", "PC", "PT", "ES", None, "CL", "BS", None, "BS", "PC", "PC", "ES", "BS", "PT"])]
    rows += [("5001", 0, "BS"), ("5001", 9, "ES")]
    out = sequential.linework(spark.createDataFrame(rows, "line_id string, seq int, command string")).orderBy("line_id", "part").collect()
    assert [(r.line_id, r.vertices, r.status, r.flags) for r in out] == [
        ("500", 4, "COMPLETE", ""), ("500", 3, "COMPLETE_CLOSED", "NO_START"), ("500", 2, "REVIEW", "RESTARTED"), ("500", 4, "COMPLETE", "NESTED_PC,PC_OPEN"), ("500", 2, "OPEN", "NO_END,PT_WITHOUT_PC"), ("5001", 2, "COMPLETE", ""),
    ]


def test_alignment(spark):
    rows = [("a", 1, "tangent", 100.0, None, None, None), ("a", 2, "curve", None, 50.0, 90.0, "RIGHT"), ("a", 3, "tangent", 25.0, None, None, None)]
    out = sequential.horizontal_alignment(spark.createDataFrame(rows, "alignment_id string, seq int, kind string, length double, radius double, delta_deg double, direction string"), 0.0, 0.0, 0.0, 1000.0).orderBy("seq").collect()
    assert math.isclose(out[2].end_station, 1125 + 25 * math.pi) and math.isclose(out[2].end_n, 150) and math.isclose(out[2].end_e, 75) and math.isclose(out[2].azimuth_out, 90)


def test_an_azimuth_just_below_north_is_reduced_as_by_the_reference(spark):
    rows = [("a", 1, "curve", None, 50.0, 0.1, "LEFT"), ("a", 2, "curve", None, 50.0, 0.2, "LEFT"), ("a", 3, "tangent", 25.0, None, None, None)]
    out = sequential.horizontal_alignment(spark.createDataFrame(rows, "alignment_id string, seq int, kind string, length double, radius double, delta_deg double, direction string"), 0.0, 0.0, 0.3, 1000.0).orderBy("seq").collect()
    below = 0.3 + (-0.1 - 0.2)
    assert below < 0 and (out[1].azimuth_out, out[2].azimuth_in, out[2].azimuth_out) == (below % 360.0,) * 3 == (360.0,) * 3


def test_curve_stakes(spark):
    out = sequential.curve_stakes(spark.createDataFrame([("c", 1000.0, 100.0, 90.0)], "curve_id string, pc_station double, radius double, delta_deg double"), 50.0)
    assert sorted(round(r.station, 4) for r in out.collect()) == [1000, 1050, 1100, 1150, 1157.0796]


@pytest.mark.parametrize("reverse", [False, True])
def test_polygon_far_from_the_origin(spark, reverse):
    ring = [(0, 0), (0, 100.1), (200.2, 100.1), (200.2, 0)]
    ring = ring[::-1] if reverse else ring
    rows = [("p", k, 1e7 + n, 3e6 + e) for k, (n, e) in enumerate(ring)]
    r = surfaces.polygon_measures(spark.createDataFrame(rows, "polygon_id string, seq int, northing double, easting double")).first()
    assert math.isclose(r.area, 100.1 * 200.2, rel_tol=2e-8) and abs(r.centroid_n - 1e7 - 100.1) < 1e-7 and r.orientation == ("CW" if reverse else "CCW")


def test_earthwork(spark):
    s = spark.createDataFrame([("l", 1000.0, 40.0, 0.0), ("l", 1100.0, 20.0, 10.0)], "line_id string, station double, cut_area double, fill_area double")
    r = surfaces.average_end_area(s).orderBy("station").collect()[-1]
    assert (r.cut_volume, r.fill_volume, r.ordinate) == (3000, 500, 2500)
    p = "section_id string, offset double, elevation double"
    flat = lambda z: spark.createDataFrame([("s", -10.0, z), ("s", 10.0, z)], p)
    r = surfaces.cut_fill(flat(102.0), flat(100.0)).first()
    assert (r.cut_area, r.fill_area, r.width) == (40, 0, 20)
    r = surfaces.cut_fill(spark.createDataFrame([("s", -10.0, 99.0), ("s", 10.0, 101.0)], p), flat(100.0)).first()
    assert (r.cut_area, r.fill_area) == (5, 5)


def test_grid_pairs_equal_brute_force(spark):
    rnd = random.Random(3)
    pts = [(i, rnd.uniform(-50, 50), rnd.uniform(-50, 50), rnd.random()) for i in range(200)] + [(500, None, 1.0, 1.0)]
    got = {(r.id_a, r.id_b) for r in surfaces.grid_pairs(spark.createDataFrame(pts, "point_id int, northing double, easting double, elevation double"), 7.0).collect()}
    assert got == {(a[0], b[0]) for a in pts[:-1] for b in pts[:-1] if a[0] < b[0] and math.hypot(a[1] - b[1], a[2] - b[2]) <= 7}


def test_isolated_bust(spark):
    pts = [("100", 0.0, 0.0, 100.00), ("101", 5.0, 0.0, 100.02), ("102", 0.0, 5.0, 99.98), ("103", 4.0, 4.0, 101.00)]
    frame = spark.createDataFrame(pts, "point_id string, northing double, easting double, elevation double")
    out = surfaces.rod_busts(frame, 10.0).collect()
    assert [(r.point, r.increment) for r in out] == [("103", 1.0)] and out[0].confidence >= 50


def test_station_offset(spark):
    seg = spark.createDataFrame([(1, 0.0, 0.0, 100.0, 0.0, 1000.0)], "seq int, n1 double, e1 double, n2 double, e2 double, station double")
    pts = spark.createDataFrame([("a", 40.0, -10.0), ("b", 40.0, 500.0)], "point_id string, northing double, easting double")
    out = surfaces.station_offset(pts, seg, 20.0).collect()
    assert [(r.point_id, r.station, r.offset) for r in out] == [("a", 1040, 10)]


def test_components(spark):
    rnd = random.Random(5)
    edges = [(rnd.randint(0, 300), rnd.randint(0, 300)) for _ in range(220)] + [(k, k + 1) for k in range(1000, 1060)] + [(2000, k) for k in range(2001, 2100)] + [(5, 5), (None, 3)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    out = {r.node: r.component for r in graph.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert out == {x: find(x) for x in parent}
    assert graph.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


PLACES = "point_id int, northing double, easting double"


def test_outliers_and_scale(spark):
    rows = [(i, float(i % 5), float(i % 3)) for i in range(20)] + [(99, 3e3, 4e3), (100, None, 1.0), (101, float("nan"), 1.0)]
    assert [(r.point_id, round(r.distance)) for r in quality.mad_outliers(spark.createDataFrame(rows, PLACES)).collect()] == [(99, 4998)]
    same = [(i, 5.0, 5.0) for i in range(8)]
    assert quality.mad_outliers(spark.createDataFrame(same + [(9, 5.0, 900.0)], PLACES)).count() == 0
    assert [r.point_id for r in quality.mad_outliers(spark.createDataFrame(same + [(8, 5.0, 6.0), (10, 5.0, 7.0), (9, 5.0, 2000.0)], PLACES)).collect()] == [9]
    assert quality.mad_outliers(spark.createDataFrame(rows[:6] + rows[20:21], PLACES)).count() == 0
    r = quality.scale_factor(spark.createDataFrame([(1.0000878, 2.0), (1.0000712, 1.0)], "factor double, weight double")).first()
    assert 1.0000712 < r.k < 1.0000878


@settings(max_examples=10, deadline=None)
@given(st.lists(st.one_of(st.none(), st.sampled_from([1.0, 2.0, float("nan"), float("inf")]), st.floats(-1e6, 1e6)), max_size=40))
def test_exact_medians(spark, values):
    import statistics

    good = [v for v in values if v is not None and math.isfinite(v)]
    r = quality.exact_medians(spark.createDataFrame([(v,) for v in values], "v double"), m=F.col("v"), half=F.col("v") / 2).first()
    assert r.m == (statistics.median(good) if good else None) and (not good or math.isclose(r.half, statistics.median(good) / 2, abs_tol=1e-12))


def test_coordinate_sanity(spark):
    schema = "point_id string, northing double, easting double, crs string, horizontal_units string"
    near = [(str(i), 5000.0 + i, 6000.0 + i, "EPSG:1", "meters") for i in range(10)]
    one = lambda rows, *a: tuple(quality.coordinate_sanity(spark.createDataFrame(rows, schema), *a).first())
    assert one(near)[:2] == ("PASS", "")
    assert one([*near, ("x", float("nan"), 1.0, "EPSG:2", " ")])[:4] == ("WARN", "INVALID_COORDINATE_ROWS,MIXED_POINT_CRS", 11, 10)
    assert one([*near, ("x", 9e6, 1.0, "", "us_survey_feet")], "EPSG:1", "us_survey_feet")[1] == "SMALL_COORDINATE_MAGNITUDE,REMOTE_COORDINATE_OUTLIER,MIXED_POINT_UNITS"
    assert one([("a", 40.0, -100.0, "", "")], "EPSG:32617", "meters")[1] == "LATLON_IN_PROJECTED_PROJECT"
    assert one([])[0] == "NO_POINTS" and one([("a", float("inf"), 0.0, "", "")])[0] == "NO_VALID_COORDINATES"


def test_calibration_normalises_units_and_takes_the_latest(spark):
    schema = "run_id string, candidate_id string, decision string, scatter double, vertical_units string, seq int"
    row = lambda run, scatter, unit, decision="confirmed_bust", seq=0: (run, "RHB-1", decision, scatter, unit, seq)
    one = lambda rows: quality.calibration(spark.createDataFrame(rows, schema)).first()
    r = one([row("a", 0.03048, "meters"), row("b", 0.1, "international_feet")])
    assert (r.median_scatter_ft, r.suggested_ft) == (0.1, 0.2)
    r = one([row("a", 0.2, "meters", "not_bust", 2), row("a", 0.2, "meters", seq=1), row("b", 0.2, None), row("c", float("nan"), "meters")])
    assert (r.reviews, r.not_bust, r.excluded, r.suggested_ft) == (3, 1, 2, None)


EVIDENCE = "point_id string, class string, basis string, id_confidence double, value_confidence double, agrees boolean, decision string"


def test_votes_and_multisets(spark):
    record = lambda p, c, b, x=0.99, y=0.98: (p, c, b, x, y, None, None)
    rows = [
        record("1001", "CNA", "EXPLICIT_CNA"), record("b", "YES", "MEASUREMENT"), record("b", "NO", "EXPLICIT_NO"), record("c", "YES", "EXPLICIT_NO"), record("d", "YES", "EXPLICIT_YES", 0.8), record("e", "CNL", "EXPLICIT_CNL"), record("e", "YES", "AMBIGUOUS"),
    ]
    frame = spark.createDataFrame(rows, EVIDENCE)
    votes = {r.point_id: (r.status, r.confidence) for r in evidence.status_vote(frame).collect()}
    assert votes == {"1001": ("CNA", 0.98), "b": ("REVIEW", 0.98), "c": ("REVIEW", 0.98), "d": ("REVIEW", 0.8), "e": ("CNL", 0.98)}
    points = spark.createDataFrame([("1001",), ("e",), ("none",)], "point_id string")
    found = {r.point_id: (r.status, r.dip_status, r.review) for r in evidence.aggregate_results(points, frame).collect()}
    assert found == {"1001": ("YES", "CNA", False), "e": ("YES", "CNL", False), "none": ("NO", "NOT_FOUND", False)}
    dips = {r.point_id: r.status for r in evidence.aggregate_results(points, frame, rule="CONFIRMED_DIP").collect()}
    assert dips == {"1001": "CNA", "e": "CNL", "none": "NOT_FOUND"}
    items = [("p", 1, "x", 1), ("p", 2, "x", 2), ("p", 2, "x", 3), ("p", 3, "x", 4), ("p", 3, "x", 5)]
    assert evidence.multiset_union(spark.createDataFrame(items, "g string, rec int, pipe string, seq int"), "g", "rec", "pipe").count() == 2


def test_assessment_needs_independent_evidence(spark):
    schema = "k int, exact_ocr boolean, in_survey boolean, has_model boolean, agrees boolean, value_confidence double, basis string, page_type string"
    rows = [(1, True, True, True, True, 0.95, "MEASUREMENT", "utility"), (2, True, True, True, False, 0.95, "MEASUREMENT", "utility"), (3, False, True, True, True, 1.0, "MEASUREMENT", "utility"), (4, True, True, True, True, 1.0, "AMBIGUOUS", "level_loop"), (5, None, None, None, None, None, None, None)]
    out = {r.k: (r.score, r.decision, r.flags) for r in evidence.assess(spark.createDataFrame(rows, schema)).collect()}
    assert out == {
        1: (0.976, "AUTO_ACCEPT", ""), 2: (0.596, "REVIEW_DETAILS", "MODEL_DISAGREEMENT"), 3: (0.56, "MANUAL_REVIEW", "NO_INDEPENDENT_EXACT_POINTID"), 4: (0.89, "REVIEW_DETAILS", "AMBIGUOUS_SEMANTICS,NON_STRUCTURE_PAGE_CONTEXT"),
        5: (0.0, "MANUAL_REVIEW", "NO_INDEPENDENT_EXACT_POINTID,POINTID_NOT_IN_SURVEY,AMBIGUOUS_SEMANTICS"),
    }


def test_page_kinds(spark):
    rows = [(1, "MH 2437 DIP 4.62 8 PVC INV storm sewer rim 12.4"), (2, "BM 1 backsight 5.22 HI 105.22 TP1 foresight 4.80 elevation closure"), (3, "GNSS RTK control point northing easting datum occupation"), (4, None), (5, " .. a"), (6, "nothing known here")]
    out = {r.page_id: (r.kind, r.confidence) for r in evidence.classify_pages(spark.createDataFrame(rows, "page_id int, text string")).collect()}
    assert [out[k][0] for k in range(1, 7)] == ["utility", "level_loop", "control", "blank", "blank", "unknown"]
    assert out[1][1] >= 0.7 and out[4][1] == 0.96 and out[6][1] == 0.35


def test_smart_confidence(spark):
    schema = "point_id string, exact_ocr boolean, has_evidence boolean, n_agree int, n_disagree int, dip_status string, status string, has_dip boolean, bases array<string>, has_diameter boolean, has_azimuth boolean, code string, confirmed boolean, review boolean"
    rows = [
        ("a", True, True, 1, 0, "YES", "YES", True, ["MEASUREMENT"], True, True, "MH", False, False), ("b", False, True, 0, 1, "REVIEW", "REVIEW", True, [], True, True, "MH", False, True), ("c", False, False, 0, 0, "NOT_FOUND", "NO", False, [], False, False, "MH", True, False),
        ("d", True, True, 0, 0, "CNA", "YES", False, ["EXPLICIT_CNA"], False, False, None, False, False),
    ]
    out = {r.point_id: r.confidence for r in evidence.smart_confidence(spark.createDataFrame(rows, schema)).collect()}
    assert out == {"a": 100, "b": 23, "c": 25, "d": 45}


@pytest.mark.parametrize("units, ratio", [(("meters", "meters"), 1.0), (("international_feet", "meters"), 1 / 0.3048), (("us_survey_feet", "international_feet"), 0.3048 * 3937 / 1200)])
def test_pipe_grades(spark, units, ratio):
    """The invert of the pipe that the edge names at its end, not the lowest one there."""
    edges = spark.createDataFrame([("A", 1, "B", 1, 100.0), ("A", 2, "B", 1, 100.0), ("A", 1, "B", 9, 100.0), ("A", 1, "B", None, 100.0)], "from_point string, pipe_index int, to_point string, to_pipe_index int, distance double")
    inverts = spark.createDataFrame([("A", 1, 10.0), ("A", 2, 8.0), ("B", 1, 9.0), ("B", 2, 1.0)], "point_id string, pipe_index int, invert double")
    out = {r.pipe_index: (r.grade, r.flow, r.flag) for r in evidence.pipe_grades(edges, inverts, *units).collect()}
    assert {k: v[1:] for k, v in out.items()} == {1: ("from_to", ""), 2: ("to_from", "ADVERSE_GRADE")}
    assert math.isclose(out[1][0], ratio) and math.isclose(out[2][0], -ratio)
    with pytest.raises(ValueError):
        evidence.pipe_grades(edges, inverts, "feet")


def test_network_finds_the_pipe_ahead(spark):
    schema = "point_id string, pipe_index int, azimuth_deg double, leader_deg double, connected_raw string"
    pipes = spark.createDataFrame([("A", 1, 90.0, None, None), ("B", 1, 270.0, None, None), ("C", 1, None, 90.0, "?"), ("D", 1, 90.0, 90.0, "Az = to A"), ("C", 2, None, None, None), ("E", 1, 90.0, None, None), ("F", 1, 0.0, None, None)], schema)
    at = spark.createDataFrame([("A", 0.0, 0.0), ("B", 0.0, 100.0), ("FAR", 0.0, 100000.0), ("C", 1000.0, 0.0), ("D", 1000.0, 50.0), ("G", 1000.0, 100.0), ("E", 5000.0, 0.0), ("F", 5000.0, 100.0)], "point_id string, northing double, easting double")
    out = {(r.from_point, r.to_point): (r.status, r.to_pipe_index) for r in evidence.network_edges(pipes, at, 300.0).collect()}
    assert out == {("A", "B"): ("STRONG", 1), ("B", "A"): ("STRONG", 1), ("C", "G"): ("SUGGESTED", None), ("E", "F"): ("REVIEW", 1)} or out[("C", "D")][0] == "REVIEW"
    assert not any(a == "D" for a, _ in out)


def test_line_support_reaches_long_segments(spark):
    """A long mapped line that passes both ends supports an edge; its own ends are far away."""
    edges = spark.createDataFrame([(1, 80.0, 0.0, 0.0, 0.0, 100.0), (2, 80.0, 500.0, 0.0, 500.0, 100.0)], "edge_id int, score double, n1 double, e1 double, n2 double, e2 double")
    lines = spark.createDataFrame([(1, 3.0, 90_000.0, 3.0, -90_000.0)], "seq int, n1 double, e1 double, n2 double, e2 double")
    out = {r.edge_id: (r.support, r.combined) for r in evidence.line_support(edges, lines).collect()}
    assert math.isclose(out[1][0], 90.0) and out[1][1] == 82.0 and out[2] == (None, 80.0)


CHECKED = "control_id string, epoch_count int, duration_seconds double, satellite_count int, pdop double, observed string"


def test_field_checks(spark):
    rows = [
        ("pass", 300, None, 5, 9.0, "2024-05-01 10:00:00"), ("pass", None, 400.0, 6, None, "05/01/2024 11:00"), ("short", 100, None, 9, 1.0, "2024-05-01T10:00:00Z"), ("short", 500, None, 9, 1.0, "2024-05-01T12:00:00Z"),
        ("unknown", None, None, 9, 1.0, "2024-05-01 10:00"), ("unknown", 400, None, 9, 1.0, "2024-05-01 13:00"), ("close", 400, None, 9, 1.0, "23:50"), ("close", 400, None, 9, 1.0, "00:10:00"), ("mixed", 400, None, 9, 1.0, "10:00"), ("mixed", 400, None, 9, 1.0, "2024-05-01 10:00"),
        ("one", 400, None, 9, 1.0, "10:00"), ("offset", 400, None, 9, 1.0, "2024-05-01T10:00:00+02:00"), ("offset", 400, None, 9, 1.0, "2024-05-01T10:00:00Z"),
    ]
    frame = spark.createDataFrame(rows, CHECKED)
    out = {r.control_id: (r.field_status, r.least_gap_minutes) for r in control.field_checks(frame).collect()}
    assert out == {
        "pass": ("PASS", 60.0), "short": ("FAIL", 120.0), "unknown": ("UNVERIFIED", 180.0), "close": ("FAIL", 20.0), "mixed": ("UNVERIFIED", None), "one": ("UNVERIFIED", None), "offset": ("PASS", 120.0),
    }
    limited = {r.control_id: r.field_status for r in control.field_checks(frame, most_pdop=3.0).collect()}
    assert limited["pass"] == "FAIL" and limited["offset"] == "PASS"


def test_clusters_of_coincident_points(spark):
    """Five thousand shots at one place are one place: nothing makes all their pairs."""
    rows = [(i, 100.0, 200.0) for i in range(5000)] + [(6000, 103.0, 200.0), (6001, 109.0, 200.0), (7000, 200.0, 200.0), (None, 103.0, 200.0)]
    frame = spark.createDataFrame(rows, PLACES).withColumn("elevation", F.lit(None).cast("double"))
    out = {r.node: r.component for r in surfaces.clusters(frame.where("point_id is not null"), 5.0).collect()}
    assert out == {i: 0 for i in [*range(5000), 6000]}
    near = surfaces.nearest_neighbours(frame.where("point_id is not null"), 5.0)
    assert near.count() == 5001 * 6
    assert [r.neighbour for r in near.where("point = 3").orderBy("place").collect()] == [0, 1, 2, 4, 5, 6]


def test_long_ranges_overlap_without_many_rows(spark):
    side = lambda rows: spark.createDataFrame(rows, "id int, start_id long, end_id long")
    a = [(1, 0, 10**15), (2, 5, 5), (3, 100, 90), (4, 63, 64)]
    b = [(7, 10**9, 10**9 + 3), (8, 64, 64), (9, -5, 5), (10, 10**15, 10**16)]
    got = {(r.id_a, r.id_b, r.from_id, r.to_id) for r in keyed.overlaps(side(a), side(b), 64).collect()}
    assert got == {(i, j, max(s, u), min(e, v)) for i, s, e in a for j, u, v in b if s <= e and s <= v and e >= u}


def test_control_network():
    points = pd.DataFrame([("A", 0.0, 0.0, True), ("B", 0.0, 100.0, True), ("C", 100.0, 0.0, True), ("P", 31.0, 39.0, False)], columns=["point_id", "northing", "easting", "fixed"])
    obs = pd.DataFrame([(k, "distance", f, "P", "", d, 0.01) for k, (f, d) in enumerate([("A", 50.0), ("B", math.hypot(30, 60)), ("C", math.hypot(70, 40))])], columns=["ord", "kind", "from_id", "to_id", "target2_id", "value", "sigma"])
    solved, res = networks.solve_control(points, obs)
    assert abs(solved.northing[0] - 30) < 1e-6 and abs(solved.easting[0] - 40) < 1e-6 and solved.dof[0] == 1 and math.isclose(res.redundancy.sum(), 1)


def test_mixed_network_converges():
    points = pd.DataFrame([("A", 0.0, 0.0, True), ("B", 0.0, 100.0, True), ("P", 31.0, 39.0, False)], columns=["point_id", "northing", "easting", "fixed"])
    az = lambda n, e: math.degrees(math.atan2(e, n)) % 360
    rows = [("distance", "A", "P", "", 50.0, 0.01), ("distance", "B", "P", "", math.hypot(30, 60), 0.01), ("azimuth", "A", "P", "", az(30, 40), 0.001), ("azimuth", "B", "P", "", az(30, -60), 0.001), ("angle", "A", "P", "B", (az(0, 100) - az(30, 40)) % 360, 0.001)]
    obs = pd.DataFrame([(k, *r) for k, r in enumerate(rows)], columns=["ord", "kind", "from_id", "to_id", "target2_id", "value", "sigma"])
    solved, res = networks.solve_control(points, obs)
    assert abs(solved.northing[0] - 30) < 1e-6 and solved.dof[0] == 3 and math.isclose(res.redundancy.sum(), 3)


def test_level_network(spark):
    points = spark.createDataFrame([(1, "A", 100.0, True), (1, "B", None, False), (1, "C", None, False)], "network_id int, point_id string, elevation double, fixed boolean")
    obs = spark.createDataFrame([(1, 1, "A", "B", 1.0, 0.01), (1, 2, "B", "C", 1.02, 0.01), (1, 3, "A", "C", 2.01, 0.01)], "network_id int, ord int, from_id string, to_id string, delta_elevation double, sigma double")
    out = {r.point_id: r for r in networks.adjust_levels(points, obs).collect()}
    assert math.isclose(out["B"].elevation, 100.9966667, abs_tol=1e-6) and math.isclose(out["C"].elevation, 102.0133333, abs_tol=1e-6) and out["B"].dof == 1


def test_level_network_negatives():
    points = pd.DataFrame([("A", 100.0, True), ("B", None, False), ("C", None, False)], columns=["point_id", "elevation", "fixed"])
    obs = pd.DataFrame([(1, "A", "B", 1.0, 0.01)], columns=["ord", "from_id", "to_id", "delta_elevation", "sigma"])
    with pytest.raises(ValueError, match="rank"):
        networks.solve_levels(points, obs)
    obs = pd.DataFrame([(k, "A", "B", d, 0.01) for k, d in enumerate((10.0, 10.0, 50.0))], columns=["ord", "from_id", "to_id", "delta_elevation", "sigma"])
    with pytest.raises(ValueError, match="converge"):
        networks.solve_levels(points.iloc[:2], obs, robust=True, rounds=1)


def demo_chain(shift=-1.83, stations=10):
    import numpy as np

    x = np.arange(stations) * 25.0
    return x, 100 + 0.01 * x + np.where((np.arange(stations) >= 3) & (np.arange(stations) <= 6), shift, 0.0)


def test_rod_shift_scan():
    found = rodshift.scan_chain(*demo_chain(), rodshift.Settings())
    assert [(a, b, ok) for a, b, _, _, ok in found] == [(3, 7, True)] and math.isclose(found[0][2], -1.83, abs_tol=1e-9)
    assert rodshift.scan_chain(*demo_chain(0.1), rodshift.Settings()) == [] == rodshift.scan_chain(*demo_chain(0.0), rodshift.Settings())


def test_rod_shift_candidate(spark):
    rows = [(f"c{lane}", 5 * k + lane, float(x), float(z)) for lane in range(5) for k, (x, z) in enumerate(zip(*demo_chain()))]
    events = rodshift.shift_events(spark.createDataFrame(rows, "chain_id string, seq int, chainage double, elevation double"))
    r = rodshift.event_groups(events, 5).first()
    assert (r.chains, r.n_points, r.status, round(r.correction, 6)) == (5, 20, "PROBABLE", 1.83)


def test_corrections(spark):
    pts = spark.createDataFrame([("a", 1.0), ("b", 2.0)], "point_id string, elevation double")
    fix = lambda r: rodshift.corrected_points(pts, spark.createDataFrame(r, "point_id string, correction double"))
    assert sorted(tuple(r) for r in fix([("a", 1.83), ("a", 1.83)]).collect()) == [("a", 2.83), ("b", 2.0)]
    with pytest.raises(Exception, match="differ"):
        fix([("a", 1.0), ("a", 2.0)]).collect()


def test_health_and_browse(spark):
    pts = spark.createDataFrame([("a", 1.0), ("b", None)], "point_id string, z double")
    rules = spark.createDataFrame([("NO_Z", True, "WARN", 0), ("NO_ID", False, "ERROR", 0)], "check string, enabled boolean, severity string, threshold long")
    out = {r.check: (r.bad_rows, r.status) for r in quality.health(pts, rules, {"NO_Z": F.col("z").isNull(), "NO_ID": F.col("point_id").isNull()}).collect()}
    assert out == {"NO_Z": (1, "WARN"), "NO_ID": (0, "SKIP")}
    assert [r.point_id for r in quality.browse(pts, "B", "point_id").collect()] == ["b"]


def test_code_match(spark):
    rules = spark.createDataFrame([(1, "EXACT", "DBL GI", "Double"), (2, "STARTS_WITH", "STM", "Storm"), (3, "CONTAINS", "MH", "Manhole")], "rule int, match string, pattern string, category string")
    pts = spark.createDataFrame([("1000", "dbl gi"), ("1001", "EP"), ("1002", "STM MH")], "point_id string, code string")
    assert {r.point_id: r.category for r in quality.match_codes(pts, rules).collect()} == {"1000": "Double", "1001": None, "1002": "Storm"}


def test_events_are_correlated_greedily(spark):
    """The newest group that fits, held against the rule written down over all groups."""
    rnd = random.Random(12)
    limits = rodshift.Correlation(rows=5, tolerance=0.2, distance=60.0)
    rows = []
    for run in ("a", "b", None):
        for k in range(120):
            first = rnd.randint(0, 150)
            rows.append((run, first, first + rnd.randint(0, 8), rnd.randint(0, 4), round(rnd.choice((0.5, 1.0)) + rnd.uniform(-0.2, 0.2), 3), rnd.uniform(0, 100), rnd.uniform(0, 100), k))
    frame = spark.createDataFrame(rows, "run_id string, first_seq int, last_seq int, chain_id int, shift double, northing double, easting double, k int").dropDuplicates(["run_id", "first_seq", "chain_id"])
    got = {}
    for r in rodshift.correlated(frame, limits).collect():
        got.setdefault((r.run_id, r.grp), set()).add(r.k)
    want = set()
    for run in ("a", "b", None):
        groups = []
        for e in sorted((r for r in frame.collect() if r.run_id == run), key=lambda r: (r.first_seq, r.chain_id)):
            for g in reversed(groups):
                near = e.first_seq - min(x.first_seq for x in g) <= 5 and e.first_seq <= max(x.last_seq for x in g) + 5 and math.hypot(e.northing - g[0].northing, e.easting - g[0].easting) <= 60
                if near and all(abs(e.shift - x.shift) <= 0.2 + 1e-12 and x.chain_id != e.chain_id for x in g):
                    g.append(e)
                    break
            else:
                groups.append([e])
        want |= {frozenset(x.k for x in g) for g in groups}
    assert {frozenset(v) for v in got.values()} == want


def test_rod_candidates_weigh_hazards_and_conflicts(spark):
    role = {10: "setup", 14: "surface", 30: "ditch", 55: "unknown"}
    points = spark.createDataFrame([("r", i, float(i * 10), 0.0 if i != 30 else 5.0, role.get(i, "surface")) for i in range(60)], "run_id string, seq int, northing double, easting double, role string")
    chains = {1: ("EP", (11, 13)), 2: ("CL", (12,)), 3: ("GS", (28, 29)), 4: ("GS", (50,)), 5: ("EP", (51,)), 6: ("CL", (52,)), 7: ("TB", (53,)), 8: ("FL", (54,))}
    nodes = [("r", c, i, 0.5, f) for c, (f, own) in chains.items() for i in own] + [("r", 1, 16, 0.0, "EP")]
    nodes = spark.createDataFrame(nodes, "run_id string, chain_id int, seq int, offset double, feature string")
    events = [("r", own[0], own[-1], c, 0.5, own[0] * 10.0, 0.0, True) for c, (_, own) in chains.items()]
    events = spark.createDataFrame(events, "run_id string, first_seq int, last_seq int, chain_id int, shift double, northing double, easting double, recovered boolean")
    out = {r.first_seq: r for r in rodshift.rod_candidates(points, nodes, events, confirmed=True).collect()}
    assert sorted(out) == [11, 28, 50]
    a, b, c = out[11], out[28], out[50]
    assert (a.chains, a.features, a.score, a.status, a.conflicting) == (2, 2, 16 + 25 + 15 + 10 + 10, "REVIEW", 0)
    assert (b.score, b.status) == (8 + 25 + 10 - 30, "SUPPRESSED") and b.correction is None
    assert (c.chains, c.score, c.status, c.unknown, c.correction) == (5, 40 + 25 + 10 + 10, "PROBABLE", 0, -0.5)


def test_rechecked_sights(spark):
    rows = spark.createDataFrame([("r", 1, "A", 1.0, None), ("r", 2, "B", 1.1, 1.2), ("r", 3, "C", None, 1.3)], "run_id string, sequence_no int, point_id string, backsight double, foresight double")
    ask = spark.createDataFrame([("r", "station_rows", 1), ("r", "station_rows", 3), ("r", "other", 2)], "run_id string, layout string, setup_no int")
    out = {(r.setup_no, r.side): (r.sequence_no, r.point_id, r.complete) for r in sequential.recheck_sights(rows, ask).collect()}
    assert out == {(1, "BS"): (1, "A", True), (1, "FS"): (2, "B", True), (3, "BS"): (3, "C", False), (3, "FS"): (4, None, False)}
    separate = sequential.recheck_sights(rows, ask.selectExpr("run_id", "'separate_sights' AS layout", "1 AS setup_no").limit(1)).collect()
    assert sorted((r.side, r.sequence_no) for r in separate) == [("BS", 1), ("FS", 2)]
    back = spark.createDataFrame([("r", 2, "FS", 9.0, 1), ("r", 2, "FS", 9.5, 2), ("r", 1, "BS", 8.0, 1)], "run_id string, sequence_no int, side string, reading double, seq int")
    got = {r.sequence_no: (r.backsight, r.foresight) for r in sequential.replaced_sights(rows, back).collect()}
    assert got == {1: (8.0, None), 2: (1.1, 9.5), 3: (None, 1.3)}
