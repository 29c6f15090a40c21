from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.functions import cogo, ids
from plumbline.operators import evidence, reviews


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_codes_by_rule_range_and_unknown(spark):
    points = spark.createDataFrame([(1, "604-a-BS"), (2, "639"), (3, "640"), (4, None), (5, " ec x")], "point_id long, code string")
    rules = spark.createDataFrame([("604", "Ground", "surface"), ("EC", "Edge", "surface")], "code string, description string, role string")
    assert {r.point_id: (r.base, r.role) for r in reviews.classify_codes(points, rules).collect()} == {1: ("604", "surface"), 2: ("639", "structure"), 3: ("640", "unknown"), 4: ("?", "unknown"), 5: ("EC", "surface")}


def test_picked_rows_keep_their_order(spark):
    obs = spark.createDataFrame([("A", 1, True), ("A", 2, False), ("B", 3, True), ("B", 4, False)], "control_id string, observation_id long, include boolean")
    picks = spark.createDataFrame([("A", [2, 99, 1])], "control_id string, observation_ids array<long>")
    assert rows(reviews.solver_rows(obs, picks).select("control_id", "observation_id", "position")) == [("A", 1, 2), ("A", 2, 0), ("B", 3, None)]


def test_metadata_fills_blanks_only(spark):
    now = spark.createDataFrame([("p1", "", 0, "x"), ("P2", "fixed", 5, "y"), (None, None, None, "z")], "id string, fix string, n int, extra string")
    new = spark.createDataFrame([("P1", 1, "old", 1), ("P1", 2, "float", 7), ("p2", 1, "float", 9), (None, 1, "q", 1), ("p9", 1, "q", 1)], "id string, seq int, fix string, n int")
    assert rows(reviews.fill_metadata(now, new, "id", "seq", "fix", "n")) == [("P2", "fixed", 5, "y", []), ("p1", "float", 7, "x", ["fix", "n"]), (None, None, None, "z", [])]


def test_occupations_take_first_and_most(spark):
    got = spark.createDataFrame([("p", 2, "b", 3, 1.0), ("p", 1, "", 9, None), ("p", 3, "c", None, 2.5), ("q", 1, None, None, None)], "id string, seq int, fix string, n int, pdop double")
    assert rows(reviews.merge_occupations(got, "id", "seq", ("fix",), ("n", "pdop"))) == [("p", "b", 9, 2.5), ("q", None, None, None)]


def test_photos_match_one_id(spark):
    names = ["a/7/IMG_12.jpg", "a/12-13.jpg", "b/x99.jpg", "1234567890123.jpg", "a/12-12.v7.jpg", None]
    files = spark.createDataFrame([(n,) for n in [*names, names[0]]], "path string")
    got = {r.path: (r.point_id, r.status) for r in reviews.photo_matches(files, spark.createDataFrame([(" 12 ",), ("13",), ("7",), (None,)], "point_id string")).collect()}
    assert got == {names[0]: ("12", "matched"), names[1]: (None, "ambiguous"), names[2]: (None, "unmatched"), names[3]: (None, "unmatched"), names[4]: (None, "ambiguous")}


def test_drawing_children_never_match(spark):
    kind = "entity_id string, g string, h string"
    a = spark.createDataFrame([("1", "x", None), ("2", "x", "y"), ("3", "x", ""), ("4/1", "x", "")], kind)
    b = spark.createDataFrame([("1", "x", None), ("2", "x", None), ("4/1", "x", ""), ("5", None, None)], kind)
    assert rows(reviews.drawing_diff(a, b, "g", "h")) == [("1", "unchanged"), ("2", "changed_candidate"), ("3", "before_only"), ("4/1", "after_only"), ("4/1", "before_only"), ("5", "after_only")]


def test_counts_of_two_states(spark):
    kind = "metric string, n long"
    assert rows(reviews.compare_counts(spark.createDataFrame([("a", 2), ("b", 1)], kind), spark.createDataFrame([("a", 5), ("c", 4)], kind))) == [("a", 2, 5, 3), ("b", 1, 0, -1), ("c", 0, 4, 4)]


def test_links_treat_null_as_equal(spark):
    c = spark.createDataFrame([(1, "h", "p", 1.0, 2.0, None), (2, "h", "p", 1.0, 2.0, 3.0)], "candidate_id int, source_hash string, point_id string, northing double, easting double, elevation double")
    p = c.drop("candidate_id").where("elevation is null").selectExpr("*", "'u' AS point_uuid")
    assert rows(reviews.evidence_links(c, p)) == [(1, "u")]


def test_gaps_exclude_ends_that_meet(spark):
    ends = spark.createDataFrame([(1, 0.0, 0.0), (2, 0.0, 0.0), (3, 0.05, 0.0), (4, 0.5, 0.0), (5, None, 0.0)], "end_id long, northing double, easting double")
    assert [(r.end_a, r.end_b, r.within) for r in reviews.endpoint_gaps(ends, 0.46, 0.1).orderBy("end_a", "end_b").collect()] == [(1, 3, True), (2, 3, True), (3, 4, False)]


def test_truth_records_round_and_wrap(spark):
    pipes = spark.createDataFrame([("p", 2, 8.0, None, -10.0), ("p", 1, None, 1.23449, 360.0)], "point_id string, pipe_no int, diameter double, dip double, azimuth double")
    assert rows(reviews.truth_records(pipes)) == [("p", "-/1.234/0.0;8.00/-/350.0")]


def test_decimation_keeps_the_last_vertex(spark):
    line = lambda n, e=None: [("a", i, float(i if e is None else e), 0.0) for i in range(n)]
    kept = lambda v, most: [r.seq for r in reviews.decimated(spark.createDataFrame(v, "line_id string, seq int, northing double, easting double"), most).orderBy("seq").collect()]
    assert kept(line(10), 4) == [0, 3, 6, 9] and kept(line(9), 4) == [0, 3, 6, 8] and kept(line(9, 1.0), 4) == [0, 3, 6] and kept(line(3), 4) == [0, 1, 2] and kept([], 4) == []


def test_returns_are_finite_and_first(spark):
    req = spark.createDataFrame([("r", 1, 10.0, 20.0, None), ("r", 2, 0.0, 0.0, 0.0), ("s", 3, 1.0, 1.0, 1.0)], "request_id string, point_id int, northing double, easting double, elevation double")
    ret = spark.createDataFrame([("r", 1, 1, float("nan"), None, None), ("r", 1, 2, 11.0, float("inf"), 5.0), ("r", 1, 3, 99.0, 0.0, 0.0), ("s", 3, 1, None, None, 2.0), ("x", 9, 1, 1.0, 1.0, 1.0)], "request_id string, point_id int, seq int, northing double, easting double, elevation double")
    assert rows(reviews.returned_deltas(req, ret).select("request_id", "point_id", "d_northing", "d_easting", "d_elevation", "returned", "status")) == [("r", 1, 1.0, None, None, True, "open"), ("r", 2, None, None, None, False, "open"), ("s", 3, None, None, 1.0, True, "returned")]


def test_states_unions_and_superseded(spark):
    ids = lambda *v: spark.createDataFrame([(x, "DONE") for x in v], "point_id int, status string")
    assert rows(reviews.pending_union(ids(1), ids(1, 2, 2))) == [(1, "DONE"), (2, "PENDING")]
    assert rows(reviews.point_states(ids(1, 2, 3), ids(1, 1), ids(1, 2))) == [(1, "INTERPRETED"), (2, "OCR_FOUND"), (3, "PENDING_OCR")]
    issues = spark.createDataFrame([("LEVEL_A", "m", "OPEN"), ("level_b", "m", "CLOSED"), ("level_c", "n", "OPEN"), (None, "m", "OPEN")], "code string, module string, status string")
    assert [r.status for r in reviews.supersede(issues, "m", "level_").collect()] == ["SUPERSEDED", "CLOSED", "OPEN", "OPEN"]


def test_first_unmatched_and_segments(spark):
    items = spark.createDataFrame([(1, 5, None, 0.50001, "r", [1]), (2, 5, "", 0.5, "r", [1]), (3, 5, "", 0.6, "r", [1])], "seq int, page_id int, point_id_raw string, confidence double, reason string, bbox array<int>")
    assert [r.seq for r in reviews.first_unmatched(items, "seq").orderBy("seq").collect()] == [1, 3]
    v = spark.createDataFrame([("a", 1, 0.0, 0.0), ("a", 2, 1.0, 1.0), ("b", 1, 0.0, 0.0)], "line_id string, seq int, northing double, easting double")
    assert rows(reviews.line_segments(v).drop("seq")) == [("a", 0.0, 0.0, 1.0, 1.0)]


def test_verified_rows_need_the_stored_hash(spark):
    points = spark.createDataFrame([("p", 1, "h"), ("q", 2, "h")], "point_id string, source_id int, source_hash string")
    sources = spark.createDataFrame([(1, "h"), (2, "other")], "source_id int, sha256 string")
    source_rows = spark.createDataFrame([(1, "p", 1.0), (1, "p", 2.0), (1, "q", 3.0), (2, "q", 4.0)], "source_id int, point_id string, v double")
    assert rows(reviews.verified_rows(points, sources, source_rows).select("v")) == [(1.0,), (2.0,)]


def test_notes_name_edges_and_geometry_checks_them(spark):
    structures = spark.createDataFrame([("A", 0.0, 0.0), ("b", 100.0, 0.0), ("C", None, 0.0)], "point_id string, northing double, easting double")
    pipes = spark.createDataFrame(
        [("A", 1, 5.0, None, "to B"), ("A", 2, 90.0, None, "b"), ("A", 3, None, None, "to C"), ("A", 4, None, None, "A"), ("A", 5, None, None, "#77"), ("A", 6, None, None, None), ("A", 7, None, 170.0, "b"), ("b", 1, None, 185.0, "two words")],
        "point_id string, pipe_index int, azimuth_deg double, leader_deg double, connected_raw string",
    )
    got = {r.pipe_index: (r.to_point, r.status, r.score, r.reciprocal_error) for r in evidence.explicit_edges(pipes, structures).collect()}
    assert got == {1: ("b", "STRONG", 95.0, 5.0), 2: ("b", "REVIEW", 65.0, 5.0), 3: ("C", "STRONG", 85.0, None), 4: ("A", "SELF", None, None), 5: (None, "MISSING", None, None), 7: ("b", "REVIEW", 65.0, 5.0)}
    assert evidence.explicit_edges(pipes.limit(0), structures).count() == 0


def test_roles_and_areas(spark):
    df = spark.createDataFrame([("Retaining WALL ditch", "discontinuity"), ("side ditch", "ditch"), ("Power pole", "support"), ("", "unknown"), (None, "unknown")], "t string, want string")
    assert all(r.got == r.want for r in df.select("want", ids.suggested_role(F.col("t")).alias("got")).collect())
    row = spark.range(1).select(*[cogo.inside_area(F.lit(x), F.lit(2.0), -1.0, 0.0, 5.0, 2.0).alias(n) for x, n in ((5.0, "a"), (5.1, "b"))]).first()
    assert (row.a, row.b) == (True, False)
