from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from plumbline.functions import cogo, ids, measures


def value(spark, column, **types):
    return spark.range(1).select(column.alias("v")).first().v


def lit(x):
    return F.lit(float(x))


@pytest.mark.parametrize(("point_id", "base", "suffix"), [("7A", "7", "A"), ("CP-12ab", "CP-12", "AB"), ("100", "100", ""), ("BASE", "BASE", ""), ("A-12", "A-12", "")])
def test_control_ids(spark, point_id, base, suffix):
    b = ids.base_control_id(F.lit(point_id))
    assert value(spark, b) == base and value(spark, ids.shot_suffix(F.lit(point_id), b)) == suffix


@pytest.mark.parametrize(("raw", "want"), [("1000.0", "1000"), ("001000", "001000"), ("A-12", "A-12"), (" 7.50 ", "7.50")])
def test_point_ids(spark, raw, want):
    assert value(spark, ids.normal_point_id(F.lit(raw))) == want


@pytest.mark.parametrize(("letters", "number"), [("", 0), ("A", 1), ("Z", 26), ("AA", 27), ("ZZ", 702), ("AAA", 703)])
def test_bijective_letters(spark, letters, number):
    assert value(spark, ids.letters_to_number(F.lit(letters))) == number
    assert value(spark, ids.number_to_letters(F.lit(number))) == letters


def test_reshoot_labels(spark):
    assert value(spark, ids.next_reshoot_labels(F.lit("8"), F.array(*map(F.lit, "ABC")), 3)) == ["8D", "8E", "8F"]


def test_code_parts(spark):
    got = value(spark, ids.code_parts(F.lit(" ec-12-pc-a-BS later words-ES")))
    assert (got.base, got.string_id, got.commands) == ("EC", "12-A", ["BS", "PC"])
    assert value(spark, ids.code_parts(F.lit("604"))).base == "604" and value(spark, ids.code_parts(F.lit(None).cast("string"))).base == ""
    assert value(spark, ids.code_parts(F.lit(""))).base == ""


@pytest.mark.parametrize(("raw", "want"), [("to 3394", "3394"), ("#12a", "12a"), ("MH-7.b", "MH-7.b"), ("flows To: pt# 9", "pt"), ("two words", None), ("", None)])
def test_destinations(spark, raw, want):
    assert value(spark, ids.destination_ref(F.lit(raw))) == want


@pytest.mark.parametrize(("text", "want"), [("1.5", 1.5), ("nan", None), ("inf", None), ("-inf", None), ("bad", None), ("", None), ("1e3", 1000.0)])
def test_finite(spark, text, want):
    assert value(spark, measures.finite(F.lit(text))) == want


@pytest.mark.parametrize(("text", "want"), [("5 min", 300), ("1:02:03", 3723), ("2:30", 150), ("90", 90), ("1.5 h", 5400), ("soon", None)])
def test_durations(spark, text, want):
    assert value(spark, measures.duration_seconds(F.lit(text))) == want


def test_times_and_units(spark):
    assert value(spark, measures.observed_time(F.lit("03/04/2024 05:06"))).isoformat() == "2024-03-04T05:06:00"
    assert value(spark, measures.observed_time(F.lit("yesterday"))) is None
    assert value(spark, measures.unit_factor(F.lit("US_FT"))) == 1200 / 3937
    assert value(spark, measures.unit_factor(F.lit("rod"))) is None


@pytest.mark.parametrize(("c", "o", "want"), [(10, 350, 20), (350, 10, -20), (0, 180, -180)])
def test_angles(spark, c, o, want):
    assert value(spark, measures.angle_difference(lit(c), lit(o))) == want


def test_inverse_and_forward(spark):
    d, a = cogo.inverse(lit(1000), lit(1000), lit(1100), lit(1200))
    assert math.isclose(value(spark, d), math.sqrt(50000))
    n, e = cogo.forward(lit(1000), lit(1000), a, d)
    assert math.isclose(value(spark, n), 1100) and math.isclose(value(spark, e), 1200)
    assert value(spark, cogo.inverse(lit(1), lit(1), lit(1), lit(1))[1]) == 0


def test_curves(spark):
    parts = {k: value(spark, c) for k, c in cogo.curve_from_radius_delta(lit(500), lit(30)).items()}
    assert math.isclose(parts["tangent"], 133.9745962, abs_tol=1e-6) and math.isclose(parts["arc_length"], 261.7993878, abs_tol=1e-6)
    assert math.isclose(parts["long_chord"], 258.8190451, abs_tol=1e-6) and math.isclose(parts["degree_of_curve"], 11.4591559026, abs_tol=1e-8)
    assert math.isclose(value(spark, cogo.delta_from_tangent_arc(lit(parts["tangent"]), lit(parts["arc_length"]))), 30, abs_tol=1e-9)


def test_circle_and_parallel_lines(spark):
    n, e, r = cogo.circle_through(*map(lit, (0, 0, 0, 2, 2, 0)))
    assert (value(spark, n), value(spark, e)) == (1, 1) and math.isclose(value(spark, r), math.sqrt(2))
    assert value(spark, cogo.circle_through(*map(lit, (0, 0, 1, 1, 2, 2)))[0]) is None
    assert value(spark, cogo.line_intersection(*map(lit, (0, 0, 45, 5, 5, 225)))[0]) is None


def test_vertical_curve(spark):
    g = (lit(2), lit(-2), lit(200))
    assert value(spark, cogo.turning_point(*g)) == 100
    assert value(spark, cogo.vertical_curve(lit(98), *g, lit(100))) == 99
    assert value(spark, cogo.turning_point(lit(2), lit(2), lit(200))) is None


def test_similarity_inverts(spark):
    x, y = cogo.similarity(lit(3), lit(4), 2.0, 40.0, 10.0, -5.0)
    x, y = cogo.similarity_inverse(x, y, 2.0, 40.0, 10.0, -5.0)
    assert math.isclose(value(spark, x), 3) and math.isclose(value(spark, y), 4)


def test_formula_injection(spark):
    assert [value(spark, ids.csv_safe(F.lit(t))) for t in ("=1+1", " @x", "plain")] == ["'=1+1", "' @x", "plain"]


def test_header_variants(spark):
    v = ids.header_variants(F.lit("\ufeff Northing-US (ft)_2 "))
    got = spark.range(1).select(*[c.alias(k) for k, c in v.items()]).first().asDict()
    assert got["validation"] == "northingus(ft)2" and got["inspector"] == "northingusft2" and got["staging"].endswith("northing_us_ft_2")
    assert got["survey"].endswith("northingus_ft_2")
