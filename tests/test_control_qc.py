from __future__ import annotations

import datetime
import itertools
import math
import random

import pytest

from plumbline.operators import control
from plumbline.plans.registry import QUERIES

SCHEMA = "control_id string, observation_id string, point_id string, description string, northing double, easting double, elevation double, observed timestamp, epoch_count int, duration_seconds double, satellite_count int, pdop double"


def shots(spark, rows):
    """(control, letter, northing, hour, epochs, seconds, satellites, pdop)"""
    made = [(c, f"{c}-{k}", f"{c}{letter}", "CP" if letter < "C" else "NAIL", n, 10.0, 5.0, f"2024-05-01 {hour:02d}:00:00", e, s, sat, dop) for k, (c, letter, n, hour, e, s, sat, dop) in enumerate(rows)]
    return spark.createDataFrame(made, SCHEMA.replace("timestamp", "string")).selectExpr(*[f"CAST({c.split()[0]} AS {c.split()[1]}) AS {c.split()[0]}" for c in SCHEMA.split(", ")])


GOOD = (300, None, 5, 2.0)


def status(spark, rows, **limits):
    return {r.control_id: (r.status, r.field_status, r.reason) for r in control.control_qc(shots(spark, rows), **limits).collect()}


def test_the_three_shots_checks_decide_with_their_times(spark):
    three = lambda c, *last: [(c, "A", 1.0, 8, *GOOD), (c, "B", 1.01, 10, *GOOD), (c, "C", 1.02, 12, *(last or GOOD))]
    rows = three("1") + three("2", 299, None, 5, 2.0) + three("3", 299, 300.0, 5, 2.0) + three("4", None, None, 5, 2.0) + three("5", 300, None, 4, 2.0) + three("6", 300, None, None, 2.0)
    rows += [("7", "A", 1.0, 8, *GOOD), ("7", "B", 1.0, 8, *GOOD), ("7", "C", 1.0, 12, *GOOD)] + three("8", 300, None, 5, 6.5) + three("9", 300, None, 5, None)
    fails, unsure, fine = ("RESHOOT", "FAIL", "FIELD_CHECKS"), ("PASS", "UNVERIFIED", ""), ("PASS", "PASS", "")
    assert status(spark, rows) == {"1": fine, "2": fails, "3": fine, "4": unsure, "5": fails, "6": unsure, "7": fails, "8": fine, "9": fine}
    got = status(spark, rows, most_pdop=6.0, require_metadata=True)
    refused = ("RESHOOT", "UNVERIFIED", "FIELD_CHECKS")
    assert got == {"1": fine, "2": fails, "3": fine, "4": refused, "5": fails, "6": refused, "7": fails, "8": fails, "9": refused}


def test_a_passing_triplet_goes_before_a_tighter_one_that_fails_in_the_field(spark):
    rows = [("1", "A", 1.0, 8, *GOOD), ("1", "B", 1.0, 10, *GOOD), ("1", "C", 1.0, 12, 10, 10.0, 9, 1.0), ("1", "D", 1.03, 14, *GOOD)]
    best = control.control_qc(shots(spark, rows)).first()
    assert (best.id_a, best.id_b, best.id_c, best.status, best.field_status) == ("1-0", "1-1", "1-3", "PASS", "PASS")


def test_columns_that_a_table_lacks(spark):
    rows = [("1", letter, 1.0, hour, *GOOD) for letter, hour in zip("ABC", (8, 10, 12))]
    bare = shots(spark, rows).drop("epoch_count", "duration_seconds", "satellite_count", "pdop")
    assert control.control_qc(bare).first().field_status == "PASS"
    assert control.control_qc(shots(spark, rows).drop("epoch_count", "duration_seconds")).first().field_status == "UNVERIFIED"


def test_tables_of_accepted_and_reshot_controls(spark):
    rows = [("1", letter, 1.0, hour, *GOOD) for letter, hour in zip("ABC", (8, 10, 12))]
    rows += [("2", letter, n, hour, *GOOD) for letter, n, hour in zip("ABC", (1.0, 2.0, 3.0), (8, 10, 12))] + [("3", "Y", 1.0, 8, *GOOD), ("3", "Z", 1.0, 10, *GOOD)]
    obs = shots(spark, rows)
    qc = control.control_qc(obs)
    accepted = control.accepted_control(qc, obs).collect()
    assert [(r.control_id, r.northing, r.code, r.source_observations, r.field_qc_status, r.minimum_time_gap_minutes, r.qc_status) for r in accepted] == [("1", 1.0, "CP;NAIL", "1A;1B;1C", "PASS", 120.0, "PASS")]
    again = {r.control_id: (r.reason, r.existing_shots, r.next_shots) for r in control.reshoot_control(qc, obs).collect()}
    assert again == {"2": ("OUT_OF_TOLERANCE", "2A;2B;2C", "2D;2E;2F"), "3": ("FEWER_THAN_THREE_SHOTS", "3Y;3Z", "3AA;3AB;3AC")}


@pytest.mark.parametrize("blank", ["", "  ", None])
def test_a_confirmed_review_with_blank_ids_takes_the_majority(spark, blank):
    rows = [("1", "", "100A", 0.0), ("2", "", "100B", 0.1), ("3", "", "200C", 0.05)]
    obs = spark.createDataFrame([(i, c, p, n, 0.0, 1.0) for i, c, p, n in rows], "observation_id string, control_id string, point_id string, northing double, easting double, elevation double")
    reviews = spark.createDataFrame([("3", "confirmed", blank, blank)], "observation_id string, status string, assigned_control_id string, assigned_point_id string")
    out = {r.observation_id: (r.control_id, r.point_id, r.source) for r in control.regroup(obs, 0.5, reviews=reviews).collect()}
    assert out["3"] == ("100", "100C", "MANUAL")


def test_triplets_are_dealt_by_their_number_and_the_best_is_a_minimum(spark, monkeypatch):
    monkeypatch.setattr(control, "TRIPLETS_A_TASK", 100)
    rows = spark.range(240).selectExpr("id % 20 AS control_id", "id AS observation_id", "(id * 7919) % 13 * 0.01D AS northing", "(id * 104729) % 11 * 0.01D AS easting", "CASE WHEN id % 9 <> 0 THEN (id * 31) % 7 * 0.01D END AS elevation", "timestamp_seconds(id * 5000) AS observed")
    ranked = control.ranked_triplets(rows, htol=0.05, vtol=0.05)
    assert ranked.rdd.getNumPartitions() == 44  # 20 controls of 220 triplets
    best = control.control_qc(rows, htol=0.05, vtol=0.05)
    assert best._jdf.queryExecution().optimizedPlan().toString().count("row_number()") == 3  # the order of the three shots alone
    columns = ("control_id", "id_a", "id_b", "id_c", "max_h", "max_v", "rms_v", "passes", "field_status")
    assert sorted(map(str, best.select(*columns).collect())) == sorted(map(str, ranked.where("rank = 1").select(*columns).collect())) and best.count() == 20


def many_shots(spark):
    """Controls of 30 shots: places that pass or don't, few places, one place, one hour, checks that fail or can't be made, missing heights, and a blunder."""
    rng = random.Random(11)
    start, rows = datetime.datetime(2024, 1, 1), []
    numbers = rng.sample(range(9000), 270)
    good = lambda: (300, None, 5, 2.0)
    mixed = lambda: (rng.choice([None, 100, 400]), None, rng.choice([None, 4, 9]), 2.0)
    box = lambda s: lambda k: (5e5 + rng.uniform(0, s), rng.uniform(0, s), rng.uniform(0, s))
    few = lambda k: (rng.randrange(3) * 0.001, 5.0, rng.randrange(2) * 0.001)
    one = lambda k: (1.0, 2.0, 3.0)
    kinds = {
        "close": (box(0.3), 900, good), "wide": (box(30), 900, mixed), "few": (few, 900, mixed), "few days": (few, 3, mixed), "one": (one, 900, good), "one mixed": (one, 4, mixed), "one hour": (one, 0.9, good),
        "no heights": (lambda k: (*box(0.1)(k)[:2], rng.choice([None, 0.01])), 900, good), "blunder": (lambda k: (0.0, 0.0, 0.0) if k == 7 else box(0.1)(k), 900, mixed),
    }
    for name, (place, hours, checks) in kinds.items():
        for k in range(30):
            rows.append((name, numbers.pop(), *place(k), start + datetime.timedelta(seconds=rng.randrange(int(hours * 3600))), *checks()))
    return spark.createDataFrame(rows, "control_id string, observation_id int, northing double, easting double, elevation double, observed timestamp, epoch_count int, duration_seconds double, satellite_count int, pdop double")


def test_the_best_of_many_combinations_are_found_without_all_of_them(spark, monkeypatch):
    rows = many_shots(spark)
    ranked = control.ranked_triplets(rows).where("rank <= 4")
    wanted = sorted(map(str, ranked.collect()))
    best = sorted(map(str, control.control_qc(rows).collect()))
    monkeypatch.setattr(control, "EACH", 100)
    monkeypatch.setattr(control, "CELL_SHOTS", 8)
    assert sorted(map(str, control.ranked_triplets(rows, top=4).select(*ranked.columns).collect())) == wanted and len(wanted) == 36
    assert sorted(map(str, control.control_qc(rows).collect())) == best and len(best) == 9


def test_a_control_of_many_shots_is_judged_like_any_other(spark):
    """90 shots have 117,480 combinations.  Shots lie the nearer the earlier; the first four were too short."""
    rows = [("1", f"1-{k}", f"1{k}", "CP", k * k * 0.001, 0.0, 0.0, datetime.datetime(2024, 1, 1) + datetime.timedelta(hours=2 * k), 300 if k > 3 else 10, None, 5, 2.0) for k in range(90)]
    obs = spark.createDataFrame(rows, SCHEMA)
    qc = control.control_qc(obs)
    best = qc.first()
    assert (best.n, best.status, best.reason, best.id_a, best.id_b, best.id_c) == (90, "PASS", "", "1-4", "1-5", "1-6")
    assert [r.source_observations for r in control.accepted_control(qc, obs).collect()] == ["14;15;16"]


def large_customer(spark, folder):
    """Orders of one customer, a day apart: 90 shots with 117,480 combinations."""
    spark.range(1, 91).selectExpr("id AS o_orderkey", "7L AS o_custkey", "id * id * 13.37D AS o_totalprice", "timestamp_seconds(id * 86400) AS o_orderdate").write.parquet(f"{folder}/orders.parquet")


def order_of_merit(most_pdop=46, tolerance=0.15):
    """The ids of all triplets of ``large_customer``, the best first, with the largest horizontal residual and whether they pass."""
    foot, found = 1200 / 3937 / 100, []
    shot = {}
    for k in range(1, 91):
        price, epochs, seconds = k * k * 13.37, None if k % 13 == 0 else 280 + k * 7 % 600, None if k % 3 == 0 else 290 + k % 40
        satellites = None if k % 29 == 0 else 4 + k % 12
        short = (epochs is not None or seconds is not None) and not ((epochs or 0) >= 300 or (seconds or 0) >= 300)
        fails = short or (satellites is not None and satellites < 5) or k % 50 > most_pdop
        lacks = (epochs is None and seconds is None) or satellites is None
        shot[k] = price % 97 * foot, price % 89 * foot, None if k % 17 == 0 else price % 83 * foot, fails, lacks
    for ids in itertools.combinations(shot, 3):
        n, e, z, fails, lacks = zip(*(shot[k] for k in ids))
        mean = [sum(c[1:], c[0]) / 3 for c in (n, e)]
        h = [math.sqrt((a - mean[0]) ** 2 + (b - mean[1]) ** 2) for a, b in zip(n, e)]
        v = None if None in z else [abs(a - sum(z[1:], z[0]) / 3) for a in z]
        rms_h, rms_v = (math.inf if x is None else math.sqrt(sum(a * a for a in x) / 3) for x in (h, v))
        max_h, max_v = max(h), math.inf if v is None else max(v)
        status = 2 if any(fails) else 1 if any(lacks) else 0
        passes = max_h <= tolerance and max_v <= tolerance and status < 2
        found.append((not passes, status, max(max_h, max_v) / tolerance, max_h, max_v, rms_h, rms_v or math.inf, ids))
    return [(x[-1], round(x[3], 4), not x[0]) for x in sorted(found)]


def test_the_best_triplet_of_a_large_customer(spark, tmp_path):
    large_customer(spark, tmp_path)
    (r,) = QUERIES["d21_best_triplet"](spark, str(tmp_path)).collect()
    assert ((r.id_a, r.id_b, r.id_c), r.max_h, r.status == "PASS") == order_of_merit()[0] and r.n == 90


def test_the_top_alternatives_of_a_large_customer(spark, tmp_path):
    large_customer(spark, tmp_path)
    rows = QUERIES["g2_top_alternatives"](spark, str(tmp_path)).orderBy("rank").collect()
    assert [((r.id_a, r.id_b, r.id_c), r.max_h, r.passes) for r in rows] == order_of_merit()[:10] and [r.rank for r in rows] == list(range(1, 11))
