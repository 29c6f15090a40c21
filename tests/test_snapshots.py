from __future__ import annotations

import random

from plumbline.operators import snapshots

POINT = "seq int, point_uuid string, point_id string, source_id string, description string, northing double, easting double, elevation double, crs string, horizontal_units string, vertical_units string"


def test_point_issues(spark):
    base = ("A", "meters", "meters")
    rows = [
        (1, "a", "1", "s", "d", 0.0, 0.0, 0.0, *base), (2, "b", "2", "s", "d", 3.0, 4.0, 9.0, *base), (3, "c", "2", "s", "d", 3.0, 4.0, None, *base), (4, "d", "3", "s", "d", 3.0, 4.0, 0.0, *base),
        (5, "e", "4", "s", "x", float("nan"), 0.0, 1.0, *base), (6, "f", "5", "s", "", 0.0, 0.0, 99.0, *base), (7, "g", None, "s", "y", 0.0, 0.0, 1.0, None, "meters", "meters"), (8, "h", None, "s", "y", 0.0, 0.0, 50.0, *base),
    ]
    df = spark.createDataFrame(rows, POINT)
    got = sorted((r.kind, r.point_uuid, r.value) for r in snapshots.point_issues(df, *base).collect())
    assert got == [("coordinate_context", "g", None), ("duplicate_id", "b", 2.0), ("duplicate_id", "c", 2.0), ("elevation_jump", "b", 9.0), ("missing_xy", "e", None), ("missing_z", "c", None)]
    assert all(r.kind != "elevation_jump" for r in snapshots.point_issues(df, "A", "chains", "meters").collect())
    assert snapshots.point_issues(df.limit(0), *base).count() == 0


def stack(log):
    """The same by a real stack."""
    state, done, undone = {}, [], []
    for _, action, key, before, after in log:
        if action == "do":
            state.setdefault(key, before)
            done.append((key, state[key], after))
            state[key], undone = after, []
        elif action == "undo":
            undone.append(done.pop())
            state[undone[-1][0]] = undone[-1][1]
        else:
            done.append(undone.pop())
            state[done[-1][0]] = done[-1][2]
    return state


def test_replay_equals_a_stack(spark):
    rnd, logs, want = random.Random(3), [], {}
    for project in range(25):
        depth, undone, log, now = 0, 0, [], {}
        for seq in range(rnd.randint(0, 25)):
            action = rnd.choice(["do", "do"] + ["undo"] * (2 * (depth > 0)) + ["redo"] * (2 * (undone > 0)))
            depth, undone = (depth + 1, 0) if action == "do" else (depth - 1, undone + 1) if action == "undo" else (depth + 1, undone - 1)
            key = rnd.choice("abc")
            log.append((seq, action, key, "", f"v{seq}"))
        held = stack(log)
        want |= {(project, k): v for k, v in held.items()}
        logs += [(project, *x) for x in log]
    df = spark.createDataFrame(logs, "project_id int, seq int, action string, key string, before string, after string")
    assert {(r.project_id, r.key): r.value for r in snapshots.replayed(df).collect()} == want


def test_moves_keep_coordinates(spark):
    results = spark.createDataFrame([("p", 1.0, "OPEN"), ("q", 2.0, None), ("r", 3.0, "X"), ("t", 4.0, None)], "point_id string, easting double, status string")
    moves = spark.createDataFrame([("p", "q"), ("p", "t"), ("r", "q"), ("q", "t"), ("p", "r"), ("p", "p"), ("zz", "t"), (None, "t")], "source_id string, target_id string")
    assert sorted(map(tuple, snapshots.reassigned(results, moves, "status").collect())) == [("p", 1.0, None, None), ("q", 2.0, "OPEN", "p"), ("r", 3.0, "X", None), ("t", 4.0, None, None)]


def test_regrouped_and_timeline(spark):
    obs = spark.createDataFrame([(1, "100", "100A"), (2, "100A", "100A"), (3, "7B", None), (4, None, "8C"), (5, None, None)], "observation_id int, control_id string, point_id string")
    assert sorted((r.observation_id, r.canonical_id) for r in snapshots.regrouped(obs).collect()) == [(2, "100"), (3, "7"), (4, "8")]
    log = spark.createDataFrame([(1, "A_B"), (3, "POINTS_MOVED"), (2, "X")], "seq int, action string")
    labels = spark.createDataFrame([("X", "Known")], "action string, label string")
    assert sorted((r.seq, r.label) for r in snapshots.timeline(log, labels, 2).collect()) == [(2, "Known"), (3, "Points Moved")]
