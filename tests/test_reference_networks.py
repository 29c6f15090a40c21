from __future__ import annotations

import numpy as np
import pandas as pd
import pytest

from plumbline.operators import networks
from plumbline.operators import reference_networks as ref

TRUE = {"A": (0.0, 0.0), "B": (1000.0, 0.0), "C": (900.0, 800.0), "D": (100.0, 900.0), "E": (500.0, 450.0)}


def points(fixed=("A", "B"), shift=0.3, true=None):
    return pd.DataFrame([(p, n + (0 if p in fixed else shift), e - (0 if p in fixed else shift), p in fixed) for p, (n, e) in (true or TRUE).items()], columns=["point_id", "northing", "easting", "fixed"])


def seen(pairs, noise=0.0, true=None):
    rng = np.random.default_rng(3)
    rows = []
    for k, (kind, a, b, c) in enumerate(pairs):
        (n1, e1), (n2, e2) = (true or TRUE)[a], (true or TRUE)[b]
        if kind == "distance":
            value, sigma = np.hypot(n2 - n1, e2 - e1), 0.01
        else:
            value, sigma = np.degrees(np.arctan2(e2 - e1, n2 - n1)), 0.002
            if kind == "angle":
                n3, e3 = (true or TRUE)[c]
                value = np.degrees(np.arctan2(e3 - e1, n3 - n1)) - value
            value %= 360
        rows.append((k, kind, a, b, c, value + noise * sigma * rng.standard_normal(), sigma))
    return pd.DataFrame(rows, columns=["ord", "kind", "from_id", "to_id", "target2_id", "value", "sigma"])


PAIRS = [("distance", a, b, "") for a in "ABCDE" for b in "ABCDE" if a < b] + [("azimuth", "A", "C", ""), ("azimuth", "E", "B", ""), ("angle", "E", "C", "D"), ("angle", "C", "A", "E"), ("angle", "A", "D", "E")]


def test_exact_observations_give_the_true_places():
    out, res = ref.solve(points(), seen(PAIRS))
    assert {r.point_id: (round(r.northing, 6), round(r.easting, 6)) for r in out.itertuples()} == {p: TRUE[p] for p in "CDE"}
    assert np.abs(res.residual).max() < 1e-6 and round(res.redundancy.sum(), 9) == out.dof.iloc[0] == len(PAIRS) - 6


@pytest.mark.parametrize("robust", [False, True])
def test_agrees_with_the_first_adjustment(robust):
    obs = seen(PAIRS, noise=1.0)
    obs.loc[4, "value"] += 0.2
    told = ref.compare(points(), obs, robust)
    assert told["status"] == "PASS" and max(told[f] for f in ref._FIGURES) < 1e-6
    (a, _), (b, _) = networks.solve_control(points(), obs, robust), ref.solve(points(), obs, robust)
    turn = (a.azimuth - b.azimuth + 90) % 180 - 90
    assert np.abs(turn).max() < 1e-6


def test_without_redundancy_there_is_no_sigma():
    obs = seen([("distance", "A", "C", ""), ("distance", "B", "C", "")])
    three = points().iloc[:3]
    told = ref.compare(three, obs)
    assert told["status"] == "PASS" and told["sigma0"] == 0.0 and ref.solve(three, obs)[0].sigma0.iloc[0] is None


def test_ill_conditioned_normals_are_found_out():
    """Two fixed points almost in line with the new one: squaring the condition number costs the normals their last digits."""
    true = {"A": (0.0, 0.0), "B": (1000.0, 2e-5), "C": (5000.0, 0.0)}
    three = points(fixed=("A", "B"), shift=0.0, true=true)
    obs = seen([("distance", "A", "C", ""), ("distance", "B", "C", ""), ("distance", "A", "C", "")], true=true)
    told = ref.compare(three, obs)
    assert told["reference_converged"] and told["status"] == "REVIEW"


def test_faults_are_named():
    obs = seen(PAIRS)
    with pytest.raises(ValueError, match="unknown points"):
        ref.solve(points().iloc[:4], obs)
    with pytest.raises(ValueError, match="fixed"):
        ref.solve(points(fixed=()), obs)
    with pytest.raises(ValueError, match="rank"):
        ref.solve(points(), obs.iloc[:3])
    with pytest.raises(ValueError, match="positive"):
        ref.solve(points(), obs.assign(sigma=0.0))
    with pytest.raises(ValueError, match="twice"):
        ref.solve(pd.concat([points(), points()]), obs)
    assert ref.compare(points(), obs.iloc[:3])["status"] == "PASS" and not ref.compare(points(), obs.iloc[:3])["converged"]


def test_networks_side_by_side(spark):
    obs, three = seen(PAIRS, noise=1.0), points()
    frame = lambda df: spark.createDataFrame(pd.concat([df.assign(network_id=k) for k in (1, 2)]))
    rows = ref.compare_adjustments(frame(three), frame(obs)).collect()
    assert sorted((r.network_id, r.status) for r in rows) == [(1, "PASS"), (2, "PASS")]
    out = ref.adjust_control(frame(three), frame(obs)).collect()
    want = networks.solve_control(three, obs)[0].set_index("point_id")
    assert len(out) == 6 and all(abs(r.northing - want.northing[r.point_id]) < 1e-6 for r in out)
