from __future__ import annotations

import math
import random
from statistics import fmean, pstdev

from plumbline.operators import rodshift

LIMITS = rodshift.Correlation(rows=6, tolerance=0.1, distance=60.0, hazard_radius=12.0)
HAZARDS = {"discontinuity": -50, "ditch": -30, "creek": -30, "structure": -20}


def brute(points, nodes, events):
    """Events one after the other, and every group's figures from whole lists."""
    groups = []
    for e in sorted(events, key=lambda e: (e[0], e[1], e[3])):
        run, first, last, chain, shift, n, east, _ = e
        for g in reversed(groups):
            a = g[0]
            if a[0] != run or first - a[1] > LIMITS.rows or first > max(x[2] for x in g) + LIMITS.rows or any(x[3] == chain for x in g):
                continue
            if math.hypot(n - a[5], east - a[6]) <= LIMITS.distance and all(abs(shift - x[4]) <= LIMITS.tolerance for x in g):
                g.append(e)
                break
        else:
            groups.append([e])
    place = {(p[0], p[1]): p for p in points}
    out = []
    for g in groups:
        run, first, last = g[0][0], min(e[1] for e in g), max(e[2] for e in g)
        own = [n for e in g for n in nodes if n[0] == run and n[1] == e[3] and e[1] <= n[2] <= e[2]]
        at = {n[2] for n in own}
        risks = [HAZARDS[p[4]] for p in points if p[0] == run and p[4] in HAZARDS for s in at if math.hypot(p[2] - place[run, s][2], p[3] - place[run, s][3]) <= LIMITS.hazard_radius]
        inside = [p for p in points if p[0] == run and first <= p[1] <= last]
        conflicting, unknown = sum(p[4] == "surface" and p[1] not in at for p in inside), sum(p[4] == "unknown" for p in inside)
        setup = any(p[0] == run and p[4] == "setup" and any(e[1] - LIMITS.rows <= p[1] <= e[1] for e in g) for p in points)
        offsets = [n[3] for n in own]
        steady = pstdev(offsets) <= LIMITS.tolerance
        score = min(40, 8 * len({n[4] for n in own})) + (25 if steady else -40) + 15 * setup + 10 + 10 * (len(g) >= 2) + min(risks, default=0)
        score = max(0, min(100, score))
        status = "SUPPRESSED" if risks else "PROBABLE" if score > 80 and all(e[7] for e in g) and steady and not conflicting else "REVIEW"
        correction = -fmean(offsets) if status == "PROBABLE" and not unknown else None
        out.append((run, first, last, len(g), len({n[4] for n in own}), round(fmean(offsets), 6), conflicting, unknown, score, status, None if correction is None else round(correction, 6)))
    return sorted(out, key=repr)


def made(seed):
    rng = random.Random(seed)
    points, nodes, events = [], [], []
    for run in ("r1", "r2", "r3"):
        # Rows are points of six chains in turn; most are shifted together now and then.
        chain_of = {s: s % 6 for s in range(180)}
        # The third run is clean: whole sections are shifted, and nothing but setups and roads lies between.
        clean = run == "r3"
        kinds = (["surface", "unknown", "setup", "road"], [80, 2, 18, 0]) if clean else (["surface", "unknown", "setup", "ditch", "structure", "road"], [85, 2, 5, 1, 1, 6])
        points += [(run, s, float(s * 4), float(chain_of[s] * 3), rng.choices(*kinds)[0]) for s in chain_of]
        spans = {}
        for begin in range(12, 170, 30):
            height = rng.choice([0.5, -0.8, 1.2])
            for chain in range(6) if clean else rng.sample(range(6), rng.randrange(2, 7)):
                first = begin + (chain - begin) % 6
                spans.setdefault(chain, []).append((first, first if clean else first + 6 * rng.randrange(0, 2), height + (0 if clean else rng.choice([0, 0.03, 0.2]))))
        for chain, listed in spans.items():
            for first, last, height in listed:
                events.append((run, first, last, chain, height, float(first * 4), float(chain * 3), rng.random() < 0.9))
        for s, chain in chain_of.items():
            lift = next((h for a, b, h in spans.get(chain, []) if a <= s <= b), 0.0)
            nodes.append((run, chain, s, lift + rng.choice([0.0, 0.01]), f"F{chain}"))
    return points, nodes, events


def test_candidates_equal_brute_force(spark):
    told = []
    for seed in (1, 2, 3):
        points, nodes, events = made(seed)
        out = rodshift.rod_candidates(
            spark.createDataFrame(points, "run_id string, seq int, northing double, easting double, role string"), spark.createDataFrame(nodes, "run_id string, chain_id int, seq int, offset double, feature string"),
            spark.createDataFrame(events, "run_id string, first_seq int, last_seq int, chain_id int, shift double, northing double, easting double, recovered boolean"), LIMITS, confirmed=True,
        ).collect()
        got = sorted(((r.run_id, r.first_seq, r.last_seq, r.chains, r.features, round(r["shift"], 6), r.conflicting, r.unknown, r.score, r.status, None if r.correction is None else round(r.correction, 6)) for r in out), key=repr)
        assert got == brute(points, nodes, events)
        told += got
    assert {r[9] for r in told} == {"SUPPRESSED", "REVIEW", "PROBABLE"} and any(r[10] is not None for r in told) and any(r[6] for r in told)
