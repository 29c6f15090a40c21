"""A second, independent adjustment of 2-D control networks, and its comparison with the first.

``networks.solve_control`` forms normal equations for covariances.  Here a ray
is a complex number, its derivatives are quotients of those, columns are
scaled, and everything comes from one orthogonal decomposition: the step, the
redundancies (lengths of the rows of Q) and the covariances (from R alone), so
what normal equations lose by squaring the condition number stays.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.operators.networks import ELLIPSE_95, MOST_OBSERVATIONS, MOST_POINTS, dealt, solve_control

#: Fixed value: how far the two adjustments may lie apart in each of the compared figures.
AGREEMENT = 1e-4
#: Smallest share of the largest diagonal element of R (columns scaled) that still counts as full rank.
RANK = 1e-13
_DEGREE = 180 / np.pi


class _Network:
    """Observations as index arrays into the points, with values and derivatives at given places."""

    def __init__(self, points: pd.DataFrame, obs: pd.DataFrame):
        self.names = points.point_id.tolist()
        if len(set(self.names)) < len(self.names):
            raise ValueError("a point occurs twice")
        number = {p: k for k, p in enumerate(self.names)}
        unknown = (set(obs.from_id) | set(obs.to_id) | set(obs.target2_id[obs.kind == "angle"])) - set(number)
        if unknown:
            raise ValueError(f"observations name unknown points {sorted(map(str, unknown))}")
        if not (obs.sigma > 0).all():
            raise ValueError("a standard deviation isn't positive")
        known = {"distance", "azimuth", "angle"}
        if set(obs.kind) - known:
            raise ValueError(f"unsupported kinds {sorted(set(obs.kind) - known)}")
        self.place = points.northing.to_numpy(float) + 1j * points.easting.to_numpy(float)
        self.free = np.flatnonzero(~points.fixed.to_numpy(bool))
        if len(self.free) == len(self.names):
            raise ValueError("no point is fixed")
        self.at, self.to = (np.array([number[v] for v in obs[c]], int) for c in ("from_id", "to_id"))
        self.far = np.array([number[t] if k == "angle" else number[f] for k, t, f in zip(obs.kind, obs.target2_id, obs.from_id)], int)
        self.is_distance, self.is_angle = (obs.kind == "distance").to_numpy(), (obs.kind == "angle").to_numpy()
        self.value, self.sigma = obs.value.to_numpy(float), obs.sigma.to_numpy(float)

    def system(self) -> tuple[np.ndarray, np.ndarray]:
        """Observed minus computed, and derivatives by the free coordinates, both in standard deviations."""
        n = len(self.value)
        ray = self.place[self.to] - self.place[self.at]
        other = np.where(self.is_angle, self.place[self.far] - self.place[self.at], 1.0)
        if (np.abs(ray) == 0).any() or (np.abs(other) == 0).any():
            raise ValueError("two points of an observation coincide")
        bearing = np.angle(ray) * _DEGREE
        modelled = np.where(self.is_distance, np.abs(ray), np.where(self.is_angle, np.angle(other) * _DEGREE - bearing, bearing))
        miss = self.value - modelled
        miss = np.where(self.is_distance, miss, (miss + 180) % 360 - 180)
        # A shift w of a ray's end changes its length by Re(conj(w) u) and its bearing by Im(w / ray).
        unit = ray / np.abs(ray)
        along = np.stack([unit.real, unit.imag])
        turn = lambda z: np.stack([(1 / z).imag, (1j / z).imag]) * _DEGREE
        end = np.where(self.is_distance, along, np.where(self.is_angle, -turn(ray), turn(ray)))
        second = np.where(self.is_angle, turn(other), 0.0)
        full = np.zeros((n, 2, len(self.names)))
        rows = np.arange(n)
        for column, change in ((self.to, end), (self.far, second), (self.at, -end - second)):
            for axis in (0, 1):
                np.add.at(full[:, axis], (rows, column), change[axis])
        design = full[:, :, self.free].transpose(0, 2, 1).reshape(n, -1)
        return miss / self.sigma, design / self.sigma[:, None]


def solve(points: pd.DataFrame, obs: pd.DataFrame, robust: bool = False, k: float = 1.5, rounds: int = 50, tolerance: float = 1e-7) -> tuple[pd.DataFrame, pd.DataFrame]:
    """The same figures as ``networks.solve_control``: (points with ellipses, observations with residuals)."""
    obs = obs.sort_values("ord").reset_index(drop=True)
    net = _Network(points, obs)
    unknowns = 2 * len(net.free)
    weight, q, back = np.ones(len(obs)), np.zeros((len(obs), 0)), np.zeros((0, 0))
    for _ in range(rounds):
        miss, design = net.system()
        if robust:
            size = np.abs(miss)
            weight = np.where(size > k, k / np.where(size > 0, size, 1.0), 1.0)
        if not unknowns:
            break
        rooted = design * np.sqrt(weight)[:, None]
        scale = np.linalg.norm(rooted, axis=0)
        if len(rooted) < unknowns or (scale == 0).any():
            raise ValueError("control network is rank deficient")
        q, r = np.linalg.qr(rooted / scale)
        if np.abs(np.diag(r)).min() < RANK * np.abs(np.diag(r)).max():
            raise ValueError("control network is rank deficient")
        back = np.linalg.solve(r, np.eye(unknowns)) / scale[:, None]
        step = (back @ (q.T @ (miss * np.sqrt(weight)))).reshape(-1, 2)
        net.place[net.free] += step[:, 0] + 1j * step[:, 1]
        if np.abs(step).max() < tolerance:
            break
    else:
        raise ValueError("control network did not converge")
    dof = len(obs) - unknowns
    rest = -miss * np.sqrt(weight)
    sigma0 = float(np.linalg.norm(rest) / np.sqrt(dof)) if dof > 0 else None
    factor = sigma0 if sigma0 else 1.0
    redundancy = np.clip(1 - (q * q).sum(axis=1), 0, 1) if unknowns else np.ones(len(obs))
    rows = []
    for j, point in enumerate(net.free):
        # The singular values of a point's rows of the inverse of R are its ellipse's axes.
        u, s, _ = np.linalg.svd(back[2 * j : 2 * j + 2])
        axis = float(np.degrees(np.arctan2(u[1, 0], u[0, 0])) % 180)
        place = net.place[point]
        rows.append((net.names[point], place.real, place.imag, ELLIPSE_95 * factor * s[0], ELLIPSE_95 * factor * s[1], axis, dof, sigma0))
    out = pd.DataFrame(rows, columns=["point_id", "northing", "easting", "semi_major", "semi_minor", "azimuth", "dof", "sigma0"])
    return out.sort_values("point_id", ignore_index=True), obs[["ord"]].assign(residual=-miss * net.sigma, redundancy=redundancy)


def _attempt(solver, points: pd.DataFrame, obs: pd.DataFrame, robust: bool):
    try:
        return solver(points, obs, robust)
    except (ValueError, np.linalg.LinAlgError):
        return None


_FIGURES = ("coordinate", "normalised_residual", "redundancy", "ellipse_axis", "sigma0")


def compare(points: pd.DataFrame, obs: pd.DataFrame, robust: bool = False, agreement: float = AGREEMENT) -> dict:
    """Whether both adjustments settle, the largest differences of their figures, and PASS or REVIEW."""
    first, second = (_attempt(s, points, obs, robust) for s in (solve_control, solve))
    told = {"converged": first is not None, "reference_converged": second is not None} | dict.fromkeys(_FIGURES)
    if first is None or second is None:
        return told | {"status": "PASS" if first is second else "REVIEW"}
    (p, o), (q, r) = ((a.set_index("point_id"), b.set_index("ord")) for a, b in (first, second))
    q, r = q.loc[p.index], r.loc[o.index]
    sigma = obs.set_index("ord").sigma.loc[o.index].to_numpy(float)
    most = lambda *v: float(max((np.abs(x).max() for x in v if len(x)), default=0.0))
    told["coordinate"] = most(np.hypot(p.northing - q.northing, p.easting - q.easting))
    told["normalised_residual"] = most((o.residual - r.residual).to_numpy() / sigma)
    told["redundancy"] = most((o.redundancy - r.redundancy).to_numpy())
    told["ellipse_axis"] = most((p.semi_major - q.semi_major).to_numpy(), (p.semi_minor - q.semi_minor).to_numpy())
    a, b = (t.sigma0.iloc[0] if len(t) else None for t in (p, q))
    a, b = (None if v is None or np.isnan(v) else float(v) for v in (a, b))
    told["sigma0"] = 0.0 if a is None and b is None else np.inf if a is None or b is None else abs(a - b)
    # A difference that is no number doesn't agree.
    return told | {"status": "PASS" if all(told[f] <= agreement for f in _FIGURES) else "REVIEW"}


def _cogrouped(points: DataFrame, observations: DataFrame, solver, columns: str) -> DataFrame:
    kind = points.schema["network_id"].dataType.simpleString()
    left, right = (dealt(df, "network_id", most).groupBy("network_id") for df, most in ((points, MOST_POINTS), (observations, MOST_OBSERVATIONS)))
    return left.cogroup(right).applyInPandas(solver, f"network_id {kind}, {columns}")


def adjust_control(points: DataFrame, observations: DataFrame, robust: bool = False) -> DataFrame:
    """Adjust every network independently of ``networks.adjust_control``; same input, same columns, same bounds."""

    def solver(key, p, o):
        out = solve(p, o, robust)[0]
        out.insert(0, "network_id", key[0])
        return out

    return _cogrouped(points, observations, solver, "point_id string, northing double, easting double, semi_major double, semi_minor double, azimuth double, dof long, sigma0 double")


def compare_adjustments(points: DataFrame, observations: DataFrame, robust: bool = False, agreement: float = AGREEMENT) -> DataFrame:
    """One row a network: whether each adjustment settles, their largest differences (null where one doesn't), and PASS or REVIEW.

    Networks where both fail for the same input pass: neither has a result.
    """

    def solver(key, p, o):
        return pd.DataFrame([{"network_id": key[0]} | compare(p, o, robust, agreement)])

    figures = ", ".join(f"{f} double" for f in _FIGURES)
    return _cogrouped(points, observations, solver, f"converged boolean, reference_converged boolean, {figures}, status string").withColumn("agreement", F.lit(agreement))
