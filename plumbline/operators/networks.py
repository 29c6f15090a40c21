"""Least-squares networks: each network is one group, solved by numpy; networks run in parallel.

A network is bounded by MOST_POINTS and MOST_OBSERVATIONS; larger ones raise
before their rows are gathered.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MOST_POINTS = 100
MOST_OBSERVATIONS = 1000
#: Fixed value: scale of a 95 % ellipse for two coordinates.
ELLIPSE_95 = 2.447746830680816


def _bounded(rows: DataFrame, key: str, most: int) -> DataFrame:
    sizes = rows.groupBy(key).agg(F.count(F.lit(1)).alias("_size"))
    checked = sizes.select(key, F.when(F.col("_size") > most, F.raise_error(F.concat(F.lit(f"more than {most} rows in network "), F.col(key).cast("string")))).otherwise(F.lit(True)).alias("_fits"))
    fitting = rows.join(checked, key).where("_fits")
    return fitting.select(*[F.col(c).alias(c) for c in rows.columns])


def dealt(rows: DataFrame, key: str, most: int) -> DataFrame:
    """``_bounded`` rows, dealt by network to a fixed number of tasks.

    A network is few bytes and much work: left to itself, Spark joins small
    partitions by their bytes and solves all networks in one task.  The number
    isn't that of a join, which would make Spark leave the dealing out.
    """
    spark = rows.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism) + 1
    return _bounded(rows, key, most).repartition(parts, key)


def _robust(r: np.ndarray, k: float) -> np.ndarray:
    return np.minimum(1.0, k / np.maximum(np.abs(r), 1e-12))


def solve_levels(points: pd.DataFrame, obs: pd.DataFrame, robust: bool = False, k: float = 1.5, rounds: int = 50) -> pd.DataFrame:
    """Adjusted elevations of one level network; raises when it hangs together badly or robust weights don't settle."""
    free = sorted(points.loc[~points.fixed, "point_id"])
    column = {p: i for i, p in enumerate(free)}
    known = dict(zip(points.loc[points.fixed, "point_id"], points.loc[points.fixed, "elevation"]))
    a, b = np.zeros((len(obs), len(free))), np.zeros(len(obs))
    for i, o in enumerate(obs.sort_values("ord").itertuples()):
        b[i] = o.delta_elevation
        for point, sign in ((o.from_id, -1.0), (o.to_id, 1.0)):
            if point in column:
                a[i, column[point]] += sign
            else:
                b[i] -= sign * known[point]
    weight = 1 / obs.sort_values("ord").sigma.to_numpy(float) ** 2
    w = weight.copy()
    for _ in range(rounds):
        if np.linalg.matrix_rank(a) < len(free):
            raise ValueError("level network is rank deficient")
        normal = np.linalg.inv(a.T @ (a * w[:, None]))
        x = normal @ (a.T @ (w * b))
        if not robust:
            break
        new = weight * _robust((a @ x - b) * np.sqrt(weight), k)
        if np.abs(new - w).max() < 1e-8 * weight.max():
            break
        w = new
    else:
        raise ValueError("robust level network did not converge")
    r = a @ x - b
    dof = len(b) - len(free)
    sigma0 = float(np.sqrt((w * r * r).sum() / dof)) if dof else None
    spread = np.sqrt(np.diag(normal)) * (sigma0 if sigma0 is not None else 1.0)
    return pd.DataFrame({"point_id": free, "elevation": x, "sigma": spread, "dof": dof, "sigma0": sigma0})


def adjust_levels(points: DataFrame, observations: DataFrame, robust: bool = False) -> DataFrame:
    """Adjust every level network: points (network_id, point_id, elevation, fixed), observations (network_id, ord, from_id, to_id, delta_elevation, sigma)."""

    def solve(key, p, o):
        out = solve_levels(p, o, robust) if len(o) else pd.DataFrame(columns=["point_id", "elevation", "sigma", "dof", "sigma0"])
        out.insert(0, "network_id", key[0])
        return out

    kind = points.schema["network_id"].dataType.simpleString()
    left = dealt(points, "network_id", MOST_POINTS).groupBy("network_id")
    right = dealt(observations, "network_id", MOST_OBSERVATIONS).groupBy("network_id")
    return left.cogroup(right).applyInPandas(solve, f"network_id {kind}, point_id string, elevation double, sigma double, dof long, sigma0 double")


def _model(kind: str, xy: dict, o) -> float:
    (n1, e1), (n2, e2) = xy[o.from_id], xy[o.to_id]
    if kind == "distance":
        return float(np.hypot(n2 - n1, e2 - e1))
    azimuth = np.degrees(np.arctan2(e2 - e1, n2 - n1))
    if kind == "azimuth":
        return float(azimuth % 360)
    n3, e3 = xy[o.target2_id]
    return float((np.degrees(np.arctan2(e3 - e1, n3 - n1)) - azimuth) % 360)


def _gradient(kind: str, xy: dict, o) -> dict[str, tuple[float, float]]:
    """Derivatives of an observation by the coordinates of its points (angles in degrees)."""
    (n1, e1), (n2, e2) = xy[o.from_id], xy[o.to_id]

    def ray(n: float, e: float) -> tuple[float, float]:
        q = (n - n1) ** 2 + (e - e1) ** 2
        return float(np.degrees(-(e - e1) / q)), float(np.degrees((n - n1) / q))

    if kind == "distance":
        d = np.hypot(n2 - n1, e2 - e1)
        u = ((n2 - n1) / d, (e2 - e1) / d)
        return {o.to_id: u, o.from_id: (-u[0], -u[1])}
    a = ray(n2, e2)
    if kind == "azimuth":
        return {o.to_id: a, o.from_id: (-a[0], -a[1])}
    b = ray(*xy[o.target2_id])
    return {o.to_id: (-a[0], -a[1]), o.target2_id: b, o.from_id: (a[0] - b[0], a[1] - b[1])}


def solve_control(points: pd.DataFrame, obs: pd.DataFrame, robust: bool = False, k: float = 1.5, rounds: int = 50, tolerance: float = 1e-7) -> tuple[pd.DataFrame, pd.DataFrame]:
    """Gauss-Newton over distances, azimuths and angles of one network: (points with ellipses, observations with residuals)."""
    obs = obs.sort_values("ord").reset_index(drop=True)
    xy = {p.point_id: (p.northing, p.easting) for p in points.itertuples()}
    free = sorted(points.loc[~points.fixed, "point_id"])
    column = {p: 2 * i for i, p in enumerate(free)}
    sigma = obs.sigma.to_numpy(float)
    seen = list(obs.itertuples())
    weight = np.ones(len(obs))
    for _ in range(rounds):
        a, r = np.zeros((len(obs), 2 * len(free))), np.zeros(len(obs))
        for i, o in enumerate(seen):
            diff = _model(o.kind, xy, o) - o.value
            r[i] = (diff if o.kind == "distance" else (diff + 180) % 360 - 180) / sigma[i]
            for point, (dn, de) in _gradient(o.kind, xy, o).items():
                if point in column:
                    a[i, column[point]] += dn / sigma[i]
                    a[i, column[point] + 1] += de / sigma[i]
        if robust:
            weight = _robust(r, k)
        root = np.sqrt(weight)[:, None]
        if np.linalg.matrix_rank(a * root) < a.shape[1]:
            raise ValueError("control network is rank deficient")
        step = -np.linalg.lstsq(a * root, r * root[:, 0], rcond=None)[0]
        for p, c in column.items():
            xy[p] = (xy[p][0] + step[c], xy[p][1] + step[c + 1])
        if len(step) == 0 or np.abs(step).max() < tolerance:
            break
    else:
        raise ValueError("control network did not converge")
    cofactor = np.linalg.inv(a.T @ (a * weight[:, None])) if len(free) else np.zeros((0, 0))
    dof = len(obs) - 2 * len(free)
    sigma0 = float(np.sqrt((weight * r * r).sum() / dof)) if dof > 0 else None
    red = np.clip(1 - weight * np.einsum("ij,jk,ik->i", a, cofactor, a), 0, 1)
    scale = sigma0 if sigma0 else 1.0
    standard = np.where(red > 1e-12, r / (scale * np.sqrt(np.maximum(red, 1e-12))), 0.0)
    rows = []
    for p in free:
        c = column[p]
        cov = cofactor[c : c + 2, c : c + 2] * scale**2
        mean, half = (cov[0, 0] + cov[1, 1]) / 2, np.hypot((cov[0, 0] - cov[1, 1]) / 2, cov[0, 1])
        azimuth = float(np.degrees(np.arctan2(2 * cov[0, 1], cov[0, 0] - cov[1, 1])) / 2 % 180)
        rows.append((p, *xy[p], ELLIPSE_95 * np.sqrt(mean + half), ELLIPSE_95 * np.sqrt(max(mean - half, 0.0)), azimuth, dof, sigma0))
    out = pd.DataFrame(rows, columns=["point_id", "northing", "easting", "semi_major", "semi_minor", "azimuth", "dof", "sigma0"])
    return out, obs[["ord"]].assign(residual=r * sigma, redundancy=red, standardised=standard)


def adjust_control(points: DataFrame, observations: DataFrame, robust: bool = False) -> DataFrame:
    """Adjust every 2-D network: points (network_id, point_id, northing, easting, fixed), observations (network_id, ord, kind, from_id, to_id, target2_id, value, sigma)."""

    def solve(key, p, o):
        out = solve_control(p, o, robust)[0]
        out.insert(0, "network_id", key[0])
        return out

    kind = points.schema["network_id"].dataType.simpleString()
    left = dealt(points, "network_id", MOST_POINTS).groupBy("network_id")
    right = dealt(observations, "network_id", MOST_OBSERVATIONS).groupBy("network_id")
    return left.cogroup(right).applyInPandas(solve, f"network_id {kind}, point_id string, northing double, easting double, semi_major double, semi_minor double, azimuth double, dof long, sigma0 double")


def snoop(points: DataFrame, observations: DataFrame, threshold: float = 3.0, most_removed: int = 3) -> DataFrame:
    """Remove the worst standardised residual while it reaches the threshold and redundancy is left: one row a removal, in order.  The input stays."""

    def solve(key, p, o):
        rows = []
        for step in range(1, most_removed + 1):
            solved, res = solve_control(p, o)
            if not len(solved) or solved.dof.iloc[0] < 2:
                break
            worst = res.loc[res.standardised.abs().idxmax()]
            if abs(worst.standardised) < threshold:
                break
            rows.append((key[0], step, int(worst.ord), float(worst.standardised)))
            o = o[o.ord != worst.ord]
        return pd.DataFrame(rows, columns=["network_id", "step", "ord", "standardised"])

    kind = points.schema["network_id"].dataType.simpleString()
    left = dealt(points, "network_id", MOST_POINTS).groupBy("network_id")
    right = dealt(observations, "network_id", MOST_OBSERVATIONS).groupBy("network_id")
    return left.cogroup(right).applyInPandas(solve, f"network_id {kind}, step long, ord long, standardised double")
