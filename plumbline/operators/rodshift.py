"""Rod-height shifts along terrain chains: events, their groups, and corrections.

A shift is a run of points that lies off the grade of the points before it by
a constant height.  The scan skips ahead by what it finds, so it is a state
machine over one chain; chains are independent groups.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.operators.cells import around_keys, cell_key
from plumbline.storage import in_order

#: Rows to a bucket of the event groups.
START_BUCKET = 1 << 16


@dataclass(frozen=True)
class Settings:
    fit_points: int = 3
    fit_tolerance: float = 0.10
    least_shift: float = 0.45
    scatter: float = 0.40
    most_gap: float = 1500.0
    most_rows: int = 1000


def scan_chain(chainage: np.ndarray, elevation: np.ndarray, s: Settings) -> list[tuple[int, int, float, float, bool]]:
    """Shift events of one chain: (first row, row after the last, mean shift, scatter, recovered)."""
    return _scan(chainage, elevation, s, s.fit_points, True)[0]


def _scan(chainage: np.ndarray, elevation: np.ndarray, s: Settings, i: int, ended: bool) -> tuple[list[tuple[int, int, float, float, bool]], int]:
    """Events from row ``i`` on, and the row to go on from: the end, or in a chain that hasn't ended the first row whose look-ahead isn't all there."""
    events, k, n = [], s.fit_points, len(chainage)

    def line(rows):
        slope, meet = np.polyfit(chainage[rows], elevation[rows], 1)
        return slope, meet, np.abs(elevation[rows] - slope * chainage[rows] - meet).max()

    while i < n and (ended or i + s.most_rows + k < n):
        before = np.arange(i - k, i)
        slope, meet, off = line(before) if np.ptp(chainage[before]) > 1e-9 else (0.0, 0.0, np.inf)
        if off > s.fit_tolerance or abs(elevation[i] - slope * chainage[i] - meet) < s.least_shift or chainage[i] - chainage[i - 1] > s.most_gap:
            i += 1
            continue
        ahead = slice(i, i + s.most_rows)
        away = elevation[ahead] - slope * chainage[ahead] - meet
        j, recovered = i, False
        while j < n and j - i < s.most_rows and chainage[j] - chainage[j - 1] <= s.most_gap:
            if abs(away[j - i]) <= s.fit_tolerance:
                recovered = True
                break
            if j > i and abs(away[j - i] - np.median(away[: j - i])) > s.scatter:
                break
            j += 1
        if recovered:
            after = np.arange(j, min(n, j + k))
            if len(after) == k:
                slope, meet, off = line(np.r_[before, after])
                away = elevation[ahead] - slope * chainage[ahead] - meet
                recovered = off <= s.fit_tolerance
            else:
                recovered = False
        shift, spread = float(away[: j - i].mean()), float(away[: j - i].std())
        if abs(shift) >= s.least_shift and spread <= s.scatter:
            events.append((i, j, shift, spread, recovered))
        i = max(i + 1, j + (k if recovered else 0))
    return events, i


def shift_events(nodes: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Events of every chain: nodes have ``chain_id``, ``seq``, ``chainage``, ``elevation``.

    Chains are streamed in order of ``seq``: a task holds the rows that the
    fit looks back to and the longest shift ahead, however long the chain is.
    """
    s = settings

    def run(batches):
        none = np.zeros(0)
        chain, held, i = None, (none.astype(np.int64), none, none), s.fit_points

        def scanned(ended):
            nonlocal held, i
            found, i = _scan(held[1], held[2], s, i, ended)
            rows = [(chain[0], int(held[0][a]), int(held[0][b - 1]), b - a, shift, spread, ok) for a, b, shift, spread, ok in found]
            held, i = tuple(x[i - s.fit_points :] for x in held), s.fit_points
            return rows

        kind = None
        for batch in batches:
            kind, rows, start = batch.schema.field(0).type, [], 0
            runs = pc.run_end_encode(batch.column(0))
            columns = [batch.column(c).to_numpy(zero_copy_only=False) for c in (1, 2, 3)]
            for value, end in zip(runs.values.to_pylist(), runs.run_ends.to_pylist()):
                if chain != (value,):
                    rows += scanned(True) if chain else []
                    chain, held, i = (value,), (none.astype(np.int64), none, none), s.fit_points
                held = tuple(np.r_[old, new[start:end]] for old, new in zip(held, columns))
                rows += scanned(False)
                start = end
            yield _batch(rows, kind)
        if chain:
            yield _batch(scanned(True), kind)

    kind = nodes.schema["chain_id"].dataType.simpleString()
    rows = nodes.where("elevation is not null").selectExpr("chain_id", "CAST(seq AS BIGINT) AS seq", "CAST(chainage AS DOUBLE) AS chainage", "CAST(elevation AS DOUBLE) AS elevation")
    ordered = in_order(rows, "chain_id", "seq")
    return ordered.mapInArrow(run, f"chain_id {kind}, first_seq long, last_seq long, n_points long, shift double, scatter double, recovered boolean")


def _batch(rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    kinds = [kind, pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.bool_()]
    return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], t) for c, t in enumerate(kinds)], _EVENTS)


_EVENTS = ["chain_id", "first_seq", "last_seq", "n_points", "shift", "scatter", "recovered"]


def event_groups(events: DataFrame, gap: int, tolerance: float = 0.25) -> DataFrame:
    """Candidates: events whose row ranges follow each other within ``gap`` rows and whose shifts are of one sign and rounded size; each with its score and correction.

    Events that start at one row are in one group, so only the distinct starts
    of a size are put in order: in buckets of rows, of which only the ends
    meet.
    """
    size = F.round(F.col("shift") / (2 * tolerance)).cast("long")
    rows = events.withColumn("size", size)
    rows = rows.join(_range_groups(rows, gap), ["size", "first_seq"])
    groups = rows.groupBy("size", "grp").agg(
        F.min("first_seq").alias("first_seq"), F.max("last_seq").alias("last_seq"), F.countDistinct("chain_id").alias("chains"), F.sum("n_points").alias("n_points"), F.avg("shift").alias("shift"),
        F.bool_and("recovered").alias("recovered"), (F.max("shift") - F.min("shift")).alias("spread"),
    )
    score = F.least(F.lit(40), 8 * F.col("chains")) + F.when(F.col("recovered"), 25).otherwise(-40) + F.when(F.col("spread") <= tolerance, 15).otherwise(0) + 10 + F.when(F.col("chains") >= 2, 10).otherwise(0)
    rows = groups.withColumn("score", score.cast("long"))
    status = F.when((F.col("score") > 80) & F.col("recovered") & (F.col("chains") >= 2), "PROBABLE").when(F.col("score") >= 40, "REVIEW").otherwise("SUPPRESSED")
    return rows.select("first_seq", "last_seq", "chains", "n_points", "shift", (-F.col("shift")).alias("correction"), "recovered", "score", status.alias("status"))


def _range_groups(events: DataFrame, gap: int) -> DataFrame:
    """``(size, first_seq, grp)`` for the distinct starts of each size."""
    starts = events.groupBy("size", "first_seq").agg(F.max("last_seq").alias("last_seq")).withColumn("bucket", F.floor(F.col("first_seq") / START_BUCKET))
    within = Window.partitionBy("size", "bucket").orderBy("first_seq")
    earlier = Window.partitionBy("size").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    ends = starts.groupBy("size", "bucket").agg(F.max("last_seq").alias("last_seq"))
    starts = starts.join(ends.select("size", "bucket", F.max("last_seq").over(earlier).alias("reached")), ["size", "bucket"])
    reach = F.greatest(F.max("last_seq").over(within.rowsBetween(Window.unboundedPreceding, -1)), F.col("reached"))
    starts = starts.withColumn("new", F.coalesce(F.col("first_seq") - reach > gap, F.lit(True)).cast("long"))
    counts = starts.groupBy("size", "bucket").agg(F.sum("new").alias("n"))
    counts = counts.select("size", "bucket", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    return starts.join(counts, ["size", "bucket"]).select("size", "first_seq", (F.col("before") + F.sum("new").over(within)).alias("grp"))


def corrected_points(points: DataFrame, corrections: DataFrame, key: str = "point_id") -> DataFrame:
    """Points with each approved correction added to the heights of the rows it names; a row with corrections that differ raises."""
    per = corrections.groupBy(key).agg(F.min("correction").alias("low"), F.max("correction").alias("high"))
    value = F.when(F.col("high") - F.col("low") > 1e-9, F.raise_error(F.concat(F.lit("corrections differ at "), F.col(key).cast("string"))).cast("double")).otherwise(F.col("low"))
    return points.join(per.select(key, value.alias("correction")), key, "left").withColumn("elevation", F.col("elevation") + F.coalesce("correction", F.lit(0.0))).drop("correction")


@dataclass(frozen=True)
class Correlation:
    """Limits within which events are one candidate, in the units of the data."""

    rows: int = 12
    tolerance: float = 0.10
    distance: float = 150.0
    hazard_radius: float = 25.0


def correlated(events: DataFrame, limits: Correlation = Correlation(), run: str = "run_id") -> DataFrame:
    """``events`` with ``grp``: each event, in order of its first row, joins the newest group that it fits, or begins one.

    It fits a group whose first event began at most ``rows`` before, whose
    last row isn't more than ``rows`` before it, that has no event of its
    chain, begins within ``distance`` of it, and of which every shift is within
    ``tolerance`` of its own.  Events have chain_id, first_seq, last_seq,
    shift, northing and easting (of their first row).  A run's events are
    streamed in order; only groups that can still grow are held.
    """
    columns = [run, "first_seq", "last_seq", "chain_id", "shift", "northing", "easting"]
    extra = [c for c in events.columns if c not in columns]
    rows = events.select(*columns, *extra)
    ordered = in_order(rows, run, "first_seq", "chain_id")

    def group(batches):
        at, groups, number = None, [], 0
        for batch in batches:
            out = []
            for key, first, last, chain, shift, n, e in zip(*[batch.column(c).to_pylist() for c in range(7)]):
                if at != (key,):
                    at, groups, number = (key,), [], 0
                groups = [g for g in groups if first - g["first"] <= limits.rows]
                for g in reversed(groups):
                    near = np.hypot(n - g["n"], e - g["e"]) <= limits.distance
                    if near and first <= g["last"] + limits.rows and chain not in g["chains"] and shift - g["low"] <= limits.tolerance and g["high"] - shift <= limits.tolerance:
                        break
                else:
                    number += 1
                    g = {"id": number, "first": first, "last": last, "n": n, "e": e, "chains": set(), "low": shift, "high": shift}
                    groups.append(g)
                g["chains"].add(chain)
                g["last"], g["low"], g["high"] = max(g["last"], last), min(g["low"], shift), max(g["high"], shift)
                out.append(g["id"])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.int64())], [*batch.schema.names, "grp"])

    kinds = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in rows.columns)
    return ordered.mapInArrow(group, f"{kinds}, grp long")


#: Points of the evidence score, and what hazards of each kind take away (the worst kind counts).
SCORE = {"feature": 8, "features_most": 40, "constant": 25, "scattered": -40, "setup": 15, "surface": 10, "chains": 10}
HAZARDS = {"discontinuity": -50, "ditch": -30, "creek": -30, "structure": -20}


def rod_candidates(points: DataFrame, nodes: DataFrame, events: DataFrame, limits: Correlation = Correlation(), confirmed: bool = False, run: str = "run_id") -> DataFrame:
    """One row a candidate: its rows, shift, scatter, evidence score, status, and a correction if it is ready.

    ``points``: run_id, seq, northing, easting, role.  ``nodes``: run_id,
    chain_id, seq, offset (from the grade before the shift), feature.
    ``events``: as for ``correlated``, with recovered.  A setup among the
    ``rows`` before an event, or at its first row, speaks for it.
    SUPPRESSED: a hazard (discontinuity, ditch, creek, structure) lies within
    the radius of a shifted point.  PROBABLE: the score is over 80, all events
    recover, the scatter is within the tolerance, and every surface point in
    the rows is shifted.  Ready for correction: PROBABLE, confirmed, and no
    point in the rows without a role.
    """
    grouped = correlated(events, limits, run)
    setups = points.where("role = 'setup'").select(run, "seq").distinct()
    asked = grouped.select(run, "grp", F.explode(F.sequence(F.col("first_seq") - limits.rows, F.col("first_seq"))).alias("seq"))
    setups = asked.join(setups, [run, "seq"]).select(run, "grp").distinct().withColumn("setup", F.lit(True))
    w = Window.partitionBy(run, "chain_id").orderBy("_at", F.col("_node"))
    part = F.struct("grp", "last_seq")
    marks = grouped.select(run, "chain_id", F.col("first_seq").alias("_at"), F.lit(0).alias("_node"), part.alias("_e"))
    members = nodes.select(run, "chain_id", F.col("seq").alias("_at"), F.lit(1).alias("_node"), "offset", "feature").unionByName(marks, allowMissingColumns=True)
    members = members.withColumn("_e", F.last("_e", ignorenulls=True).over(w)).where("_node = 1 and _at <= _e.last_seq").select(run, F.col("_e.grp").alias("grp"), F.col("_at").alias("seq"), "offset", "feature")
    shifted = members.groupBy(run, "grp").agg(F.avg("offset").alias("shift"), F.stddev_pop("offset").alias("scatter"), F.countDistinct("feature").alias("features"))
    whole = grouped.groupBy(run, "grp").agg(
        F.min("first_seq").alias("first_seq"), F.max("last_seq").alias("last_seq"), F.count(F.lit(1)).alias("chains"), F.bool_and("recovered").alias("closed"),
    )
    own = members.select(run, "grp", "seq").distinct()
    placed = own.join(points.select(run, "seq", "northing", "easting"), [run, "seq"])
    around = F.explode(around_keys(F.col("northing"), F.col("easting"), limits.hazard_radius))
    risky = points.where(F.col("role").isin(*HAZARDS)).select(run, "role", F.col("northing").alias("n2"), F.col("easting").alias("e2"), cell_key(F.col("northing"), F.col("easting"), limits.hazard_radius).alias("cell"))
    close = F.sqrt((F.col("northing") - F.col("n2")) ** 2 + (F.col("easting") - F.col("e2")) ** 2) <= limits.hazard_radius
    weight = F.create_map(*[x for k, v in HAZARDS.items() for x in (F.lit(k), F.lit(v))])[F.col("role")]
    hazards = placed.withColumn("cell", around).join(risky, [run, "cell"]).where(close).groupBy(run, "grp").agg(F.min(weight).alias("hazard"))
    rows = points.select(run, "seq", "role").where("role = 'surface' or role = 'unknown'")
    spans = whole.select(run, "grp", F.explode(F.sequence("first_seq", "last_seq")).alias("seq"))
    inside = spans.join(rows, [run, "seq"]).join(own.withColumn("_own", F.lit(True)), [run, "grp", "seq"], "left")
    inside = inside.groupBy(run, "grp").agg(F.count_if((F.col("role") == "surface") & F.col("_own").isNull()).alias("conflicting"), F.count_if(F.col("role") == "unknown").alias("unknown"))
    out = whole.join(shifted, [run, "grp"]).join(hazards, [run, "grp"], "left").join(setups, [run, "grp"], "left").join(inside, [run, "grp"], "left")
    constant = F.col("scatter") <= limits.tolerance
    score = (
        F.least(F.lit(SCORE["features_most"]), SCORE["feature"] * F.col("features")) + F.when(constant, SCORE["constant"]).otherwise(SCORE["scattered"]) + F.when(F.col("setup"), SCORE["setup"]).otherwise(0) + SCORE["surface"]
        + F.when(F.col("chains") >= 2, SCORE["chains"]).otherwise(0) + F.coalesce("hazard", F.lit(0))
    )
    out = out.withColumns({"score": F.greatest(F.lit(0), F.least(F.lit(100), score)).cast("long"), "conflicting": F.coalesce("conflicting", F.lit(0)), "unknown": F.coalesce("unknown", F.lit(0))})
    probable = (F.col("score") > 80) & F.col("closed") & constant & (F.col("conflicting") == 0)
    status = F.when(F.col("hazard").isNotNull(), "SUPPRESSED").when(probable, "PROBABLE").otherwise("REVIEW")
    out = out.withColumn("status", status)
    ready = (F.col("status") == "PROBABLE") & F.lit(confirmed) & (F.col("unknown") == 0)
    return out.select(run, "grp", "first_seq", "last_seq", "chains", "features", "shift", "scatter", "conflicting", "unknown", "score", "status", F.when(ready, -F.col("shift")).alias("correction"))
