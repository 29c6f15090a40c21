"""Reductions along ordered rows: levels, traverses, chains, linework, alignments.

A run is one window partition.  Runs are small by nature (one crew, one
instrument day); totals come from aggregates, so only the running sums need
the order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _running(run: str, order: str):
    return Window.partitionBy(run).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)


def _azimuth(angle: Column) -> Column:
    """Degrees from 0 on, as the reference and SQL reduce them: an angle below 0 by no more than the last bit of a sum is 360, which ``pmod`` reduces once more."""
    return angle - 360.0 * F.floor(angle / 360.0)


def _correction(method: str, closure: Column, setups: Column, all_setups: Column, distance: Column, all_distance: Column) -> Column:
    by_setups = setups / F.greatest(all_setups, F.lit(1))
    by_distance = F.when(all_distance > 0, F.when(setups == 0, 0.0).otherwise(distance / F.when(all_distance > 0, all_distance))).otherwise(by_setups)
    share = {"none": F.lit(0.0), "setups": by_setups, "distance": by_distance}[method]
    return F.coalesce(-closure * share, F.lit(0.0))


def level_setups(rows: DataFrame, start: float, known_end: float | None = None, method: str = "none", run: str = "run_id", order: str = "seq") -> DataFrame:
    """Level runs whose rows each have a backsight and a foresight: raw and adjusted elevation after each row, and the run's closure.

    ``distance_bs`` and ``distance_fs`` may be null; a row's distance is the
    larger.  Without a known end the closure is null and nothing is adjusted.
    """
    w, whole = _running(run, order), Window.partitionBy(run)
    rise = F.col("backsight") - F.col("foresight")
    leg = F.greatest(F.coalesce("distance_bs", F.lit(0.0)), F.coalesce("distance_fs", F.lit(0.0)), F.lit(0.0))
    end = F.lit(known_end).cast("double")
    rows = rows.withColumns({"setups": F.count(F.lit(1)).over(w), "raw_elevation": F.lit(start) + F.sum(rise).over(w), "distance": F.sum(leg).over(w)})
    rows = rows.withColumns({"closure": F.lit(start) + F.sum(rise).over(whole) - end, "n": F.count(F.lit(1)).over(whole), "total": F.sum(leg).over(whole)})
    fix = _correction(method, F.col("closure"), F.col("setups"), F.col("n"), F.col("distance"), F.col("total"))
    return rows.select(run, order, F.col("raw_elevation"), (F.col("raw_elevation") + fix).alias("elevation"), "closure")


def level_separate(rows: DataFrame, start: float, known_end: float | None = None, method: str = "none", run: str = "run_id", order: str = "seq") -> DataFrame:
    """Level runs of alternating rows, a backsight and then a foresight.  Backsight rows give the height of instrument."""
    w, whole = _running(run, order), Window.partitionBy(run)
    bs, fs = F.coalesce("backsight", F.lit(0.0)), F.coalesce("foresight", F.lit(0.0))
    leg = F.greatest(F.coalesce("distance_bs", F.lit(0.0)), F.coalesce("distance_fs", F.lit(0.0)), F.lit(0.0))
    rows = rows.withColumns({
        "raw_elevation": F.lit(start) + F.sum(bs - fs).over(w), "setups": F.count("foresight").over(w), "n": F.count("foresight").over(whole),
        "distance": F.sum(leg).over(w), "total": F.sum(leg).over(whole), "closure": F.lit(start) + F.sum(bs - fs).over(whole) - F.lit(known_end).cast("double"),
    })
    fix = _correction(method, F.col("closure"), F.col("setups"), F.col("n"), F.col("distance"), F.col("total"))
    role = F.when(F.col("backsight").isNotNull(), "HEIGHT_OF_INSTRUMENT").otherwise("POINT")
    return rows.select(run, order, role.alias("role"), "raw_elevation", (F.col("raw_elevation") + fix).alias("elevation"), "closure")


def level_stations(rows: DataFrame, start: float, known_end: float | None = None, method: str = "none", run: str = "run_id", order: str = "seq") -> DataFrame:
    """Level runs with a row for each station: a foresight to it (none on the first) and a backsight from it (none on the last)."""
    w, whole = _running(run, order), Window.partitionBy(run)
    before = F.lag("backsight").over(Window.partitionBy(run).orderBy(order))
    rise = F.coalesce(before - F.col("foresight"), F.lit(0.0))
    leg = F.greatest(F.coalesce("distance_bs", F.lit(0.0)), F.coalesce("distance_fs", F.lit(0.0)), F.lit(0.0))
    rows = rows.withColumns({"rise": rise, "leg": leg})
    rows = rows.withColumns({
        "raw_elevation": F.lit(start) + F.sum("rise").over(w), "setups": F.count(F.lit(1)).over(w) - 1, "n": F.count(F.lit(1)).over(whole) - 1,
        "distance": F.sum("leg").over(w), "total": F.sum("leg").over(whole), "closure": F.lit(start) + F.sum("rise").over(whole) - F.lit(known_end).cast("double"),
    })
    fix = _correction(method, F.col("closure"), F.col("setups"), F.col("n"), F.col("distance"), F.col("total"))
    return rows.select(run, order, "raw_elevation", (F.col("raw_elevation") + fix).alias("elevation"), "closure")


def traverse(courses: DataFrame, start_n: float, start_e: float, end_n: float | None = None, end_e: float | None = None, method: str = "bowditch", run: str = "run_id", order: str = "seq") -> DataFrame:
    """Adjusted coordinates after each course (azimuth_deg, distance > 0); without a known end the traverse closes on its start.

    ``precision`` is length over linear closure, null for a perfect closure.
    """
    w, whole = _running(run, order), Window.partitionBy(run)
    rows = courses.where("distance > 0").withColumns({"dn": F.col("distance") * F.cos(F.radians("azimuth_deg")), "de": F.col("distance") * F.sin(F.radians("azimuth_deg"))})
    total = lambda c: F.sum(c).over(whole)
    to_n, to_e = (start_n if end_n is None else end_n) - start_n, (start_e if end_e is None else end_e) - start_e
    rows = rows.withColumns({"close_n": total("dn") - to_n, "close_e": total("de") - to_e, "length": total("distance"), "abs_n": total(F.abs("dn")), "abs_e": total(F.abs("de"))})
    fix = {
        "none": (F.lit(0.0), F.lit(0.0)),
        "bowditch": (-F.col("close_n") * F.col("distance") / F.col("length"), -F.col("close_e") * F.col("distance") / F.col("length")),
        "transit": (-F.coalesce(F.try_divide(F.col("close_n") * F.abs("dn"), F.col("abs_n")), F.lit(0.0)), -F.coalesce(F.try_divide(F.col("close_e") * F.abs("de"), F.col("abs_e")), F.lit(0.0))),
    }[method]
    linear = F.sqrt(F.col("close_n") * F.col("close_n") + F.col("close_e") * F.col("close_e"))
    rows = rows.withColumns({"adj_n": F.col("dn") + fix[0], "adj_e": F.col("de") + fix[1]})
    return rows.select(
        run, order, (F.lit(start_n) + F.sum("adj_n").over(w)).alias("northing"), (F.lit(start_e) + F.sum("adj_e").over(w)).alias("easting"),
        linear.alias("linear_closure"), F.when(linear != 0, F.col("length") / F.when(linear != 0, linear)).alias("precision"),
    )


def elevation_jumps(points: DataFrame, jump: float, distance: float, run: str = "source_id", order: str = "seq") -> DataFrame:
    """Rows that differ by ``jump`` or more in height from the row before, at most ``distance`` away.  A row without coordinates breaks the chain."""
    w = Window.partitionBy(run).orderBy(order)
    cols = ("northing", "easting", "elevation")
    rows = points.withColumns({f"p_{c}": F.lag(c).over(w) for c in cols})
    gap = F.sqrt((F.col("northing") - F.col("p_northing")) ** 2 + (F.col("easting") - F.col("p_easting")) ** 2)
    dz = F.col("elevation") - F.col("p_elevation")
    return rows.select(run, order, gap.alias("gap"), dz.alias("dz")).where((F.col("gap") <= distance) & (F.abs("dz") >= jump))


def chains(points: DataFrame, limit: float, key: str = "string_id", order: str = "seq") -> DataFrame:
    """Chain number and chainage of each point: a chain ends at a gap over ``limit``, at coincident points, after ES and before BS.

    ``command`` is BS, ES or something else.
    """
    w = Window.partitionBy(key).orderBy(order)
    step = F.sqrt((F.col("northing") - F.lag("northing").over(w)) ** 2 + (F.col("easting") - F.lag("easting").over(w)) ** 2)
    rows = points.withColumns({"step": step, "after_end": F.coalesce(F.lag("command").over(w) == "ES", F.lit(False))})
    new = F.col("step").isNull() | (F.col("step") > limit) | (F.col("step") <= 1e-8) | (F.col("command") == "BS") | F.col("after_end")
    rows = rows.withColumn("chain", F.sum(new.cast("long")).over(w)).withColumn("step", F.when(new, 0.0).otherwise(F.col("step")))
    inside = Window.partitionBy(key, "chain").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("chainage", F.sum("step").over(inside)).select(key, order, "chain", "chainage")


def local_grades(nodes: DataFrame, k: int, key: str = "chain_id", order: str = "seq", x: str = "chainage", z: str = "elevation") -> DataFrame:
    """Least-squares grade of the ``k`` nodes before each node, and the node's offset from its extension; null until ``k`` nodes are there."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(-k, -1)
    n, sx, sz = F.count(F.lit(1)).over(w), F.sum(x).over(w), F.sum(z).over(w)
    sxx, sxz = F.sum(F.col(x) * F.col(x)).over(w), F.sum(F.col(x) * F.col(z)).over(w)
    rows = nodes.withColumns({"n": n, "sx": sx, "sz": sz, "sxx": sxx, "sxz": sxz})
    spread = F.col("n") * F.col("sxx") - F.col("sx") * F.col("sx")
    slope = F.when((F.col("n") == k) & (spread > 1e-9), (F.col("n") * F.col("sxz") - F.col("sx") * F.col("sz")) / F.when(spread > 1e-9, spread))
    rows = rows.withColumn("slope", slope)
    meet = (F.col("sz") - F.col("slope") * F.col("sx")) / F.col("n")
    return rows.select(key, order, "slope", (F.col(z) - meet - F.col("slope") * F.col(x)).alias("offset"))


def linework(points: DataFrame, line: str = "line_id", order: str = "seq") -> DataFrame:
    """Lines from coded points (``command``: BS, ES, CL, PC, PT or null): one row a line part with its vertex count, status and flags.

    A part begins at BS, at the line's first point, and after ES or CL.  CL
    closes it (the first vertex is counted again), ES completes it, another BS
    before that leaves it for REVIEW, and else it is OPEN.  Flags: a part
    without BS, without an end, or with curve commands that don't pair.
    """
    w = Window.partitionBy(line).orderBy(order)
    command = F.coalesce(F.upper("command"), F.lit(""))
    rows = points.withColumn("command", command)
    ended = F.coalesce(F.lag("command").over(w).isin("ES", "CL"), F.lit(True))
    rows = rows.withColumn("part", F.sum(((F.col("command") == "BS") | ended).cast("long")).over(w))
    inside = Window.partitionBy(line, "part").orderBy(order)
    curve = F.when(F.col("command").isin("PC", "PT"), F.col("command"))
    rows = rows.withColumn("before", F.last(curve, ignorenulls=True).over(inside.rowsBetween(Window.unboundedPreceding, -1))).withColumn("curve", curve)
    last = F.max_by("command", order)
    parts = rows.groupBy(line, "part").agg(
        F.count(F.lit(1)).alias("n"), F.min(order).alias("first_seq"), F.min_by("command", order).alias("first"), last.alias("last"), F.max_by("curve", F.when(F.col("curve").isNotNull(), F.col(order))).alias("last_curve"),
        F.bool_or((F.col("curve") == "PC") & F.coalesce(F.col("before") == "PC", F.lit(False))).alias("nested"), F.bool_or((F.col("curve") == "PT") & F.coalesce(F.col("before") != "PC", F.lit(True))).alias("unpaired"),
    )
    again = F.lead("first").over(Window.partitionBy(line).orderBy("part"))
    status = F.when(F.col("last") == "ES", "COMPLETE").when(F.col("last") == "CL", "COMPLETE_CLOSED").when(again.isNotNull(), "REVIEW").otherwise("OPEN")
    parts = parts.withColumn("status", status)
    flags = (
        (F.col("status") == "REVIEW", "RESTARTED"), (F.col("first") != "BS", "NO_START"), (F.col("status") == "OPEN", "NO_END"), (F.col("nested"), "NESTED_PC"), (F.col("unpaired"), "PT_WITHOUT_PC"), (F.col("last_curve") == "PC", "PC_OPEN"),
    )
    return parts.select(line, "part", "first_seq", (F.col("n") + (F.col("status") == "COMPLETE_CLOSED").cast("long")).alias("vertices"), "status", F.concat_ws(",", *[F.when(c, name) for c, name in flags]).alias("flags"))


def closure_gaps(parts: DataFrame, key: str = "drawing_id", order: str = "seq") -> DataFrame:
    """Gap from the end of each ordered part to the start of the next; the last meets the first."""
    w = Window.partitionBy(key).orderBy(order)
    first = lambda c: F.first(c).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    nn, ne = F.coalesce(F.lead("start_n").over(w), first("start_n")), F.coalesce(F.lead("start_e").over(w), first("start_e"))
    rows = parts.withColumns({"dn": nn - F.col("end_n"), "de": ne - F.col("end_e")})
    return rows.select(key, order, "dn", "de", F.sqrt(F.col("dn") ** 2 + F.col("de") ** 2).alias("gap"))


def horizontal_alignment(elements: DataFrame, start_n: float, start_e: float, azimuth: float, station: float, key: str = "alignment_id", order: str = "seq") -> DataFrame:
    """Start and end station, coordinates and azimuth of each tangent or curve.

    Elements have ``kind`` (tangent or curve), ``length`` (tangents), and
    ``radius``, ``delta_deg`` and ``direction`` (LEFT or RIGHT; curves).
    Azimuths accumulate first; then each curve adds its chord.
    """
    w = _running(key, order)
    curve = F.col("kind") == "curve"
    turn = F.when(curve, F.when(F.col("direction") == "LEFT", -F.col("delta_deg")).otherwise(F.col("delta_deg"))).otherwise(0.0)
    run = F.when(curve, F.col("radius") * F.radians("delta_deg")).otherwise(F.col("length"))
    chord = F.when(curve, 2 * F.col("radius") * F.sin(F.radians("delta_deg") / 2)).otherwise(F.col("length"))
    rows = elements.withColumns({"turn": turn, "run": run, "chord": chord}).withColumn("out", F.lit(azimuth) + F.sum("turn").over(w))
    along = F.radians(F.col("out") - F.col("turn") / 2)
    rows = rows.withColumns({"dn": F.col("chord") * F.cos(along), "de": F.col("chord") * F.sin(along)})
    rows = rows.withColumns({"end_n": F.lit(start_n) + F.sum("dn").over(w), "end_e": F.lit(start_e) + F.sum("de").over(w), "end_station": F.lit(station) + F.sum("run").over(w)})
    return rows.select(
        key, order, (F.col("end_station") - F.col("run")).alias("start_station"), "end_station",
        (F.col("end_n") - F.col("dn")).alias("start_n"), (F.col("end_e") - F.col("de")).alias("start_e"), "end_n", "end_e",
        _azimuth(F.col("out") - F.col("turn")).alias("azimuth_in"), _azimuth(F.col("out")).alias("azimuth_out"),
    )


def curve_stakes(curves: DataFrame, interval: float) -> DataFrame:
    """Stakes of each curve (``curve_id``, ``pc_station``, ``radius``, ``delta_deg``): its start, the full stations inside, its end; with deflection and chord from the start."""
    end = F.col("pc_station") + F.col("radius") * F.radians("delta_deg")
    first = (F.floor(F.col("pc_station") / interval) + 1).cast("long")
    last = F.when(F.floor(end / interval) * interval == end, F.floor(end / interval) - 1).otherwise(F.floor(end / interval)).cast("long")
    full = F.when(last >= first, F.transform(F.sequence(first, F.greatest(first, last)), lambda k: k * F.lit(interval))).otherwise(F.array().cast("array<double>"))
    rows = curves.select("curve_id", "pc_station", "radius", F.explode(F.concat(F.array("pc_station"), full, F.array(end))).alias("station"))
    half = (F.col("station") - F.col("pc_station")) / (2 * F.col("radius"))
    return rows.select("curve_id", "station", F.degrees(half).alias("deflection_deg"), (2 * F.col("radius") * F.sin(half)).alias("chord"))


def points_at_stations(elements: DataFrame, stations: DataFrame, key: str = "alignment_id", order: str = "seq") -> DataFrame:
    """Coordinates and tangent azimuth at each station of an alignment; nulls where the station is beyond its ends.

    ``elements`` are those of ``horizontal_alignment`` with kind, radius and
    direction; a station where two meet belongs to the first.
    """
    names = ["start_station", "end_station", "start_n", "start_e", "azimuth_in", "kind", "radius", "direction"]
    part = F.struct(F.col(order).alias("element"), *names)
    both = elements.select(key, F.col("start_station").alias("_at"), F.lit(None).cast("double").alias("station"), part.alias("_part")).unionByName(
        stations.select(key, (F.col("station") - 1e-9).alias("_at"), F.col("station").cast("double").alias("station")), allowMissingColumns=True
    )
    w = Window.partitionBy(key).orderBy("_at", F.col("station").isNull())
    before = F.last("_part", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    after = F.first("_part", ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    first = both.withColumn("_e", F.coalesce(before, after)).where("station is not null").select(key, "station", "_e.*")
    inside = (F.col("station") >= F.col("start_station") - 1e-9) & (F.col("station") <= F.col("end_station") + 1e-9)
    run = F.greatest(F.lit(0.0), F.least(F.col("station"), F.col("end_station")) - F.col("start_station"))
    curve = F.col("kind") == "curve"
    sweep = F.when(curve, run / F.col("radius")).otherwise(0.0)
    sign = F.when(F.col("direction") == "LEFT", -1.0).otherwise(1.0)
    chord = F.when(curve, 2 * F.col("radius") * F.sin(sweep / 2)).otherwise(run)
    along = F.radians("azimuth_in") + sign * sweep / 2
    value = lambda c: F.when(inside, c)
    return first.select(
        key, "station", value(F.col("start_n") + chord * F.cos(along)).alias("northing"), value(F.col("start_e") + chord * F.sin(along)).alias("easting"),
        value(_azimuth(F.col("azimuth_in") + sign * F.degrees(sweep))).alias("azimuth"), value(F.col("element")).alias("element"),
    )


#: The rows of a setup's backsight and foresight, as multiples of its number and an offset, in each row layout.
SIGHTS = {"differential_setups": ((1, 0), (1, 0)), "separate_sights": ((2, -1), (2, 0)), "station_rows": ((1, 0), (1, 1))}


def recheck_sights(rows: DataFrame, requests: DataFrame, run: str = "run_id") -> DataFrame:
    """The two sights of each setup that is to be rechecked: run, setup_no, side, sequence_no, point_id, and whether the level book has both.

    ``rows``: run, sequence_no, point_id, backsight, foresight.  ``requests``:
    run, layout, setup_no.  A setup of an unknown layout has no sights.
    """
    places = [
        F.when(F.col("layout") == layout, F.array(*[F.struct(F.lit(side).alias("side"), (F.col("setup_no") * m + o).alias("sequence_no")) for side, (m, o) in zip(("BS", "FS"), sides)])) for layout, sides in SIGHTS.items()
    ]
    asked = requests.select(run, "setup_no", F.explode(F.coalesce(*places)).alias("s")).select(run, "setup_no", "s.side", F.col("s.sequence_no").cast("long").alias("sequence_no"))
    found = asked.join(rows.select(run, F.col("sequence_no").cast("long").alias("sequence_no"), "point_id", "backsight", "foresight"), [run, "sequence_no"], "left")
    there = F.when(F.col("side") == "BS", F.col("backsight")).otherwise(F.col("foresight")).isNotNull()
    both = F.bool_and(there).over(Window.partitionBy(run, "setup_no"))
    return found.select(run, "setup_no", "side", "sequence_no", "point_id", both.alias("complete"))


def replaced_sights(rows: DataFrame, returned: DataFrame, run: str = "run_id") -> DataFrame:
    """``rows`` of a level book with the readings that came back: each returned sight (run, sequence_no, side, reading) replaces just that sight; the latest by ``seq`` wins."""
    newest = returned.groupBy(run, "sequence_no").pivot("side", ["BS", "FS"]).agg(F.max_by("reading", "seq"))
    joined = rows.join(newest, [run, "sequence_no"], "left")
    return joined.withColumns({"backsight": F.coalesce("BS", "backsight"), "foresight": F.coalesce("FS", "foresight")}).select(*rows.columns)
