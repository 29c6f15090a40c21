"""Areas, earthwork, and joins by place on a uniform grid."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.operators.cells import around_keys, cell_key, key_of, segment_cells
from plumbline.operators.graph import connected_components

#: How often ``nearest_neighbours`` halves its radius.
HALVES = 6


def polygon_measures(vertices: DataFrame, key: str = "polygon_id", order: str = "seq") -> DataFrame:
    """Area, perimeter, centroid and orientation; vertices are taken relative to the polygon's first one."""
    w = Window.partitionBy(key).orderBy(order)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = vertices.withColumns({"n0": F.first("northing").over(whole), "e0": F.first("easting").over(whole)})
    rows = rows.withColumns({"y": F.col("northing") - F.col("n0"), "x": F.col("easting") - F.col("e0")})
    rows = rows.withColumns({"y2": F.coalesce(F.lead("y").over(w), F.lit(0.0)), "x2": F.coalesce(F.lead("x").over(w), F.lit(0.0))})
    cross = F.col("x") * F.col("y2") - F.col("x2") * F.col("y")
    rows = rows.withColumn("cross", cross)
    sums = rows.groupBy(key).agg(
        F.sum("cross").alias("twice"), F.sum(F.sqrt((F.col("x2") - F.col("x")) ** 2 + (F.col("y2") - F.col("y")) ** 2)).alias("perimeter"),
        F.sum((F.col("x") + F.col("x2")) * F.col("cross")).alias("cx"), F.sum((F.col("y") + F.col("y2")) * F.col("cross")).alias("cy"),
        F.first("n0").alias("n0"), F.first("e0").alias("e0"), F.count(F.lit(1)).alias("vertices"),
    )
    ok = F.abs("twice") > 1e-12
    safe = F.when(ok, F.col("twice"))
    return sums.select(
        key, "vertices", (F.abs("twice") / 2).alias("area"), "perimeter", (F.col("n0") + F.col("cy") / (3 * safe)).alias("centroid_n"), (F.col("e0") + F.col("cx") / (3 * safe)).alias("centroid_e"),
        F.when(~ok, "DEGENERATE").when(F.col("twice") > 0, "CCW").otherwise("CW").alias("orientation"),
    )


def average_end_area(sections: DataFrame, key: str = "line_id", order: str = "station") -> DataFrame:
    """Cut and fill volume of each interval between sections, running totals and the mass ordinate."""
    w = Window.partitionBy(key).orderBy(order)
    rows = sections.withColumns({"d": F.col(order) - F.lag(order).over(w), "cut": (F.col("cut_area") + F.lag("cut_area").over(w)) / 2, "fill": (F.col("fill_area") + F.lag("fill_area").over(w)) / 2})
    rows = rows.withColumns({"cut_volume": F.coalesce(F.col("cut") * F.col("d"), F.lit(0.0)), "fill_volume": F.coalesce(F.col("fill") * F.col("d"), F.lit(0.0))})
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    return rows.select(key, order, "cut_volume", "fill_volume", F.sum(F.col("cut_volume") - F.col("fill_volume")).over(run).alias("ordinate"))


def _filled(side: DataFrame, key: str, tag: str) -> DataFrame:
    return side.select(key, "offset", F.col("elevation").alias(tag))


def cut_fill(ground: DataFrame, design: DataFrame, key: str = "section_id") -> DataFrame:
    """Cut and fill area of each cross section where both profiles reach.

    Offsets of both profiles are merged; each profile is interpolated between
    its own neighbours; where ground and design cross, an interval is split.
    """
    both = _filled(ground, key, "g").join(_filled(design, key, "d"), [key, "offset"], "full_outer")
    up, down = Window.partitionBy(key).orderBy("offset").rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy(key).orderBy("offset").rowsBetween(0, Window.unboundedFollowing)

    def level(c: str) -> Column:
        here = F.when(F.col(c).isNotNull(), F.struct("offset", c))
        a, b = F.last(here, ignorenulls=True).over(up), F.first(here, ignorenulls=True).over(down)
        run = b["offset"] - a["offset"]
        return F.when(F.col(c).isNotNull(), F.col(c)).otherwise(a[c] + (b[c] - a[c]) * (F.col("offset") - a["offset"]) / F.when(run != 0, run))

    rows = both.withColumns({"gz": level("g"), "dz": level("d")}).where("gz is not null and dz is not null")
    w = Window.partitionBy(key).orderBy("offset")
    rows = rows.withColumn("diff", F.col("gz") - F.col("dz")).withColumns({"width": F.lead("offset").over(w) - F.col("offset"), "diff2": F.lead("diff").over(w)})
    a, b, width = F.col("diff"), F.col("diff2"), F.col("width")
    split = a * b < 0
    at = F.abs(a) / F.when(split, F.abs(a) + F.abs(b))
    left, right = F.abs(a) * width * at / 2, F.abs(b) * width * (1 - at) / 2
    mean = (a + b) * width / 2
    cut = F.when(split, F.when(a > 0, left).otherwise(right)).otherwise(F.greatest(mean, F.lit(0.0)))
    fill = F.when(split, F.when(a < 0, left).otherwise(right)).otherwise(F.greatest(-mean, F.lit(0.0)))
    return rows.where("width is not null").groupBy(key).agg(F.sum(cut).alias("cut_area"), F.sum(fill).alias("fill_area"), F.sum(width).alias("width"))


def _near(a: DataFrame, b: DataFrame, radius: float) -> DataFrame:
    """Rows of ``a`` (na, ea) and ``b`` (nb, eb) whose places are within ``radius``, with their distance.  Each row of ``b`` is put in the nine cells around it, so only neighbours meet."""
    left = a.withColumn("cell", cell_key(F.col("na"), F.col("ea"), radius))
    right = b.withColumn("cell", F.explode(around_keys(F.col("nb"), F.col("eb"), radius)))
    distance = F.sqrt((F.col("na") - F.col("nb")) ** 2 + (F.col("ea") - F.col("eb")) ** 2)
    return left.join(right, "cell").withColumn("distance", distance).where(F.col("distance") <= radius).drop("cell")


def _placed(points: DataFrame, key: str, tag: str) -> DataFrame:
    rows = points.where("northing is not null and easting is not null")
    return rows.select(F.col(key).alias(f"id_{tag}"), F.col("northing").alias(f"n{tag}"), F.col("easting").alias(f"e{tag}"), F.col("elevation").alias(f"z{tag}"))


def grid_pairs(points: DataFrame, radius: float, key: str = "point_id") -> DataFrame:
    """Pairs ``(id_a < id_b)`` within ``radius``, with their distance.  A point without coordinates has no pair.

    The result has every pair; where only groups or the nearest are wanted,
    ``clusters`` and ``nearest_neighbours`` don't make them.
    """
    pairs = _near(_placed(points, key, "a"), _placed(points, key, "b"), radius).where("id_a < id_b")
    return pairs.select("id_a", "id_b", "distance", (F.col("zb") - F.col("za")).alias("dz"))


def clusters(points: DataFrame, radius: float, key: str = "point_id") -> DataFrame:
    """``(node, component)`` for points that others are within ``radius`` of: the smallest id that can be reached by such steps.

    Points of equal coordinates are one place.  Places in one cell that is
    small enough (its diagonal is ``radius``) are all linked, so each is tied
    to the cell's first place; only pairs of places in different cells are
    compared, and what is kept of them is which cells they link.
    """
    rows = points.where("northing is not null and easting is not null")
    places = rows.groupBy(F.col("northing").cast("double").alias("n"), F.col("easting").cast("double").alias("e")).agg(F.min(key).alias("id"))
    small = radius / 2**0.5 * (1 - 1e-12)
    places = places.withColumn("own", key_of(F.floor(F.col("n") / small), F.floor(F.col("e") / small)))
    heads = places.groupBy("own").agg(F.min("id").alias("head"))
    inside = places.join(heads, "own").select(F.col("id").alias("a"), F.col("head").alias("b"))
    side = lambda tag: places.select(F.col("id").alias(f"id_{tag}"), F.col("n").alias(f"n{tag}"), F.col("e").alias(f"e{tag}"), F.col("own").alias(f"own_{tag}"))
    across = _near(side("a"), side("b"), radius).where("own_a < own_b").select("own_a", "own_b").distinct()
    head = lambda c, of: heads.select(F.col("own").alias(f"own_{c}"), F.col("head").alias(of))
    across = across.join(head("a", "a"), "own_a").join(head("b", "b"), "own_b").select("a", "b")
    same = rows.join(places, (rows["northing"] == places["n"]) & (rows["easting"] == places["e"])).select(rows[key].alias("a"), F.col("id").alias("b"))
    return connected_components(inside.unionByName(across).unionByName(same))


def layered_clusters(points: DataFrame, radius: float, vertical: float, key: str = "point_id") -> DataFrame:
    """``clusters`` whose steps also bridge at most ``vertical`` in height, where both points have one.

    Points of equal coordinates are cut into layers where their sorted heights
    leave a gap of more than ``vertical``; one without height ties all of its
    place together.  Inside a layer's span every height has a member within
    ``vertical``, so two layers of different places are linked exactly if
    their spans come that near.  Only layers are compared, so n shots at one
    place make no n^2 pairs.
    """
    rows = points.where("northing is not null and easting is not null").select(F.col(key).alias("id"), F.col("northing").cast("double").alias("n"), F.col("easting").cast("double").alias("e"), F.col("elevation").cast("double").alias("z"))
    bare = F.max(F.col("z").isNull()).over(Window.partitionBy("n", "e"))
    by_height = Window.partitionBy("n", "e").orderBy("z", "id")
    gap = F.col("z") - F.lag("z").over(by_height) > vertical
    rows = rows.withColumns({"bare": bare, "new": F.coalesce(gap, F.lit(False)).cast("long")})
    rows = rows.withColumn("layer", F.when(F.col("bare"), 0).otherwise(F.sum("new").over(by_height)))
    span = lambda f: F.when(~F.bool_or("bare"), f("z"))
    layers = rows.groupBy("n", "e", "layer").agg(F.min("id").alias("head"), span(F.min).alias("low"), span(F.max).alias("high"))
    side = lambda tag: layers.select(F.col("head").alias(f"id_{tag}"), F.col("n").alias(f"n{tag}"), F.col("e").alias(f"e{tag}"), F.col("low").alias(f"low_{tag}"), F.col("high").alias(f"high_{tag}"))
    apart = F.greatest("low_a", "low_b") - F.least("high_a", "high_b")
    near = F.col("low_a").isNull() | F.col("low_b").isNull() | (apart <= vertical)
    across = _near(side("a"), side("b"), radius).where(F.col("id_a") < F.col("id_b")).where(near & (F.col("distance") > 0)).select(F.col("id_a").alias("a"), F.col("id_b").alias("b"))
    same = rows.join(layers.select("n", "e", "layer", "head"), ["n", "e", "layer"]).select(F.col("id").alias("a"), F.col("head").alias("b"))
    return connected_components(across.unionByName(same))


def neighbours(points: DataFrame, radius: float, key: str = "point_id") -> DataFrame:
    """Both directions of ``grid_pairs``: ``(point, neighbour, distance, dz)`` with dz as neighbour minus point."""
    p = grid_pairs(points, radius, key)
    return p.select(F.col("id_a").alias("point"), F.col("id_b").alias("neighbour"), "distance", "dz").unionByName(p.select(F.col("id_b").alias("point"), F.col("id_a").alias("neighbour"), "distance", (-F.col("dz")).alias("dz")))


def nearest_neighbours(points: DataFrame, radius: float, k: int = 6, key: str = "point_id") -> DataFrame:
    """The ``k`` nearest neighbours within ``radius`` of each point, nearest first; ties by id.

    Of points at one place only the first ``k + 1`` by id can be among
    anyone's nearest, so only those are put up as neighbours.

    A point looks as far as a cell around it that has ``k + 1`` points is
    wide: the smallest of cells whose diagonals are ``radius`` and its halves
    (``radius`` where none has them).  So the denser points lie, the fewer
    cells they meet in.
    """
    placed = _placed(points, key, "b").withColumn("at_place", F.row_number().over(Window.partitionBy("nb", "eb").orderBy("id_b"))).where(F.col("at_place") <= k + 1).drop("at_place")
    reaches = F.array(*[F.struct(F.lit(radius / 2**i).alias("reach"), F.lit(i > 0).alias("half")) for i in range(HALVES + 1)])
    at_all = lambda rows: rows.withColumn("r", F.explode(reaches)).select(*rows.columns, "r.*")
    inside = lambda tag: cell_key(F.col(f"n{tag}"), F.col(f"e{tag}"), F.col("reach") / 2**0.5 * (1 - 1e-9)).alias("own")
    full = at_all(placed).where("half").groupBy("reach", inside("b")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > k).select("reach", "own", F.lit(True).alias("full"))
    looked = at_all(_placed(points, key, "a")).withColumn("own", inside("a")).join(full, ["reach", "own"], "left").where("full or not half")
    looking = looked.groupBy("id_a", "na", "ea").agg(F.min("reach").alias("reach"))
    met = looking.withColumn("cell", F.explode(around_keys(F.col("na"), F.col("ea"), F.col("reach")))).join(at_all(placed).withColumn("cell", cell_key(F.col("nb"), F.col("eb"), F.col("reach"))), ["reach", "cell"])
    distance = F.sqrt((F.col("na") - F.col("nb")) ** 2 + (F.col("ea") - F.col("eb")) ** 2)
    near = met.withColumn("distance", distance).where((F.col("distance") <= F.col("reach")) & (F.col("id_a") != F.col("id_b")))
    w = Window.partitionBy("point").orderBy("distance", "neighbour")
    ranked = near.select(F.col("id_a").alias("point"), F.col("id_b").alias("neighbour"), "distance").withColumn("place", F.row_number().over(w))
    return ranked.where(F.col("place") <= k).select("point", "place", "neighbour", "distance")


def rod_busts(points: DataFrame, radius: float, increments: tuple[float, ...] = (0.5, 1.0, 2.0), tolerance: float = 0.08, least: float = 0.45, slope_percent: float = 8.0, key: str = "point_id") -> DataFrame:
    """Points whose height is off the median of two or more neighbours by nearly a rod increment.

    Neighbours at distance zero don't count.  ``confidence`` weighs closeness
    to the increment, slope to the nearest neighbour, and their number.

    All points of one place have the same neighbours, so places, not points,
    are put beside them.
    """
    rows = _placed(points.where("elevation is not null"), key, "b")
    places = rows.select(F.col("nb").alias("na"), F.col("eb").alias("ea")).distinct()
    near = _near(places, rows, radius).where("distance > 0")
    stats = near.groupBy("na", "ea").agg(F.count(F.lit(1)).alias("n"), F.median("zb").alias("middle"), F.min_by("distance", F.struct("distance", "id_b")).alias("nearest")).where("n >= 2")
    own = rows.select(F.col("id_b").alias("point"), F.col("nb").alias("na"), F.col("eb").alias("ea"), "zb")
    stats = own.join(stats, ["na", "ea"]).withColumn("delta", F.col("zb") - F.col("middle"))
    options = F.array(*[F.struct(F.abs(F.abs("delta") - i).alias("error"), F.lit(i).alias("increment")) for i in increments])
    stats = stats.withColumn("match", F.array_min(options)).withColumn("slope", F.abs("delta") / F.col("nearest") * 100)
    hits = stats.where((F.abs("delta") >= least) & (F.col("match.error") <= tolerance) & (F.col("slope") >= slope_percent))
    score = 100 * (0.55 * (1 - F.col("match.error") / tolerance) + 0.30 * F.least(F.lit(1.0), F.col("slope") / max(3 * slope_percent, 1.0)) + 0.15 * F.least(F.lit(1.0), F.col("n") / 5.0))
    return hits.select("point", "n", "delta", F.col("match.increment").alias("increment"), "slope", score.alias("confidence"))


def nearest_structure(targets: DataFrame, structures: DataFrame, tolerance: float) -> DataFrame:
    """For each target the nearest structure within ``tolerance`` (ties by id), or ``missing``; joined by cells of that size."""
    cell = lambda c: F.floor(F.col(c) / tolerance).cast("long")
    around = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)]))
    t = targets.select(F.col("point_id").alias("target"), F.col("northing").alias("tn"), F.col("easting").alias("te"), around.alias("s")).select(
        "target", "tn", "te", (F.floor(F.col("tn") / tolerance).cast("long") + F.col("s.i")).alias("cn"), (F.floor(F.col("te") / tolerance).cast("long") + F.col("s.j")).alias("ce")
    )
    s = structures.select(F.col("point_id").alias("structure"), "northing", "easting", cell("northing").alias("cn"), cell("easting").alias("ce"))
    distance = F.sqrt((F.col("northing") - F.col("tn")) ** 2 + (F.col("easting") - F.col("te")) ** 2)
    best = t.join(s, ["cn", "ce"]).withColumn("distance", distance).where(F.col("distance") <= tolerance).groupBy("target").agg(F.min(F.struct("distance", "structure")).alias("m"))
    all_targets = targets.select(F.col("point_id").alias("target"))
    return all_targets.join(best, "target", "left").select("target", F.col("m.structure").alias("structure"), F.col("m.distance").alias("distance"), F.when(F.col("m").isNull(), "missing").otherwise("found").alias("status"))


def station_offset(points: DataFrame, segments: DataFrame, limit: float) -> DataFrame:
    """Station and offset (LEFT positive) of each point on its nearest segment within ``limit``; ties go to the first segment.

    Segments have ``seq``, ``n1, e1, n2, e2`` and ``station``.  They are put
    in the cells that they pass within ``limit``; a point looks only in its
    own cell.  It looks twice: for its least distance, a number that is
    reduced as the pairs are made, and then for what lies at that distance.
    So no pair is kept or sorted.
    """
    seg = segment_cells(segments, limit, limit)
    pts = points.select("point_id", "northing", "easting", cell_key(F.col("northing"), F.col("easting"), limit).alias("cell"))
    dn, de = F.col("n2") - F.col("n1"), F.col("e2") - F.col("e1")
    length2 = dn * dn + de * de
    pn, pe = F.col("northing") - F.col("n1"), F.col("easting") - F.col("e1")
    t = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (pn * dn + pe * de) / length2))
    off_n, off_e = pn - F.col("t") * dn, pe - F.col("t") * de

    def beside(some: DataFrame) -> DataFrame:
        rows = some.join(seg.where(length2 > 0), "cell").withColumn("t", t)
        rows = rows.withColumns({"distance": F.sqrt(off_n * off_n + off_e * off_e), "side": F.signum(dn * pe - de * pn), "along": F.col("station") + F.col("t") * F.sqrt(length2)}).where(F.col("distance") <= limit)
        return rows.withColumn("rounded", F.round("distance", 9))

    nearest = beside(pts).groupBy("point_id").agg(F.min("rounded").alias("least"))
    rows = beside(pts.join(nearest, "point_id")).where("rounded = least")
    best = rows.groupBy("point_id").agg(F.min_by(F.struct("seq", "along", (-F.col("side") * F.col("distance")).alias("offset")), "seq").alias("m"))
    return best.select("point_id", F.col("m.seq").alias("seq"), F.col("m.along").alias("station"), F.col("m.offset").alias("offset"))


def duplicate_segments(segments: DataFrame) -> DataFrame:
    """Segments with the same two ends in either direction as an earlier one (by ``seq``), with that one's ``seq``."""
    ends = F.array_sort(F.array(F.struct(F.col("n1").alias("n"), F.col("e1").alias("e")), F.struct(F.col("n2").alias("n"), F.col("e2").alias("e"))))
    w = Window.partitionBy("ends").orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return segments.withColumn("ends", ends).withColumn("first_seq", F.min("seq").over(w)).where("seq > first_seq").select("seq", "first_seq")


def crossings(segments: DataFrame, cell: float) -> DataFrame:
    """Pairs of segments that cross properly (not at an end), by the grid cells that they pass; each pair once.

    Two that pass several cells together are a pair in the least of those, so
    pairs are neither kept nor moved to make them distinct; ``seq`` is unique.
    """
    boxed = segment_cells(segments, cell, cell * 1e-9, listed=True)
    side = lambda s: boxed.select("cell", *[F.col(c).alias(f"{c}_{s}") for c in ("seq", "n1", "e1", "n2", "e2", "cells")])
    turn = lambda an, ae, bn, be, cn, ce: (F.col(be) - F.col(ae)) * (F.col(cn) - F.col(an)) - (F.col(bn) - F.col(an)) * (F.col(ce) - F.col(ae))
    d1, d2 = turn("n1_a", "e1_a", "n2_a", "e2_a", "n1_b", "e1_b"), turn("n1_a", "e1_a", "n2_a", "e2_a", "n2_b", "e2_b")
    d3, d4 = turn("n1_b", "e1_b", "n2_b", "e2_b", "n1_a", "e1_a"), turn("n1_b", "e1_b", "n2_b", "e2_b", "n2_a", "e2_a")
    first = F.col("cell") == F.array_min(F.array_intersect("cells_a", "cells_b"))
    pairs = side("a").join(side("b"), "cell").where("seq_a < seq_b").where((d1 * d2 < 0) & (d3 * d4 < 0)).where(first)
    return pairs.select("seq_a", "seq_b")


def slope_catch(ground: DataFrame, design: DataFrame, centre: DataFrame, key: str = "section_id") -> DataFrame:
    """Where the outer slope of a design template, carried on, meets the ground: one row a section and side.

    ``ground`` has offset and elevation, ``design`` offset and
    relative_elevation (to the section's ``elevation`` in ``centre``).  A side
    needs two template points; where nothing is met the ground's edge is used
    and the row is extrapolated.
    """
    side = F.explode(F.array(F.lit("LEFT"), F.lit("RIGHT")))
    own = design.withColumn("side", side).where(F.when(F.col("side") == "LEFT", F.col("offset") <= 0).otherwise(F.col("offset") >= 0))
    out = F.when(F.col("side") == "LEFT", -F.col("offset")).otherwise(F.col("offset"))
    rank = F.row_number().over(Window.partitionBy(key, "side").orderBy(out.desc()))
    at = lambda k, c: F.max(F.when(F.col("k") == k, F.col(c)))
    edge = own.withColumn("k", rank).where("k <= 2").groupBy(key, "side").agg(at(1, "offset").alias("outer"), at(1, "relative_elevation").alias("z1"), at(2, "offset").alias("inner"), at(2, "relative_elevation").alias("z2")).where("inner is not null")
    edge = edge.join(centre.select(key, F.col("elevation").alias("centre")), key).select(key, "side", "outer", (F.col("centre") + F.col("z1")).alias("outer_z"), ((F.col("z1") - F.col("z2")) / (F.col("outer") - F.col("inner"))).alias("slope"))
    w = Window.partitionBy(key).orderBy("offset")
    seg = ground.select(key, F.col("offset").alias("a"), F.col("elevation").alias("za"), F.lead("offset").over(w).alias("b"), F.lead("elevation").over(w).alias("zb"))
    ground_slope = (F.col("zb") - F.col("za")) / (F.col("b") - F.col("a"))
    meet = (F.col("za") - ground_slope * F.col("a") - F.col("outer_z") + F.col("slope") * F.col("outer")) / (F.col("slope") - ground_slope)
    right = F.col("side") == "RIGHT"
    hits = edge.join(seg.where("b is not null"), key).where(F.abs(F.col("slope") - ground_slope) > 1e-12).withColumn("at", meet)
    hits = hits.where((F.col("at") >= F.col("a") - 1e-9) & (F.col("at") <= F.col("b") + 1e-9) & F.when(right, F.col("at") >= F.col("outer") - 1e-9).otherwise(F.col("at") <= F.col("outer") + 1e-9))
    first = hits.groupBy(key, "side").agg(F.min_by("at", F.when(right, F.col("a")).otherwise(-F.col("a"))).alias("at"))
    ends = ground.groupBy(key).agg(F.min("offset").alias("first"), F.max("offset").alias("last"))
    rows = edge.join(ends, key).join(first, [key, "side"], "left")
    offset = F.coalesce("at", F.when(right, F.col("last")).otherwise(F.col("first")))
    return rows.select(key, "side", offset.alias("offset"), (F.col("outer_z") + F.col("slope") * (offset - F.col("outer"))).alias("elevation"), "slope", F.col("at").isNull().alias("extrapolated"))


def grade_profile(points: DataFrame, key: str = "section_id", value: str = "elevation") -> DataFrame:
    """Profile points with finite offset and value; a section with under two of them, or with an offset twice, raises."""
    finite = lambda c: F.col(c).isNotNull() & ~F.isnan(F.col(c)) & (F.abs(F.col(c)) < F.lit(float("inf")))
    w = Window.partitionBy(key)
    rows = points.withColumns({"_ok": finite("offset") & finite(value), "_gap": F.col("offset") - F.lag("offset").over(w.orderBy("offset"))})
    rows = rows.withColumns({"_n": F.count(F.lit(1)).over(w), "_bad": F.bool_or(~F.col("_ok")).over(w), "_same": F.min("_gap").over(w)})
    fault = F.when(F.col("_bad"), "values must be finite").when(F.col("_n") < 2, "a profile requires at least two points").when(F.col("_same") <= 1e-12, "profile offsets must be unique")
    checked = F.when(fault.isNotNull(), F.raise_error(F.concat_ws(": ", F.lit("section"), F.col(key).cast("string"), fault)).cast("double")).otherwise(F.col("offset"))
    return rows.withColumn("offset", checked).drop("_ok", "_gap", "_n", "_bad", "_same")
