"""Repeated control observations: averages, checks, triplets and their ranking.

Observations have ``control_id``, ``observation_id``, ``northing``,
``easting``, ``elevation`` (may be null), ``h_sigma``, ``v_sigma``,
``include`` (boolean) and ``observed`` (timestamp).
"""

from __future__ import annotations

from functools import reduce
from math import ceil

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions import measures
from plumbline.storage import materialise, scope

TOLERANCE = 0.10
TRIPLET_TOLERANCE = 0.045
#: Triplets of a partition: few enough to be ranked in a task's memory.
TRIPLETS_A_TASK = 500_000
#: Combinations of a control up to which each is judged, also where only the best are asked for.
EACH = 100_000
#: Shots of a grid cell that one task pairs.
CELL_SHOTS = 2_000
#: What triplets take from a shot, and the sums of its checks.
SHOT, COUNTED = ("observation_id", "northing", "easting", "elevation", "observed", "n", "ord"), ("failures", "missing")


def _weight(sigma: Column) -> Column:
    """1 / sigma squared; 1 for a missing, non-positive or non-finite sigma."""
    good = sigma.isNotNull() & (sigma > 0) & ~F.isnan(sigma) & (sigma < F.lit(float("inf")))
    return F.when(good, 1 / (sigma * sigma)).otherwise(1.0)


def control_means(obs: DataFrame, weighted: bool = False) -> DataFrame:
    """Mean coordinates of each control point over its included rows; elevations over those that have one."""
    used = obs.where("include")
    if not weighted:
        return used.groupBy("control_id").agg(
            F.count(F.lit(1)).alias("n"), F.avg("northing").alias("mean_n"), F.avg("easting").alias("mean_e"), F.avg("elevation").alias("mean_z")
        )
    wh, wv = _weight(F.col("h_sigma")), F.when(F.col("elevation").isNotNull(), _weight(F.col("v_sigma")))
    return used.groupBy("control_id").agg(
        F.count(F.lit(1)).alias("n"),
        (F.sum(wh * F.col("northing")) / F.sum(wh)).alias("mean_n"),
        (F.sum(wh * F.col("easting")) / F.sum(wh)).alias("mean_e"),
        (F.sum(wv * F.col("elevation")) / F.sum(wv)).alias("mean_z"),
    )


def control_residuals(obs: DataFrame, weighted: bool = False) -> DataFrame:
    """Each included row with its residuals (observed minus mean).  The means have one row a control, so a hot control's rows may be split."""
    rows = obs.where("include").join(control_means(obs, weighted), "control_id")
    dn, de, dz = F.col("northing") - F.col("mean_n"), F.col("easting") - F.col("mean_e"), F.col("elevation") - F.col("mean_z")
    return rows.select("control_id", "observation_id", dn.alias("dn"), de.alias("de"), F.sqrt(dn * dn + de * de).alias("h"), dz.alias("dz"))


def control_solutions(obs: DataFrame, weighted: bool = False, htol: float = TOLERANCE, vtol: float = TOLERANCE) -> DataFrame:
    """One row a control: count, means, largest residuals, and whether every row is within the tolerances."""
    worst = control_residuals(obs, weighted).groupBy("control_id").agg(
        F.max("h").alias("max_h"), F.max(F.abs("dz")).alias("max_dz"), F.bool_and((F.col("h") <= htol) & (F.col("dz").isNull() | (F.abs("dz") <= vtol))).alias("passes")
    )
    return control_means(obs, weighted).join(worst, "control_id")


def analyse_all(obs: DataFrame, least: int = 3, htol: float = TOLERANCE, vtol: float = TOLERANCE) -> DataFrame:
    """Status of every control: too few shots, pass or review."""
    solved = control_solutions(obs, htol=htol, vtol=vtol)
    status = F.when(F.col("n") < least, "INSUFFICIENT_SHOTS").when(F.col("passes"), "PASS").otherwise("REVIEW")
    return solved.select("control_id", "n", "max_h", "max_dz", status.alias("status"))


def three_shot_profile(obs: DataFrame) -> DataFrame:
    """Means and displayed residuals of controls with exactly three included rows that all have elevations; the third row's dz changes sign."""
    w = Window.partitionBy("control_id")
    rows = obs.where("include").withColumns({"n": F.count(F.lit(1)).over(w), "nz": F.count("elevation").over(w)}).where("n = 3 and nz = 3")
    rank = F.row_number().over(w.orderBy("observed", "observation_id"))
    mean = {c: F.avg(c).over(w) for c in ("northing", "easting", "elevation")}
    rows = rows.select("control_id", "observation_id", rank.alias("shot"), *[(F.col(c) - m).alias(f"d_{c}") for c, m in mean.items()])
    return rows.withColumn("d_elevation", F.when(F.col("shot") == 3, -F.col("d_elevation")).otherwise(F.col("d_elevation")))


def control_summary(obs: DataFrame, solutions: DataFrame) -> DataFrame:
    """Counts and time span of every control with its newest solution revision (null if it has none)."""
    newest = solutions.groupBy("control_id").agg(F.max("revision").alias("latest_revision"))
    spans = obs.groupBy("control_id").agg(
        F.count(F.lit(1)).alias("observations"), F.sum(F.col("include").cast("long")).alias("included"), F.min("observed").alias("first_seen"), F.max("observed").alias("last_seen")
    )
    return spans.join(newest, "control_id", "left")


def _combinations(n: Column) -> Column:
    """How many three-row combinations ``n`` rows (a double) have."""
    return n * (n - 1) * (n - 2) / 6


def _minutes(x: Column, y: Column) -> Column:
    return F.abs(F.unix_timestamp(y.cast("timestamp")) - F.unix_timestamp(x.cast("timestamp"))) / 60.0


def _numbered(rows: DataFrame) -> DataFrame:
    """What triplets need of each row, with its place in row order (``ord``) and the number of its control's rows (``n``)."""
    w = Window.partitionBy("control_id")
    keep = ["control_id", *SHOT, *[c for c in COUNTED if c in rows.columns]]
    return rows.withColumns({"ord": F.row_number().over(w.orderBy("observed", "observation_id")), "n": F.count(F.lit(1)).over(w)}).select(*keep)


def triplets(rows: DataFrame, most: int | None = None) -> DataFrame:
    """All three-row combinations of each control, in row order (``observed``, ``observation_id``), with their statistics.

    A caller may set a limit: controls with more than ``most`` combinations
    have none then, and ``best_triplets`` reports that they need review.
    ``failures`` and ``missing`` are those of the three shots, where ``rows``
    has counted them.
    """
    return _each(rows, _sizes(rows, most)[0], most)


def _sizes(rows: DataFrame, most: int | None, each: int | None = None) -> tuple[float, bool]:
    """The combinations of all controls that have no more than ``most``, and whether one has more than ``each``; the others with more than that aren't counted."""
    made = _combinations(F.count(F.lit(1)).cast("double"))
    sizes = rows.groupBy("control_id").agg(made.alias("made"))
    if most is not None:
        sizes = sizes.where(F.col("made") <= most)
    large = F.col("made") > each if each is not None else F.lit(False)
    total, any_large = sizes.agg(F.sum(F.when(~large, F.col("made"))), F.bool_or(large)).first()
    return total or 0.0, bool(any_large)


def _each(rows: DataFrame, total: float, most: int | None) -> DataFrame:
    """``triplets``, of which there are ``total``.

    Rows are few beside their triplets, so they are dealt by the number of
    these: partitions by the rows' size would hold more than can be ranked
    without spilling.
    """
    rows = rows.repartition(max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), ceil(total / TRIPLETS_A_TASK)), "control_id")
    rows = _numbered(rows)
    if most is not None:
        rows = rows.where(_combinations(F.col("n").cast("double")) <= most)
    a, b, c = (rows.select("control_id", *[F.col(k).alias(f"{k}_{s}") for k in rows.columns[1:]]) for s in "abc")
    return _measured(a.join(b, "control_id").where("ord_a < ord_b").join(c, "control_id").where("ord_b < ord_c"))


def _measured(three: DataFrame) -> DataFrame:
    """Statistics of triplets, whose columns of each shot end in _a, _b and _c."""
    counted = [c for c in COUNTED if f"{c}_a" in three.columns]
    col = lambda k: [F.col(f"{k}_{s}") for s in "abc"]
    mean = {k: sum(col(k)[1:], col(k)[0]) / 3 for k in ("northing", "easting", "elevation")}
    three = three.withColumns({f"mean_{k}": m for k, m in mean.items()})
    h = [F.sqrt((n - F.col("mean_northing")) ** 2 + (e - F.col("mean_easting")) ** 2) for n, e in zip(col("northing"), col("easting"))]
    v = [F.abs(z - F.col("mean_elevation")) for z in col("elevation")]
    ta, tb, tc = col("observed")
    return three.select(
        "control_id", "n_a", *[F.col(f"observation_id_{s}").alias(f"id_{s}") for s in "abc"], *[F.col(f"mean_{k}") for k in mean],
        F.greatest(*h).alias("max_h"), F.greatest(*v).alias("max_v"),
        F.sqrt((h[0] * h[0] + h[1] * h[1] + h[2] * h[2]) / 3).alias("rms_h"), F.sqrt((v[0] * v[0] + v[1] * v[1] + v[2] * v[2]) / 3).alias("rms_v"),
        F.least(_minutes(ta, tb), _minutes(tb, tc), _minutes(ta, tc)).alias("least_gap_minutes"),
        *[(sum(col(c)[1:], col(c)[0]) if c in counted else F.lit(0)).cast("long").alias(c) for c in COUNTED],
        *[c for c in ("kind", "limit") if c in three.columns],
    ).withColumnRenamed("n_a", "n")


METADATA = ("epoch_count", "duration_seconds", "satellite_count", "pdop", "hdop", "vdop")


def ranked_triplets(
    rows: DataFrame, htol: float = TRIPLET_TOLERANCE, vtol: float = TRIPLET_TOLERANCE, gap_minutes: float = 60.0, most: int | None = None, require_metadata: bool = False, top: int | None = None, **limits,
) -> DataFrame:
    """Triplets in order of merit within each control: all, or the ``top`` first.

    Field status: FAIL if any of the three shots fails a check of
    ``shot_checks`` (with ``limits``) or two are nearer in time than
    ``gap_minutes``; else PASS if nothing is missing, else UNVERIFIED.  Rows
    without any column of METADATA are judged by their times alone; of those
    columns, one that is absent counts as missing values.  A triplet passes
    within both tolerances if its field status isn't FAIL (with
    ``require_metadata``: is PASS).

    The order is: passing first; then field status; then the larger of the two
    tolerance ratios, the maxima, the RMS values (a zero or missing vertical
    RMS comes last), and the ids.
    """
    three, order = _judged(rows, htol, vtol, gap_minutes, most, require_metadata, top, **limits)
    ranked = three.withColumn("rank", F.row_number().over(Window.partitionBy("control_id").orderBy(*order)))
    return ranked if top is None else ranked.where(F.col("rank") <= top)


def _judged(rows: DataFrame, htol: float, vtol: float, gap_minutes: float, most: int | None, require_metadata: bool, top: int | None, **limits) -> tuple[DataFrame, list[Column]]:
    """Triplets with what ``ranked_triplets`` judges of them, and the columns of their order of merit.

    With ``top``, controls with over EACH combinations have only triplets among
    which their ``top`` best are.
    """
    if any(c in rows.columns for c in METADATA):
        rows = shot_checks(rows.withColumns({c: F.lit(None).cast("double") for c in METADATA if c not in rows.columns}), **limits)
    coordinate = F.coalesce((F.col("max_h") <= htol) & (F.col("max_v") <= vtol), F.lit(False))
    close = F.coalesce(F.col("least_gap_minutes") < gap_minutes - 1e-9, F.lit(False))
    status = F.when((F.col("failures") > 0) | close, "FAIL").when((F.col("missing") > 0) | F.col("least_gap_minutes").isNull(), "UNVERIFIED").otherwise("PASS")
    eligible = F.col("field_status") == "PASS" if require_metadata else F.col("field_status") != "FAIL"
    judge = lambda three: three.withColumns({"coordinate_pass": coordinate, "field_status": status}).withColumn("passes", F.col("coordinate_pass") & eligible)
    infinite = F.lit(float("inf"))
    order = [
        F.when(F.col("passes"), 0).otherwise(1),
        F.when(F.col("field_status") == "PASS", 0).when(F.col("field_status") == "UNVERIFIED", 1).otherwise(2),
        F.greatest(F.col("max_h") / htol, F.coalesce(F.col("max_v") / vtol, infinite)),
        F.col("max_h"), F.coalesce("max_v", infinite), F.col("rms_h"),
        F.when(F.col("rms_v") == 0, infinite).otherwise(F.coalesce("rms_v", infinite)),
        F.col("id_a"), F.col("id_b"), F.col("id_c"),
    ]
    total, any_large = _sizes(rows, most, None if top is None else EACH)
    if not any_large:
        return judge(_each(rows, total, most)), order
    made = _combinations(F.col("n").cast("double"))
    large = _numbered(rows).where((made > EACH) & (F.lit(True) if most is None else made <= most))
    three = judge(_each(rows, total, EACH))
    return three.unionByName(_nearest(large, top, htol, vtol, gap_minutes, judge, order).select(*three.columns)), order


def _interleaved(*cells: Column) -> Column:
    """The bits of three numbers below 2^20 in turn: what is near in this order mostly is near in place."""

    def spread(v: Column) -> Column:
        for shift, mask in ((32, 0x1F00000000FFFF), (16, 0x1F0000FF0000FF), (8, 0x100F00F00F00F00F), (4, 0x10C30C30C30C30C3), (2, 0x1249249249249249)):
            v = v.bitwiseOR(F.shiftleft(v, shift)).bitwiseAND(F.lit(mask))
        return v

    a, b, c = map(spread, cells)
    return a.bitwiseOR(F.shiftleft(b, 1)).bitwiseOR(F.shiftleft(c, 2))


def _limits(shots: DataFrame, top: int, htol: float, vtol: float, judge, key: Column) -> DataFrame:
    """The ``top``-th best of some triplets of each control (``limit``, a key of the order of merit), which none of its ``top`` best goes behind; null if there are fewer.

    Those triplets are of shots near each other along a curve through their
    places, and of shots of one place in order of their ids.
    """
    finite = lambda c: F.when(F.abs(c) < float("inf"), F.col(c))
    tolerance = {"northing": htol, "easting": htol, "elevation": vtol}
    span = shots.groupBy("control_id").agg(*[F.percentile_approx(finite(c), [0.05, 0.95]).alias(f"{c}_s") for c in tolerance])
    width = F.greatest(*[(F.get(f"{c}_s", 1) - F.get(f"{c}_s", 0)) / t for c, t in tolerance.items()])
    span = span.withColumn("width", F.when(width > 0, width).otherwise(1.0))
    last = 2**20 - 1
    part = lambda c, t: F.coalesce(F.floor(F.least(F.greatest((finite(c) - F.get(f"{c}_s", 0)) / t / F.col("width"), F.lit(0.0)), F.lit(1.0)) * last).cast("long"), F.lit(0))
    # Equal shots at one time rarely make a triplet that passes.
    placed = shots.where("twin = 1 or kind = 2").join(span, "control_id").withColumn("at", _interleaved(*[part(c, t) for c, t in tolerance.items()]))
    placed = placed.withColumn("stretch", F.floor(F.col("at") / 2.0**60 * F.ceil(F.col("n") / 4096)))
    near = Window.partitionBy("control_id", "kind", "stretch").orderBy("at", "ord")
    same = Window.partitionBy("control_id", "kind", *tolerance).orderBy("observation_id")
    shot = F.struct("ord", *[c for c in (*SHOT, *COUNTED) if c != "ord" and c in shots.columns])
    steps = (1, 2, 4, 8, 16, 32)
    leads = [placed.select("control_id", shot.alias("s"), F.array(*[F.lead(shot, k).over(w) for k in steps]).alias("others")) for w in (near, same)]
    two = F.explode(F.array(*[F.struct(F.lit(p).alias("p"), F.lit(q).alias("q")) for q in range(len(steps)) for p in range(q)]))
    some = leads[0].unionByName(leads[1]).withColumn("two", two).select("control_id", "s", F.get("others", F.col("two.p")).alias("s_p"), F.get("others", F.col("two.q")).alias("s_q"))
    some = some.where("s_q is not null").select("control_id", F.array_sort(F.array("s", "s_p", "s_q")).alias("t"))
    some = some.select("control_id", *[F.get("t", F.lit(k))[c].alias(f"{c}_{s}") for k, s in enumerate("abc") for c in (*SHOT, *COUNTED) if c in shots.columns])
    keyed = judge(_measured(some)).select("control_id", key.alias("key"))
    best = keyed.withColumn("k", F.dense_rank().over(Window.partitionBy("control_id").orderBy("key"))).where(F.col("k") <= top)
    return best.groupBy("control_id").agg(F.when(F.max("k") == top, F.max("key")).alias("limit"))


def _nearest(rows: DataFrame, top: int, htol: float, vtol: float, gap_minutes: float, judge, order: list[Column]) -> DataFrame:
    """Judged triplets of each control, its ``top`` best among them, without making all combinations.

    None of the best goes behind the limit of ``_limits``.  So for each field
    status there is a tolerance ratio that they don't exceed, and their shots
    lie within twice that of each other: they are found by grid cells of that
    size, for PASS and UNVERIFIED among the shots that can have it.  Where
    there is no such ratio (no limit, places that aren't numbers, or a status
    of which all triplets go before the limit) all combinations are made.

    Of shots that are equal in place, time and checks the first ids go before
    the others, so no more than can all be in one triplet or the best are kept.
    """
    spark, infinite = rows.sparkSession, F.lit(float("inf"))
    key = F.struct(*[c.alias(f"_{k}") for k, c in enumerate(order)])
    fails, lacks = (F.col(c) > 0 if c in rows.columns else F.lit(False) for c in COUNTED)
    places = ["northing", "easting", "elevation"]
    twins = Window.partitionBy("control_id", *places, "observed", fails, lacks).orderBy("observation_id")
    kinds = F.array(*[F.when(~fails & ~lacks, 0), F.when(~fails, 1), F.lit(2)])
    shots = rows.withColumn("twin", F.row_number().over(twins)).where(F.col("twin") <= top + 2).withColumn("kind", F.explode(F.filter(kinds, lambda k: k.isNotNull())))

    number = lambda c: F.coalesce(F.abs(c) < float("inf"), F.lit(False))
    far = lambda *c: F.greatest(*[F.max(F.when(number(k), F.abs(k))) for k in c], F.lit(0.0))
    sizes = rows.groupBy("control_id").agg(far("northing", "easting").alias("far_h"), far("elevation").alias("far_v"), F.bool_or(~number("northing") | ~number("easting")).alias("odd"))
    with scope(spark):
        shots = materialise(shots, "triplet-shots")
        known = _limits(shots, top, htol, vtol, judge, key).join(sizes, "control_id", "right")
        last, status, ratio = (F.col(f"limit._{k}") for k in range(3))
        over = F.greatest(ratio, F.lit(1.0))
        passing = last == 0
        ratios = [
            F.when(status == 0, F.when(passing, ratio).otherwise(over)).when(passing, 1.0).otherwise(infinite),
            F.when(status == 0, F.when(~passing, 1.0)).when(status == 1, F.when(passing, ratio).otherwise(over)).otherwise(infinite),
            F.when(status == 2, ratio),
        ]
        ratios = [F.when(F.col("limit").isNull() | (c.isNotNull() & (F.isnan(c) | (F.col("odd") & ~passing))), infinite).otherwise(c) for c in ratios]
        known = known.select("control_id", "limit", "far_h", "far_v", F.posexplode(F.array(*ratios)).alias("kind", "ratio")).where("ratio is not null")
        # The last bits of a mean don't count.
        reach = lambda t, c: F.greatest(2 * F.col("ratio") * t * (1 + 1e-9) + 1e-13 * F.col(c), F.lit(1e-290))
        known = known.select("control_id", "kind", "limit", "ratio", reach(htol, "far_h").alias("reach_h"), reach(vtol, "far_v").alias("reach_v"))
        shots = shots.drop("twin").join(known, ["control_id", "kind"]).where((F.col("ratio") == infinite) | (number("northing") & number("easting") & number("elevation")))
        cell = lambda c, r: F.when(F.col("ratio") == infinite, F.lit(0)).otherwise(F.floor(F.col(c) / F.col(r)).cast("long"))
        cells = {"cn": cell("northing", "reach_h"), "ce": cell("easting", "reach_h"), "cz": cell("elevation", "reach_v")}
        shots = materialise(shots.withColumns(cells), "triplet-searches", hand_on=True)

    mine = [c for c in (*SHOT, *COUNTED) if c in rows.columns]
    two = _pairs(shots.where("ratio > 0"), mine, mine, [*cells], gap_minutes)
    third = two.select("control_id", "kind", "ord_a", *[F.col(f"{c}_b").alias(f"{c}_c") for c in mine])
    # Without a failure the second shot needs a third one that is late enough.
    two = two.where((F.col("kind") == 2) | F.col("observed_b").isNull() | (_minutes(F.col("observed_b"), F.col("end")) >= gap_minutes - 1e-9)).drop("end")
    three = two.join(third, ["control_id", "kind", "ord_a"]).where(_near("b", "c", gap_minutes))
    three = three.unionByName(_tied(shots.where("ratio = 0"), top, mine, [*cells], gap_minutes, fails, lacks).select(*three.columns))
    three = judge(_measured(three))
    return three.where((order[1] == F.col("kind")) & F.coalesce(key <= F.col("limit"), F.lit(True)))


def _near(a: str, b: str, gap_minutes: float) -> Column:
    """Whether two shots, in row order, can be of one triplet of their search."""
    apart = lambda k: F.abs(F.col(f"{k}_{a}") - F.col(f"{k}_{b}"))
    close = (apart("northing") <= F.col("reach_h")) & (apart("easting") <= F.col("reach_h")) & (apart("elevation") <= F.col("reach_v"))
    gap = _minutes(F.col(f"observed_{a}"), F.col(f"observed_{b}"))
    in_time = (F.col("kind") == 2) | gap.isNull() | (gap >= gap_minutes - 1e-9)
    return (F.col(f"ord_{a}") < F.col(f"ord_{b}")) & ((F.col("ratio") == float("inf")) | close) & in_time


def _pairs(shots: DataFrame, first: list[str], second: list[str], cells: list[str], gap_minutes: float, begin: Column | None = None) -> DataFrame:
    """Pairs of near shots, of which the first fulfils ``begin``; what is kept of each ends in _a and _b.

    ``end`` is the latest time of the search.  A crowded cell is dealt over several tasks.
    """
    crowd = shots.groupBy("control_id", "kind", *cells).agg(F.count(F.lit(1)).alias("crowd"), F.max("observed").alias("end"))
    crowd = crowd.groupBy("control_id", "kind").agg(F.ceil(F.max("crowd") / CELL_SHOTS).cast("int").alias("deals"), F.max("end").alias("end"))
    shots = shots.join(crowd, ["control_id", "kind"])
    around = F.when((F.col("ratio") == 0) | (F.col("ratio") == float("inf")), F.array(F.lit(0))).otherwise(F.array(*map(F.lit, (-1, 0, 1))))
    a = shots if begin is None else shots.where(begin)
    a = a.select("control_id", "kind", "limit", "ratio", "reach_h", "reach_v", "end", *cells, F.pmod(F.hash("ord"), "deals").alias("deal"), *[F.col(c).alias(f"{c}_a") for c in first])
    for c in cells:
        a = a.withColumn(f"_{c}", F.explode(around)).withColumn(c, F.col(c) + F.col(f"_{c}")).drop(f"_{c}")
    b = shots.select("control_id", "kind", *cells, F.explode(F.sequence(F.lit(0), F.col("deals") - 1)).alias("deal"), *[F.col(c).alias(f"{c}_b") for c in second])
    return a.join(b, ["control_id", "kind", *cells, "deal"]).where(_near("a", "b", gap_minutes)).drop(*cells, "deal")


def _tied(shots: DataFrame, top: int, mine: list[str], cells: list[str], gap_minutes: float, fails: Column, lacks: Column) -> DataFrame:
    """Triplets of shots at one place, for searches whose best have no residual at all.

    These differ by their ids alone.  So none of the best begins behind the
    first id of the limit, and of the second shots that have a third one the
    ``top`` first are enough for each first shot.
    """
    places = ["northing", "easting", "elevation"]
    w = Window.partitionBy("control_id", "kind", *places)
    gap = lambda x, y: _minutes(F.col(x), y) if isinstance(y, Column) else _minutes(F.col(x), F.col(y))
    close = lambda g: F.coalesce(g < gap_minutes - 1e-9, F.lit(False))
    shots = shots.withColumns({
        "fails": fails, "lacks": lacks, "last": F.max("ord").over(w), "last_failing": F.max(F.when(fails, F.col("ord"))).over(w), "latest": F.max("observed").over(w),
        "latest_lacking": F.max(F.when(lacks, F.col("observed"))).over(w), "crowded": close(gap("observed", F.lead("observed").over(w.orderBy("ord")))),
    })
    two = _pairs(shots, [*mine, "fails", "lacks"], [*mine, "fails", "lacks", "last", "last_failing", "latest", "latest_lacking", "crowded"], cells, gap_minutes, F.coalesce(F.col("observation_id") <= F.col("limit")["_7"], F.lit(True)))
    for c in places:
        two = two.where(F.col(f"{c}_a") == F.col(f"{c}_b"))
    if gap_minutes > 1e-9:
        later = lambda t: F.coalesce((t > F.col("observed_b")) & (gap("observed_b", t) >= gap_minutes - 1e-9), F.lit(False))
        third = (
            F.when(F.col("kind") == 0, later(F.col("latest_b")))
            .when(F.col("kind") == 1, F.col("observed_b").isNull() | later(F.when(F.col("lacks_a") | F.col("lacks_b"), F.col("latest_b")).otherwise(F.col("latest_lacking_b"))))
            .otherwise(F.col("fails_a") | F.col("fails_b") | close(gap("observed_a", "observed_b")) | F.coalesce(F.col("ord_b") < F.col("last_failing_b"), F.lit(False)) | F.col("crowded_b"))
        )
        by_id = Window.partitionBy("control_id", "kind", "ord_a").orderBy("observation_id_b")
        two = two.where((F.col("ord_b") < F.col("last_b")) & third).withColumn("k", F.row_number().over(by_id)).where(F.col("k") <= top)
    at = shots.select("control_id", "kind", *[F.col(c).alias(f"{c}_c") for c in mine], *[F.col(c).alias(f"{c}_b") for c in places])
    return two.join(at, ["control_id", "kind", *[f"{c}_b" for c in places]]).where(_near("b", "c", gap_minutes))


def control_qc(rows: DataFrame, htol: float = TRIPLET_TOLERANCE, vtol: float = TRIPLET_TOLERANCE, gap_minutes: float = 60.0, most: int | None = None, require_metadata: bool = False, **limits) -> DataFrame:
    """One row a control with all of its best triplet: PASS, RESHOOT, or REVIEW when it has more combinations than a caller's limit ``most``, and why.

    The best is the least by the order of ``ranked_triplets``: a minimum needs
    no triplet to be kept or sorted.
    """
    three, order = _judged(rows, htol, vtol, gap_minutes, most, require_metadata, 1, **limits)
    least = F.min(F.struct(*[c.alias(f"_{k}") for k, c in enumerate(order)], *[c for c in three.columns if c not in ("control_id", "n")]))
    best = three.groupBy("control_id").agg(least.alias("m")).select("control_id", *[f"m.{c}" for c in three.columns if c not in ("control_id", "n")], F.lit(1).alias("rank"))
    sizes = rows.groupBy("control_id").agg(F.count(F.lit(1)).alias("n"))
    n = F.col("n")
    too_many = F.lit(False) if most is None else _combinations(n.cast("double")) > most
    status = F.when(n < 3, "RESHOOT").when(too_many, "REVIEW").when(F.col("passes"), "PASS").otherwise("RESHOOT")
    reason = F.when(n < 3, "FEWER_THAN_THREE_SHOTS").when(too_many, "TOO_MANY_COMBINATIONS").when(F.col("passes"), "").when(~F.col("coordinate_pass"), "OUT_OF_TOLERANCE").otherwise("FIELD_CHECKS")
    return sizes.join(best, "control_id", "left").withColumns({"status": status, "reason": reason})


def best_triplets(rows: DataFrame, htol: float = TRIPLET_TOLERANCE, vtol: float = TRIPLET_TOLERANCE, gap_minutes: float = 60.0, most: int | None = None, require_metadata: bool = False, **limits) -> DataFrame:
    """One row a control: PASS with its best triplet, RESHOOT, or REVIEW when it has more combinations than a caller's limit."""
    found = control_qc(rows, htol, vtol, gap_minutes, most, require_metadata, **limits)
    return found.select("control_id", "n", "id_a", "id_b", "id_c", "max_h", "max_v", "field_status", "status")


def accepted_control(qc: DataFrame, obs: DataFrame) -> DataFrame:
    """Controls of ``control_qc`` that pass, for export: mean place, code, residuals, the points it rests on, field status and least time gap.

    ``obs`` has observation_id, point_id and description.  The code is that of
    the three shots; different ones are joined by semicolons, in shot order.
    """
    shot = obs.select("observation_id", F.coalesce(F.nullif(F.trim("point_id"), F.lit("")), F.col("observation_id").cast("string")).alias("point"), F.coalesce(F.trim("description"), F.lit("")).alias("code"))
    passed = qc.where("status = 'PASS'")
    kept = ("mean_northing", "mean_easting", "mean_elevation", "max_h", "max_v", "field_status", "least_gap_minutes", "status")
    # Each passing control goes along with its three shots, so the triplets are judged once.
    each = passed.select("control_id", F.struct(*kept).alias("q"), F.posexplode(F.array("id_a", "id_b", "id_c")).alias("k", "observation_id")).join(shot, "observation_id", "left")
    found = F.when(F.col("point").isNotNull(), F.struct("k", "point", "code"))
    names = each.groupBy("control_id").agg(F.array_sort(F.collect_list(found)).alias("s"), F.first("q").alias("q"))
    codes = F.array_remove(F.array_distinct(F.col("s.code")), "")
    any_shot = F.size("s") > 0
    named = names.select("control_id", "q.*", F.when(any_shot, F.array_join("s.point", ";")).alias("source_observations"), F.when(any_shot, F.array_join(codes, ";")).alias("code"))
    return named.select(
        "control_id", F.col("mean_northing").alias("northing"), F.col("mean_easting").alias("easting"), F.col("mean_elevation").alias("elevation"), "code", F.col("max_h").alias("horizontal_residual"), F.col("max_v").alias("vertical_residual"),
        "source_observations", F.col("field_status").alias("field_qc_status"), F.col("least_gap_minutes").alias("minimum_time_gap_minutes"), F.col("status").alias("qc_status"),
    )


def reshoot_control(qc: DataFrame, obs: DataFrame, shots: int = 3) -> DataFrame:
    """Controls of ``control_qc`` to shoot again or to review: why, the shots they have by letter, the labels of the next ones, and what failed in the field.

    ``obs`` has control_id and point_id.  Labels go on behind the letters in use.
    """
    from plumbline.functions import ids

    letter = ids.shot_suffix(F.col("point_id"), F.col("control_id").cast("string"))
    have = obs.groupBy("control_id").agg(F.array_join(F.array_sort(F.collect_set("point_id")), ";").alias("existing_shots"), F.array_remove(F.collect_set(letter), "").alias("letters"))
    again = qc.where("status in ('RESHOOT', 'REVIEW')").join(have, "control_id", "left")
    labels = F.array_join(ids.next_reshoot_labels(F.col("control_id").cast("string"), F.coalesce("letters", F.array().cast("array<string>")), shots), ";")
    return again.select(
        "control_id", "status", "reason", "existing_shots", labels.alias("next_shots"), F.col("field_status").alias("field_qc_status"), F.col("failures").alias("field_failures"), F.col("missing").alias("missing_field_metadata"),
        F.col("max_h").alias("horizontal_residual"), F.col("max_v").alias("vertical_residual"),
    )


def shot_checks(
    rows: DataFrame, least_epochs: int = 300, least_seconds: float = 300.0, least_satellites: int = 5, most_pdop: float | None = None, most_hdop: float | None = None, most_vdop: float | None = None,
) -> DataFrame:
    """Rows with ``length_pass`` and ``satellite_pass`` (null where unknown), the number of failures and of missing values.

    Epochs or duration, whichever is there, may be long enough; if what is
    there is too short, that is a failure.  A DOP is checked only against a
    limit that is given.
    """
    epochs, seconds = F.coalesce(F.col("epoch_count") >= least_epochs, F.lit(False)), F.coalesce(F.col("duration_seconds") >= least_seconds, F.lit(False))
    known = F.col("epoch_count").isNotNull() | F.col("duration_seconds").isNotNull()
    rows = rows.withColumns({"length_pass": F.when(known, epochs | seconds), "satellite_pass": F.col("satellite_count") >= least_satellites})
    checks = [F.col("length_pass"), F.col("satellite_pass"), *[F.col(c) <= limit for c, limit in (("pdop", most_pdop), ("hdop", most_hdop), ("vdop", most_vdop)) if limit is not None]]
    count = lambda test: reduce(lambda a, b: a + b, [F.when(F.coalesce(test(c), F.lit(False)), 1).otherwise(0) for c in checks])
    return rows.withColumns({"failures": count(lambda c: ~c), "missing": count(lambda c: c.isNull())})


def field_checks(rows: DataFrame, group: str = "control_id", least_gap_minutes: float = 60.0, **limits) -> DataFrame:
    """One row a group of shots: PASS, FAIL or UNVERIFIED, with failures, missing values and the least time between two shots.

    ``observed`` is the text of a shot's time.  Times count as verified if
    all shots (two at least) have one of the same kind, dates or times of day;
    times of day may go round midnight.  A failure beats what is missing.
    ``limits`` are those of ``shot_checks``.
    """
    day = 86_400.0
    moment = measures.observed_time(F.col("observed"))
    at = F.when(moment.isNotNull(), F.unix_micros(moment) / 1e6).otherwise(measures.time_of_day(F.col("observed")))
    timed = shot_checks(rows, **limits).withColumns({"is_date": moment.isNotNull(), "at": at})
    w = Window.partitionBy(group).orderBy("at")
    timed = timed.withColumn("step", F.col("at") - F.lag("at").over(w))
    sums = timed.groupBy(group).agg(
        F.count(F.lit(1)).alias("shots"), F.sum("failures").alias("failures"), F.sum("missing").alias("missing"), F.count("at").alias("timed"), F.count_if("is_date").alias("dates"),
        F.min("step").alias("step"), (F.min("at") + day - F.max("at")).alias("round"),
    )
    verified = (F.col("shots") == F.col("timed")) & (F.col("shots") >= 2) & F.col("dates").isin(0, F.col("shots"))
    gap = F.when(verified, F.when(F.col("dates") > 0, F.col("step")).otherwise(F.least("step", "round")) / 60)
    out = sums.withColumns({"verified": verified, "least_gap_minutes": gap, "untimed": F.col("shots") - F.col("timed")})
    close = F.coalesce(F.col("least_gap_minutes") + 1e-9 < least_gap_minutes, F.lit(False)).cast("long")
    out = out.withColumns({"failures": F.col("failures") + close, "missing": F.col("missing") + F.col("untimed")})
    status = F.when(F.col("failures") > 0, "FAIL").when((F.col("missing") == 0) & F.col("verified"), "PASS").otherwise("UNVERIFIED")
    return out.select(group, "shots", "failures", "missing", "least_gap_minutes", status.alias("field_status"))


def import_overlap(existing: DataFrame, incoming: DataFrame, tolerance: float = 1e-9) -> DataFrame:
    """Incoming rows whose id (without case) exists: ``exact`` when a row has equal coordinates, else ``conflict``."""
    key = F.lower(F.trim("point_id"))
    old = existing.select(key.alias("k"), *[F.col(c).alias(f"old_{c}") for c in ("northing", "easting", "elevation")])
    same = reduce(lambda a, b: a & b, [F.abs(F.col(c) - F.col(f"old_{c}")) <= tolerance for c in ("northing", "easting", "elevation")])
    pairs = incoming.withColumn("k", key).join(old, "k")
    found = pairs.groupBy("point_id").agg(F.bool_or(F.coalesce(same, F.lit(False))).alias("any_same"), F.count(F.lit(1)).alias("matches"))
    return found.select("point_id", "matches", F.when(F.col("any_same"), "exact").otherwise("conflict").alias("overlap"))


def new_observations(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Incoming rows that aren't there yet: key is the id without case and coordinates to nine places; the first of equal rows by observation id."""
    key = [F.lower(F.trim("point_id")).alias("k"), *[F.round(c, 9).alias(f"k_{c}") for c in ("northing", "easting", "elevation")]]
    names = ["k", "k_northing", "k_easting", "k_elevation"]
    fresh = incoming.select("*", *key)
    first = fresh.withColumn("rn", F.row_number().over(Window.partitionBy(*names).orderBy("observation_id"))).where("rn = 1")
    return first.join(existing.select(*key), names, "left_anti").drop("rn", *names)


def regroup(obs: DataFrame, tolerance: float, vertical: float | None = None, reviews: DataFrame | None = None) -> DataFrame:
    """Effective control and point id of every observation: shots that lie among those of another control are probably misnumbered.

    ``obs`` has observation_id, control_id, point_id, northing, easting,
    elevation.  Shots within ``tolerance`` of each other (and ``vertical``,
    where both have heights) form clusters.  In a cluster with several controls
    the one that most shots name is the majority, if it has two and more than
    any other; without one the cluster is a conflict.  A shot of another
    control takes the majority's id with its own letter if no shot there, or
    earlier by observation id, has it.  ``reviews`` (observation_id, status,
    assigned_control_id, assigned_point_id) go before all that; an assigned id
    that is null or blank leaves the majority's, and the suggested point id.
    """
    from plumbline.functions import ids
    from plumbline.operators.surfaces import clusters, layered_clusters

    found = clusters(obs, tolerance, "observation_id") if vertical is None else layered_clusters(obs, tolerance, vertical, "observation_id")
    base = ids.base_control_id(F.coalesce(F.nullif(F.trim("control_id"), F.lit("")), F.col("point_id")))
    rows = obs.withColumn("base", base).join(found.select(F.col("node").alias("observation_id"), "component"), "observation_id", "left")
    votes = rows.where("component is not null").groupBy("component", "base").agg(F.count(F.lit(1)).alias("n"), F.avg("northing").alias("mid_n"), F.avg("easting").alias("mid_e"), F.collect_set(ids.shot_suffix(F.col("point_id"), F.col("base"))).alias("letters"))
    w = Window.partitionBy("component").orderBy(F.col("n").desc(), "base")
    ranked = votes.withColumns({"rank": F.row_number().over(w), "second": F.lead("n").over(w), "bases": F.count(F.lit(1)).over(Window.partitionBy("component"))}).where("rank = 1 and bases > 1")
    clear = (F.col("n") >= 2) & (F.col("n") > F.col("second"))
    ranked = ranked.select("component", F.when(clear, F.col("base")).otherwise("").alias("majority"), "mid_n", "mid_e", "letters")
    none = F.lit(None).cast("string")
    judged = reviews.select("observation_id", F.upper("status").alias("review"), *[F.nullif(F.trim(c), F.lit("")).alias(c) for c in ("assigned_control_id", "assigned_point_id")]) if reviews is not None else obs.limit(0).select("observation_id", none.alias("review"), none.alias("assigned_control_id"), none.alias("assigned_point_id"))
    rows = rows.join(ranked, "component", "left").join(judged, "observation_id", "left").withColumn("letter", ids.shot_suffix(F.col("point_id"), F.col("base")))
    other = F.coalesce((F.col("majority") != "") & (F.col("base") != F.col("majority")), F.lit(False))
    decided = other & F.coalesce(F.col("review").isin("CONFIRMED", "REASSIGNED", "REJECTED"), F.lit(False))
    free = other & ~decided & (F.col("letter") != "") & ~F.array_contains("letters", F.col("letter"))
    rows = rows.withColumns({"other": other, "decided": decided, "free": F.coalesce(free, F.lit(False))})
    # A cluster may be the whole table: its first free shot of each letter is a minimum, not a rank among all its rows.
    takers = rows.where("free").groupBy("component", "letter").agg(F.min("observation_id").alias("observation_id")).select("observation_id", F.lit(True).alias("first"))
    rows = rows.join(takers, "observation_id", "left")
    taken = F.col("free") & F.coalesce("first", F.lit(False))
    manual = F.col("decided") & (F.col("review") != "REJECTED")
    suggested = F.when(F.col("letter") != "", F.concat("majority", "letter"))
    flag = (
        F.when(manual, "MANUAL_GROUPING").when(F.col("decided"), "PROBABLE_MISNUMBER_REJECTED").when(taken, "PROBABLE_MISNUMBER").when(F.col("other") | (F.col("majority") == ""), "SPATIAL_ID_CONFLICT")
    )
    source = F.when(manual, "MANUAL").when(F.col("decided"), "MANUAL_REJECT").when(taken, "SPATIAL_INFERENCE").otherwise("POINT_ID")
    away = F.when(F.col("other"), F.sqrt((F.col("northing") - F.col("mid_n")) ** 2 + (F.col("easting") - F.col("mid_e")) ** 2))
    return rows.select(
        "observation_id", F.when(manual, F.coalesce("assigned_control_id", "majority")).when(taken, F.col("majority")).otherwise(F.col("base")).alias("control_id"),
        F.when(manual, F.coalesce("assigned_point_id", suggested, "point_id")).when(taken, suggested).otherwise(F.col("point_id")).alias("point_id"), source.alias("source"), flag.alias("flag"), away.alias("distance"),
    )
