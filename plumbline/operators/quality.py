"""Quality rules and statistics over whole tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.operators.scalars import attach
from plumbline.storage import materialise, scope


#: Half the width, in ranks, of the bracket in which an exact median is looked for, and the accuracy (one part in) of the sketch that places it.
BRACKET, ACCURACY = 1e-4, 20_000


def exact_medians(rows: DataFrame, **values: Column) -> DataFrame:
    """One row with the exact median of each column's finite values (null without any), under its name.

    A sketch brackets each median; values below are counted, and only the
    distinct values inside the bracket, about two in ten thousand of all, are
    put in order.  No task holds a column.  The row is written to the shared
    folder, as what follows reads it more than once.
    """
    names = list(values)
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("name"), c.cast("double").alias("v")) for n, c in values.items()]))
    v = rows.select(each.alias("x")).select("x.*").where("v is not null and not isnan(v) and abs(v) < double('infinity')")
    low, high = F.percentile_approx("v", 0.5 - BRACKET, ACCURACY), F.percentile_approx("v", 0.5 + BRACKET, ACCURACY)
    spark = rows.sparkSession
    with scope(spark):
        bracket = materialise(v.groupBy("name").agg(low.alias("low"), high.alias("high")), "brackets")
        placed = v.join(F.broadcast(bracket), "name")
        below = placed.groupBy("name").agg(F.count_if(F.col("v") < F.col("low")).alias("below"), F.count(F.lit(1)).alias("n"))
        inside = placed.where("v between low and high").groupBy("name", "v").agg(F.count(F.lit(1)).alias("k"))
        ordered = inside.withColumn("upto", F.sum("k").over(Window.partitionBy("name").orderBy("v"))).join(F.broadcast(below), "name")
        at = lambda rank: F.min(F.when(F.col("below") + F.col("upto") > rank, F.col("v")))
        found = ordered.groupBy("name").agg(((at(F.floor((F.col("n") - 1) / 2)) + at(F.floor(F.col("n") / 2))) / 2).alias("median"))
        return materialise(found.agg(*[F.max(F.when(F.col("name") == n, F.col("median"))).alias(n) for n in names]), "medians", hand_on=True)


def mad_outliers(points: DataFrame, key: str = "point_id", least: int = 8) -> DataFrame:
    """Points whose distance from the median place is over ``median + 12 MAD`` of all distances, or over ``max(20 times the median positive distance, 1000)`` when the MAD vanishes; needs eight points with both coordinates."""
    finite = lambda c: F.col(c).isNotNull() & ~F.isnan(F.col(c)) & (F.abs(F.col(c)) < F.lit(float("inf")))
    good = points.select(key, F.col("northing").cast("double").alias("northing"), F.col("easting").cast("double").alias("easting")).where(finite("northing") & finite("easting"))
    centre = exact_medians(good, mid_n=F.col("northing"), mid_e=F.col("easting"))
    far = attach(good, centre).select(key, F.sqrt((F.col("northing") - F.col("mid_n")) ** 2 + (F.col("easting") - F.col("mid_e")) ** 2).alias("distance"))
    middles = exact_medians(far, middle=F.col("distance"), typical=F.when(F.col("distance") > 0, F.col("distance")))
    mad = exact_medians(attach(far, middles), mad=F.abs(F.col("distance") - F.col("middle")))
    limits = attach(attach(middles, mad), good.agg(F.count(F.lit(1)).alias("n")))
    limit = F.when(F.col("mad") > 1e-9, F.col("middle") + 12 * F.col("mad")).otherwise(F.greatest(20 * F.col("typical"), F.lit(1000.0)))
    return attach(far, limits.select("n", limit.alias("limit"))).where((F.col("n") >= least) & (F.col("distance") > F.col("limit"))).select(key, "distance")


#: Flags of the coordinate checks, in the order they are reported.
SANITY_FLAGS = (
    "INVALID_COORDINATE_ROWS", "LATLON_IN_PROJECTED_PROJECT", "POSSIBLE_NORTHING_EASTING_SWAP", "SMALL_COORDINATE_MAGNITUDE", "LARGE_METER_COORDINATES", "REMOTE_COORDINATE_OUTLIER", "MIXED_POINT_CRS", "MIXED_POINT_UNITS",
)


def coordinate_sanity(points: DataFrame, project_crs: str = "", units: str = "") -> DataFrame:
    """One row: status, flags and statistics of all points that have both coordinates (northing, easting, crs, horizontal_units).

    A pair counts if both are finite.  Points over 100 times the median
    positive distance from the median place (at least 1) are outliers, where
    five points have a positive distance.
    """
    finite = lambda c: ~F.isnan(F.col(c)) & (F.abs(F.col(c)) < F.lit(float("inf")))
    text = lambda c: F.nullif(F.trim(F.coalesce(F.col(c), F.lit(""))), F.lit("")) if c in points.columns else F.lit(None).cast("string")
    rows = points.where("northing is not null and easting is not null").select(
        F.col("northing").cast("double").alias("northing"), F.col("easting").cast("double").alias("easting"), text("crs").alias("crs"), text("horizontal_units").alias("unit")
    ).withColumn("ok", finite("northing") & finite("easting"))
    good = rows.where("ok")
    within = lambda n, e: F.col("northing").between(-n, n) & F.col("easting").between(-e, e)
    counts = rows.agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_if("ok").alias("n_valid"), F.count_if(F.col("ok") & within(90, 180)).alias("latlon"), F.count_if(F.col("ok") & within(180, 90)).alias("swapped"),
        (F.min("crs") != F.max("crs")).alias("mixed_crs"), (F.min("unit") != F.max("unit")).alias("mixed_units"),
    )
    middles = exact_medians(good, median_n=F.col("northing"), median_e=F.col("easting"), median_magnitude=F.sqrt(F.col("northing") ** 2 + F.col("easting") ** 2))
    far = attach(good, middles).select(F.sqrt((F.col("northing") - F.col("median_n")) ** 2 + (F.col("easting") - F.col("median_e")) ** 2).alias("distance"))
    typical = exact_medians(far, typical=F.when(F.col("distance") > 0, F.col("distance")))
    remote = attach(far, typical).agg(F.count_if(F.col("distance") > F.greatest(100 * F.col("typical"), F.lit(1.0))).alias("remote"), F.count_if(F.col("distance") > 0).alias("apart"))
    one = attach(attach(counts, middles), remote)
    share = lambda c: F.col(c) / F.col("n_valid")
    projected = bool(project_crs) and "4326" not in project_crs and "wgs 84" not in project_crs.lower()
    outliers = F.when(F.col("apart") >= 5, F.col("remote")).otherwise(0)
    raised = (
        F.col("n_valid") < F.col("n_rows"), F.lit(projected) & (share("latlon") >= 0.8), (share("swapped") >= 0.8) & (share("latlon") < 0.5),
        F.lit(units in ("us_survey_feet", "international_feet") and bool(project_crs) and "4326" not in project_crs) & (F.col("median_magnitude") > 0) & (F.col("median_magnitude") < 10_000),
        F.lit(units == "meters") & (F.col("median_magnitude") > 20_000_000), outliers > 0, F.col("mixed_crs"), F.col("mixed_units"),
    )
    flags = F.when(F.col("n_valid") > 0, F.concat_ws(",", *[F.when(c, name) for c, name in zip(raised, SANITY_FLAGS)])).when(F.col("n_rows") > 0, SANITY_FLAGS[0]).otherwise("")
    status = F.when(F.col("n_rows") == 0, "NO_POINTS").when(F.col("n_valid") == 0, "NO_VALID_COORDINATES").when(flags != "", "WARN").otherwise("PASS")
    return one.select(status.alias("status"), flags.alias("flags"), "n_rows", "n_valid", "median_n", "median_e", "median_magnitude", outliers.cast("long").alias("n_outliers"))


def scale_factor(samples: DataFrame, limit_ppm: float = 20.0) -> DataFrame:
    """One row: the project factor that fits weighted point factors best, largest and RMS residual in parts per million, and whether it passes."""
    fit = samples.agg((F.sum(F.col("weight") / F.col("factor")) / F.sum(F.col("weight") / (F.col("factor") * F.col("factor")))).alias("k"))
    ppm = (F.col("k") / F.col("factor") - 1) * 1e6
    return attach(samples, fit).groupBy("k").agg(
        F.max(F.abs(ppm)).alias("max_ppm"), F.sqrt(F.sum(F.col("weight") * ppm * ppm) / F.sum("weight")).alias("rms_ppm"), (F.max(F.abs(ppm)) <= limit_ppm).alias("passes")
    )


def similarity_fit(pairs: DataFrame, *group: str) -> DataFrame:
    """Scale, rotation and shift from local (x, y) to grid (gx, gy), by least squares from centred sums; one row a group."""
    means = pairs.groupBy(*group).agg(*[F.avg(c).alias(f"m_{c}") for c in ("x", "y", "gx", "gy")])
    joined = pairs.join(means, list(group)) if group else attach(pairs, means)
    c = {k: F.col(k) - F.col(f"m_{k}") for k in ("x", "y", "gx", "gy")}
    sums = joined.groupBy(*group).agg(
        F.sum(c["x"] * c["gx"] + c["y"] * c["gy"]).alias("p"), F.sum(c["x"] * c["gy"] - c["y"] * c["gx"]).alias("q"), F.sum(c["x"] * c["x"] + c["y"] * c["y"]).alias("r"),
        *[F.first(f"m_{k}").alias(f"m_{k}") for k in ("x", "y", "gx", "gy")],
    )
    rows = sums.where("r > 0").withColumns({"a": F.col("p") / F.col("r"), "b": F.col("q") / F.col("r")})
    return rows.select(
        *group, F.sqrt(F.col("a") ** 2 + F.col("b") ** 2).alias("scale"), F.degrees(F.atan2("b", "a")).alias("rotation_deg"),
        (F.col("m_gx") - F.col("a") * F.col("m_x") + F.col("b") * F.col("m_y")).alias("dx"), (F.col("m_gy") - F.col("b") * F.col("m_x") - F.col("a") * F.col("m_y")).alias("dy"),
    )


def health(points: DataFrame, rules: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """One row for each check (name to condition of a bad row) that its rule enables: bad rows, and the rule's severity if there are more than its threshold, else OK.

    ``rules`` has ``check``, ``enabled``, ``severity``, ``threshold``.
    """
    counted = points.agg(*[F.count_if(c).alias(name) for name, c in checks.items()])
    each = counted.select(F.explode(F.array(*[F.struct(F.lit(n).alias("check"), F.col(n).alias("bad_rows")) for n in checks])).alias("c")).select("c.*")
    status = F.when(~F.col("enabled"), "SKIP").when(F.col("bad_rows") > F.col("threshold"), F.col("severity")).otherwise("OK")
    return each.join(F.broadcast(rules), "check").select("check", "bad_rows", status.alias("status"))


def union_issues(*sources: tuple[str, str, DataFrame]) -> DataFrame:
    """Issues of several tables as one: (source, severity, rows with ``object_id`` and ``detail``), and a rank that puts errors first."""
    parts = [df.select(F.lit(s).alias("source"), F.lit(v).alias("severity"), F.col("object_id").cast("string").alias("object_id"), F.col("detail").cast("string").alias("detail")) for s, v, df in sources]
    rank = F.when(F.col("severity") == "ERROR", 0).when(F.col("severity") == "WARN", 1).otherwise(2)
    return reduce(DataFrame.unionByName, parts).withColumn("severity_rank", rank)


#: Vertical units of a scatter in one foot.
UNITS_PER_FOOT = {"international_feet": 1.0, "us_survey_feet": 0.999998, "meters": 0.3048}


def calibration(reviews: DataFrame) -> DataFrame:
    """One row from the latest decision (by ``seq``) of each run's candidates: counts, and twice the median scatter of confirmed busts in feet, between 0.05 and 0.25.

    Columns: run_id, candidate_id, decision (confirmed_bust, not_bust,
    needs_review), scatter, vertical_units.  Confirmed busts whose scatter is
    missing, negative or in an unknown unit are excluded and counted; rows
    without a run or candidate are not read.
    """
    known = reviews.where("run_id is not null and candidate_id is not null")
    latest = known.groupBy("run_id", "candidate_id").agg(F.max_by(F.struct("decision", F.col("scatter").cast("double").alias("scatter"), "vertical_units"), "seq").alias("r")).select("r.*")
    factor = F.coalesce(*[F.when(F.col("vertical_units") == u, F.lit(f)) for u, f in UNITS_PER_FOOT.items()])
    usable = F.col("scatter").isNotNull() & ~F.isnan("scatter") & (F.col("scatter") >= 0) & (F.col("scatter") < F.lit(float("inf"))) & factor.isNotNull()
    confirmed = F.col("decision") == "confirmed_bust"
    counts = latest.agg(
        F.count(F.lit(1)).alias("reviews"), F.count_if(confirmed).alias("confirmed"), F.count_if(F.col("decision") == "not_bust").alias("not_bust"), F.count_if(F.col("decision") == "needs_review").alias("needs_review"),
        F.count_if(confirmed & ~F.coalesce(usable, F.lit(False))).alias("excluded"),
    )
    middle = exact_medians(latest, middle=F.when(confirmed & usable, F.col("scatter") / factor))
    out = attach(counts, middle)
    return out.select("reviews", "confirmed", "not_bust", "needs_review", "excluded", F.round("middle", 4).alias("median_scatter_ft"), F.when(F.col("middle").isNotNull(), F.round(F.least(F.lit(0.25), F.greatest(F.lit(0.05), 2 * F.col("middle"))), 3)).alias("suggested_ft"))


def profile(rows: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """One row a column: values, nulls, distinct values, least and greatest."""
    aggs = [x for c in columns for x in (F.count(c).alias(f"n_{c}"), F.count_if(F.col(c).isNull()).alias(f"z_{c}"), F.countDistinct(c).alias(f"d_{c}"), F.min(c).cast("double").alias(f"a_{c}"), F.max(c).cast("double").alias(f"b_{c}"))]
    names = ("n_values", "n_nulls", "n_distinct", "least", "greatest")
    each = [F.struct(F.lit(c).alias("column"), *[F.col(f"{p}_{c}").alias(n) for p, n in zip("nzdab", names)]) for c in columns]
    return rows.agg(*aggs).select(F.explode(F.array(*each)).alias("p")).select("p.*")


def browse(rows: DataFrame, text: str, order: str, limit: int = 500, offset: int = 0) -> DataFrame:
    """A page of the rows of which any column's text contains ``text`` without case, newest first by ``order``."""
    hit = reduce(lambda a, b: a | b, [F.coalesce(F.lower(F.col(c).cast("string")).contains(text.lower()), F.lit(False)) for c in rows.columns])
    return rows.where(hit).orderBy(F.col(order).desc()).offset(offset).limit(min(limit, 500))


def match_codes(points: DataFrame, rules: DataFrame) -> DataFrame:
    """The rule of each point's code: EXACT, STARTS_WITH or CONTAINS without case; the longest pattern wins, then the first rule.

    ``rules`` (rule, match, pattern, category) is a profile.  Distinct codes
    are matched: equal ones and beginnings (of the lengths that the profile
    has) by equi-joins, contained ones in one projection over the profile's
    few such patterns.  Points without a rule stay, with nulls.
    """
    code = F.upper(F.trim("code"))
    codes = points.select(code.alias("_code")).where("_code is not null").distinct()
    known = rules.select("rule", "match", F.upper("pattern").alias("pattern"), F.length("pattern").alias("size"), "category")
    columns = ["_code", "rule", "size", "category"]
    exact = codes.join(known.where("match = 'EXACT'"), F.col("_code") == F.col("pattern")).select(*columns)
    sizes = known.where("match = 'STARTS_WITH'").agg(F.collect_set("size").alias("sizes"))
    begun = attach(codes, sizes).withColumn("cut", F.explode("sizes")).where("length(_code) >= cut").select("_code", F.substring("_code", F.lit(1), F.col("cut")).alias("begin"))
    begun = begun.join(known.where("match = 'STARTS_WITH'"), F.col("begin") == F.col("pattern")).select(*columns)
    listed = known.where("match not in ('EXACT', 'STARTS_WITH')").agg(F.collect_list(F.struct("rule", "pattern", "size", "category")).alias("listed"))
    held = attach(codes, listed).withColumn("m", F.explode(F.filter("listed", lambda r: F.col("_code").contains(r["pattern"])))).select("_code", "m.rule", "m.size", "m.category")
    found = exact.unionByName(begun).unionByName(held)
    best = found.groupBy("_code").agg(F.min_by(F.struct("rule", "category"), F.struct((-F.col("size")).alias("l"), F.col("rule"))).alias("m"))
    return points.select("point_id", code.alias("_code")).join(best, "_code", "left").select("point_id", F.col("m.rule").alias("rule"), F.col("m.category").alias("category"))
