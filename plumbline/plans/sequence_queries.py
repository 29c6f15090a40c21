"""Queries of the sequential operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.operators import rodshift, sequential
from plumbline.plans.bindings import COURSES, FOOT, FOOT_SQL, SIGHTS, courses, places, query, r, sights, table

_START, _END = 100.0, 90.0


def _level_sql(kind: str, method: str) -> str:
    if kind == "setups":
        rows = f"(SELECT *, backsight - foresight AS rise, greatest(distance_bs, distance_fs, 0) AS leg, 1 AS one, 0 AS less FROM {SIGHTS})"
    elif kind == "separate":
        rows = f"""(SELECT *, coalesce(bs, 0) - coalesce(fs, 0) AS rise, distance_bs AS leg, CASE WHEN fs IS NOT NULL THEN 1 ELSE 0 END AS one, 0 AS less FROM
            (SELECT *, CASE WHEN k % 2 = 1 THEN backsight END AS bs, CASE WHEN k % 2 = 0 THEN foresight END AS fs FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY seq) AS k FROM {SIGHTS})))"""
    else:
        rows = f"(SELECT *, coalesce(lag(backsight) OVER (PARTITION BY run_id ORDER BY seq) - foresight, 0) AS rise, greatest(distance_bs, distance_fs, 0) AS leg, 1 AS one, 1 AS less FROM {SIGHTS})"
    by_setups = "setups / greatest(n, 1)"
    share = {"none": "0", "setups": by_setups, "distance": f"CASE WHEN total > 0 THEN CASE WHEN setups = 0 THEN 0 ELSE dist / total END ELSE {by_setups} END"}[method]
    role = "CASE WHEN bs IS NOT NULL THEN 'HEIGHT_OF_INSTRUMENT' ELSE 'POINT' END AS role, " if kind == "separate" else ""
    return f"""WITH q AS (SELECT *, {_START} + sum(rise) OVER w AS raw, {_START} + sum(rise) OVER p - {_END} AS cl, CAST(sum(one) OVER w - less AS DOUBLE) AS setups, CAST(sum(one) OVER p - less AS DOUBLE) AS n, sum(leg) OVER w AS dist, sum(leg) OVER p AS total FROM {rows}
        WINDOW w AS (PARTITION BY run_id ORDER BY seq ROWS UNBOUNDED PRECEDING), p AS (PARTITION BY run_id))
    SELECT run_id, seq, {role}{r('raw')} AS raw_elevation, {r(f'raw - cl * ({share})')} AS elevation, {r('cl')} AS closure FROM q"""


def _level(kind: str, method: str):
    @query(f"f3_level_{kind}_{method}", _level_sql(kind, method))
    def run(spark, sf):
        rows = sights(spark, sf)
        if kind == "separate":
            from pyspark.sql import Window

            k = F.row_number().over(Window.partitionBy("run_id").orderBy("seq"))
            rows = rows.withColumn("k", k).withColumns({"backsight": F.when(F.col("k") % 2 == 1, F.col("backsight")), "foresight": F.when(F.col("k") % 2 == 0, F.col("foresight")), "distance_fs": F.lit(0.0)})
        op = {"setups": sequential.level_setups, "separate": sequential.level_separate, "station": sequential.level_stations}[kind]
        return op(rows, _START, _END, method)


for _kind in ("setups", "separate", "station"):
    for _method in ("none", "setups", "distance"):
        _level(_kind, _method)


def _traverse_sql(method: str) -> str:
    fix = {
        "none": ("0", "0"), "bowditch": ("-cn * distance / len", "-ce * distance / len"),
        "transit": ("-CASE WHEN an = 0 THEN 0 ELSE cn * abs(dn) / an END", "-CASE WHEN ae = 0 THEN 0 ELSE ce * abs(de) / ae END"),
    }[method]
    return f"""WITH d AS (SELECT *, distance * cos(radians(azimuth_deg)) AS dn, distance * sin(radians(azimuth_deg)) AS de FROM {COURSES}),
    t AS (SELECT *, sum(dn) OVER p AS cn, sum(de) OVER p AS ce, sum(distance) OVER p AS len, sum(abs(dn)) OVER p AS an, sum(abs(de)) OVER p AS ae FROM d WINDOW p AS (PARTITION BY run_id)),
    a AS (SELECT *, dn + {fix[0]} AS xn, de + {fix[1]} AS xe FROM t)
    SELECT run_id, seq, {r('1000 + sum(xn) OVER w')} AS northing, {r('2000 + sum(xe) OVER w')} AS easting, {r('sqrt(cn * cn + ce * ce)')} AS linear_closure, {r('len / sqrt(cn * cn + ce * ce)')} AS precision
    FROM a WINDOW w AS (PARTITION BY run_id ORDER BY seq ROWS UNBOUNDED PRECEDING)"""


def _traverse(method: str):
    @query(f"f4_traverse_{method}", _traverse_sql(method))
    def run(spark, sf):
        return sequential.traverse(courses(spark, sf), 1000.0, 2000.0, method=method)


for _method in ("none", "bowditch", "transit"):
    _traverse(_method)

_TRACK = f"""(SELECT user_id, event_id AS seq, value * {FOOT_SQL} AS northing, (value % 13) * {FOOT_SQL} AS easting, CASE WHEN event_id % 23 = 0 THEN NULL ELSE (value % 17) * {FOOT_SQL} END AS elevation,
    CASE event_type WHEN 'signup' THEN 'BS' WHEN 'error' THEN 'ES' WHEN 'purchase' THEN 'PC' WHEN 'view' THEN 'PT' ELSE NULL END AS command FROM events)"""


def _track(spark, sf):
    return table(spark, sf, "events").selectExpr(
        "user_id", "event_id AS seq", f"value * {FOOT} AS northing", f"(value % 13) * {FOOT} AS easting", f"CASE WHEN event_id % 23 = 0 THEN NULL ELSE (value % 17) * {FOOT} END AS elevation",
        "CASE event_type WHEN 'signup' THEN 'BS' WHEN 'error' THEN 'ES' WHEN 'purchase' THEN 'PC' WHEN 'view' THEN 'PT' ELSE NULL END AS command",
    )


@query(
    "f5_elevation_jump",
    f"""WITH l AS (SELECT *, lag(northing) OVER w AS pn, lag(easting) OVER w AS pe, lag(elevation) OVER w AS pz FROM {_TRACK} WINDOW w AS (PARTITION BY user_id ORDER BY seq)),
    g AS (SELECT user_id, seq, sqrt((northing - pn) ** 2 + (easting - pe) ** 2) AS gap, elevation - pz AS dz FROM l) SELECT user_id, seq, {r('gap')} AS gap, {r('dz')} AS dz FROM g WHERE gap <= 10 AND abs(dz) >= 1.5""",
)
def f5(spark, sf):
    return sequential.elevation_jumps(_track(spark, sf), 1.5, 10.0, "user_id", "seq")


_CHAINS = f"""WITH l AS (SELECT *, sqrt((northing - lag(northing) OVER w) ** 2 + (easting - lag(easting) OVER w) ** 2) AS step, coalesce(lag(command) OVER w = 'ES', false) AS ended FROM {_TRACK} WINDOW w AS (PARTITION BY user_id ORDER BY seq)),
    n AS (SELECT *, CASE WHEN step IS NULL OR step > 25 OR step <= 1e-8 OR coalesce(command = 'BS', false) OR ended THEN 1 ELSE 0 END AS new FROM l),
    c AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY seq) AS chain, CASE WHEN new = 1 THEN 0 ELSE step END AS s FROM n),
    x AS (SELECT user_id, seq, CAST(chain AS BIGINT) AS chain, elevation, sum(s) OVER (PARTITION BY user_id, chain ORDER BY seq ROWS UNBOUNDED PRECEDING) AS chainage FROM c)"""


@query("f6_chains", _CHAINS + f" SELECT user_id, seq, chain, {r('chainage')} AS chainage FROM x")
def f6(spark, sf):
    return sequential.chains(_track(spark, sf).withColumn("command", F.coalesce("command", F.lit(""))), 25.0, "user_id", "seq")


@query(
    "f7_grade_fit",
    f"""WITH w AS (SELECT user_id, seq, value * {FOOT_SQL} AS z, CAST(row_number() OVER (PARTITION BY user_id ORDER BY seq) AS DOUBLE) * 10 * {FOOT_SQL} AS x FROM (SELECT user_id, event_id AS seq, value FROM events)),
    s AS (SELECT *, count(*) OVER k AS n, sum(x) OVER k AS sx, sum(z) OVER k AS sz, sum(x * x) OVER k AS sxx, sum(x * z) OVER k AS sxz FROM w WINDOW k AS (PARTITION BY user_id ORDER BY seq ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING)),
    g AS (SELECT *, CASE WHEN n = 3 THEN (n * sxz - sx * sz) / (n * sxx - sx * sx) END AS slope FROM s)
    SELECT user_id, seq, {r('slope')} AS slope, {r('z - (sz - slope * sx) / n - slope * x')} AS "offset" FROM g""",
)
def f7(spark, sf):
    from pyspark.sql import Window

    k = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")).cast("double")
    rows = table(spark, sf, "events").withColumn("k", k).selectExpr("user_id", "event_id AS seq", f"value * {FOOT} AS elevation", f"k * 10 * {FOOT} AS chainage")
    return sequential.local_grades(rows, 3, "user_id", "seq")


@query(
    "f11_linework",
    f"""WITH b AS (SELECT user_id, seq, coalesce(command, '') AS command FROM {_TRACK}), n AS (SELECT *, CASE WHEN command = 'BS' OR coalesce(lag(command) OVER w IN ('ES', 'CL'), true) THEN 1 ELSE 0 END AS new FROM b WINDOW w AS (PARTITION BY user_id ORDER BY seq)),
    p AS (SELECT *, CAST(sum(new) OVER (PARTITION BY user_id ORDER BY seq) AS BIGINT) AS part FROM n), c AS (SELECT user_id, part, seq, command, lag(command) OVER (PARTITION BY user_id, part ORDER BY seq) AS before FROM p WHERE command IN ('PC', 'PT')),
    f AS (SELECT user_id, part, bool_or(command = 'PC' AND coalesce(before = 'PC', false)) AS nested, bool_or(command = 'PT' AND coalesce(before <> 'PC', true)) AS unpaired, arg_max(command, seq) AS last_curve FROM c GROUP BY ALL),
    g AS (SELECT user_id, part, min(seq) AS first_seq, count(*) AS n, arg_min(command, seq) AS first, arg_max(command, seq) AS last FROM p GROUP BY ALL),
    s AS (SELECT g.*, nested, unpaired, last_curve, CASE WHEN last = 'ES' THEN 'COMPLETE' WHEN last = 'CL' THEN 'COMPLETE_CLOSED' WHEN lead(g.part) OVER (PARTITION BY g.user_id ORDER BY g.part) IS NOT NULL THEN 'REVIEW' ELSE 'OPEN' END AS status FROM g LEFT JOIN f ON f.user_id = g.user_id AND f.part = g.part)
    SELECT user_id, part, first_seq, n + CASE WHEN status = 'COMPLETE_CLOSED' THEN 1 ELSE 0 END AS vertices, status, array_to_string(list_filter([CASE WHEN status = 'REVIEW' THEN 'RESTARTED' END, CASE WHEN first <> 'BS' THEN 'NO_START' END, CASE WHEN status = 'OPEN' THEN 'NO_END' END,
        CASE WHEN nested THEN 'NESTED_PC' END, CASE WHEN unpaired THEN 'PT_WITHOUT_PC' END, CASE WHEN last_curve = 'PC' THEN 'PC_OPEN' END], lambda x: x IS NOT NULL), ',') AS flags FROM s""",
)
def f11(spark, sf):
    return sequential.linework(_track(spark, sf), "user_id", "seq")


@query(
    "f13_closure_gaps",
    f"""WITH p AS (SELECT user_id, event_id AS seq, value * {FOOT_SQL} AS sn, (value % 7) * {FOOT_SQL} AS se, (value % 11) * {FOOT_SQL} AS en, (value % 5) * {FOOT_SQL} AS ee FROM events),
    n AS (SELECT *, coalesce(lead(sn) OVER w, first_value(sn) OVER w) - en AS dn, coalesce(lead(se) OVER w, first_value(se) OVER w) - ee AS de FROM p WINDOW w AS (PARTITION BY user_id ORDER BY seq))
    SELECT user_id, seq, {r('dn')} AS dn, {r('de')} AS de, {r('sqrt(dn * dn + de * de)')} AS gap FROM n""",
)
def f13(spark, sf):
    rows = table(spark, sf, "events").selectExpr("user_id", "event_id AS seq", f"value * {FOOT} AS start_n", f"(value % 7) * {FOOT} AS start_e", f"(value % 11) * {FOOT} AS end_n", f"(value % 5) * {FOOT} AS end_e")
    return sequential.closure_gaps(rows, "user_id", "seq")


_ELEMENTS = f"""(SELECT user_id, event_id AS seq, CASE WHEN event_type IN ('click', 'view') THEN 'curve' ELSE 'tangent' END AS kind, 10 + value * {FOOT_SQL} AS length, 50 + value * {FOOT_SQL} AS radius, 5 + (value % 40) AS delta_deg,
    CASE WHEN event_type = 'click' THEN 'LEFT' ELSE 'RIGHT' END AS direction FROM events)"""


@query(
    "f15_alignment",
    f"""WITH t AS (SELECT *, CASE WHEN kind = 'curve' THEN CASE direction WHEN 'LEFT' THEN -delta_deg ELSE delta_deg END ELSE 0 END AS turn, CASE WHEN kind = 'curve' THEN radius * radians(delta_deg) ELSE length END AS run,
        CASE WHEN kind = 'curve' THEN 2 * radius * sin(radians(delta_deg) / 2) ELSE length END AS chord FROM {_ELEMENTS}),
    a AS (SELECT *, 45 + sum(turn) OVER w AS azo FROM t WINDOW w AS (PARTITION BY user_id ORDER BY seq ROWS UNBOUNDED PRECEDING)),
    d AS (SELECT *, chord * cos(radians(azo - turn / 2)) AS dn, chord * sin(radians(azo - turn / 2)) AS de FROM a),
    e AS (SELECT *, 1000 + sum(dn) OVER w AS en, 2000 + sum(de) OVER w AS ee, 500 + sum(run) OVER w AS es FROM d WINDOW w AS (PARTITION BY user_id ORDER BY seq ROWS UNBOUNDED PRECEDING))
    SELECT user_id, seq, {r('es - run')} AS start_station, {r('es')} AS end_station, {r('en - dn')} AS start_n, {r('ee - de')} AS start_e, {r('en')} AS end_n, {r('ee')} AS end_e, {r('azo - turn - 360 * floor((azo - turn) / 360)')} AS azimuth_in, {r('azo - 360 * floor(azo / 360)')} AS azimuth_out FROM e""",
)
def f15(spark, sf):
    rows = table(spark, sf, "events").selectExpr(
        "user_id", "event_id AS seq", "CASE WHEN event_type IN ('click', 'view') THEN 'curve' ELSE 'tangent' END AS kind", f"10 + value * {FOOT} AS length", f"50 + value * {FOOT} AS radius", "5 + (value % 40) AS delta_deg", "CASE WHEN event_type = 'click' THEN 'LEFT' ELSE 'RIGHT' END AS direction"
    )
    return sequential.horizontal_alignment(rows, 1000.0, 2000.0, 45.0, 500.0, "user_id", "seq")


_ALIGNED = f"""WITH t AS (SELECT *, CASE WHEN kind = 'curve' THEN CASE direction WHEN 'LEFT' THEN -delta_deg ELSE delta_deg END ELSE 0 END AS turn, CASE WHEN kind = 'curve' THEN radius * radians(delta_deg) ELSE length END AS run,
        CASE WHEN kind = 'curve' THEN 2 * radius * sin(radians(delta_deg) / 2) ELSE length END AS chord FROM {_ELEMENTS}),
    a AS (SELECT *, 45 + sum(turn) OVER w AS azo FROM t WINDOW w AS (PARTITION BY user_id ORDER BY seq ROWS UNBOUNDED PRECEDING)),
    d AS (SELECT *, chord * cos(radians(azo - turn / 2)) AS dn, chord * sin(radians(azo - turn / 2)) AS de FROM a),
    e AS (SELECT *, 1000 + sum(dn) OVER w - dn AS sn, 2000 + sum(de) OVER w - de AS se, 500 + sum(run) OVER w AS es FROM d WINDOW w AS (PARTITION BY user_id ORDER BY seq ROWS UNBOUNDED PRECEDING))"""


@query(
    "i47_point_at_station",
    _ALIGNED
    + f""", s AS (SELECT DISTINCT user_id, CAST(k * 777.7 + 500 AS DOUBLE) AS station FROM events, (VALUES (0), (1), (2), (3), (400)) v(k)),
    h AS (SELECT s.user_id, station, seq AS element, station - (es - run) AS x, kind, radius, direction, azo - turn AS azi, sn, se, row_number() OVER (PARTITION BY s.user_id, station ORDER BY seq) AS j FROM s JOIN e ON e.user_id = s.user_id AND station >= es - run - 1e-9 AND station <= es + 1e-9),
    q AS (SELECT *, CASE WHEN kind = 'curve' THEN x / radius ELSE 0 END AS sweep, CASE WHEN direction = 'LEFT' THEN -1 ELSE 1 END AS sign FROM h WHERE j = 1), p AS (SELECT *, CASE WHEN kind = 'curve' THEN 2 * radius * sin(sweep / 2) ELSE x END AS c, radians(azi) + sign * sweep / 2 AS al, azi + sign * degrees(sweep) AS az FROM q)
    SELECT s.user_id, {r('s.station')} AS station, {r('sn + c * cos(al)', 3)} AS northing, {r('se + c * sin(al)', 3)} AS easting, {r('az - 360 * floor(az / 360)', 3)} AS azimuth, element FROM s LEFT JOIN p ON p.user_id = s.user_id AND p.station = s.station""",
)
def i47(spark, sf):
    """Five stations of each alignment, one of them beyond its end."""
    own = table(spark, sf, "events").selectExpr("user_id", "event_id AS seq", "CASE WHEN event_type IN ('click', 'view') THEN 'curve' ELSE 'tangent' END AS kind", f"50 + value * {FOOT} AS radius", "CASE WHEN event_type = 'click' THEN 'LEFT' ELSE 'RIGHT' END AS direction")
    stations = table(spark, sf, "events").select("user_id").distinct().withColumn("k", F.explode(F.array(*map(F.lit, (0, 1, 2, 3, 400))))).selectExpr("user_id", "CAST(k * 777.7 + 500 AS DOUBLE) AS station")
    out = sequential.points_at_stations(f15(spark, sf).join(own, ["user_id", "seq"]), stations, "user_id", "seq")
    return out.select("user_id", "station", *[F.round(c, 3).alias(c) for c in ("northing", "easting", "azimuth")], "element")


@query(
    "i45_stakes",
    f"""WITH c AS (SELECT p_partkey AS curve_id, 1000 + p_retailprice * {FOOT_SQL} AS pc, 100 + p_size * {FOOT_SQL} AS radius, 20 + p_size * {FOOT_SQL} AS delta FROM part), e AS (SELECT *, pc + radius * radians(delta) AS pt FROM c),
    s AS (SELECT curve_id, pc, radius, pc AS station FROM e UNION ALL SELECT curve_id, pc, radius, pt FROM e UNION ALL SELECT curve_id, pc, radius, CAST(unnest(range(CAST(floor(pc / 25) AS BIGINT) + 1, CAST(ceil(pt / 25) AS BIGINT))) AS DOUBLE) * 25 FROM e)
    SELECT curve_id, {r('station')} AS station, {r('degrees((station - pc) / (2 * radius))')} AS deflection_deg, {r('2 * radius * sin((station - pc) / (2 * radius))')} AS chord FROM s""",
)
def i45(spark, sf):
    rows = table(spark, sf, "part").selectExpr("p_partkey AS curve_id", f"1000 + p_retailprice * {FOOT} AS pc_station", f"100 + p_size * {FOOT} AS radius", f"20 + p_size * {FOOT} AS delta_deg")
    return sequential.curve_stakes(rows, 25.0)


@query("f8_rod_events")
def f8(spark, sf):
    """Shift events along vectors' places, chained by label in order of northing; every 40 rows, ten are lifted."""
    from pyspark.sql import Window

    w = Window.partitionBy("label").orderBy("northing", "point_id")
    rows = places(spark, sf).withColumn("k", F.row_number().over(w)).selectExpr("label AS chain_id", "CAST(k AS BIGINT) AS seq", "k * 10.0D AS chainage", "elevation / 1000 + k * 0.02D + CASE WHEN k % 40 BETWEEN 20 AND 29 THEN 1.83D ELSE 0.0D END AS elevation")
    return rodshift.shift_events(rows)


@query("f10_rod_candidates")
def f10(spark, sf):
    """Events of all chains, grouped and scored."""
    return rodshift.event_groups(f8(spark, sf), 5)


@query("f9_correlated")
def f9(spark, sf):
    """The events of ``f8_rod_events`` in runs of 500 rows, greedily grouped."""
    events = f8(spark, sf).selectExpr("first_seq div 500 AS run_id", "chain_id", "first_seq", "last_seq", "shift", "first_seq * 10.0D AS northing", "chain_id * 5.0D AS easting")
    return rodshift.correlated(events).select("run_id", "chain_id", "first_seq", "last_seq", "grp")


@query("f10_scored_candidates")
def f10_scored(spark, sf):
    """The events of ``f8_rod_events`` in runs of 500 rows, with hazards, setups and points of other roles among their rows, scored by the full rule."""
    from pyspark.sql import Window

    w = Window.partitionBy("label").orderBy("northing", "point_id")
    rows = places(spark, sf).withColumn("k", F.row_number().over(w).cast("long")).selectExpr("k div 500 AS run_id", "label AS chain_id", "k", "k * 10 + label AS seq", "k * 10.0D AS northing", "label * 5.0D AS easting")
    role = "CASE WHEN k % 40 = 19 AND chain_id = 3 THEN 'setup' WHEN k % 120 = 65 AND chain_id = 4 THEN 'ditch' WHEN k % 400 = 100 THEN 'structure' WHEN k % 90 = 25 AND chain_id = 7 THEN 'unknown' ELSE 'surface' END AS role"
    points = rows.selectExpr("run_id", "seq", "northing", "easting", role)
    nodes = rows.selectExpr("run_id", "chain_id", "seq", "CASE WHEN k % 40 BETWEEN 20 AND 29 THEN 1.83D ELSE 0.0D END AS offset", "concat('F', chain_id % 6) AS feature")
    events = f8(spark, sf).selectExpr("first_seq div 500 AS run_id", "first_seq * 10 + chain_id AS first_seq", "last_seq * 10 + chain_id AS last_seq", "chain_id", "shift", "first_seq * 10.0D AS northing", "chain_id * 5.0D AS easting", "recovered")
    return rodshift.rod_candidates(points, nodes, events, rodshift.Correlation(rows=120), confirmed=True)
