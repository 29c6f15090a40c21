"""Queries of geometry, earthwork and place joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.functions import cogo, measures
from plumbline.operators import control, evidence, networks, surfaces
from plumbline.operators.scalars import attach
from plumbline.plans.bindings import FOOT, FOOT_SQL, PLACES, places, query, r, table


def _mod(x: str) -> str:
    return f"({x} - 360 * floor(({x}) / 360))"


_PAIRS = f"(SELECT a.point_id AS id, a.northing AS n1, a.easting AS e1, b.northing AS n2, b.easting AS e2 FROM {PLACES} a JOIN {PLACES} b ON b.point_id = a.point_id + 1)"


def _pairs(spark, sf):
    p = places(spark, sf)
    a = p.selectExpr("point_id AS id", "northing AS n1", "easting AS e1")
    return a.join(p.selectExpr("point_id - 1 AS id", "northing AS n2", "easting AS e2"), "id")


@query("i40_inverse", f"SELECT id, {r('sqrt((n2 - n1) ** 2 + (e2 - e1) ** 2)')} AS distance, {r(_mod('degrees(atan2(e2 - e1, n2 - n1))'))} AS azimuth FROM {_PAIRS}")
def i40(spark, sf):
    d, a = cogo.inverse(*map(F.col, ("n1", "e1", "n2", "e2")))
    return _pairs(spark, sf).select("id", d.alias("distance"), a.alias("azimuth"))


@query("i41_forward", f"SELECT id, {r('n1 + abs(n2) * cos(radians(e2))')} AS northing, {r('e1 + abs(n2) * sin(radians(e2))')} AS easting FROM {_PAIRS}")
def i41(spark, sf):
    n, e = cogo.forward(F.col("n1"), F.col("e1"), F.col("e2"), F.abs("n2"))
    return _pairs(spark, sf).select("id", n.alias("northing"), e.alias("easting"))


@query(
    "i42_intersection",
    f"""WITH p AS (SELECT id, n1, e1, n2, e2, radians(n1) AS a, radians(e2) AS b FROM {_PAIRS}), d AS (SELECT *, sin(a) * cos(b) - cos(a) * sin(b) AS det FROM p), t AS (SELECT *, ((e2 - e1) * cos(b) - (n2 - n1) * sin(b)) / det AS t FROM d WHERE abs(det) >= 0.01)
    SELECT id, {r('n1 + t * cos(a)', 3)} AS northing, {r('e1 + t * sin(a)', 3)} AS easting FROM t""",
)
def i42(spark, sf):
    a, b = F.radians("n1"), F.radians("e2")
    rows = _pairs(spark, sf).where(F.abs(F.sin(a) * F.cos(b) - F.cos(a) * F.sin(b)) >= 0.01)
    n, e = cogo.line_intersection(F.col("n1"), F.col("e1"), F.col("n1"), F.col("n2"), F.col("e2"), F.col("e2"))
    return rows.select("id", F.round(n, 3).alias("northing"), F.round(e, 3).alias("easting"))


_CURVES = f"(SELECT p_partkey AS id, 100 + p_retailprice * {FOOT_SQL} AS rad, 5 + p_size * {FOOT_SQL} AS delta FROM part)"


def _curves(spark, sf):
    return table(spark, sf, "part").selectExpr("p_partkey AS id", f"100 + p_retailprice * {FOOT} AS rad", f"5 + p_size * {FOOT} AS delta")


@query(
    "i43_curve",
    f"""WITH h AS (SELECT *, radians(delta) / 2 AS h FROM {_CURVES}) SELECT id, {r('rad * tan(h)')} AS tangent, {r('rad * 2 * h')} AS arc_length, {r('2 * rad * sin(h)')} AS long_chord, {r('rad * (1 / cos(h) - 1)')} AS external,
        {r('rad * (1 - cos(h))')} AS middle_ordinate, {r('18000 / (pi() * rad)')} AS degree_of_curve, {r('delta')} AS delta_again FROM h""",
)
def i43(spark, sf):
    """The angle is found again from tangent and arc."""
    parts = cogo.curve_from_radius_delta(F.col("rad"), F.col("delta"))
    return _curves(spark, sf).select("id", *[c.alias(k) for k, c in parts.items()], cogo.delta_from_tangent_arc(parts["tangent"], parts["arc_length"]).alias("delta_again"))


@query(
    "i44_circle",
    f"""WITH t AS (SELECT p.id, p.n1, p.e1, p.n2, p.e2, q.n2 AS n3, q.e2 AS e3 FROM {_PAIRS} p JOIN {_PAIRS} q ON q.id = p.id + 1), d AS (SELECT *, 2 * (e1 * (n2 - n3) + e2 * (n3 - n1) + e3 * (n1 - n2)) AS d, e1 * e1 + n1 * n1 AS s1, e2 * e2 + n2 * n2 AS s2, e3 * e3 + n3 * n3 AS s3 FROM t),
    c AS (SELECT *, (s1 * (n2 - n3) + s2 * (n3 - n1) + s3 * (n1 - n2)) / d AS ce, (s1 * (e3 - e2) + s2 * (e1 - e3) + s3 * (e2 - e1)) / d AS cn FROM d WHERE abs(d) >= 2000)
    SELECT id, {r('cn', 3)} AS northing, {r('ce', 3)} AS easting, {r('sqrt((n1 - cn) ** 2 + (e1 - ce) ** 2)', 3)} AS radius FROM c""",
)
def i44(spark, sf):
    p = _pairs(spark, sf)
    t = p.join(p.selectExpr("id - 1 AS id", "n2 AS n3", "e2 AS e3"), "id")
    args = [F.col(c) for c in ("n1", "e1", "n2", "e2", "n3", "e3")]
    n1, e1, n2, e2, n3, e3 = args
    n, e, radius = cogo.circle_through(*args)
    t = t.where(F.abs(2 * (e1 * (n2 - n3) + e2 * (n3 - n1) + e3 * (n1 - n2))) >= 2000)
    return t.select("id", *[F.round(c, 3).alias(k) for k, c in (("northing", n), ("easting", e), ("radius", radius))])


@query(
    "i46_vertical",
    f"""WITH c AS (SELECT p_partkey AS id, p_retailprice * {FOOT_SQL} AS bvc, p_size / CAST(10 AS DOUBLE) AS g1, 2 - p_size / CAST(7 AS DOUBLE) AS g2, 100 + p_size AS len FROM part), t AS (SELECT *, g1 * len / (g1 - g2) AS x FROM c WHERE g1 <> g2)
    SELECT c.id, {r('c.bvc + c.g1 / 100 * 30 + (c.g2 - c.g1) / 100 * 900 / (2 * c.len)')} AS elevation, {r('CASE WHEN x > 0 AND x < c.len THEN x END')} AS turning FROM c LEFT JOIN t ON c.id = t.id""",
)
def i46(spark, sf):
    rows = table(spark, sf, "part").selectExpr("p_partkey AS id", f"p_retailprice * {FOOT} AS bvc", "p_size / 10.0D AS g1", "2 - p_size / 7.0D AS g2", "100 + p_size AS len")
    g1, g2, length = F.col("g1"), F.col("g2"), F.col("len")
    return rows.select("id", cogo.vertical_curve(F.col("bvc"), g1, g2, length, F.lit(30.0)).alias("elevation"), cogo.turning_point(g1, g2, length).alias("turning"))


@query(
    "i49_local_site",
    f"""WITH c AS (SELECT point_id, easting - 10 AS e, northing - 20 AS n, cos(radians(30)) AS c, sin(radians(30)) AS s FROM {PLACES}) SELECT point_id, {r('(e * c + n * s) * 1.0002')} AS local_e, {r('(n * c - e * s) * 1.0002')} AS local_n FROM c""",
)
def i49(spark, sf):
    e, n = cogo.local_site(F.col("easting"), F.col("northing"), 30.0, 1.0002, 10.0, 20.0)
    return places(spark, sf).select("point_id", e.alias("local_e"), n.alias("local_n"))


@query("i50_similarity", f"SELECT point_id, {r('easting')} AS x, {r('northing')} AS y FROM {PLACES}")
def i50(spark, sf):
    """Applying the transform and then its inverse gives the points back."""
    x, y = cogo.similarity(F.col("easting"), F.col("northing"), 1.25, 33.0, 100.0, -40.0)
    rows = places(spark, sf).select("point_id", x.alias("gx"), y.alias("gy"))
    x, y = cogo.similarity_inverse(F.col("gx"), F.col("gy"), 1.25, 33.0, 100.0, -40.0)
    return rows.select("point_id", x.alias("x"), y.alias("y"))


@query("i51_web_mercator", f"SELECT point_id, {r('6378137.0 * radians(easting / 5)', 2)} AS x, {r('6378137.0 * ln(tan(pi() / 4 + radians(northing / 5) / 2))', 2)} AS y FROM {PLACES}")
def i51(spark, sf):
    x, y = cogo.web_mercator(F.col("easting") / 5, F.col("northing") / 5)
    return places(spark, sf).select("point_id", F.round(x, 2).alias("x"), F.round(y, 2).alias("y"))


@query("i25_angle_difference", f"SELECT id, {r(_mod('n1 - e2 + 180') + ' - 180')} AS difference, {r('CASE WHEN abs(n2) <= 60 THEN 1 ELSE 60 / abs(n2) END')} AS weight FROM {_PAIRS}")
def i25(spark, sf):
    return _pairs(spark, sf).select("id", measures.angle_difference(F.col("n1"), F.col("e2")).alias("difference"), measures.huber_weight(F.col("n2"), 60.0).alias("weight"))


_RINGS = f"(SELECT label AS polygon_id, point_id AS seq, northing + 2000000 AS northing, easting + 600000 AS easting FROM {PLACES})"


@query(
    "e15_polygon",
    f"""WITH o AS (SELECT *, northing - first_value(northing) OVER w AS y, easting - first_value(easting) OVER w AS x, first_value(northing) OVER w AS n0, first_value(easting) OVER w AS e0 FROM {_RINGS} WINDOW w AS (PARTITION BY polygon_id ORDER BY seq)),
    l AS (SELECT *, coalesce(lead(y) OVER w, 0) AS y2, coalesce(lead(x) OVER w, 0) AS x2 FROM o WINDOW w AS (PARTITION BY polygon_id ORDER BY seq)),
    s AS (SELECT polygon_id, count(*) AS vertices, sum(x * y2 - x2 * y) AS t, sum(sqrt((x2 - x) ** 2 + (y2 - y) ** 2)) AS p, sum((x + x2) * (x * y2 - x2 * y)) AS cx, sum((y + y2) * (x * y2 - x2 * y)) AS cy, min(n0) AS n0, min(e0) AS e0 FROM l GROUP BY 1)
    SELECT polygon_id, vertices, {r('abs(t) / 2')} AS area, {r('p')} AS perimeter, {r('n0 + cy / (3 * t)')} AS centroid_n, {r('e0 + cx / (3 * t)')} AS centroid_e, CASE WHEN t > 0 THEN 'CCW' ELSE 'CW' END AS orientation FROM s""",
)
def e15(spark, sf):
    rows = places(spark, sf).selectExpr("label AS polygon_id", "point_id AS seq", "northing + 2000000 AS northing", "easting + 600000 AS easting")
    return surfaces.polygon_measures(rows)


@query(
    "e21_average_end_area",
    f"""WITH s AS (SELECT user_id AS line_id, event_id * {FOOT_SQL} AS station, value AS c, value % 9 AS f FROM events), d AS (SELECT *, station - lag(station) OVER w AS d, (c + lag(c) OVER w) / 2 AS mc, (f + lag(f) OVER w) / 2 AS mf FROM s WINDOW w AS (PARTITION BY line_id ORDER BY station)),
    v AS (SELECT *, coalesce(mc * d, 0) AS cv, coalesce(mf * d, 0) AS fv FROM d) SELECT line_id, {r('station')} AS station, {r('cv', 3)} AS cut_volume, {r('fv', 3)} AS fill_volume, {r('sum(cv - fv) OVER (PARTITION BY line_id ORDER BY station ROWS UNBOUNDED PRECEDING)', 3)} AS ordinate FROM v""",
)
def e21(spark, sf):
    rows = table(spark, sf, "events").selectExpr("user_id AS line_id", f"event_id * {FOOT} AS station", "value AS cut_area", "value % 9 AS fill_area")
    out = surfaces.average_end_area(rows)
    return out.select("line_id", "station", *[F.round(c, 3).alias(c) for c in ("cut_volume", "fill_volume", "ordinate")])


_GROUND = f"(SELECT user_id AS section_id, CAST(event_id % 41 AS DOUBLE) AS o, max(value) * {FOOT_SQL} AS z FROM events WHERE event_type IN ('click', 'view') GROUP BY 1, 2)"
_DESIGN = f"(SELECT user_id AS section_id, CAST(event_id % 37 AS DOUBLE) + 0.5 AS o, avg(value % 100) * {FOOT_SQL} AS z FROM events WHERE event_type = 'signup' GROUP BY 1, 2)"


@query(
    "e22_cut_fill",
    f"""WITH g AS {_GROUND}, d AS {_DESIGN}, o AS (SELECT section_id, o FROM g UNION SELECT section_id, o FROM d),
    a AS (SELECT o.section_id, o.o, max(g.o) FILTER (g.o <= o.o) AS gl, min(g.o) FILTER (g.o >= o.o) AS gr FROM o JOIN g ON g.section_id = o.section_id GROUP BY 1, 2), b AS (SELECT o.section_id, o.o, max(d.o) FILTER (d.o <= o.o) AS dl, min(d.o) FILTER (d.o >= o.o) AS dr FROM o JOIN d ON d.section_id = o.section_id GROUP BY 1, 2),
    z AS (SELECT a.section_id, a.o, CASE WHEN gl = gr THEN g1.z ELSE g1.z + (g2.z - g1.z) * (a.o - gl) / (gr - gl) END AS gz, CASE WHEN dl = dr THEN d1.z ELSE d1.z + (d2.z - d1.z) * (a.o - dl) / (dr - dl) END AS dz FROM a JOIN b ON a.section_id = b.section_id AND a.o = b.o
        JOIN g g1 ON g1.section_id = a.section_id AND g1.o = gl JOIN g g2 ON g2.section_id = a.section_id AND g2.o = gr JOIN d d1 ON d1.section_id = a.section_id AND d1.o = dl JOIN d d2 ON d2.section_id = a.section_id AND d2.o = dr),
    i AS (SELECT section_id, gz - dz AS a, lead(gz - dz) OVER w AS b, lead(o) OVER w - o AS w FROM z WINDOW w AS (PARTITION BY section_id ORDER BY o)),
    k AS (SELECT section_id, w, a, b, abs(a) / nullif(abs(a) + abs(b), 0) AS t FROM i WHERE w IS NOT NULL)
    SELECT section_id, {r('sum(CASE WHEN a * b < 0 THEN CASE WHEN a > 0 THEN a * w * t / 2 ELSE b * w * (1 - t) / 2 END ELSE greatest((a + b) * w / 2, 0) END)')} AS cut_area,
        {r('sum(CASE WHEN a * b < 0 THEN CASE WHEN a < 0 THEN -a * w * t / 2 ELSE -b * w * (1 - t) / 2 END ELSE greatest(-(a + b) * w / 2, 0) END)')} AS fill_area, {r('sum(w)')} AS width FROM k GROUP BY section_id""",
)
def e22(spark, sf):
    ev = table(spark, sf, "events")
    g = ev.where("event_type IN ('click', 'view')").groupBy(F.expr("user_id AS section_id"), F.expr("CAST(event_id % 41 AS DOUBLE) AS offset")).agg(F.expr(f"max(value) * {FOOT} AS elevation"))
    d = ev.where("event_type = 'signup'").groupBy(F.expr("user_id AS section_id"), F.expr("CAST(event_id % 37 AS DOUBLE) + 0.5D AS offset")).agg(F.expr(f"avg(value % 100) * {FOOT} AS elevation"))
    return surfaces.cut_fill(g, d)


_TERRAIN = f"(SELECT user_id AS section_id, CAST(event_id % 81 - 40 AS DOUBLE) AS o, max(value) * {FOOT_SQL} / 10 AS z FROM events GROUP BY 1, 2)"


@query(
    "i48_slope_catch",
    f"""WITH g AS {_TERRAIN}, s AS (SELECT section_id, o AS a, z AS za, lead(o) OVER w AS b, lead(z) OVER w AS zb FROM g WINDOW w AS (PARTITION BY section_id ORDER BY o)),
    e AS (SELECT DISTINCT user_id AS section_id, side, outr, CAST(user_id % 7 AS DOUBLE) + z1 AS z, (z1 - z2) / (outr - innr) AS m FROM events, (VALUES ('LEFT', CAST(-3 AS DOUBLE), CAST(-1.5 AS DOUBLE), CAST(-2 AS DOUBLE), CAST(0.1 AS DOUBLE)), ('RIGHT', 3, -1.1, 2, 0.2)) v(side, outr, z1, innr, z2)),
    h AS (SELECT e.*, a, (za - (zb - za) / (b - a) * a - z + m * outr) / (m - (zb - za) / (b - a)) AS x, b FROM e JOIN s USING (section_id) WHERE b IS NOT NULL AND abs(m - (zb - za) / (b - a)) > 1e-12),
    k AS (SELECT section_id, side, arg_min(x, CASE WHEN side = 'RIGHT' THEN a ELSE -a END) AS x FROM h WHERE x >= a - 1e-9 AND x <= b + 1e-9 AND CASE WHEN side = 'RIGHT' THEN x >= outr - 1e-9 ELSE x <= outr + 1e-9 END GROUP BY ALL),
    n AS (SELECT section_id, min(o) AS lo, max(o) AS hi FROM g GROUP BY 1), f AS (SELECT e.*, x, coalesce(x, CASE WHEN side = 'RIGHT' THEN hi ELSE lo END) AS p FROM e JOIN n USING (section_id) LEFT JOIN k USING (section_id, side))
    SELECT section_id, side, {r('p', 3)} AS "offset", {r('z + m * (p - outr)', 3)} AS elevation, {r('m')} AS slope, x IS NULL AS extrapolated FROM f""",
)
def i48(spark, sf):
    ev = table(spark, sf, "events")
    ground = ev.groupBy(F.expr("user_id AS section_id"), F.expr("CAST(event_id % 81 - 40 AS DOUBLE) AS offset")).agg(F.expr(f"max(value) * {FOOT} / 10 AS elevation"))
    users = ev.selectExpr("user_id AS section_id").distinct()
    design = users.withColumn("p", F.explode(F.array(*[F.struct(F.lit(o).alias("offset"), F.lit(z).alias("relative_elevation")) for o, z in ((-3.0, -1.5), (-2.0, 0.1), (0.0, 0.4), (2.0, 0.2), (3.0, -1.1))]))).select("section_id", "p.*")
    out = surfaces.slope_catch(surfaces.grade_profile(ground), design, users.selectExpr("section_id", "CAST(section_id % 7 AS DOUBLE) AS elevation"))
    return out.select("section_id", "side", F.round("offset", 3).alias("offset"), F.round("elevation", 3).alias("elevation"), "slope", "extrapolated")


_NEAR = f"(SELECT a.point_id AS id_a, b.point_id AS id_b, sqrt((a.northing - b.northing) ** 2 + (a.easting - b.easting) ** 2) AS distance, b.elevation - a.elevation AS dz FROM {PLACES} a JOIN {PLACES} b ON a.point_id < b.point_id WHERE sqrt((a.northing - b.northing) ** 2 + (a.easting - b.easting) ** 2) <= 20)"
_BOTH = f"(SELECT id_a AS point, id_b AS neighbour, distance, dz FROM {_NEAR} UNION ALL SELECT id_b, id_a, distance, -dz FROM {_NEAR})"


@query("d1_grid_pairs", f"SELECT id_a, id_b, {r('distance')} AS distance, {r('dz')} AS dz FROM {_NEAR}")
def d1_pairs(spark, sf):
    return surfaces.grid_pairs(places(spark, sf), 20.0)


@query(
    "d1_components",
    f"""WITH RECURSIVE e AS (SELECT point AS a, neighbour AS b FROM {_BOTH} WHERE distance <= 8), t(node, other) AS (SELECT a, b FROM e UNION SELECT t.node, e.b FROM t JOIN e ON t.other = e.a)
    SELECT node, least(node, min(other)) AS component FROM t GROUP BY node""",
)
def d1_components(spark, sf):
    return surfaces.clusters(places(spark, sf), 8.0)


@query(
    "d1_regroup",
    f"""WITH RECURSIVE e AS (SELECT point AS a, neighbour AS b FROM {_BOTH} WHERE distance <= 14), t(node, other) AS (SELECT a, b FROM e UNION SELECT t.node, e.b FROM t JOIN e ON t.other = e.a), c AS (SELECT node, least(node, min(other)) AS component FROM t GROUP BY node),
    o AS (SELECT point_id AS id, northing AS n, easting AS e, (100 + point_id // 2 % 3) || '' AS base, chr(CAST(65 + point_id % 5 AS INTEGER)) AS letter FROM {PLACES}), q AS (SELECT o.*, component FROM o LEFT JOIN c ON c.node = o.id),
    v AS (SELECT component, base, count(*) AS k, avg(n) AS mn, avg(e) AS me, list(letter) AS letters FROM q WHERE component IS NOT NULL GROUP BY ALL), w AS (SELECT *, row_number() OVER p AS rank, lead(k) OVER p AS second, count(*) OVER (PARTITION BY component) AS bases FROM v WINDOW p AS (PARTITION BY component ORDER BY k DESC, base)),
    m AS (SELECT component, CASE WHEN k >= 2 AND k > second THEN base ELSE '' END AS majority, mn, me, letters FROM w WHERE rank = 1 AND bases > 1),
    x AS (SELECT q.*, majority, mn, me, coalesce(majority <> '' AND base <> majority, false) AS other, coalesce(majority <> '' AND base <> majority AND NOT list_contains(letters, letter), false) AS free FROM q LEFT JOIN m USING (component)),
    y AS (SELECT *, free AND row_number() OVER (PARTITION BY component, letter, free ORDER BY id) = 1 AS taken FROM x)
    SELECT id AS observation_id, CASE WHEN taken THEN majority ELSE base END AS control_id, CASE WHEN taken THEN majority ELSE base END || letter AS point_id, CASE WHEN taken THEN 'SPATIAL_INFERENCE' ELSE 'POINT_ID' END AS source,
        CASE WHEN taken THEN 'PROBABLE_MISNUMBER' WHEN other OR majority = '' THEN 'SPATIAL_ID_CONFLICT' END AS flag, {r('CASE WHEN other THEN sqrt((n - mn) ** 2 + (e - me) ** 2) END')} AS distance FROM y""",
)
def d1_regroup(spark, sf):
    obs = places(spark, sf).selectExpr("point_id AS observation_id", "CAST(NULL AS STRING) AS control_id", "concat(100 + point_id div 2 % 3, chr(65 + point_id % 5)) AS point_id", "northing", "easting", "elevation")
    return control.regroup(obs, 14.0)


@query("g3_six_nearest", f"SELECT point, CAST(k AS INTEGER) AS place, neighbour, {r('distance')} AS distance FROM (SELECT *, row_number() OVER (PARTITION BY point ORDER BY distance, neighbour) AS k FROM {_BOTH}) WHERE k <= 6")
def g3(spark, sf):
    return surfaces.nearest_neighbours(places(spark, sf), 20.0)


@query(
    "f17_isolated_bust",
    f"""WITH n AS (SELECT * FROM {_BOTH} WHERE distance > 0), s AS (SELECT point, count(*) AS n, -median(dz) AS delta, min(distance) AS nearest FROM n GROUP BY point HAVING count(*) >= 2),
    m AS (SELECT *, least(abs(abs(delta) - 0.5), abs(abs(delta) - 1), abs(abs(delta) - 2)) AS err, abs(delta) / nearest * 100 AS slope FROM s)
    SELECT point, n, {r('delta')} AS delta, CASE err WHEN abs(abs(delta) - 0.5) THEN CAST(0.5 AS DOUBLE) WHEN abs(abs(delta) - 1) THEN 1 ELSE 2 END AS increment, {r('slope')} AS slope,
        {r('100 * (0.55 * (1 - err / 0.08) + 0.30 * least(1, slope / 24) + 0.15 * least(1, n / 5))')} AS confidence FROM m WHERE abs(delta) >= 0.45 AND err <= 0.08 AND slope >= 8""",
)
def f17(spark, sf):
    return surfaces.rod_busts(places(spark, sf), 20.0)


@query(
    "d9_nearest_structure",
    f"""WITH t AS (SELECT * FROM {PLACES} WHERE label < 5), s AS (SELECT * FROM {PLACES} WHERE label >= 5), d AS (SELECT t.point_id AS target, s.point_id AS structure, sqrt((t.northing - s.northing) ** 2 + (t.easting - s.easting) ** 2) AS distance FROM t JOIN s ON true),
    b AS (SELECT *, row_number() OVER (PARTITION BY target ORDER BY distance, structure) AS k FROM d WHERE distance <= 12) SELECT t.point_id AS target, structure, {r('distance')} AS distance, CASE WHEN structure IS NULL THEN 'missing' ELSE 'found' END AS status FROM t LEFT JOIN b ON target = t.point_id AND k = 1""",
)
def d9(spark, sf):
    p = places(spark, sf)
    return surfaces.nearest_structure(p.where("label < 5"), p.where("label >= 5"), 12.0)


_SEGMENTS = f"(SELECT a.point_id AS seq, a.northing AS n1, a.easting AS e1, b.northing AS n2, b.easting AS e2, CAST(a.point_id * 100 AS DOUBLE) AS station FROM {PLACES} a JOIN {PLACES} b ON b.point_id = a.point_id + 10 WHERE a.point_id % 10 = 3)"


def _segments(spark, sf):
    p = places(spark, sf)
    return p.where("point_id % 10 = 3").selectExpr("point_id AS seq", "northing AS n1", "easting AS e1", "CAST(point_id * 100 AS DOUBLE) AS station").join(p.selectExpr("point_id - 10 AS seq", "northing AS n2", "easting AS e2"), "seq")


@query(
    "d25_station_offset",
    f"""WITH x AS (SELECT p.point_id, s.*, n2 - n1 AS dn, e2 - e1 AS de, p.northing - n1 AS pn, p.easting - e1 AS pe FROM {PLACES} p JOIN {_SEGMENTS} s ON true), t AS (SELECT *, least(1, greatest(0, (pn * dn + pe * de) / (dn * dn + de * de))) AS t FROM x),
    d AS (SELECT *, sqrt((pn - t * dn) ** 2 + (pe - t * de) ** 2) AS distance FROM t), b AS (SELECT *, row_number() OVER (PARTITION BY point_id ORDER BY round(distance, 9), seq) AS k FROM d WHERE distance <= 15)
    SELECT point_id, seq, {r('station + t * sqrt(dn * dn + de * de)')} AS station, {r('-sign(dn * pe - de * pn) * distance')} AS "offset" FROM b WHERE k = 1""",
)
def d25(spark, sf):
    return surfaces.station_offset(places(spark, sf), _segments(spark, sf), 15.0)


@query(
    "d25_station_offset_all",
    f"""WITH x AS (SELECT p.point_id, s.*, n2 - n1 AS dn, e2 - e1 AS de, p.northing - n1 AS pn, p.easting - e1 AS pe FROM {PLACES} p JOIN {_SEGMENTS} s
        ON p.northing BETWEEN least(n1, n2) - 15 AND greatest(n1, n2) + 15 AND p.easting BETWEEN least(e1, e2) - 15 AND greatest(e1, e2) + 15),
    t AS (SELECT *, least(1, greatest(0, (pn * dn + pe * de) / (dn * dn + de * de))) AS t FROM x),
    d AS (SELECT *, sqrt((pn - t * dn) ** 2 + (pe - t * de) ** 2) AS distance FROM t), b AS (SELECT *, row_number() OVER (PARTITION BY point_id ORDER BY round(distance, 9), seq) AS k FROM d WHERE distance <= 15)
    SELECT point_id, seq, {r('station + t * sqrt(dn * dn + de * de)')} AS station, {r('-sign(dn * pe - de * pn) * distance')} AS "offset" FROM b WHERE k = 1""",
)
def d25_all(spark, sf):
    """Every point."""
    return surfaces.station_offset(places(spark, sf), _segments(spark, sf), 15.0)


@query(
    "d19_crossings",
    f"""WITH s AS (SELECT * FROM {_SEGMENTS}), x AS (SELECT a.seq AS seq_a, b.seq AS seq_b, (a.e2 - a.e1) * (b.n1 - a.n1) - (a.n2 - a.n1) * (b.e1 - a.e1) AS d1, (a.e2 - a.e1) * (b.n2 - a.n1) - (a.n2 - a.n1) * (b.e2 - a.e1) AS d2,
        (b.e2 - b.e1) * (a.n1 - b.n1) - (b.n2 - b.n1) * (a.e1 - b.e1) AS d3, (b.e2 - b.e1) * (a.n2 - b.n1) - (b.n2 - b.n1) * (a.e2 - b.e1) AS d4 FROM s a JOIN s b ON a.seq < b.seq) SELECT seq_a, seq_b FROM x WHERE d1 * d2 < 0 AND d3 * d4 < 0""",
)
def d19(spark, sf):
    return surfaces.crossings(_segments(spark, sf), 50.0)


@query(
    "d20_duplicate_segments",
    """WITH s AS (SELECT event_id AS seq, event_id % 20 AS n1, user_id % 15 AS e1, user_id % 20 AS n2, event_id % 15 AS e2 FROM events), k AS (SELECT seq, CASE WHEN (n1, e1) <= (n2, e2) THEN (n1, e1, n2, e2) ELSE (n2, e2, n1, e1) END AS k FROM s),
    f AS (SELECT seq, min(seq) OVER (PARTITION BY k) AS first_seq FROM k) SELECT seq, first_seq FROM f WHERE seq > first_seq""",
)
def d20(spark, sf):
    rows = table(spark, sf, "events").selectExpr("event_id AS seq", "event_id % 20 AS n1", "user_id % 15 AS e1", "user_id % 20 AS n2", "event_id % 15 AS e2")
    return surfaces.duplicate_segments(rows)


_EDGES = f"(SELECT a.point_id AS edge_id, 60 + a.label AS score, a.northing AS n1, a.easting AS e1, b.northing AS n2, b.easting AS e2 FROM {PLACES} a JOIN {PLACES} b ON b.point_id = a.point_id + 10 WHERE a.point_id % 2 = 1)"


def _gap(n: str, e: str) -> str:
    """SQL of the distance of a place from the segment s."""
    t = f"greatest(0, least(1, coalesce((({n} - s.n1) * (s.n2 - s.n1) + ({e} - s.e1) * (s.e2 - s.e1)) / nullif((s.n2 - s.n1) ** 2 + (s.e2 - s.e1) ** 2, 0), 0)))"
    return f"sqrt(({n} - s.n1 - {t} * (s.n2 - s.n1)) ** 2 + ({e} - s.e1 - {t} * (s.e2 - s.e1)) ** 2)"


@query(
    "d10_line_support",
    f"""WITH e AS (SELECT * FROM {_EDGES}), s AS (SELECT seq, n1 + 0.5 AS n1, e1 AS e1, n2 AS n2, e2 + 0.5 AS e2 FROM {_SEGMENTS}),
    p AS (SELECT edge_id, {_gap('e.n1', 'e.e1')} + {_gap('e.n2', 'e.e2')} AS gap, degrees(atan2(e.e2 - e.e1, e.n2 - e.n1)) - degrees(atan2(s.e2 - s.e1, s.n2 - s.n1)) + 180 AS turn FROM e JOIN s ON true),
    q AS (SELECT edge_id, gap, abs(turn - 360 * floor(turn / 360) - 180) AS turn FROM p), b AS (SELECT edge_id, max(100 * greatest(0, 1 - gap / 60) * greatest(0, 1 - least(turn, 180 - turn) / 35)) AS support FROM q GROUP BY 1)
    SELECT edge_id, {r('nullif(support, 0)')} AS support, CASE WHEN support > 0 THEN round(least(100, 0.8 * score + 0.2 * support) + 1e-9, 1) ELSE CAST(score AS DOUBLE) END AS combined FROM e JOIN b USING (edge_id)""",
)
def d10(spark, sf):
    p = places(spark, sf)
    edges = p.where("point_id % 2 = 1").selectExpr("point_id AS edge_id", "60 + label AS score", "northing AS n1", "easting AS e1").join(p.selectExpr("point_id - 10 AS edge_id", "northing AS n2", "easting AS e2"), "edge_id")
    shifted = _segments(spark, sf).selectExpr("seq", "n1 + 0.5D AS n1", "e1", "n2", "e2 + 0.5D AS e2")
    return evidence.line_support(edges, shifted)


def _turn(a: str, b: str) -> str:
    return f"abs({a} - {b} + 180 - 360 * floor(({a} - {b} + 180) / 360) - 180)"


_NETWORK = f"""WITH s AS (SELECT s_suppkey AS id, (s_suppkey * 37 % 101) * CAST(7.13 AS DOUBLE) AS n, (s_suppkey * 53 % 97) * CAST(6.71 AS DOUBLE) AS e FROM supplier),
    p AS (SELECT s_suppkey AS id, k AS pipe, CASE WHEN (s_suppkey + k) % 7 <> 0 THEN CAST((s_suppkey * 29 + k * 137) % 360 AS DOUBLE) END AS az, CASE WHEN (s_suppkey + k) % 3 <> 0 THEN CAST((s_suppkey * 31 + k * 139) % 360 AS DOUBLE) END AS lead,
        CASE WHEN (s_suppkey * k) % 13 = 0 THEN 'to ' || (s_suppkey + 1) ELSE 'unknown note' END AS note FROM supplier, (VALUES (1), (2)) v(k)),
    c AS (SELECT p.id AS from_point, pipe, az, lead, coalesce(az, lead) AS dir, t.id AS to_point, sqrt((t.n - s.n) ** 2 + (t.e - s.e) ** 2) AS distance, degrees(atan2(t.e - s.e, t.n - s.n)) AS b FROM p JOIN s ON s.id = p.id JOIN s t ON t.id <> p.id WHERE NOT starts_with(note, 'to ') AND coalesce(az, lead) IS NOT NULL),
    f AS (SELECT *, {_turn('b', 'dir')} AS error FROM c WHERE distance <= 150 AND distance > 0), h AS (SELECT * FROM f WHERE error <= 25),
    q AS (SELECT id, pipe AS to_pipe, coalesce(az, lead) AS back FROM p WHERE coalesce(az, lead) IS NOT NULL),
    g AS (SELECT h.*, {_turn('b + 180', 'back')} AS turned, to_pipe FROM h LEFT JOIN q ON q.id = h.to_point), o AS (SELECT *, row_number() OVER (PARTITION BY from_point, pipe, to_point ORDER BY turned, to_pipe) AS j FROM g),
    x AS (SELECT *, 100 * (0.52 * (1 - error / 25) + 0.33 * coalesce(greatest(0, 1 - turned / 25), 0) + 0.15 * (1 - distance / 150)) AS whole FROM o WHERE j = 1),
    k AS (SELECT *, round(whole + 1e-9, 1) AS score, row_number() OVER (PARTITION BY from_point, pipe ORDER BY round(whole + 1e-9, 1) DESC, to_point) AS rn FROM x)"""


def _pipes(spark, sf):
    s = table(spark, sf, "supplier")
    pipes = s.select(F.col("s_suppkey").alias("point_id"), F.explode(F.array(F.lit(1), F.lit(2))).alias("pipe_index")).selectExpr(
        "point_id", "pipe_index", "CASE WHEN (point_id + pipe_index) % 7 <> 0 THEN CAST((point_id * 29 + pipe_index * 137) % 360 AS DOUBLE) END AS azimuth_deg",
        "CASE WHEN (point_id + pipe_index) % 3 <> 0 THEN CAST((point_id * 31 + pipe_index * 139) % 360 AS DOUBLE) END AS leader_deg",
        "CASE WHEN (point_id * pipe_index) % 13 = 0 THEN concat('to ', point_id + 1) ELSE 'unknown note' END AS connected_raw",
    )
    at = s.selectExpr("s_suppkey AS point_id", "(s_suppkey * 37 % 101) * 7.13D AS northing", "(s_suppkey * 53 % 97) * 6.71D AS easting")
    return pipes, at


@query(
    "d7_network",
    _NETWORK
    + f""" SELECT from_point, pipe AS pipe_index, to_point, to_pipe AS to_pipe_index, {r('distance')} AS distance, {r('turned')} AS reciprocal_error, {r(_turn('b', 'az'))} AS bearing_error, {r(_turn('b', 'lead'))} AS leader_error, {r('score')} AS score,
        CASE WHEN turned > 25 THEN 'REVIEW' WHEN whole >= 78 AND turned IS NOT NULL THEN 'STRONG' ELSE 'SUGGESTED' END AS status FROM k WHERE rn = 1""",
)
def d7(spark, sf):
    return evidence.network_edges(*_pipes(spark, sf), 150.0)


_RATIO = f"(CAST(1 AS DOUBLE) / {FOOT_SQL})"


@query(
    "d11_grades",
    _NETWORK
    + f""", i AS (SELECT id, pipe, CASE WHEN (id + pipe) % 10 <> 0 THEN CAST((id * 13 + pipe * 7) % 50 AS DOUBLE) END AS invert FROM p), j AS (SELECT from_point, k.pipe AS pipe_index, to_point, to_pipe, (a.invert - b.invert) / distance * {_RATIO} * 100 AS grade
        FROM k JOIN i a ON a.id = from_point AND a.pipe = k.pipe JOIN i b ON b.id = to_point AND b.pipe = to_pipe WHERE rn = 1 AND a.invert IS NOT NULL AND b.invert IS NOT NULL)
    SELECT from_point, pipe_index, to_point, to_pipe AS to_pipe_index, {r('grade')} AS grade, CASE WHEN grade > 0 THEN 'from_to' WHEN grade < 0 THEN 'to_from' ELSE 'flat' END AS flow, CASE WHEN grade < 0 THEN 'ADVERSE_GRADE' ELSE '' END AS flag FROM j""",
)
def d11(spark, sf):
    """Inverts in metres, distances in US survey feet."""
    pipes, at = _pipes(spark, sf)
    inverts = pipes.selectExpr("point_id", "pipe_index", "CASE WHEN (point_id + pipe_index) % 10 <> 0 THEN CAST((point_id * 13 + pipe_index * 7) % 50 AS DOUBLE) END AS invert")
    return evidence.pipe_grades(evidence.network_edges(pipes, at, 150.0), inverts, "us_survey_feet", "meters")


@query("j2_level_network")
def j2(spark, sf):
    """One level network for each eight neighbouring suppliers: a ring with chords."""
    points, obs = _rings(spark, sf)
    return networks.adjust_levels(points.withColumn("elevation", F.col("northing") / 10), obs.where("kind = 'distance'").selectExpr("network_id", "ord", "from_id", "to_id", "value / 100 AS delta_elevation", "sigma"))


def _rings(spark, sf):
    return rings(table(spark, sf, "supplier"))


def rings(suppliers):
    """All suppliers in rings of eight neighbours by key: points, and distances to the next three.

    Those that are left at the end join the last ring.  Where keys are sparse a
    ring has fewer points; under three, all are fixed and nothing is to solve.
    """
    from pyspark.sql import Window

    own = Window.partitionBy("network_id")
    last = suppliers.agg(F.greatest(F.floor(F.max("s_suppkey") / 8) - 1, F.lit(0)).alias("last"))
    s = attach(suppliers.select("s_suppkey"), last).withColumn("network_id", F.least(F.floor(F.greatest(F.col("s_suppkey") - 1, F.lit(0)) / 8), F.col("last")))
    s = s.withColumns({"k": F.row_number().over(own.orderBy("s_suppkey")) - 1, "m": F.count(F.lit(1)).over(own)}).where("m > 2")
    s = s.withColumns({"northing": 100 * F.cos(F.radians(F.col("k") * 360 / F.col("m"))) + F.col("network_id") % 9, "easting": 100 * F.sin(F.radians(F.col("k") * 360 / F.col("m")))})
    points = s.selectExpr("network_id", "concat('S', k) AS point_id", "northing", "easting", "k < 2 AS fixed")
    pairs = s.withColumn("d", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3)))).where("d < m").withColumn("other", (F.col("k") + F.col("d")) % F.col("m"))
    pairs = pairs.join(s.selectExpr("network_id", "CAST(k AS BIGINT) AS other", "northing AS n2", "easting AS e2"), ["network_id", "other"])
    obs = pairs.selectExpr("network_id", "CAST(k * 10 + d AS BIGINT) AS ord", "'distance' AS kind", "concat('S', k) AS from_id", "concat('S', other) AS to_id", "'' AS target2_id", "sqrt(pow(n2 - northing, 2) + pow(e2 - easting, 2)) + (k * 7 + d * 3) % 5 * 0.01D + CASE WHEN k = 4 AND d = 2 THEN 1.0D ELSE 0.0D END AS value", "0.02D AS sigma")
    return points, obs


@query("j1_control_network")
def j1(spark, sf):
    return networks.adjust_control(*_rings(spark, sf))


@query("j4_snooping")
def j4(spark, sf):
    """Each ring of five points or more has one distance that is a metre off."""
    return networks.snoop(*_rings(spark, sf))
