"""Queries of the review operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.functions.ids import suggested_role
from plumbline.operators import evidence, reviews
from plumbline.plans.bindings import FOOT, FOOT_SQL, PLACES, places, query, r, table, version_sql, versions

_LISTED = [("604", "Ground shot", "surface"), ("305", "Drop box", "discontinuity"), ("EC", "Edge", "surface")]
_LISTED_SQL = "(VALUES ('604', 'Ground shot', 'surface'), ('305', 'Drop box', 'discontinuity'), ('EC', 'Edge', 'surface')) c(base, description, role)"


@query(
    "c5_code_roles",
    f"""WITH p AS (SELECT p_partkey AS point_id, split_part(upper(CASE WHEN p_partkey % 10 = 3 THEN 'ec' WHEN p_partkey % 10 = 7 THEN '' ELSE CAST(590 + p_partkey % 60 AS VARCHAR) END || '-' || p_size || '-bs'), '-', 1) AS base FROM part)
    SELECT point_id, CASE WHEN p.base = '' THEN '?' ELSE p.base END AS base, coalesce(c.role, CASE WHEN TRY_CAST(p.base AS BIGINT) BETWEEN 600 AND 639 THEN 'structure' ELSE 'unknown' END) AS role,
        coalesce(c.description, CASE WHEN TRY_CAST(p.base AS BIGINT) BETWEEN 600 AND 639 THEN 'Unclassified structure-range code' ELSE 'Review code classification' END) AS description FROM p LEFT JOIN {_LISTED_SQL} ON p.base = c.base""",
)
def c5(spark, sf):
    points = table(spark, sf, "part").selectExpr("p_partkey AS point_id", "concat(CASE WHEN p_partkey % 10 = 3 THEN 'ec' WHEN p_partkey % 10 = 7 THEN '' ELSE CAST(590 + p_partkey % 60 AS STRING) END, '-', p_size, '-bs') AS code")
    return reviews.classify_codes(points, spark.createDataFrame(_LISTED, "code string, description string, role string"))


@query(
    "c4_solver_rows",
    """WITH o AS (SELECT o_custkey AS control_id, o_orderkey AS observation_id, o_orderstatus <> 'P' AS include FROM orders), k AS (SELECT control_id, array_agg(observation_id ORDER BY observation_id DESC) AS ids FROM o WHERE control_id % 3 = 0 GROUP BY 1),
    e AS (SELECT control_id, unnest(ids) AS observation_id, unnest(range(len(ids))) AS position FROM k)
    SELECT o.control_id, o.observation_id, position FROM o JOIN e USING (control_id, observation_id) UNION ALL SELECT control_id, observation_id, NULL FROM o WHERE include AND control_id NOT IN (SELECT control_id FROM k)""",
)
def c4(spark, sf):
    rows = table(spark, sf, "orders").selectExpr("o_custkey AS control_id", "o_orderkey AS observation_id", "o_orderstatus <> 'P' AS include")
    picks = rows.where("control_id % 3 = 0").groupBy("control_id").agg(F.sort_array(F.collect_list("observation_id"), asc=False).alias("observation_ids"))
    return reviews.solver_rows(rows, picks).drop("include")


_PRIOR = "(SELECT c_custkey, c_name, CASE WHEN c_custkey % 3 = 0 THEN NULL WHEN c_custkey % 3 = 1 THEN '' ELSE c_mktsegment END AS fix_type, CASE WHEN c_custkey % 2 = 0 THEN 0 ELSE c_nationkey END AS epochs FROM customer)"


@query(
    "d3_fill_metadata",
    f"""WITH n AS (SELECT o_custkey, o_orderstatus AS fix_type, CAST(o_orderkey % 50 AS INTEGER) AS epochs FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) = 1),
    j AS (SELECT c.*, n.o_custkey IS NOT NULL AS has, n.fix_type AS f, n.epochs AS e, coalesce(c.fix_type, '') = '' AND n.o_custkey IS NOT NULL AS gf, coalesce(c.epochs, 0) = 0 AND n.o_custkey IS NOT NULL AS ge FROM {_PRIOR} c LEFT JOIN n ON o_custkey = c_custkey)
    SELECT c_name AS point_id, CASE WHEN gf THEN f ELSE fix_type END AS fix_type, CASE WHEN ge THEN e ELSE epochs END AS epochs, concat_ws(',', CASE WHEN gf THEN 'fix_type' END, CASE WHEN ge THEN 'epochs' END) AS filled FROM j""",
)
def d3(spark, sf):
    prior = table(spark, sf, "customer").selectExpr("c_name AS point_id", "CASE WHEN c_custkey % 3 = 0 THEN NULL WHEN c_custkey % 3 = 1 THEN '' ELSE c_mktsegment END AS fix_type", "CAST(CASE WHEN c_custkey % 2 = 0 THEN 0 ELSE c_nationkey END AS INT) AS epochs")
    incoming = table(spark, sf, "orders").selectExpr("concat('CUSTOMER#', lpad(o_custkey, 9, '0')) AS point_id", "o_orderkey AS seq", "o_orderstatus AS fix_type", "CAST(o_orderkey % 50 AS INT) AS epochs")
    return reviews.fill_metadata(prior, incoming, "point_id", "seq", "fix_type", "epochs").withColumn("filled", F.array_join("filled", ","))


_RECORDS = "(SELECT user_id, event_id, CASE WHEN event_id % 3 = 0 THEN NULL WHEN event_id % 3 = 1 THEN '' ELSE event_type END AS fix_type, CASE WHEN event_id % 4 > 0 THEN event_id % 17 END AS satellites, value AS pdop FROM events)"


@query("k7_occupations", f"SELECT user_id, arg_min(fix_type, event_id) FILTER (fix_type <> '') AS fix_type, max(satellites) AS satellites, {r('max(pdop)')} AS pdop FROM {_RECORDS} GROUP BY 1")
def k7(spark, sf):
    rows = table(spark, sf, "events").selectExpr("user_id", "event_id", "CASE WHEN event_id % 3 = 0 THEN NULL WHEN event_id % 3 = 1 THEN '' ELSE event_type END AS fix_type", "CASE WHEN event_id % 4 > 0 THEN event_id % 17 END AS satellites", "value AS pdop")
    return reviews.merge_occupations(rows, "user_id", "event_id", ("fix_type",), ("satellites", "pdop"))


@query(
    "d16_photo_ids",
    """WITH f AS (SELECT DISTINCT 'photos/' || (o_custkey % 7) || '/IMG_' || o_custkey || CASE WHEN o_orderkey % 3 = 0 THEN '-' || (o_custkey + 5000) WHEN o_orderkey % 3 = 1 THEN '_' || (o_custkey + 1) ELSE '' END || '.7.jpg' AS path FROM orders),
    t AS (SELECT DISTINCT path, unnest(string_split_regex(regexp_replace(regexp_extract(path, '([^/]*)$', 1), '(.)\\.[^.]*$', '\\1'), '[^0-9]+')) AS id FROM f), w AS (SELECT DISTINCT CAST(c_custkey AS VARCHAR) AS id FROM customer WHERE c_custkey > 9),
    h AS (SELECT path, count(*) AS n, min(id) AS id FROM t JOIN w USING (id) GROUP BY 1)
    SELECT path, CASE WHEN n = 1 THEN id END AS point_id, coalesce(n, 0) AS n_hits, CASE WHEN n IS NULL THEN 'unmatched' WHEN n = 1 THEN 'matched' ELSE 'ambiguous' END AS status FROM f LEFT JOIN h USING (path)""".replace("\\\\", "\\"),
)
def d16(spark, sf):
    files = table(spark, sf, "orders").selectExpr("concat('photos/', o_custkey % 7, '/IMG_', o_custkey, CASE WHEN o_orderkey % 3 = 0 THEN concat('-', o_custkey + 5000) WHEN o_orderkey % 3 = 1 THEN concat('_', o_custkey + 1) ELSE '' END, '.7.jpg') AS path")
    return reviews.photo_matches(files, table(spark, sf, "customer").where("c_custkey > 9").selectExpr("c_custkey AS point_id"))


@query(
    "d24_snapshot_counts",
    """WITH a AS (SELECT event_type AS metric, count(*) AS n FROM events WHERE event_id % 5 > 0 AND event_type <> 'click' GROUP BY 1), b AS (SELECT event_type AS metric, count(*) AS n FROM events WHERE event_type <> 'view' GROUP BY 1)
    SELECT metric, coalesce(a.n, 0) AS snapshot, coalesce(b.n, 0) AS current, coalesce(b.n, 0) - coalesce(a.n, 0) AS delta FROM a FULL JOIN b USING (metric)""",
)
def d24(spark, sf):
    counts = lambda where: table(spark, sf, "events").where(where).groupBy(F.col("event_type").alias("metric")).agg(F.count(F.lit(1)).alias("n"))
    return reviews.compare_counts(counts("event_id % 5 > 0 AND event_type <> 'click'"), counts("event_type <> 'view'"))


_ENTITY = "point_id || CASE WHEN point_id % 9 = 2 THEN '/1' ELSE '' END"


@query(
    "d27_drawing_diff",
    f"""WITH a AS (SELECT {_ENTITY} AS entity_id, round(northing, 6) AS northing, description FROM {version_sql(False)}), b AS (SELECT {_ENTITY} AS entity_id, round(northing, 6) AS northing, description FROM {version_sql(True)})
    SELECT coalesce(a.entity_id, b.entity_id) AS entity_id, CASE WHEN a.entity_id IS NULL THEN 'after_only' WHEN b.entity_id IS NULL THEN 'before_only' WHEN a.northing IS NOT DISTINCT FROM b.northing AND a.description IS NOT DISTINCT FROM b.description THEN 'unchanged' ELSE 'changed_candidate' END AS kind
    FROM (SELECT * FROM a WHERE NOT contains(entity_id, '/')) a FULL JOIN (SELECT * FROM b WHERE NOT contains(entity_id, '/')) b ON a.entity_id = b.entity_id
    UNION ALL SELECT entity_id, 'before_only' FROM a WHERE contains(entity_id, '/') UNION ALL SELECT entity_id, 'after_only' FROM b WHERE contains(entity_id, '/')""",
)
def d27(spark, sf):
    entities = lambda second: versions(spark, sf, second).selectExpr("concat(point_id, CASE WHEN point_id % 9 = 2 THEN '/1' ELSE '' END) AS entity_id", "round(northing, 6) AS northing", "description")
    return reviews.drawing_diff(entities(False), entities(True), "northing", "description")


@query(
    "d28_verified_rows",
    """SELECT l_orderkey AS source_id, l_partkey AS point_id, l_linenumber AS line FROM lineitem l JOIN orders ON l_orderkey = o_orderkey AND o_orderkey % 4 <> 0
    WHERE EXISTS (SELECT 1 FROM lineitem p WHERE p.l_orderkey = l.l_orderkey AND p.l_partkey = l.l_partkey AND p.l_linenumber % 2 = 1)""",
)
def d28(spark, sf):
    rows = table(spark, sf, "lineitem").selectExpr("l_orderkey AS source_id", "l_partkey AS point_id", "l_linenumber AS line")
    sources = table(spark, sf, "orders").selectExpr("o_orderkey AS source_id", "sha2(CAST(IF(o_orderkey % 4 = 0, -1, o_orderkey) AS STRING), 256) AS sha256")
    points = rows.where("line % 2 = 1").selectExpr("point_id", "source_id", "sha2(CAST(source_id AS STRING), 256) AS source_hash")
    return reviews.verified_rows(points, sources, rows)


@query(
    "d14_evidence_links",
    f"""WITH p AS (SELECT point_id, label, {r('northing')} AS n, {r('easting')} AS e, CASE WHEN point_id % 3 > 0 THEN {r('elevation')} END AS z FROM {PLACES})
    SELECT a.point_id AS candidate_id, 'u' || b.point_id AS point_uuid FROM p a JOIN p b ON a.label IS NOT DISTINCT FROM b.label AND a.point_id IS NOT DISTINCT FROM b.point_id AND a.n IS NOT DISTINCT FROM b.n AND a.e IS NOT DISTINCT FROM b.e AND a.z IS NOT DISTINCT FROM b.z WHERE a.point_id % 2 = 0""",
)
def d14(spark, sf):
    rows = places(spark, sf).selectExpr("point_id", "label AS source_hash", "round(northing, 4) AS northing", "round(easting, 4) AS easting", "CASE WHEN point_id % 3 > 0 THEN round(elevation, 4) END AS elevation")
    return reviews.evidence_links(rows.where("point_id % 2 = 0").withColumnRenamed("point_id", "candidate_id").withColumn("point_id", F.col("candidate_id")), rows.withColumn("point_uuid", F.concat(F.lit("u"), "point_id")))


_VERTICES = f"(SELECT user_id AS line_id, event_id AS seq, value * {FOOT_SQL} AS northing, (value % 13) * {FOOT_SQL} AS easting FROM events)"


def _vertices(spark, sf):
    return table(spark, sf, "events").selectExpr("user_id AS line_id", "event_id AS seq", f"value * {FOOT} AS northing", f"(value % 13) * {FOOT} AS easting")


@query(
    "d29_line_segments",
    f"""SELECT line_id, seq, {r('northing')} AS n1, {r('easting')} AS e1, {r('n2')} AS n2, {r('e2')} AS e2 FROM (SELECT *, lead(northing) OVER w AS n2, lead(easting) OVER w AS e2 FROM {_VERTICES} WINDOW w AS (PARTITION BY line_id ORDER BY seq)) WHERE n2 IS NOT NULL""",
)
def d29(spark, sf):
    return reviews.line_segments(_vertices(spark, sf))


@query(
    "i58_decimated",
    f"""WITH v AS (SELECT *, row_number() OVER (PARTITION BY line_id ORDER BY seq) - 1 AS ix, count(*) OVER (PARTITION BY line_id) AS n FROM {_VERTICES}), k AS (SELECT *, ix % CAST(ceil(n / 20) AS BIGINT) = 0 AS kept FROM v),
    b AS (SELECT *, last_value(CASE WHEN kept THEN {{'n': northing, 'e': easting}} END IGNORE NULLS) OVER (PARTITION BY line_id ORDER BY seq) AS p FROM k)
    SELECT line_id, seq, {r('northing')} AS northing, {r('easting')} AS easting FROM b WHERE kept OR (ix = n - 1 AND (northing <> p.n OR easting <> p.e))""",
)
def i58(spark, sf):
    return reviews.decimated(_vertices(spark, sf), 20)


@query(
    "d18_endpoint_gaps",
    f"""SELECT a.point_id AS end_a, b.point_id AS end_b, {r('d')} AS gap, d <= 9 AS within FROM {PLACES} a JOIN {PLACES} b ON a.point_id < b.point_id, LATERAL (SELECT sqrt((a.northing - b.northing) ** 2 + (a.easting - b.easting) ** 2) AS d) WHERE d > 0 AND d <= 15""",
)
def d18(spark, sf):
    return reviews.endpoint_gaps(places(spark, sf).withColumnRenamed("point_id", "end_id"), 15.0, 9.0)


@query(
    "e32_first_unmatched",
    """SELECT event_id, user_id AS page_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id, CASE WHEN event_id % 2 = 0 THEN '' ELSE event_type END, CAST(value * 100 AS BIGINT) % 20, event_type ORDER BY event_id) = 1""",
)
def e32(spark, sf):
    items = table(spark, sf, "events").selectExpr("event_id", "user_id AS page_id", "CASE WHEN event_id % 2 = 0 THEN NULL ELSE event_type END AS point_id_raw", "CAST(round(value * 100) AS BIGINT) % 20 / 20.0D AS confidence", "event_type AS reason", "array(0, 1) AS bbox")
    return reviews.first_unmatched(items, "event_id").select("event_id", "page_id")


@query(
    "e34_truth_records",
    """SELECT point_id, string_agg(t, ';' ORDER BY l_linenumber, l_partkey, t) AS pipes FROM (SELECT l_orderkey AS point_id, l_linenumber, l_partkey, printf('%.2f', l_quantity + 0.001) || '/' || CASE WHEN l_linenumber % 3 = 0 THEN '-' ELSE printf('%.3f', l_tax + 0.0001) END || '/' || printf('%.1f', (l_partkey * 7 + 0.03) % 360) AS t FROM lineitem WHERE l_orderkey % 2 = 0) GROUP BY 1""",
)
def e34(spark, sf):
    pipes = table(spark, sf, "lineitem").where("l_orderkey % 2 = 0").selectExpr("l_orderkey AS point_id", "struct(l_linenumber, l_partkey) AS pipe_no", "l_quantity + 0.001D AS diameter", "CASE WHEN l_linenumber % 3 > 0 THEN l_tax + 0.0001D END AS dip", "l_partkey * 7 + 0.03D - 360 AS azimuth")
    return reviews.truth_records(pipes)


@query(
    "k9_pending_union",
    """SELECT o_custkey AS point_id, o_orderstatus AS status FROM orders WHERE o_custkey % 3 = 0 UNION ALL SELECT DISTINCT o_custkey, 'PENDING' FROM orders WHERE o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey % 3 = 0)""",
)
def k9(spark, sf):
    rows = table(spark, sf, "orders").selectExpr("o_custkey AS point_id", "o_orderstatus AS status")
    return reviews.pending_union(rows.where("point_id % 3 = 0"), rows)


@query(
    "k10_point_states",
    """SELECT c_custkey AS point_id, CASE WHEN EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F') THEN 'INTERPRETED' WHEN EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey) THEN 'OCR_FOUND' ELSE 'PENDING_OCR' END AS state FROM customer""",
)
def k10(spark, sf):
    orders = table(spark, sf, "orders").selectExpr("o_custkey AS point_id", "o_orderstatus")
    return reviews.point_states(table(spark, sf, "customer").selectExpr("c_custkey AS point_id"), orders.where("o_orderstatus = 'F'"), orders)


@query(
    "l5_supersede",
    """SELECT p_partkey AS issue_id, p_type AS module, p_brand AS code, CASE WHEN p_type = 'ECONOMY' AND p_partkey % 2 = 0 AND p_brand ILIKE 'brand#1%' THEN 'SUPERSEDED' WHEN p_partkey % 2 = 0 THEN 'OPEN' ELSE 'CLOSED' END AS status FROM part""",
)
def l5(spark, sf):
    return reviews.supersede(table(spark, sf, "part").selectExpr("p_partkey AS issue_id", "p_type AS module", "p_brand AS code", "IF(p_partkey % 2 = 0, 'OPEN', 'CLOSED') AS status"), "ECONOMY", "brand#1")


@query(
    "l12_returned_deltas",
    f"""WITH q AS (SELECT o_custkey AS request_id, o_orderkey AS point_id, o_totalprice * {FOOT_SQL} AS northing, CAST(o_custkey AS DOUBLE) AS easting FROM orders), b AS (SELECT l_orderkey AS point_id, l_extendedprice * {FOOT_SQL} AS n FROM lineitem WHERE l_orderkey % 5 > 0 QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber * 100000 + l_partkey, l_extendedprice) = 1),
    j AS (SELECT q.*, b.n - q.northing AS d, b.n IS NOT NULL AS returned FROM q LEFT JOIN b USING (point_id))
    SELECT request_id, point_id, {r('d')} AS d_northing, CAST(NULL AS DOUBLE) AS d_easting, CAST(NULL AS DOUBLE) AS d_elevation, returned, CASE WHEN bool_and(returned) OVER (PARTITION BY request_id) THEN 'returned' ELSE 'open' END AS status FROM j""",
)
def l12(spark, sf):
    requested = table(spark, sf, "orders").selectExpr("o_custkey AS request_id", "o_orderkey AS point_id", f"o_totalprice * {FOOT} AS northing", "CAST(o_custkey AS DOUBLE) AS easting", "CAST(NULL AS DOUBLE) AS elevation")
    returned = table(spark, sf, "lineitem").where("l_orderkey % 5 > 0").selectExpr("l_orderkey AS point_id", "l_linenumber * 100000 + l_partkey AS seq", f"l_extendedprice * {FOOT} AS northing", "CAST('NaN' AS DOUBLE) AS easting", "1.0D AS elevation")
    returned = returned.join(requested.select("request_id", "point_id"), "point_id")
    return reviews.returned_deltas(requested, returned)


_NOTED = f"""(SELECT point_id, CAST(1 AS INTEGER) AS pipe_index, CASE WHEN CAST(substr(point_id, 2) AS BIGINT) % 4 > 0 THEN azimuth END AS azimuth_deg, CASE WHEN CAST(substr(point_id, 2) AS BIGINT) % 5 = 0 THEN azimuth + 20 END AS leader_deg,
    CASE CAST(substr(point_id, 2) AS BIGINT) % 7 WHEN 0 THEN NULL WHEN 1 THEN point_id WHEN 2 THEN 'x99' ELSE lower('P') || (CAST(substr(point_id, 2) AS BIGINT) + 3) END AS ref FROM (SELECT 'P' || point_id AS point_id, abs(elevation) * 9 AS azimuth FROM {PLACES}))"""


@query(
    "d6_explicit_edges",
    f"""WITH s AS (SELECT 'P' || point_id AS point_id, CASE WHEN point_id % 11 > 0 THEN northing END AS northing, easting FROM {PLACES}), p AS (SELECT * FROM {_NOTED}),
    f AS (SELECT p.*, coalesce(x.point_id, y.point_id) AS to_point FROM p LEFT JOIN s x ON x.point_id = ref LEFT JOIN s y ON lower(y.point_id) = lower(ref) WHERE ref IS NOT NULL),
    d AS (SELECT f.*, sqrt((b.northing - a.northing) ** 2 + (b.easting - a.easting) ** 2) AS distance, (degrees(atan2(b.easting - a.easting, b.northing - a.northing)) + 360) % 360 AS bearing FROM f JOIN s a ON a.point_id = f.point_id LEFT JOIN s b ON b.point_id = f.to_point),
    e AS (SELECT d.*, abs((bearing - d.azimuth_deg + 180 + 720) % 360 - 180) AS bearing_error, abs((bearing - d.leader_deg + 180 + 720) % 360 - 180) AS leader_error, abs((bearing + 180 - coalesce(q.azimuth_deg, q.leader_deg) + 180 + 720) % 360 - 180) AS reciprocal_error FROM d LEFT JOIN p q ON q.point_id = d.to_point),
    t AS (SELECT *, CASE WHEN to_point IS NULL THEN 'MISSING' WHEN to_point = point_id THEN 'SELF' WHEN coalesce(bearing_error > 60, false) OR coalesce(leader_error > 60, false) OR coalesce(reciprocal_error > 90, false) OR coalesce(distance > 900, false) THEN 'REVIEW' ELSE 'STRONG' END AS status FROM e)
    SELECT point_id AS from_point, pipe_index, ref, to_point, CASE WHEN status IN ('REVIEW', 'STRONG') THEN {r('distance')} END AS distance, CASE WHEN status IN ('REVIEW', 'STRONG') THEN {r('bearing_error')} END AS bearing_error, CASE WHEN status IN ('REVIEW', 'STRONG') THEN {r('reciprocal_error')} END AS reciprocal_error,
        CASE status WHEN 'REVIEW' THEN 65.0 WHEN 'STRONG' THEN CASE WHEN bearing IS NULL THEN 85.0 ELSE 95.0 END END AS score, status FROM t""",
)
def d6(spark, sf):
    rows = places(spark, sf).selectExpr("point_id AS n", "concat('P', point_id) AS point_id", "CASE WHEN point_id % 11 > 0 THEN northing END AS northing", "easting", "abs(elevation) * 9 AS azimuth")
    pipes = rows.selectExpr(
        "point_id", "1 AS pipe_index", "CASE WHEN n % 4 > 0 THEN azimuth END AS azimuth_deg", "CASE WHEN n % 5 = 0 THEN azimuth + 20 END AS leader_deg",
        "CASE n % 7 WHEN 0 THEN NULL WHEN 1 THEN concat('to ', point_id) WHEN 2 THEN 'Pt# x99' ELSE concat('p', n + 3) END AS connected_raw",
    )
    return evidence.explicit_edges(pipes, rows, 900.0, 60.0, 90.0)


@query(
    "i6_suggested_roles",
    """SELECT p_partkey, CASE WHEN regexp_matches(t, 'wall|barrier|headwall|wingwall|inlet|manhole|catch basin|drop box|curb') THEN 'discontinuity' WHEN contains(t, 'ditch') THEN 'ditch' WHEN regexp_matches(t, 'creek|stream|channel') THEN 'creek' WHEN regexp_matches(t, 'backsight|setup|control point') THEN 'setup'
        WHEN regexp_matches(t, 'ground shot|pavement|shoulder|stripe|centerline|surface edge|breakline|gutter') THEN 'surface' WHEN regexp_matches(t, 'pole|sign|meter|junction|splice') THEN 'support' ELSE 'unknown' END AS role
    FROM (SELECT p_partkey, lower(p_name || CASE p_partkey % 8 WHEN 0 THEN ' Wall' WHEN 1 THEN ' Ditch' WHEN 2 THEN ' Channel' WHEN 3 THEN ' SETUP' WHEN 4 THEN ' Gutter' WHEN 5 THEN ' Sign at wall' WHEN 6 THEN ' pole' ELSE '' END) AS t FROM part)""",
)
def i6(spark, sf):
    parts = table(spark, sf, "part").selectExpr("p_partkey", "concat(p_name, CASE p_partkey % 8 WHEN 0 THEN ' Wall' WHEN 1 THEN ' Ditch' WHEN 2 THEN ' Channel' WHEN 3 THEN ' SETUP' WHEN 4 THEN ' Gutter' WHEN 5 THEN ' Sign at wall' WHEN 6 THEN ' pole' ELSE '' END) AS t")
    return parts.select("p_partkey", suggested_role(F.col("t")).alias("role"))
