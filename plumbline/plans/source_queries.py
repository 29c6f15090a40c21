"""Queries of drawings, file pairs, and other operators that came with sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.operators import drawings, pairing, redaction, reference_networks
from plumbline.plans.bindings import query, r, table
from plumbline.sources import geometry, tables

_TURN = "radians(30.0 * ({0} % 12))"


def _nested(spark, sf):
    """Regions as drawings: their modelspace places a block of the region, that places a block for each nation, which has a point for each of its suppliers."""
    nation, supplier = table(spark, sf, "nation"), table(spark, sf, "supplier")
    path = "concat('region ', n_regionkey) AS path"
    shape = ["CAST(NULL AS ARRAY<DOUBLE>) AS xs", "CAST(NULL AS ARRAY<DOUBLE>) AS ys", "CAST(NULL AS ARRAY<DOUBLE>) AS zs", "false AS closed", "false AS curved", "'' AS text"]
    array = ["1 AS columns", "1 AS rows", "0.0D AS dx", "0.0D AS dy"]
    place = lambda x, y: f"named_struct('x', {x}, 'y', {y}, 'z', 0.0D) AS place"
    factor = lambda x, y: f"named_struct('x', {x}, 'y', {y}, 'z', 1.0D) AS factor"
    region = nation.select("n_regionkey").distinct().selectExpr(
        path, "CAST(NULL AS STRING) AS block", "CAST(n_regionkey AS BIGINT) AS seq", "concat('R', n_regionkey) AS handle", "'INSERT' AS kind", "'top' AS layer", *shape, "'whole' AS name",
        place("10000.0D * n_regionkey", "500.0D"), factor("2.0D", "-2.0D"), "15.0D * n_regionkey AS rotation", *array,
    )
    ranked = nation.withColumn("seq", F.expr("row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1L"))
    inner = ranked.selectExpr(
        path, "'whole' AS block", "seq", "CAST(NULL AS STRING) AS handle", "'INSERT' AS kind", "'0' AS layer", *shape, "concat('nation ', n_nationkey) AS name",
        place("100.0D * n_nationkey", "50.0D * (n_nationkey % 4)"), factor("1.0D + n_nationkey % 3", "1.0D"), "30.0D * (n_nationkey % 12) AS rotation", *array,
    )
    points = supplier.join(nation, F.col("s_nationkey") == F.col("n_nationkey")).withColumn("seq", F.expr("row_number() OVER (PARTITION BY n_nationkey ORDER BY s_suppkey) - 1L")).selectExpr(
        path, "concat('nation ', n_nationkey) AS block", "seq", "CAST(NULL AS STRING) AS handle", "'POINT' AS kind", "CASE WHEN s_suppkey % 2 = 0 THEN '0' ELSE 'own' END AS layer",
        "array(CAST(s_suppkey % 97 AS DOUBLE)) AS xs", "array(CAST(s_suppkey % 89 AS DOUBLE)) AS ys", "array(s_acctbal) AS zs", "false AS closed", "false AS curved", "'' AS text", "CAST(NULL AS STRING) AS name",
        "CAST(NULL AS STRUCT<x: DOUBLE, y: DOUBLE, z: DOUBLE>) AS place", "CAST(NULL AS STRUCT<x: DOUBLE, y: DOUBLE, z: DOUBLE>) AS factor", "CAST(NULL AS DOUBLE) AS rotation", *array,
    )
    base = lambda x, y: f"named_struct('x', {x}, 'y', {y}, 'z', 0.0D) AS base"
    blocks = nation.selectExpr(path, "concat('nation ', n_nationkey) AS block", base("CAST(n_nationkey % 5 AS DOUBLE)", "1.0D"), "false AS external")
    blocks = blocks.unionByName(nation.select("n_regionkey").distinct().selectExpr(path, "'whole' AS block", base("0.0D", "0.0D"), "false AS external"))
    return region.unionByName(inner).unionByName(points), blocks


@query(
    "a17_block_references",
    f"""WITH n AS (SELECT *, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS nth FROM nation),
    s AS (SELECT n.*, s_suppkey, s_acctbal, row_number() OVER (PARTITION BY n_nationkey ORDER BY s_suppkey) - 1 AS sth, radians(CAST(30 * (n_nationkey % 12) AS DOUBLE)) AS a, radians(CAST(15 * n_regionkey AS DOUBLE)) AS b,
        (1 + n_nationkey % 3) * (s_suppkey % 97 - n_nationkey % 5) AS u, s_suppkey % 89 - 1 AS v FROM supplier JOIN n ON s_nationkey = n_nationkey),
    m AS (SELECT *, 100 * n_nationkey + cos(a) * u - sin(a) * v AS x1, 50 * (n_nationkey % 4) + sin(a) * u + cos(a) * v AS y1 FROM s)
    SELECT 'region ' || n_regionkey AS path, 'R' || n_regionkey || '/0/' || nth || '/0/' || sth AS entity_id, CASE WHEN s_suppkey % 2 = 0 THEN 'top' ELSE 'own' END AS layer, 'whole/nation ' || n_nationkey AS blocks,
        {r('10000 * n_regionkey + cos(b) * 2 * x1 + sin(b) * 2 * y1')} AS x, {r('500 + sin(b) * 2 * x1 - cos(b) * 2 * y1')} AS y, {r('s_acctbal')} AS z FROM m""",
)
def a17(spark, sf):
    entities, _ = drawings.modelspace(*_nested(spark, sf))
    return entities.select("path", "entity_id", "layer", F.array_join("block_path", "/").alias("blocks"), F.col("xs")[0].alias("x"), F.col("ys")[0].alias("y"), F.col("zs")[0].alias("z"))


#: A word of three letters from a number: it is rare, as the name of a street or client is.
_WORD = "concat(char(97 + {0} % 26), char(97 + {0} div 26 % 26), char(97 + {0} div 676 % 26), 'ton')"


@query("d17_file_pairs")
def d17(spark, sf):
    """Survey files of customers and field books of the same jobs, some with other words, letters or numbers."""
    customer = table(spark, sf, "customer")
    word, near = _WORD.format("(c_custkey * 7919)"), _WORD.format("(c_custkey * 7919 + 26 * (c_custkey % 7))")
    surveys = customer.selectExpr(f"concat('Survey_', {word}, '-', 10000 + c_custkey, '_points.csv') AS name", "c_custkey AS seq")
    books = customer.selectExpr(
        f"""CASE c_custkey % 5 WHEN 0 THEN concat('fieldbook ', {word}, ' ', 10000 + c_custkey, ' p', c_custkey % 9, '.pdf') WHEN 1 THEN concat({near}, '_', 10000 + c_custkey, '.jpg')
            WHEN 2 THEN concat({word}, ' east fieldbook.pdf') WHEN 3 THEN concat({word}, '-', 10001 + c_custkey, '.pdf') ELSE concat('scan', c_custkey, '.pdf') END AS name""",
        "c_custkey AS seq",
    )
    return pairing.pair_files(surveys, books)


@query(
    "a18_geometry_blobs",
    f"""WITH s AS (SELECT s_nationkey, s_suppkey % 97 AS x, s_suppkey % 89 AS y, s_acctbal AS z FROM supplier)
    SELECT s_nationkey AS nation, CASE s_nationkey % 3 WHEN 0 THEN 'MultiPoint' WHEN 1 THEN 'LineString' ELSE 'MultiLineString' END AS kind, count(*) AS vertices, {r('sum(CAST(x AS DOUBLE))')} AS sum_x, {r('sum(CAST(y AS DOUBLE))')} AS sum_y,
        CASE WHEN s_nationkey % 2 = 0 THEN {r('sum(z)')} END AS sum_z, 2263 AS srs_id, CAST(NULL AS VARCHAR) AS fault FROM s GROUP BY s_nationkey""",
)
def a18(spark, sf):
    """Suppliers of a nation as one geometry, written as a GeoPackage blob and read back."""
    rows = table(spark, sf, "supplier").selectExpr("s_nationkey AS nation", "CAST(s_suppkey % 97 AS DOUBLE) AS x", "CAST(s_suppkey % 89 AS DOUBLE) AS y", "s_acctbal AS z", "s_suppkey")
    listed = rows.groupBy("nation").agg(F.array_sort(F.collect_list(F.struct("s_suppkey", "x", "y", "z"))).alias("p"))
    n = F.size("p")
    every, all_of, halves = F.sequence(F.lit(1), n), F.array(n), F.when(n > 1, F.array((n / 2).cast("int"), n)).otherwise(F.array(n))
    which = F.col("nation") % 3
    rings = F.when(which == 0, every).when(which == 1, all_of).otherwise(halves)
    shapes = listed.select(
        "nation", F.when(which == 0, "MultiPoint").when(which == 1, "LineString").otherwise("MultiLineString").alias("kind"), F.col("p.x").alias("xs"), F.col("p.y").alias("ys"),
        F.when(F.col("nation") % 2 == 0, F.col("p.z")).alias("zs"), rings.alias("rings"), F.when(which == 1, F.array(F.lit(1))).otherwise(F.sequence(F.lit(1), F.size(rings))).alias("parts"),
    )
    read = geometry.geometries(geometry.encoded(shapes, ["nation"], ">", 2263), "blob")
    add = lambda c: F.aggregate(c, F.lit(0.0), lambda a, v: a + v)
    return read.select("nation", "kind", F.size("xs").cast("long").alias("vertices"), add("xs").alias("sum_x"), add("ys").alias("sum_y"), add("zs").alias("sum_z"), "srs_id", "fault")


@query(
    "j3_solver_comparison",
    """WITH m AS (SELECT greatest(max(s_suppkey) // 8 - 1, 0) AS last FROM supplier), s AS (SELECT least(greatest(s_suppkey - 1, 0) // 8, last) AS network_id FROM supplier, m)
    SELECT CAST(network_id AS BIGINT) AS network_id, true AS converged, true AS reference_converged, 'PASS' AS status FROM s GROUP BY network_id HAVING count(*) > 2""",
)
def j3(spark, sf):
    """Both adjustments of every ring agree."""
    from plumbline.plans.surface_queries import _rings

    rows = reference_networks.compare_adjustments(*_rings(spark, sf))
    return rows.select(F.col("network_id").cast("long").alias("network_id"), "converged", "reference_converged", "status")


@query("j3_reference_adjustment")
def j3_reference(spark, sf):
    from plumbline.plans.surface_queries import _rings

    return reference_networks.adjust_control(*_rings(spark, sf))


@query(
    "i11_redaction",
    """SELECT event_id, '{"detail":{"apiKey":"<redacted>","list":[{"Password":"<redacted>","kind":"' || event_type || '"},[' || CAST(user_id AS VARCHAR) || ',null]]},"token":"<redacted>","user":' || CAST(user_id AS VARCHAR) || '}' AS body FROM events""",
)
def i11(spark, sf):
    """Events as nested JSON, with hidden values at three depths."""
    body = """concat('{"user": ', user_id, ', "token": {"x": [', event_id, ']}, "detail": {"apiKey": "k', event_id, '", "list": [{"kind": "', event_type, '", "Password": ', value, '}, [', user_id, ', null]]}}') AS body"""
    return redaction.redact(table(spark, sf, "events").selectExpr("event_id", body), "event_id", "body")


_STAGED_SQL = """w AS (SELECT o_orderkey AS seq, CASE WHEN o_orderkey % 23 = 0 THEN '' ELSE CAST(o_custkey AS VARCHAR) END AS point_id, o_totalprice AS northing, CASE WHEN o_orderkey % 19 <> 0 THEN o_totalprice / 2 END AS easting FROM orders),
    v AS (SELECT *, point_id = '' OR easting IS NULL AS invalid FROM w), f AS (SELECT *, min(CASE WHEN NOT invalid THEN seq END) OVER (PARTITION BY point_id) AS first FROM v),
    s AS (SELECT seq, nullif(point_id, '') AS point_id, northing, CASE WHEN invalid THEN 'INVALID' WHEN seq > first THEN 'DUPLICATE' ELSE 'VALID' END AS status FROM f), x AS (SELECT CAST(c_custkey AS VARCHAR) AS point_id FROM customer WHERE c_acctbal < 0)"""


def _staged(spark, sf):
    rows = table(spark, sf, "orders").selectExpr("o_orderkey AS seq", "CASE WHEN o_orderkey % 23 = 0 THEN ' ' ELSE concat(' ', o_custkey) END AS point_id", "o_totalprice AS northing", "CASE WHEN o_orderkey % 19 <> 0 THEN o_totalprice / 2 END AS easting")
    return table(spark, sf, "customer").where("c_acctbal < 0").selectExpr("c_custkey AS point_id"), tables.staged(rows, "seq")


@query("a3_commit", f"WITH {_STAGED_SQL} SELECT point_id, seq, {r('northing')} AS northing FROM s WHERE status = 'VALID' AND point_id NOT IN (SELECT point_id FROM x)")
def a3(spark, sf):
    """Orders as staged points of their customers: the first of each goes in, unless the customer owes money (exists already)."""
    return tables.commit_staged(*_staged(spark, sf)).select("point_id", "seq", "northing")


@query("a3_conflicts", f"WITH {_STAGED_SQL} SELECT point_id, count(*) AS rows FROM s WHERE status <> 'INVALID' AND (status = 'DUPLICATE' OR point_id IN (SELECT point_id FROM x)) GROUP BY 1")
def a3_conflicts(spark, sf):
    return tables.commit_conflicts(*_staged(spark, sf))


@query(
    "a3_summary",
    f"""WITH {_STAGED_SQL}, t AS (SELECT *, point_id IN (SELECT point_id FROM x) AS there FROM s)
    SELECT count(*) FILTER (status = 'VALID' AND NOT there) AS inserted, count(DISTINCT CASE WHEN status <> 'INVALID' AND (there OR status = 'DUPLICATE') THEN point_id END) AS conflicts, count(*) FILTER (status = 'INVALID') AS skipped, 'COMMITTED_WITH_REVIEW' AS status FROM t""",
)
def a3_summary(spark, sf):
    return tables.commit_summary(*_staged(spark, sf))
