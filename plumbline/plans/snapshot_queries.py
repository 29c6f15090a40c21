"""Queries of the operators on project states."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.operators import snapshots
from plumbline.plans.bindings import FOOT, FOOT_SQL, query, r, table

_POINTS = f"""(SELECT o_orderkey AS seq, o_orderkey AS point_uuid, CASE WHEN o_orderkey % 10 < 3 THEN o_orderkey - o_orderkey % 10 ELSE o_orderkey END AS point_id, CAST(o_custkey % 40 AS VARCHAR) AS source_id, CASE WHEN o_orderkey % 23 = 0 THEN '' ELSE o_orderpriority END AS description,
    CASE WHEN o_orderkey % 31 = 5 THEN NULL ELSE (o_totalprice % 71) * {FOOT_SQL} END AS northing, (o_totalprice % 67) * {FOOT_SQL} AS easting, CASE WHEN o_orderkey % 29 = 5 THEN NULL ELSE (o_totalprice % 7) * {FOOT_SQL} END AS elevation, CASE WHEN o_orderkey % 37 = 5 THEN NULL ELSE 'A' END AS crs FROM orders)"""


@query(
    "e27_point_issues",
    f"""WITH p AS (SELECT * FROM {_POINTS}), j AS (SELECT *, northing IS NOT NULL AND elevation IS NOT NULL AND crs IS NOT NULL AS ok FROM p WHERE description <> ''), k AS (SELECT *, lag(ok) OVER w AS ok0, lag(northing) OVER w AS n0, lag(easting) OVER w AS e0, lag(elevation) OVER w AS z0 FROM j WINDOW w AS (PARTITION BY source_id, description ORDER BY seq))
    SELECT 'missing_xy' AS kind, 'ERROR' AS severity, point_uuid, CAST(NULL AS DOUBLE) AS value FROM p WHERE northing IS NULL UNION ALL SELECT 'missing_z', 'WARN', point_uuid, NULL FROM p WHERE elevation IS NULL UNION ALL SELECT 'coordinate_context', 'ERROR', point_uuid, NULL FROM p WHERE crs IS NULL
    UNION ALL SELECT 'duplicate_id', 'ERROR', point_uuid, CAST(n AS DOUBLE) FROM (SELECT *, count(*) OVER (PARTITION BY point_id) AS n FROM p) WHERE n > 1
    UNION ALL SELECT 'elevation_jump', 'WARN', point_uuid, {r('elevation - z0')} FROM k WHERE ok AND ok0 AND sqrt((northing - n0) ** 2 + (easting - e0) ** 2) <= 10 AND abs(elevation - z0) >= 0.7""",
)
def e27(spark, sf):
    points = table(spark, sf, "orders").selectExpr(
        "o_orderkey AS seq", "o_orderkey AS point_uuid", "CASE WHEN o_orderkey % 10 < 3 THEN o_orderkey - o_orderkey % 10 ELSE o_orderkey END AS point_id", "CAST(o_custkey % 40 AS STRING) AS source_id", "CASE WHEN o_orderkey % 23 = 0 THEN '' ELSE o_orderpriority END AS description",
        f"CASE WHEN o_orderkey % 31 = 5 THEN NULL ELSE (o_totalprice % 71) * {FOOT} END AS northing", f"(o_totalprice % 67) * {FOOT} AS easting", f"CASE WHEN o_orderkey % 29 = 5 THEN CAST('NaN' AS DOUBLE) ELSE (o_totalprice % 7) * {FOOT} END AS elevation",
        "CASE WHEN o_orderkey % 37 = 5 THEN NULL ELSE 'A' END AS crs", "'meters' AS horizontal_units", "'meters' AS vertical_units",
    )
    return snapshots.point_issues(points, "A", "meters", "meters", jump=0.7, distance=10.0)


_LOG = """(SELECT user_id AS project_id, event_id AS seq, CASE (row_number() OVER (PARTITION BY user_id ORDER BY event_id)) % 8 WHEN 3 THEN 'undo' WHEN 4 THEN 'redo' WHEN 5 THEN 'undo' WHEN 6 THEN 'undo' ELSE 'do' END AS action, event_type AS key, 'b' || event_id AS before, 'a' || event_id AS after FROM events)"""


@query(
    "k11_replayed",
    f"""WITH l AS (SELECT *, sum(CASE WHEN action = 'undo' THEN -1 ELSE 1 END) OVER (PARTITION BY project_id ORDER BY seq) AS level FROM {_LOG}), d AS (SELECT project_id, arg_max(level, seq) AS depth FROM l GROUP BY 1),
    o AS (SELECT l.*, level <= depth AND row_number() OVER (PARTITION BY project_id, level ORDER BY seq DESC) = 1 AS stands FROM l JOIN d USING (project_id) WHERE action = 'do')
    SELECT project_id, key, coalesce(arg_max(after, seq) FILTER (stands), arg_min(before, seq)) AS value FROM o GROUP BY 1, 2""",
)
def k11(spark, sf):
    rows = table(spark, sf, "events").selectExpr("user_id AS project_id", "event_id AS seq", "row_number() OVER (PARTITION BY user_id ORDER BY event_id) % 8 AS k", "event_type AS key", "concat('b', event_id) AS before", "concat('a', event_id) AS after")
    return snapshots.replayed(rows.withColumn("action", F.expr("CASE WHEN k IN (3, 5, 6) THEN 'undo' WHEN k = 4 THEN 'redo' ELSE 'do' END")).drop("k"))


@query(
    "l14_reassigned",
    """WITH v AS (SELECT c_custkey AS point_id, c_acctbal AS easting, CASE WHEN c_custkey % 3 = 0 THEN c_mktsegment END AS status FROM customer), m AS (SELECT point_id AS source_id, point_id // 2 + 1 AS target_id FROM v),
    a AS (SELECT m.* FROM m JOIN v s ON s.point_id = source_id JOIN v t ON t.point_id = target_id WHERE source_id <> target_id AND s.status IS NOT NULL AND t.status IS NULL), b AS (SELECT target_id, min(source_id) AS source_id FROM a GROUP BY 1), o AS (SELECT source_id, min(target_id) AS target_id FROM b GROUP BY 1)
    SELECT v.point_id, v.easting, CASE WHEN g.source_id IS NOT NULL THEN s.status WHEN x.source_id IS NULL THEN v.status END AS status, g.source_id AS moved_from FROM v LEFT JOIN o g ON g.target_id = v.point_id LEFT JOIN v s ON s.point_id = g.source_id LEFT JOIN o x ON x.source_id = v.point_id""",
)
def l14(spark, sf):
    results = table(spark, sf, "customer").selectExpr("c_custkey AS point_id", "c_acctbal AS easting", "CASE WHEN c_custkey % 3 = 0 THEN c_mktsegment END AS status")
    return snapshots.reassigned(results, results.selectExpr("point_id AS source_id", "point_id DIV 2 + 1 AS target_id"), "status")


@query(
    "a38_regrouped",
    """SELECT o_orderkey AS observation_id, CASE WHEN o_orderkey % 2 = 0 THEN o_custkey || 'B' ELSE CAST(o_custkey AS VARCHAR) END AS control_id, CAST(o_custkey AS VARCHAR) AS canonical_id FROM orders WHERE o_orderkey % 2 = 0""",
)
def a38(spark, sf):
    return snapshots.regrouped(table(spark, sf, "orders").selectExpr("o_orderkey AS observation_id", "concat(o_custkey, IF(o_orderkey % 2 = 0, 'B', '')) AS control_id", "CASE WHEN o_orderkey % 3 > 0 THEN concat(o_custkey, 'A') END AS point_id"))


@query(
    "c9_timeline",
    """SELECT event_id AS seq, event_type AS action, CASE event_type WHEN 'click' THEN 'Clicked' ELSE upper(event_type[1]) || event_type[2:] END AS label FROM events ORDER BY event_id DESC LIMIT 250""",
)
def c9(spark, sf):
    labels = spark.createDataFrame([("click", "Clicked")], "action string, label string")
    return snapshots.timeline(table(spark, sf, "events").selectExpr("event_id AS seq", "event_type AS action"), labels)


@query("e26_status_counts", "SELECT o_orderstatus AS status, count(*) AS n FROM orders GROUP BY 1")
def e26(spark, sf):
    return table(spark, sf, "orders").groupBy(F.col("o_orderstatus").alias("status")).agg(F.count(F.lit(1)).alias("n"))
