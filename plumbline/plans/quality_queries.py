"""Queries of quality, evidence and browsing operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.functions import ids, measures
from plumbline.operators import evidence, quality
from plumbline.plans.bindings import FOOT, FOOT_SQL, PLACES, places, query, r, table


_FAR = "northing * CASE WHEN point_id % 97 = 3 THEN 1000 ELSE 1 END"


@query(
    "e12_mad_outliers",
    f"""WITH p AS (SELECT point_id, {_FAR} AS northing, easting FROM {PLACES}), c AS (SELECT median(northing) AS n, median(easting) AS e, count(*) AS k FROM p), d AS (SELECT point_id, sqrt((northing - n) ** 2 + (easting - e) ** 2) AS distance, k FROM p, c),
    m AS (SELECT median(distance) AS m, median(distance) FILTER (distance > 0) AS t FROM d), s AS (SELECT median(abs(distance - m)) AS mad FROM d, m)
    SELECT point_id, {r('distance')} AS distance FROM d, m, s WHERE k >= 8 AND distance > CASE WHEN mad > 1e-9 THEN m + 12 * mad ELSE greatest(20 * t, 1000) END""",
)
def e12(spark, sf):
    return quality.mad_outliers(places(spark, sf).selectExpr("point_id", f"{_FAR} AS northing", "easting"))


_ODD = "CASE WHEN point_id % 9 = 1 THEN CAST('nan' AS DOUBLE) WHEN point_id % 10 = 1 THEN NULL ELSE northing * CASE WHEN point_id % 101 = 7 THEN 100000 ELSE 1 END END AS northing, easting, CASE WHEN label < 5 THEN 'EPSG:32617' ELSE ' ' END AS crs, CASE WHEN label = 3 THEN 'meters' WHEN label > 3 THEN 'us_survey_feet' END AS horizontal_units"


@query(
    "e11_sanity",
    f"""WITH p AS (SELECT *, northing IS NOT NULL AND NOT isnan(northing) AS ok FROM (SELECT {_ODD} FROM {PLACES})), q AS (SELECT * FROM p WHERE northing IS NOT NULL AND easting IS NOT NULL),
    c AS (SELECT count(*) AS n_rows, count(*) FILTER (ok) AS n_valid, count(*) FILTER (ok AND abs(northing) <= 90 AND abs(easting) <= 180) AS ll, count(*) FILTER (ok AND abs(northing) <= 180 AND abs(easting) <= 90) AS sw,
        count(DISTINCT nullif(trim(crs), '')) AS crss, count(DISTINCT horizontal_units) AS units, median(northing) FILTER (ok) AS mn, median(easting) FILTER (ok) AS me, median(sqrt(northing ** 2 + easting ** 2)) FILTER (ok) AS mm FROM q),
    d AS (SELECT sqrt((northing - mn) ** 2 + (easting - me) ** 2) AS d FROM q, c WHERE ok), m AS (SELECT median(d) FILTER (d > 0) AS m, count(*) FILTER (d > 0) AS k FROM d), o AS (SELECT count(*) FILTER (k >= 5 AND d > greatest(100 * m, 1)) AS n_outliers FROM d, m),
    f AS (SELECT *, array_to_string(list_filter([CASE WHEN n_valid < n_rows THEN 'INVALID_COORDINATE_ROWS' END, CASE WHEN ll / n_valid >= 0.8 THEN 'LATLON_IN_PROJECTED_PROJECT' END, CASE WHEN sw / n_valid >= 0.8 AND ll / n_valid < 0.5 THEN 'POSSIBLE_NORTHING_EASTING_SWAP' END,
        CASE WHEN mm > 0 AND mm < 10000 THEN 'SMALL_COORDINATE_MAGNITUDE' END, CASE WHEN n_outliers > 0 THEN 'REMOTE_COORDINATE_OUTLIER' END, CASE WHEN crss > 1 THEN 'MIXED_POINT_CRS' END, CASE WHEN units > 1 THEN 'MIXED_POINT_UNITS' END], lambda x: x IS NOT NULL), ',') AS flags FROM c, o)
    SELECT CASE WHEN flags <> '' THEN 'WARN' ELSE 'PASS' END AS status, flags, n_rows, n_valid, {r('mn')} AS median_n, {r('me')} AS median_e, {r('mm')} AS median_magnitude, n_outliers FROM f""",
)
def e11(spark, sf):
    return quality.coordinate_sanity(places(spark, sf).selectExpr(*_split(_ODD)), "EPSG:32617", "us_survey_feet")


def _split(columns: str) -> list[str]:
    """Expressions of a select list without commas inside them but in calls."""
    import re

    return [c.strip() for c in re.split(r",(?![^(]*\))", columns)]


@query(
    "e13_scale_fit",
    f"""WITH s AS (SELECT 1 + l_discount * 1e-4 AS factor, l_quantity AS weight FROM lineitem), k AS (SELECT sum(weight / factor) / sum(weight / (factor * factor)) AS k FROM s)
    SELECT {r('(k - 1) * 1e6')} AS k_ppm, {r('max(abs((k / factor - 1) * 1e6))')} AS max_ppm, {r('sqrt(sum(weight * ((k / factor - 1) * 1e6) ** 2) / sum(weight))')} AS rms_ppm, max(abs((k / factor - 1) * 1e6)) <= 20 AS passes FROM s, k GROUP BY k""",
)
def e13(spark, sf):
    rows = table(spark, sf, "lineitem").selectExpr("1 + l_discount * 1e-4D AS factor", "l_quantity AS weight")
    return quality.scale_factor(rows).selectExpr("(k - 1) * 1e6D AS k_ppm", "max_ppm", "rms_ppm", "passes")


@query(
    "e14_helmert",
    f"""WITH p AS (SELECT label, easting AS x, northing AS y, 1.5 * easting - 0.7 * northing + 100 + elevation AS gx, 0.7 * easting + 1.5 * northing - 50 - elevation AS gy FROM {PLACES}), m AS (SELECT label, avg(x) AS mx, avg(y) AS my, avg(gx) AS mgx, avg(gy) AS mgy FROM p GROUP BY 1),
    s AS (SELECT label, mx, my, mgx, mgy, sum((x - mx) * (gx - mgx) + (y - my) * (gy - mgy)) / sum((x - mx) ** 2 + (y - my) ** 2) AS a, sum((x - mx) * (gy - mgy) - (y - my) * (gx - mgx)) / sum((x - mx) ** 2 + (y - my) ** 2) AS b FROM p JOIN m USING (label) GROUP BY ALL)
    SELECT label, {r('sqrt(a * a + b * b)')} AS scale, {r('degrees(atan2(b, a))')} AS rotation_deg, {r('mgx - a * mx + b * my')} AS dx, {r('mgy - b * mx - a * my')} AS dy FROM s""",
)
def e14(spark, sf):
    rows = places(spark, sf).selectExpr("label", "easting AS x", "northing AS y", "1.5D * easting - 0.7D * northing + 100 + elevation AS gx", "0.7D * easting + 1.5D * northing - 50 - elevation AS gy")
    return quality.similarity_fit(rows, "label")


@query(
    "e10_health",
    """WITH c AS (SELECT count(*) FILTER (c_acctbal < 0) AS a, count(*) FILTER (c_mktsegment IS NULL) AS b, count(*) FILTER (c_nationkey > 20) AS d FROM customer)
    SELECT 'HEALTH_NEGATIVE' AS "check", a AS bad_rows, CASE WHEN a > 0 THEN 'ERROR' ELSE 'OK' END AS status FROM c UNION ALL SELECT 'HEALTH_SEGMENT', b, CASE WHEN b > 0 THEN 'ERROR' ELSE 'OK' END FROM c UNION ALL SELECT 'HEALTH_NATION', d, 'SKIP' FROM c""",
)
def e10(spark, sf):
    rules = spark.createDataFrame([("HEALTH_NEGATIVE", True, "ERROR", 0), ("HEALTH_SEGMENT", True, "ERROR", 0), ("HEALTH_NATION", False, "WARN", 10)], "check string, enabled boolean, severity string, threshold long")
    return quality.health(table(spark, sf, "customer"), rules, {"HEALTH_NEGATIVE": F.col("c_acctbal") < 0, "HEALTH_SEGMENT": F.col("c_mktsegment").isNull(), "HEALTH_NATION": F.col("c_nationkey") > 20})


@query(
    "c10_review_center",
    """SELECT source, severity, severity_rank, count(*) AS n FROM (SELECT 'customer' AS source, 'ERROR' AS severity, 0 AS severity_rank FROM customer WHERE c_acctbal < 0 UNION ALL SELECT 'supplier', 'WARN', 1 FROM supplier WHERE s_acctbal < 1000 UNION ALL SELECT 'part', 'INFO', 2 FROM part WHERE p_size > 40) GROUP BY ALL""",
)
def c10(spark, sf):
    a = table(spark, sf, "customer").where("c_acctbal < 0").selectExpr("c_custkey AS object_id", "c_name AS detail")
    b = table(spark, sf, "supplier").where("s_acctbal < 1000").selectExpr("s_suppkey AS object_id", "s_name AS detail")
    c = table(spark, sf, "part").where("p_size > 40").selectExpr("p_partkey AS object_id", "p_name AS detail")
    return quality.union_issues(("customer", "ERROR", a), ("supplier", "WARN", b), ("part", "INFO", c)).groupBy("source", "severity", "severity_rank").count().withColumnRenamed("count", "n")


_REVIEWS = """CAST(user_id % 10 AS VARCHAR(9)) AS run_id, CASE WHEN user_id % 50 <> 7 THEN user_id END AS candidate_id, CASE WHEN event_type IN ('click', 'view') THEN 'confirmed_bust' WHEN event_type = 'error' THEN 'needs_review' ELSE 'not_bust' END AS decision,
    value / 2000 AS scatter, CASE event_id % 4 WHEN 0 THEN 'meters' WHEN 1 THEN 'us_survey_feet' WHEN 2 THEN 'international_feet' END AS vertical_units, event_id AS seq"""


@query(
    "e23_calibration",
    f"""WITH r AS (SELECT *, row_number() OVER (PARTITION BY run_id, candidate_id ORDER BY seq DESC) AS k FROM (SELECT {_REVIEWS} FROM events) WHERE candidate_id IS NOT NULL),
    f AS (SELECT decision, scatter / CASE vertical_units WHEN 'meters' THEN CAST(0.3048 AS DOUBLE) WHEN 'us_survey_feet' THEN CAST(0.999998 AS DOUBLE) WHEN 'international_feet' THEN 1 END AS feet FROM r WHERE k = 1), m AS (SELECT median(feet) AS m FROM f WHERE decision = 'confirmed_bust')
    SELECT count(*) AS reviews, count(*) FILTER (decision = 'confirmed_bust') AS confirmed, count(*) FILTER (decision = 'not_bust') AS not_bust, count(*) FILTER (decision = 'needs_review') AS needs_review,
        count(*) FILTER (decision = 'confirmed_bust' AND feet IS NULL) AS excluded, {r('any_value(m)')} AS median_scatter_ft, {r('least(0.25, greatest(0.05, 2 * any_value(m)))', 3)} AS suggested_ft FROM f, m""",
)
def e23(spark, sf):
    return quality.calibration(table(spark, sf, "events").selectExpr(*_split(_REVIEWS)))


@query("e24_role_counts", "SELECT event_type AS role, count(*) AS n FROM events GROUP BY 1")
def e24(spark, sf):
    return table(spark, sf, "events").groupBy(F.col("event_type").alias("role")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "a25_profile",
    """SELECT 'value' AS "column", count(value) AS n_values, count(*) - count(value) AS n_nulls, count(DISTINCT value) AS n_distinct, round(min(value), 4) + 0.0 AS least, round(max(value), 4) + 0.0 AS greatest FROM events
    UNION ALL SELECT 'user_id', count(user_id), count(*) - count(user_id), count(DISTINCT user_id), min(user_id), max(user_id) FROM events""",
)
def a25(spark, sf):
    return quality.profile(table(spark, sf, "events"), ("value", "user_id"))


@query("c1_browse", "SELECT * FROM part WHERE contains(lower(p_partkey || ' ' || p_name || ' ' || p_brand || ' ' || p_type), 'red') ORDER BY p_partkey DESC LIMIT 50 OFFSET 20")
def c1(spark, sf):
    """A page of parts (a top-k report)."""
    return quality.browse(table(spark, sf, "part"), "red", "p_partkey", 50, 20)


@query("c2_overview", "SELECT 'customer' AS dataset, count(*) AS n FROM customer UNION ALL SELECT 'orders', count(*) FROM orders UNION ALL SELECT 'events', count(*) FROM events")
def c2(spark, sf):
    from functools import reduce

    return reduce(lambda a, b: a.unionByName(b), [table(spark, sf, n).agg(F.count(F.lit(1)).alias("n")).select(F.lit(n).alias("dataset"), "n") for n in ("customer", "orders", "events")])


@query(
    "c6_code_match",
    """WITH r(rule, match, pattern, category) AS (VALUES (1, 'EXACT', 'RED WIDGET', 'Exact'), (2, 'STARTS_WITH', 'RED', 'Red'), (3, 'CONTAINS', 'BOLT', 'Bolt'), (4, 'CONTAINS', 'GEAR', 'Gear')),
    m AS (SELECT p_partkey AS point_id, rule, category, row_number() OVER (PARTITION BY p_partkey ORDER BY length(pattern) DESC, rule) AS k FROM part LEFT JOIN r ON CASE match WHEN 'EXACT' THEN upper(trim(p_name)) = pattern WHEN 'STARTS_WITH' THEN starts_with(upper(trim(p_name)), pattern) ELSE contains(upper(trim(p_name)), pattern) END)
    SELECT point_id, rule, category FROM m WHERE k = 1""",
)
def c6(spark, sf):
    rules = spark.createDataFrame([(1, "EXACT", "red widget", "Exact"), (2, "STARTS_WITH", "RED", "Red"), (3, "CONTAINS", "bolt", "Bolt"), (4, "CONTAINS", "gear", "Gear")], "rule int, match string, pattern string, category string")
    return quality.match_codes(table(spark, sf, "part").selectExpr("p_partkey AS point_id", "p_name AS code"), rules)


@query("c7_search", "SELECT 'documents' AS source, doc_id AS object_id FROM documents WHERE contains(lower(text), 'token') UNION ALL SELECT 'benchmark', item_id FROM benchmark WHERE contains(lower(text), 'token') UNION ALL SELECT 'conversations', conv_id FROM conversations WHERE contains(lower(text), 'token')")
def c7(spark, sf):
    side = lambda n, k: table(spark, sf, n).where(F.lower("text").contains("token")).select(F.lit(n).alias("source"), F.col(k).alias("object_id"))
    return side("documents", "doc_id").unionByName(side("benchmark", "item_id")).unionByName(side("conversations", "conv_id"))


@query("g1_recent", "SELECT event_id, event_type FROM events ORDER BY ts DESC, event_id DESC LIMIT 100")
def g1(spark, sf):
    """The newest hundred events (a top-k report)."""
    return table(spark, sf, "events").orderBy(F.col("ts").desc(), F.col("event_id").desc()).limit(100).select("event_id", "event_type")


@query("g4_page", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' ORDER BY o_orderkey LIMIT 50 OFFSET 100")
def g4(spark, sf):
    """The third page of fifty (a top-k report)."""
    return table(spark, sf, "orders").where("o_orderstatus = 'F'").orderBy("o_orderkey").offset(100).limit(50).select("o_orderkey")


_SIGNS = """user_id AS point_id, CASE event_id % 5 WHEN 0 THEN 'AMBIGUOUS' WHEN 1 THEN 'EXPLICIT_NO' WHEN 2 THEN 'EXPLICIT_CNA' WHEN 3 THEN 'EXPLICIT_YES' ELSE 'MEASUREMENT' END AS basis,
    CASE WHEN event_id % 90 = 0 THEN NULL ELSE (event_id % 100) / CAST(100 AS DOUBLE) END AS id_confidence, (event_id * 7 % 100) / CAST(100 AS DOUBLE) AS value_confidence,
    CASE WHEN user_id % 3 = 0 THEN 'CNA' WHEN value < 60 THEN 'YES' ELSE 'NO' END AS class, CASE WHEN event_id % 7 <> 0 THEN event_id % 50 <> 0 END AS agrees, CASE WHEN event_id % 40 = 0 THEN 'HOLD' WHEN event_id % 3 = 0 THEN 'AUTO_ACCEPT' END AS decision"""
_EVIDENCE = f"(SELECT {_SIGNS} FROM events)"


def _evidence(spark, sf):
    return table(spark, sf, "events").selectExpr(*_split(_SIGNS))


_VOTE = f"""WITH e AS (SELECT *, least(coalesce(id_confidence, 0), coalesce(value_confidence, 0)) AS effective FROM {_EVIDENCE}),
    d AS (SELECT *, effective >= 0.85 AND CASE class WHEN 'YES' THEN basis IN ('MEASUREMENT', 'EXPLICIT_YES') ELSE basis = 'EXPLICIT_' || class END AS ok FROM e),
    v AS (SELECT point_id, count(*) FILTER (ok) AS decisive, min(CASE WHEN ok THEN class END) AS lo, max(CASE WHEN ok THEN class END) AS hi, max(effective) FILTER (ok) AS best, max(effective) AS any_best, count(*) AS n, max(id_confidence) AS id_best,
        bool_or(coalesce(NOT agrees, false) OR coalesce(decision, '') NOT IN ('', 'AUTO_ACCEPT')) AS doubt FROM d GROUP BY 1)"""


@query("e17_vote", _VOTE + f" SELECT point_id, decisive, CASE WHEN lo = hi THEN lo ELSE 'REVIEW' END AS status, {r('CASE WHEN lo = hi THEN best ELSE any_best END')} AS confidence FROM v")
def e17(spark, sf):
    return evidence.status_vote(_evidence(spark, sf))


_RESULTS = (
    _VOTE
    + f""", p AS (SELECT c_custkey AS point_id FROM customer), s AS (SELECT p.point_id, n, CASE WHEN n IS NULL THEN 'NOT_FOUND' WHEN lo = hi THEN lo ELSE 'REVIEW' END AS dip, CASE WHEN lo = hi THEN best ELSE any_best END AS dip_confidence, id_best, coalesce(doubt, false) AS doubt FROM p LEFT JOIN v USING (point_id))
    SELECT point_id, coalesce(n, 0) AS n_evidence, STATUS AS status, dip AS dip_status, {r('coalesce(CONFIDENCE, 0)')} AS confidence, n IS NOT NULL AND (dip = 'REVIEW' OR doubt) AS review FROM s"""
)


@query("d5_aggregate_results", _RESULTS.replace("STATUS AS", "CASE WHEN n IS NULL THEN 'NO' ELSE 'YES' END AS").replace("CONFIDENCE,", "id_best,"))
def d5(spark, sf):
    return evidence.aggregate_results(table(spark, sf, "customer").selectExpr("c_custkey AS point_id"), _evidence(spark, sf))


@query("d5_confirmed_dips", _RESULTS.replace("STATUS AS", "dip AS").replace("CONFIDENCE,", "dip_confidence,"))
def d5_confirmed(spark, sf):
    return evidence.aggregate_results(table(spark, sf, "customer").selectExpr("c_custkey AS point_id"), _evidence(spark, sf), rule="CONFIRMED_DIP")


@query(
    "e16_pipe_multiset",
    """WITH i AS (SELECT user_id AS point_id, event_id % 4 AS record, event_type AS pipe, event_id AS seq FROM events), c AS (SELECT point_id, pipe, record, row_number() OVER (PARTITION BY point_id, record, pipe ORDER BY seq) AS copy FROM i)
    SELECT point_id, pipe, copy, min(record) AS record FROM c GROUP BY ALL""",
)
def e16(spark, sf):
    rows = table(spark, sf, "events").selectExpr("user_id AS point_id", "event_id % 4 AS record", "event_type AS pipe", "event_id AS seq")
    return evidence.multiset_union(rows, "point_id", "record", "pipe")


_READ = """event_id, event_id % 4 <> 0 AS exact_ocr, event_id % 3 <> 0 AS in_survey, event_id % 5 <> 0 AS has_model, CASE event_id % 7 WHEN 0 THEN NULL WHEN 1 THEN false ELSE true END AS agrees, (event_id % 130 - 10) / CAST(100 AS DOUBLE) AS value_confidence,
    CASE WHEN event_id % 11 = 0 THEN 'AMBIGUOUS' ELSE 'MEASUREMENT' END AS basis, CASE event_id % 6 WHEN 0 THEN 'level_loop' WHEN 1 THEN 'index' ELSE 'utility' END AS page_type"""


@query(
    "e28_assess",
    f"""WITH c AS (SELECT *, basis = 'AMBIGUOUS' AS vague, page_type IN ('level_loop', 'control', 'index') AS context, coalesce(NOT agrees, false) AS off FROM (SELECT {_READ} FROM events)),
    s AS (SELECT *, round(greatest(0, least(1, CASE WHEN exact_ocr THEN 0.42 ELSE 0 END + CASE WHEN in_survey THEN 0.18 ELSE 0 END + CASE WHEN has_model THEN 0.12 ELSE 0 END + CASE WHEN agrees THEN 0.14 WHEN off THEN -0.24 ELSE 0 END
        + 0.08 * greatest(0, least(1, value_confidence)) + CASE WHEN vague THEN 0 ELSE 0.04 END - CASE WHEN context THEN 0.05 ELSE 0 END)), 3) AS score FROM c)
    SELECT event_id, {r('score')} AS score, CASE WHEN exact_ocr AND score >= 0.88 AND NOT off AND NOT vague THEN 'AUTO_ACCEPT' WHEN exact_ocr AND score >= 0.58 THEN 'REVIEW_DETAILS' ELSE 'MANUAL_REVIEW' END AS decision,
        array_to_string(list_filter([CASE WHEN NOT exact_ocr THEN 'NO_INDEPENDENT_EXACT_POINTID' END, CASE WHEN NOT in_survey THEN 'POINTID_NOT_IN_SURVEY' END, CASE WHEN off THEN 'MODEL_DISAGREEMENT' END, CASE WHEN vague THEN 'AMBIGUOUS_SEMANTICS' END,
            CASE WHEN context THEN 'NON_STRUCTURE_PAGE_CONTEXT' END], lambda x: x IS NOT NULL), ',') AS flags FROM s""",
)
def e28(spark, sf):
    return evidence.assess(table(spark, sf, "events").selectExpr(*_split(_READ))).select("event_id", "score", "decision", "flags")


_JUDGED = """event_id AS point_id, event_id % 2 = 0 AS exact_ocr, event_id % 3 <> 0 AS has_evidence, event_id % 4 AS n_agree, CASE WHEN event_id % 9 = 0 THEN 1 ELSE 0 END AS n_disagree, CASE event_id % 5 WHEN 0 THEN 'YES' WHEN 1 THEN 'NO' WHEN 2 THEN 'CNA' ELSE 'NOT_FOUND' END AS dip_status,
    CASE WHEN event_id % 8 = 0 THEN 'YES' ELSE 'NOT_FOUND' END AS status, event_id % 6 <> 0 AS has_dip, CASE WHEN event_id % 10 < 5 THEN 'EXPLICIT_NO' ELSE 'EXPLICIT_CNA' END AS basis, event_id % 7 = 0 AS has_diameter, event_id % 11 = 0 AS has_azimuth,
    CASE WHEN event_id % 13 > 4 THEN 'SSMH' ELSE '' END AS code, event_id % 17 = 0 AS confirmed, event_id % 12 = 5 AS review"""


@query(
    "e18_confidence",
    f"""WITH o AS (SELECT *, CASE WHEN dip_status <> 'NOT_FOUND' OR status = 'NOT_FOUND' THEN dip_status ELSE status END AS outcome FROM (SELECT {_JUDGED} FROM events)),
    s AS (SELECT *, CASE WHEN exact_ocr THEN 30 WHEN has_evidence THEN 18 ELSE 0 END + CASE WHEN n_disagree > 0 THEN -25 WHEN n_agree > 0 THEN 25 ELSE 0 END + CASE WHEN (outcome = 'YES' AND has_dip) OR (outcome IN ('NO', 'CNA', 'CNL') AND basis = 'EXPLICIT_' || outcome) THEN 15 ELSE 0 END
        + CASE WHEN has_diameter THEN 10 ELSE 0 END + CASE WHEN has_azimuth THEN 10 ELSE 0 END + CASE WHEN code <> '' THEN 10 ELSE 0 END AS raw FROM o),
    f AS (SELECT *, CASE WHEN confirmed THEN greatest(raw, 95) ELSE raw END AS a FROM s), g AS (SELECT *, CASE WHEN review THEN least(a, 79) ELSE a END AS b FROM f)
    SELECT point_id, CAST(greatest(0, least(100, CASE WHEN has_evidence THEN b ELSE least(b, 25) END)) AS BIGINT) AS confidence FROM g""",
)
def e18(spark, sf):
    return evidence.smart_confidence(table(spark, sf, "events").selectExpr(*_split(_JUDGED)).withColumn("bases", F.array("basis")))


def _page_sql() -> str:
    weights = ", ".join(" + ".join(f"CASE WHEN contains(t, '{t}') THEN {w} ELSE 0 END" for t, w in terms.items()) + f" AS w_{k}" for k, terms in evidence.PAGE_TERMS.items())
    names = ", ".join(f"w_{k}" for k in evidence.PAGE_TERMS)
    return f"""WITH t AS (SELECT page_id, trim(regexp_replace(lower(coalesce(html, '')), '\\s+', ' ', 'g')) AS t FROM pages), w AS (SELECT page_id, length(regexp_replace(t, '[^a-z0-9]', '', 'g')) AS size, greatest(1, len(regexp_extract_all(t, '[a-z0-9]+'))) AS tokens, {weights} FROM t),
    k AS (SELECT *, list_reverse_sort([{names}]) AS ranked FROM w), b AS (SELECT *, ranked[1] AS best, ranked[1] - ranked[2] AS margin FROM k)
    SELECT page_id, CASE WHEN size < 3 THEN 'blank' WHEN best < 3 THEN 'unknown' {' '.join(f"WHEN w_{k} = best THEN '{k}'" for k in evidence.PAGE_TERMS)} END AS kind, CAST(CASE WHEN size < 3 THEN 0 ELSE best END AS BIGINT) AS weight,
        CAST(CASE WHEN size < 3 THEN 0.96 WHEN best < 3 THEN 0.35 ELSE round(least(0.97, 0.58 + least(0.25, best / greatest(CAST(10 AS DOUBLE), tokens / 4) * 0.08) + least(0.14, margin * 0.025)) + 1e-9, 3) END AS DOUBLE) AS confidence FROM b"""


@query("e29_page_type", _page_sql())
def e29(spark, sf):
    return evidence.classify_pages(table(spark, sf, "pages").selectExpr("page_id", "html AS text"))


_PIPES = f"""(SELECT event_id AS point_id, 1 AS pipe_index, value * {FOOT_SQL} - 0.1 AS dip, (event_id % 200) - 5 AS diameter_in, (event_id * 3 % 400) - 10 AS azimuth_deg, event_id * 5 % 360 AS leader_deg, event_id % 2 = 0 AS is_rim, 100 + value AS elevation FROM events)"""


@query(
    "e30_pipe_qc",
    f"""WITH p AS (SELECT *, azimuth_deg - leader_deg + 180 AS t FROM {_PIPES}) SELECT point_id, pipe_index, array_to_string(list_filter([CASE WHEN dip < 0.05 THEN 'DIP_SMALL' END, CASE WHEN dip > 80 THEN 'DIP_LARGE' END, CASE WHEN diameter_in <= 0 OR diameter_in > 144 THEN 'DIAMETER' END,
        CASE WHEN azimuth_deg < 0 OR azimuth_deg >= 360 THEN 'AZIMUTH' END, CASE WHEN abs(t - 360 * floor(t / 360) - 180) > 35 THEN 'DIRECTION' END], lambda x: x IS NOT NULL), ',') AS flags, {r('CASE WHEN is_rim THEN elevation - dip END')} AS invert FROM p""",
)
def e30(spark, sf):
    rows = table(spark, sf, "events").selectExpr("event_id AS point_id", "1 AS pipe_index", f"value * {FOOT} - 0.1D AS dip", "(event_id % 200) - 5 AS diameter_in", "(event_id * 3 % 400) - 10 AS azimuth_deg", "event_id * 5 % 360 AS leader_deg", "event_id % 2 = 0 AS is_rim", "100 + value AS elevation")
    return evidence.pipe_checks(rows)


@query(
    "e25_baseline_metrics",
    f"""WITH a AS (SELECT o_orderkey AS id, o_orderstatus AS v FROM orders WHERE o_orderkey % 3 <> 0), b AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 5 = 0 THEN 'X' ELSE o_orderstatus END AS v FROM orders WHERE o_orderkey % 4 <> 0)
    SELECT count(*) FILTER (a.id IS NOT NULL AND b.id IS NOT NULL) AS common, {r('count(*) FILTER (a.id IS NOT NULL AND b.id IS NOT NULL) / greatest(1, count(b.id))')} AS coverage, {r('count(*) FILTER (a.id IS NOT NULL AND b.id IS NOT NULL) / greatest(1, count(a.id))')} AS precision, {r('count(*) FILTER (a.v = b.v) / greatest(1, count(*) FILTER (a.id IS NOT NULL AND b.id IS NOT NULL))')} AS accuracy
    FROM a FULL JOIN b ON a.id = b.id""",
)
def e25(spark, sf):
    o = table(spark, sf, "orders")
    a = o.where("o_orderkey % 3 <> 0").selectExpr("o_orderkey AS id", "o_orderstatus AS av", "true AS a")
    b = o.where("o_orderkey % 4 <> 0").selectExpr("o_orderkey AS id", "CASE WHEN o_orderkey % 5 = 0 THEN 'X' ELSE o_orderstatus END AS bv", "true AS b")
    common = F.count_if(F.col("a") & F.col("b"))
    return a.join(b, "id", "full_outer").agg(
        common.alias("common"), (common / F.greatest(F.lit(1), F.count("b"))).alias("coverage"), (common / F.greatest(F.lit(1), F.count("a"))).alias("precision"), (F.count_if(F.col("av") == F.col("bv")) / F.greatest(F.lit(1), common)).alias("accuracy")
    )


@query(
    "i22_duration",
    f"""SELECT o_orderkey, {r('CAST(CASE o_orderkey % 4 WHEN 0 THEN (o_custkey % 60) * 60 WHEN 1 THEN (o_custkey % 24) * 3600 + (o_orderkey % 60) * 60 + 30 WHEN 2 THEN (o_custkey % 60) * 60 + 15 ELSE o_custkey END AS DOUBLE)')} AS seconds FROM orders""",
)
def i22(spark, sf):
    rows = table(spark, sf, "orders").selectExpr("o_orderkey", "CASE o_orderkey % 4 WHEN 0 THEN concat(o_custkey % 60, ' min') WHEN 1 THEN concat(o_custkey % 24, ':', lpad(o_orderkey % 60, 2, '0'), ':30') WHEN 2 THEN concat(o_custkey % 60, ':15') ELSE concat(o_custkey, '') END AS t")
    return rows.select("o_orderkey", measures.duration_seconds(F.col("t")).alias("seconds"))


@query(
    "i3_point_ids",
    "SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN o_custkey || '' ELSE '00' || o_custkey END AS id, (o_custkey // 1000 * 1000) || '-series' AS series, CASE WHEN o_orderkey % 3 = 0 THEN o_custkey || 'a' ELSE 'unknown' END AS destination FROM orders",
)
def i3(spark, sf):
    rows = table(spark, sf, "orders").selectExpr("o_orderkey", "o_custkey", "CASE WHEN o_orderkey % 2 = 0 THEN concat(o_custkey, '.0 ') ELSE concat('00', o_custkey) END AS raw", "CASE WHEN o_orderkey % 3 = 0 THEN concat('to ', o_custkey, 'a') ELSE 'unknown' END AS note")
    return rows.select("o_orderkey", ids.normal_point_id(F.col("raw")).alias("id"), ids.series_label(F.col("o_custkey")).alias("series"), ids.destination_ref(F.col("note")).alias("destination"))


@query(
    "i26_three_wire",
    f"""WITH w AS (SELECT event_id, 5 + value * {FOOT_SQL} AS u, CASE WHEN event_id % 4 = 0 THEN NULL ELSE 4.5 + value * {FOOT_SQL} END AS m, CASE WHEN event_id % 3 = 0 THEN NULL ELSE 4 + value * {FOOT_SQL} END AS l FROM events)
    SELECT event_id, {r('CASE WHEN u IS NOT NULL AND m IS NOT NULL AND l IS NOT NULL THEN (u + m + l) / 3 WHEN m IS NOT NULL THEN m WHEN l IS NOT NULL THEN (u + l) / 2 END')} AS mean, {r('m - (u + l) / 2')} AS "check", {r('u - l')} AS intercept FROM w""",
)
def i26(spark, sf):
    rows = table(spark, sf, "events").selectExpr("event_id", f"5 + value * {FOOT} AS u", f"CASE WHEN event_id % 4 = 0 THEN NULL ELSE 4.5D + value * {FOOT} END AS m", f"CASE WHEN event_id % 3 = 0 THEN NULL ELSE 4 + value * {FOOT} END AS l")
    mean, check, intercept = measures.three_wire(F.col("u"), F.col("m"), F.col("l"))
    return rows.select("event_id", mean.alias("mean"), check.alias("check"), intercept.alias("intercept"))
