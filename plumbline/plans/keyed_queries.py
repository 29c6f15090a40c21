"""Queries of the keyed operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.operators import keyed
from plumbline.plans.bindings import CONTROL, FOOT_SQL, control_observations, query, r, table, version_sql, versions

_BASE, _NEW = version_sql(False), version_sql(True)


@query("f1_revisions", f"SELECT control_id, observation_id, row_number() OVER (PARTITION BY control_id ORDER BY observed, observation_id, h_sigma, northing) AS revision FROM {CONTROL}")
def f1(spark, sf):
    rows = keyed.revisions(control_observations(spark, sf), "control_id", "observed", "observation_id", "h_sigma", "northing")
    return rows.select("control_id", "observation_id", "revision")


_REVISED = "(SELECT o_custkey AS object_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS revision, o_orderkey AS solution FROM orders)"


@query(
    "f2_active_or_latest",
    f"""WITH s AS (SELECT * FROM {_REVISED}), c AS (SELECT DISTINCT object_id, object_id % 4 + 1 AS selected FROM s WHERE object_id % 2 = 0),
    o AS (SELECT s.*, row_number() OVER (PARTITION BY s.object_id ORDER BY CASE WHEN revision = selected THEN 1 ELSE 0 END DESC, revision DESC) AS rn FROM s LEFT JOIN c ON s.object_id = c.object_id)
    SELECT object_id, revision, solution FROM o WHERE rn = 1""",
)
def f2(spark, sf):
    rows = keyed.revisions(table(spark, sf, "orders").selectExpr("o_custkey AS object_id", "o_orderkey AS solution"), "object_id", "solution")
    selections = rows.select("object_id").distinct().where("object_id % 2 = 0").selectExpr("object_id", "object_id % 4 + 1 AS revision")
    return keyed.active_or_latest(rows, selections, "object_id").select("object_id", "revision", "solution")


@query(
    "h3_revision_compare",
    f"""WITH s AS (SELECT * FROM {_REVISED}), f AS (SELECT s.object_id, s.revision, array_agg(DISTINCT o_orderpriority) AS flags FROM s JOIN orders ON o_orderkey = solution WHERE revision <= 2 GROUP BY ALL)
    SELECT a.object_id, array_to_string(list_sort(list_filter(b.flags, lambda x: NOT list_contains(a.flags, x))), ',') AS added, array_to_string(list_sort(list_filter(a.flags, lambda x: NOT list_contains(b.flags, x))), ',') AS resolved
    FROM f a JOIN f b ON a.object_id = b.object_id AND a.revision = 1 AND b.revision = 2""",
)
def h3(spark, sf):
    rows = keyed.revisions(table(spark, sf, "orders").selectExpr("o_custkey AS object_id", "o_orderkey AS solution", "o_orderpriority AS flag"), "object_id", "solution").where("revision <= 2")
    flags = rows.groupBy("object_id").agg(F.collect_set(F.when(F.col("revision") == 1, F.col("flag"))).alias("a"), F.collect_set(F.when(F.col("revision") == 2, F.col("flag"))).alias("b"), F.max("revision").alias("n"))
    diff = lambda x, y: F.array_join(F.sort_array(F.array_except(x, y)), ",")
    return flags.where("n = 2").select("object_id", diff("b", "a").alias("added"), diff("a", "b").alias("resolved"))


@query(
    "d4_point_diff",
    f"""SELECT coalesce(a.point_id, b.point_id) AS point_id, CASE WHEN a.point_id IS NULL THEN 'added' WHEN b.point_id IS NULL THEN 'removed'
        WHEN abs(b.northing - a.northing) > 0.001 OR abs(b.easting - a.easting) > 0.001 OR coalesce(a.description, '') <> coalesce(b.description, '') THEN 'changed' ELSE 'unchanged' END AS status,
        {r('b.northing - a.northing')} AS d_northing, {r('b.easting - a.easting')} AS d_easting, {r('b.elevation - a.elevation')} AS d_elevation FROM {_BASE} a FULL JOIN {_NEW} b ON a.point_id = b.point_id""",
)
def d4(spark, sf):
    return keyed.point_diff(versions(spark, sf, False), versions(spark, sf, True))


@query(
    "d26_revision_match",
    f"""WITH a AS (SELECT point_id, northing, easting, elevation, description FROM {_BASE} x), b AS (SELECT point_id, northing, easting, elevation, description FROM {_NEW} x),
    ga AS (SELECT point_id, count(*) AS n, min(northing) AS nn, min(easting) AS ee, min(description) AS dd FROM a GROUP BY 1), gb AS (SELECT point_id, count(*) AS n, min(northing) AS nn, min(easting) AS ee, min(description) AS dd FROM b GROUP BY 1)
    SELECT coalesce(ga.point_id, gb.point_id) AS point_id, coalesce(ga.n, 0) AS n_base, coalesce(gb.n, 0) AS n_revised, CASE WHEN coalesce(ga.n, 0) > 1 OR coalesce(gb.n, 0) > 1 THEN 'ambiguous' WHEN ga.n IS NULL THEN 'added'
        WHEN gb.n IS NULL THEN 'removed' WHEN ga.nn <> gb.nn OR ga.ee <> gb.ee OR ga.dd <> gb.dd THEN 'changed' ELSE 'unchanged' END AS status FROM ga FULL JOIN gb ON ga.point_id = gb.point_id""",
)
def d26(spark, sf):
    return keyed.revision_match(versions(spark, sf, False), versions(spark, sf, True))


_FOLDED = "CASE WHEN point_id % 5 = 0 THEN {half} ELSE point_id END AS point_id, northing, easting, elevation, description"


@query(
    "d26_revision_match_all",
    f"""WITH a AS (SELECT {_FOLDED.format(half='point_id // 2')} FROM {_BASE} x), b AS (SELECT {_FOLDED.format(half='point_id // 2')} FROM {_NEW} x),
    ga AS (SELECT point_id, count(*) AS n, min(northing) AS nn, min(easting) AS ee, min(description) AS dd FROM a GROUP BY 1), gb AS (SELECT point_id, count(*) AS n, min(northing) AS nn, min(easting) AS ee, min(description) AS dd FROM b GROUP BY 1)
    SELECT coalesce(ga.point_id, gb.point_id) AS point_id, coalesce(ga.n, 0) AS n_base, coalesce(gb.n, 0) AS n_revised, CASE WHEN coalesce(ga.n, 0) > 1 OR coalesce(gb.n, 0) > 1 THEN 'ambiguous' WHEN ga.n IS NULL THEN 'added'
        WHEN gb.n IS NULL THEN 'removed' WHEN ga.nn <> gb.nn OR ga.ee <> gb.ee OR ga.dd <> gb.dd THEN 'changed' ELSE 'unchanged' END AS status FROM ga FULL JOIN gb ON ga.point_id = gb.point_id""",
)
def d26_all(spark, sf):
    """Both whole tables; every fifth id is halved, which makes some ids ambiguous."""
    folded = lambda second: versions(spark, sf, second).selectExpr(*_FOLDED.format(half="point_id div 2").split(", "))
    return keyed.revision_match(folded(False), folded(True))


@query("h1_added_ids", f"SELECT point_id FROM {_NEW} EXCEPT SELECT point_id FROM {_BASE}")
def h1(spark, sf):
    return versions(spark, sf, True).select("point_id").exceptAll(versions(spark, sf, False).select("point_id"))


@query("h2_common_ids", f"SELECT point_id FROM {_NEW} INTERSECT SELECT point_id FROM {_BASE}")
def h2(spark, sf):
    return versions(spark, sf, True).select("point_id").intersect(versions(spark, sf, False).select("point_id"))


@query("h4_distinct_ids", "SELECT DISTINCT l_partkey AS point_id FROM lineitem")
def h4(spark, sf):
    return table(spark, sf, "lineitem").select(F.col("l_partkey").alias("point_id")).distinct()


@query(
    "h5_union_sources",
    "SELECT 'customer' AS source, c_custkey AS object_id, c_acctbal AS amount FROM customer UNION ALL SELECT 'supplier', s_suppkey, s_acctbal FROM supplier UNION ALL SELECT 'part', p_partkey, NULL FROM part",
)
def h5(spark, sf):
    a = table(spark, sf, "customer").selectExpr("'customer' AS source", "c_custkey AS object_id", "c_acctbal AS amount")
    b = table(spark, sf, "supplier").selectExpr("'supplier' AS source", "s_suppkey AS object_id", "s_acctbal AS amount")
    c = table(spark, sf, "part").selectExpr("'part' AS source", "p_partkey AS object_id")
    return a.unionByName(b).unionByName(c, allowMissingColumns=True)


@query("e8_duplicate_ids", "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def e8(spark, sf):
    return keyed.duplicates(table(spark, sf, "lineitem"), "l_orderkey", "l_linenumber")


@query(
    "e9_null_rates",
    f"""WITH p AS (SELECT nullif(l_tax, 0) AS tax, nullif(l_returnflag, 'R') AS flag FROM lineitem)
    SELECT count(*) AS n_rows, count(*) FILTER (tax IS NULL) AS null_tax, count(*) FILTER (flag IS NULL) AS null_flag, {r('count(*) FILTER (tax IS NULL) / count(*)')} AS share_tax, {r('count(*) FILTER (flag IS NULL) / count(*)')} AS share_flag FROM p""",
)
def e9(spark, sf):
    return keyed.null_rates(table(spark, sf, "lineitem").selectExpr("nullif(l_tax, 0) AS tax", "nullif(l_returnflag, 'R') AS flag"), "tax", "flag")


def _gap_sql(ids: str, least: int) -> str:
    return f"SELECT x + 1 AS first_id, nx - 1 AS last_id, nx - x - 1 AS n_ids FROM (SELECT x, lead(x) OVER (ORDER BY x) AS nx FROM ({ids})) WHERE nx - x - 1 >= {least}"


_URGENT = "SELECT DISTINCT o_orderkey AS x FROM orders WHERE o_orderpriority = '1-URGENT'"


@query("e19_gaps", _gap_sql(_URGENT, 1))
def e19(spark, sf):
    return keyed.gaps(table(spark, sf, "orders").where("o_orderpriority = '1-URGENT'"), "o_orderkey")


@query("e19_gaps_bounded", _gap_sql("SELECT DISTINCT o_orderkey AS x FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderkey BETWEEN 100 AND 20000 UNION SELECT 99 UNION SELECT 20001", 5))
def e19_bounded(spark, sf):
    return keyed.gaps(table(spark, sf, "orders").where("o_orderpriority = '1-URGENT'"), "o_orderkey", 20000, 100, 5)


_NUMBERS = "o_custkey * 300 + o_orderkey % 90"
_SAFEST = "Safest option: starts a new 1000-point series above every PointID currently in the file, preventing overlap with existing numbers."


@query(
    "e20_crew_ranges",
    f"""WITH g AS ({_gap_sql(f'SELECT DISTINCT {_NUMBERS} AS x FROM orders', 100)})
    SELECT first_id, last_id, n_ids, CASE WHEN n_ids >= 500 THEN 'Large gap' WHEN n_ids >= 250 THEN 'Recommended' ELSE 'Usable' END AS priority,
        CASE WHEN first_id // 1000 = last_id // 1000 AND last_id % 1000 = 999 THEN 'Clean open sequence through the end of the ' || (first_id // 1000 * 1000) || '-series block.'
            WHEN (last_id + 1) % 1000 = 0 THEN 'Open gap immediately before the ' || ((last_id + 1) // 1000 * 1000) || '-series sequence begins.'
            WHEN first_id // 1000 = last_id // 1000 THEN 'Open block between existing ' || (first_id // 1000 * 1000) || '-series points; the next occupied point is ' || (last_id + 1) || '.'
            ELSE 'Open block between occupied points ' || (first_id - 1) || ' and ' || (last_id + 1) || '.' END AS notes FROM g
    UNION ALL SELECT (max({_NUMBERS}) // 1000 + 1) * 1000, NULL, NULL, 'Safest', '{_SAFEST}' FROM orders""",
)
def e20(spark, sf):
    return keyed.crew_ranges(table(spark, sf, "orders").selectExpr(f"{_NUMBERS} AS id"), "id")


@query(
    "d15_range_overlap",
    """WITH a AS (SELECT o_orderkey AS id, o_orderkey * 3 AS s, o_orderkey * 3 + o_custkey % 50 AS e FROM orders WHERE o_orderpriority = '1-URGENT'), b AS (SELECT o_orderkey AS id, o_orderkey * 3 + 1 AS s, o_orderkey * 3 + o_custkey % 40 + 1 AS e FROM orders WHERE o_orderpriority = '5-LOW')
    SELECT a.id AS id_a, b.id AS id_b, greatest(a.s, b.s) AS from_id, least(a.e, b.e) AS to_id FROM a JOIN b ON a.s <= b.e AND a.e >= b.s""",
)
def d15(spark, sf):
    side = lambda p, d, m: table(spark, sf, "orders").where(f"o_orderpriority = '{p}'").selectExpr("o_orderkey AS id", f"o_orderkey * 3 + {d} AS start_id", f"o_orderkey * 3 + o_custkey % {m} + {d} AS end_id")
    return keyed.overlaps(side("1-URGENT", 0, 50), side("5-LOW", 1, 40), 64)


@query(
    "l1_upsert",
    f"""WITH u AS (SELECT *, 1 AS v FROM {_BASE} UNION ALL SELECT *, 2 AS v FROM {_NEW}), n AS (SELECT *, row_number() OVER (PARTITION BY point_id ORDER BY v DESC) AS rn FROM u)
    SELECT point_id, {r('northing')} AS northing, description, v AS version FROM n WHERE rn = 1""",
)
def l1(spark, sf):
    old, new = (versions(spark, sf, s).select("point_id", "northing", "description", F.lit(v).alias("version")) for s, v in ((False, 1), (True, 2)))
    return keyed.upsert(old, new, "point_id", "version")


@query(
    "l2_edit_history",
    f"""SELECT a.point_id, 'description' AS field, a.description AS old_value, b.description AS new_value FROM {_BASE} a JOIN {_NEW} b USING (point_id) WHERE a.description IS DISTINCT FROM b.description""",
)
def l2(spark, sf):
    return keyed.edit_history(versions(spark, sf, False), versions(spark, sf, True), "point_id", "description")


@query("k8_stale_state", "SELECT user_id, event_type AS state, event_id AS as_of FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1")
def k8(spark, sf):
    rows = table(spark, sf, "events").selectExpr("user_id", "event_type AS state", "event_id AS as_of", "ts")
    return keyed.latest_event(rows, "user_id", F.struct("ts", "as_of"), "state", "as_of")


@query(
    "k12_decisions",
    "SELECT user_id, decision, event_id FROM (SELECT user_id, event_id, CASE WHEN event_type IN ('click', 'view') THEN 'ACCEPT' ELSE 'REJECT' END AS decision, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS rn FROM events WHERE event_id % 2 = 0) WHERE rn = 1",
)
def k12(spark, sf):
    rows = table(spark, sf, "events").where("event_id % 2 = 0").selectExpr("user_id", "event_id", "CASE WHEN event_type IN ('click', 'view') THEN 'ACCEPT' ELSE 'REJECT' END AS decision")
    return keyed.latest_event(rows, "user_id", F.col("event_id"), "decision", "event_id")


@query(
    "f16_hash_chain",
    """WITH e AS (SELECT user_id, event_id, event_type, CASE WHEN event_id % 701 = 5 THEN 'x' ELSE '' END AS prev0, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events),
    h AS (SELECT *, sha256('{"event_id":' || event_id || ',"event_type":"' || event_type || '"}') AS own FROM e), p AS (SELECT *, coalesce(lag(own) OVER (PARTITION BY user_id ORDER BY event_id), '') AS prev FROM h)
    SELECT user_id, count(*) AS n_events, min(CASE WHEN prev0 <> '' THEN event_id END) AS broken_at FROM p GROUP BY user_id""",
)
def f16(spark, sf):
    """The chain is stored first; every 701st event's stored link is damaged, and verification must name the first such event."""
    from pyspark.sql import Window

    rows = table(spark, sf, "events").select("user_id", "event_id", "event_type")
    w = Window.partitionBy("user_id").orderBy("event_id")
    own = F.sha2(F.to_json(F.struct("event_id", "event_type")), 256)
    linked = rows.withColumn("own", own).withColumn("prev_hash", F.coalesce(F.lag("own").over(w), F.lit("")))
    damaged = linked.withColumn("event_hash", F.col("own")).withColumn("prev_hash", F.when(F.col("event_id") % 701 == 5, F.lit("x")).otherwise(F.col("prev_hash")))
    linked_ok = F.coalesce(F.lag("event_hash").over(w), F.lit("")) == F.col("prev_hash")
    return damaged.withColumn("ok", linked_ok & (F.sha2(F.to_json(F.struct("event_id", "event_type")), 256) == F.col("event_hash"))).groupBy("user_id").agg(F.count(F.lit(1)).alias("n_events"), F.min(F.when(~F.col("ok"), F.col("event_id"))).alias("broken_at"))


@query("l7_orphans", "SELECT o_orderkey FROM orders WHERE o_custkey IS NOT NULL AND o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment <> 'BUILDING')")
def l7(spark, sf):
    return keyed.orphans(table(spark, sf, "orders").select("o_orderkey", "o_custkey"), table(spark, sf, "customer").where("c_mktsegment <> 'BUILDING'"), "o_custkey", "c_custkey").select("o_orderkey")


@query("e31_zero_filled", "SELECT v AS event_type, count(event_id) AS n FROM (VALUES ('click'), ('error'), ('merge'), ('view')) t(v) LEFT JOIN events ON event_type = v GROUP BY v")
def e31(spark, sf):
    return keyed.zero_filled(table(spark, sf, "events"), "event_type", ("click", "error", "merge", "view"))


@query(
    "d13_active_lookup",
    f"""WITH s AS (SELECT * FROM {_REVISED}), m AS (SELECT object_id, max(revision) AS latest FROM s GROUP BY 1) SELECT c_custkey, latest, {r(f'c_acctbal * {FOOT_SQL}')} AS balance FROM customer LEFT JOIN m ON object_id = c_custkey""",
)
def d13(spark, sf):
    rows = keyed.revisions(table(spark, sf, "orders").selectExpr("o_custkey AS object_id", "o_orderkey AS solution"), "object_id", "solution")
    latest = keyed.active_or_latest(rows, rows.limit(0).select("object_id", "revision"), "object_id").selectExpr("object_id AS c_custkey", "revision AS latest")
    return table(spark, sf, "customer").join(latest, "c_custkey", "left").selectExpr("c_custkey", "latest", "c_acctbal * (1200.0D / 3937.0D) AS balance")
