"""Queries of the control operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.functions import ids
from plumbline.operators import control
from plumbline.plans.bindings import CONTROL, READ_SHOTS, SHOTS, control_observations, query, r, read_shots, shots

_W = "CASE WHEN h_sigma > 0 THEN 1 / (h_sigma * h_sigma) ELSE 1 END"
_V = "CASE WHEN v_sigma > 0 THEN 1 / (v_sigma * v_sigma) ELSE 1 END"


def _solution_sql(means: str) -> str:
    return f"""WITH o AS (SELECT * FROM {CONTROL} WHERE include), m AS (SELECT control_id, count(*) AS n, {means} FROM o GROUP BY control_id),
    e AS (SELECT control_id, max(sqrt((northing - mean_n) ** 2 + (easting - mean_e) ** 2)) AS max_h, max(abs(elevation - mean_z)) AS max_dz,
        bool_and(sqrt((northing - mean_n) ** 2 + (easting - mean_e) ** 2) <= 5000 AND (elevation - mean_z IS NULL OR abs(elevation - mean_z) <= 0.7)) AS passes FROM o JOIN m USING (control_id) GROUP BY control_id)
    SELECT control_id, n, {r('mean_n')} AS mean_n, {r('mean_e')} AS mean_e, {r('mean_z')} AS mean_z, {r('max_h')} AS max_h, {r('max_dz')} AS max_dz, passes FROM m JOIN e USING (control_id)"""


_PLAIN = "avg(northing) AS mean_n, avg(easting) AS mean_e, avg(elevation) AS mean_z"
_WEIGHTED = f"sum({_W} * northing) / sum({_W}) AS mean_n, sum({_W} * easting) / sum({_W}) AS mean_e, sum({_V} * elevation) / sum({_V}) AS mean_z"


@query("e1_control_arith", _solution_sql(_PLAIN))
def e1(spark, sf):
    return control.control_solutions(control_observations(spark, sf), htol=5000, vtol=0.7)


@query("e2_control_weighted", _solution_sql(_WEIGHTED))
def e2(spark, sf):
    return control.control_solutions(control_observations(spark, sf), weighted=True, htol=5000, vtol=0.7)


@query(
    "e1_control_residuals",
    f"""WITH o AS (SELECT * FROM {CONTROL} WHERE include), m AS (SELECT control_id, {_PLAIN} FROM o GROUP BY control_id)
    SELECT control_id, observation_id, {r('northing - mean_n')} AS dn, {r('easting - mean_e')} AS de, {r('sqrt((northing - mean_n) ** 2 + (easting - mean_e) ** 2)')} AS h, {r('elevation - mean_z')} AS dz
    FROM o JOIN m USING (control_id)""",
)
def e1_residuals(spark, sf):
    return control.control_residuals(control_observations(spark, sf))


@query(
    "e3_three_shot",
    f"""WITH o AS (SELECT *, count(*) OVER w AS n, count(elevation) OVER w AS nz FROM {SHOTS} WINDOW w AS (PARTITION BY control_id)),
    t AS (SELECT *, row_number() OVER (PARTITION BY control_id ORDER BY observed, observation_id) AS shot, elevation - avg(elevation) OVER (PARTITION BY control_id) AS z FROM o WHERE n = 3 AND nz = 3)
    SELECT control_id, observation_id, CAST(shot AS INTEGER) AS shot, {r('northing - avg(northing) OVER (PARTITION BY control_id)')} AS d_northing,
        {r('easting - avg(easting) OVER (PARTITION BY control_id)')} AS d_easting, {r('CASE WHEN shot = 3 THEN -z ELSE z END')} AS d_elevation FROM t""",
)
def e3(spark, sf):
    return control.three_shot_profile(shots(spark, sf).withColumn("include", F.lit(True)))


@query(
    "e4_analyze_all",
    f"""WITH s AS ({_solution_sql(_PLAIN)}) SELECT control_id, n, max_h, max_dz, CASE WHEN n < 20 THEN 'INSUFFICIENT_SHOTS' WHEN passes THEN 'PASS' ELSE 'REVIEW' END AS status FROM s""",
)
def e4(spark, sf):
    return control.analyse_all(control_observations(spark, sf), least=20, htol=5000, vtol=0.7)


@query(
    "e5_control_summary",
    f"""SELECT control_id, count(*) AS observations, CAST(count(*) FILTER (include) AS BIGINT) AS included, min(observed) AS first_seen, max(observed) AS last_seen,
        CASE WHEN control_id % 3 = 0 THEN control_id % 5 + 1 END AS latest_revision FROM {CONTROL} GROUP BY control_id""",
)
def e5(spark, sf):
    obs = control_observations(spark, sf)
    solutions = obs.where("control_id % 3 = 0").select("control_id").distinct().select("control_id", F.explode(F.sequence(F.lit(1).cast("long"), F.col("control_id") % 5 + 1)).alias("revision"))
    return control.control_summary(obs, solutions)


_TRIPLETS = f"""WITH o AS (SELECT *, row_number() OVER (PARTITION BY control_id ORDER BY observed, observation_id) AS ord, count(*) OVER (PARTITION BY control_id) AS n,
        CASE WHEN (epoch_count IS NOT NULL OR duration_seconds IS NOT NULL) AND NOT (coalesce(epoch_count >= 300, false) OR coalesce(duration_seconds >= 300, false)) THEN 1 ELSE 0 END + CASE WHEN satellite_count < 5 THEN 1 ELSE 0 END + CASE WHEN pdop > 46 THEN 1 ELSE 0 END AS failed,
        CASE WHEN epoch_count IS NULL AND duration_seconds IS NULL THEN 1 ELSE 0 END + CASE WHEN satellite_count IS NULL THEN 1 ELSE 0 END AS lacking FROM {READ_SHOTS}),
    t AS (SELECT a.control_id, a.n, a.observation_id AS id_a, b.observation_id AS id_b, c.observation_id AS id_c, (a.northing + b.northing + c.northing) / 3 AS mn, (a.easting + b.easting + c.easting) / 3 AS me,
        (a.elevation + b.elevation + c.elevation) / 3 AS mz, a.northing AS n1, b.northing AS n2, c.northing AS n3, a.easting AS e1, b.easting AS e2, c.easting AS e3, a.elevation AS z1, b.elevation AS z2, c.elevation AS z3,
        least(abs(date_diff('second', a.observed, b.observed)), abs(date_diff('second', b.observed, c.observed)), abs(date_diff('second', a.observed, c.observed))) / CAST(60 AS DOUBLE) AS gap, a.failed + b.failed + c.failed AS failures, a.lacking + b.lacking + c.lacking AS missing
        FROM o a JOIN o b ON a.control_id = b.control_id AND a.ord < b.ord JOIN o c ON a.control_id = c.control_id AND b.ord < c.ord),
    u AS (SELECT *, sqrt((n1 - mn) ** 2 + (e1 - me) ** 2) AS h1, sqrt((n2 - mn) ** 2 + (e2 - me) ** 2) AS h2, sqrt((n3 - mn) ** 2 + (e3 - me) ** 2) AS h3, abs(z1 - mz) AS v1, abs(z2 - mz) AS v2, abs(z3 - mz) AS v3 FROM t),
    x AS (SELECT *, greatest(h1, h2, h3) AS max_h, CASE WHEN mz IS NOT NULL THEN greatest(v1, v2, v3) END AS max_v, sqrt((h1 * h1 + h2 * h2 + h3 * h3) / 3) AS rms_h, sqrt((v1 * v1 + v2 * v2 + v3 * v3) / 3) AS rms_v FROM u),
    y AS (SELECT *, coalesce(max_h <= 0.15 AND max_v <= 0.15, false) AS coordinate_pass, CASE WHEN failures > 0 OR coalesce(gap < 60 - 1e-9, false) THEN 'FAIL' WHEN missing > 0 OR gap IS NULL THEN 'UNVERIFIED' ELSE 'PASS' END AS field_status FROM x),
    z AS (SELECT *, coordinate_pass AND field_status <> 'FAIL' AS passes FROM y),
    q AS (SELECT *, row_number() OVER (PARTITION BY control_id ORDER BY CASE WHEN passes THEN 0 ELSE 1 END, CASE field_status WHEN 'PASS' THEN 0 WHEN 'UNVERIFIED' THEN 1 ELSE 2 END,
        greatest(max_h / 0.15, coalesce(max_v / 0.15, 'inf'::DOUBLE)), max_h, coalesce(max_v, 'inf'::DOUBLE), rms_h, CASE WHEN rms_v = 0 THEN 'inf'::DOUBLE ELSE coalesce(rms_v, 'inf'::DOUBLE) END, id_a, id_b, id_c) AS rank FROM z)"""


@query(
    "d21_best_triplet",
    _TRIPLETS
    + f""", s AS (SELECT control_id, count(*) AS n FROM {READ_SHOTS} GROUP BY control_id)
    SELECT s.control_id, s.n, id_a, id_b, id_c, {r('max_h')} AS max_h, {r('max_v')} AS max_v, field_status, CASE WHEN s.n < 3 THEN 'RESHOOT' WHEN passes THEN 'PASS' ELSE 'RESHOOT' END AS status
    FROM s LEFT JOIN (SELECT * FROM q WHERE rank = 1) q ON s.control_id = q.control_id""",
)
def d21(spark, sf):
    return control.best_triplets(read_shots(spark, sf), htol=0.15, vtol=0.15, most_pdop=46)


@query("g2_top_alternatives", _TRIPLETS + f" SELECT control_id, CAST(rank AS INTEGER) AS rank, id_a, id_b, id_c, {r('max_h')} AS max_h, passes FROM q WHERE rank <= 10")
def g2(spark, sf):
    return control.ranked_triplets(read_shots(spark, sf), htol=0.15, vtol=0.15, most_pdop=46, top=10).select("control_id", "rank", "id_a", "id_b", "id_c", "max_h", "passes")


_QC = (
    _TRIPLETS
    + f""", s AS (SELECT control_id, count(*) AS n FROM {READ_SHOTS} GROUP BY control_id),
    d AS (SELECT s.control_id, s.n AS shots, q.*, CASE WHEN s.n < 3 THEN 'RESHOOT' WHEN passes THEN 'PASS' ELSE 'RESHOOT' END AS status FROM s LEFT JOIN (SELECT * EXCLUDE (control_id, n), control_id AS own FROM q WHERE rank = 1) q ON s.control_id = q.own)"""
)


@query(
    "b4_accepted_control",
    _QC
    + f""", e AS (SELECT control_id, unnest([1, 2, 3]) AS k, unnest([id_a, id_b, id_c]) AS observation_id FROM d WHERE status = 'PASS'),
    g AS (SELECT e.control_id, string_agg(point_id, ';' ORDER BY k) AS source_observations, max(CASE WHEN k = 1 THEN description END) AS c1, max(CASE WHEN k = 2 THEN description END) AS c2, max(CASE WHEN k = 3 THEN description END) AS c3 FROM e JOIN {READ_SHOTS} o ON o.observation_id = e.observation_id GROUP BY 1)
    SELECT d.control_id, {r('mn')} AS northing, {r('me')} AS easting, {r('mz')} AS elevation, array_to_string(list_filter([c1, CASE WHEN c2 <> c1 THEN c2 ELSE '' END, CASE WHEN c3 <> c1 AND c3 <> c2 THEN c3 ELSE '' END], lambda x: x <> ''), ';') AS code, {r('max_h')} AS horizontal_residual, {r('max_v')} AS vertical_residual,
        source_observations, field_status AS field_qc_status, {r('gap')} AS minimum_time_gap_minutes, status AS qc_status FROM d JOIN g ON d.control_id = g.control_id""",
)
def b4_accepted(spark, sf):
    obs = read_shots(spark, sf)
    return control.accepted_control(control.control_qc(obs, htol=0.15, vtol=0.15, most_pdop=46), obs)


@query(
    "b4_reshoot_control",
    _QC
    + f""", h AS (SELECT control_id, string_agg(DISTINCT point_id, ';' ORDER BY point_id) AS existing_shots, max(ascii(right(point_id, 1)) - 64) AS top FROM {READ_SHOTS} GROUP BY 1)
    SELECT d.control_id, status, CASE WHEN shots < 3 THEN 'FEWER_THAN_THREE_SHOTS' WHEN NOT coordinate_pass THEN 'OUT_OF_TOLERANCE' ELSE 'FIELD_CHECKS' END AS reason, existing_shots,
        d.control_id || chr(CAST(65 + top AS INTEGER)) || ';' || d.control_id || chr(CAST(66 + top AS INTEGER)) || ';' || d.control_id || chr(CAST(67 + top AS INTEGER)) AS next_shots, field_status AS field_qc_status,
        CAST(failures AS BIGINT) AS field_failures, CAST(missing AS BIGINT) AS missing_field_metadata, {r('max_h')} AS horizontal_residual, {r('max_v')} AS vertical_residual FROM d JOIN h ON h.control_id = d.control_id WHERE status <> 'PASS'""",
)
def b4_reshoot(spark, sf):
    obs = read_shots(spark, sf)
    return control.reshoot_control(control.control_qc(obs, htol=0.15, vtol=0.15, most_pdop=46), obs)


_SHOTS_READ = """user_id AS control_id, CASE WHEN event_id % 5 = 0 THEN NULL ELSE 200 + event_id * 7 % 600 END AS epoch_count, CASE WHEN event_id % 3 = 0 THEN NULL ELSE 100 + value * 10 END AS duration_seconds,
    CASE WHEN event_id % 41 = 0 THEN NULL ELSE 4 + event_id % 12 END AS satellite_count, value / 20 AS pdop"""


@query(
    "e7_field_checks",
    f"""WITH o AS (SELECT {_SHOTS_READ}, CASE WHEN event_id % 31 = 0 THEN NULL ELSE ts END AS seen FROM events),
    c AS (SELECT *, CASE WHEN epoch_count IS NOT NULL OR duration_seconds IS NOT NULL THEN coalesce(epoch_count >= 300, false) OR coalesce(duration_seconds >= 300, false) END AS a, satellite_count >= 5 AS b, epoch(date_trunc('second', seen)) AS s FROM o),
    g AS (SELECT *, s - lag(s) OVER (PARTITION BY control_id ORDER BY s) AS step FROM c),
    t AS (SELECT control_id, count(*) AS shots, sum(CASE WHEN NOT a THEN 1 ELSE 0 END + CASE WHEN NOT b THEN 1 ELSE 0 END) AS f, sum(CASE WHEN a IS NULL THEN 1 ELSE 0 END + CASE WHEN b IS NULL THEN 1 ELSE 0 END) AS m, count(s) AS timed, min(step) AS step FROM g GROUP BY 1),
    v AS (SELECT *, shots = timed AND shots >= 2 AS verified FROM t), w AS (SELECT *, CASE WHEN verified THEN step / 60 END AS gap FROM v), x AS (SELECT *, f + CASE WHEN gap + 1e-9 < 60 THEN 1 ELSE 0 END AS failures, m + shots - timed AS missing FROM w)
    SELECT control_id, shots, CAST(failures AS BIGINT) AS failures, CAST(missing AS BIGINT) AS missing, {r('CAST(gap AS DOUBLE)')} AS least_gap_minutes, CASE WHEN failures > 0 THEN 'FAIL' WHEN missing = 0 AND verified THEN 'PASS' ELSE 'UNVERIFIED' END AS field_status FROM x""",
)
def e7(spark, sf):
    from plumbline.plans.quality_queries import _split

    observed = "CASE WHEN event_id % 31 = 0 THEN NULL ELSE date_format(ts, 'yyyy-MM-dd HH:mm:ss') END AS observed"
    return control.field_checks(spark.read.parquet(f"{sf}/events.parquet").selectExpr(*_split(_SHOTS_READ), observed))


@query("flagship_control_qc", _solution_sql(_WEIGHTED))
def flagship(spark, sf):
    return control.control_solutions(control_observations(spark, sf), weighted=True, htol=5000, vtol=0.7)


_LABELS = "SELECT o_custkey AS control, o_orderkey, chr(CAST(65 + row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) % 26 AS INTEGER)) AS letter FROM orders"


@query(
    "f14_reshoot_labels",
    f"""WITH p AS ({_LABELS}), t AS (SELECT control, max(ascii(letter) - 64) AS top FROM p GROUP BY control)
    SELECT control, array_to_string([control || CASE WHEN top + k > 26 THEN 'A' || chr(CAST(64 + top + k - 26 AS INTEGER)) ELSE chr(CAST(64 + top + k AS INTEGER)) END for k in [1, 2, 3]], ',') AS labels FROM t""",
)
def f14(spark, sf):
    spark.read.parquet(f"{sf}/orders.parquet").createOrReplaceTempView("plumbline_orders")
    rows = spark.sql("SELECT o_custkey AS control, chr(65 + row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) % 26) AS letter FROM plumbline_orders")
    grouped = rows.groupBy("control").agg(F.collect_set("letter").alias("letters"))
    return grouped.select("control", F.array_join(ids.next_reshoot_labels(F.col("control").cast("string"), F.col("letters"), 3), ",").alias("labels"))


@query(
    "i1_base_id",
    """WITH p AS (SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN o_custkey || 'ab' WHEN 1 THEN o_custkey || '' WHEN 2 THEN 'CP-' || o_custkey || 'C' ELSE 'BASE' END AS id FROM orders)
    SELECT o_orderkey, id, CASE WHEN regexp_matches(id, '^(.*\\d)([A-Za-z]+)$') THEN regexp_extract(id, '^(.*\\d)([A-Za-z]+)$', 1) ELSE id END AS base, upper(regexp_extract(id, '^(.*\\d)([A-Za-z]+)$', 2)) AS suffix FROM p""",
)
def i1(spark, sf):
    rows = spark.read.parquet(f"{sf}/orders.parquet").selectExpr("o_orderkey", "CASE o_orderkey % 4 WHEN 0 THEN concat(o_custkey, 'ab') WHEN 1 THEN concat(o_custkey, '') WHEN 2 THEN concat('CP-', o_custkey, 'C') ELSE 'BASE' END AS id")
    base = ids.base_control_id(F.col("id"))
    return rows.select("o_orderkey", "id", base.alias("base"), ids.shot_suffix(F.col("id"), base).alias("suffix"))


@query(
    "d2_import_overlap",
    f"""WITH a AS (SELECT * FROM {CONTROL}), b AS (SELECT * FROM {CONTROL} WHERE include)
    SELECT b.point_id, count(*) AS matches, CASE WHEN bool_or(abs(a.northing - b.northing) <= 1e-9 AND abs(a.easting - b.easting) <= 1e-9 AND abs(a.elevation - b.elevation) <= 1e-9) THEN 'exact' ELSE 'conflict' END AS overlap
    FROM b JOIN a ON lower(trim(a.point_id)) = lower(trim(b.point_id)) GROUP BY b.point_id""",
)
def d2(spark, sf):
    obs = control_observations(spark, sf)
    return control.import_overlap(obs, obs.where("include"))


@query(
    "d2_import_overlap_all",
    f"""WITH b AS (SELECT point_id, CASE WHEN control_id % 3 = 0 THEN northing + 1 ELSE northing END AS northing, easting, elevation FROM {CONTROL})
    SELECT b.point_id, count(*) AS matches, CASE WHEN bool_or(abs(a.northing - b.northing) <= 1e-9 AND abs(a.easting - b.easting) <= 1e-9 AND abs(a.elevation - b.elevation) <= 1e-9) THEN 'exact' ELSE 'conflict' END AS overlap
    FROM b JOIN {CONTROL} a ON lower(trim(a.point_id)) = lower(trim(b.point_id)) GROUP BY b.point_id""",
)
def d2_all(spark, sf):
    """All rows against all rows; those of every third control come in a metre off."""
    obs = control_observations(spark, sf)
    moved = F.when(F.col("control_id") % 3 == 0, F.col("northing") + 1).otherwise(F.col("northing"))
    return control.import_overlap(obs, obs.withColumn("northing", moved))


@query(
    "l4_idempotent_insert",
    f"""WITH k AS (SELECT *, round(northing, 9) AS kn, round(easting, 9) AS ke, round(elevation, 9) AS kz FROM {CONTROL}), b AS (SELECT * FROM k WHERE NOT include),
    f AS (SELECT *, row_number() OVER (PARTITION BY point_id, kn, ke, kz ORDER BY observation_id) AS rn FROM k)
    SELECT control_id, observation_id FROM f WHERE rn = 1 AND NOT EXISTS (SELECT 1 FROM b WHERE b.point_id = f.point_id AND b.kn = f.kn AND b.ke = f.ke AND b.kz = f.kz)""",
)
def l4(spark, sf):
    obs = control_observations(spark, sf)
    return control.new_observations(obs.where("not include"), obs).select("control_id", "observation_id")
