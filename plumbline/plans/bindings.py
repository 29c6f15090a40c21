"""Survey relations made from the given tables, and the SQL of the same relations."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed value: metres in a US survey foot; it keeps bound coordinates off decimal ties, so rounding agrees everywhere.
FOOT = "(1200.0D / 3937.0D)"
FOOT_SQL = "(CAST(1200.0 AS DOUBLE) / CAST(3937.0 AS DOUBLE))"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(df: DataFrame, places: int = 4) -> DataFrame:
    """Doubles to ``places`` decimals, so that the order of sums doesn't show."""
    return df.select(*[(F.round(c, places) + F.lit(0.0)).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes])


def r(expression: str, places: int = 4) -> str:
    """SQL of the same rounding."""
    return f"(round({expression}, {places}) + 0.0)"


def query(name: str, sql: str | None = None):
    """Register a query by name, with its SQL."""

    def put(f):
        QUERIES[name] = lambda spark, sf_dir: rounded(f(spark, sf_dir))
        QUERIES[name].__doc__ = f.__doc__
        if sql is not None:
            ORACLE_SQL[name] = sql
        return f

    return put


def control_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").selectExpr(
        "l_partkey AS control_id", "concat_ws('-', l_orderkey, l_linenumber, l_suppkey) AS observation_id", "concat('P', l_partkey) AS point_id",
        f"l_extendedprice * {FOOT} AS northing", f"l_quantity * {FOOT} AS easting", f"l_discount * 10 * {FOOT} AS elevation", "l_tax + 0.01D AS h_sigma", "l_tax + 0.02D AS v_sigma",
        "l_returnflag <> 'R' AS include", "l_shipdate AS observed",
    )


CONTROL = f"""(SELECT l_partkey AS control_id, concat_ws('-', l_orderkey, l_linenumber, l_suppkey) AS observation_id, 'P' || l_partkey AS point_id,
    l_extendedprice * {FOOT_SQL} AS northing, l_quantity * {FOOT_SQL} AS easting, l_discount * 10 * {FOOT_SQL} AS elevation,
    l_tax + CAST(0.01 AS DOUBLE) AS h_sigma, l_tax + CAST(0.02 AS DOUBLE) AS v_sigma, l_returnflag <> 'R' AS include, l_shipdate AS observed FROM lineitem)"""


def shots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated shots: orders of a customer."""
    return table(spark, sf_dir, "orders").selectExpr(
        "o_custkey AS control_id", "o_orderkey AS observation_id", f"(o_totalprice % 97) * {FOOT} / 100 AS northing", f"(o_totalprice % 89) * {FOOT} / 100 AS easting",
        f"CASE WHEN o_orderkey % 17 = 0 THEN NULL ELSE (o_totalprice % 83) * {FOOT} / 100 END AS elevation", "o_orderdate AS observed",
    )


SHOTS = f"""(SELECT o_custkey AS control_id, o_orderkey AS observation_id, (o_totalprice % 97) * {FOOT_SQL} / 100 AS northing, (o_totalprice % 89) * {FOOT_SQL} / 100 AS easting,
    CASE WHEN o_orderkey % 17 = 0 THEN NULL ELSE (o_totalprice % 83) * {FOOT_SQL} / 100 END AS elevation, o_orderdate AS observed FROM orders)"""


_SHOT_COLUMNS = [
    "o_custkey AS control_id", "o_orderkey AS observation_id", "(o_totalprice % 97) * {FOOT} / 100 AS northing", "(o_totalprice % 89) * {FOOT} / 100 AS easting",
    "CASE WHEN o_orderkey % 17 = 0 THEN NULL ELSE (o_totalprice % 83) * {FOOT} / 100 END AS elevation", "o_orderdate AS observed",
    "CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE 280 + o_orderkey * 7 % 600 END AS epoch_count", "CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE 290 + o_orderkey % 40 END AS duration_seconds",
    "CASE WHEN o_orderkey % 29 = 0 THEN NULL ELSE 4 + o_orderkey % 12 END AS satellite_count", "o_orderkey % 50 AS pdop",
    "concat('', o_custkey, CASE o_orderkey % 4 WHEN 0 THEN 'A' WHEN 1 THEN 'B' WHEN 2 THEN 'C' ELSE 'D' END) AS point_id", "CASE o_orderkey % 4 WHEN 0 THEN 'CP' WHEN 1 THEN 'NAIL' ELSE '' END AS description",
]


def read_shots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated shots with what a receiver tells of them."""
    return table(spark, sf_dir, "orders").selectExpr(*[c.replace("{FOOT}", FOOT) for c in _SHOT_COLUMNS])


READ_SHOTS = f"(SELECT {', '.join(_SHOT_COLUMNS).replace('{FOOT}', FOOT_SQL)} FROM orders)"


def sights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Level rows: events of a user."""
    return table(spark, sf_dir, "events").selectExpr(
        "user_id AS run_id", "event_id AS seq", f"1 + (value % 7) * {FOOT} AS backsight", f"1 + (value % 5) * {FOOT} AS foresight",
        f"10 + value * {FOOT} AS distance_bs", f"10 + (value % 11) * {FOOT} AS distance_fs",
    )


SIGHTS = f"""(SELECT user_id AS run_id, event_id AS seq, 1 + (value % 7) * {FOOT_SQL} AS backsight, 1 + (value % 5) * {FOOT_SQL} AS foresight,
    10 + value * {FOOT_SQL} AS distance_bs, 10 + (value % 11) * {FOOT_SQL} AS distance_fs FROM events)"""


def courses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr("user_id AS run_id", "event_id AS seq", f"(value * 37 * {FOOT}) % 360 AS azimuth_deg", f"1 + value * {FOOT} AS distance")


COURSES = f"(SELECT user_id AS run_id, event_id AS seq, (value * 37 * {FOOT_SQL}) % 360 AS azimuth_deg, 1 + value * {FOOT_SQL} AS distance FROM events)"


def places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points: the first three numbers of vectors, as metres."""
    return table(spark, sf_dir, "embeddings").selectExpr(
        "vec_id AS point_id", "CAST(embedding[0] AS DOUBLE) * 1000 AS northing", "CAST(embedding[1] AS DOUBLE) * 1000 AS easting", "CAST(embedding[2] AS DOUBLE) * 10 AS elevation", "CAST(label AS BIGINT) AS label",
    )


PLACES = """(SELECT vec_id AS point_id, CAST(embedding[1] AS DOUBLE) * 1000 AS northing, CAST(embedding[2] AS DOUBLE) * 1000 AS easting, CAST(embedding[3] AS DOUBLE) * 10 AS elevation,
    CAST(label AS BIGINT) AS label FROM embeddings)"""


def versions(spark: SparkSession, sf_dir: str, second: bool) -> DataFrame:
    """Two states of one point table: orders, of which the second leaves some out, adds some, and moves some."""
    rows = table(spark, sf_dir, "orders").where("o_orderkey % 11 <> 1" if second else "o_orderkey % 13 <> 1")
    shift = "CASE WHEN o_orderkey % 7 = 0 THEN 0.5D ELSE 0.0D END" if second else "0.0D"
    return rows.selectExpr("o_orderkey AS point_id", f"o_totalprice * {FOOT} + {shift} AS northing", f"o_custkey * {FOOT} AS easting", "CAST(NULL AS DOUBLE) AS elevation", ("CASE WHEN o_orderkey % 19 = 0 THEN 'moved' ELSE o_orderpriority END" if second else "o_orderpriority") + " AS description")


def version_sql(second: bool) -> str:
    shift = "CASE WHEN o_orderkey % 7 = 0 THEN CAST(0.5 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END" if second else "CAST(0 AS DOUBLE)"
    text = "CASE WHEN o_orderkey % 19 = 0 THEN 'moved' ELSE o_orderpriority END" if second else "o_orderpriority"
    return f"(SELECT o_orderkey AS point_id, o_totalprice * {FOOT_SQL} + {shift} AS northing, o_custkey * {FOOT_SQL} AS easting, CAST(NULL AS DOUBLE) AS elevation, {text} AS description FROM orders WHERE o_orderkey % {11 if second else 13} <> 1)"
