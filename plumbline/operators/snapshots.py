"""Operators on states of a project: point issues, undo and redo, moved interpretations, regrouping and timelines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.ids import base_control_id

#: Units in which elevation jumps can be judged.
KNOWN_UNITS = ("us_survey_feet", "international_feet", "meters")


def _finite(name: str) -> Column:
    return F.when(~F.isnan(name) & (F.abs(F.col(name)) < F.lit(float("inf"))), F.col(name))


def point_issues(points: DataFrame, crs: str, horizontal: str, vertical: str, jump: float = 2.0, distance: float = 50.0) -> DataFrame:
    """One row for each point that an issue names: kind, severity, point_uuid, value.

    missing_xy, missing_z (null or not finite), coordinate_context (another
    CRS or other units than the project's), duplicate_id (``value``: how many
    records share the id), and elevation_jump: between consecutive records
    (by ``seq``) of the same source and description, both complete and in the
    project's context, at most ``distance`` apart and ``jump`` or more
    different in elevation (``value``: the difference).  Jumps need known
    units.  The result is a report of all rows, without a cap.
    """
    p = points.withColumns({c: _finite(c) for c in ("northing", "easting", "elevation")})
    fits = F.col("crs").eqNullSafe(F.lit(crs)) & F.col("horizontal_units").eqNullSafe(F.lit(horizontal)) & F.col("vertical_units").eqNullSafe(F.lit(vertical))
    p = p.withColumn("_fits", fits)
    own = F.array_compact(F.array(
        F.when(F.col("northing").isNull() | F.col("easting").isNull(), F.struct(F.lit("missing_xy").alias("kind"), F.lit("ERROR").alias("severity"))),
        F.when(F.col("elevation").isNull(), F.struct(F.lit("missing_z").alias("kind"), F.lit("WARN").alias("severity"))),
        F.when(~F.col("_fits"), F.struct(F.lit("coordinate_context").alias("kind"), F.lit("ERROR").alias("severity"))),
    ))
    single = p.select("point_uuid", F.explode(own).alias("i")).select("i.kind", "i.severity", "point_uuid", F.lit(None).cast("double").alias("value"))
    shared = p.groupBy("point_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    again = p.where("point_id is not null").join(shared, "point_id").select(F.lit("duplicate_id").alias("kind"), F.lit("ERROR").alias("severity"), "point_uuid", F.col("n").cast("double").alias("value"))
    found = single.unionByName(again)
    if horizontal not in KNOWN_UNITS or vertical not in KNOWN_UNITS:
        return found
    w = Window.partitionBy("source_id", "description").orderBy("seq")
    usable = F.col("_fits") & F.col("northing").isNotNull() & F.col("easting").isNotNull() & F.col("elevation").isNotNull()
    here = F.when(usable, F.struct("northing", "easting", "elevation"))
    rows = p.where("source_id <> '' and description <> ''").select("point_uuid", here.alias("a"), F.lag(here).over(w).alias("b"))
    dz = F.col("a.elevation") - F.col("b.elevation")
    gap = F.sqrt((F.col("a.northing") - F.col("b.northing")) ** 2 + (F.col("a.easting") - F.col("b.easting")) ** 2)
    jumps = rows.where((gap <= distance) & (F.abs(dz) >= jump)).select(F.lit("elevation_jump").alias("kind"), F.lit("WARN").alias("severity"), "point_uuid", dz.alias("value"))
    return found.unionByName(jumps)


def replayed(log: DataFrame) -> DataFrame:
    """The value of each key after a log of edits with undo and redo: project_id, key, value.

    ``log`` has project_id, seq, action (do, undo, redo), key, before, after;
    the last three are read from ``do`` rows.  A new edit forgets what could
    be redone.  The stack is not simulated: after each row its depth is a
    running sum, and what stands at the end is the last edit made at each
    level up to the last depth.  A key without a standing edit has the value
    before its first one.
    """
    w = Window.partitionBy("project_id").orderBy("seq")
    whole = Window.partitionBy("project_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    step = F.when(F.col("action") == "undo", -1).otherwise(1)
    rows = log.withColumn("level", F.sum(step).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumn("depth", F.last("level").over(whole)).where("action = 'do'")
    latest = F.row_number().over(Window.partitionBy("project_id", "level").orderBy(F.desc("seq"))) == 1
    rows = rows.withColumn("stands", latest & (F.col("level") <= F.col("depth")))
    at = F.when(F.col("stands"), F.col("seq"))
    held = rows.groupBy("project_id", "key").agg(F.max_by(F.struct("after"), at).alias("now"), F.min_by(F.struct("before"), "seq").alias("first"))
    return held.select("project_id", "key", F.when(F.col("now").isNotNull(), F.col("now.after")).otherwise(F.col("first.before")).alias("value"))


def reassigned(results: DataFrame, moves: DataFrame, *evidence: str) -> DataFrame:
    """``results`` with the ``evidence`` columns moved from one point to another; other columns stay with their point.

    ``moves`` has source_id and target_id.  A move counts if both points
    exist and differ, the source has evidence and the target has none; of
    several moves to a target or from a source, the smallest ids count.  Adds
    ``moved_from``.
    """
    has = F.coalesce(*[F.col(c).cast("string") for c in evidence]).isNotNull()
    points = results.select(F.col("point_id"), has.alias("has"))
    asked = moves.where("source_id <> target_id").join(points.selectExpr("point_id AS source_id", "has AS s"), "source_id").join(points.selectExpr("point_id AS target_id", "has AS t"), "target_id").where("s and not t")
    one = asked.groupBy("target_id").agg(F.min("source_id").alias("source_id"))
    one = one.groupBy("source_id").agg(F.min("target_id").alias("target_id"))
    given = one.join(results.select(F.col("point_id").alias("source_id"), F.struct(*evidence).alias("given")), "source_id").select(F.col("target_id").alias("point_id"), "given", F.col("source_id").alias("moved_from"))
    gone = one.select(F.col("source_id").alias("point_id"), F.lit(True).alias("gone"))
    joined = results.join(given, "point_id", "left").join(gone, "point_id", "left")
    value = lambda c: F.when(F.col("moved_from").isNotNull(), F.col(f"given.{c}")).when(F.col("gone").isNull(), F.col(c)).alias(c)
    return joined.select(*[value(c) if c in evidence else F.col(c) for c in results.columns], "moved_from")


def regrouped(observations: DataFrame) -> DataFrame:
    """Observations whose control id isn't the base of their point id: observation_id, control_id, canonical_id."""
    base = base_control_id(F.when(F.coalesce(F.trim("point_id"), F.lit("")) != "", F.col("point_id")).otherwise(F.col("control_id")))
    return observations.select("observation_id", "control_id", base.alias("canonical_id")).where("canonical_id <> '' and not canonical_id <=> control_id")


def timeline(log: DataFrame, labels: DataFrame, most: int = 250) -> DataFrame:
    """The newest ``most`` events by seq, with a label for their action; an action without one is spelled out."""
    newest = log.orderBy(F.desc("seq")).limit(most)
    return newest.join(labels, "action", "left").select("seq", "action", F.coalesce("label", F.initcap(F.replace(F.col("action"), F.lit("_"), F.lit(" ")))).alias("label"))
