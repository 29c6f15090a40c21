"""Operators on keyed rows: revisions, latest rows, differences, gaps, overlaps, upserts and event chains."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def revisions(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """Rows numbered 1, 2, ... within their key in the given order."""
    return rows.withColumn("revision", F.row_number().over(Window.partitionBy(key).orderBy(*order)).cast("long"))


def active_or_latest(solutions: DataFrame, selections: DataFrame, key: str) -> DataFrame:
    """One row a key: the selected revision if that exists, else the newest.  ``selections`` has the key and ``revision``."""
    chosen = selections.select(key, F.col("revision").alias("selected"))
    best = F.struct((F.col("revision") == F.col("selected")).cast("int"), F.col("revision"))
    joined = solutions.join(chosen, key, "left")
    columns = [c for c in solutions.columns if c != key]
    return joined.groupBy(key).agg(F.max_by(F.struct(*columns), F.struct(F.coalesce(best["col1"], F.lit(0)), best["revision"])).alias("row")).select(key, "row.*")


def point_diff(base: DataFrame, revised: DataFrame, htol: float = 0.001, vtol: float = 0.001) -> DataFrame:
    """Added, removed, changed or unchanged by point_id.

    Changed: any axis differs by more than its tolerance (elevations where
    both are there), or the descriptions differ (null is empty).
    """
    cols = ("northing", "easting", "elevation", "description")
    a = base.select("point_id", F.lit(True).alias("in_base"), *[F.col(c).alias(f"base_{c}") for c in cols])
    b = revised.select("point_id", F.lit(True).alias("in_revised"), *[F.col(c).alias(f"revised_{c}") for c in cols])
    off = lambda c, tol: F.coalesce(F.abs(F.col(f"revised_{c}") - F.col(f"base_{c}")) > tol, F.lit(False))
    changed = off("northing", htol) | off("easting", htol) | off("elevation", vtol) | (F.coalesce("base_description", F.lit("")) != F.coalesce("revised_description", F.lit("")))
    status = F.when(F.col("in_base").isNull(), "added").when(F.col("in_revised").isNull(), "removed").when(changed, "changed").otherwise("unchanged")
    return a.join(b, "point_id", "full_outer").select("point_id", status.alias("status"), *[(F.col(f"revised_{c}") - F.col(f"base_{c}")).alias(f"d_{c}") for c in cols[:3]])


def revision_match(base: DataFrame, revised: DataFrame) -> DataFrame:
    """Match rows one to one by point_id: ids that are repeated on a side are ambiguous; a matched pair is changed if any value differs exactly."""
    cols = ("northing", "easting", "elevation", "description")
    side = lambda df, s: df.groupBy("point_id").agg(F.count(F.lit(1)).alias(f"n_{s}"), *[F.min(c).alias(f"{s}_{c}") for c in cols])
    joined = side(base, "a").join(side(revised, "b"), "point_id", "full_outer")
    differs = reduce(lambda x, y: x | y, [~F.col(f"a_{c}").eqNullSafe(F.col(f"b_{c}")) for c in cols])
    na, nb = F.coalesce("n_a", F.lit(0)).cast("long"), F.coalesce("n_b", F.lit(0)).cast("long")
    status = F.when((na > 1) | (nb > 1), "ambiguous").when(na == 0, "added").when(nb == 0, "removed").when(differs, "changed").otherwise("unchanged")
    return joined.select("point_id", na.alias("n_base"), nb.alias("n_revised"), status.alias("status"))


def duplicates(rows: DataFrame, *key: str) -> DataFrame:
    """Keys that occur more than once, with their counts."""
    return rows.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def null_rates(rows: DataFrame, *columns: str) -> DataFrame:
    """Row count, and for each column its nulls and their share; one row."""
    n = F.count(F.lit(1))
    nulls = {c: F.count_if(F.col(c).isNull()) for c in columns}
    return rows.agg(n.alias("n_rows"), *[v.alias(f"null_{c}") for c, v in nulls.items()], *[F.try_divide(v, n).alias(f"share_{c}") for c, v in nulls.items()])


#: Ids to a bucket of the gap search; a bucket's neighbours meet through bucket ends, not through one global sort.
GAP_BUCKET = 1 << 20


def gaps(ids: DataFrame, column: str, low: int | None = None, high: int | None = None, least: int = 1) -> DataFrame:
    """Runs of integers between ``low`` and ``high`` (default: the ids' range) that don't occur: first, last, count.

    Ids are bucketed by value and sorted within buckets; only each bucket's
    ends meet in wider buckets, and only the ends of those in one window, so
    the work follows the ids, not the range.
    Bounds given in reverse are swapped; null and negative ids are ignored.
    """
    if low is not None and high is not None and low > high:
        low, high = high, low
    x = ids.select(F.col(column).cast("long").alias("x")).where("x >= 0").distinct()
    if low is not None:
        x = x.where(F.col("x") >= low)
    if high is not None:
        x = x.where(F.col("x") <= high)
    bounds = [F.lit(v).cast("long").alias("x") for v in ([low - 1] if low is not None else []) + ([high + 1] if high is not None else [])]
    spark = ids.sparkSession
    for b in bounds:
        x = x.unionByName(spark.range(1).select(b))
    ends = x.select(F.col("x").alias("first"), F.col("x").alias("last"))
    steps = []
    for wide in (GAP_BUCKET, GAP_BUCKET * GAP_BUCKET):
        ends = ends.withColumn("bucket", F.floor(F.col("first") / wide))
        steps.append(ends.select(F.col("last").alias("x"), F.lead("first").over(Window.partitionBy("bucket").orderBy("first")).alias("next")))
        ends = ends.groupBy("bucket").agg(F.min("first").alias("first"), F.max("last").alias("last"))
    steps.append(ends.select(F.col("last").alias("x"), F.lead("first").over(Window.orderBy("first")).alias("next")))
    runs = reduce(DataFrame.unionByName, steps).where("next > x + 1")
    return runs.select((F.col("x") + 1).alias("first_id"), (F.col("next") - 1).alias("last_id"), (F.col("next") - F.col("x") - 1).alias("n_ids")).where(F.col("n_ids") >= least)


def crew_ranges(ids: DataFrame, column: str, least: int = 100, block: int = 1000) -> DataFrame:
    """Gaps with a priority and a note each, and the open range that starts at the next whole block after the largest id (its last id and count are null)."""
    label = F.when(F.col("n_ids") >= 500, "Large gap").when(F.col("n_ids") >= 250, "Recommended").otherwise("Usable")
    series = lambda v: F.concat((F.floor(v / 1000) * 1000).cast("string"), F.lit("-series"))
    first, last, after = F.col("first_id"), F.col("last_id"), F.col("last_id") + 1
    same = F.floor(first / 1000) == F.floor(last / 1000)
    note = (
        F.when(same & (last % 1000 == 999), F.concat(F.lit("Clean open sequence through the end of the "), series(first), F.lit(" block.")))
        .when(after % 1000 == 0, F.concat(F.lit("Open gap immediately before the "), series(after), F.lit(" sequence begins.")))
        .when(same, F.concat(F.lit("Open block between existing "), series(first), F.lit(" points; the next occupied point is "), after.cast("string"), F.lit(".")))
        .otherwise(F.concat(F.lit("Open block between occupied points "), (first - 1).cast("string"), F.lit(" and "), after.cast("string"), F.lit(".")))
    )
    inner = gaps(ids, column, least=least).withColumns({"priority": label, "notes": note})
    start = (F.floor(F.max(F.col(column).cast("long")) / block) + 1) * block
    empty = F.lit(None).cast("long")
    outer = ids.where(F.col(column) >= 0).agg(start.cast("long").alias("first_id")).where("first_id is not null")
    safest = f"Safest option: starts a new {block}-point series above every PointID currently in the file, preventing overlap with existing numbers."
    return inner.unionByName(outer.select("first_id", empty.alias("last_id"), empty.alias("n_ids"), F.lit("Safest").alias("priority"), F.lit(safest).alias("notes")))


#: Levels of range buckets, each this many times as wide as the one before.
LEVELS, WIDER = 13, 16


def overlaps(left: DataFrame, right: DataFrame, width: int) -> DataFrame:
    """Pairs of closed integer ranges that overlap; both sides have ``id``, ``start_id``, ``end_id``.

    A range is keyed by the (at most two) buckets it touches at the lowest
    level whose buckets are as wide as it is, and looks up those that it
    touches at every wider level, so a range of any length makes a fixed number
    of rows.  A pair is reported in the bucket where the later range starts,
    so once.
    """
    widths = [width * WIDER**k for k in range(LEVELS)]

    def side(rows: DataFrame, tag: str, own: bool) -> DataFrame:
        size = F.col("end_id") - F.col("start_id") + 1
        level = reduce(lambda c, k: c.when(size <= widths[k], k), range(LEVELS - 1), F.when(F.lit(False), 0)).otherwise(LEVELS - 1)
        rows = rows.where("end_id >= start_id").select(F.col("id").alias(f"id_{tag}"), F.col("start_id").alias(f"start_{tag}"), F.col("end_id").alias(f"end_{tag}"), level.alias(f"level_{tag}"))
        levels = F.array(F.col(f"level_{tag}")) if own else F.sequence(F.col(f"level_{tag}"), F.lit(LEVELS - 1))
        rows = rows.withColumn("level", F.explode(levels)).withColumn("wide", F.element_at(F.array(*[F.lit(w).cast("long") for w in widths]), F.col("level") + 1))
        return rows.withColumn("bucket", F.explode(F.sequence(F.floor(F.col(f"start_{tag}") / F.col("wide")), F.floor(F.col(f"end_{tag}") / F.col("wide")))))

    keys = ["level", "bucket", "wide"]
    wide_left = side(left, "a", True).join(side(right, "b", False), keys)
    wide_right = side(left, "a", False).join(side(right, "b", True), keys).where("level_a < level_b")
    meet = wide_left.unionByName(wide_right).where("start_a <= end_b and end_a >= start_b").where(F.floor(F.greatest("start_a", "start_b") / F.col("wide")) == F.col("bucket"))
    return meet.select("id_a", "id_b", F.greatest("start_a", "start_b").alias("from_id"), F.least("end_a", "end_b").alias("to_id"))


def upsert(current: DataFrame, changes: DataFrame, key: str, version: str) -> DataFrame:
    """Current rows with changes applied: the newest version of each key."""
    columns = [c for c in current.columns if c != key]
    both = current.unionByName(changes.select(*current.columns))
    return both.groupBy(key).agg(F.max_by(F.struct(*columns), F.col(version)).alias("row")).select(key, *[F.col(f"row.{c}").alias(c) for c in columns])


def latest_event(events: DataFrame, key: str, order: Column, *values: str) -> DataFrame:
    """The values of the newest event of each key: the state that an append log stands for."""
    return events.groupBy(key).agg(F.max_by(F.struct(*values), order).alias("row")).select(key, "row.*")


def edit_history(before: DataFrame, after: DataFrame, key: str, *fields: str) -> DataFrame:
    """One row for each changed field of each key: old and new value as text."""
    a, b = before.select(key, *[F.col(f).cast("string").alias(f"old_{f}") for f in fields]), after.select(key, *[F.col(f).cast("string").alias(f"new_{f}") for f in fields])
    each = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"old_{f}").alias("old_value"), F.col(f"new_{f}").alias("new_value")) for f in fields]))
    return a.join(b, key).select(key, each.alias("e")).select(key, "e.*").where(~F.col("old_value").eqNullSafe(F.col("new_value")))


def chain_hash(previous: Column, *fields: Column) -> Column:
    """SHA-256 of the previous hash and the canonical JSON of an event's fields (names sorted, no nulls)."""
    return F.sha2(F.concat(previous, F.to_json(F.struct(*fields))), 256)


def verify_chain(events: DataFrame, partition: str, order: str, *fields: str) -> DataFrame:
    """For each chain the number of events and the first order value whose stored hashes don't fit, or null.

    Each event stores ``prev_hash`` and ``event_hash``, so rows are checked on
    their own and against the row before: no sequential fold is needed.
    """
    w = Window.partitionBy(partition).orderBy(order)
    linked = F.coalesce(F.lag("event_hash").over(w), F.lit("")) == F.col("prev_hash")
    own = chain_hash(F.col("prev_hash"), *[F.col(f) for f in sorted(fields)]) == F.col("event_hash")
    checked = events.withColumn("ok", F.coalesce(linked & own, F.lit(False)))
    return checked.groupBy(partition).agg(F.count(F.lit(1)).alias("n_events"), F.min(F.when(~F.col("ok"), F.col(order))).alias("broken_at"))


def orphans(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    """Child rows whose key has no parent; null keys have none to look for."""
    return child.where(F.col(child_key).isNotNull()).join(parent.select(F.col(parent_key).alias(child_key)), child_key, "left_anti")


def zero_filled(rows: DataFrame, column: str, values: tuple[str, ...]) -> DataFrame:
    """Counts of every listed value, zero where it doesn't occur."""
    listed = rows.sparkSession.createDataFrame([(v,) for v in values], f"{column} string")
    counts = rows.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    return F.broadcast(listed).join(counts, column, "left").select(column, F.coalesce("n", F.lit(0)).cast("long").alias("n"))
