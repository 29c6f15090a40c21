"""Operators on project records: merges, listings, appended events, requests and selections."""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.storage import in_order


def merged_points(points: DataFrame, order: str = "seq") -> DataFrame:
    """The first row of each point id."""
    w = Window.partitionBy("point_id").orderBy(order)
    return points.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def merge_issues(points: DataFrame, order: str = "seq", place: tuple[str, ...] = ("northing", "easting", "elevation")) -> DataFrame:
    """Later rows of a point id that differ from its first one in ``place`` or code (without case), with that row's order value."""
    w = Window.partitionBy("point_id").orderBy(order)
    first = lambda c: F.first(c).over(w)
    code = lambda c: F.lower(F.trim(F.coalesce(c, F.lit(""))))
    same = code(F.col("code")).eqNullSafe(code(first("code")))
    for c in place:
        same = same & F.col(c).eqNullSafe(first(c))
    return points.withColumns({"_same": same, "first_seq": first(order)}).where("not _same").select("point_id", order, "first_seq")


def observation_listing(obs: DataFrame, control_id: str | int | None = None, limit: int = 10_000) -> DataFrame:
    """Observations of one control (or all), by control, time and id; at most 10,000 (a page, not a sample)."""
    rows = obs if control_id is None else obs.where(F.col("control_id") == control_id)
    return rows.orderBy("control_id", "observed", "observation_id").limit(min(limit, 10_000))


def overlay_points(points: DataFrame, crs: str, units: str) -> DataFrame:
    """Points with finite coordinates in the project's system and units."""
    return points.where(_fits(crs, units))


def overlay_excluded(points: DataFrame, crs: str, units: str) -> DataFrame:
    """One row: how many points an overlay shows and leaves out."""
    fits = F.coalesce(_fits(crs, units), F.lit(False))
    return points.agg(F.count_if(fits).alias("shown"), F.count_if(~fits).alias("excluded"))


def _fits(crs: str, units: str):
    finite = lambda c: F.col(c).isNotNull() & ~F.isnan(F.col(c)) & (F.abs(F.col(c)) < F.lit(float("inf")))
    return finite("northing") & finite("easting") & (F.col("crs") == crs) & (F.col("horizontal_units") == units)


#: States of a job from which it can go on.
RESUMABLE = ("INTERRUPTED", "ERROR", "CANCELLED")


def latest_resumable(jobs: DataFrame, *key: str) -> DataFrame:
    """The newest job (by ``updated``, then ``job_id``) that can go on, for each value of ``key`` or of all."""
    rows = jobs.where(F.col("status").isin(*RESUMABLE))
    newest = F.max_by(F.struct("job_id", "status", "updated"), F.struct("updated", "job_id"))
    return rows.groupBy(*key).agg(newest.alias("j")).where("j is not null").select(*key, "j.*")


def id_changes(base: DataFrame, revised: DataFrame, key: str = "point_id") -> DataFrame:
    """Ids that only one side has, and which: added or removed.  Null ids are not compared."""
    side = lambda df, tag: df.select(key).where(F.col(key).isNotNull()).distinct().withColumn(tag, F.lit(True))
    both = side(base, "old").join(side(revised, "new"), key, "full_outer")
    return both.where("old is null or new is null").select(key, F.when(F.col("old").isNull(), "added").otherwise("removed").alias("change"))


def replace_by_source(current: DataFrame, fresh: DataFrame, source: str = "source", refreshed: DataFrame | None = None) -> DataFrame:
    """Current rows of sources that aren't refreshed, and all of ``fresh``: each source's rows are replaced as a whole.

    ``refreshed`` (column ``source``) names the sources that were read again;
    one that brings nothing then loses its rows.  Without it, the sources of
    ``fresh`` are meant.  Rows without a source stay.
    """
    gone = (fresh if refreshed is None else refreshed).select(source).distinct()
    return current.join(gone, source, "left_anti").select(*current.columns).unionByName(fresh.select(*current.columns))


def replace_children(children: DataFrame, current: DataFrame, fresh: DataFrame, refreshed: DataFrame, parent: str, source: str = "source") -> DataFrame:
    """Child rows after ``replace_by_source``: those of replaced parents go first, then ``fresh`` comes.

    ``children`` and ``fresh`` have the column ``parent``, which ``current``
    has with its source.
    """
    gone = current.join(refreshed.select(source).distinct(), source, "left_semi").select(parent).distinct()
    return children.join(gone, parent, "left_anti").select(*children.columns).unionByName(fresh.select(*children.columns))


def append_events(tails: DataFrame, events: DataFrame, chain: str, order: str, *fields: str) -> DataFrame:
    """New events of each chain with seq, prev_hash and event_hash, carried on from the chain's tail.

    ``tails`` has the chain's key, last seq and event_hash (none for a new
    chain).  The hash of an event is that of ``keyed.chain_hash``, so
    ``keyed.verify_chain`` accepts what this returns.  Each hash needs the one
    before, so a chain is folded by one task; it streams its events and holds
    one hash.
    """
    payload = F.to_json(F.struct(*[F.col(f) for f in sorted(fields)]))
    rows = events.select(chain, order, *[f for f in fields if f not in (chain, order)], payload.alias("_payload"))
    rows = rows.join(tails.select(F.col(chain), F.col("seq").alias("_seq"), F.col("event_hash").alias("_hash")), chain, "left")
    kept = [c for c in rows.columns if not c.startswith("_")]
    ordered = in_order(rows, chain, order)

    def fold(batches):
        at, seq, last = None, 0, ""
        for batch in batches:
            keys, payloads, seqs, hashes = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in (chain, "_payload", "_seq", "_hash"))
            out: list[list] = [[], [], []]
            for k, p, s, h in zip(keys, payloads, seqs, hashes):
                if at is None or at[0] != k:
                    at, seq, last = (k,), s or 0, h or ""
                before, seq = last, seq + 1
                last = hashlib.sha256((before + p).encode()).hexdigest()
                for c, v in zip(out, (seq, before, last)):
                    c.append(v)
            columns = [batch.column(batch.schema.get_field_index(c)) for c in kept]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(out[0], pa.int64()), pa.array(out[1], pa.string()), pa.array(out[2], pa.string())], [*kept, "seq", "prev_hash", "event_hash"])

    kinds = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in kept)
    return ordered.mapInArrow(fold, f"{kinds}, seq long, prev_hash string, event_hash string")


def return_faults(reserved: DataFrame, returned: DataFrame) -> DataFrame:
    """One row a request: whether what came back has each reserved point id (without case) exactly once, all of the request's control.

    ``reserved`` has request_id, control_id, point_id; ``returned`` request_id,
    control_id, point_id.  Other returned points are only counted; a returned
    point without a control is of another control.
    """
    low = lambda c: F.lower(F.trim(F.col(c)))
    want = reserved.select("request_id", low("control_id").alias("control"), low("point_id").alias("k")).distinct()
    came = returned.select("request_id", F.coalesce(low("control_id"), F.lit("")).alias("other"), low("point_id").alias("k")).groupBy("request_id", "k").agg(F.count(F.lit(1)).alias("n"), F.min("other").alias("low"), F.max("other").alias("high"))
    both = want.withColumn("wanted", F.lit(True)).join(came, ["request_id", "k"], "full_outer")
    count = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    wanted = F.col("wanted").isNotNull()
    sums = both.groupBy("request_id").agg(
        count(wanted & F.col("n").isNull()).alias("missing"), count(wanted & (F.col("n") > 1)).alias("repeated"), count(wanted & ((F.col("low") != F.coalesce("control", F.lit(""))) | (F.col("high") != F.coalesce("control", F.lit(""))))).alias("other_control"),
        count(~wanted).alias("ignored"), count(wanted).alias("reserved"),
    )
    status = F.when(F.col("missing") + F.col("repeated") > 0, "INCOMPLETE").when(F.col("other_control") > 0, "OTHER_CONTROL").otherwise("COMPLETE")
    return sums.where("reserved > 0").select("request_id", "missing", "repeated", "other_control", "ignored", status.alias("status"))


def manual_selections(points: DataFrame, selections: DataFrame, htol: float | None = None, vtol: float | None = None) -> DataFrame:
    """Mean of the three points that each selection (selection_id, point_a, point_b, point_c) names, in that order, and its largest horizontal residual.

    A selection whose ids aren't three distinct ones, of points that occur
    exactly once with all coordinates, has no mean and is INVALID.  With
    tolerances (both), a valid one is PASS if all three residuals are within
    them, else REVIEW, and ``max_v`` is its largest vertical residual.
    """
    if (htol is None) != (vtol is None):
        raise ValueError("give both tolerances or none")
    once = points.groupBy("point_id").agg(F.count(F.lit(1)).alias("n"), *[F.first(c).alias(c) for c in ("northing", "easting", "elevation")])
    names = ("point_a", "point_b", "point_c")
    each = selections.select("selection_id", F.posexplode(F.array(*names)).alias("k", "point_id")).join(once, "point_id", "left")
    ok = (F.col("n") == 1) & F.col("northing").isNotNull() & F.col("easting").isNotNull() & F.col("elevation").isNotNull()
    sums = each.groupBy("selection_id").agg(
        F.count_if(F.coalesce(ok, F.lit(False))).alias("good"), F.countDistinct("point_id").alias("distinct"), *[F.avg(c).alias(f"mean_{c[0]}") for c in ("northing", "easting")], F.avg("elevation").alias("mean_z"),
        F.collect_list(F.struct("northing", "easting", "elevation")).alias("p"),
    )
    valid = (F.col("good") == 3) & (F.col("distinct") == 3)
    far = F.array_max(F.transform("p", lambda p: F.sqrt((p["northing"] - F.col("mean_n")) ** 2 + (p["easting"] - F.col("mean_e")) ** 2)))
    means = [F.when(valid, F.col(c)).alias(c) for c in ("mean_n", "mean_e", "mean_z")]
    if htol is None:
        return sums.select("selection_id", *means, F.when(valid, far).alias("max_h"), F.when(valid, "OK").otherwise("INVALID").alias("status"))
    high = F.array_max(F.transform("p", lambda p: F.abs(p["elevation"] - F.col("mean_z"))))
    status = F.when(~valid, "INVALID").when((far <= htol) & (high <= vtol), "PASS").otherwise("REVIEW")
    return sums.select("selection_id", *means, F.when(valid, far).alias("max_h"), F.when(valid, high).alias("max_v"), status.alias("status"))


def attach_once(existing: DataFrame, files: DataFrame) -> DataFrame:
    """Files (object_id, sha256, path) whose content their object doesn't store yet; of equal ones the first path.  These are the copies to make."""
    first = files.groupBy("object_id", "sha256").agg(F.min("path").alias("path"))
    return first.join(existing.select("object_id", "sha256").distinct(), ["object_id", "sha256"], "left_anti")


def attachments(existing: DataFrame, files: DataFrame) -> DataFrame:
    """One new attachment for every file (object_id, sha256, path), with the path its content is stored under.

    Equal contents of an object share one stored file: the first that
    ``existing`` (object_id, sha256, stored_path) names, else the first path.
    """
    kept = existing.groupBy("object_id", "sha256").agg(F.min("stored_path").alias("kept"))
    first = files.groupBy("object_id", "sha256").agg(F.min("path").alias("first"))
    stored = first.join(kept, ["object_id", "sha256"], "left").select("object_id", "sha256", F.coalesce("kept", "first").alias("stored_path"), F.col("kept").isNull().alias("copied"))
    return files.join(stored, ["object_id", "sha256"]).select("object_id", "sha256", "path", "stored_path", (F.col("copied") & (F.col("path") == F.col("stored_path"))).alias("copied"))


def pipe_rows(results: DataFrame) -> DataFrame:
    """One row a pipe of results (point_id, pipes: an array of structs), with its place in the array from one."""
    return results.select("point_id", F.posexplode("pipes").alias("_at", "_pipe")).select("point_id", (F.col("_at") + 1).alias("pipe_index"), "_pipe.*")
