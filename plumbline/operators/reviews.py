"""Operators of review work: codes, metadata merges, comparisons of states, links to sources, and returned observations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.ids import code_parts
from plumbline.operators.surfaces import grid_pairs

_NUMERIC = ("tinyint", "smallint", "int", "bigint", "float", "double", "decimal")


def classify_codes(points: DataFrame, rules: DataFrame) -> DataFrame:
    """point_id, base code, role and description of each point's code.

    ``rules`` has one row a code: code, description, role.  Codes without a
    rule are structures from 600 to 639 and unknown otherwise; a null code is
    unknown with the base ``?``.
    """
    base = code_parts(F.coalesce("code", F.lit("")))["base"]
    listed = rules.select(F.col("code").alias("base"), F.col("role").alias("listed_role"), F.col("description").alias("listed_description"))
    joined = points.select("point_id", base.alias("base")).join(listed, "base", "left")
    structure = F.col("base").rlike("^[0-9]+$") & F.col("base").try_cast("long").between(600, 639)
    role = F.when(F.col("listed_role").isNotNull(), F.col("listed_role")).when(structure, "structure").otherwise("unknown")
    text = F.when(F.col("listed_role").isNotNull(), F.col("listed_description")).when(structure, "Unclassified structure-range code").otherwise("Review code classification")
    return joined.select("point_id", F.when(F.col("base") == "", "?").otherwise(F.col("base")).alias("base"), role.alias("role"), text.alias("description"))


def solver_rows(observations: DataFrame, picks: DataFrame) -> DataFrame:
    """Observations that a solution uses: the picked ones with their place in the pick, else those marked ``include``.

    ``picks`` has control_id and observation_ids (an array).  A picked id that
    a control doesn't have, and a null one, is left out.
    """
    chosen = picks.select("control_id", F.posexplode("observation_ids").alias("position", "observation_id"))
    explicit = observations.join(chosen, ["control_id", "observation_id"])
    rest = observations.where("include").join(picks.select("control_id").distinct(), "control_id", "left_anti")
    columns = ["control_id", "observation_id", *[c for c in observations.columns if c not in ("control_id", "observation_id")]]
    return explicit.select(*columns, F.col("position").cast("long").alias("position")).unionByName(rest.select(*columns, F.lit(None).cast("long").alias("position")))


def _blank(column: Column, kind: str) -> Column:
    empty = column == "" if kind == "string" else column == 0 if kind.startswith(_NUMERIC) else F.lit(False)
    return column.isNull() | F.coalesce(empty, F.lit(False))


def fill_metadata(current: DataFrame, incoming: DataFrame, key: str, order: str, *fields: str) -> DataFrame:
    """``current`` with blank ``fields`` (null, empty text, zero) filled from the last incoming row of the same id without case.

    Adds ``filled``, the names of the fields that were.  Incoming nulls and
    empty texts fill nothing; ids that ``current`` lacks are ignored.  Rows of
    one id are all filled; null and empty ids never match.
    """
    kinds = dict(incoming.dtypes)
    last = incoming.where(F.coalesce(F.trim(key), F.lit("")) != "").groupBy(F.lower(F.trim(key)).alias("_id")).agg(F.max_by(F.struct(*fields), order).alias("_new"))
    joined = current.withColumn("_id", F.lower(F.trim(key))).join(last, "_id", "left")
    gives = {f: _blank(F.col(f), dict(current.dtypes)[f]) & F.col(f"_new.{f}").isNotNull() & (F.col(f"_new.{f}") != "" if kinds[f] == "string" else F.lit(True)) for f in fields}
    filled = F.array_compact(F.array(*[F.when(F.coalesce(g, F.lit(False)), f) for f, g in gives.items()]))
    values = [F.when(F.coalesce(gives[c], F.lit(False)), F.col(f"_new.{c}")).otherwise(F.col(c)).alias(c) if c in gives else F.col(c) for c in current.columns]
    return joined.select(*values, filled.alias("filled"))


def merge_occupations(records: DataFrame, key: str, order: str, first: tuple[str, ...], most: tuple[str, ...]) -> DataFrame:
    """One row a point from all its records: the first value that isn't blank, and the largest of counts and dilutions of precision."""
    kinds = dict(records.dtypes)
    told = lambda c: F.when(F.col(c).isNotNull() & (F.col(c) != "" if kinds[c] == "string" else F.lit(True)), F.col(order))
    return records.groupBy(key).agg(*[F.min_by(c, told(c)).alias(c) for c in first], *[F.max(c).alias(c) for c in most])


def photo_matches(files: DataFrame, points: DataFrame) -> DataFrame:
    """path, point_id, n_hits and status of each distinct file: matched by one id, ambiguous for more, unmatched for none.

    A file's ids are the runs of up to 12 digits in its name without its
    folder and ending.  The join is on the runs, so only hits meet.
    """
    stem = F.regexp_replace(F.regexp_extract("path", r"([^/\\]*)$", 1), r"(.)\.[^.]*$", "$1")
    runs = F.filter(F.split(stem, "[^0-9]+"), lambda t: F.length(t).between(1, 12))
    named = files.where("path is not null").select("path").distinct()
    wanted = points.select(F.trim(F.col("point_id").cast("string")).alias("point_id")).distinct()
    hits = named.select("path", F.explode(F.array_distinct(runs)).alias("point_id")).join(wanted, "point_id")
    counted = hits.groupBy("path").agg(F.count(F.lit(1)).alias("n_hits"), F.min("point_id").alias("least"))
    n = F.coalesce("n_hits", F.lit(0)).cast("long")
    status = F.when(n == 0, "unmatched").when(n == 1, "matched").otherwise("ambiguous")
    return named.join(counted, "path", "left").select("path", F.when(n == 1, F.col("least")).alias("point_id"), n.alias("n_hits"), status.alias("status"))


def compare_counts(before: DataFrame, after: DataFrame) -> DataFrame:
    """Counts of each metric in two states and their difference; a metric that a state lacks counts zero there."""
    a, b = before.select("metric", F.col("n").alias("a")), after.select("metric", F.col("n").alias("b"))
    x, y = F.coalesce("a", F.lit(0)).cast("long"), F.coalesce("b", F.lit(0)).cast("long")
    return a.join(b, "metric", "full_outer").select("metric", x.alias("snapshot"), y.alias("current"), (y - x).alias("delta"))


def drawing_diff(before: DataFrame, after: DataFrame, *fields: str) -> DataFrame:
    """entity_id and kind: before_only, after_only, changed_candidate or unchanged, by the values of ``fields``.

    Ids with ``/`` are children of blocks, whose numbers move: they never
    match, and are listed once for each state.
    """
    a = before.select("entity_id", F.struct(*fields).alias("a"))
    b = after.select("entity_id", F.struct(*fields).alias("b"))
    top, child = ~F.col("entity_id").contains("/"), F.col("entity_id").contains("/")
    same = F.col("a").eqNullSafe(F.col("b"))
    kind = F.when(F.col("a").isNull(), "after_only").when(F.col("b").isNull(), "before_only").when(same, "unchanged").otherwise("changed_candidate")
    matched = a.where(top).join(b.where(top), "entity_id", "full_outer").select("entity_id", kind.alias("kind"))
    return matched.unionByName(a.where(child).select("entity_id", F.lit("before_only").alias("kind"))).unionByName(b.where(child).select("entity_id", F.lit("after_only").alias("kind")))


def verified_rows(points: DataFrame, sources: DataFrame, rows: DataFrame) -> DataFrame:
    """Source rows behind each point: its source's stored hash must be the one it was imported with.

    points: point_id, source_id, source_hash; sources: source_id, sha256;
    rows: source_id, point_id and more columns, which are returned.
    """
    proven = points.join(sources.select("source_id", F.col("sha256").alias("source_hash")), ["source_id", "source_hash"], "left_semi").select("source_id", "point_id").distinct()
    return rows.join(proven, ["source_id", "point_id"], "left_semi")


def evidence_links(candidates: DataFrame, points: DataFrame) -> DataFrame:
    """candidate_id and point_uuid where source hash, id and all three coordinates are the same; null equals null."""
    keys = ("source_hash", "point_id", "northing", "easting", "elevation")
    c = candidates.select("candidate_id", *[F.col(k).alias(f"c_{k}") for k in keys])
    return c.join(points, reduce(lambda x, y: x & y, [F.col(f"c_{k}").eqNullSafe(points[k]) for k in keys])).select("candidate_id", "point_uuid")


def line_segments(vertices: DataFrame, line: str = "line_id", order: str = "seq") -> DataFrame:
    """Straight pieces between consecutive vertices of each line: n1, e1, n2, e2."""
    w = Window.partitionBy(line).orderBy(order)
    rows = vertices.select(line, order, F.col("northing").alias("n1"), F.col("easting").alias("e1"), F.lead("northing").over(w).alias("n2"), F.lead("easting").over(w).alias("e2"))
    return rows.where("n2 is not null and e2 is not null")


def endpoint_gaps(ends: DataFrame, radius: float, limit: float) -> DataFrame:
    """Pairs of line ends that are near but don't meet: end_a, end_b, gap, and whether it is within ``limit``.

    ``ends`` has end_id, northing and easting; the join is on grid cells.
    """
    found = grid_pairs(ends.select("end_id", "northing", "easting", F.lit(None).cast("double").alias("elevation")), radius, "end_id").where("distance > 0")
    return found.select(F.col("id_a").alias("end_a"), F.col("id_b").alias("end_b"), F.col("distance").alias("gap"), (F.col("distance") <= limit).alias("within"))


def first_unmatched(items: DataFrame, order: str) -> DataFrame:
    """The first of items that agree in page, raw id, confidence to three places, reason and box."""
    key = [F.coalesce("point_id_raw", F.lit("")), F.bround(F.coalesce("confidence", F.lit(0.0)), 3), "page_id", "reason", "bbox"]
    numbered = items.withColumn("_nth", F.row_number().over(Window.partitionBy(*key).orderBy(order)))
    return numbered.where("_nth = 1").drop("_nth")


def truth_records(pipes: DataFrame) -> DataFrame:
    """point_id and its pipes in order as text: diameter to 2 places, dip to 3, azimuth in [0, 360) to 1; ``-`` for null."""
    text = lambda c, places: F.coalesce(F.format_string(f"%.{places}f", F.bround(c, places)), F.lit("-"))
    shown = lambda c, places: F.when(c.isNull(), "-").otherwise(text(c, places))
    row = F.concat_ws("/", shown(F.col("diameter"), 2), shown(F.col("dip"), 3), shown(F.pmod(F.col("azimuth"), F.lit(360.0)), 1))
    grouped = pipes.groupBy("point_id").agg(F.array_sort(F.collect_list(F.struct("pipe_no", row.alias("t")))).alias("p"))
    return grouped.select("point_id", F.array_join(F.col("p.t"), ";").alias("pipes"))


def pending_union(interpreted: DataFrame, candidates: DataFrame) -> DataFrame:
    """Interpreted evidence, and a placeholder for each candidate point that has none: point_id, status."""
    waiting = candidates.select("point_id").distinct().join(interpreted.select("point_id"), "point_id", "left_anti")
    return interpreted.select("point_id", "status").unionByName(waiting.select("point_id", F.lit("PENDING").alias("status")))


def point_states(points: DataFrame, interpreted: DataFrame, candidates: DataFrame) -> DataFrame:
    """INTERPRETED, else OCR_FOUND, else PENDING_OCR for each point."""
    flag = lambda df, name: df.select("point_id").distinct().withColumn(name, F.lit(True))
    joined = points.select("point_id").join(flag(interpreted, "done"), "point_id", "left").join(flag(candidates, "seen"), "point_id", "left")
    return joined.select("point_id", F.when(F.col("done"), "INTERPRETED").when(F.col("seen"), "OCR_FOUND").otherwise("PENDING_OCR").alias("state"))


def supersede(issues: DataFrame, module: str, prefix: str) -> DataFrame:
    """Open issues of a module whose code begins with ``prefix``, without case, become SUPERSEDED; all rows stay."""
    hit = (F.col("module") == module) & (F.col("status") == "OPEN") & F.lower("code").startswith(prefix.lower())
    return issues.withColumn("status", F.when(F.coalesce(hit, F.lit(False)), "SUPERSEDED").otherwise(F.col("status")))


def returned_deltas(requested: DataFrame, returned: DataFrame) -> DataFrame:
    """For each requested point its first return that has a finite coordinate: differences, and the request's status.

    requested: request_id, point_id, northing, easting, elevation; returned:
    the same with ``seq``.  Returns of points that weren't requested are
    ignored; of returns that share a ``seq``, the least coordinates count; a request is open until every point has come back.
    """
    axes = ("northing", "easting", "elevation")
    finite = lambda c: F.when(~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))), F.col(c))
    usable = returned.select("request_id", "point_id", "seq", *[finite(c).alias(c) for c in axes]).where("coalesce(northing, easting, elevation) is not null")
    first = usable.groupBy("request_id", "point_id").agg(F.min_by(F.struct(*axes), F.struct("seq", *axes)).alias("r"))
    joined = requested.join(first, ["request_id", "point_id"], "left")
    rows = joined.select("request_id", "point_id", *[(F.col(f"r.{c}") - F.col(c)).alias(f"d_{c}") for c in axes], F.col("r").isNotNull().alias("returned"))
    status = rows.groupBy("request_id").agg(F.when(F.bool_and("returned"), "returned").otherwise("open").alias("status"))
    return rows.join(status, "request_id")


def decimated(vertices: DataFrame, most: int, line: str = "line_id", order: str = "seq") -> DataFrame:
    """Every k-th vertex of each line, k being the least that leaves ``most``; the last vertex stays where it differs from the one kept before."""
    w = Window.partitionBy(line).orderBy(order)
    rows = vertices.withColumns({"_at": F.row_number().over(w) - 1, "_n": F.count(F.lit(1)).over(Window.partitionBy(line))})
    rows = rows.withColumn("_step", F.ceil(F.col("_n") / most))
    kept = F.col("_at") % F.col("_step") == 0
    before = F.last(F.when(kept, F.struct("northing", "easting")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    ends = (F.col("_at") == F.col("_n") - 1) & ~F.struct("northing", "easting").eqNullSafe(before)
    return rows.withColumn("_keep", kept | ends).where("_keep").drop("_at", "_n", "_step", "_keep")
