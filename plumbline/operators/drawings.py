"""Modelspace of drawings: block references expanded by composed affine transforms.

A drawing is two relations.  ``records`` has one row an entity: path, block
(null in modelspace), seq, handle, kind, layer, xs, ys, zs, closed, curved,
text, and for references name, place (x, y, z), factor (x, y, z), rotation
(degrees), columns, rows, dx, dy.  ``blocks`` has path, block, base (x, y, z)
and external.  Every level of nesting is one join of the references with the
contents of their blocks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.storage import materialise, scope

#: Levels of nesting that are followed, and why something is left out.
LEVELS = 12
RECURSIVE, MISSING, UNSUPPORTED, EMPTY = "Recursive block or nesting exceeds 12 levels.", "Missing block or external reference is not loaded.", "Unsupported entity; no substitute geometry generated.", "Entity has no vertices."
#: Meters in a drawing unit.
METERS = {"meters": 1.0, "international_feet": 0.3048, "us_survey_feet": 1200 / 3937, "millimeters": 0.001, "centimeters": 0.01, "inches": 0.0254}
FARTHEST = 1e12
_AXES = ("x", "y", "z")


def _matrix(rows: list[list[Column | float]]) -> Column:
    """A 3 x 4 matrix as 12 numbers, row after row."""
    return F.array(*[v if isinstance(v, Column) else F.lit(float(v)) for row in rows for v in row])


def _times(a: Column, b: Column) -> Column:
    """The transform that applies ``b``, then ``a``."""
    cell = lambda m, r, c: F.get(m, F.lit(4 * r + c))
    return F.array(*[sum((cell(a, r, k) * cell(b, k, c) for k in range(3)), cell(a, r, 3) if c == 3 else F.lit(0.0)) for r in range(3) for c in range(4)])


def _placement(column: Column, row: Column) -> Column:
    """Transform of one instance of a reference: the block's base goes to the place, scaled, rotated, and moved along the array's own axes."""
    turn = F.radians("rotation")
    cos, sin = F.cos(turn), F.sin(turn)
    fx, fy, fz = (F.col(f"factor.{a}") for a in _AXES)
    bx, by, bz = (F.col(f"base.{a}") for a in _AXES)
    along, up = column * F.col("dx"), row * F.col("dy")
    return _matrix([
        [cos * fx, -sin * fy, 0.0, F.col("place.x") + cos * (along - fx * bx) - sin * (up - fy * by)],
        [sin * fx, cos * fy, 0.0, F.col("place.y") + sin * (along - fx * bx) + cos * (up - fy * by)],
        [0.0, 0.0, fz, F.col("place.z") - fz * bz],
    ])


def _moved(scale: float) -> list[Column]:
    """Coordinates of an entity under its transform ``at``, in project units."""
    points = F.arrays_zip("xs", "ys", "zs")
    m = lambda r, c: F.get("at", F.lit(4 * r + c))
    return [F.transform(points, lambda p: (m(r, 0) * p["xs"] + m(r, 1) * p["ys"] + m(r, 2) * p["zs"] + m(r, 3)) * scale).alias(c) for r, c in enumerate(("xs", "ys", "zs"))]


def modelspace(records: DataFrame, blocks: DataFrame, drawing_units: str = "meters", project_units: str = "meters") -> tuple[DataFrame, DataFrame]:
    """``(entities, omitted)`` of the modelspace of every drawing, all references expanded.

    Entities: path, entity_id, handle, kind, layer, block_path, closed, curved,
    text, xs, ys, zs (project units), planar.  An ``entity_id`` is the
    reference's id, the instance in its array and the place in the block, so
    every entity names where it comes from; what lies on layer 0 of a block
    takes the reference's layer.  Omitted: path, entity_id, kind, reason, for
    references that contain themselves or nest too deep, missing blocks,
    unsupported kinds (null coordinates), entities without vertices, and
    coordinates that aren't numbers or beyond 1e12.

    The number of levels bounds the loop, not the data; every level is written
    to the shared folder, and nothing is gathered.
    """
    scale = METERS[drawing_units] / METERS[project_units]
    spark = records.sparkSession
    identity = _matrix([[1, 0, 0, 0], [0, 1, 0, 0], [0, 0, 1, 0]])
    none = F.array().cast("array<string>")
    with scope(spark):
        rows = records.where("block is null").withColumns({"entity_id": F.coalesce("handle", F.concat(F.lit("index-"), F.col("seq").cast("string"))), "at": identity, "block_path": none, "own_layer": F.col("layer")})
        rows = rows.withColumn("source", F.col("entity_id"))
        contents = records.where("block is not null").withColumnRenamed("block", "name_in")
        contents = contents.select("path", "name_in", *[F.col(c).alias(f"c_{c}") for c in records.columns if c not in ("path", "block")])
        plain, omitted = [], []
        for level in range(LEVELS + 1):
            plain.append(rows.where("kind != 'INSERT'"))
            inserts = rows.where("kind = 'INSERT'").join(blocks.select("path", F.col("block").alias("name"), "base", "external"), ["path", "name"], "left")
            endless = F.array_contains("block_path", F.col("name")) | F.lit(level >= LEVELS)
            reason = F.when(endless, RECURSIVE).when(F.col("base").isNull() | F.col("external"), MISSING)
            inserts = materialise(inserts.withColumn("reason", reason), "drawing-references", hand_on=True)
            omitted.append(inserts.where("reason is not null").select("path", "entity_id", "kind", "reason"))
            followed = inserts.where("reason is null")
            if level == LEVELS or followed.isEmpty():
                break
            cell = F.explode(F.sequence(F.lit(0), F.greatest(F.col("columns") * F.col("rows") - 1, F.lit(0))))
            each = followed.withColumn("instance", cell)
            column, row = F.col("instance") % F.greatest("columns", F.lit(1)), F.floor(F.col("instance") / F.greatest("columns", F.lit(1)))
            each = each.select("path", F.col("name").alias("name_in"), "entity_id", "source", "own_layer", F.concat("block_path", F.array("name")).alias("block_path"), "instance", _times(F.col("at"), _placement(column, row)).alias("at"))
            inner = each.join(contents, ["path", "name_in"])
            child = F.concat_ws("/", "entity_id", F.col("instance").cast("string"), F.col("c_seq").cast("string"))
            rows = inner.select("path", child.alias("entity_id"), "source", F.when(F.col("c_layer") == "0", F.col("own_layer")).otherwise(F.col("c_layer")).alias("own_layer"), "block_path", "at", *[F.col(f"c_{c}").alias(c) for c in records.columns if c not in ("path", "block")])
        every = plain[0].drop("block", "place_in")
        for p in plain[1:]:
            every = every.unionByName(p, allowMissingColumns=True)
        every = every.select("path", "entity_id", F.col("source").alias("handle"), "kind", F.col("own_layer").alias("layer"), "block_path", "closed", "curved", "text", F.col("xs").isNull().alias("no_shape"), *_moved(scale))
        every = materialise(every, "drawing-entities", hand_on=True)
    far = lambda c: F.exists(c, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) > FARTHEST))
    why = F.when(F.col("no_shape"), UNSUPPORTED).when(F.size("xs") == 0, EMPTY).when(far("xs") | far("ys") | far("zs"), "Invalid or out-of-range coordinate.")
    every = every.withColumn("reason", why)
    left_out = every.where("reason is not null").select("path", "entity_id", "kind", "reason")
    for o in omitted:
        left_out = left_out.unionByName(o)
    planar = F.array_max("zs") - F.array_min("zs") <= 1e-9
    return every.where("reason is null").drop("no_shape", "reason").withColumn("planar", planar), left_out


def layer_counts(entities: DataFrame) -> DataFrame:
    """Entities and vertices of each layer of each drawing."""
    return entities.groupBy("path", "layer").agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("xs")).cast("long").alias("vertices"))
