"""Delimited, XML and JSON sources of survey data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.functions.measures import finite

#: Header spellings of the canonical columns.
ALIASES = {
    "point_id": ("point_id", "pointid", "point", "pt", "id", "name", "point_name"),
    "northing": ("northing", "north", "n", "y"),
    "easting": ("easting", "east", "e", "x"),
    "elevation": ("elevation", "elev", "z", "height"),
    "description": ("description", "desc", "code"),
}


#: Header spellings of the staging scan.
STAGING_ALIASES = {
    "point_id": ("point_id", "point", "pt", "ptno", "pnt", "pn", "pointnumber", "point_number", "name"),
    "northing": ("northing", "north", "n", "y", "y_coord", "ycoord"),
    "easting": ("easting", "east", "e", "x", "x_coord", "xcoord"),
    "elevation": ("elevation", "elev", "z", "height", "rl"),
    "description": ("description", "desc", "code", "feature", "feature_code", "d"),
}


def _mapping(columns: list[str], strict: bool) -> dict[str, str]:
    """Canonical name to column: the first alias that occurs; strictly, two aliases of one name are an error."""
    import re

    keys: dict[str, list[str]] = {}
    for c in columns:
        low = c.strip("\ufeff ").lower()
        key = re.sub(r"^_+|_+$", "", re.sub(r"[^a-z0-9]+", "_", low)) if strict else re.sub(r"\W", "", low.replace("-", "_").replace(" ", "_"))
        keys.setdefault(key, []).append(c)
    if strict and any(len(v) > 1 for v in keys.values()):
        raise ValueError("a header occurs twice")
    found = {}
    for name, aliases in (ALIASES if strict else STAGING_ALIASES).items():
        hits = [keys[a][0] for a in aliases if a in keys]
        if strict and len(hits) > 1:
            raise ValueError(f"{name} is ambiguous: {hits}")
        if hits:
            found[name] = hits[0]
    missing = {"point_id", "northing", "easting"} - set(found)
    if missing:
        raise ValueError(f"no column for {sorted(missing)}")
    return found


def delimiter(spark: SparkSession, path: str, rows: int = 80) -> str:
    """Comma, tab, semicolon or bar: the one that splits a sample of lines most evenly; comma if none does.  Reads at most ``rows`` lines."""
    sample = [r.value for r in spark.read.text(path).limit(rows).collect() if r.value]

    def score(d: str) -> float:
        widths = [line.count(d) + 1 for line in sample]
        most = max(set(widths), key=widths.count) if widths else 1
        return 0.0 if most < 2 else 2 * widths.count(most) / len(widths) + (most >= 5) * 0.35

    best = max(",\t;|", key=score)
    return best if sample and score(best) > 0.75 else ","


def _read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, sep=delimiter(spark, path), header=True, enforceSchema=False, ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)


def canonical_points(spark: SparkSession, path: str) -> DataFrame:
    """Points of a delimited file, strictly: a bad header, number or row fails the read.

    Ids are kept as text.  One aggregate over the parsed rows counts the bad
    ones before anything is returned.
    """
    raw = _read(spark, path)
    names = _mapping(raw.columns, strict=True)
    col = lambda n: F.col(f"`{names[n]}`") if n in names else F.lit(None).cast("string")
    rows = raw.select(col("point_id").alias("point_id"), *[finite(col(n)).alias(n) for n in ("northing", "easting", "elevation")], col("description").alias("description"), col("elevation").alias("_z"))
    bad = F.col("point_id").isNull() | (F.trim("point_id") == "") | F.col("northing").isNull() | F.col("easting").isNull() | (F.col("_z").isNotNull() & F.col("elevation").isNull())
    n = rows.agg(F.count_if(bad)).first()[0]
    if n:
        raise ValueError(f"{n} rows of {path} are not valid points")
    return rows.drop("_z")


def staged(rows: DataFrame, order: str) -> DataFrame:
    """Rows (point_id, northing, easting, ...) with a status: INVALID without id or coordinates; of valid ones with the same id (blanks around it aside) the first by ``order`` is VALID and others are DUPLICATE."""
    name = F.trim(F.coalesce(F.col("point_id").cast("string"), F.lit("")))
    valid = (name != "") & F.col("northing").isNotNull() & F.col("easting").isNotNull()
    first = F.min(F.when(F.col("_valid"), F.col(order))).over(Window.partitionBy("_name"))
    marked = rows.withColumns({"_name": name, "_valid": valid})
    status = F.when(~F.col("_valid"), "INVALID").when(F.col(order) > first, "DUPLICATE").otherwise("VALID")
    return marked.withColumn("status", status).withColumn("point_id", F.when(F.col("_name") != "", F.col("_name"))).drop("_name", "_valid")


def staged_points(spark: SparkSession, path: str) -> DataFrame:
    """Points of a delimited file, leniently: every row with its line's place (``seq``) and a status (VALID, INVALID, DUPLICATE).

    Of repeated ids the first line counts, so one file is read at a time.
    """
    raw = _read(spark, path)
    if len(raw.inputFiles()) > 1:
        raise ValueError("one file at a time: the order of several isn't known")
    names = _mapping(raw.columns, strict=False)
    col = lambda n: F.col(f"`{names[n]}`") if n in names else F.lit(None).cast("string")
    rows = raw.select(F.monotonically_increasing_id().alias("seq"), col("point_id").alias("point_id"), *[finite(col(n)).alias(n) for n in ("northing", "easting", "elevation")], col("description").alias("description"))
    return staged(rows, "seq")


def commit_staged(existing: DataFrame, staged: DataFrame) -> DataFrame:
    """Valid staged points that aren't there yet."""
    return staged.where("status = 'VALID'").drop("status").join(existing.select(F.col("point_id").cast("string").alias("point_id")), "point_id", "left_anti").select(*[c for c in staged.columns if c != "status"])


def commit_conflicts(existing: DataFrame, staged: DataFrame) -> DataFrame:
    """Ids that a commit leaves out for review: those that exist, and those that the file repeats, with the number of their rows."""
    there = existing.select(F.col("point_id").cast("string").alias("point_id")).distinct().withColumn("_there", F.lit(True))
    left = staged.where("status != 'INVALID'").join(there, "point_id", "left").where("_there or status = 'DUPLICATE'")
    return left.groupBy("point_id").agg(F.count(F.lit(1)).alias("rows"))


def commit_summary(existing: DataFrame, staged: DataFrame) -> DataFrame:
    """One row: points inserted, ids in conflict, rows skipped as invalid, and COMMITTED or COMMITTED_WITH_REVIEW."""
    there = existing.select(F.col("point_id").cast("string").alias("point_id")).distinct().withColumn("_there", F.lit(True))
    rows = staged.join(there, "point_id", "left").withColumn("_there", F.coalesce("_there", F.lit(False)))
    valid, invalid = F.col("status") == "VALID", F.col("status") == "INVALID"
    sums = rows.agg(
        F.count_if(valid & ~F.col("_there")).alias("inserted"), F.countDistinct(F.when(~invalid & (F.col("_there") | (F.col("status") == "DUPLICATE")), F.col("point_id"))).alias("conflicts"), F.count_if(invalid).alias("skipped")
    )
    return sums.withColumn("status", F.when(F.col("conflicts") + F.col("skipped") > 0, "COMMITTED_WITH_REVIEW").otherwise("COMMITTED"))


def whitespace_points(spark: SparkSession, path: str) -> DataFrame:
    """Points of a headerless text file: id, northing, easting, elevation, rest as code, parted by blanks."""
    parts = F.split(F.trim("value"), r"\s+", 5)
    rows = spark.read.text(path).where("trim(value) != ''").select(parts.alias("p"))
    at = lambda k: F.try_element_at("p", F.lit(k))
    return rows.select(at(1).alias("point_id"), *[finite(at(k)).alias(n) for k, n in ((2, "northing"), (3, "easting"), (4, "elevation"))], F.coalesce(at(5), F.lit("")).alias("code"))


def header_signature(columns: list[str]) -> str:
    """Twenty hex digits that name a set of headers."""
    import hashlib
    import re

    keys = sorted(re.sub(r"[^a-z0-9]+", "", c.lower()) for c in columns)
    return hashlib.sha256("|".join(keys).encode()).hexdigest()[:20]


def feature_schema(features: DataFrame, properties: str = "properties") -> DataFrame:
    """The types that each property's values look like, over all features of a map<string,string> column."""
    rows = features.select(F.explode(properties).alias("name", "value"))
    kind = F.when(F.col("value").isNull(), "null").when(F.col("value").rlike(r"^[+-]?\d+$"), "integer").when(F.col("value").try_cast("double").isNotNull(), "number").when(F.lower("value").isin("true", "false"), "boolean").otherwise("text")
    return rows.groupBy("name").agg(F.sort_array(F.collect_set(kind)).alias("types"))


def geojson_features(spark: SparkSession, path: str) -> DataFrame:
    """Point features of GeoJSON collections: coordinates and properties; other geometries keep null coordinates."""
    schema = "type string, features array<struct<geometry:struct<type:string,coordinates:string>,properties:map<string,string>>>"
    rows = spark.read.schema(schema).json(path, multiLine=True).select(F.explode("features").alias("f"))
    xy = F.from_json("f.geometry.coordinates", "array<double>")
    point = F.col("f.geometry.type") == "Point"
    return rows.select(F.col("f.geometry.type").alias("kind"), F.when(point, F.get(xy, F.lit(0))).alias("x"), F.when(point, F.get(xy, F.lit(1))).alias("y"), F.col("f.geometry.coordinates").alias("coordinates"), F.col("f.properties").alias("properties"))


def landxml_points(spark: SparkSession, path: str) -> DataFrame:
    """CgPoint rows of LandXML: name, code, and ``N E [Z]`` from the text."""
    rows = spark.read.format("xml").option("rowTag", "CgPoint").schema("_name string, _code string, _VALUE string").load(path)
    p = F.split(F.trim("_VALUE"), r"\s+")
    at = lambda k: finite(F.try_element_at(p, F.lit(k)))
    return rows.select(F.col("_name").alias("point_id"), F.col("_code").alias("code"), at(1).alias("northing"), at(2).alias("easting"), at(3).alias("elevation"))


def jobxml_points(spark: SparkSession, path: str) -> DataFrame:
    """Point rows of job XML: name and grid coordinates; rows without a name or coordinates are left out."""
    grid = "struct<North:string,East:string,Elevation:string>"
    rows = spark.read.format("xml").option("rowTag", "Point").schema(f"Name string, Code string, Grid {grid}").load(path)
    return rows.select(F.col("Name").alias("point_id"), F.col("Code").alias("code"), finite(F.col("Grid.North")).alias("northing"), finite(F.col("Grid.East")).alias("easting"), finite(F.col("Grid.Elevation")).alias("elevation")).where("point_id is not null and northing is not null and easting is not null")


def kml_points(spark: SparkSession, path: str) -> DataFrame:
    """Placemarks with a point: name, longitude, latitude, height."""
    rows = spark.read.format("xml").option("rowTag", "Placemark").schema("name string, Point struct<coordinates:string>").load(path)
    p = F.split(F.trim("Point.coordinates"), ",")
    return rows.where("Point is not null").select("name", *[finite(F.try_element_at(p, F.lit(k))).alias(n) for k, n in ((1, "lon"), (2, "lat"), (3, "height"))])


def register_sources(spark: SparkSession, pattern: str) -> DataFrame:
    """Files as sources: path, bytes and SHA-256 of the content; the first path of equal contents is the original."""
    rows = spark.read.format("binaryFile").load(pattern).select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))
    return rows.withColumn("original", F.min("path").over(Window.partitionBy("sha256")))


