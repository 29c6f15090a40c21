"""Deliverables: delimited points, GeoJSON, LandXML, corrections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.ids import csv_safe


def fixed(value: Column, places: int) -> Column:
    """A number as text with a fixed number of decimals; empty for null."""
    return F.coalesce(F.format_string(f"%.{places}f", value.cast("double")), F.lit("")) if 0 <= places <= 10 else F.raise_error(F.lit("places must be 0 to 10"))


def pnezd(points: DataFrame, places: int = 3) -> DataFrame:
    """``value``: one line a point, id, northing, easting, elevation, description."""
    number = lambda c: F.when(F.col(c).isNotNull(), fixed(F.col(c), places)).otherwise("")
    return points.select(F.concat_ws(",", F.col("point_id").cast("string"), number("northing"), number("easting"), number("elevation"), csv_safe(F.coalesce("description", F.lit("")))).alias("value"))


def geojson(points: DataFrame) -> DataFrame:
    """``value``: one GeoJSON feature a line."""
    geometry = F.struct(F.lit("Point").alias("type"), F.array("easting", "northing").alias("coordinates"))
    properties = F.struct(F.col("point_id").cast("string").alias("point_id"), F.coalesce("description", F.lit("")).alias("description"))
    return points.select(F.to_json(F.struct(F.lit("Feature").alias("type"), geometry.alias("geometry"), properties.alias("properties"))).alias("value"))


def line_geojson(vertices: DataFrame, line: str = "line_id", order: str = "seq") -> DataFrame:
    """``value``: a LineString feature for each line of two or more vertices; a line's vertices meet in one row."""
    grouped = vertices.groupBy(line).agg(F.array_sort(F.collect_list(F.struct(order, "easting", "northing"))).alias("v")).where(F.size("v") >= 2)
    geometry = F.struct(F.lit("LineString").alias("type"), F.transform("v", lambda p: F.array(p["easting"], p["northing"])).alias("coordinates"))
    return grouped.select(F.to_json(F.struct(F.lit("Feature").alias("type"), geometry.alias("geometry"), F.struct(F.col(line)).alias("properties"))).alias("value"))


def write_points(points: DataFrame, path: str, profile: str = "csv", places: int = 3) -> None:
    """Write points as csv (with a header), pnezd or geojson part files."""
    if profile == "csv":
        number = lambda c: F.when(F.col(c).isNotNull(), fixed(F.col(c), places)).alias(c)
        points.select("point_id", number("northing"), number("easting"), number("elevation"), csv_safe(F.col("description")).alias("description")).write.csv(path, header=True)
    elif profile in ("pnezd", "geojson"):
        (pnezd(points, places) if profile == "pnezd" else geojson(points)).write.text(path)
    else:
        raise ValueError(f"unknown profile {profile}")


def write_landxml(points: DataFrame, path: str, places: int = 4) -> None:
    """Write CgPoint elements that ``landxml_points`` reads."""
    text = F.concat_ws(" ", fixed(F.col("northing"), places), fixed(F.col("easting"), places), F.when(F.col("elevation").isNotNull(), fixed(F.col("elevation"), places)))
    rows = points.select(F.col("point_id").cast("string").alias("_name"), F.coalesce("description", F.lit("")).alias("_code"), text.alias("_VALUE"))
    rows.write.format("xml").option("rootTag", "CgPoints").option("rowTag", "CgPoint").save(path)


def kml(points: DataFrame, lon: str = "lon", lat: str = "lat") -> DataFrame:
    """``value``: one KML placemark a line, for points with longitude and latitude."""
    safe = lambda c: F.replace(F.replace(F.replace(F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    place = F.concat_ws(",", F.col(lon).cast("string"), F.col(lat).cast("string"), F.coalesce(F.col("elevation"), F.lit(0.0)).cast("string"))
    shown = points.where(F.col(lon).isNotNull() & F.col(lat).isNotNull())
    return shown.select(F.concat(F.lit("<Placemark><name>"), safe("point_id"), F.lit("</name><description>"), safe("description"), F.lit("</description><Point><coordinates>"), place, F.lit("</coordinates></Point></Placemark>")).alias("value"))


def write_kml(points: DataFrame, path: str) -> None:
    """Write placemarks as part files that ``tables.kml_points`` reads; each file is a list of placemarks."""
    kml(points).write.text(path)


def dxf_points(points: DataFrame) -> DataFrame:
    """``value``: the group lines of one POINT entity a row, on the layer of the point's description; a drawing needs a section head and end around them."""
    layer = F.coalesce(F.nullif(F.regexp_replace(F.trim(F.coalesce("description", F.lit(""))), r"[^A-Za-z0-9_-]+", "_"), F.lit("")), F.lit("0"))
    number = lambda c: F.format_string("%.6f", F.coalesce(F.col(c), F.lit(0.0)))
    return points.select(F.concat_ws("\n", F.lit("0"), F.lit("POINT"), F.lit("8"), layer, F.lit("10"), number("easting"), F.lit("20"), number("northing"), F.lit("30"), number("elevation")).alias("value"))


def project_map(points: DataFrame, structures: DataFrame, controls: DataFrame) -> DataFrame:
    """``value``: one GeoJSON feature a line for every survey point, structure and control that has a place; what each knows beside it are its properties."""
    place = F.struct(F.lit("Point").alias("type"), F.array("easting", "northing").alias("coordinates"))

    def features(rows: DataFrame, kind: str, key: str) -> DataFrame:
        rest = [c for c in rows.columns if c not in ("northing", "easting", key)]
        properties = F.struct(F.lit(kind).alias("kind"), F.col(key).cast("string").alias("id"), *rest)
        return rows.where("northing is not null and easting is not null").select(F.to_json(F.struct(F.lit("Feature").alias("type"), place.alias("geometry"), properties.alias("properties"))).alias("value"))

    return features(points, "survey_point", "point_id").unionByName(features(structures, "utility_structure", "structure_id")).unionByName(features(controls, "control", "control_id"))


def write_table(rows: DataFrame, path: str) -> None:
    """Write any flat table (structures, pipes, edges, reviews, control results) as csv part files; texts that a spreadsheet would read as formulas are made safe."""
    rows.select(*[csv_safe(F.col(c)).alias(c) if kind == "string" else F.col(c) for c, kind in rows.dtypes]).write.csv(path, header=True)
