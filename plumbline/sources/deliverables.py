"""Deliverables: partitioned CSV outputs that appear whole or not at all, and corrected copies of points.

Every task writes a file of its own attempt; only the commit, one manifest,
names files.  What failed or repeated attempts leave is never read.
"""

from __future__ import annotations

import csv
import hashlib
import io
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from plumbline.storage import arrow_files

#: First characters by which a text cell could be taken for a formula, and units in which heights may be corrected.
FORMULAS = ("=", "+", "-", "@")
UNITS = ("us_survey_feet", "international_feet", "meters")
COLUMNS = ("point_uuid", "point_id", "northing", "easting", "elevation", "description", "crs", "horizontal_units", "vertical_units", "source_id")


@dataclass
class Part(WriterCommitMessage):
    file: str
    rows: int
    size: int
    sha256: str


def cell(value) -> str:
    """A value as a CSV cell; text that could be a formula gets an apostrophe."""
    if value is None:
        return ""
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, str) and value.lstrip().startswith(FORMULAS):
        return "'" + value
    return repr(value) if isinstance(value, float) else str(value)


def _manifests(files: pafs.FileSystem, root: str, name: str) -> list[tuple[int, str]]:
    listed = files.get_file_info(pafs.FileSelector(root, allow_not_found=True))
    prefix = f"{name}.manifest-"
    found = [(i.base_name[len(prefix) : -5], i.path) for i in listed if i.base_name.startswith(prefix) and i.base_name.endswith(".json")]
    return sorted((int(n), path) for n, path in found if n.isdigit())


def manifest(folder: str, name: str) -> dict | None:
    """The last whole commit of a deliverable: columns and parts (None before the first).  One that was cut off is passed over."""
    files, root = arrow_files(folder)
    for number, path in reversed(_manifests(files, root, name)):
        with files.open_input_stream(path) as source:
            try:
                return json.loads(source.read()) | {"number": number}
            except ValueError:
                continue
    return None


class _Writer(DataSourceWriter):
    def __init__(self, options: dict, schema, overwrite: bool):
        self.folder, self.deliverable, self.overwrite = options["path"].rstrip("/"), options.get("deliverable", "table"), overwrite
        self.columns, self.ddl = schema.fieldNames(), ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)

    def write(self, iterator: Iterator) -> Part:
        files, root = arrow_files(self.folder)
        files.create_dir(f"{root}/parts", recursive=True)
        file, rows, size, digest = f"parts/{self.deliverable}-{uuid.uuid4().hex}.csv", 0, 0, hashlib.sha256()
        with files.open_output_stream(f"{root}/{file}") as out:
            text = io.StringIO(newline="")
            writer = csv.writer(text)
            writer.writerow(self.columns)

            def flush():
                nonlocal size
                data = text.getvalue().encode()
                out.write(data)
                digest.update(data)
                size += len(data)
                text.seek(0)
                text.truncate()

            for row in iterator:
                writer.writerow([cell(v) for v in row])
                rows += 1
                if text.tell() > 1 << 20:
                    flush()
            flush()
        return Part(file, rows, size, digest.hexdigest())

    def commit(self, messages: list[Part | None]) -> None:
        files, root = arrow_files(self.folder)
        before = manifest(self.folder, self.deliverable)
        kept = before["parts"] if before and not self.overwrite else []
        told = {"deliverable": self.deliverable, "columns": self.columns, "schema": self.ddl, "parts": kept + [vars(m) for m in messages if m is not None and m.rows]}
        number = max((n for n, _ in _manifests(files, root, self.deliverable)), default=0) + 1
        with files.open_output_stream(f"{root}/{self.deliverable}.manifest-{number:06d}.json") as out:
            out.write(json.dumps(told, indent=1).encode())

    def abort(self, messages: list[Part | None]) -> None:
        files, root = arrow_files(self.folder)
        for m in messages:
            if m is not None:
                files.delete_file(f"{root}/{m.file}")


class DeliverableSink(DataSource):
    """``df.write.format("deliverable").option("deliverable", name).mode("overwrite").save(folder)``: CSV parts and one manifest of them."""

    @classmethod
    def name(cls) -> str:
        return "deliverable"

    def writer(self, schema, overwrite: bool) -> _Writer:
        return _Writer(self.options, schema, overwrite)


def write_deliverable(rows: DataFrame, folder: str, name: str, mode: str = "overwrite") -> None:
    """Write flat rows as the deliverable ``name`` under ``folder``; with mode ``append`` to what its last commit has."""
    rows.sparkSession.dataSource.register(DeliverableSink)
    rows.write.format("deliverable").option("deliverable", name).mode(mode).save(folder)


def read_deliverable(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """Rows of the last commit; texts keep the apostrophe before what could be a formula.  Raises where nothing was committed or a part isn't whole."""
    told = manifest(folder, name)
    if told is None:
        raise FileNotFoundError(f"{folder} has no deliverable {name}")
    files, root = arrow_files(folder)
    for part in told["parts"]:
        info = files.get_file_info(f"{root}/{part['file']}")
        if info.size != part["size"]:
            raise ValueError(f"part {part['file']} isn't whole")
    if not told["parts"]:
        return spark.createDataFrame([], told["schema"])
    return spark.read.csv([f"{folder.rstrip('/')}/{p['file']}" for p in told["parts"]], header=True, schema=told["schema"], enforceSchema=True, quote='"', escape='"', multiLine=True, nullValue="")


def corrected_points(points: DataFrame, changes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(copy, evidence)``: all points (COLUMNS) with the offsets of ``changes`` (point_uuid, offset) added to their elevations, and one row of evidence a change.

    The points themselves stay as they are.  Fails when it is read if a point
    has two changes or is there twice or not at all, has no finite elevation
    or no recognised unit, or if a result isn't finite: so a correction is
    applied once or nothing is.
    """
    once = changes.groupBy("point_uuid").agg(F.count(F.lit(1)).alias("changes"), F.first("offset").alias("offset"))
    there = points.groupBy("point_uuid").agg(F.count(F.lit(1)).alias("rows"))
    both = once.join(there, "point_uuid", "left").join(points.select(*COLUMNS), "point_uuid", "left")
    finite = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    value = F.col("elevation") + F.col("offset")
    fault = (
        F.when(F.col("changes") > 1, "a record can be corrected only once").when(F.coalesce("rows", F.lit(0)) != 1, "a correction needs one existing record").when(~finite(F.col("elevation")), "a correction needs a finite elevation")
        .when(~F.coalesce(F.col("vertical_units").isin(*UNITS), F.lit(False)), "confirm recognised units first").when(~F.coalesce(finite(value), F.lit(False)), "a corrected elevation must be finite")
    )
    checked = F.when(fault.isNotNull(), F.raise_error(F.concat(fault, F.lit(": "), F.coalesce("point_uuid", F.lit("null")))).cast("double")).otherwise(value)
    evidence = both.select(*COLUMNS, "offset", checked.alias("corrected_elevation"))
    new = evidence.select(F.col("point_uuid").alias("_uuid"), "corrected_elevation")
    # A change without a point has no row to fall on; the outer join lets its fault be seen.
    copy = points.select(*COLUMNS).join(new, F.col("point_uuid") == F.col("_uuid"), "full_outer")
    kept = [F.coalesce("corrected_elevation", "elevation").alias(c) if c == "elevation" else F.col(c) for c in COLUMNS]
    return copy.where("point_uuid is not null or corrected_elevation is null").select(*kept), evidence
