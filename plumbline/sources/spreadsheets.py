"""Rows of workbooks (XLSX) as a Spark data source, and code lists and profiles from workbooks or CSV files.

A workbook's sheets are partitions.  A sheet's XML is read as events, row by
row, straight out of the archive; only the shared strings are held.
"""

from __future__ import annotations

import datetime as dt
import posixpath
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from xml.etree.ElementTree import ParseError, iterparse

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from plumbline.functions.ids import suggested_role
from plumbline.storage import arrow_files

#: Headings of code profiles, words that exclude a code, and names of how a code matches.
PROFILE_HEADINGS = {
    "code": ("code", "survey code", "feature code", "field code", "point code"),
    "category": ("category", "description", "type", "feature type", "structure type"),
    "include": ("include", "included", "enabled", "use", "active"),
    "match": ("match", "match mode", "match type", "matching"),
}
EXCLUDES = ("0", "false", "no", "n", "exclude", "excluded", "off")
MATCHES = {"EXACT": ("exact", "equals", "equal"), "STARTS_WITH": ("startswith", "starts_with", "prefix"), "CONTAINS": ("contains", "contain")}
#: Rows in which a profile's heading may stand, and codes a list may have.
HEADING_ROWS, MOST_CODES = 20, 5000
#: Number formats of spreadsheets that are dates or times of day.
DATE_FORMATS = {*range(14, 23), *range(45, 48)}
_SCHEMA = "sheet int, name string, row long, cells array<string>"


class BrokenWorkbook(ValueError):
    pass


def _tag(element) -> str:
    return element.tag.rsplit("}", 1)[-1]


def _events(book: zipfile.ZipFile, part: str, names: set[str]) -> Iterator:
    """Elements of a part with one of the names, each let go when it has been seen."""
    with book.open(part) as source:
        root = None
        for event, element in iterparse(source, ("start", "end")):
            if root is None:
                root = element
            if event == "end" and _tag(element) in names:
                yield element
                root.clear()


def _text(element) -> str:
    """Text of runs, without what is read aloud beside them."""
    if _tag(element) == "rPh":
        return ""
    own = (element.text or "") if _tag(element) == "t" else ""
    return own + "".join(_text(c) for c in element)


def _relations(book: zipfile.ZipFile, part: str) -> dict[str, str]:
    folder, name = posixpath.split(part)
    listed = f"{folder}/_rels/{name}.rels" if folder else f"_rels/{name}.rels"
    if listed not in book.namelist():
        return {}
    return {e.get("Id"): posixpath.normpath(posixpath.join(folder, e.get("Target"))) if not e.get("Target").startswith("/") else e.get("Target")[1:] for e in _events(book, listed, {"Relationship"})}


def sheets(book: zipfile.ZipFile) -> list[tuple[str, str]]:
    """Name and part of each sheet, in the workbook's order."""
    targets = _relations(book, "xl/workbook.xml")
    out = []
    for e in _events(book, "xl/workbook.xml", {"sheet"}):
        link = next((v for k, v in e.attrib.items() if k.rsplit("}", 1)[-1] == "id"), None)
        if link in targets:
            out.append((e.get("name"), targets[link]))
    return out


def _shared(book: zipfile.ZipFile) -> list[str]:
    if "xl/sharedStrings.xml" not in book.namelist():
        return []
    return [_text(e) for e in _events(book, "xl/sharedStrings.xml", {"si"})]


def _dates(book: zipfile.ZipFile) -> tuple[list[bool], bool]:
    """Which cell styles are dates, and whether days are counted from 1904."""
    own, styles, inside = {}, [], False
    if "xl/styles.xml" in book.namelist():
        with book.open("xl/styles.xml") as source:
            for event, e in iterparse(source, ("start", "end")):
                name = _tag(e)
                if name == "cellXfs":
                    inside = event == "start"
                elif event == "end" and name == "numFmt":
                    # Quoted text and bracketed conditions don't make a date.
                    code, plain, skip = e.get("formatCode") or "", "", None
                    for ch in code:
                        if skip:
                            skip = None if ch == skip else skip
                        elif ch in "\"[":
                            skip = "\"" if ch == "\"" else "]"
                        else:
                            plain += ch.lower()
                    own[int(e.get("numFmtId"))] = any(ch in plain for ch in "ymdhs")
                elif event == "end" and name == "xf" and inside:
                    number = int(e.get("numFmtId") or 0)
                    styles.append(own.get(number, number in DATE_FORMATS))
    later = any(e.get("date1904") in ("1", "true") for e in _events(book, "xl/workbook.xml", {"workbookPr"}))
    return styles, later


def _place(reference: str, default: int) -> int:
    """Column number from a reference such as AB12."""
    letters = reference.rstrip("0123456789")
    column = 0
    for ch in letters:
        column = column * 26 + ord(ch) - 64
    return column - 1 if letters else default


def _day(value: float, later: bool) -> str:
    start = dt.datetime(1904, 1, 1) if later else dt.datetime(1899, 12, 30)
    if not later and value < 60:
        # The calendar of spreadsheets has a 29 February 1900.
        start = dt.datetime(1899, 12, 31)
    found = start + dt.timedelta(seconds=round(value * 86_400))
    return found.date().isoformat() if found.time() == dt.time() and value >= 1 else found.isoformat(sep=" ") if value >= 1 else found.time().isoformat()


def _number(text: str) -> str:
    value = float(text)
    return str(int(value)) if value == int(value) and abs(value) < 1e15 else repr(value)


def rows(book: zipfile.ZipFile, part: str) -> Iterator[tuple[int, list[str | None]]]:
    """Row number from one, and the cells of each row that has any; gaps are None."""
    shared, (styles, later) = _shared(book), _dates(book)
    at = 0
    for row in _events(book, part, {"row"}):
        at = int(row.get("r") or at + 1)
        cells: list[str | None] = []
        for c in row:
            if _tag(c) != "c":
                continue
            place, kind = _place(c.get("r") or "", len(cells)), c.get("t") or "n"
            raw = next((v.text for v in c if _tag(v) == "v"), None)
            if kind == "inlineStr":
                value = "".join(_text(v) for v in c if _tag(v) == "is")
            elif raw is None:
                value = None
            elif kind == "s":
                value = shared[int(raw)]
            elif kind == "b":
                value = "True" if raw == "1" else "False"
            elif kind == "n":
                style = int(c.get("s") or 0)
                value = _day(float(raw), later) if style < len(styles) and styles[style] else _number(raw)
            else:
                value = raw
            cells += [None] * (place + 1 - len(cells))
            cells[place] = value
        if any(v not in (None, "") for v in cells):
            yield at, cells


@dataclass
class _Sheet(InputPartition):
    number: int
    name: str
    part: str


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.only = options["path"], options.get("sheet")

    def _book(self) -> zipfile.ZipFile:
        files, inner = arrow_files(self.path)
        try:
            return zipfile.ZipFile(files.open_input_file(inner))
        except zipfile.BadZipFile as e:
            raise BrokenWorkbook(f"{self.path} is no workbook: {e}") from e

    def partitions(self):
        with self._book() as book:
            try:
                found = [_Sheet(k, name, part) for k, (name, part) in enumerate(sheets(book))]
            except KeyError as e:
                raise BrokenWorkbook(f"{self.path} is no workbook: {e}") from e
        chosen = [s for s in found if self.only in (None, s.name)]
        if not chosen:
            raise BrokenWorkbook(f"{self.path} has no sheet {self.only or ''}".rstrip())
        return chosen

    def read(self, partition: _Sheet) -> Iterator[pa.RecordBatch]:
        def given(held):
            columns = [pa.array([partition.number] * len(held), pa.int32()), pa.array([partition.name] * len(held)), pa.array([r for r, _ in held], pa.int64()), pa.array([c for _, c in held], pa.list_(pa.string()))]
            return pa.RecordBatch.from_arrays(columns, ["sheet", "name", "row", "cells"])

        held = []
        try:
            with self._book() as book:
                for found in rows(book, partition.part):
                    held.append(found)
                    if len(held) == 2048:
                        yield given(held)
                        held = []
        except (zipfile.BadZipFile, zlib.error, ParseError, KeyError, IndexError, EOFError) as e:
            raise BrokenWorkbook(f"sheet {partition.name} of {self.path} is damaged: {e}") from e
        yield given(held)


class WorkbookSource(DataSource):
    """``spark.read.format("workbook").load("x.xlsx")``: sheet, name, row and cells of every row that has any; option ``sheet`` picks one by name.

    Dates come as ISO text, whole numbers without decimals, formulas as the
    value that was stored with them.  A damaged archive fails the read.
    """

    @classmethod
    def name(cls) -> str:
        return "workbook"

    def schema(self) -> str:
        return _SCHEMA

    def reader(self, schema) -> _Reader:
        return _Reader(self.options)


def sheet_rows(spark: SparkSession, path: str) -> DataFrame:
    """Rows (sheet, name, row, cells) of a workbook, or of a CSV file as one sheet."""
    low = path.lower()
    if low.endswith((".xlsx", ".xlsm", ".xltx", ".xltm")):
        spark.dataSource.register(WorkbookSource)
        return spark.read.format("workbook").load(path)
    if low.endswith(".xls"):
        raise ValueError("workbooks of the old kind (.xls) can't be read; save them as .xlsx")
    text = spark.read.text(path)
    width = text.agg(F.max(F.length("value") - F.length(F.replace("value", F.lit(","), F.lit(""))) + 1)).first()[0] or 1
    names = [f"c{k}" for k in range(width)]
    raw = spark.read.csv(path, schema=", ".join(f"{n} string" for n in names), multiLine=True, ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)
    cells = F.transform(F.array(*names), lambda v: F.regexp_replace(v, "^﻿", ""))
    full = raw.select(cells.alias("cells")).where(F.exists("cells", lambda v: F.coalesce(v, F.lit("")) != ""))
    return full.select(F.lit(0).alias("sheet"), F.lit("").alias("name"), (F.monotonically_increasing_id() + 1).alias("row"), "cells")


def _cell(at: int | None) -> Column:
    return F.lit(None).cast("string") if at is None else F.nullif(F.trim(F.get("cells", F.lit(at))), F.lit(""))


def code_list(spark: SparkSession, path: str) -> DataFrame:
    """``(code, description, role)`` of a code list with the headers code, description and maybe role.

    Codes are in upper case and must be there and unique; a missing role
    follows from the description.  One sheet, the first, is read; 1 to 5,000
    codes.
    """
    every = sheet_rows(spark, path).where("sheet = 0")
    head = every.orderBy("row").limit(1).collect()
    names = [(v or "").strip().lower() for v in head[0].cells] if head else []
    if "code" not in names or "description" not in names:
        raise ValueError("a code list requires the headers code, description, and maybe role")
    role = names.index("role") if "role" in names else None
    body = every.where(F.col("row") > head[0].row)
    found = body.select(F.upper(_cell(names.index("code"))).alias("code"), F.coalesce(_cell(names.index("description")), F.lit("")).alias("description"), F.lower(_cell(role)).alias("role"))
    total, distinct, empty = found.agg(F.count(F.lit(1)), F.countDistinct("code"), F.count_if(F.col("code").isNull())).first()
    if not 1 <= total <= MOST_CODES:
        raise ValueError(f"a code list has 1 to {MOST_CODES} codes, this one {total}")
    if empty or distinct < total:
        raise ValueError(f"{empty} codes are empty and {total - empty - distinct} are repeated")
    return found.withColumn("role", F.coalesce("role", suggested_role(F.col("description"))))


def _heading(cells: list[str | None]) -> dict[str, int]:
    known = {alias: name for name, aliases in PROFILE_HEADINGS.items() for alias in aliases}
    found: dict[str, int] = {}
    for k, value in enumerate(cells):
        name = known.get(" ".join((value or "").lower().replace("_", " ").replace("-", " ").split()))
        if name:
            found.setdefault(name, k)
    return found


def code_profile(spark: SparkSession, path: str) -> DataFrame:
    """``(row, code, category, include, match)`` of a client's codes: the first sheet with a code heading among its first 20 rows and a code below it.

    Of rows that are the same without case the first counts; rows without a
    code are left out; an unknown kind of match fails the read.
    """
    every = sheet_rows(spark, path)
    first = 1 if path.lower().endswith(".csv") else HEADING_ROWS
    heads = sorted(every.where(F.col("row") <= first).collect(), key=lambda r: (r.sheet, r.row))
    for head in heads:
        at = _heading(head.cells)
        if "code" not in at or any(h.sheet == head.sheet and h.row < head.row and "code" in _heading(h.cells) for h in heads):
            continue
        plain = F.regexp_replace(F.lower(_cell(at.get("match"))), "[- ]", "_")
        match = F.when(plain.isNull(), "EXACT")
        for kind, names in MATCHES.items():
            match = match.when(plain.isin(*names), kind)
        include = ~F.coalesce(F.lower(_cell(at.get("include"))).isin(*EXCLUDES), F.lit(False))
        body = every.where((F.col("sheet") == head.sheet) & (F.col("row") > head.row)).select(
            "row", _cell(at["code"]).alias("code"), F.coalesce(_cell(at.get("category")), F.lit("Structure")).alias("category"), include.alias("include"), match.alias("match")
        ).where("code is not null")
        total, bad = body.agg(F.count(F.lit(1)), F.count_if(F.col("match").isNull())).first()
        if bad:
            raise ValueError(f"{bad} rows have an invalid match")
        if total:
            once = body.groupBy(F.lower("code").alias("k"), F.lower("category").alias("c"), "include", "match").agg(F.min_by(F.struct("row", "code", "category"), "row").alias("r"))
            return once.select("r.row", "r.code", "r.category", "include", "match")
    raise ValueError(f"{path} has no code heading with codes below it")
