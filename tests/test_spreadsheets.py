from __future__ import annotations

import zipfile
from xml.sax.saxutils import escape

import pytest

from plumbline.sources import spreadsheets as s

NS = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'


def letters(k):
    return (chr(64 + k // 26) if k >= 26 else "") + chr(65 + k % 26)


def workbook(path, tables, shared=True, formats=(), lost=()):
    """A workbook from {sheet: rows}; a cell is text, a number, a bool, None, or (number, style)."""
    strings, parts = [], {}
    for n, (_, table) in enumerate(tables.items(), 1):
        out = []
        for i, row in enumerate(table, 1):
            cells = ""
            for k, v in enumerate(row):
                at = f'r="{letters(k)}{i}"'
                if v is None:
                    continue
                if isinstance(v, bool):
                    cells += f'<c {at} t="b"><v>{int(v)}</v></c>'
                elif isinstance(v, tuple):
                    cells += f'<c {at} s="{v[1]}"><v>{v[0]}</v></c>'
                elif isinstance(v, str) and shared:
                    strings.append(v)
                    cells += f'<c {at} t="s"><v>{len(strings) - 1}</v></c>'
                elif isinstance(v, str):
                    cells += f'<c {at} t="inlineStr"><is><r><t>{escape(v)}</t></r></is></c>'
                else:
                    cells += f"<c {at}><f>1+1</f><v>{v}</v></c>"
            out.append(f'<row r="{i}">{cells}</row>')
        parts[f"xl/worksheets/s{n}.xml"] = f"<worksheet {NS}><sheetData>{''.join(out)}</sheetData></worksheet>"
    parts["xl/workbook.xml"] = f"<workbook {NS}><workbookPr/><sheets>" + "".join(f'<sheet name="{escape(t)}" sheetId="{n}" r:id="r{n}"/>' for n, t in enumerate(tables, 1)) + "</sheets></workbook>"
    parts["xl/_rels/workbook.xml.rels"] = '<Relationships xmlns="x">' + "".join(f'<Relationship Id="r{n}" Target="{"/xl/" if n % 2 else ""}worksheets/s{n}.xml"/>' for n in range(1, len(tables) + 1)) + "</Relationships>"
    if strings:
        parts["xl/sharedStrings.xml"] = f"<sst {NS}>" + "".join(f"<si><r><t>{escape(t[:1])}</t></r><r><t>{escape(t[1:])}</t></r><rPh><t>no</t></rPh></si>" for t in strings) + "</sst>"
    custom = "".join(f'<numFmt numFmtId="{k}" formatCode="{escape(f, {chr(34): "&quot;"})}"/>' for k, f in enumerate(formats, 164))
    parts["xl/styles.xml"] = f'<styleSheet {NS}><numFmts>{custom}</numFmts><cellStyleXfs><xf numFmtId="14"/></cellStyleXfs><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/>' + "".join(f'<xf numFmtId="{164 + k}"/>' for k in range(len(formats))) + "</cellXfs></styleSheet>"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in parts.items():
            if name not in lost:
                z.writestr(name, text)
    return str(path)


def read(spark, path, **options):
    spark.dataSource.register(s.WorkbookSource)
    return sorted((r.sheet, r.name, r.row, r.cells) for r in spark.read.format("workbook").options(**options).load(path).collect())


@pytest.mark.parametrize("shared", [True, False])
def test_cells_of_all_kinds(spark, tmp_path, shared):
    rows = [["é <b>", None, 3, 2.5, True], [], [None, ""], [(45000, 1), (0.5, 2), (45000.25, 2), (5, 3), 1e20]]
    path = workbook(tmp_path / "a.xlsx", {"One": rows, "Two & 3": [["x"]]}, shared, ["yyyy-mm-dd hh:mm", '0.0 "days"'])
    got = read(spark, path)
    assert got[0] == (0, "One", 1, ["é <b>", None, "3", "2.5", "True"]) and got[2] == (1, "Two & 3", 1, ["x"]) and len(got) == 3
    assert got[1] == (0, "One", 4, ["2023-03-15", "12:00:00", "2023-03-15 06:00:00", "5", "1e+20"])
    assert read(spark, path, sheet="Two & 3") == [got[2]]
    with pytest.raises(Exception, match="no sheet"):
        read(spark, path, sheet="none")


def test_five_thousand_rows_stream(spark, tmp_path):
    table = [["Code", "Description"], *[[f"c{k}", f"manhole {k}" if k % 2 else "edge of pavement"] for k in range(5000)]]
    codes = s.code_list(spark, workbook(tmp_path / "b.xlsx", {"codes": table}))
    got = {r.code: (r.description, r.role) for r in codes.collect()}
    assert len(got) == 5000 and got["C1"][0] == "manhole 1" and got["C1"][1] != got["C2"][1]
    with pytest.raises(ValueError, match="5001"):
        s.code_list(spark, workbook(tmp_path / "c.xlsx", {"codes": [*table, ["more", "x"]]}))


def test_code_lists_in_both_kinds_of_file(spark, tmp_path):
    table = [["Role", " CODE", "Description "], ["Surface", "mh1 ", "Manhole"], [None, "ep", "edge of pavement"]]
    (tmp_path / "d.csv").write_text("﻿Role, CODE,Description \nSurface,mh1 ,Manhole\n,ep,edge of pavement\n", encoding="utf-8")
    want = None
    for path in (workbook(tmp_path / "d.xlsx", {"codes": table, "other": [["x"]]}), str(tmp_path / "d.csv")):
        got = sorted(tuple(r) for r in s.code_list(spark, path).collect())
        assert [r[:2] for r in got] == [("EP", "edge of pavement"), ("MH1", "Manhole")] and got[1][2] == "surface"
        assert want in (None, got)
        want = got
    for bad in ([["Code", "Description"], ["a", "x"], ["A", "y"]], [["Code", "Description"], ["", "x"]], [["Code"], ["a"]], [["Code", "Description"]]):
        with pytest.raises(ValueError):
            s.code_list(spark, workbook(tmp_path / "e.xlsx", {"codes": bad}))


def test_profiles_under_a_title(spark, tmp_path):
    table = [["Client codes"], [None, "made in May"], ["Feature_Code", "Type", "Use", "Match-Mode"], ["MH", "Manhole", "yes", "Starts With"], ["mh", "MANHOLE", "", "prefix"], [None, "x"], ["GI", None, "Off", None], ["CB", "Basin", 0, "contain"]]
    path = workbook(tmp_path / "p.xlsx", {"notes": [["Code"], ["", "no codes here"]], "codes": table})
    got = sorted((r.code, r.category, r.include, r.match) for r in s.code_profile(spark, path).collect())
    assert got == [("CB", "Basin", False, "CONTAINS"), ("GI", "Structure", False, "EXACT"), ("MH", "Manhole", True, "STARTS_WITH")]
    (tmp_path / "p.csv").write_text("Code,Match\nA,exact\nB,sideways\n", encoding="utf-8")
    with pytest.raises(ValueError, match="match"):
        s.code_profile(spark, str(tmp_path / "p.csv"))
    with pytest.raises(ValueError, match="heading"):
        s.code_profile(spark, workbook(tmp_path / "q.xlsx", {"a": [["x"]]}))
    with pytest.raises(ValueError, match="xls"):
        s.code_profile(spark, "old.xls")


def test_broken_archives_raise(spark, tmp_path):
    (tmp_path / "x.xlsx").write_bytes(b"not an archive")
    with pytest.raises(Exception, match="no workbook"):
        read(spark, str(tmp_path / "x.xlsx"))
    with pytest.raises(Exception, match="damaged"):
        read(spark, workbook(tmp_path / "y.xlsx", {"a": [["text"]]}, lost=("xl/sharedStrings.xml",)))
    path = workbook(tmp_path / "z.xlsx", {"a": [[f"t{k}" * 50] for k in range(3000)]}, shared=False)
    with zipfile.ZipFile(path) as z:
        at = z.getinfo("xl/worksheets/s1.xml").header_offset
    data = bytearray(open(path, "rb").read())
    data[at + 80 : at + 200] = bytes(120)
    open(path, "wb").write(data)
    with pytest.raises(Exception, match="damaged|no workbook|invalid"):
        read(spark, path)
