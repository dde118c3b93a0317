"""Workbooks, array archives, listings, and one row to many."""

import os
import zipfile
from datetime import datetime

import numpy as np

from corvane.operators import cases
from corvane.sources import archives as A
from corvane.sources import tables as T

NS = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
REL = 'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'


def workbook(path, sheets):
    """sheets: name -> rows of cells; texts are shared, and numbers plain."""
    shared = sorted({c for rows in sheets.values() for r in rows for c in r if isinstance(c, str)})
    cell = lambda v, at: "" if v is None else f'<c r="{at}" t="s"><v>{shared.index(v)}</v></c>' if isinstance(v, str) else f'<c r="{at}"><v>{v}</v></c>'
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f"<workbook {NS} {REL}><sheets>" + "".join(f'<sheet name="{n}" sheetId="{k}" r:id="r{k}"/>' for k, n in enumerate(sheets, 1)) + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">' + "".join(f'<Relationship Id="r{k}" Target="worksheets/s{k}.xml"/>' for k in range(1, len(sheets) + 1)) + "</Relationships>")
        z.writestr("xl/sharedStrings.xml", f"<sst {NS}>" + "".join(f"<si><t>{s}</t></si>" for s in shared) + "</sst>")
        for k, rows in enumerate(sheets.values(), 1):
            body = "".join(f'<row r="{y}">' + "".join(cell(v, f"{chr(65 + x)}{y}") for x, v in enumerate(r)) + "</row>" for y, r in enumerate(rows, 1))
            z.writestr(f"xl/worksheets/s{k}.xml", f"<worksheet {NS}><sheetData>{body}</sheetData></worksheet>")


def test_workbooks(spark, tmp_path):
    workbook(tmp_path / "a.xlsx", {"notes": [["nothing"]], "cases": [["Clinical data"], [" Patient ", "Side", "Age"], ["p1", "L", 51], ["p2", None, 60.5], [None, None, None], ["p3", "R", None]]})
    workbook(tmp_path / "b.xlsx", {"notes": [], "cases": [["x"], ["Age", "Patient"], [40, "q1"]]})
    (tmp_path / "c.xlsx").write_bytes(b"no workbook")
    workbook(tmp_path / "d.xlsx", {"other": [["x"]]})
    cells = A.workbook_cells(spark, str(tmp_path), "cases")
    rows = A.with_header(cells, {"Patient": "patient", "Side": "side", "Age": "age"}, 2).collect()
    assert sorted((os.path.basename(r.path), r.row, r.patient, r.side, r.age) for r in rows) == [("a.xlsx", 3, "p1", "L", "51"), ("a.xlsx", 4, "p2", None, "60.5"), ("a.xlsx", 6, "p3", "R", None), ("b.xlsx", 3, "q1", None, "40")]
    bad = {os.path.basename(r.path): r.error for r in cells.where("error is not null").collect()}
    assert set(bad) == {"c.xlsx", "d.xlsx"} and "no sheet cases" in bad["d.xlsx"]
    assert A.workbook_cells(spark, str(tmp_path / "a.xlsx"), 0).first().cells == {"A": "nothing"}


def test_array_archives(spark, tmp_path):
    for k in (1, 2, 4):
        np.savez(tmp_path / f"run_fold{k}.npz", probs=np.array([0.25, 0.5]) * k, labels=np.array([0, 1]), image=np.array(["a", f"b{k}"]))
    np.savez(tmp_path / "run_fold3.npz", probs=np.array([0.5]), labels=np.array([0, 1]), image=np.array(["a", "b"]))
    (tmp_path / "run_fold5.npz").write_bytes(b"nothing")
    rows = A.array_rows(spark, str(tmp_path), {"probs": "double", "labels": "int", "image": "string"}).cache()
    found, missing = A.fold_arrays(rows, r"fold(\d+)", [1, 2, 3, 5, 6])
    assert sorted((r.fold, r.place, r.probs, r.labels, r.image) for r in found.collect()) == [(1, 0, 0.25, 0, "a"), (1, 1, 0.5, 1, "b1"), (2, 0, 0.5, 0, "a"), (2, 1, 1.0, 1, "b2")]
    assert sorted(r.fold for r in missing.collect()) == [3, 5, 6]
    assert len([r for r in rows.collect() if r.error]) == 2


def test_listing(spark, tmp_path):
    (tmp_path / "d.txt").mkdir()
    (tmp_path / "d.txt" / "a.TXT").write_text("x")
    (tmp_path / "empty.txt").write_text("")
    (tmp_path / "b.bin").write_text("xyz")
    os.symlink(tmp_path / "b.bin", tmp_path / "link.txt")
    rows = {os.path.basename(r.path): r for r in T.files_under(spark, str(tmp_path)).collect()}
    assert {k: r.length for k, r in rows.items()} == {"a.TXT": 1, "empty.txt": 0, "b.bin": 3}
    assert abs((rows["b.bin"].modified - datetime.fromtimestamp(os.path.getmtime(tmp_path / "b.bin"))).total_seconds()) % 3600 < 1
    assert sorted(os.path.basename(r.path) for r in T.files_under(spark, str(tmp_path), (".txt",)).collect()) == ["a.TXT", "empty.txt"]
    assert T.files_under(spark, str(tmp_path / "none")).count() == 0


def test_lesion_rows(spark):
    rows = [("a", 1, 2.0), ("a", 2, 5.0), ("a", 4, 1.0), ("a", 3, 0.0), ("b", 1, 0.0), ("c", 1, 1.0), ("c", 1, 2.0), ("d", 3, None), ("e", 1, -1.0), (None, 7, 2.0), (None, 8, 2.0)]
    df = spark.createDataFrame(rows, "c string, z int, n double").repartition(3)
    got = sorted((tuple(r) for r in cases.lesion_rows(df, "c", "z", "n").collect()), key=str)
    ok = [r for r in got if r[6] is None]
    assert sorted(ok, key=str) == sorted([("a", 1, 1, 2, 2, 7.0, None), ("a", 2, 4, 4, 4, 1.0, None), (None, 1, 7, 8, 7, 4.0, None)], key=str)
    assert [(r[0], r[1]) for r in got if r[6]] == [("c", None), ("d", None), ("e", None)]
    assert cases.lesion_rows(df.limit(0), "c", "z", "n").count() == 0


def test_predictions_missing_folds(spark, tmp_path):
    spark.createDataFrame([(0.5, 1)], "p double, y int").write.parquet(str(tmp_path / "run=a" / "fold=2"))
    rows, missing = T.predictions(spark, str(tmp_path), ["a", "b"], [1, 2], "p double, y int")
    assert [tuple(r) for r in rows.collect()] == [(0.5, 1, "a", 2)] and missing == [("a", 1), ("b", 1), ("b", 2)]
    none, all_ = T.predictions(spark, str(tmp_path), ["z"], [1], "p double, y int")
    assert none.count() == 0 and all_ == [("z", 1)]
