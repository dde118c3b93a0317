"""Sheets of workbooks and archives of parallel arrays, read where they lie: one scan, a file a row of bytes."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator, Mapping
from xml.etree import ElementTree

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SHEET = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
RELATED = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


def _bytes(spark: SparkSession, path: str, glob: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(path).select("path", "content")


def _text(node: ElementTree.Element | None) -> str:
    return "".join(t.text or "" for t in node.iter(f"{SHEET}t")) if node is not None else ""


def _sheet_file(book: zipfile.ZipFile, sheet: str | int) -> str:
    """The part that holds a sheet, by name or by place from 0."""
    names = ElementTree.fromstring(book.read("xl/workbook.xml")).find(f"{SHEET}sheets")
    held = list(names) if names is not None else []
    found = [s for k, s in enumerate(held) if sheet in (k, s.get("name"))]
    if not found:
        raise ValueError(f"no sheet {sheet}")
    targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
    target = targets[found[0].get(RELATED)]
    return target.lstrip("/") if target.startswith("/") else f"xl/{target}"


def _rows(content: bytes, sheet: str | int) -> Iterator[tuple[int, dict[str, str]]]:
    """number (from 1) and cells by column letter of a sheet's rows; empty cells are absent."""
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        shared = [_text(x) for x in ElementTree.fromstring(book.read("xl/sharedStrings.xml"))] if "xl/sharedStrings.xml" in book.namelist() else []
        with book.open(_sheet_file(book, sheet)) as part:
            for _, node in ElementTree.iterparse(part):
                if node.tag != f"{SHEET}row":
                    continue
                cells = {}
                for c in node.iter(f"{SHEET}c"):
                    kind, v = c.get("t"), c.find(f"{SHEET}v")
                    value = _text(c.find(f"{SHEET}is")) if kind == "inlineStr" else shared[int(v.text)] if kind == "s" and v is not None else v.text if v is not None else None
                    if value:
                        cells[re.match("[A-Z]+", c.get("r"))[0]] = value
                yield int(node.get("r")), cells
                node.clear()


def workbook_cells(spark: SparkSession, path: str, sheet: str | int = 0, glob: str = "*.xlsx") -> DataFrame:
    """path, row (from 1), cells (map of column letter to text) and error of the rows of a sheet of each workbook under path.

    A workbook that cannot be read, or has no such sheet, is one row with its error, and stops nothing.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.map_(pa.string(), pa.string())
        for batch in batches:
            for name, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                rows, error = [], None
                try:
                    for row in _rows(content.as_py(), sheet):
                        rows.append(row)
                        if len(rows) == 10_000:
                            yield pa.RecordBatch.from_arrays([pa.array([name] * len(rows)), pa.array([r for r, _ in rows], pa.int32()), pa.array([list(c.items()) for _, c in rows], kind), pa.nulls(len(rows), pa.string())], ["path", "row", "cells", "error"])
                            rows = []
                except (zipfile.BadZipFile, ElementTree.ParseError, KeyError, ValueError, IndexError) as e:
                    error = f"{type(e).__name__}: {e}"
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(rows)), pa.array([r for r, _ in rows], pa.int32()), pa.array([list(c.items()) for _, c in rows], kind), pa.nulls(len(rows), pa.string())], ["path", "row", "cells", "error"])
                if error:
                    yield pa.RecordBatch.from_arrays([pa.array([name]), pa.nulls(1, pa.int32()), pa.nulls(1, kind), pa.array([error])], ["path", "row", "cells", "error"])

    return _bytes(spark, path, glob).mapInArrow(run, "path string, row int, cells map<string,string>, error string")


def with_header(cells: DataFrame, columns: Mapping[str, str], header: int = 1) -> DataFrame:
    """path, row and, for each title of columns, the text below it as the name that columns gives; rows after row header.

    Titles are trimmed and looked for in row header of each workbook; a title that it lacks gives nulls.
    """
    titles = cells.where(F.col("row") == header).select(F.col("path").alias("_p"), F.map_from_entries(F.transform(F.array_sort(F.map_entries("cells")), lambda e: F.struct(F.concat(F.trim(e["value"]), F.lit("\x00"), e["key"]), e["key"]))).alias("_t"))
    letter = lambda title: F.get(F.map_values(F.map_filter("_t", lambda k, _: k.startswith(f"{title}\x00"))), 0)
    places = titles.select("_p", *[letter(t).alias(f"_c{k}") for k, t in enumerate(columns)])
    held = cells.where((F.col("row") > header) & (F.size("cells") > 0)).join(places, F.col("path") == F.col("_p"))
    return held.select("path", "row", *[F.try_element_at("cells", F.col(f"_c{k}")).alias(name) for k, name in enumerate(columns.values())])


def array_rows(spark: SparkSession, path: str, arrays: Mapping[str, str], glob: str = "*.npz") -> DataFrame:
    """path, place (from 0), error and a column of the given Spark type for each of arrays, of the archives of parallel arrays under path.

    An archive that cannot be read, lacks an array, or has arrays of different lengths is one row with its error.
    """
    types = {"string": pa.string(), "double": pa.float64(), "int": pa.int32(), "long": pa.int64(), "bigint": pa.int64()}
    names = ["path", "place", "error", *arrays]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                try:
                    with np.load(io.BytesIO(content.as_py()), allow_pickle=False) as held:
                        found = {a: held[a] for a in arrays}
                    if len({len(v) for v in found.values()}) > 1:
                        raise ValueError("arrays of different lengths")
                    n = len(next(iter(found.values())))
                    values = [pa.array([str(x) for x in v]) if arrays[a] == "string" else pa.array(v).cast(types[arrays[a]]) for a, v in found.items()]
                    yield pa.RecordBatch.from_arrays([pa.array([name] * n, pa.string()), pa.array(np.arange(n)), pa.nulls(n, pa.string()), *values], names)
                except (zipfile.BadZipFile, KeyError, ValueError, OSError, EOFError) as e:
                    yield pa.RecordBatch.from_arrays([pa.array([name]), pa.nulls(1, pa.int64()), pa.array([f"{type(e).__name__}: {e}"]), *[pa.nulls(1, types[t]) for t in arrays.values()]], names)

    return _bytes(spark, path, glob).mapInArrow(run, "path string, place long, error string, " + ", ".join(f"`{a}` {t}" for a, t in arrays.items()))


def fold_arrays(rows: DataFrame, pattern: str, folds: list[int]) -> tuple[DataFrame, DataFrame]:
    """(rows with fold, missing): fold is group 1 of pattern in the path; missing has the folds that no archive gives."""
    told = rows.withColumn("fold", F.regexp_extract("path", pattern, 1).cast("int"))
    asked = rows.sparkSession.createDataFrame([(k,) for k in folds], "fold int")
    return told.where(F.col("fold").isin(folds) & F.col("error").isNull()), asked.join(told.where("error is null").select("fold").distinct(), "fold", "left_anti")
