"""Cells of spreadsheet workbooks: the XML of their sheets and shared strings, read in the tasks from each file's zip."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
LINK = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
CELLS = "path string, sheet string, row int, col int, value string"


def column_of(place: str) -> int:
    """``AB12`` is column 28."""
    n = 0
    for c in place:
        if not c.isalpha():
            break
        n = 26 * n + ord(c.upper()) - ord("A") + 1
    return n


def text_of(node: ElementTree.Element) -> str:
    """Runs of a rich text together, without its phonetic notes."""
    notes = {id(t) for r in node.iter(f"{MAIN}rPh") for t in r.iter(f"{MAIN}t")}
    return "".join(t.text or "" for t in node.iter(f"{MAIN}t") if id(t) not in notes)


def number(text: str) -> str:
    """Numbers as written, whole ones without a fraction."""
    return text[:-2] if text.endswith(".0") else text


def sheets(book: zipfile.ZipFile) -> Iterator[tuple[str, str]]:
    """Name and file of each sheet, in order."""
    files = {r.get("Id"): r.get("Target", "") for r in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
    for sheet in ElementTree.fromstring(book.read("xl/workbook.xml")).iter(f"{MAIN}sheet"):
        target = files.get(sheet.get(LINK), "")
        yield sheet.get("name", ""), target.lstrip("/") if target.startswith("/") else f"xl/{target}"


def cells(content: bytes) -> Iterator[tuple[str, int, int, str]]:
    """``sheet, row, col, value`` of all cells with a value; rows of a sheet are parsed one after the other."""
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        names = set(book.namelist())
        shared = [text_of(s) for s in ElementTree.fromstring(book.read("xl/sharedStrings.xml")).iter(f"{MAIN}si")] if "xl/sharedStrings.xml" in names else []
        for sheet, file in sheets(book):
            if file not in names:
                continue
            with book.open(file) as part:
                row = 0
                for _, node in ElementTree.iterparse(part):
                    if node.tag != f"{MAIN}row":
                        continue
                    row, col = int(node.get("r", row + 1)), 0
                    for cell in node.iter(f"{MAIN}c"):
                        col = column_of(cell.get("r", "")) or col + 1
                        kind, raw = cell.get("t", "n"), cell.findtext(f"{MAIN}v")
                        value = text_of(cell) if kind == "inlineStr" else None if raw is None else shared[int(raw)] if kind == "s" else raw if kind == "str" else {"1": "TRUE", "0": "FALSE"}.get(raw, raw) if kind == "b" else number(raw)
                        if value is not None:
                            yield sheet, row, col, value
                    node.clear()


def read_workbooks(spark: SparkSession, path: str) -> DataFrame:
    """``path, sheet, row, col, value`` of the workbooks in a folder or file, a task for some files each.

    A file is whole in a task, as its directory stands at its end; its sheets are not. A file that is no workbook fails.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["path", "sheet", "row", "col", "value"]
        kinds = (pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string())
        for batch in batches:
            for file, content in zip(batch.column(0), batch.column(1), strict=True):
                held: list[tuple] = []
                for cell in cells(content.as_py()):
                    held.append((file.as_py(), *cell))
                    if len(held) == 50_000:
                        yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*held, strict=True), kinds, strict=True)], names=names)
                        held = []
                if held:
                    yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*held, strict=True), kinds, strict=True)], names=names)

    return spark.read.format("binaryFile").option("pathGlobFilter", "*.xlsx").load(path).select("path", "content").mapInArrow(run, CELLS)


def flat_workbook(books: DataFrame, drop: tuple[str, ...] = ("", "nan", "brand_name")) -> DataFrame:
    """``value`` of all cells, as :func:`sources.flat_cells` gives them for a sheet."""
    return books.select(F.trim("value").alias("value")).where(~F.lower("value").isin(*drop))
