"""XLSX workbooks: first sheet, every cell as text.

The container format has no Spark reader, so bytes are decoded in a small
per-file helper; Spark lists, reads and spreads the files.
"""

from __future__ import annotations

import io
import re
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.naming import file_kind
from .files import file_name

SHEET_SCHEMA = "file string, sheet string, row_idx long, cells array<string>, error string"
# Rows handed to Arrow at a time, so a large sheet is not held as one frame.
ROWS_OUT = 2000

_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


def _text_of(node) -> str:
    return "".join(t.text or "" for t in node.iter(f"{_MAIN}t"))


def _column(ref: str) -> int:
    n = 0
    for ch in re.match(r"[A-Z]*", ref).group():
        n = n * 26 + ord(ch) - 64
    return n - 1


def _value(cell, shared: list[str]) -> str:
    kind = cell.get("t", "n")
    if kind == "inlineStr":
        return _text_of(cell)
    raw = cell.findtext(f"{_MAIN}v") or ""
    if kind == "s" and raw:
        return shared[int(raw)]
    if kind == "b":
        return {"1": "true", "0": "false"}.get(raw, raw)
    if kind == "n" and raw:
        number = float(raw)
        return str(int(number)) if number.is_integer() and abs(number) < 1e15 else repr(number)
    return raw


def sheet_rows(content: bytes) -> Iterator[tuple[str, int, list[str]]]:
    """(sheet name, row number, cells) of the first sheet; rows padded to its used width."""
    book = zipfile.ZipFile(io.BytesIO(content))
    names = set(book.namelist())
    sheets = ET.fromstring(book.read("xl/workbook.xml")).findall(f"{_MAIN}sheets/{_MAIN}sheet")
    if not sheets:
        raise ValueError("No sheets found in workbook")
    links = {r.get("Id"): r.get("Target") for r in ET.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
    target = links[sheets[0].get(_REL)].lstrip("/")
    target = target if target.startswith("xl/") else f"xl/{target}"
    shared: list[str] = []
    if "xl/sharedStrings.xml" in names:
        shared = [_text_of(si) for si in ET.fromstring(book.read("xl/sharedStrings.xml")).findall(f"{_MAIN}si")]
    rows: list[tuple[int, dict[int, str]]] = []
    with book.open(target) as stream:
        for _, node in ET.iterparse(stream):
            if node.tag == f"{_MAIN}row":
                at = int(node.get("r") or len(rows) + 1)
                cells: dict[int, str] = {}
                for i, cell in enumerate(node.findall(f"{_MAIN}c")):
                    cells[_column(cell.get("r")) if cell.get("r") else i] = _value(cell, shared)
                rows.append((at, cells))
                node.clear()
    used = [(at, cells) for at, cells in rows if cells]
    if not used:
        return
    left = min(min(c) for _, c in used)
    right = max(max(c) for _, c in used)
    by_row = dict(used)
    for at in range(used[0][0], used[-1][0] + 1):
        cells = by_row.get(at, {})
        yield sheets[0].get("name"), at - used[0][0], [cells.get(i, "") for i in range(left, right + 1)]


def _decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    columns = ["file", "sheet", "row_idx", "cells", "error"]
    for files in batches:
        for path, content in zip(files["file"], files["content"], strict=True):
            out: list[tuple] = []
            try:
                for sheet, at, cells in sheet_rows(content):
                    out.append((path, sheet, at, cells, None))
                    if len(out) == ROWS_OUT:
                        yield pd.DataFrame(out, columns=columns)
                        out = []
            except Exception as exc:  # one broken workbook does not stop the batch
                out.append((path, None, None, None, f"Failed to parse file: {exc}"))
            if out:
                yield pd.DataFrame(out, columns=columns)


def parse_workbooks(files: DataFrame) -> DataFrame:
    """Rows of workbooks given as ``(file, content)``; row 0 is the header.

    A workbook that cannot be read gives one row with ``error`` set.
    """
    return files.select("file", "content").mapInPandas(_decode, SHEET_SCHEMA)


def read_workbooks(spark: SparkSession, paths) -> DataFrame:
    """Rows of every workbook under files, folders (at any depth) and globs."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(paths)
    binary = found.where(file_kind("path") == "xlsx")
    return parse_workbooks(binary.select(file_name(F.col("path")).alias("file"), "content"))
