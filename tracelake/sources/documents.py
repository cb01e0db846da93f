"""Office and text documents as blocks and grids, read from binary files with the standard library only."""

from __future__ import annotations

import csv
import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree as ET

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BLOCKS = "path string, block_no int, kind string, heading string, sheet_name string, row_number int, text string, error string"
SUPPORTED = ("txt", "md", "csv", "docx", "xlsx")
UNCACHED = "[公式未计算]"
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
# The forms of numbered headings (1. x, 1.2 x, 1.2.3, 第一章 and the like).
NUMBERED_HEADINGS = (r"^\d+\.\s+\S", r"^\d+\.\d+\s+\S", r"^\d+\.\d+\.\d+", r"^第[一二三四五六七八九十\d]+[章节篇]")
_NUMBERED = re.compile("|".join(NUMBERED_HEADINGS))


def decoded(data: bytes) -> str:
    """UTF-8 with or without a mark, else GB18030 with replacement."""
    try:
        return data.decode("utf-8-sig")
    except UnicodeDecodeError:
        return data.decode("gb18030", "replace")


def is_numbered_heading(text: str) -> bool:
    return bool(_NUMBERED.match(text))


def docx_blocks(data: bytes) -> Iterator[tuple[str, str, str]]:
    """(kind, heading above, text) of paragraphs and tables in order; tables become Markdown."""
    body = ET.fromstring(zipfile.ZipFile(io.BytesIO(data)).read("word/document.xml")).find(f"{_W}body")
    heading = ""
    for node in body if body is not None else []:
        if node.tag == f"{_W}p":
            text = "".join(t.text or "" for t in node.iter(f"{_W}t")).strip()
            style = node.find(f"{_W}pPr/{_W}pStyle")
            if not text:
                continue
            if (style is not None and style.get(f"{_W}val", "").lower().startswith("heading")) or is_numbered_heading(text):
                heading = text
            yield "paragraph", heading, text
        elif node.tag == f"{_W}tbl":
            rows = [["".join(t.text or "" for t in c.iter(f"{_W}t")).strip() for c in r.iter(f"{_W}tc")] for r in node.iter(f"{_W}tr")]
            if table := table_markdown(rows):
                yield "table", heading, table


def table_markdown(rows: list[list[str]]) -> str:
    """Rows as Markdown under the first of them, as wide as that; shorter rows are filled up, empty rows are left out."""
    filled = [[c.replace("\n", " ") for c in r] for r in rows if any(r)]
    if not filled:
        return ""
    width = len(filled[0])
    line = lambda r: "| " + " | ".join([*r, *[""] * width][:width]) + " |"
    return "\n".join([line(filled[0]), line(["---"] * width), *map(line, filled[1:])])


def column_index(ref: str) -> int:
    n = 0
    for c in re.match(r"[A-Z]+", ref)[0]:
        n = n * 26 + ord(c) - 64
    return n


def xlsx_cells(data: bytes) -> Iterator[tuple[str, int, int, str | None, bool]]:
    """(sheet, row, column, value, formula without a cached value); merged ranges are filled from their first cell."""
    z = zipfile.ZipFile(io.BytesIO(data))
    names = z.namelist()
    shared = ["".join(t.text or "" for t in si.iter(f"{_S}t")) for si in ET.fromstring(z.read("xl/sharedStrings.xml"))] if "xl/sharedStrings.xml" in names else []
    titles = [s.get("name") for s in ET.fromstring(z.read("xl/workbook.xml")).iter(f"{_S}sheet")]
    for title, name in zip(titles, sorted((n for n in names if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), key=lambda n: int(re.search(r"\d+", n)[0]))):
        root = ET.fromstring(z.read(name))
        grid: dict[tuple[int, int], tuple[str | None, bool]] = {}
        for c in root.iter(f"{_S}c"):
            ref = c.get("r")
            v, formula = c.find(f"{_S}v"), c.find(f"{_S}f") is not None
            value = v.text if v is not None else "".join(t.text or "" for t in c.iter(f"{_S}t")) or None
            if c.get("t") == "s" and value is not None:
                value = shared[int(value)]
            grid[int(re.search(r"\d+", ref)[0]), column_index(ref)] = (UNCACHED, True) if formula and value is None else (value, False)
        for m in root.iter(f"{_S}mergeCell"):
            a, b = m.get("ref").split(":")
            (r0, c0), (r1, c1) = [(int(re.search(r"\d+", x)[0]), column_index(x)) for x in (a, b)]
            for r in range(r0, r1 + 1):
                for k in range(c0, c1 + 1):
                    grid.setdefault((r, k), grid.get((r0, c0), (None, False)))
        for (r, k), (value, open_formula) in sorted(grid.items()):
            yield title, r, k, value, open_formula


def sheet_rows(rows: list[tuple[str, int, dict[int, str]]]) -> Iterator[tuple[str, int, str]]:
    """Rows below the first of each sheet as ``header：value；...``."""
    heads: dict[str, dict[int, str]] = {}
    for sheet, n, values in rows:
        if sheet not in heads:
            heads[sheet] = values
            continue
        text = "；".join(f"{heads[sheet].get(k) or k}：{v}" for k, v in sorted(values.items()) if v)
        if text:
            yield sheet, n, text


def parse(path: str, data: bytes) -> Iterator[tuple]:
    """The blocks of one file; what can't be parsed is one row with an error."""
    ext = path.rsplit(".", 1)[-1].lower()
    try:
        if ext in ("txt", "md"):
            for i, p in enumerate(x for x in re.split(r"\n\s*\n", decoded(data).replace("\r\n", "\n")) if x.strip()):
                yield path, i, "paragraph", "", None, None, p.strip(), None
        elif ext == "docx":
            for i, (kind, heading, text) in enumerate(docx_blocks(data)):
                yield path, i, kind, heading, None, None, text, None
        elif ext in ("csv", "xlsx"):
            if ext == "csv":
                rows = [("CSV", n, {k: v.strip() for k, v in enumerate(r, 1)}) for n, r in enumerate(csv.reader(io.StringIO(decoded(data))), 1)]
            else:
                by: dict[tuple[str, int], dict[int, str]] = {}
                for sheet, r, c, v, _ in xlsx_cells(data):
                    by.setdefault((sheet, r), {})[c] = (v or "").strip()
                rows = [(s, r, v) for (s, r), v in by.items()]
            for i, (sheet, n, text) in enumerate(sheet_rows(rows)):
                yield path, i, "row", "", sheet, n, text, None
        else:
            yield path, 0, "error", None, None, None, None, f"unsupported: {ext}"
    except Exception as e:
        yield path, 0, "error", None, None, None, None, str(e)[:200] or type(e).__name__


def read_documents(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """Blocks of all files below a folder, one file per record; supported are txt, md, csv, docx and xlsx."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cols = [c.split()[0] for c in BLOCKS.split(", ")]
        for part in parts:
            for path, data in zip(part["path"], part["content"]):
                out = pd.DataFrame(list(parse(path, bytes(data))), columns=cols)
                out["row_number"] = out["row_number"].astype("Int32")
                yield out

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(folder)
    return files.select("path", "content").mapInPandas(run, BLOCKS)


CELLS = "path string, sheet string, row int, col int, value string, uncached boolean, error string"


def read_cells(spark: SparkSession, folder: str, pattern: str = "*.xlsx") -> DataFrame:
    """The cells of all workbooks below a folder as one long grid: merged ranges filled from their first cell, formulas without a
    cached value marked. A workbook that can't be read is one row with an error."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cols = [c.split()[0] for c in CELLS.split(", ")]
        for part in parts:
            for path, data in zip(part["path"], part["content"]):
                try:
                    rows = [(path, sheet, r, c, v, u, None) for sheet, r, c, v, u in xlsx_cells(bytes(data))]
                except Exception as e:
                    rows = [(path, None, None, None, None, None, str(e)[:200] or type(e).__name__)]
                yield pd.DataFrame(rows, columns=cols).astype({"row": "Int32", "col": "Int32"})

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(folder)
    return files.select("path", "content").mapInPandas(run, CELLS)


def file_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    """sha256 of a file's first and last 4 KiB and its size, shortened, with the size."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    c = F.col("content")
    tail = F.when(F.col("length") > 8192, F.substring(c, -4096, 4096)).otherwise(F.lit(b""))
    digest = F.sha2(F.concat(F.substring(c, 1, 4096), tail, F.encode(F.col("length").cast("string"), "UTF-8")), 256)
    return files.select("path", "length", F.concat(F.left(digest, F.lit(16)), F.lit("_"), F.col("length").cast("string")).alias("fingerprint"))
