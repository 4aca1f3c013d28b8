"""An XLSX reader for the Python Data Source API: spark.read.format("xlsx").load(paths).

Options: sheet (name or 0-based number, default 0), header (true). One partition per file; rows are streamed from the
sheet's XML. Columns are texts named by the header row, preceded by row_idx (0 for the first row below the header).
"""

from __future__ import annotations

import glob
import os
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import LongType, StringType, StructField, StructType

_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"


def _column(ref: str) -> int:
    n = 0
    for ch in re.match(r"[A-Z]+", ref).group():
        n = n * 26 + ord(ch) - 64
    return n - 1


def _sheet_path(z: zipfile.ZipFile, sheet: str) -> str:
    book = ElementTree.fromstring(z.read("xl/workbook.xml"))
    sheets = list(book.iter(f"{_MAIN}sheet"))
    chosen = sheets[int(sheet)] if sheet.isdigit() else next(s for s in sheets if s.get("name") == sheet)
    rels = ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))
    target = next(r.get("Target") for r in rels if r.get("Id") == chosen.get(f"{_REL}id"))
    return target.lstrip("/") if target.startswith("/") else f"xl/{target}"


def _shared(z: zipfile.ZipFile) -> list[str]:
    if "xl/sharedStrings.xml" not in z.namelist():
        return []
    root = ElementTree.fromstring(z.read("xl/sharedStrings.xml"))
    return ["".join(t.text or "" for t in si.iter(f"{_MAIN}t")) for si in root.iter(f"{_MAIN}si")]


def read_rows(path: str, sheet: str = "0") -> Iterator[list[str | None]]:
    """The rows of a sheet as texts, blank cells and errors as null; whole numbers without a decimal part."""
    with zipfile.ZipFile(path) as z:
        shared = _shared(z)
        with z.open(_sheet_path(z, sheet)) as f:
            for _, row in ElementTree.iterparse(f):
                if row.tag != f"{_MAIN}row":
                    continue
                cells: list[str | None] = []
                for c in row.iter(f"{_MAIN}c"):
                    at = _column(c.get("r")) if c.get("r") else len(cells)
                    cells += [None] * (at + 1 - len(cells))
                    v, kind = c.find(f"{_MAIN}v"), c.get("t")
                    if kind == "inlineStr":
                        text = "".join(t.text or "" for t in c.iter(f"{_MAIN}t"))
                    elif v is None or v.text is None or kind == "e":
                        text = None
                    elif kind == "s":
                        text = shared[int(v.text)]
                    elif kind in ("str", "b", "d"):
                        text = v.text
                    else:
                        text = v.text[:-2] if v.text.endswith(".0") else v.text
                    cells[at] = text
                row.clear()
                yield cells


class _File(InputPartition):
    def __init__(self, path: str):
        self.path = path


class _Reader(DataSourceReader):
    def __init__(self, options: dict, schema: StructType):
        self.options, self.schema = options, schema

    def partitions(self) -> list[InputPartition]:
        return [_File(p) for p in _paths(self.options)]

    def read(self, partition: _File) -> Iterator[tuple]:
        width = len(self.schema.fields) - 1
        rows = read_rows(partition.path, self.options.get("sheet", "0"))
        if self.options.get("header", "true") == "true":
            next(rows, None)
        for i, cells in enumerate(rows):
            yield (i, *(cells[:width] + [None] * (width - len(cells))))


def _paths(options: dict) -> list[str]:
    path = options["path"].removeprefix("file://").removeprefix("file:")
    out = sorted(glob.glob(os.path.join(path, "*.xlsx"))) if os.path.isdir(path) else sorted(glob.glob(path))
    if not out:
        raise FileNotFoundError(path)
    return out


class XlsxSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "xlsx"

    def schema(self) -> StructType:
        first = next(read_rows(_paths(self.options)[0], self.options.get("sheet", "0")), [])
        named = self.options.get("header", "true") == "true"
        names = [c if named and c else f"Unnamed: {i}" for i, c in enumerate(first)]
        return StructType([StructField("row_idx", LongType()), *(StructField(n, StringType()) for n in names)])

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self.options, schema)


def register(spark) -> None:
    spark.dataSource.register(XlsxSource)
