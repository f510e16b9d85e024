"""Spreadsheets (xlsx, xlsm) as a Python data source: ``spark.read.format("papyra_xlsx")``, one partition a sheet.

Options: ``path``; ``header`` (default true: the first row gives the names); ``sheet`` to read one sheet only, otherwise all
sheets are read into one frame with a ``_sheet`` and a ``_row`` column and columns by position. Only the standard library is
used: shared and inline strings, numbers, booleans, dates by cell style, gaps. Older and binary formats raise a clear error.
"""

from __future__ import annotations

import datetime as dt
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree as ET

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

_M = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
# Built-in number formats of dates, and signs of a date in a format of one's own.
_DATE_FORMATS = {*range(14, 23), *range(45, 48)}
_DATE_SIGNS = re.compile(r"(?i)[ymdhs]")


def check_format(path: str) -> None:
    end = path.rsplit(".", 1)[-1].lower()
    if end in ("xls", "xlsb"):
        raise ValueError(f"{path}: the binary formats xls and xlsb cannot be read; save it as xlsx")
    if end not in ("xlsx", "xlsm"):
        raise ValueError(f"{path}: not a spreadsheet")


class Workbook:
    def __init__(self, path: str):
        check_format(path)
        self.zip = zipfile.ZipFile(path)
        book = ET.fromstring(self.zip.read("xl/workbook.xml"))
        rels = {r.get("Id"): r.get("Target") for r in ET.fromstring(self.zip.read("xl/_rels/workbook.xml.rels"))}
        self.sheets = {s.get("name"): self._place(rels[s.get(f"{_R}id")]) for s in book.iter(f"{_M}sheet")}
        first_1904 = book.find(f"{_M}workbookPr")
        self.epoch = dt.datetime(1904, 1, 1) if first_1904 is not None and first_1904.get("date1904") in ("1", "true") else dt.datetime(1899, 12, 30)
        names = self.zip.namelist()
        self.strings: list[str] = []
        if "xl/sharedStrings.xml" in names:
            for item in ET.fromstring(self.zip.read("xl/sharedStrings.xml")).iter(f"{_M}si"):
                self.strings.append("".join(t.text or "" for t in item.iter(f"{_M}t")))
        self.dates: set[int] = set()
        if "xl/styles.xml" in names:
            styles = ET.fromstring(self.zip.read("xl/styles.xml"))
            own = {int(f.get("numFmtId")): f.get("formatCode") or "" for f in styles.iter(f"{_M}numFmt")}
            cells = styles.find(f"{_M}cellXfs")
            for i, xf in enumerate(cells if cells is not None else []):
                n = int(xf.get("numFmtId") or 0)
                if n in _DATE_FORMATS or n in own and _DATE_SIGNS.search(re.sub(r'"[^"]*"|\[[^\]]*\]', "", own[n])):
                    self.dates.add(i)

    @staticmethod
    def _place(target: str) -> str:
        return target.lstrip("/") if target.startswith("/") else f"xl/{target}"

    def rows(self, sheet: str) -> Iterator[tuple[int, list[str | None]]]:
        """(row number from 1, values as text) of the rows that have cells, read as a stream."""
        with self.zip.open(self.sheets[sheet]) as f:
            for _, node in ET.iterparse(f):
                if node.tag != f"{_M}row":
                    continue
                out: list[str | None] = []
                for c in node.iter(f"{_M}c"):
                    at = self._column(c.get("r")) if c.get("r") else len(out)
                    out += [None] * (at - len(out))
                    out.append(self._value(c))
                yield int(node.get("r") or 0), out
                node.clear()

    @staticmethod
    def _column(ref: str) -> int:
        n = 0
        for ch in ref:
            if not ch.isalpha():
                break
            n = n * 26 + ord(ch.upper()) - 64
        return n - 1

    def _value(self, c: ET.Element) -> str | None:
        kind, v = c.get("t"), c.find(f"{_M}v")
        if kind == "inlineStr":
            return "".join(t.text or "" for t in c.iter(f"{_M}t"))
        if v is None or v.text is None:
            return None
        if kind == "s":
            return self.strings[int(v.text)]
        if kind == "b":
            return "true" if v.text == "1" else "false"
        if kind in ("str", "e"):
            return v.text
        if int(c.get("s") or 0) in self.dates:
            when = self.epoch + dt.timedelta(seconds=round(float(v.text) * 86400))
            return when.isoformat() if when.time() != dt.time() else when.date().isoformat()
        x = float(v.text)
        return str(int(x)) if x.is_integer() and abs(x) < 1e15 else repr(x)

    def width(self, sheet: str) -> int:
        return max((len(r) for _, r in self.rows(sheet)), default=0)


def sheet_names(path: str) -> list[str]:
    return list(Workbook(path).sheets)


class SheetPartition(InputPartition):
    def __init__(self, sheet: str):
        super().__init__(sheet)
        self.sheet = sheet


class XlsxReader(DataSourceReader):
    def __init__(self, options: dict[str, str], width: int):
        self.path, self.header, self.width = options["path"], options.get("header", "true").lower() == "true", width
        self.only = options.get("sheet")

    def partitions(self) -> list[InputPartition]:
        return [SheetPartition(s) for s in ([self.only] if self.only else sheet_names(self.path))]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        for i, (number, values) in enumerate(Workbook(self.path).rows(partition.sheet)):
            if i == 0 and self.header:
                continue
            yield (partition.sheet, number, *(values + [None] * (self.width - len(values)))[: self.width])


class XlsxDataSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "papyra_xlsx"

    def _names(self) -> list[str]:
        book, only = Workbook(self.options["path"]), self.options.get("sheet")
        if only and only not in book.sheets:
            raise ValueError(f"no sheet named {only}")
        sheets = [only] if only else list(book.sheets)
        width = max((book.width(s) for s in sheets), default=0)
        if not only or self.options.get("header", "true").lower() != "true":
            return [str(i) for i in range(width)]
        first = next((r for _, r in book.rows(only)), [])
        names, seen = [], set()
        for i in range(width):
            name = (first[i] if i < len(first) else None) or f"Unnamed: {i}"
            while name.lower() in seen:
                name += f".{i}"
            seen.add(name.lower())
            names.append(name)
        return names

    def schema(self) -> StructType:
        return StructType([StructField("_sheet", StringType()), StructField("_row", IntegerType()), *(StructField(n, StringType()) for n in self._names())])

    def reader(self, schema: StructType) -> DataSourceReader:
        return XlsxReader(dict(self.options), len(schema) - 2)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(XlsxDataSource)
