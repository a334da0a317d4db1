"""Workbooks in and out, and archives of files: each file is read or made by one task, a batch at a time."""

from __future__ import annotations

import datetime as dt
import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditloom.sources.delimited import headers

_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_DATES = {14, 15, 16, 17, 18, 19, 20, 21, 22, 45, 46, 47}


def _date_styles(book: zipfile.ZipFile) -> set[int]:
    """Numbers of the cell styles that show dates."""
    if "xl/styles.xml" not in book.namelist():
        return set()
    root = ElementTree.fromstring(book.read("xl/styles.xml"))
    own = {int(x.get("numFmtId")) for x in root.iter(f"{_MAIN}numFmt") if re.search("[dy]", x.get("formatCode", ""), re.I)}
    cells = root.find(f"{_MAIN}cellXfs")
    return {i for i, x in enumerate(cells if cells is not None else []) if int(x.get("numFmtId", 0)) in _DATES | own}


def _column(place: str) -> int:
    n = 0
    for c in re.match("[A-Z]*", place).group():
        n = n * 26 + ord(c) - 64
    return n - 1


def sheet_rows(content: bytes) -> Iterator[list[str]]:
    """The rows of a workbook's first sheet as texts: whole numbers without a point, dates as ISO, TRUE and FALSE; empty rows left out."""
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        shared: list[str] = []
        if "xl/sharedStrings.xml" in book.namelist():
            shared = ["".join(t.text or "" for t in x.iter(f"{_MAIN}t")) for x in ElementTree.fromstring(book.read("xl/sharedStrings.xml")).iter(f"{_MAIN}si")]
        dates = _date_styles(book)
        sheet = next(n for n in sorted(book.namelist()) if re.match("xl/worksheets/sheet[0-9]+.xml$", n))
        with book.open(sheet) as stream:
            for _, row in ElementTree.iterparse(stream):
                if row.tag != f"{_MAIN}row":
                    continue
                cells: list[str] = []
                for i, c in enumerate(row.iter(f"{_MAIN}c")):
                    at = _column(c.get("r", "")) if c.get("r") else i
                    cells += [""] * (at + 1 - len(cells))
                    cells[at] = _cell_text(c, shared, dates)
                row.clear()
                if any(cells):
                    yield cells


def _cell_text(c, shared: list[str], dates: set[int]) -> str:
    kind, v = c.get("t", "n"), c.find(f"{_MAIN}v")
    if kind == "inlineStr":
        return "".join(t.text or "" for t in c.iter(f"{_MAIN}t"))
    if v is None or v.text is None:
        return ""
    if kind == "s":
        return shared[int(v.text)]
    if kind == "b":
        return "TRUE" if v.text == "1" else "FALSE"
    if kind != "n":
        return v.text
    x = float(v.text)
    if int(c.get("s", 0)) in dates:
        moment = dt.datetime(1899, 12, 30) + dt.timedelta(days=x)
        return moment.date().isoformat() if x == int(x) else moment.isoformat(sep=" ", timespec="seconds")
    return str(int(x)) if x == int(x) else v.text


def read_excel(spark: SparkSession, path: str) -> DataFrame:
    """The first sheets of workbooks as a table of strings: the first row names the columns, short rows are filled with "".

    Every workbook is read by one task, row by row; all must have the columns of the first one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                lot: list[list[str]] = []
                n = 0
                for cells in sheet_rows(content):
                    lot.append(cells)
                    if len(lot) == 10_000:
                        yield _lot(name, n, lot)
                        n, lot = n + len(lot), []
                yield _lot(name, n, lot)

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    rows = files.mapInArrow(run, "file string, n bigint, cells array<string>")
    first = rows.filter("n = 0").orderBy("file").limit(1).collect()
    if not first:
        return spark.createDataFrame([], "_extra_columns string")
    names = headers(first[0]["cells"])
    cells = [F.coalesce(F.get("cells", F.lit(i)), F.lit("")).alias(x) for i, x in enumerate(names)]
    return rows.filter("n > 0").select(*cells, F.concat_ws(" | ", F.slice("cells", len(names) + 1, F.greatest(F.size("cells"), F.lit(1)))).alias("_extra_columns"))


def _lot(name: str, n: int, lot: list[list[str]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([name] * len(lot), pa.string()), pa.array(range(n, n + len(lot)), pa.int64()), pa.array(lot, pa.list_(pa.string()))], names=["file", "n", "cells"]
    )


def _sheet(names: list[str], rows: list[list], marked: int) -> str:
    """One sheet: the header in two colours (style 1 for the first marked columns, 2 for the others), frozen; widths by content."""
    size = lambda v: 0 if v is None else min(80, len(str(v)))
    widths = [min(52, max(12, 2 + max(size(r[i]) for r in [names, *rows[:400]]))) for i in range(len(names))]
    cols = "".join(f'<col min="{i + 1}" max="{i + 1}" width="{w}" customWidth="1"/>' for i, w in enumerate(widths))
    out = [f'<worksheet xmlns="{_MAIN[1:-1]}"><sheetViews><sheetView workbookViewId="0"><pane ySplit="1" topLeftCell="A2" activePane="bottomLeft" state="frozen"/></sheetView></sheetViews><cols>{cols}</cols><sheetData>']
    out.append("<row>" + "".join(_cell(n, 1 if i < marked else 2) for i, n in enumerate(names)) + "</row>")
    out += ["<row>" + "".join(_cell(v, 0) for v in r) + "</row>" for r in rows]
    return "".join(out) + "</sheetData></worksheet>"


def _cell(value, style: int) -> str:
    if value is None:
        return f'<c s="{style}"/>'
    if isinstance(value, bool):
        return f'<c s="{style}" t="b"><v>{int(value)}</v></c>'
    if isinstance(value, (int, float)):
        return f'<c s="{style}"><v>{value}</v></c>'
    text = re.sub("[\x00-\x08\x0b\x0c\x0e-\x1f]", "", str(value))
    text = "'" + text if text[:1] in ("=", "+", "-", "@", "\t", "\r") else text
    return f'<c s="{style}" t="inlineStr"><is><t xml:space="preserve">{escape(text[:32_000])}</t></is></c>'


def workbook(names: list[str], rows: list[list], marked: int, notes: list[tuple[str, str]]) -> bytes:
    """A workbook with the sheet Leads, and the sheet Columns that explains them."""
    fill = lambda c: f'<fill><patternFill patternType="solid"><fgColor rgb="FF{c}"/></patternFill></fill>'
    plain = '<fill><patternFill patternType="none"/></fill><fill><patternFill patternType="gray125"/></fill>'
    xfs = "".join(f'<xf fontId="0" fillId="{f}" borderId="0" applyFill="1"/>' for f in (0, 2, 3))
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    sheets = [("Leads", _sheet(names, rows, marked)), ("Columns", _sheet(["column", "meaning"], [list(n) for n in notes], 2))]
    kinds = "application/vnd.openxmlformats-officedocument.spreadsheetml"
    parts = {
        "[Content_Types].xml": '<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/>'
        f'<Override PartName="/xl/workbook.xml" ContentType="{kinds}.sheet.main+xml"/><Override PartName="/xl/styles.xml" ContentType="{kinds}.styles+xml"/>'
        + "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="{kinds}.worksheet+xml"/>' for i in (1, 2)) + "</Types>",
        "_rels/.rels": f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="{rel}/officeDocument" Target="xl/workbook.xml"/></Relationships>',
        "xl/workbook.xml": f'<workbook xmlns="{_MAIN[1:-1]}" xmlns:r="{rel}"><sheets>' + "".join(f'<sheet name="{n}" sheetId="{i}" r:id="r{i}"/>' for i, (n, _) in enumerate(sheets, 1)) + "</sheets></workbook>",
        "xl/_rels/workbook.xml.rels": '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">'
        + "".join(f'<Relationship Id="r{i}" Type="{rel}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in (1, 2)) + f'<Relationship Id="r3" Type="{rel}/styles" Target="styles.xml"/></Relationships>',
        "xl/styles.xml": f'<styleSheet xmlns="{_MAIN[1:-1]}"><fonts count="1"><font/></fonts><fills count="4">{plain}{fill("DDE6F0")}{fill("E3F1DE")}</fills><borders count="1"><border/></borders>'
        f'<cellStyleXfs count="1"><xf/></cellStyleXfs><cellXfs count="3">{xfs}</cellXfs></styleSheet>',
        **{f"xl/worksheets/sheet{i}.xml": x for i, (_, x) in enumerate(sheets, 1)},
    }
    return archive([(k, '<?xml version="1.0" encoding="UTF-8"?>' + v) for k, v in parts.items()])


def archive(files: list[tuple[str, str]]) -> bytes:
    """A ZIP archive of named texts; the same texts give the same bytes."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in files:
            z.writestr(zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0)), text, zipfile.ZIP_DEFLATED)
    return out.getvalue()


def workbooks(rows: DataFrame, marked: int, notes: list[tuple[str, str]], most: int = 100_000) -> DataFrame:
    """Rows (n, content): rows as workbooks of most rows each, made where the rows are. The first marked columns are the original ones."""
    names = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lot: list[list] = []
        for b in batches:
            lot += [list(r.values()) for r in b.to_pylist()]
            while len(lot) >= most:
                yield _made(len(lot[:most]), workbook(names, lot[:most], marked, notes))
                lot = lot[most:]
        if lot:
            yield _made(len(lot), workbook(names, lot, marked, notes))

    return rows.mapInArrow(run, "n int, content binary")


def archives(files: DataFrame, most: int = 1000) -> DataFrame:
    """Rows (n, content): files (name, text) in ZIP archives of most files each, made where the files are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lot: list[tuple[str, str]] = []
        for b in batches:
            lot += list(zip(b.column(0).to_pylist(), b.column(1).to_pylist()))
            while len(lot) >= most:
                yield _made(most, archive(lot[:most]))
                lot = lot[most:]
        if lot:
            yield _made(len(lot), archive(lot))

    return files.select("name", "text").mapInArrow(run, "n int, content binary")


def _made(n: int, content: bytes) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([n], pa.int32()), pa.array([content], pa.binary())], names=["n", "content"])


def save(files: DataFrame, folder: str, ending: str) -> int:
    """Writes the contents of workbooks() or archives() as files of a folder, one at a time, by the folder's own file system."""
    spark = files.sparkSession
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    k = 0
    for k, row in enumerate(files.select("content").toLocalIterator(), 1):
        place = jvm.org.apache.hadoop.fs.Path(f"{folder}/part-{k:05d}{ending}")
        stream = place.getFileSystem(conf).create(place, True)
        try:
            stream.write(row["content"])
        finally:
            stream.close()
    return k


def history(spark: SparkSession, folder: str, limit: int = 50) -> DataFrame:
    """name, bytes and time of the files below a folder, the newest first, 1 to 200 of them."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    rows = files.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("bytes"), F.col("modificationTime").alias("time"))
    return rows.orderBy(F.col("time").desc(), "name").limit(min(max(limit, 1), 200))
