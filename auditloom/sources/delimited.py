"""Delimited files in and out: dialect by a bounded look at the start, rows by Spark."""

from __future__ import annotations

import csv
import io

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditloom.functions.text import formula_guard


def _start(spark: SparkSession, path: str, size: int = 200_000) -> bytes:
    """The first bytes of a file, read by Spark's own file systems."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    place = jvm.org.apache.hadoop.fs.Path(path)
    stream = place.getFileSystem(conf).open(place)
    try:
        return bytes(stream.readNBytes(size))
    finally:
        stream.close()


def dialect(start: bytes) -> tuple[str, str]:
    """Encoding and delimiter: UTF-8, UTF-16 by its mark, Windows-1252 where its own letters stand, else Latin-1; comma, semicolon, tab or bar, comma if nothing tells."""
    if start[:2] in (b"\xff\xfe", b"\xfe\xff"):
        encoding = "UTF-16"
    else:
        try:
            # the last character may be cut
            start[: -4 if len(start) >= 200_000 else None].decode("utf-8-sig")
            encoding = "UTF-8"
        except UnicodeDecodeError:
            # the bytes that are control characters in Latin-1 are quotes, dashes and the euro sign there
            encoding = "windows-1252" if any(0x80 <= b <= 0x9F for b in start) else "ISO-8859-1"
    try:
        return encoding, csv.Sniffer().sniff(start.decode(_python(encoding), "replace")[:8192], ",;\t|").delimiter
    except csv.Error:
        return encoding, ","


def _python(encoding: str) -> str:
    return {"UTF-8": "utf-8-sig", "UTF-16": "utf-16", "windows-1252": "cp1252"}.get(encoding, "latin-1")


def headers(names: list[str]) -> list[str]:
    """Names for columns: empty ones are column_i, repeated ones get _1, _2 and so on."""
    out: list[str] = []
    for i, n in enumerate(names):
        n = n.strip().lstrip("﻿") or f"column_{i + 1}"
        new, k = n, 0
        while new in out:
            k += 1
            new = f"{n}_{k}"
        out.append(new)
    return out


def read_delimited(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """A delimited file with a header line: all columns are strings, short rows are filled with "", blank lines dropped.

    Cells beyond the header's, however many, are joined by " | " in _extra_columns. Spark splits and
    reads the file; only its start is looked at here. limit is for previews.
    """
    encoding, sep = dialect(start := _start(spark, path))
    lines = csv.reader(start.decode(_python(encoding), "replace").splitlines(), delimiter=sep)
    names = headers(next((x for x in lines if any(c.strip() for c in x)), []))
    if not names:
        return spark.createDataFrame([], "_extra_columns string")
    schema = ", ".join(f"`{n}` string" for n in [*names, "_record"])
    # a record with more or fewer cells than the header comes as a whole, too
    rows = spark.read.csv(path, schema=schema, sep=sep, encoding=encoding, quote='"', escape='"', multiLine=True, header=True, enforceSchema=True, columnNameOfCorruptRecord="_record")
    if limit is not None:
        rows = rows.limit(limit)
    width = len(names)

    @F.pandas_udf("string")
    def beyond(records: pd.Series) -> pd.Series:
        cells = (next(csv.reader(io.StringIO(x), delimiter=sep), []) if x else [] for x in records)
        return pd.Series([" | ".join(c[width:]) for c in cells])

    some = F.concat_ws("", *[F.col(f"`{n}`") for n in names])
    over = F.when(F.col("_record").isNotNull(), beyond(F.col("_record"))).otherwise("")
    return rows.filter(F.trim(some) != "").select(*[F.coalesce(F.col(f"`{n}`"), F.lit("")).alias(n) for n in names], over.alias("_extra_columns"))


def preview(spark: SparkSession, path: str, rows: int = 25) -> DataFrame:
    """The first rows of a file, 1 to 200 of them."""
    return read_delimited(spark, path, min(max(rows, 1), 200))


def count_rows(spark: SparkSession, path: str) -> int:
    """The rows of a file without header and blank lines."""
    return read_delimited(spark, path).count()


def write_delimited(rows: DataFrame, path: str, order: str | None = None) -> None:
    """rows as delimited files, sorted by order, that no spreadsheet takes for formulas; text columns are guarded.

    The first header cell begins with a byte order mark, so that spreadsheets read UTF-8.
    """
    text = {f.name for f in rows.schema if f.dataType.simpleString() == "string"}
    rows = rows.orderBy(order) if order else rows
    out = rows.select(*[formula_guard(F.col(f"`{c}`")).alias(c) if c in text else F.col(f"`{c}`") for c in rows.columns])
    first = out.columns[0]
    out.withColumnRenamed(first, "\ufeff" + first).write.mode("overwrite").csv(path, header=True, quote='"', escape='"')
