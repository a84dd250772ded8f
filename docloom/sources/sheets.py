"""Tables in files (S04-S06): rows of CSV and TSV files and of every sheet of XLSX and ODS files, read on executors, with side-cars and summaries by Spark."""

from __future__ import annotations

import csv
import datetime
import io
import posixpath
import re
from collections.abc import Iterator
from xml.etree import ElementTree
from xml.etree.ElementTree import Element

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .ooxml import Package, child, children, local, number, value

ROWS = "path string, sheet string, sheet_index int, row int, cells array<string>, error string"
ROWS_ARROW = pa.schema([("path", pa.string()), ("sheet", pa.string()), ("sheet_index", pa.int32()), ("row", pa.int32()), ("cells", pa.list_(pa.string())), ("error", pa.string())])
BATCH_ROWS, MOST_COLUMNS = 5_000, 16_384
#: Numbers of the built-in formats that show a date or a time.
DATE_FORMATS = {*range(14, 23), *range(27, 37), *range(45, 48), *range(50, 59)}


def rows_of(package: Package, name: str, tag: str) -> Iterator[Element]:
    """A part's elements of one tag, each cleared once it has been used."""
    if name not in package.names:
        return
    with package.zip.open(name) as part:
        for _, e in ElementTree.iterparse(io.BufferedReader(part)):
            if local(e) == tag:
                yield e
                e.clear()


def string_of(si: Element) -> str:
    """A shared or inline string: its own text or its runs', without phonetic hints."""
    return "".join((c.text or "") if local(c) == "t" else "".join(t.text or "" for t in children(c, "t")) if local(c) == "r" else "" for c in si)


def date_styles(styles: Element | None) -> list[bool]:
    """For each cell style whether it shows a date."""
    own = {number(value(f, "numFmtId")): re.sub(r'"[^"]*"|\\.|\[[^\]]*\]', "", value(f, "formatCode") or "") for f in children(child(styles, "numFmts"), "numFmt")}
    kinds = [number(value(x, "numFmtId")) for x in children(child(styles, "cellXfs"), "xf")]
    return [k in DATE_FORMATS or bool(re.search("[ymdhs]", own.get(k, ""), re.I)) for k in kinds]


def day_of(serial: float, since: datetime.datetime) -> str:
    """A serial number as a date, with the time if there is one."""
    moment = since + datetime.timedelta(microseconds=round(serial * 86_400) * 1_000_000)
    return moment.isoformat(sep=" ") if serial % 1 else moment.date().isoformat()


def xlsx_rows(package: Package) -> Iterator[tuple[str, int, int, list[str | None]]]:
    """(sheet, its index, row from 1, cells) in order; rows and cells that aren't there are left out, or null before later ones."""
    name = next((part for kind, part in package.relations("").values() if kind == "officeDocument"), "xl/workbook.xml")
    book, relations = package.part(name), package.relations(name)
    parts = {kind: part for kind, part in relations.values()}
    strings = [string_of(si) for si in rows_of(package, parts.get("sharedStrings", ""), "si")]
    dates = date_styles(package.part(parts.get("styles", "")))
    since = datetime.datetime(1904, 1, 1) if value(child(book, "workbookPr"), "date1904") in ("1", "true") else datetime.datetime(1899, 12, 30)

    def text(c: Element) -> str | None:
        kind, v = value(c, "t") or "n", child(c, "v")
        if kind == "inlineStr":
            return string_of(child(c, "is")) if child(c, "is") is not None else None
        if v is None or v.text is None:
            return None
        if kind == "s":
            return strings[number(v.text, -1)] if 0 <= number(v.text, -1) < len(strings) else None
        if kind == "b":
            return "true" if v.text.strip() == "1" else "false"
        style = number(value(c, "s"))
        if kind == "n" and style < len(dates) and dates[style] and re.fullmatch(r"\d{1,7}(\.\d+)?", v.text):
            return day_of(float(v.text), since)
        return v.text

    for index, sheet in enumerate(children(child(book, "sheets"), "sheet")):
        ref = next((v for a, v in sheet.attrib.items() if a.endswith("}id")), "")
        last = 0
        for row in rows_of(package, relations.get(ref, ("", ""))[1], "row"):
            last = number(value(row, "r"), last + 1)
            cells: list[str | None] = []
            for c in children(row, "c"):
                letters = re.match("[A-Z]{1,3}", value(c, "r") or "")
                at = len(cells)
                if letters:
                    at = sum((ord(x) - 64) * 26**k for k, x in enumerate(reversed(letters[0]))) - 1
                if len(cells) <= at < MOST_COLUMNS:
                    cells += [None] * (at - len(cells)) + [text(c)]
            if any(x is not None for x in cells):
                yield value(sheet, "name") or "", index, last, cells


def ods_rows(package: Package) -> Iterator[tuple[str, int, int, list[str | None]]]:
    """The same of an OpenDocument file; repeats are spelt out, but for empty ones at a row's or a sheet's end."""
    sheets = child(package.part("content.xml"), "body", "spreadsheet")
    for index, table in enumerate(children(sheets, "table")):
        at = 0
        for row in (e for e in table.iter() if local(e) == "table-row"):
            cells: list[str | None] = []
            for c in row:
                if local(c) not in ("table-cell", "covered-table-cell"):
                    continue
                kind = value(c, "value-type")
                said = "\n".join("".join(p.itertext()) for p in children(c, "p")) or None
                x = value(c, "value") if kind in ("float", "percentage", "currency") else value(c, "date-value") if kind == "date" else value(c, "boolean-value") if kind == "boolean" else said
                times = number(value(c, "number-columns-repeated"), 1)
                cells += [x] * min(times, MOST_COLUMNS - len(cells))
            while cells and cells[-1] is None:
                cells.pop()
            times = number(value(row, "number-rows-repeated"), 1)
            for k in range(times if cells else 0):
                yield value(table, "name") or "", index, at + k + 1, list(cells)
            at += times


def text_rows(path: str, content: bytes) -> Iterator[tuple[str, int, int, list[str | None]]]:
    """The rows of a file of separated values as a sheet named like the file: tabs in a .tsv, else what its first line has most of."""
    text = content.decode("utf-8-sig", "replace").replace("\0", "")
    first = text.partition("\n")[0]
    separator = "\t" if path.lower().endswith(".tsv") else max(",;\t|", key=first.count)
    name = posixpath.basename(path)
    for k, row in enumerate(csv.reader(io.StringIO(text, newline=""), delimiter=separator), 1):
        if any(row):
            yield name, 0, k, [x if x else None for x in row[:MOST_COLUMNS]]


def rows_in(path: str, content: bytes) -> Iterator[tuple[str, int, int, list[str | None]]]:
    if path.lower().endswith((".csv", ".tsv")):
        yield from text_rows(path, content)
        return
    package = Package(content)
    if "content.xml" in package.names:
        yield from ods_rows(package)
    elif any(n.startswith("xl/") for n in package.names):
        yield from xlsx_rows(package)
    else:
        raise ValueError("no workbook")


def sheet_rows(files: DataFrame) -> DataFrame:
    """ROWS of (path, content): every row of every sheet; a file that can't be read is one row with an error.

    A task holds one file's bytes and its shared strings, and hands rows on as it reads them. Large files of separated values
    are better read by `readers.csv`, which splits them.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            for path, content in zip(batch["path"].to_pylist(), batch["content"], strict=True):
                try:
                    for row in rows_in(path or "", content.as_py() or b""):
                        held.append((path, *row, None))
                        if len(held) == BATCH_ROWS:
                            yield pa.RecordBatch.from_pylist([dict(zip(ROWS_ARROW.names, r, strict=True)) for r in held], schema=ROWS_ARROW)
                            held = []
                except (ValueError, csv.Error, ElementTree.ParseError, OSError, EOFError, RuntimeError, OverflowError) as error:
                    held.append((path, None, None, None, None, f"{type(error).__name__}: {error}"))
        yield pa.RecordBatch.from_pylist([dict(zip(ROWS_ARROW.names, r, strict=True)) for r in held], schema=ROWS_ARROW)

    return files.select(F.col("path").cast("string").alias("path"), "content").mapInArrow(read, ROWS)


def write_side_cars(rows: DataFrame, folder: str) -> None:
    """The sheets as Parquet, partitioned by file and sheet, so that one sheet is read alone."""
    sound = rows.filter("error IS NULL").select("path", "sheet_index", "sheet", "row", "cells")
    sound.repartition("path", "sheet_index").sortWithinPartitions("path", "sheet_index", "row").write.partitionBy("path", "sheet_index").parquet(folder)


def sheet_summaries(rows: DataFrame, samples: int = 5) -> DataFrame:
    """(path, sheet_index, sheet, n_rows, n_columns, columns, text): a sheet's first row names its columns; the text shows shape, columns, first and last rows."""
    sheet = Window.partitionBy("path", "sheet_index")
    place = F.row_number().over(sheet.orderBy("row"))
    sound = rows.filter("error IS NULL").withColumn("place", place).withColumn("total", F.count("*").over(sheet))
    shown = F.concat_ws(" | ", F.transform("cells", lambda x: F.coalesce(x, F.lit(""))))
    head, tail = F.col("place").between(2, samples + 1), (F.col("place") > 1) & (F.col("place") > F.col("total") - samples)
    lines = lambda kept: F.array_join(F.transform(F.sort_array(F.collect_list(F.when(kept, F.struct("place", shown.alias("line"))))), lambda x: x["line"]), "\n")
    found = sound.groupBy("path", "sheet_index").agg(
        F.first("sheet").alias("sheet"), (F.count("*") - 1).alias("n_rows"), F.max(F.size("cells")).alias("n_columns"), F.min_by("cells", "place").alias("columns"), lines(head).alias("first"), lines(tail).alias("last")
    )
    names = F.array_join(F.transform("columns", lambda x: F.coalesce(x, F.lit(""))), ", ")
    text = F.concat(F.lit("=== Sheet: "), "sheet", F.lit(" ===\nShape: "), F.col("n_rows").cast("string"), F.lit(" rows × "), F.col("n_columns").cast("string"), F.lit(" columns\nColumns: "), names, F.lit("\n\nSample (first rows):\n"), "first", F.lit("\n\nSample (last rows):\n"), "last")
    return found.select("path", "sheet_index", "sheet", "n_rows", "n_columns", "columns", text.alias("text"))


def workbook_texts(files: DataFrame) -> DataFrame:
    """S06 as an extractor: path, text (the sheets' summaries), status, error."""
    rows = sheet_rows(files)
    parts = sheet_summaries(rows).select("path", "sheet_index", "text", F.lit(None).cast("string").alias("error"))
    parts = parts.unionByName(rows.filter("error IS NOT NULL").select("path", F.lit(None).cast("int").alias("sheet_index"), F.lit(None).cast("string").alias("text"), "error"))
    ordered = F.transform(F.sort_array(F.collect_list(F.when(F.col("text").isNotNull(), F.struct("sheet_index", "text")))), lambda x: x["text"])
    found = parts.groupBy("path").agg(F.array_join(ordered, "\n\n===\n\n").alias("text"), F.max("error").alias("error"))
    found = files.select(F.col("path").cast("string").alias("path")).join(found, "path", "left").withColumn("error", F.coalesce("error", F.when(F.coalesce("text", F.lit("")) == "", "no rows")))
    return found.select("path", F.when(F.col("error").isNull(), F.col("text")).alias("text"), F.when(F.col("error").isNull(), "success").otherwise("failed").alias("status"), "error")
