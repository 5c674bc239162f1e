"""Tables from files, by extension: CSV, TSV, Parquet, JSON lines and XLSX."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_LINK = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


def open_table(spark: SparkSession, path: str, sheet: str | None = None, max_rows: int | None = None) -> DataFrame:
    """The table in a file or folder of files; an XLSX sheet comes as cells."""
    kind = path.rstrip("/").rsplit(".", 1)[-1].lower()
    if kind in ("csv", "tsv"):
        out = read_csv(spark, path, "\t" if kind == "tsv" else ",")
    elif kind in ("xlsx", "xlsm"):
        out = read_xlsx(spark, path, sheet)
    elif kind in ("json", "jsonl"):
        out = spark.read.json(path)
    else:
        out = spark.read.parquet(path)
    return out.limit(max_rows) if max_rows is not None else out


def read_csv(spark: SparkSession, path: str, delimiter: str = ",", quote: str = '"', header: bool = True, schema: str | None = None) -> DataFrame:
    """Fields without their surrounding white space; kinds are inferred unless a schema is given."""
    reader = spark.read.option("sep", delimiter).option("quote", quote).option("escape", quote).option("header", header).option("multiLine", True).option("ignoreLeadingWhiteSpace", True).option("ignoreTrailingWhiteSpace", True)
    return reader.schema(schema).csv(path) if schema else reader.option("inferSchema", True).csv(path)


def write_csv(df: DataFrame, path: str, delimiter: str = ",", header: bool = True) -> None:
    df.write.option("sep", delimiter).option("header", header).option("escape", '"').mode("overwrite").csv(path)


def column_number(letters: str) -> int:
    n = 0
    for c in letters:
        n = n * 26 + ord(c) - 64
    return n


def column_letters(n: int) -> str:
    out = ""
    while n:
        n, r = divmod(n - 1, 26)
        out = chr(65 + r) + out
    return out


def _cells(content: bytes, wanted: str | None) -> Iterator[tuple[str, int, int, str, str | None]]:
    """(sheet, row, column, kind, value) of a workbook, sheet by sheet; kinds are number, text, boolean and error."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = set(z.namelist())
        shared: list[str] = []
        if "xl/sharedStrings.xml" in names:
            for item in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{_MAIN}si"):
                shared.append("".join(t.text or "" for t in item.iter(f"{_MAIN}t")))
        links = {r.get("Id"): r.get("Target", "") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        for sheet in ElementTree.fromstring(z.read("xl/workbook.xml")).iter(f"{_MAIN}sheet"):
            name, target = sheet.get("name", ""), links.get(sheet.get(_LINK), "")
            part = target.lstrip("/") if target.startswith("/") else f"xl/{target}"
            if part not in names or (wanted is not None and name.lower() != wanted.lower()):
                continue
            with z.open(part) as f:
                for _, cell in ElementTree.iterparse(f):
                    if cell.tag != f"{_MAIN}c":
                        continue
                    place, kind = re.match(r"([A-Z]+)(\d+)", cell.get("r", "A1")), cell.get("t", "n")
                    raw = cell.find(f"{_MAIN}v")
                    value = raw.text if raw is not None else None
                    if kind == "s" and value is not None:
                        value = shared[int(value)]
                    elif kind == "inlineStr":
                        value = "".join(t.text or "" for t in cell.iter(f"{_MAIN}t"))
                    if value is not None and place:
                        yield name, int(place[2]), column_number(place[1]), {"n": "number", "b": "boolean", "e": "error"}.get(kind, "text"), value
                    cell.clear()


def read_xlsx(spark: SparkSession, path: str, sheet: str | None = None) -> DataFrame:
    """(path, sheet, row, column, kind, value) of the cells of one or many workbooks; a workbook is one task's."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["path", "sheet", "row", "column", "kind", "value"]
        for batch in batches:
            for where, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                rows: list[tuple] = []
                for c in _cells(content.as_py(), sheet):
                    rows.append((where, *c))
                    if len(rows) == 50_000:
                        yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows, strict=True)], names)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows, strict=True)], names)

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(parse, "path string, sheet string, row long, column long, kind string, value string")


def table_of_cells(cells: DataFrame, columns: dict[int, tuple[str, str]], header_row: int = 1) -> DataFrame:
    """A table from cells: for each column number a name and a kind; rows below the header."""
    rows = cells.where(F.col("row") > header_row).groupBy("row")
    return rows.agg(*(F.max(F.when(F.col("column") == n, F.col("value"))).try_cast(kind).alias(name) for n, (name, kind) in columns.items()))
