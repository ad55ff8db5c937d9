"""Readers: Parquet tables, JSON-line event logs, uploads, HTML pages and workbooks; and the shared folder."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree
from xml.sax.saxutils import escape, quoteattr

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.functions import text as T
from millrace.sources import shared


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share; `shared.release` deletes it."""
    return shared.new_path(spark, name)


def files(spark: SparkSession, path: str, pattern: str | None = None) -> DataFrame:
    """path, modificationTime, length and content of whole files."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    return (reader.option("pathGlobFilter", pattern) if pattern else reader).load(path)


def decoded(content: Column) -> Column:
    """UTF-8 text, or Latin-1 where the bytes are no UTF-8."""
    return F.coalesce(F.try_validate_utf8(content.cast("string")), F.decode(content, "ISO-8859-1"))


def html_documents(spark: SparkSession, path: str) -> DataFrame:
    """path and visible text of HTML files, such as those of an unpacked help archive."""
    return files(spark, path).select("path", T.html_to_text(decoded(F.col("content"))).alias("text"))


def uploads(requests: DataFrame) -> DataFrame:
    """filename (base name only), content and size of (name, content_base64) rows."""
    name = F.try_element_at(F.split(F.replace("name", F.lit("\\"), F.lit("/")), "/"), F.lit(-1))
    body = F.unbase64("content_base64")
    return requests.select(name.alias("filename"), body.alias("content"), F.octet_length(body).alias("size"))


def parsed(content: DataFrame, parse: Callable[[bytes], str]) -> DataFrame:
    """path and text by any parser of whole files, for formats that need a library (PDF); a failing file gives null
    text and its error."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for path, data in zip(frame["path"], frame["content"]):
                try:
                    rows.append((path, parse(data), None))
                except Exception as e:  # any parser's error becomes the row's
                    rows.append((path, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["path", "text", "error"])

    return content.select("path", "content").mapInPandas(run, "path string, text string, error string")


_NS = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


#: Rows of workbooks that make a frame, at least.
FRAME = 4096


def _column(reference: str) -> int:
    n = 0
    for c in re.match(r"[A-Z]*", reference)[0]:
        n = n * 26 + ord(c) - 64
    return n - 1


def _sheet_rows(data: bytes, max_cols: int) -> Iterator[tuple[int, str, int, list[str]]]:
    """(sheet number, sheet, row number, cells) of a workbook, row by row."""
    book = zipfile.ZipFile(io.BytesIO(data))
    shared = []
    if "xl/sharedStrings.xml" in book.namelist():
        shared = ["".join(t.text or "" for t in item.iter(f"{_NS}t")) for item in ElementTree.fromstring(book.read("xl/sharedStrings.xml")).iter(f"{_NS}si")]
    targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
    for sheet_no, sheet in enumerate(ElementTree.fromstring(book.read("xl/workbook.xml")).iter(f"{_NS}sheet"), 1):
        target = targets.get(sheet.get(_REL), "").lstrip("/")
        try:
            source = book.open(target if target.startswith("xl/") else f"xl/{target}")
        except KeyError:
            continue
        for number, (_, row) in enumerate((e for e in ElementTree.iterparse(source) if e[1].tag == f"{_NS}row"), 1):
            cells: dict[int, str] = {}
            for i, c in enumerate(row.iter(f"{_NS}c")):
                at = _column(c.get("r")) if c.get("r") else i
                value, kind = c.find(f"{_NS}v"), c.get("t")
                text = "".join(t.text or "" for t in c.iter(f"{_NS}t")) if kind == "inlineStr" else value.text or "" if value is not None else ""
                if at < max_cols:
                    cells[at] = shared[int(text)] if kind == "s" and text else text
            yield sheet_no, sheet.get("name"), number, [cells.get(i, "") for i in range(max(cells, default=-1) + 1)]
            row.clear()


def workbook_rows(content: DataFrame, max_rows: int = 2000, max_cols: int = 50) -> DataFrame:
    """path, sheet_no, sheet, row_no and cells of the .xlsx files that can be read whole."""
    return read_workbooks(content, max_rows, max_cols).where("error is null").drop("error")


def read_workbooks(content: DataFrame, max_rows: int | None = 2000, max_cols: int = 50) -> DataFrame:
    """path, sheet_no, sheet, row_no, cells and error of .xlsx files: at most max_rows rows a sheet that are not blank, the
    header included (None: all). A damaged file has one row with its error and no other."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # many small workbooks make one frame, as each frame is sent on by itself
        shaped = lambda rows: pd.DataFrame(rows, columns=["path", "sheet_no", "sheet", "row_no", "cells", "error"])
        due = []
        for frame in frames:
            for path, data in zip(frame["path"], frame["content"]):
                rows, seen = [], {}
                try:
                    for sheet_no, sheet, number, cells in _sheet_rows(data, max_cols):
                        if any(c.strip() for c in cells) and (max_rows is None or seen.setdefault(sheet_no, 0) < max_rows):
                            seen[sheet_no] = seen.get(sheet_no, 0) + 1
                            rows.append((path, sheet_no, sheet, number, cells, None))
                except Exception as e:  # zip, XML, references: whatever a damaged file raises
                    rows = [(path, 0, None, 0, None, f"the workbook can't be read: {type(e).__name__}: {e}")]
                due += rows
                if len(due) >= FRAME:
                    yield shaped(due)
                    due = []
        if due:
            yield shaped(due)

    return content.select("path", "content").mapInPandas(run, "path string, sheet_no int, sheet string, row_no int, cells array<string>, error string")


def workbook_bytes(sheets: list[tuple[str, list[list[str]]]]) -> bytes:
    """A minimal .xlsx file of named sheets with text cells."""
    main, rel = _NS[1:-1], _REL[1:-3]
    package = "http://schemas.openxmlformats.org/package/2006/relationships"
    listed = "".join(f'<sheet name={quoteattr(name)} sheetId="{i}" r:id="rId{i}"/>' for i, (name, _) in enumerate(sheets, 1))
    targets = "".join(f'<Relationship Id="rId{i}" Target="worksheets/sheet{i}.xml"/>' for i in range(1, len(sheets) + 1))
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as book:
        book.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="{rel}"><sheets>{listed}</sheets></workbook>')
        book.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="{package}">{targets}</Relationships>')
        for i, (_, rows) in enumerate(sheets, 1):
            cells = "".join("<row>" + "".join(f'<c t="inlineStr"><is><t>{escape(c)}</t></is></c>' for c in row) + "</row>" for row in rows)
            book.writestr(f"xl/worksheets/sheet{i}.xml", f'<worksheet xmlns="{main}"><sheetData>{cells}</sheetData></worksheet>')
    return out.getvalue()


def sheet_rows(rows: DataFrame, keys: list[str], max_rows: int = 2000, max_cols: int = 50) -> DataFrame:
    """The same caps for rows that are a table already: (keys, row_no, cells) to the first non-blank rows."""
    cells = F.transform(F.slice("cells", 1, max_cols), T.cell_text)
    kept = rows.withColumn("cells", cells).where(F.exists("cells", lambda c: c != ""))
    at = F.row_number().over(Window.partitionBy(*keys).orderBy("row_no"))
    return kept.withColumn("_at", at).where(F.col("_at") <= max_rows).drop("_at")


def workbook_text(sheets: DataFrame, keys: list[str]) -> DataFrame:
    """keys and text of (keys, sheet_no, sheet, lines): `[Sheet] name`, the table, sheets apart by a blank line."""
    block = F.concat(F.lit("[Sheet] "), F.col("sheet"), F.lit("\n"), F.array_join("lines", "\n"))
    ordered = F.sort_array(F.collect_list(F.struct("sheet_no", block.alias("block"))))
    return sheets.groupBy(*keys).agg(F.array_join(F.transform(ordered, lambda b: b["block"]), "\n\n").alias("text"))


EVENT = "ts bigint, event string, name string, run_id string, data string"


def event_lines(lines: DataFrame) -> DataFrame:
    """Events of JSON lines (column `value`); lines that are no JSON object are skipped."""
    v = F.try_parse_json("value")
    get = lambda path, kind: F.try_variant_get(v, path, kind)
    data = F.to_json(F.try_variant_get(v, "$.data", "variant"))
    return lines.where(v.isNotNull() & F.ltrim("value").startswith("{")).select(
        get("$.ts", "bigint").alias("ts"), get("$.event", "string").alias("event"), get("$.name", "string").alias("name"), get("$.run_id", "string").alias("run_id"), data.alias("data")
    )


def read_event_log(spark: SparkSession, path: str, streaming: bool = False) -> DataFrame:
    return event_lines(spark.readStream.text(path) if streaming else spark.read.text(path))


def write_text(texts: DataFrame, path: str, text: str = "text") -> None:
    """One text a line end: a text's own last line end is not doubled."""
    texts.select(F.regexp_replace(text, r"\n\z", "").alias("value")).write.mode("append").text(path)


def protocol_lines(lines: DataFrame) -> DataFrame:
    """kind (text, tool, error) and content of older `type:json` lines; others are skipped."""
    kind = F.substring_index("value", ":", 1)
    body = F.try_variant_get(F.try_parse_json(F.expr("substring(value, instr(value, ':') + 1)")), "$", "string")
    named = F.when(kind == "0", "text").when(kind == "8", "tool").when(kind == "3", "error")
    return lines.where(F.contains("value", F.lit(":"))).select(named.alias("kind"), body.alias("content")).where("kind is not null and content is not null")


def write_event_log(events: DataFrame, path: str) -> None:
    events.write.mode("append").json(path)
