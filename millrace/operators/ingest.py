"""Ingest: uploads to chunks, by the extension of their names. PDF text is split by its headings or into windows, workbooks
into parts of their tables; what cannot be read has one row with its error."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.operators import chunking as C
from millrace.sources import shared
from millrace.sources import tables as S

#: Caps of a sheet and of a table part at ingest.
SHEET_ROWS, SHEET_COLUMNS, PART_ROWS, PART_CHARS = 5000, 50, 80, 8000
OTHER = "only PDF and Excel (xlsx) files can be ingested"
#: Fixed value: what stands for a workbook without any row.
EMPTY = "[ExcelEmpty] 未读取到任何非空表格数据"
CHUNK = "{keys}, chunk_index int, content string, metadata string, error string"


def workbook_chunks(uploads: DataFrame, keys: list[str], max_rows: int | None = SHEET_ROWS, part_rows: int = PART_ROWS, part_chars: int = PART_CHARS) -> DataFrame:
    """keys, chunk_index, content, metadata and error of (keys, filename, content) workbooks: the parts of their sheets'
    tables in order, or one placeholder where no sheet has a row; a damaged one has its error only. Without max_rows sheets
    are read whole."""
    named = uploads.withColumn("path", F.to_json(F.struct(*keys, "filename")))
    # read once: the sheets and the errors both come from it
    read = shared.saved(S.read_workbooks(named.select("path", "content"), max_rows, SHEET_COLUMNS), "workbooks")
    rows, errors = read.where("error is null"), read.where("error is not null").select("path", "error")
    # at most max_rows rows of SHEET_COLUMNS cells a sheet
    table = F.transform(F.sort_array(F.collect_list(F.struct("row_no", "cells"))), lambda r: r["cells"])
    sheets = rows.groupBy("path", "sheet_no", "sheet").agg(table.alias("cells")).select("path", "sheet_no", "sheet", C.render_table(F.col("cells")).alias("lines"))
    stem = F.regexp_replace(F.get_json_object("path", "$.filename"), r"\.[^.]*$", "")
    parts = C.split_tables(sheets, ["path", "sheet_no"], stem, part_rows, part_chars)
    listed = F.sort_array(F.collect_list(F.struct("sheet_no", "part_index", "part_count", "sheet", "header", "content")))
    found = named.select(*keys, "path").join(parts.groupBy("path").agg(listed.alias("parts")), "path", "left").join(errors, "path", "left")
    nothing = F.struct(F.lit(0).alias("sheet_no"), F.lit(1).alias("part_index"), F.lit(1).alias("part_count"), F.lit("").alias("sheet"), F.array().cast("array<string>").alias("header"), F.concat(F.lit("[Table] "), stem, F.lit(f"\n{EMPTY}")).alias("content"))
    every = found.select(*keys, "path", "error", F.posexplode(F.coalesce("parts", F.array(nothing))).alias("chunk_index", "p"))
    metadata = F.to_json(F.struct(F.lit("table").alias("type"), stem.alias("table_name"), F.col("p.sheet").alias("sheet_name"), "p.part_index", "p.part_count", "p.header"))
    whole = lambda c: F.when(F.col("error").isNull(), c)
    return every.select(*keys, whole(F.col("chunk_index")).alias("chunk_index"), whole(F.col("p.content")).alias("content"), whole(metadata).alias("metadata"), "error")


def text_chunks(texts: DataFrame, keys: list[str]) -> DataFrame:
    """keys, chunk_index, content and metadata of (keys, text) documents."""
    made = C.split_document(texts, keys)
    return made.select(*keys, "chunk_index", "content", F.to_json(F.struct("type", "number", "title")).alias("metadata"))


def ingest_chunks(uploads: DataFrame, keys: list[str], parse: Callable[[bytes], str] | None = None, max_rows: int | None = SHEET_ROWS, part_chars: int = PART_CHARS) -> DataFrame:
    """keys, chunk_index, content, metadata and error of (keys, filename, content) uploads. `parse` turns the bytes of a
    .pdf into text; a file that it fails on, or that has another extension, has one row with an error only."""
    name, none = F.lower("filename"), F.lit(None).cast("string")
    columns = [*keys, "chunk_index", "content", "metadata"]
    books = workbook_chunks(uploads.where(name.endswith(".xlsx")), keys, max_rows, part_chars=part_chars).select(*columns, "error")
    failed = lambda rows, error: rows.select(*keys, F.lit(None).cast("int").alias("chunk_index"), none.alias("content"), none.alias("metadata"), error.alias("error"))
    others = failed(uploads.where(F.coalesce(~name.endswith(".xlsx") & ~name.endswith(".pdf"), F.lit(True))), F.lit(OTHER))
    pdfs = uploads.where(name.endswith(".pdf"))
    if parse is None:
        return books.unionByName(others).unionByName(failed(pdfs, F.lit("a parser of PDF files must be given")))
    named = pdfs.withColumn("path", F.to_json(F.struct(*keys)))
    read = S.parsed(named.select("path", "content"), parse).join(named.select(*keys, "path"), "path")
    texts = text_chunks(read.where("error is null").select(*keys, "text"), keys).select(*columns, none.alias("error"))
    return books.unionByName(others).unionByName(texts).unionByName(failed(read.where("error is not null"), F.col("error")))
