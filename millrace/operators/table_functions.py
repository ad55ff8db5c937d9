"""Splitters as table functions of SQL: `SELECT ... FROM documents, LATERAL split_text(text, 'fixed')`.

The columns follow the strategy, which must be a constant: every one has chunk_index and content, `lines` has the number of
its first line, `sheets` the sheet's name. A null or blank text has no chunk. Each call sees one text; DataFrame plans
should use `chunking`, which needs no Python.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import IntegerType, StringType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

#: White space as the rest of the library means it: what str.strip takes.
SIZE, OVERLAP = 500, 100
EXTRA = {"fixed": (), "lines": (("line", IntegerType()),), "sheets": (("sheet", StringType()),)}
NAMES = frozenset(("split_text", "split_fixed"))


def fixed(text: str, size: int, overlap: int) -> Iterator[str]:
    if size <= 0 or not 0 <= overlap < size:
        raise ValueError("size must be positive and overlap at least 0 and less than size")
    text = text.strip()
    for start in range(0, max(1, len(text) - overlap), size - overlap) if text else ():
        yield text[start : start + size]


def lines(text: str, size: int) -> Iterator[tuple[str, int]]:
    """Whole lines up to `size` characters together; a longer line stands alone."""
    held, first, n = [], 0, 0
    for i, line in enumerate(text.split("\n")):
        if held and n + 1 + len(line) > size:
            yield "\n".join(held), first
            held, first, n = [], i, 0
        n += len(line) + bool(held)
        held.append(line)
    yield "\n".join(held), first


def sheets(text: str) -> Iterator[tuple[str, str]]:
    """The blocks that `[Sheet] name` lines open; what stands before the first goes."""
    parts = re.split(r"(?m)^\[Sheet\][^\S\n]*(\S.*)$", text)
    for name, block in zip(parts[1::2], parts[2::2]):
        if block.strip():
            yield block.strip("\n"), name.strip()


class SplitText:
    @staticmethod
    def analyze(text: AnalyzeArgument, strategy: AnalyzeArgument, size: AnalyzeArgument | None = None, overlap: AnalyzeArgument | None = None) -> AnalyzeResult:
        if strategy.value not in EXTRA:
            raise ValueError(f"the strategy must be a constant, one of {', '.join(EXTRA)}")
        schema = StructType().add("chunk_index", IntegerType()).add("content", StringType())
        for name, kind in EXTRA[strategy.value]:
            schema = schema.add(name, kind)
        return AnalyzeResult(schema=schema)

    def eval(self, text: str | None, strategy: str, size: int = SIZE, overlap: int = OVERLAP) -> Iterator[tuple]:
        if text is None or not text.strip():
            return
        made = ((x,) for x in fixed(text, size, overlap)) if strategy == "fixed" else lines(text, size) if strategy == "lines" else sheets(text)
        for i, row in enumerate(made):
            yield (i, *row)


class SplitFixed:
    def eval(self, text: str | None, size: int = SIZE, overlap: int = OVERLAP) -> Iterator[tuple[int, str]]:
        yield from enumerate(fixed(text or "", size, overlap))


def register(spark: SparkSession) -> frozenset[str]:
    """Makes the functions known to SQL; the names are what the gate must let through."""
    spark.udtf.register("split_text", udtf(SplitText))
    spark.udtf.register("split_fixed", udtf(SplitFixed, returnType="chunk_index int, content string"))
    return NAMES
