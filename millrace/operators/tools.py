"""The operations that an agent calls, with JSON text as their results: search, files, chunks and pages of one collection or
of several, and read-only SQL.

Results are bounded by their nature (a search's hits, named files and chunks, a page), so they may be text in the
driver. Of several collections each is asked for itself and its rows are tagged with its kb_id; one that fails is skipped. An
empty argument gives a fixed message instead of JSON.
"""

from __future__ import annotations

import json
import os
from collections.abc import Callable, Mapping

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators import catalog as C
from millrace.operators import retrieval, sqlgate

#: What stands for a result where ids or chunks are missing.
NO_IDS, NO_CHUNKS = "give the ids of files", "give the chunks to read"
#: The setting that turns a reranker on, and what it says then.
RERANK, ON = "KB_RERANK", ("1", "true", "yes")


def default_scorer(scorer: Callable[[pd.Series], pd.Series] | None, settings: Mapping[str, str] = os.environ) -> Callable[[pd.Series], pd.Series] | None:
    """The scorer if the settings ask for reranking, else none, which keeps the given order."""
    return scorer if settings.get(RERANK, "").strip().lower() in ON else None


def _json(rows: list[dict]) -> str:
    return json.dumps(rows, ensure_ascii=False, indent=2)


def _rows(df: DataFrame) -> list[dict]:
    return [r.asDict(recursive=True) for r in df.collect()]


class KnowledgeTools:
    """The tools over some collections of a catalog. `embedder` makes the vector of a query as it made those of the chunks;
    without it a search has its keyword half only."""

    def __init__(self, catalog: C.Catalog, kb_ids: list[int], embedder: Callable[[list[str]], np.ndarray] | None = None, scorer: Callable[[pd.Series], pd.Series] | None = None):
        self.catalog, self.kb_ids, self.embedder, self.scorer = catalog, kb_ids, embedder, scorer

    def _each(self, ask: Callable[[int], list[dict]]) -> str:
        """Rows of every collection with its kb_id; a single collection's rows have none, and its failure is the caller's."""
        if len(self.kb_ids) == 1:
            return _json(ask(self.kb_ids[0]))
        out = []
        for kb_id in self.kb_ids:
            try:
                out += [row | {"kb_id": kb_id} for row in ask(kb_id)]
            except Exception:  # whatever is wrong with one collection
                continue
        return _json(out)

    def _search(self, kb_id: int, query: str) -> list[dict]:
        chunks = self.catalog.all_chunks([kb_id])
        vector = np.asarray(self.embedder([query])[0], float).tolist() if self.embedder and query.strip() else [0.0]
        found = retrieval.hybrid_search(chunks.select("file_id", "chunk_index", "content", "embedding"), query, vector, scorer=self.scorer)
        if "preview" not in found.columns:
            return []
        named = found.join(F.broadcast(chunks.select("file_id", "chunk_index", "filename", "metadata").join(F.broadcast(found.select("file_id", "chunk_index")), ["file_id", "chunk_index"], "left_semi")), ["file_id", "chunk_index"])
        keep = ["file_id", "chunk_index", "filename", "score", "preview", "metadata"] + (["rerank_score"] if "rerank_score" in found.columns else [])
        return [{k: v for k, v in row.items() if v is not None or k != "metadata"} for row in _rows(named.orderBy("position").select(*keep))]

    def query(self, query: str) -> str:
        return self._each(lambda kb_id: self._search(kb_id, query))

    def files_meta(self, file_ids: list[int]) -> str:
        if not file_ids:
            return NO_IDS
        ids = self.catalog.spark.createDataFrame([(int(i),) for i in file_ids], "file_id long")
        return self._each(lambda kb_id: _rows(C.files_meta(self.catalog.files(kb_id), ids).orderBy("file_id").select(F.col("file_id").alias("id"), "filename", "chunk_count", "status")))

    def read_chunks(self, specs: list[dict]) -> str:
        """specs: fileId or file_id and chunkIndex or chunk_index; bad ones are skipped."""
        if not specs:
            return NO_CHUNKS
        named = [(s.get("fileId", s.get("file_id")), s.get("chunkIndex", s.get("chunk_index"))) for s in specs if isinstance(s, dict)]
        whole = [(int(a), int(b)) for a, b in named if all(isinstance(x, (int, str)) and str(x).lstrip("-").isdigit() for x in (a, b))]
        wanted = self.catalog.spark.createDataFrame(whole, "file_id long, chunk_index int")

        def ask(kb_id: int) -> list[dict]:
            found = C.read_chunks(self.catalog.all_chunks([kb_id]).drop("filename"), wanted, self.catalog.files(kb_id))
            rows = _rows(found.orderBy("file_id", "chunk_index").select("file_id", "chunk_index", "filename", "content", "metadata"))
            return [{k: v for k, v in row.items() if v or k != "metadata"} for row in rows]

        return self._each(ask)

    def list_files(self, page: int = 0, size: int = 10) -> str:
        return self._each(lambda kb_id: _rows(C.page(self.catalog.files(kb_id), page, size).select(F.col("file_id").alias("id"), "filename", "chunk_count")))


class SqlTools:
    """The tools over the tables of a folder. Without one, or with a missing one, every tool says so."""

    def __init__(self, spark: SparkSession, folder: str | None):
        self.spark, self.missing = spark, sqlgate.open_database(spark, folder)

    def _or_missing(self, make: Callable[[], object]) -> str:
        return json.dumps({"ok": False, "error": self.missing} if self.missing else make(), ensure_ascii=False, default=str)

    def list_tables(self) -> str:
        return self._or_missing(lambda: sqlgate.list_tables(self.spark))

    def schema(self, tables: str) -> str:
        return self._or_missing(lambda: sqlgate.describe(self.spark, tables))

    def check(self, query: str) -> str:
        why = sqlgate.check_query(query)
        return json.dumps({"ok": False, "error": why} if why else {"ok": True}, ensure_ascii=False)

    def run(self, query: str) -> str:
        return self._or_missing(lambda: sqlgate.query_result(self.spark, query))
