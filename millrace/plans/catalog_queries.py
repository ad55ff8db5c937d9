"""Catalog queries: every document is a file of the collection of its source, its windows the file's chunks."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import text as T
from millrace.operators import catalog as C
from millrace.operators.vectors import HashEmbedder
from millrace.plans.chunk_queries import CHUNKS_SQL, chunks
from millrace.sources import tables as S

NAME = "concat('doc-', doc_id, CASE doc_id % 3 WHEN 0 THEN '.pdf' WHEN 1 THEN '.xlsx' ELSE '.txt' END)"
FILES_SQL = f"files AS (SELECT doc_id AS file_id, {NAME} AS filename, (n_chars // 500)::INT AS chunk_count, 'done' AS status, source FROM documents)"


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = S.table(spark, sf_dir, "documents")
    return docs.select(F.col("doc_id").alias("file_id"), F.expr(NAME).alias("filename"), F.expr("CAST(n_chars DIV 500 AS INT)").alias("chunk_count"), F.lit("done").alias("status"), "source")


def files_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.page(_files(spark, sf_dir), 2, 10).select("file_id", "filename", "chunk_count")


def files_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.pages_of(_files(spark, sf_dir), "source", 10).select("source", "file_id", "page")


def files_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.files_meta(_files(spark, sf_dir), S.table(spark, sf_dir, "labels").where("toxic = 1").select(F.col("doc_id").alias("file_id"))).select("file_id", "filename", "status")


def files_mime(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.with_mime(_files(spark, sf_dir)).select("file_id", "filename", "mime")


def file_name_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _files(spark, sf_dir).where(C.name_contains(" DOC-1 ")).select("file_id", "filename")


def chunk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks(spark, sf_dir).where(C.chunk_contains("12")).select("file_id", "chunk_index")


def chunk_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks(spark, sf_dir).select("file_id", "chunk_index", T.listed(F.col("content")).alias("shown"), T.utf16_length(F.col("content")).alias("n_utf16"))


def read_chunks_semijoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All chunks of every labelled document, asked for twice; the files of toxic documents are gone."""
    labels, every = S.table(spark, sf_dir, "labels"), chunks(spark, sf_dir)
    specs = every.select("file_id", "chunk_index").join(labels.select(F.col("doc_id").alias("file_id")), "file_id", "left_semi")
    files = C.without_files(_files(spark, sf_dir), labels.where("toxic = 1").select(F.col("doc_id").alias("file_id")))
    return C.read_chunks(every, specs.union(specs), files).select("file_id", "chunk_index", "filename", "content")


def upload_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All benchmark items uploaded under the names of the first files or new ones."""
    names = S.table(spark, sf_dir, "benchmark").select(F.expr("concat('doc-', item_id, CASE item_id % 2 WHEN 0 THEN '.pdf' ELSE '.new' END)").alias("filename"))
    files = _files(spark, sf_dir).select("file_id", "filename", "chunk_count", "status")
    next_id = files.agg(F.max("file_id") + 1).first()[0] or 1
    return C.upsert_uploads(files, names, F.lit(next_id))


def delete_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks by file once the toxic documents' files are gone."""
    gone = S.table(spark, sf_dir, "labels").where("toxic = 1").select(F.col("doc_id").alias("file_id"))
    return C.without_files(chunks(spark, sf_dir), gone).groupBy("file_id").agg(F.count("*").alias("n"))


def next_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _files(spark, sf_dir).groupBy("source").agg((F.max("file_id") + 1).alias("next_file_id"), F.count("*").alias("n"))


def kb_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A collection per region, with the made-up name where none is stored, and its external id both ways."""
    ids = S.table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("kb_id"))
    stored = S.table(spark, sf_dir, "region").select(F.col("r_regionkey").cast("long").alias("kb_id"), F.col("r_name").alias("name"))
    made = C.default_meta(stored, ids).withColumn("id", T.external_id("kb", F.col("kb_id")))
    return made.select("id", "name", T.parse_external_id("kb", F.col("id")).alias("kb_id"))


def catalog_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All chunks saved into a catalog and read back, with the file's count and status."""
    catalog = C.Catalog(spark, S.shared_path(spark, "catalog"))
    kb = catalog.create_kb("documents")
    file_id = catalog.save_upload(kb, "all/documents.pdf")
    numbered = S.table(spark, sf_dir, "documents").select(F.col("doc_id").cast("int").alias("chunk_index"), F.col("text").alias("content"))
    catalog.save_chunks(kb, file_id, numbered)
    files = catalog.files(kb).select("file_id", "chunk_count", "status")
    return catalog.chunks(kb, file_id).join(F.broadcast(files.limit(1)), "file_id").select("chunk_index", F.length("content").alias("n"), "chunk_count", "status")


def catalog_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A workbook of all regions uploaded, ingested by its extension with vectors, and read back from the collection."""
    catalog = C.Catalog(spark, S.shared_path(spark, "catalog"))
    kb = catalog.create_kb("regions")
    rows = [[str(r.r_regionkey), r.r_name] for r in S.table(spark, sf_dir, "region").orderBy("r_regionkey").collect()]  # a constant of the schema: five regions
    catalog.save_upload(kb, "in/regions.xlsx", S.workbook_bytes([("regions", [["key", "name"], *rows])]))
    catalog.ingest(kb, "regions.xlsx", embedder=HashEmbedder(16))
    return catalog.all_chunks([kb]).select("filename", "chunk_index", "content", F.size("embedding").alias("dim"))


def catalog_bulk_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A workbook of every customer's orders, all uploaded in one change and ingested in another, then read back with their
    files' rows and the id that the next file would get."""
    row = F.struct("o_orderkey", F.array(F.col("o_orderkey").cast("string"), "o_orderstatus", "o_orderpriority").alias("cells"))
    books = S.table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.transform(F.sort_array(F.collect_list(row)), lambda r: r["cells"]).alias("body"))

    @F.pandas_udf("binary")
    def written(bodies: pd.Series) -> pd.Series:
        return bodies.map(lambda body: S.workbook_bytes([("orders", [["key", "status", "priority"], *body])]))

    catalog = C.Catalog(spark, S.shared_path(spark, "catalog"))
    kb = catalog.create_kb("customers")
    catalog.save_uploads(kb, books.select(F.concat(F.lit("in/customer-"), F.col("o_custkey").cast("string"), F.lit(".xlsx")).alias("filename"), written("body").alias("content")))
    catalog.ingest_all(kb)
    files = catalog.files(kb).select("file_id", "chunk_count", "status")
    made = catalog.all_chunks([kb]).join(files, "file_id").join(F.broadcast(catalog.next_ids().select(F.col("kb_id"), "next_id")), "kb_id")
    return made.select("file_id", "filename", "chunk_index", "content", "chunk_count", "status", "next_id")


QUERIES = {f.__name__: f for f in (
    files_page, files_pages, files_meta, files_mime, file_name_search, chunk_search, chunk_listing, read_chunks_semijoin, upload_upsert, delete_cascade, next_id, kb_listing, catalog_roundtrip, catalog_ingest,
    catalog_bulk_ingest,
)}
ORACLES = {
    "files_page": f"WITH {FILES_SQL} SELECT file_id, filename, chunk_count FROM files ORDER BY file_id LIMIT 10 OFFSET 20",
    "files_pages": f"WITH {FILES_SQL} SELECT source, file_id, ((row_number() OVER (PARTITION BY source ORDER BY file_id) - 1) // 10)::INT AS page FROM files",
    "files_meta": f"WITH {FILES_SQL} SELECT file_id, filename, status FROM files WHERE file_id IN (SELECT doc_id FROM labels WHERE toxic = 1)",
    "files_mime": f"""WITH {FILES_SQL} SELECT file_id, filename, CASE WHEN filename LIKE '%.pdf' THEN 'application/pdf' WHEN filename LIKE '%.xlsx'
        THEN 'application/vnd.openxmlformats-officedocument.spreadsheetml.sheet' ELSE 'application/octet-stream' END AS mime FROM files""",
    "file_name_search": f"WITH {FILES_SQL} SELECT file_id, filename FROM files WHERE contains(filename, 'doc-1')",
    "chunk_search": f"WITH {CHUNKS_SQL} SELECT file_id, chunk_index FROM chunks WHERE contains(content, '12') OR contains(chunk_index::VARCHAR, '12')",
    "chunk_listing": f"""WITH {CHUNKS_SQL} SELECT file_id, chunk_index, regexp_replace(substr(content, 1, 30), '[\\r\\n]+', ' ', 'g') || '...' AS shown,
        (length(content) + len(list_filter(string_split(content, ''), lambda c: ord(c) > 65535)))::INT AS n_utf16 FROM chunks""",
    "read_chunks_semijoin": f"""WITH {CHUNKS_SQL}, {FILES_SQL} SELECT c.file_id, chunk_index, coalesce(filename, 'unknown') AS filename, content FROM chunks c
        LEFT JOIN files f ON c.file_id = f.file_id AND f.file_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1) WHERE c.file_id IN (SELECT doc_id FROM labels)""",
    "upload_upsert": f"""WITH {FILES_SQL}, u AS (SELECT DISTINCT concat('doc-', item_id, CASE item_id % 2 WHEN 0 THEN '.pdf' ELSE '.new' END) AS filename FROM benchmark)
        SELECT file_id, filename, CASE WHEN u.filename IS NULL THEN chunk_count ELSE 0 END AS chunk_count, CASE WHEN u.filename IS NULL THEN status ELSE 'uploaded' END AS status FROM files LEFT JOIN u USING (filename)
        UNION ALL SELECT (SELECT max(file_id) FROM files) + row_number() OVER (ORDER BY filename), filename, 0, 'uploaded' FROM u ANTI JOIN files USING (filename)""",
    "delete_cascade": f"WITH {CHUNKS_SQL} SELECT file_id, count(*) AS n FROM chunks WHERE file_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1) GROUP BY file_id",
    "next_id": f"WITH {FILES_SQL} SELECT source, max(file_id) + 1 AS next_file_id, count(*) AS n FROM files GROUP BY source",
    "kb_listing": "SELECT 'kb-' || n_nationkey AS id, coalesce(r_name, 'Knowledge Base ' || n_nationkey) AS name, n_nationkey::BIGINT AS kb_id FROM nation LEFT JOIN region ON n_nationkey = r_regionkey",
    "catalog_ingest": """SELECT 'regions.xlsx' AS filename, 0 AS chunk_index, '[Table] regions' || chr(10) || '[Sheet] regions' || chr(10) || '| key | name |' || chr(10) || '| --- | --- |' || chr(10)
        || string_agg('| ' || r_regionkey || ' | ' || r_name || ' |', chr(10) ORDER BY r_regionkey) AS content, 16 AS dim FROM region""",
    "catalog_bulk_ingest": """WITH f AS (SELECT 'customer-' || o_custkey || '.xlsx' AS filename, 'customer-' || o_custkey AS stem, string_agg('| ' || o_orderkey || ' | ' || o_orderstatus || ' | ' || o_orderpriority || ' |', chr(10) ORDER BY o_orderkey) AS body
          FROM orders GROUP BY o_custkey)
        SELECT row_number() OVER (ORDER BY filename) AS file_id, filename, 0 AS chunk_index, '[Table] ' || stem || chr(10) || '[Sheet] orders' || chr(10) || '| key | status | priority |' || chr(10) || '| --- | --- | --- |' || chr(10) || body AS content,
          1 AS chunk_count, 'done' AS status, (SELECT count(*) + 1 FROM f) AS next_id FROM f""",
    "catalog_roundtrip": "SELECT doc_id::INT AS chunk_index, length(text)::INT AS n, (SELECT count(*) FROM documents)::INT AS chunk_count, 'done' AS status FROM documents",
}
