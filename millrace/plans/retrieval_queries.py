"""Keyword, vector and hybrid retrieval over the chunks of `documents` and the rows of `embeddings`."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import text as T
from millrace.operators import catalog as C
from millrace.operators import keyword as K
from millrace.operators import keyword_index as KI
from millrace.operators import retrieval as R
from millrace.operators import vector_index as VI
from millrace.operators import vectors as V
from millrace.operators.chunking import split_fixed
from millrace.plans.chunk_queries import CHUNKS_SQL, chunks
from millrace.sources import shared
from millrace.sources import tables as S

QUERY = "Released under the MIT License"
TERMS = ["Released", "under", "the", "MIT", "License"]
#: A query vector by a rule: alternating signs over 64 places.
VECTOR = [((i % 7) - 3) / 10 for i in range(64)]


def vowels(texts: list[str]) -> np.ndarray:
    """An embedder that SQL can state as well: how often each vowel stands in a text."""
    return np.array([[t.count(c) for c in "aeiou"] for t in texts], float)


EMBEDDER = vowels


def keyword_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.table(spark, sf_dir, "benchmark").select("item_id", F.array_join(K.query_terms(F.col("text")), " ").alias("terms"))


def keyword_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.table(spark, sf_dir, "documents").select("doc_id", K.keyword_score(F.coalesce("text", F.lit("")), QUERY).alias("score"))


def keyword_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.keyword_search(chunks(spark, sf_dir), QUERY, 5).select("rank", "file_id", "chunk_index", "score")


def keyword_index_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """keyword_topk through the index over all chunks."""
    every = shared.saved(chunks(spark, sf_dir), "chunks")
    return KI.search(KI.KeywordIndex.build(every), every, QUERY, 5).hits.select("rank", "file_id", "chunk_index", "score")


def catalog_keyword_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keyword search in the collections of two languages, by the index that the catalog keeps with its chunks."""
    catalog = C.Catalog(spark, S.shared_path(spark, "catalog"), indexed=True)
    docs = S.table(spark, sf_dir, "documents").select("doc_id", "lang")
    texts = S.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("file_id"), "lang", "text")
    every = shared.saved(split_fixed(texts, ["file_id", "lang"]), "chunks")
    ids = []
    for lang in ("en", "de"):
        ids.append(kb := catalog.create_kb(lang))
        name = F.concat(F.lit("doc-"), F.lpad(F.col("doc_id").cast("string"), 12, "0"), F.lit(".pdf"))
        catalog.save_uploads(kb, docs.where(F.col("lang") == lang).select(name.alias("filename"), F.lit(None).cast("binary").alias("content")))
        files = catalog.files(kb).select("file_id", F.regexp_extract("filename", r"\d+", 0).cast("long").alias("doc_id"))
        own = every.where(F.col("lang") == lang).withColumnRenamed("file_id", "doc_id").join(files, "doc_id")
        catalog.save_all(kb, own.select("file_id", "chunk_index", "content"))
    found = catalog.keyword_search(ids, QUERY, 5)
    named = catalog.files(ids[0]).union(catalog.files(ids[1])).select("kb_id", "file_id", F.regexp_extract("filename", r"\d+", 0).cast("long").alias("doc_id"))
    return found.join(named, ["kb_id", "file_id"]).select("kb_id", "rank", "doc_id", "chunk_index", "score")


def knn_single(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.nearest(S.table(spark, sf_dir, "embeddings"), VECTOR, 5)


def knn_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = S.table(spark, sf_dir, "embeddings")
    return V.nearest_each(rows.where("vec_id % 50 = 0"), rows, 5)


def knn_by_label_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = S.table(spark, sf_dir, "embeddings")
    return V.nearest_each(rows.where("vec_id % 50 = 0"), rows, 3, within="label")


def knn_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """knn_batch through cells that most queries skip."""
    rows = S.table(spark, sf_dir, "embeddings")
    return VI.nearest_each(rows.where("vec_id % 50 = 0"), VI.build(rows), 5).rows


def _embedded_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every chunk, made and saved once, with one of the table's vectors, dealt by its numbers."""
    vectors = S.table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    dealt = (F.col("file_id") * 7 + F.col("chunk_index")) % F.lit(vectors.count())
    made = shared.saved(chunks(spark, sf_dir).withColumn("vec_id", dealt), "chunks")
    return made.join(vectors, "vec_id", "left").drop("vec_id")


def hybrid_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.hybrid_search(_embedded_chunks(spark, sf_dir), QUERY, VECTOR).select("position", "source", "file_id", "chunk_index", "score", "preview")


def by_length(content: pd.Series) -> pd.Series:
    """A deterministic scorer in the place of a model: shorter chunks first."""
    return -content.str.len().astype(float)


def rerank_function(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = R.hybrid_search(_embedded_chunks(spark, sf_dir), QUERY, VECTOR, scorer=by_length)
    return found.select("position", "source", "file_id", "chunk_index", "rerank_score")


def _all_embedded(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, list[float]]:
    """Every chunk with its vector, made and saved once, and the query's by the same embedder."""
    return shared.saved(V.embed(chunks(spark, sf_dir), EMBEDDER), "chunks"), EMBEDDER([QUERY])[0].tolist()


def hybrid_search_embedded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hybrid search whose semantic half sees all chunks."""
    rows, vector = _all_embedded(spark, sf_dir)
    return R.hybrid_search(rows, QUERY, vector).select("position", "source", "file_id", "chunk_index", "score", "preview")


def rerank_function_embedded(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, vector = _all_embedded(spark, sf_dir)
    found = R.hybrid_search(rows, QUERY, vector, scorer=by_length)
    return found.select("position", "source", "file_id", "chunk_index", "rerank_score")


def multi_kb_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = S.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("file_id"), F.lit(0).alias("chunk_index"), F.col("text").alias("content"), "source")
    return R.search_each(docs, QUERY, "source", 5).select("source", "rank", "file_id", "score")


def multi_kb_hybrid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hybrid search in the collection of every source, over all chunks."""
    sources = S.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("file_id"), F.coalesce("source", F.lit("")).alias("kb"))
    found = R.hybrid_each(_embedded_chunks(spark, sf_dir).join(sources, "file_id"), QUERY, VECTOR, "kb")
    return found.select("kb", "position", "source", "file_id", "chunk_index", "score")


def chunk_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of all chunks by an embedder that counts vowels, with their checked dimension."""
    made = V.checked_dimension(V.embed(chunks(spark, sf_dir), vowels), 5)
    return made.select("file_id", "chunk_index", F.size("embedding").alias("dim"), *[F.round(F.get("embedding", i), 6).alias(f"v{i}") for i in range(5)])


QUERIES = {f.__name__: f for f in (keyword_tokens, keyword_score, keyword_topk, keyword_index_topk, catalog_keyword_search, knn_single, knn_batch, knn_by_label_filter, knn_cells, hybrid_search, rerank_function, hybrid_search_embedded, rerank_function_embedded, multi_kb_search, multi_kb_hybrid, chunk_embeddings)}


def _score(text: str) -> str:
    count = lambda t: f"least(3, (length(lower({text})) - length(replace(lower({text}), lower('{t}'), ''))) / {len(t)})"
    return " + ".join(map(count, TERMS)) + f" + CASE WHEN contains(lower({text}), lower('{QUERY}')) THEN 5 ELSE 0 END"


_V = "[" + ", ".join(f"{x}::DOUBLE" for x in VECTOR) + "]"
_KNN = """WITH e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings),
 p AS (SELECT q.vec_id AS query_id, e.vec_id, round(list_cosine_similarity(q.v, e.v), 6) AS score FROM e q JOIN e ON q.vec_id <> e.vec_id {on} WHERE q.vec_id % 50 = 0)
 SELECT query_id, rank::INT AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM p) WHERE rank <= {k}"""
_HYBRID = f"""WITH {CHUNKS_SQL},
 sem AS (SELECT file_id, chunk_index, content, round(list_cosine_similarity(embedding::DOUBLE[], {_V}), 6) AS score FROM chunks JOIN embeddings ON vec_id = (file_id * 7 + chunk_index) % (SELECT count(*) FROM embeddings)),
 s AS (SELECT *, row_number() OVER (ORDER BY score DESC, file_id, chunk_index) AS rank FROM sem QUALIFY rank <= 5),
 w AS (SELECT file_id, chunk_index, content, ({_score('content')})::DOUBLE AS score FROM chunks ANTI JOIN s USING (file_id, chunk_index)),
 k AS (SELECT *, row_number() OVER (ORDER BY score DESC, length(content), file_id DESC, chunk_index DESC) AS rank FROM w WHERE score > 0 QUALIFY rank <= 5),
 u AS (SELECT 'semantic' AS source, 0 AS sr, * FROM s UNION ALL SELECT 'keyword', 1, * FROM k)"""
_VOWELS = "[length({0}) - length(replace({0}, c, '')) for c in ['a', 'e', 'i', 'o', 'u']]::DOUBLE[]"
#: The same over vectors made of the chunks themselves; a chunk without vowels has a vector without length.
_EMBEDDED = f"""WITH {CHUNKS_SQL},
 sem AS (SELECT file_id, chunk_index, content, round(CASE WHEN list_sum(v) > 0 THEN list_cosine_similarity(v, q) ELSE 0 END, 6) AS score FROM (SELECT *, {_VOWELS.format('content')} AS v, {_VOWELS.format(f"'{QUERY}'")} AS q FROM chunks)),
{_HYBRID[_HYBRID.index(" s AS"):]}"""
_FIRST = """ SELECT row_number() OVER (ORDER BY sr, rank)::INT AS position, source, file_id, chunk_index, score,
        CASE WHEN length(content) > 200 THEN substr(content, 1, 200) || '...' ELSE content END AS preview FROM u QUALIFY position <= 8"""
_RERANKED = " SELECT row_number() OVER (ORDER BY length(content), sr, rank)::INT AS position, source, file_id, chunk_index, -length(content)::DOUBLE AS rerank_score FROM u QUALIFY position <= 8"
ORACLES = {
    "hybrid_search_embedded": _EMBEDDED + _FIRST,
    "rerank_function_embedded": _EMBEDDED + _RERANKED,
    "keyword_tokens": """SELECT item_id, (SELECT coalesce(string_agg(t, ' ' ORDER BY i), '') FROM (SELECT t, min(i) AS i FROM (SELECT unnest(x) AS t, generate_subscripts(x, 1) AS i
        FROM (SELECT regexp_extract_all(b.text, '[A-Za-z0-9_]+|[一-鿿]+') AS x)) WHERE NOT regexp_full_match(t, '[A-Za-z0-9_]') GROUP BY t)) AS terms FROM benchmark b""",
    "keyword_score": f"SELECT doc_id, ({_score('text')})::DOUBLE AS score FROM documents",
    "keyword_topk": f"""WITH {CHUNKS_SQL}, x AS (SELECT file_id, chunk_index, content, ({_score('content')})::DOUBLE AS score FROM chunks)
        SELECT row_number() OVER (ORDER BY score DESC, length(content), file_id DESC, chunk_index DESC)::INT AS rank, file_id, chunk_index, score FROM x WHERE score > 0 QUALIFY rank <= 5""",
    "catalog_keyword_search": f"""WITH {CHUNKS_SQL}, x AS (SELECT CASE lang WHEN 'en' THEN 1 ELSE 2 END AS kb_id, file_id, chunk_index, content, ({_score('content')})::DOUBLE AS score FROM chunks JOIN documents ON doc_id = file_id WHERE lang IN ('en', 'de'))
        SELECT kb_id::BIGINT AS kb_id, row_number() OVER (PARTITION BY kb_id ORDER BY score DESC, length(content), file_id DESC, chunk_index DESC)::INT AS rank, file_id AS doc_id, chunk_index, score FROM x WHERE score > 0 QUALIFY rank <= 5""",
    "knn_single": f"""SELECT row_number() OVER (ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score
        FROM (SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], {_V}), 6) AS score FROM embeddings) QUALIFY rank <= 5""",
    "knn_batch": _KNN.format(on="", k=5),
    "knn_by_label_filter": _KNN.format(on="AND q.label = e.label", k=3),
    "hybrid_search": _HYBRID + _FIRST,
    "rerank_function": _HYBRID + _RERANKED,
    "multi_kb_search": f"""WITH x AS (SELECT source, doc_id AS file_id, text, ({_score('text')})::DOUBLE AS score FROM documents)
        SELECT source, row_number() OVER (PARTITION BY source ORDER BY score DESC, length(text), file_id DESC)::INT AS rank, file_id, score FROM x WHERE score > 0 QUALIFY rank <= 5""",
    "multi_kb_hybrid": f"""WITH {CHUNKS_SQL}, e AS (SELECT c.*, coalesce(source, '') AS kb, embedding FROM chunks c JOIN documents ON file_id = doc_id
          JOIN embeddings ON vec_id = (file_id * 7 + chunk_index) % (SELECT count(*) FROM embeddings)),
        s AS (SELECT kb, file_id, chunk_index, round(list_cosine_similarity(embedding::DOUBLE[], {_V}), 6) AS score FROM e),
        t AS (SELECT *, row_number() OVER (PARTITION BY kb ORDER BY score DESC, file_id, chunk_index) AS rank FROM s QUALIFY rank <= 5),
        w AS (SELECT kb, file_id, chunk_index, content, ({_score('content')})::DOUBLE AS score FROM e ANTI JOIN t USING (kb, file_id, chunk_index)),
        k AS (SELECT *, row_number() OVER (PARTITION BY kb ORDER BY score DESC, length(content), file_id DESC, chunk_index DESC) AS rank FROM w WHERE score > 0 QUALIFY rank <= 5),
        u AS (SELECT 'semantic' AS source, 0 AS sr, kb, file_id, chunk_index, score, rank FROM t UNION ALL SELECT 'keyword', 1, kb, file_id, chunk_index, score, rank FROM k)
        SELECT kb, row_number() OVER (PARTITION BY kb ORDER BY sr, rank)::INT AS position, source, file_id, chunk_index, score FROM u QUALIFY position <= 8""",
    "chunk_embeddings": f"""WITH {CHUNKS_SQL}, n AS (SELECT *, [length(content) - length(replace(content, c, '')) for c in ['a', 'e', 'i', 'o', 'u']]::DOUBLE[] AS v FROM chunks),
        l AS (SELECT *, sqrt(list_sum([x * x for x in v])) AS size FROM n)
        SELECT file_id, chunk_index, 5 AS dim, {', '.join(f'round(v[{i + 1}] / CASE WHEN size > 0 THEN size ELSE 1 END, 6) AS v{i}' for i in range(5))} FROM l""",
}
ORACLES["keyword_index_topk"] = ORACLES["keyword_topk"]
ORACLES["knn_cells"] = ORACLES["knn_batch"]
