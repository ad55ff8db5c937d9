"""Vector operators: normalising, cosine similarity, exact nearest neighbours, and a vector table's rules.

One query is a scan with a bounded sort. Many queries are compared in blocks: a row of the block tables holds up to
BLOCK vectors, so the product of all queries and all vectors is a matrix product a task, and only the best `k` of each
pair of blocks go on to the per-query ranking.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 2048
#: Bytes of query vectors up to which their blocks are broadcast to the tasks that hold vectors.
QUERY_BYTES = 64 << 20


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def l2_normalize(v: Column) -> Column:
    """Unit length; a zero vector stays as it is."""
    n = norm(v)
    return F.when(n > 0, F.transform(v, lambda x: x.cast("double") / n)).otherwise(F.transform(v, lambda x: x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """0 where either vector has no length."""
    return F.coalesce(F.try_divide(dot(a, b), norm(a) * norm(b)), F.lit(0.0))


def nearest(vectors: DataFrame, query: list[float], k: int = 5, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """rank, key, score of the k most similar rows; equal scores by key. A zero query has no neighbour."""
    if not any(query):
        return vectors.select(F.lit(0).alias("rank"), key, F.lit(0.0).alias("score")).where("false")
    score = F.round(cosine(F.col(column), F.array(*[F.lit(float(x)) for x in query])), 6)
    best = vectors.select(key, score.alias("score")).orderBy(F.desc("score"), key).limit(k)
    return best.select(F.row_number().over(Window.orderBy(F.desc("score"), key)).alias("rank"), key, "score")


def _blocks(vectors: DataFrame, key: str, column: str, group: Column) -> DataFrame:
    """One row for up to BLOCK vectors of a partition: their keys, groups and unit vectors as bytes."""

    def pack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for i in range(0, len(frame), BLOCK):
                part = frame.iloc[i : i + BLOCK]
                m = np.stack(part["v"].to_numpy()).astype("<f8")
                size = np.linalg.norm(m, axis=1, keepdims=True)
                m = np.divide(m, size, out=np.zeros_like(m), where=size > 0)
                yield pd.DataFrame({"keys": [part["k"].to_numpy("<i8").tobytes()], "groups": [list(part["g"])], "m": [m.tobytes()], "dim": [m.shape[1]]})

    rows = vectors.where(F.col(column).isNotNull() & F.col(key).isNotNull()).select(F.col(key).cast("long").alias("k"), group.cast("string").alias("g"), F.col(column).alias("v"))
    return rows.mapInPandas(pack, "keys binary, groups array<string>, m binary, dim int")


def nearest_each(queries: DataFrame, vectors: DataFrame, k: int = 5, key: str = "vec_id", column: str = "embedding", within: str | None = None) -> DataFrame:
    """query_id, rank, key and score of the k most similar other rows of every query; `within` names a column that
    both sides must share."""
    group = F.col(within) if within else F.lit("")
    q = _blocks(queries, key, column, group).select(F.monotonically_increasing_id().alias("qb"), F.col("keys").alias("q_keys"), F.col("groups").alias("q_groups"), F.col("m").alias("q_m"))
    v = _blocks(vectors, key, column, group)

    def compare(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.itertuples():
                qk, vk = np.frombuffer(row.q_keys, "<i8"), np.frombuffer(row.keys, "<i8")
                a, b = np.frombuffer(row.q_m, "<f8").reshape(len(qk), -1), np.frombuffer(row.m, "<f8").reshape(len(vk), -1)
                s = np.round(a @ b.T, 6)
                s[(qk[:, None] == vk[None]) | (np.array(row.q_groups, object)[:, None] != np.array(row.groups, object)[None])] = -np.inf
                few = min(k, len(vk))
                # all that reach the k-th score of their row, so that ties are decided by key; only those are sorted
                at, of = np.nonzero((s >= -np.partition(-s, few - 1, axis=1)[:, few - 1 : few]) & np.isfinite(s))
                order = np.lexsort((vk[of], -s[at, of], at))
                at, of = at[order], of[order]
                best = np.arange(len(at)) - np.searchsorted(at, at) < few
                yield pd.DataFrame({"query_id": qk[at[best]], key: vk[of[best]], "score": s[at[best], of[best]] + 0.0})

    # a stated query set against all rows, in blocks: each pair is one matrix product
    size = queries.agg(F.sum(F.coalesce(F.size(column), F.lit(0))).alias("n")).first()["n"] or 0
    pairs = v.crossJoin(F.broadcast(q) if 8 * size <= QUERY_BYTES else q)
    made = pairs.select("keys", "groups", "m", "q_keys", "q_groups", "q_m").mapInPandas(compare, f"query_id long, {key} long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), key))
    return made.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", key, "score")


def embed(texts: DataFrame, embedder: Callable[[list[str]], np.ndarray], text: str = "content", out: str = "embedding") -> DataFrame:
    """Adds unit vectors of non-blank texts; a batch of rows is one call of the embedder."""

    @F.pandas_udf("array<double>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            made: list = [None] * len(batch)
            due = [i for i, t in enumerate(batch) if t is not None and t.strip()]
            for i, v in zip(due, np.asarray(embedder([batch.iloc[i] for i in due]), float) if due else []):
                size = np.linalg.norm(v)
                made[i] = (v / size if size > 0 else v).tolist()
            yield pd.Series(made, index=batch.index)

    return texts.withColumn(out, run(F.col(text)))


class HashEmbedder:
    """A deterministic embedder that needs no model: signed hashes of words, counted into `dim` places."""

    def __init__(self, dim: int = 64):
        self.dim = dim

    def __call__(self, texts: list[str]) -> np.ndarray:
        import zlib

        out = np.zeros((len(texts), self.dim))
        for row, text in zip(out, texts):
            for word in text.lower().split():
                h = zlib.crc32(word.encode())
                row[h % self.dim] += 1 if h >> 31 else -1
        return out


def checked_dimension(vectors: DataFrame, dim: int, column: str = "embedding") -> DataFrame:
    """Fails at run time if a vector has another dimension; checked before anything is written."""
    return vectors.where(F.when(F.size(column) == dim, True).otherwise(F.raise_error(F.lit(f"vectors must have {dim} dimensions")).cast("boolean")))


def matching(file_id: int | None = None, chunk_index: int | None = None, filename: str | None = None) -> Column:
    """The filter of a vector delete: given fields must be equal; without any, every row matches."""
    condition = F.lit(True)
    for name, value in (("file_id", file_id), ("chunk_index", chunk_index), ("filename", filename)):
        if value is not None:
            condition = condition & F.col(name).eqNullSafe(F.lit(value))
    return condition
