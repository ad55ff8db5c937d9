"""Exact nearest neighbours through cells: vectors in cells with a centre and a radius, most of which a query never reads.

The centres are found on a bounded sample; every vector then goes to the cell of its nearest centre, and a cell knows the
angle of its farthest vector (its radius) and how many it has. By the triangle inequality of angles no vector of a cell is
nearer to a query than the angle to the centre less the radius. A query first reads the cells nearest to it that together
hold k others; its k-th best angle there bounds all others: cells whose least possible angle is above it are skipped, the
rest are read. Bounds are widened by more than any rounding, so the result is that of reading every cell, ties included.

Cells hold blocks of at most BLOCK vectors, so a large cell is many rows, and a pair of a query block and a cell's block is
one matrix product whose result is k rows a query.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from millrace.sources import shared

#: Vectors of the sample that centres are found on, rounds of finding them, vectors a block, and the widening of angles.
SAMPLE, ROUNDS, BLOCK, WIDEN = 1 << 14, 4, 2048, 1e-6
#: Most cells: their centres are sent to every task, CELLS x dimension x 8 bytes.
CELLS = 1024


def unit(rows: pd.Series) -> np.ndarray:
    """Unit vectors as a matrix; a zero vector stays zero."""
    m = np.stack(rows.to_numpy()).astype("<f8")
    size = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, size, out=np.zeros_like(m), where=size > 0)


def angles(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(a @ b.T, -1.0, 1.0))


@dataclass
class VectorIndex:
    """The centres, and the saved tables: blocks (cell, block, keys, groups, ms) and cells (cell, radius, n)."""

    centres: np.ndarray
    blocks: DataFrame
    cells: DataFrame


def build(vectors: DataFrame, key: str = "vec_id", column: str = "embedding", within: str | None = None, cells: int | None = None) -> VectorIndex | None:
    """The index over all rows with a key and a vector; None if there are none. `within` names a column that neighbours
    must share. Vectors have one dimension."""
    rows = vectors.where(F.col(key).isNotNull() & F.col(column).isNotNull()).select(F.col(key).cast("long").alias("k"), (F.col(within).cast("string") if within else F.lit("")).alias("g"), F.col(column).alias("v"))
    n = rows.count()
    if not n:
        return None
    # every n/SAMPLE-th row by a hash of its key
    sample = rows.where(F.pmod(F.xxhash64("k"), F.lit(max(1, n // SAMPLE))) == 0).select("k", "v").limit(2 * SAMPLE).toPandas().sort_values("k")
    points = unit(sample["v"] if len(sample) else pd.Series([rows.first()["v"]]))
    centres = points[np.linspace(0, len(points) - 1, min(cells or min(CELLS, max(1, int(n**0.5))), len(points))).astype(int)]
    for _ in range(ROUNDS):
        near = (points @ centres.T).argmax(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, points)
        size = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(size > 0, sums / np.where(size > 0, size, 1), centres)

    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for i in range(0, len(frame), 1 << 14):
                part = frame.iloc[i : i + (1 << 14)]
                m = unit(part["v"])
                cosine = m @ centres.T
                cell = cosine.argmax(1)
                angle = np.arccos(np.clip(cosine[np.arange(len(part)), cell], -1.0, 1.0))
                yield pd.DataFrame({"cell": cell.astype("int32"), "k": part["k"].to_numpy(), "g": part["g"].to_numpy(), "m": [x.tobytes() for x in m], "angle": angle})

    placed = shared.saved(rows.mapInPandas(place, "cell int, k long, g string, m binary, angle double"), "vector-cells")
    counts = placed.groupBy("cell").agg(F.max("angle").alias("radius"), F.count("*").alias("n"))
    sized = shared.saved(counts, "vector-radii")
    block = F.pmod(F.xxhash64("k"), F.ceil(F.col("n") / BLOCK)).cast("int")
    dealt = placed.join(F.broadcast(sized.select("cell", "n")), "cell").withColumn("block", block)
    packed = dealt.groupBy("cell", "block").agg(F.collect_list(F.struct("k", "g", "m")).alias("held"))
    packed = packed.select("cell", "block", F.col("held.k").alias("keys"), F.col("held.g").alias("groups"), F.col("held.m").alias("ms"))
    return VectorIndex(centres, shared.saved(packed, "vector-blocks"), sized)


def _matrix(ms: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(ms), "<f8").reshape(len(ms), -1)


def _best(pairs: DataFrame, k: int) -> DataFrame:
    """query_id, key and score of the k best other vectors of every pair of a query block and a block."""

    def compare(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.itertuples():
                qk, vk = np.asarray(row.q_keys, np.int64), np.asarray(row.keys, np.int64)
                s = np.round(_matrix(row.q_ms) @ _matrix(row.ms).T, 6)
                s[(qk[:, None] == vk[None]) | (np.asarray(row.q_groups, object)[:, None] != np.asarray(row.groups, object)[None])] = -np.inf
                few = min(k, len(vk))
                # all that reach the k-th score of their row, so that ties are decided by key
                least = -np.partition(-s, few - 1, axis=1)[:, few - 1 : few]
                at, of = np.nonzero((s >= least) & np.isfinite(s))
                order = np.lexsort((vk[of], -s[at, of], at))
                at, of = at[order], of[order]
                rank = np.arange(len(at)) - np.searchsorted(at, at)
                at, of = at[rank < few], of[rank < few]
                yield pd.DataFrame({"query_id": qk[at], "key": vk[of], "score": s[at, of] + 0.0})

    return pairs.select("q_keys", "q_groups", "q_ms", "keys", "groups", "ms").mapInPandas(compare, "query_id long, key long, score double")


def _top(found: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "key"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


@dataclass
class Neighbours:
    """query_id, rank, key and score of the neighbours; how many pairs of a query and a cell were read, of how many."""

    rows: DataFrame
    read: int
    pairs: int


def nearest_each(queries: DataFrame, index: VectorIndex, k: int = 5, key: str = "vec_id", column: str = "embedding", within: str | None = None) -> Neighbours:
    """The k most similar other rows of every query, exactly; equal scores by key."""
    rows = queries.where(F.col(key).isNotNull() & F.col(column).isNotNull()).select(F.col(key).cast("long").alias("k"), (F.col(within).cast("string") if within else F.lit("")).alias("g"), F.col(column).alias("v"))
    centres = index.centres
    facts = index.cells.orderBy("cell").toPandas()  # at most CELLS rows
    radius, counts = np.full(len(centres), -np.inf), np.zeros(len(centres), np.int64)
    radius[facts["cell"]], counts[facts["cell"]] = facts["radius"], facts["n"]

    filled = np.flatnonzero(counts > 0)

    def route(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Every query (k, g, v) with the cells to read at once, the nearest that hold k others together; a query that comes
        with its worst angle, with those of the other cells that may hold a nearer vector."""
        for frame in frames:
            for i in range(0, len(frame), 1 << 12):
                part = frame.iloc[i : i + (1 << 12)]
                m = unit(part["v"])
                to = angles(m, centres[filled])
                order = np.argsort(to, axis=1, kind="stable")
                first = np.minimum((np.cumsum(counts[filled][order], axis=1) <= k).sum(1) + 1, len(filled))
                at = np.argsort(order, axis=1) < first[:, None]
                if "worst" in part:
                    at = ~at & (to - radius[filled][None] - WIDEN <= part["worst"].to_numpy()[:, None])
                query, cell = np.nonzero(at)
                yield pd.DataFrame({"k": part["k"].to_numpy()[query], "g": part["g"].to_numpy()[query], "m": [m[j].tobytes() for j in query], "cell": filled[cell].astype("int32")})

    routed = "k long, g string, m binary, cell int"
    with shared.scratch(queries.sparkSession):

        def read(due: DataFrame) -> DataFrame:
            """The best of every query in its cells: queries of a cell in blocks, each with each block of the cell."""
            sizes = due.groupBy("cell").agg(F.count("*").alias("_n"))
            part = F.pmod(F.xxhash64("k"), F.ceil(F.col("_n") / BLOCK)).cast("int")
            held = due.join(F.broadcast(sizes), "cell").groupBy("cell", part.alias("part")).agg(F.collect_list(F.struct("k", "g", "m")).alias("q"))
            asked = held.select("cell", F.col("q.k").alias("q_keys"), F.col("q.g").alias("q_groups"), F.col("q.m").alias("q_ms"))
            numbered = index.cells.select("cell", F.explode(F.sequence(F.lit(0), F.ceil(F.col("n") / BLOCK).cast("int") - 1)).alias("block"))
            # merged: a query's vector comes once a cell, which compresses to a size that would pass for a small side's
            return _best(asked.join(F.broadcast(numbered), "cell").join(index.blocks.hint("merge"), ["cell", "block"]), k)

        first = shared.saved(rows.mapInPandas(route, routed), "vector-first")
        begun = shared.saved(_top(read(first), k), "vector-begun")
        # the k-th best score so far, rounded to six digits, as an angle; none where fewer were found
        bound = begun.groupBy("query_id").agg(F.min("score").alias("s"), F.count("*").alias("n")).where(F.col("n") >= k)
        worst = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("s") - 1e-6))) + WIDEN
        bounded = rows.join(bound.select(F.col("query_id").alias("k"), worst.alias("worst")), "k", "left").withColumn("worst", F.coalesce("worst", F.lit(4.0)))
        rest = shared.saved(bounded.mapInPandas(route, routed), "vector-rest")
        found = _top(begun.drop("rank").unionByName(read(rest)), k)
        made = shared.saved(found.select("query_id", "rank", F.col("key").alias(key), "score"), "neighbours", lasting=True)
        return Neighbours(made, first.count() + rest.count(), rows.count() * len(filled))
