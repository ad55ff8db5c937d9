"""Vector codes by product quantisation, each part assigned through a vantage-point tree of its codebook.

A vector's components x become integers floor(scale * x); the vector is cut into equal consecutive parts, and each part
position has a codebook that starts as that part of the vectors with the smallest ids. A round assigns every part to
its nearest entry (squared Euclidean distance, ties to the lower index) and moves each entry to the mean of its parts,
rounded down; the last assignment gives the codes.

The nearest entry is found by branch and bound in a tree over the entries: each node holds one entry (the vantage point)
and two halves of the rest, with the range of their distances from it. Those ranges are widened by more than any
rounding, a half is left out only if its lower bound is strictly above the best distance so far, and every distance
that decides is an exact integer. All parts of a block of vectors go down the tree together.

Each task adds up its own parts, so a round sends at most entries x dimension sums from a task, and the driver holds the
codebooks alone, whose size does not depend on the rows.

Rows whose vector is null, empty or holds null or non-finite components are dropped, also those of another dimension
than the vector with the smallest id. Rows without id are coded, but start no codebook; of rows with equal ids the smaller
vector comes first. Repeated rows get equal codes; with fewer vectors than entries there are fewer entries; an empty table
gives an empty result. A dimension that the parts don't divide, or a component of 2^24 / scale or more in size, is
an error. Other columns of the input are not carried.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import common

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Vectors that go down the trees together.
BLOCK = 1 << 15
#: Entries that are compared without a further vantage point.
LEAF = 6
#: Sums of squares over up to 2^13 components of differences below 2 * LARGEST stay below 2^63.
LARGEST = 1 << 24
#: Relative widening of distance ranges: far above the rounding of a square root of a 64-bit integer.
WIDEN = 1e-9


@dataclass
class Node:
    """An entry and, by their distances from it, the nearer and the farther half of the other entries; or a leaf."""

    entries: np.ndarray
    split: float = 0.0
    halves: tuple[tuple[float, float, Node], ...] = ()


def squared(points: np.ndarray, entry: np.ndarray) -> np.ndarray:
    difference = points - entry
    return np.einsum("...i,...i->...", difference, difference)


def tree(book: np.ndarray, entries: np.ndarray | None = None) -> Node:
    """The vantage-point tree over the entries of one codebook."""
    entries = np.arange(len(book)) if entries is None else entries
    if len(entries) <= LEAF:
        return Node(entries)
    # an entry at the rim sees the others at more different distances
    vantage = entries[np.argmax(((book[entries] - book[entries].mean(axis=0)) ** 2).sum(axis=1))]
    rest = entries[entries != vantage]
    far = np.sqrt(squared(book[rest], book[vantage]).astype(float))
    order = np.argsort(far, kind="stable")
    rest, far = rest[order], far[order]
    middle = len(rest) // 2
    halves = tuple((far[i] * (1 - WIDEN), far[j - 1] * (1 + WIDEN), tree(book, np.sort(rest[i:j]))) for i, j in ((0, middle), (middle, len(rest))))
    return Node(np.array([vantage]), float(far[middle]), halves)


def nearest(node: Node, book: np.ndarray, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index of the nearest entry, its squared distance) of every point; equal distances to the lower index."""
    best, code = np.full(len(points), np.iinfo(np.int64).max), np.full(len(points), len(book))

    def visit(node: Node, due: np.ndarray) -> None:
        held = points[due]
        for entry in node.entries.tolist():
            d = squared(held, book[entry])
            better = (d < best[due]) | ((d == best[due]) & (entry < code[due]))
            best[due[better]], code[due[better]] = d[better], entry
        if not node.halves:
            return
        distance = np.sqrt(d.astype(float))
        near = distance < node.split
        for halves, some in ((node.halves, near), (node.halves[::-1], ~near)):
            for low, high, child in halves:
                own, at = due[some], distance[some]
                bound = np.maximum(low - at * (1 + WIDEN), at * (1 - WIDEN) - high)
                if len(open_ := own[bound <= np.sqrt(best[own].astype(float)) * (1 + WIDEN)]):
                    visit(child, open_)

    if len(points):
        visit(node, np.arange(len(points)))
    return code, best


def _matrices(batches: Iterator[pa.RecordBatch], dim: int, scale: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Blocks of rows with their integer vectors; the vectors are the last column."""
    for batch in batches:
        for i in range(0, batch.num_rows, BLOCK):
            block = batch.slice(i, BLOCK)
            vectors = np.floor(block.column(block.num_columns - 1).flatten().to_numpy(zero_copy_only=False).astype(float) * scale)
            if len(vectors) and np.abs(vectors).max() >= LARGEST:
                raise ValueError(f"a component times {scale} must be below {LARGEST} in size")
            yield block, vectors.astype(np.int64).reshape(-1, dim)


def _parts(vectors: np.ndarray, books: np.ndarray, trees: list[Node]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    width = books.shape[2]
    for p, node in enumerate(trees):
        held = np.ascontiguousarray(vectors[:, p * width : (p + 1) * width])
        yield p, held, *nearest(node, books[p], held)


def _summing(books: np.ndarray, scale: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Sums of a task's parts by part, entry and position, with their counts."""
    parts, entries, width = books.shape

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees, sums, counts = [tree(b) for b in books], np.zeros(books.shape, np.int64), np.zeros((parts, entries), np.int64)
        for _, vectors in _matrices(batches, parts * width, scale):
            for p, held, code, _ in _parts(vectors, books, trees):
                np.add.at(sums[p], code, held)
                counts[p] += np.bincount(code, minlength=entries)
        places = np.nonzero(np.repeat(counts[:, :, None], width, axis=2))
        columns = [*[pa.array(x.astype(np.int32)) for x in places], pa.array(counts[places[:2]]), pa.array(sums[places])]
        yield pa.RecordBatch.from_arrays(columns, ["part", "entry", "place", "n", "total"])

    return work


def _coding(books: np.ndarray, scale: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Codes and errors of a task's rows (vec_id, label, vector)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = [tree(b) for b in books]
        for block, vectors in _matrices(batches, books.shape[0] * books.shape[2], scale):
            codes, error = np.zeros((len(vectors), len(books)), np.uint8), np.zeros(len(vectors), np.int64)
            for p, _, code, distance in _parts(vectors, books, trees):
                codes[:, p] = code
                error += distance
            texts = pa.array([row.tobytes().hex() for row in codes], pa.string())
            yield pa.RecordBatch.from_arrays([block.column(0), block.column(1), texts, pa.array(error)], ["vec_id", "label", "code", "error"])

    return work


@dataclass
class Codebooks:
    """Integer entries by part, entry and position, and the scale of the components."""

    entries: np.ndarray
    scale: int = SCALE

    @property
    def sha256(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.reshape(-1).tolist())).encode()).hexdigest()


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, label, v) of the rows with a whole vector of finite components."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "label", F.col("embedding").alias("v"))
    return rows.where(F.coalesce(F.size("v"), F.lit(0)) > 0).where(F.forall("v", finite))


def train(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> Codebooks | None:
    """Codebooks from all usable rows; None if there are none with an id."""
    rows = usable(vectors)
    named = rows.where("vec_id is not null").orderBy("vec_id", "v")
    if (one := named.first()) is None:
        return None
    if (dim := len(one["v"])) % parts:
        raise ValueError(f"vectors of {dim} components can't be cut into {parts} equal parts")
    if not 0 < entries <= 256:
        raise ValueError("a code of two hexadecimal digits names at most 256 entries")
    start = np.floor(np.array([r["v"] for r in named.where(F.size("v") == dim).limit(entries).collect()], float) * scale)
    if np.abs(start).max() >= LARGEST:
        raise ValueError(f"a component times {scale} must be below {LARGEST} in size")
    books = np.ascontiguousarray(start.astype(np.int64).reshape(len(start), parts, -1).transpose(1, 0, 2))
    rows = rows.where(F.size("v") == dim).select("v")
    for _ in range(rounds):
        sums = common.map_batches(rows, _summing(books, scale), "part int, entry int, place int, n long, total long")
        # at most one row for each component of the codebooks
        for r in sums.groupBy("part", "entry", "place").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).collect():
            books[r["part"], r["entry"], r["place"]] = r["total"] // r["n"]
    return Codebooks(books, scale)


def encode(vectors: DataFrame, books: Codebooks) -> DataFrame:
    """vec_id, label, code (an entry's index in two hexadecimal digits for each part) and error of every usable row."""
    rows, dim = usable(vectors), books.entries.shape[0] * books.entries.shape[2]
    label = dict(rows.dtypes)["label"]
    return common.map_batches(rows.where(F.size("v") == dim), _coding(books.entries, books.scale), f"vec_id long, label {label}, code string, error long")


def decode(codes: pa.Array, books: Codebooks) -> np.ndarray:
    """The vectors that the codes stand for, in the units of the input: the middles of their entries' integer cells."""
    n = books.entries.shape[0]
    indexes = np.frombuffer(bytes.fromhex("".join(codes.to_pylist())), np.uint8).reshape(-1, n)
    return (books.entries[np.arange(n), indexes].reshape(len(indexes), -1) + 0.5) / books.scale


def label_errors(coded: DataFrame) -> DataFrame:
    """Adds label_error, the error summed over equal labels; nulls are one label. A label that many rows share is joined
    in salted parts."""
    rows = coded.withColumns({"_named": F.col("label").isNotNull(), "_label": F.coalesce(F.col("label").cast("string"), F.lit(""))})
    totals = rows.groupBy("_named", "_label").agg(F.sum("error").alias("label_error"), F.count("*").alias("_n"))
    return common.salted_join(rows, common.saved(totals, "label-errors"), ["_named", "_label"], "vec_id", "_n").drop("_named", "_label")


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    books = train(vectors)
    if books is None:
        books = Codebooks(np.zeros((PARTS, 0, 1), np.int64))
        vectors = vectors.where("false")
    coded = common.saved(encode(vectors, books), "vector-codes")
    return label_errors(coded).select("vec_id", "code", "error", "label_error", F.lit(books.sha256).alias("codebooks_sha256"))


def _sql() -> str:
    """The rounds as joins of all parts with all entries of their position."""

    def nearest_of(book: str) -> str:
        distance = "list_sum(list_transform(list_zip(x.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT"
        return f"""(SELECT r, p, e, d FROM (SELECT x.r, x.p, b.e, {distance} AS d FROM part x JOIN {book} b USING (p))
  QUALIFY row_number() OVER (PARTITION BY r, p ORDER BY d, e) = 1)"""

    rounds = "".join(
        f""",
near{i} AS MATERIALIZED {nearest_of(f"book{i}")},
mean{i} AS (SELECT p, e, list(m ORDER BY i) AS v FROM (SELECT p, e, i, floor(sum(x) / count(*))::BIGINT AS m
  FROM (SELECT p, e, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM near{i} JOIN part USING (r, p)) GROUP BY p, e, i) GROUP BY p, e),
book{i + 1} AS MATERIALIZED (SELECT p, e, coalesce(m.v, b.v) AS v FROM book{i} b LEFT JOIN mean{i} m USING (p, e))"""
        for i in range(ROUNDS)
    )
    return f"""
WITH kept AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, label, list_transform(embedding, lambda x: floor(x::DOUBLE * {SCALE})::BIGINT) AS v FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
one AS MATERIALIZED (SELECT * FROM kept WHERE len(v) = (SELECT len(v) FROM kept WHERE vec_id IS NOT NULL ORDER BY vec_id, v LIMIT 1)),
part AS MATERIALIZED (SELECT r, p, v[p * len(v) // {PARTS} + 1 : (p + 1) * len(v) // {PARTS}] AS v FROM one, range({PARTS}) t(p)),
book0 AS MATERIALIZED (SELECT p, e, v FROM part JOIN (SELECT r, row_number() OVER (ORDER BY vec_id, v) - 1 AS e FROM one WHERE vec_id IS NOT NULL QUALIFY e < {ENTRIES}) USING (r)){rounds},
last AS MATERIALIZED {nearest_of(f"book{ROUNDS}")},
coded AS (SELECT r, string_agg(printf('%02x', e), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM last GROUP BY r),
books AS (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM book{ROUNDS})
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, codebooks_sha256 FROM coded JOIN one USING (r), books
"""


ORACLE = _sql()
