"""Lexical retrieval packing: training sequences of related documents.

Texts are encoded once. Every full window of a long document is a sequence of its own; what remains, less than one
window, is dealt to shards. A shard holds a BM25 inverted index of its documents, with frequencies and lengths over all
ids of all documents: the longest remainder left seeds a sequence, the lists of all terms of the seed's document give its
best unused neighbours, which follow whole, the last one is cut where the window ends, and its rest seeds the next
sequence. So only the last sequence of a shard is padded.

Neighbours are searched in the seed's shard only. So that they meet there, a tree of splits, found on a sample of SAMPLE
projected BM25 vectors, parts documents into leaves of lexically similar ones, and the signs of their places around its
mean order a leaf. A shard is a subtree or a range of a large leaf of about SHARD_TOKENS ids, however many there are;
only texts that no sign tells apart are parted by row. What lies in another shard is missed.

Null and empty texts hold the end id only; repeated rows are packed as often as they come; an empty table gives an
empty result; other columns of the input are not carried.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.llm import common, pieces

WINDOW, END_ID = 4096, 2
SHARD_TOKENS = 1 << 20
K1, B = 1.2, 0.75
#: Places of a projected document, and how many of their signs order a leaf; documents of the sample that the tree is
#: found on, its leaves, and the fewest sampled documents in a leaf.
PLACES, SIGNS, SAMPLE, LEAVES, LEAF_LEAST = 64, 16, 1 << 14, 256, 8
#: The share of listed documents that must be unused; below it the lists are made shorter.
STALE = 0.7
PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def _crc(ids: np.ndarray) -> int:
    return zlib.crc32(np.ascontiguousarray(ids, "<u4"))


def distinct(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """np.unique with counts, at a third of its time: 32-bit numbers are sorted four times as fast as 16-bit ones."""
    ids = np.sort(ids.astype(np.uint32))
    first = np.ones(len(ids), bool)
    np.not_equal(ids[1:], ids[:-1], out=first[1:])
    at = np.flatnonzero(first)
    return ids[at], np.append(at[1:], len(ids))[: len(at)] - at


def remainders(docs: DataFrame, tokenizer_path: str, window: int = WINDOW, end_id: int = END_ID) -> DataFrame:
    """doc_id, doc_tokens, the checksums of full windows, and the ids of the rest as little-endian bytes; for documents
    with a full window also the distinct ids of the whole document and their counts, which the rest does not tell."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = pieces.encoder(tokenizer_path)
        end = np.array([end_id], encoder.dtype)
        for batch in batches:
            at = 0
            for texts in pieces.slices(batch.column(1)):
                all_ids, offsets = encoder.encode(texts)
                tokens, windows, rests, terms, counts = [], [], [], [], []
                for i in range(len(texts)):
                    ids = np.append(all_ids[offsets[i] : offsets[i + 1]], end)
                    full = len(ids) // window
                    tokens.append(len(ids))
                    windows.append([_crc(ids[w * window : (w + 1) * window]) for w in range(full)])
                    stored = "<u4" if encoder.dtype.itemsize > 2 else "<u2"
                    rests.append(ids[full * window :].astype(stored).tobytes())
                    term, count = distinct(ids) if full else (None, None)
                    terms.append(term.astype(stored).tobytes() if full else None)
                    counts.append(count.astype("<u4").tobytes() if full else None)
                columns = [batch.column(0).slice(at, len(texts)), pa.array(tokens, pa.int64()), pa.array(windows, pa.list_(pa.int64()))]
                columns += [pa.array(x, pa.binary()) for x in (rests, terms, counts)]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "doc_tokens", "windows", "rest", "terms", "counts"])
                at += len(texts)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return common.map_batches(rows, encode, "doc_id long, doc_tokens long, windows array<long>, rest binary, terms binary, counts binary")


def term_counts(rest: bytes, terms: bytes | None, counts: bytes | None, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct ids of a whole document and their counts."""
    if terms is None:
        return distinct(np.frombuffer(rest, f"<u{width}"))
    return np.frombuffer(terms, f"<u{width}"), np.frombuffer(counts, "<u4")


def term_frequencies(rests: DataFrame, vocabulary_size: int, width: int) -> np.ndarray:
    """How many documents hold each id, in a full window or the rest. Bounded by the vocabulary, whatever the input."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(vocabulary_size, np.int64)
        for batch in batches:
            for rest, terms in zip(batch.column(0), batch.column(1)):
                total[np.frombuffer((terms if terms.is_valid else rest).as_buffer(), f"<u{width}")] += 1  # a repeated id adds 1
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(total[held])], ["term", "n"])

    found = common.map_batches(rests.select("rest", "terms"), count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toPandas()
    frequency = np.zeros(vocabulary_size, np.int64)
    frequency[found["term"].to_numpy(np.int64)] = found["n"].to_numpy(np.int64)
    return frequency


def bm25(idf: np.ndarray, term: np.ndarray, count: np.ndarray, length: np.ndarray, average: float) -> np.ndarray:
    norm = K1 * (1 - B + B * length / max(average, 1e-9))
    return (idf[term] * count * (K1 + 1) / (count + norm)).astype(np.float32)


class Index:
    """BM25 inverted index of one shard: for each term the documents that hold it, with their weights. `counts` holds the
    terms and counts of the whole documents where `ids` are what remains of them."""

    def __init__(self, ids: list[np.ndarray], idf: np.ndarray, average: float, counts: list[tuple[np.ndarray, np.ndarray]] | None = None):
        self.lengths = np.array([len(x) for x in ids], np.int64)
        counts = [distinct(x) for x in ids] if counts is None else counts
        sizes = np.array([len(t) for t, _ in counts], np.int64)
        doc = np.repeat(np.arange(len(ids), dtype=np.int32), sizes)
        term = np.concatenate([t for t, _ in counts] or [np.zeros(0)]).astype(np.int64)
        count = np.concatenate([c for _, c in counts] or [np.zeros(0)]).astype(np.int64)
        whole = np.bincount(doc, count, len(ids))
        weight = bm25(idf, term, count, whole[doc], average)
        #: The terms of each document, as numbers of this shard's terms: its query.
        held = np.bincount(term)
        self.terms = np.flatnonzero(held)
        numbered = (np.cumsum(held > 0) - 1)[term].astype(np.min_scalar_type(len(self.terms)))
        self.query_terms, self.query_bounds = numbered, np.append(0, np.cumsum(sizes))
        order = np.argsort(numbered, kind="stable")
        # in the types that bincount reads, so that no search converts its lists
        self.posting_doc, self.posting_weight = doc[order].astype(np.intp), weight[order].astype(np.float64)
        self.posting_bounds = np.append(0, np.cumsum(held[self.terms]))

    def keep(self, docs: np.ndarray) -> None:
        """From now on only these documents are found: the lists lose the postings of all others."""
        held = docs[self.posting_doc]
        self.posting_bounds = np.append(0, np.cumsum(held))[self.posting_bounds]
        self.posting_doc, self.posting_weight = self.posting_doc[held], self.posting_weight[held]

    def scores(self, seed: int) -> np.ndarray:
        """Scores of all documents by the terms of one: its terms' lists are read, no others."""
        asked = self.query_terms[self.query_bounds[seed] : self.query_bounds[seed + 1]]
        starts, sizes = self.posting_bounds[asked], self.posting_bounds[asked + 1] - self.posting_bounds[asked]
        ends = np.cumsum(sizes)
        at = np.repeat(starts - (ends - sizes), sizes)
        at += np.arange(len(at))
        return np.bincount(self.posting_doc[at], self.posting_weight[at], len(self.lengths))


class Tree:
    """Splits of projected BM25 vectors, found on a sample, into leaves of lexically similar documents; within a leaf the
    signs of a document's first places around the leaf's mean."""

    def __init__(self, vectors: np.ndarray, leaves: int = LEAVES):
        self.direction, self.threshold, self.child, self.center = [], [], [], []
        self._grow(vectors, leaves)
        self.direction, self.threshold = np.array(self.direction), np.array(self.threshold, np.float32)
        self.child, self.center = np.array(self.child), np.array(self.center, np.float32)

    def _grow(self, x: np.ndarray, leaves: int) -> int:
        """Adds the node of these vectors and those below it."""
        node = len(self.child)
        for values, none in ((self.direction, np.zeros(PLACES, np.float32)), (self.threshold, 0.0), (self.child, [-1, -1]), (self.center, x.mean(0) if len(x) else np.zeros(PLACES))):
            values.append(none)
        if split := self._split(x) if leaves > 1 and len(x) >= 2 * LEAF_LEAST else None:
            self.direction[node], self.threshold[node], right = split
            share = min(max(1, round(leaves * right.mean())), leaves - 1)
            self.child[node] = [self._grow(x[~right], leaves - share), self._grow(x[right], share)]
        return node

    @staticmethod
    def _split(x: np.ndarray) -> tuple[np.ndarray, float, np.ndarray] | None:
        """Direction between two means, and the place on it that parts what is nearer to either."""
        a = x[np.argmax(((x - x.mean(0)) ** 2).sum(1))]
        b = x[np.argmax(((x - a) ** 2).sum(1))]
        for _ in range(8):
            near = x @ (b - a) > (b @ b - a @ a) / 2
            if near.all() or not near.any():
                break
            a, b = x[~near].mean(0), x[near].mean(0)
        direction, threshold = (b - a).astype(np.float32), np.float32((b @ b - a @ a) / 2)
        right = (x * direction).sum(1) > threshold
        return (direction, threshold, right) if right.any() and not right.all() else None

    def place(self, x: np.ndarray) -> np.ndarray:
        """The leaf of documents, then SIGNS signs."""
        node = np.zeros(len(x), np.int64)
        while (inner := np.flatnonzero(self.child[node, 0] >= 0)).size:
            n = node[inner]
            node[inner] = self.child[n, ((x[inner] * self.direction[n]).sum(1) > self.threshold[n]).astype(int)]
        signs = (x > self.center[node])[:, :SIGNS] @ (1 << np.arange(SIGNS - 1, -1, -1, dtype=np.int64))
        return node << SIGNS | signs

    def groups(self, ids: dict[int, int], shard_tokens: int) -> dict[int, tuple[int, int, int]]:
        """For each leaf its group, how many shards that has, and its ids; ids: of each leaf. The largest subtrees that
        round to one shard are groups, else leaves."""
        out: dict[int, tuple[int, int, int]] = {}

        def leaves(node: int) -> list[int]:
            return [int(node)] if self.child[node, 0] < 0 else [*leaves(self.child[node, 0]), *leaves(self.child[node, 1])]

        def visit(node: int) -> None:
            below = leaves(node)
            total = sum(ids.get(x, 0) for x in below)
            shards = max(1, round(total / shard_tokens))
            if shards == 1 or len(below) == 1:
                out.update({x: (node, shards, total) for x in below})
            else:
                visit(self.child[node, 0])
                visit(self.child[node, 1])

        visit(0)
        return out


def projected(counts: list[tuple[np.ndarray, np.ndarray]], idf: np.ndarray, average: float, places: np.ndarray) -> np.ndarray:
    """Unit vectors of documents: their BM25 weights by random signs."""
    out = np.zeros((len(counts), PLACES), np.float32)
    for row, (term, count) in zip(out, counts):
        row[:] = bm25(idf, term, count, count.sum(), average) @ places[term]
    size = np.linalg.norm(out, axis=1, keepdims=True)
    return np.divide(out, size, out=out, where=size > 0)


def placed(rests: DataFrame, idf: np.ndarray, average: float, width: int, n: int) -> tuple[DataFrame, Tree]:
    """The rests with their leaf, the signs in it and their ids; and the tree."""

    def vectors(rest: pd.Series, terms: pd.Series, counts: pd.Series, signs: np.ndarray) -> np.ndarray:
        return projected([term_counts(*x, width) for x in zip(rest, terms, counts)], idf, average, signs)

    def signs() -> np.ndarray:
        return np.random.default_rng(0).integers(0, 2, (len(idf), PLACES), np.int8).astype(np.float32) * 2 - 1

    @F.pandas_udf("binary")
    def vector(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        s = signs()
        for rest, terms, counts in batches:
            yield pd.Series([x.tobytes() for x in vectors(rest, terms, counts, s)], index=rest.index, dtype=object)

    chosen = rests.where(F.pmod(F.xxhash64("row"), F.lit(max(1, n // SAMPLE))) == 0)
    sample = chosen.select("row", vector("rest", "terms", "counts").alias("v")).toPandas().sort_values("row")
    tree = Tree(np.frombuffer(b"".join(sample["v"]), np.float32).reshape(-1, PLACES))

    @F.pandas_udf("long")
    def place(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        s = signs()
        for rest, terms, counts in batches:
            yield pd.Series(tree.place(vectors(rest, terms, counts, s)), index=rest.index)

    made = rests.withColumn("place", place("rest", "terms", "counts"))
    return made.withColumns({"leaf": F.shiftright("place", SIGNS), "ids": (F.octet_length("rest") / width).cast("long")}), tree


def sharded(rests: DataFrame, idf: np.ndarray, average: float, width: int, n: int, shard_tokens: int) -> DataFrame:
    """The rests with the number of their shard: a group of leaves, or a range of a large leaf's signs of about
    shard_tokens ids. The ids before a range are summed over counts by place, of which a leaf has at most 2^SIGNS; what
    no sign tells apart and is still larger is parted by row, into the shards that its ids reach over."""
    rows, tree = placed(rests, idf, average, width, n)
    rows = common.saved(rows, "pack-placed", lasting=True)
    counts = common.saved(rows.groupBy("leaf", "place").agg(F.sum("ids").alias("ids"), F.count("*").alias("n")), "pack-places")
    leaves = {r["leaf"]: r["ids"] for r in counts.groupBy("leaf").agg(F.sum("ids").alias("ids")).collect()}  # at most LEAVES rows
    groups, first, begins = tree.groups(leaves, shard_tokens), 0, {}
    for group, shards, _ in groups.values():
        if group not in begins:
            begins[group], first = first, first + shards
    named = [(leaf, begins[group], shards, total) for leaf, (group, shards, total) in groups.items()]
    named = rests.sparkSession.createDataFrame(named, "leaf long, first long, shards long, total long")
    before = F.coalesce(F.sum("ids").over(Window.partitionBy("leaf").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    at = F.when(F.col("shards") == 1, 0).otherwise(F.floor(before * F.col("shards") / F.col("total")))
    parts = F.when(F.col("shards") == 1, 1).otherwise(F.greatest(F.round(F.col("ids") / shard_tokens), F.lit(1)))
    dealt = counts.join(F.broadcast(named), "leaf").select("place", "n", "first", "shards", at.cast("long").alias("at"), parts.cast("long").alias("parts"))
    dealt, rows = common.saved(dealt, "pack-dealt", lasting=True), rows.drop("leaf", "ids")
    if dealt.count() <= common.BROADCAST_ROWS:
        found = rows.join(F.broadcast(dealt.drop("n")), "place")
    else:
        found = common.salted_join(rows, dealt, ["place"], "row", "n")
    part = F.pmod(F.xxhash64("row", F.lit(1)), F.col("parts"))
    number = F.col("first") + F.least(F.col("at") + part, F.col("shards") - 1)
    return found.withColumn("number", number).drop("place", "first", "shards", "at", "parts")


def pack_shard(ids: list[np.ndarray], index: Index, window: int) -> Iterator[tuple[int, int, int, int, int]]:
    """(document, begin, length, sequence, offset) of every piece of a shard's remainders."""
    unused = index.lengths > 0
    index.keep(unused)
    left = listed = int(unused.sum())
    order, at = np.argsort(-index.lengths, kind="stable"), 0
    sequence = used = 0
    carried: tuple[int, int] | None = None  # a document cut at the end of the last sequence, and where
    while True:
        if carried is None:
            while at < len(order) and not unused[order[at]]:
                at += 1
            if at == len(order):
                return
            seed, begin = int(order[at]), 0
            unused[seed] = False
            left -= 1
        else:
            seed, begin = carried
            carried = None
        length = int(index.lengths[seed]) - begin
        yield seed, begin, length, sequence, 0
        used = length
        if left < listed * STALE:
            index.keep(unused)
            listed = left
        found = index.scores(seed) if used < window and left else None
        while used < window and left:
            scores = np.where(unused, found, -1.0)
            # enough neighbours to fill the window, best first
            few = min(len(scores), 64)
            best = np.argpartition(-scores, few - 1)[:few]
            for d in best[np.lexsort((best, -scores[best]))].tolist():
                if used == window or not unused[d]:
                    break
                length = min(int(index.lengths[d]), window - used)
                yield d, 0, length, sequence, used
                unused[d] = False
                left -= 1
                used += length
                if length < index.lengths[d]:
                    carried = (d, length)
        sequence += 1


def pack(docs: DataFrame, tokenizer_path: str, window: int = WINDOW, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """One row a piece: doc_id, start, length, checksum, the document's tokens, its sequence and the offset there."""
    v = pieces.vocabulary(tokenizer_path)
    width = 2 if v.size <= 1 << 16 else 4
    rests = common.saved(remainders(docs, tokenizer_path, window).withColumn("row", F.monotonically_increasing_id()), "pack-rests", lasting=True)
    totals = rests.agg(F.count("*").alias("n"), F.sum(F.octet_length("rest") / width).alias("ids"), F.avg("doc_tokens").alias("average")).first()
    n, total = totals["n"], int(totals["ids"] or 0)
    frequency = term_frequencies(rests, v.size, width)
    idf = np.log1p((n - frequency + 0.5) / (frequency + 0.5)).astype(np.float32)
    average = totals["average"] or 0.0
    if total > shard_tokens:
        rows = sharded(rests, idf, average, width, n, shard_tokens)
    else:
        rows = rests.withColumn("number", F.lit(0).cast("long"))

    def shard(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("row", kind="stable")
        number = int(frame["number"].iloc[0])
        ids = [np.frombuffer(x, f"<u{width}") for x in frame["rest"]]
        doc_ids = [None if none else d for d, none in zip(frame["doc_id"].tolist(), frame["no_id"])]
        tokens, windows = frame["doc_tokens"].tolist(), frame["windows"].tolist()
        out, base, sequence = [], number << 40, 0
        for doc_id, n_tokens, checks in zip(doc_ids, tokens, windows):
            for w, check in enumerate(checks):
                out.append((doc_id, w * window, window, int(check), n_tokens, base + sequence, 0))
                sequence += 1
        counts = [term_counts(*x, width) for x in zip(frame["rest"], frame["terms"], frame["counts"])]
        for d, begin, length, s, offset in pack_shard(ids, Index(ids, idf, average, counts), window):
            start = tokens[d] - len(ids[d]) + begin
            out.append((doc_ids[d], start, length, _crc(ids[d][begin : begin + length]), tokens[d], base + sequence + s, offset))
        columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
        return pd.DataFrame({c: pd.array(list(values), "Int64") for c, values in zip(columns, zip(*out))})

    # a column with nulls would reach pandas as floats
    rows = rows.withColumns({"doc_id": F.coalesce("doc_id", F.lit(0)), "no_id": F.col("doc_id").isNull()})
    return rows.groupBy("number").applyInPandas(shard, PIECE)


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(common.documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))
