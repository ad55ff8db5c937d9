"""A persisted index for keyword search, equal to the scan of `keyword.keyword_search`.

A query term matches inside words. As a term is a run of word characters itself, each of its places lies within one
maximal run (word) of the text, so the places in a text are those in its words, times how often each word comes. The index
therefore holds the distinct words of blocks of chunks, each with the list of its chunks in the block and how often it
comes there (postings, in the order of words within a block). A block is some rows of one task, so an index is written
without a shuffle and a word of very many chunks is in many rows. A term's words are found by a scan of the words alone,
which are far smaller than the text; one pass finds those of all terms of a query and keeps their lists.

A term adds three points at most. Terms are read rarest first; once the k-th best score so far is above all that the
unread terms can add, chunks without a term read so far can't enter, and the lists of the other terms are read for the
candidates only. Contents are read for those chunks alone that hold all terms and could win by the whole phrase.

An index is a set of segments, one for each write; `Catalog` keeps one with every version of chunks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.operators import keyword
from millrace.sources import shared

KEY = ["file_id", "chunk_index"]
#: Words of a block at most, but for the last rows' own.
BLOCK = 2_000_000
POSTING = "word string, chunks int, hits array<struct<file_id:long,chunk_index:int,n:int,length:int>>"
#: Words are maximal runs of these bytes, or of the characters from 一 to 鿿, in a lower-cased text.
KINDS = np.array([chr(b) in "abcdefghijklmnopqrstuvwxyz0123456789_" for b in range(256)], np.uint8)


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of lower-cased texts in their order, and the row of each."""
    texts = texts.cast(pa.large_string())
    at = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[at[0] : at[-1]]
    at = at - at[0]
    kind = KINDS[data]
    lead = np.flatnonzero((data[:-2] >= 0xE4) & (data[:-2] <= 0xE9))
    code = ((data[lead] & 15).astype(np.int32) << 12) | ((data[lead + 1] & 63).astype(np.int32) << 6) | (data[lead + 2] & 63)
    lead = lead[(code >= 0x4E00) & (code <= 0x9FFF)]
    for i in range(3):
        kind[lead + i] = 2
    # a run ends where the kind of characters changes, and with its row
    first = np.ones(len(data), bool)
    first[1:] = kind[1:] != kind[:-1]
    first[at[:-1][at[:-1] < len(data)]] = True
    begin = np.flatnonzero(first)
    size, held = np.diff(begin, append=len(data)), kind[begin] > 0
    ends = np.concatenate([[0], np.cumsum(size[held])]).astype(np.int64)
    words = pa.LargeStringArray.from_buffers(len(ends) - 1, pa.py_buffer(ends), pa.py_buffer(data[kind > 0]))
    return words, np.searchsorted(at, begin[held], side="right") - 1


def _block(keys: pa.StructArray, words: list[pa.Array], rows: list[np.ndarray]) -> pa.RecordBatch:
    """The postings of one block of chunks: keys are structs of their keys and lengths."""
    coded = pa.chunked_array(words).combine_chunks().dictionary_encode()
    order = pc.sort_indices(coded.dictionary).to_numpy()
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    pairs, n = np.unique(rank[coded.indices.to_numpy()] * len(keys) + np.concatenate(rows), return_counts=True)
    word, row = pairs // len(keys), pairs % len(keys)
    starts = np.searchsorted(word, np.arange(len(order) + 1)).astype(np.int32)
    of = dict(zip(keys.type.names, keys.take(pa.array(row)).flatten(), strict=True))
    of = {**{c: v for c, v in of.items() if c != "length"}, "n": pa.array(n.astype(np.int32)), "length": of["length"]}
    hits = pa.ListArray.from_arrays(pa.array(starts), pa.StructArray.from_arrays(list(of.values()), list(of)))
    return pa.RecordBatch.from_arrays([coded.dictionary.take(pa.array(order)).cast(pa.string()), pa.array(np.diff(starts)), hits], ["word", "chunks", "hits"])


def _postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    keys, words, rows, chunks = [], [], [], 0
    for batch in batches:
        if not len(batch):
            continue
        found, row = words_of(batch.column("content"))
        names = [c for c in batch.schema.names if c != "content"]
        keys.append(pa.StructArray.from_arrays([batch.column(c) for c in names], names))
        words.append(found)
        rows.append(row + chunks)
        chunks += len(batch)
        if sum(map(len, words)) >= BLOCK:
            yield _block(pa.chunked_array(keys).combine_chunks(), words, rows)
            keys, words, rows, chunks = [], [], [], 0
    if sum(map(len, words)):
        yield _block(pa.chunked_array(keys).combine_chunks(), words, rows)


def postings(chunks: DataFrame, keys: list[str] = KEY) -> DataFrame:
    """word, the number of chunks of a block that hold it, and for each of these the keys, how often the word comes and
    the length of the content."""
    content = F.coalesce("content", F.lit(""))
    rows = chunks.select(*keys, F.length(content).alias("length"), F.lower(content).alias("content"))
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    hit = ",".join([*[f"`{c}`:{kinds[c]}" for c in keys], "n:int", "length:int"])
    return rows.mapInArrow(_postings, f"word string, chunks int, hits array<struct<{hit}>>")


@dataclass
class KeywordIndex:
    """Postings and the keys of their hits. `build` saves them; segments of a catalog come through `of`, with the keys of
    the files that are `live` where others may be in them."""

    postings: DataFrame
    keys: list[str] = field(default_factory=lambda: list(KEY))
    live: DataFrame | None = None

    @staticmethod
    def build(chunks: DataFrame, name: str = "keyword-index") -> KeywordIndex:
        return KeywordIndex(shared.saved(postings(chunks), name))

    @staticmethod
    def of(rows: DataFrame, keys: list[str] | None = None, live: DataFrame | None = None) -> KeywordIndex:
        inner = [c for c in rows.schema["hits"].dataType.elementType.names if c not in ("n", "length")]
        return KeywordIndex(rows, keys or inner, live)

    def matching(self, terms: list[str]) -> DataFrame:
        """The postings of every word that holds a term, once a term: with its number and its places in the word."""
        low = list(map(str.lower, terms))
        held = F.lit(False)
        for t in low:
            held = held | F.contains("word", F.lit(t))
        each = F.array(*[F.struct(F.lit(i).alias("term"), keyword.occurrences(F.col("word"), F.lit(t)).cast("int").alias("places")) for i, t in enumerate(low)])
        found = self.postings.where(held).withColumn("of", F.explode(each)).where("of.places > 0")
        return found.select(*self.postings.columns, "of.places", "of.term")


def _term_hits(index: KeywordIndex, lists: DataFrame, some: DataFrame | None = None) -> DataFrame:
    """The keys, length, points (three at most a term) and number of terms of every chunk that holds one, from the lists of
    matching words; of `some` chunks only where these are given."""
    outer = [c for c in lists.columns if c not in ("word", "chunks", "hits")]
    hits = lists.select(*outer, F.explode("hits").alias("hit")).select(*outer, "hit.*")
    for these in (index.live, some):
        if these is not None:
            hits = hits.join(these, these.columns, "left_semi")
    points = F.least(F.lit(float(keyword.MOST_A_TERM)), F.sum(F.col("n") * F.col("places")).cast("double"))
    each = hits.groupBy(*index.keys, "term").agg(F.max("length").alias("length"), points.alias("points"))
    return each.groupBy(*index.keys).agg(F.max("length").alias("length"), F.sum("points").alias("points"), F.count("*").alias("terms"))


def _with(hits: DataFrame | None, own: DataFrame, keys: list[str]) -> DataFrame:
    if hits is None:
        return own
    return hits.unionByName(own).groupBy(*keys).agg(F.max("length").alias("length"), F.sum("points").alias("points"), F.sum("terms").alias("terms"))


def _ranked(hits: DataFrame, k: int, by: list[str]) -> DataFrame:
    order = [F.desc("score"), "length", F.desc("file_id"), F.desc("chunk_index")]
    if by:
        return hits.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= k)
    return hits.orderBy(*order).limit(k).withColumn("rank", F.row_number().over(Window.orderBy(*order)))


@dataclass
class Found:
    """The hits of a search, and what it read: terms by their whole lists, and chunks whose content was compared."""

    hits: DataFrame
    whole_lists: list[str]
    compared: int


def search(index: KeywordIndex, chunks: DataFrame, query: str, k: int = 5, by: tuple[str, ...] = ()) -> Found:
    """The k best chunks (of each collection, where `by` names its column): the keys, score and rank, as the scan gives
    them. chunks: the keys and content; they are read for candidates only."""
    terms, keys = keyword.terms_of(query), index.keys
    if not terms:
        return Found(_empty(chunks, keys), [], 0)
    with shared.scratch(chunks.sparkSession):
        lists = shared.saved(index.matching(terms), "term-lists", by=["term"])
        sizes = {r["term"]: r["n"] for r in lists.groupBy("term").agg(F.sum("chunks").alias("n")).collect()}
        todo = sorted(sizes, key=lambda i: (sizes[i], terms[i]))
        if not todo:
            return Found(_empty(chunks, keys), [], 0)
        # a term without any word leaves no chunk that could hold the phrase
        phrase_possible, read, hits = len(todo) == len(terms), [], None
        if by:
            read, todo = [terms[i] for i in todo], []
            hits = shared.saved(_term_hits(index, lists), "term-hits")
        while todo:
            term = todo.pop(0)
            read.append(terms[term])
            hits = shared.saved(_with(hits, _term_hits(index, lists.where(F.col("term") == term)), keys), "term-hits")
            if todo and _least_of(hits, k) > keyword.MOST_A_TERM * len(todo):
                break
        if todo:
            # those that may still come among the best k, with what the other lists add to them
            most = F.col("points") + keyword.MOST_A_TERM * len(todo) + keyword.PHRASE_BONUS
            hits = shared.saved(hits.where(most >= _least_of(hits, k)), "candidates")
            own = _term_hits(index, lists.where(F.col("term").isin(todo)), _few(hits.select(*keys)))
            hits = shared.saved(_with(hits, own, keys), "candidates")
        whole = (F.col("terms") == len(terms)) & F.lit(phrase_possible)
        enough = F.col("points") + F.when(whole, keyword.PHRASE_BONUS).otherwise(0.0) >= F.col("_least")
        finalists = shared.saved(_with_least(hits, k, list(by)).where(enough).drop("_least"), "finalists")
        compared = shared.saved(finalists.where(whole).select(*keys), "compared")
        n = compared.count()
        phrase = chunks.join(_few(compared, n), keys).where(F.contains(F.lower("content"), F.lit(query.strip().lower()))).select(*keys, F.lit(keyword.PHRASE_BONUS).alias("bonus"))
        scored = finalists.join(phrase, keys, "left").withColumn("score", F.col("points") + F.coalesce("bonus", F.lit(0.0)))
        made = _ranked(scored, k, list(by)).select(*keys, "score", "rank")
        return Found(shared.saved(made, "keyword-hits", lasting=True), read, n)


def _least_of(hits: DataFrame, k: int) -> float:
    """The k-th best points, or less than any chunk's where there are fewer."""
    best = hits.orderBy(F.desc("points")).limit(k).agg(F.min("points"), F.count("*")).first()
    return best[0] if best[1] >= k else 0.0


def _with_least(hits: DataFrame, k: int, by: list[str]) -> DataFrame:
    """Hits with the k-th best points, of each collection where `by` names its column, as `_least`."""
    if not by:
        return hits.withColumn("_least", F.lit(_least_of(hits, k)))
    best = hits.select(*by, "points").withColumn("_at", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("points")))).where(F.col("_at") <= k)
    least = best.groupBy(*by).agg(F.when(F.count("*") >= k, F.min("points")).otherwise(0.0).alias("_least"))
    same = F.lit(True)
    for c in by:  # a collection may have no name
        least, same = least.withColumnRenamed(c, f"_{c}"), same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    return hits.join(least, same).drop(*[f"_{c}" for c in by])


def _few(keys: DataFrame, n: int | None = None) -> DataFrame:
    return F.broadcast(keys) if (keys.count() if n is None else n) <= 1_000_000 else keys


def _empty(chunks: DataFrame, keys: list[str]) -> DataFrame:
    return chunks.select(*keys, F.lit(0.0).alias("score"), F.lit(0).alias("rank")).where("false")
