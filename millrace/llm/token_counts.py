"""Token counts by byte-pair merging with a heap and a linked list.

The lowest-ranked adjacent pair is popped and merged again and again; the count of a pre-token is its initial symbols
minus its merges. No token id is ever made.

Null and empty texts count 0 tokens and 0 bytes; rows repeat as they come; very long texts are taken in slices that
end where no pre-token does; an empty table gives an empty result; other columns of the input are not carried.
"""

from __future__ import annotations

import functools
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import common, pieces

SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"
MAX_TOKENS = 2048
#: Heap entries are rank * SHIFT + position: the lowest rank first, then the leftmost pair.
SHIFT = 1 << 32


class MergeCounter(pieces.ByUnit):
    def __init__(self, path: str):
        super().__init__(path, self._piece, lambda _: 1, sum)
        model = self.vocabulary.spec["model"]
        self.ranks = {tuple(m if isinstance(m, list) else m.split(" ")): r for r, m in enumerate(model["merges"])}
        self.known = model["vocab"]

    def _piece(self, piece: str) -> int:
        parts = list(pieces.symbols(piece))
        parts[-1] += self.vocabulary.suffix
        return self.count([p for p in parts if p in self.known])

    def count(self, parts: list[str]) -> int:
        """Symbols that are left once no adjacent pair has a rank."""
        n, find = len(parts), self.ranks.get
        if n < 2:
            return n
        rank = [find((parts[i], parts[i + 1]), -1) for i in range(n - 1)]
        rank.append(-1)
        heap = [r * SHIFT + i for i, r in enumerate(rank) if r >= 0]
        heapq.heapify(heap)
        after, before, merges = list(range(1, n + 1)), list(range(-1, n - 1)), 0
        while heap:
            r, i = divmod(heapq.heappop(heap), SHIFT)
            if rank[i] != r:
                continue  # one side was merged away meanwhile
            j = after[i]
            k = after[i] = after[j]
            parts[i] += parts[j]
            rank[j] = -1
            merges += 1
            rank[i] = -1
            if k < n:
                before[k] = i
                if (r := find((parts[i], parts[k]), -1)) >= 0:
                    rank[i] = r
                    heapq.heappush(heap, r * SHIFT + i)
            if (h := before[i]) >= 0:
                rank[h] = r = find((parts[h], parts[i]), -1)
                if r >= 0:
                    heapq.heappush(heap, r * SHIFT + h)
        return n - merges

    def counts(self, texts: pa.StringArray) -> np.ndarray:
        if not len(texts):
            return np.zeros(0, np.int64)
        offsets, index, values = self.batch(texts)
        ends = np.concatenate([[0], np.cumsum(np.array(values, np.int64)[index])]) if len(index) else np.zeros(1, np.int64)
        return np.diff(ends[offsets])


@functools.lru_cache(maxsize=4)
def counter(path: str) -> MergeCounter:
    return MergeCounter(path)


def token_counts(docs: DataFrame, tokenizer_path: str, max_tokens: int = MAX_TOKENS) -> DataFrame:
    """doc_id, UTF-8 bytes, tokens and whether they exceed max_tokens, for every whole text."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = counter(tokenizer_path).counts
        for batch in batches:
            texts = batch.column(1)
            n = np.concatenate([counts(x) for x in pieces.slices(texts)] or [np.zeros(0, np.int64)])
            n_bytes = pc.cast(pc.binary_length(texts), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), n_bytes, pa.array(n), pa.array(n > max_tokens)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return common.map_batches(docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text")), count, SCHEMA)


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(common.documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))
