"""What the training-data operators share: reading `documents`, shared folders, sized joins, whole-text slices."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.sources.shared import delete, new_path, register, release, saved, scratch, shared_dir, unscoped

__all__ = ["delete", "new_path", "register", "release", "saved", "scratch", "shared_dir", "unscoped"]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A word between ASCII blanks, as the contracts of several operators define it.
BLANK_WORD = r"[^\x20\x09-\x0D]+"
#: Rows of one key from which a salted join splits the key.
HOT_ROWS = 1024
#: Rows up to which a keyed side is broadcast (checked by a count); beyond it the join shuffles.
BROADCAST_ROWS = 1_000_000
#: Bytes of one Arrow batch, where the session has left Spark's default.
BATCH_BYTES, DEFAULT_BATCH_BYTES = "8m", "67108864b"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def maybe_broadcast(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Marks a narrow saved table for broadcast only if its counted rows stay within the limit."""
    return F.broadcast(df) if df.count() <= limit else df


def salted_join(left: DataFrame, right: DataFrame, on: list[str], by: str, n: str, how: str = "inner") -> DataFrame:
    """Inner or left join with a saved `right` that has one row a key and counts the key's rows of `left` in column n.
    A key with many rows is dealt by a hash of column `by` over as many copies of its right row. At most BROADCAST_ROWS
    keys are split, whatever the sizes: no more can hold that share of all rows."""
    totals = right.agg(F.sum(n).alias("rows"), F.max(n).alias("most")).first()
    hot = max(HOT_ROWS, (totals["rows"] or 0) // BROADCAST_ROWS)
    if (totals["most"] or 0) <= hot:
        return left.join(right.drop(n), on, how)
    salts = F.ceil(F.col(n) / hot).cast("int")
    split = F.broadcast(right.where(F.col(n) > hot).select(*on, salts.alias("_salts")))
    dealt = left.join(split, on, "left").withColumn("_salt", F.pmod(F.xxhash64(by), F.coalesce("_salts", F.lit(1))).cast("int")).drop("_salts")
    copies = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.when(F.col(n) > hot, salts - 1).otherwise(0)))).drop(n)
    return dealt.join(copies, [*on, "_salt"], how).drop("_salt")


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of at most BATCH_BYTES, so that a task needs little memory on both sides; the setting stays."""
    setting = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(setting) == DEFAULT_BATCH_BYTES:
        spark.conf.set(setting, BATCH_BYTES)


def map_batches(df: DataFrame, make: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """mapInArrow with small batches; a worker gives back what it no longer uses when a task ends."""
    small_batches(df.sparkSession)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from make(batches)
        pa.default_memory_pool().release_unused()

    return df.mapInArrow(work, schema)


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value evaluated once: the argument of a lambda is a local name."""
    return F.get(F.transform(F.array(value), use), 0)


def scan(items: Column, begin: Column, step: Callable[[Column, Column], tuple[Column, Column]], kind: str, block: int = 256) -> Column:
    """What a pass over an array makes of its items, with a state: step(state, item) gives the next state and an array of
    `kind`, and those are joined. Outputs grow in blocks, as an array that grew with every item would be copied each time."""
    pair = lambda state, out: F.struct(state.alias("state"), out.alias("out"))
    none, nothing = F.array().cast(f"array<{kind}>"), F.array().cast(f"array<array<{kind}>>")

    def one(acc: Column, item: Column) -> Column:
        state, made = step(acc["state"], item)
        return pair(state, F.concat(acc["out"], made))

    def whole(items: Column) -> Column:
        def next_block(acc: Column, b: Column) -> Column:
            own = F.aggregate(F.slice(items, b * block + 1, F.lit(block)), pair(acc["state"], none), one)
            return once(own, lambda own: pair(own["state"], F.concat(acc["out"], F.array(own["out"]))))

        blocks = F.sequence(F.lit(0), F.floor(F.size(items) / block).cast("int"))
        return F.flatten(F.aggregate(blocks, pair(begin, nothing), next_block)["out"])

    return once(items, whole)


class Cut:
    """Parts of a text by code points, each in the time of its own length: the text is cut into blocks once."""

    SIZE = 4096

    def __init__(self, blocks: Column):
        self.blocks = blocks

    @staticmethod
    def of(text: Column, use: Callable[[Cut], Column]) -> Column:
        return once(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{Cut.SIZE}}}"), F.lit(0)), lambda blocks: use(Cut(blocks)))

    def part(self, begin: Column, end: Column) -> Column:
        first, last = F.floor(begin / self.SIZE).cast("int"), F.floor(end / self.SIZE).cast("int")
        joined = F.array_join(F.slice(self.blocks, first + 1, last - first + 1), "")
        return F.substring(joined, (begin % self.SIZE + 1).cast("int"), F.greatest(end - begin, F.lit(0)).cast("int"))


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def words_of(text: Column, pattern: str = BLANK_WORD) -> Column:
    """Array of the words of a text; null counts as the empty text."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(pattern), F.lit(0))


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(BLANK_WORD)).cast("long")


def text_slices(texts: Iterator[str], size: int) -> Iterator[list[str]]:
    """Groups texts into lists of about `size` characters, so that a batch of long texts stays small in memory."""
    held, n = [], 0
    for text in texts:
        held.append(text)
        n += len(text)
        if n >= size:
            yield held
            held, n = [], 0
    if held:
        yield held
