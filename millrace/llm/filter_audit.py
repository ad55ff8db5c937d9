"""How filters interact: what each one removes in every order of applying them.

All orders of the filters form a trie; a node's state is what survived the filters above it, which does not depend on
their order. The trie is walked depth first over persisted survivor DataFrames: a state is made from its parent by
one filter, counted once (for every filter that may come next, the rows it removes there), remembered by its unordered
set of filters, and released when its branch is done. With five filters that is 32 states and 80 edges for 120 orders.
The counts of the edges then give every step of every order, and no row is counted twice.

Rows are narrow: one boolean a filter, the part and two marks. A state is persisted on disk and is remade from the saved
first one if an executor is lost; counts are written as they are made. At most as many states as there are filters
are persisted at a time. Texts are compared through 128-bit hashes.

The filters on documents fail short texts, repetitive texts, upper-case texts, texts with symbols and later copies
(FAILURES). A null text is empty, so it is short and like any other empty text a copy of the smallest doc_id that has one;
rows without doc_id neither are copies nor have any, and rows with one doc_id are no copies of each other. Of several
labels of a document the marks are joined by or. An empty table gives an empty result; other columns are not carried.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import common, pieces

LEAST_WORDS, LEAST_DISTINCT, MOST_UPPER = 200, 50, 2
SYMBOLS = "#$%&*|"
FAILURES = "ABCDE"
EDGE = "part string, seen int, filter int, n long, removed long, good long, toxic long"


def _measures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Failures A to D of texts (doc_id, part, text), and the two halves of their hash."""
    for batch in batches:
        at = 0
        for texts in pieces.slices(batch.column(2)):
            n = len(texts)
            units = pc.ascii_split_whitespace(texts)
            codes, ends = units.flatten().dictionary_encode(), units.offsets.to_numpy().astype(np.int64)
            filled = np.array([bool(w) for w in pieces.strings(codes.dictionary)] or [False], bool)
            index, owner = codes.indices.to_numpy().astype(np.int64), np.repeat(np.arange(n), np.diff(ends))
            real = filled[index]  # blanks at a text's ends leave empty units
            words = np.bincount(owner[real], minlength=n)
            pairs = np.unique(owner[real] * max(1, len(codes.dictionary)) + index[real])
            distinct = np.bincount(pairs // max(1, len(codes.dictionary)), minlength=n)
            raw, edges = np.frombuffer(texts.buffers()[2] or b"", np.uint8), np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + n + 1]
            upper = np.concatenate([[0], np.cumsum((raw[edges[0] : edges[-1]] >= 65) & (raw[edges[0] : edges[-1]] <= 90))])
            upper = np.diff(upper[edges - edges[0]])
            length = pc.utf8_length(texts).to_numpy()
            symbol = pc.match_substring_regex(texts, "[" + SYMBOLS + "]")
            digests = [xxhash.xxh3_128_intdigest(t) for t in texts.cast(pa.binary()).to_pylist()]
            halves = [pa.array([(d >> s & (1 << 64) - 1) - (1 << 63) for d in digests], pa.int64()) for s in (0, 64)]
            fails = [words < LEAST_WORDS, 100 * distinct < LEAST_DISTINCT * words, 100 * upper > MOST_UPPER * length]
            keys = [batch.column(i).slice(at, n) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([*keys, *halves, *map(pa.array, fails), symbol], ["doc_id", "part", "h0", "h1", *FAILURES[:4]])
            at += n


def failures(docs: DataFrame) -> DataFrame:
    """doc_id, part and a boolean for every filter of FAILURES: whether the row fails it."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("source", F.lit("")).alias("part"), F.coalesce("text", F.lit("")).alias("text"))
    made = common.saved(common.map_batches(rows, _measures, "doc_id long, part string, h0 long, h1 long, " + ", ".join(f"{f} boolean" for f in FAILURES[:4])), "audit-measures")
    copies = made.where("doc_id is not null").groupBy("h0", "h1").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.count("*").alias("n"))
    copies = common.saved(copies.where("last > first").drop("last"), "audit-copies")
    placed = common.salted_join(made, copies, ["h0", "h1"], "doc_id", "n", "left")
    return placed.select("doc_id", "part", *FAILURES[:4], F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False)).alias("E"))


def marked(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """Adds the marks good (quality 1) and toxic (toxic 1) of a document's labels."""
    marks = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id"))
    marks = marks.agg(F.max(F.col("quality").eqNullSafe(1)).alias("good"), F.max(F.col("toxic").eqNullSafe(1)).alias("toxic"))
    return rows.join(marks, "doc_id", "left").withColumns({m: F.coalesce(m, F.lit(False)) for m in ("good", "toxic")})


class Walk:
    """The depth-first walk over the trie. `counts` holds the edges out of every state seen so far, at `path`."""

    def __init__(self, spark: SparkSession, filters: str):
        self.spark, self.filters, self.seen = spark, filters, set()
        self.path = common.new_path(spark, "audit-edges")

    def visit(self, state: DataFrame, applied: frozenset[str] = frozenset()) -> None:
        self.seen.add(applied)
        rest = [f for f in self.filters if f not in applied]
        if not rest:
            return
        state = state.persist(StorageLevel.DISK_ONLY)
        try:
            self._count(state, applied, rest)
            for f in rest:
                if (then := applied | {f}) not in self.seen:
                    self.visit(state.where(~F.col(f)).drop(f), then)
        finally:
            state.unpersist()

    def _count(self, state: DataFrame, applied: frozenset[str], rest: list[str]) -> None:
        """Writes the edges out of a state: what each filter that may come next removes there, by part."""
        removed = [F.struct(F.lit(self.filters.index(f)).alias("filter"), F.count_if(f).alias("removed"), F.count_if(F.col(f) & F.col("good")).alias("good"), F.count_if(F.col(f) & F.col("toxic")).alias("toxic")) for f in rest]
        made = state.groupBy("part").agg(F.count("*").alias("n"), F.array(*removed).alias("edges"))
        mask = sum(1 << self.filters.index(f) for f in applied)
        made = made.select("part", F.lit(mask).alias("seen"), "n", F.inline("edges"))
        made.select("part", "seen", "filter", "n", "removed", "good", "toxic").write.mode("append").parquet(self.path)

    def edges(self) -> DataFrame:
        return self.spark.read.schema(EDGE).parquet(self.path)


def _steps(edges: DataFrame, filters: str) -> DataFrame:
    """Every step of every order, by part, from the counts of the edges: at most filters x 2^(filters - 1) of them a part."""
    k, everything = len(filters), (1 << len(filters)) - 1
    counts = F.struct("n", "removed", "good", "toxic")
    table = edges.groupBy("part").agg(F.map_from_entries(F.collect_list(F.struct((F.col("seen") * k + F.col("filter")).alias("edge"), counts.alias("counts")))).alias("at"))

    def at(seen: Column | int, f: Column | int, field: str) -> Column:
        seen, f = (x if isinstance(x, Column) else F.lit(x) for x in (seen, f))
        return F.coalesce(F.try_element_at("at", (seen * k + f).cast("int"))[field], F.lit(0))

    def weighed(f: int) -> Column:
        """Removals of a filter over all orders: a state is the prefix of as many orders as its filters and the rest have."""
        states = [s for s in range(everything + 1) if not s >> f & 1]
        return sum((math.factorial(s.bit_count()) * math.factorial(k - 1 - s.bit_count()) * at(s, f, "removed") for s in states), F.lit(0)).cast("long")

    table = table.select("part", "at", F.array(*map(weighed, range(k))).alias("shapley"))
    orders = []
    for order in itertools.permutations(range(k)):
        for i, f in enumerate(order):
            seen = sum(1 << x for x in order[:i])
            orders.append(f"struct('{''.join(filters[x] for x in order)}' AS filter_order, {i + 1} AS step, {seen} AS seen, {f} AS f)")
    rows = table.select("*", F.inline(F.expr(f"array({', '.join(orders)})")))
    seen, f = F.col("seen"), F.col("f")
    removed = at(seen, f, "removed")
    only = F.get(F.array(*[F.lit(everything - (1 << x)) for x in range(k)]), f)
    return rows.select(
        "part", "filter_order", "step", (at(seen, f, "n") - removed).alias("kept"), removed.alias("removed"), (at(0, f, "removed") - removed).alias("redundant"),
        at(only, f, "removed").alias("unique_fails"), at(seen, f, "good").alias("good_lost"), at(seen, f, "toxic").alias("toxic_lost"), F.get("shapley", f).alias("shapley"),
    )


def audit(rows: DataFrame, filters: str = FAILURES) -> DataFrame:
    """One row for each part, order and step. rows: part, good, toxic and for each filter (named by one letter) whether
    the row fails it."""
    with common.scratch(rows.sparkSession):
        start = common.saved(rows.select("part", "good", "toxic", *filters), "audit-rows")
        walk = Walk(rows.sparkSession, filters)
        walk.visit(start)
        return common.saved(_steps(walk.edges(), filters), "audit", lasting=True)


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    with common.scratch(spark):
        rows = marked(failures(common.documents(spark, sf_dir)), spark.read.parquet(f"{sf_dir}/labels.parquet"))
        return common.saved(audit(rows), "filter-audit", lasting=True)


ORACLE = rf"""
WITH RECURSIVE t AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
f AS (SELECT doc_id, part, (len(w) < {LEAST_WORDS})::INT + 2 * (100 * len(list_distinct(w)) < {LEAST_DISTINCT} * len(w))::INT
  + 4 * (100 * len(regexp_replace(text, '[^A-Z]', '', 'g')) > {MOST_UPPER} * length(text))::INT + 8 * regexp_matches(text, '[{SYMBOLS}]')::INT
  + 16 * coalesce(doc_id > min(doc_id) OVER (PARTITION BY text), false)::INT AS mask FROM t),
l AS (SELECT doc_id, bool_or(coalesce(quality = 1, false)) AS good, bool_or(coalesce(toxic = 1, false)) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
m AS MATERIALIZED (SELECT part, mask, count(*) AS n, count_if(good) AS good, count_if(toxic) AS toxic FROM f LEFT JOIN l USING (doc_id) GROUP BY part, mask),
o(filter_order, seen) AS (SELECT '', 0 UNION ALL SELECT filter_order || letter, seen + bit FROM o, (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) b(letter, bit) WHERE seen & bit = 0),
s AS MATERIALIZED (SELECT filter_order, step, bit, seen FROM (SELECT filter_order, step, 1 << (ascii(filter_order[step]) - 65) AS bit,
  list_sum(list_transform(range(1, step), lambda i: 1 << (ascii(filter_order[i]) - 65))) AS seen FROM o, range(1, 6) r(step) WHERE length(filter_order) = 5)),
a AS MATERIALIZED (SELECT part, filter_order, step, bit, coalesce(sum(n) FILTER (mask & (coalesce(seen, 0) | bit) = 0), 0) AS kept,
  coalesce(sum(n) FILTER (mask & coalesce(seen, 0) = 0 AND mask & bit > 0), 0) AS removed, coalesce(sum(n) FILTER (mask & coalesce(seen, 0) > 0 AND mask & bit > 0), 0) AS redundant,
  coalesce(sum(n) FILTER (mask = bit), 0) AS unique_fails, coalesce(sum(good) FILTER (mask & coalesce(seen, 0) = 0 AND mask & bit > 0), 0) AS good_lost,
  coalesce(sum(toxic) FILTER (mask & coalesce(seen, 0) = 0 AND mask & bit > 0), 0) AS toxic_lost FROM m, s GROUP BY ALL)
SELECT part, filter_order, step::INT AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails,
  good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost, sum(removed) OVER (PARTITION BY part, bit)::BIGINT AS shapley FROM a
"""
