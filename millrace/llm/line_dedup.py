"""Line dedup over batches: lines that many documents share stay in one of them, found through levelled sorted runs.

A line's key is the line stripped of ASCII blanks at both ends with A-Z lower-cased, known by 128 bits of hash. Batches
come in order; what earlier batches have seen lies in runs: tables of keys, sorted and bucketed by key, with the number of
documents and, in the run of the batch that saw the key first, the document that keeps its lines. A new batch merge-joins
the runs (anti: what none of them holds is fresh, and its largest document keeps it) and is added as a run of the lowest
level. When a level holds FANOUT runs they are merged into one of the next level, so a batch meets few runs and a key is
rewritten once a level. All runs are bucketed alike, so neither these joins nor merges shuffle a run again.

`deduplicated_lines` takes its batches from the largest doc_ids down, so the first document that holds a key is the largest
one. Then the keys found in enough documents are joined with the lines (a key that many documents share in salted parts),
and every document drops its own lines in place.

A null or empty text is one empty line. Rows with one doc_id are one document: what it loses, each of its rows loses.
Rows without doc_id together are one document, below all others. Short keys and all other lines stay as they are, in
their order. An empty table gives an empty result; all other columns are kept, whatever their names.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import common, pieces

LEAST_LENGTH, LEAST_DOCUMENTS = 40, 5
BATCHES, FANOUT = 4, 2
BLANKS = b" \t\n\v\f\r"
KEY = ["h0", "h1"]


def line_key(line: bytes, least: int) -> bytes | None:
    """The 16 bytes that stand for a line's key; None if the key has fewer than `least` code points."""
    key = line.strip(BLANKS).lower()  # of bytes: A-Z only
    if len(key) < least or (not key.isascii() and len(key.decode("utf-8", "replace")) < least):
        return None
    return xxhash.xxh3_128_digest(key)


def named(text: Column, doc_id: Column) -> Column:
    """What tells rows without doc_id apart: a hash of the text."""
    return F.when(doc_id.isNull(), F.xxhash64(text)).otherwise(0)


def line_keys(docs: DataFrame, least: int = LEAST_LENGTH) -> DataFrame:
    """(doc_id, t, h0, h1): the distinct keys of every row, t as in `named`."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for texts in pieces.slices(batch.column(2)):
                found, n = [], []
                for text in texts.cast(pa.binary()).to_pylist():
                    keys = {k for line in text.split(b"\n") if (k := line_key(line, least))}
                    found += keys
                    n.append(len(keys))
                halves = np.frombuffer(b"".join(found), "<i8").reshape(-1, 2)
                owner = pa.array(at + np.repeat(np.arange(len(texts)), n))
                columns = [*[batch.column(i).take(owner) for i in (0, 1)], *[pa.array(halves[:, i].copy()) for i in (0, 1)]]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "t", *KEY])
                at += len(texts)

    doc_id, text = F.col("doc_id").cast("long"), F.col("text")
    rows = docs.select(doc_id.alias("doc_id"), named(text, doc_id).alias("t"), text.alias("text")).where("text <> ''")
    return common.map_batches(rows, work, "doc_id long, t long, h0 long, h1 long")


class LineRuns:
    """The runs: by level, bucketed tables (h0, h1, n, keeper) in the shared folder. `keeper` is null in a run whose batch
    was not the first to hold the key, so the one keeper of a key is its only value."""

    def __init__(self, spark: SparkSession, fanout: int = FANOUT):
        self.spark, self.fanout = spark, fanout
        self.buckets = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
        self.levels: list[list[str]] = []
        self.paths: dict[str, str] = {}

    def __enter__(self) -> LineRuns:
        return self

    def __exit__(self, *_) -> None:
        for name in sum(self.levels, []):
            self._drop(name)

    def _write(self, rows: DataFrame) -> str:
        name = f"line_run_{uuid.uuid4().hex}"
        self.paths[name] = path = common.new_path(self.spark, name)
        rows.write.bucketBy(self.buckets, *KEY).sortBy(*KEY).option("path", path).saveAsTable(name)
        return name

    def _drop(self, name: str) -> None:
        self.spark.sql(f"DROP TABLE {name}")
        common.delete(self.spark, self.paths.pop(name))

    def runs(self) -> list[DataFrame]:
        """All runs, the older ones first."""
        return [self.spark.table(name).hint("merge") for level in reversed(self.levels) for name in level]

    def add(self, pairs: DataFrame) -> None:
        """Adds a batch of (doc_id, h0, h1)."""
        own = pairs.distinct().groupBy(*KEY).agg(F.count("*").alias("n"), F.max("doc_id").alias("keeper"))
        batch = self._write(own.repartition(self.buckets, *KEY))
        if held := self.runs():
            own = fresh = self.spark.table(batch)
            for run in held:
                fresh = fresh.join(run, KEY, "left_anti")
            merged = own.drop("keeper").join(fresh.select(*KEY, "keeper").hint("merge"), KEY, "left")
            counted, batch = batch, self._write(merged)
            self._drop(counted)
        self._place(batch, 0)

    def _place(self, name: str, level: int) -> None:
        if level == len(self.levels):
            self.levels.append([])
        self.levels[level].append(name)
        if len(self.levels[level]) >= self.fanout:
            merged, old = self._write(self.totals(self.levels[level])), self.levels[level]
            self.levels[level] = []
            for run in old:
                self._drop(run)
            self._place(merged, level + 1)

    def totals(self, names: list[str] | None = None) -> DataFrame:
        """(h0, h1, n, keeper) over some or all runs: merge joins of bucketed runs."""
        names = [x for level in reversed(self.levels) for x in level] if names is None else names
        out = self.spark.table(names[0])
        for name in names[1:]:
            other = self.spark.table(name).hint("merge")
            n = F.coalesce(out["n"], F.lit(0)) + F.coalesce(other["n"], F.lit(0))
            out = out.join(other, KEY, "full").select(*KEY, n.alias("n"), F.coalesce(out["keeper"], other["keeper"]).alias("keeper"))
        return out


def repeated_lines(docs: DataFrame, least_length: int, least_documents: int, batches: int) -> DataFrame:
    """(doc_id, t, h0, h1): the keys whose lines each row loses."""
    spark = docs.sparkSession
    share = [i / batches for i in range(batches - 1, 0, -1)]
    bounds = docs.agg(F.percentile_approx(F.col("doc_id").cast("long"), share)).first()[0] or []
    # the largest ids come first; rows without doc_id belong to the last batch
    batch = sum((F.when(F.col("doc_id") > b, 0).otherwise(1) for b in bounds), F.lit(0))
    lines = line_keys(docs, least_length).withColumn("batch", batch.cast("int"))
    lines = common.saved(lines, "lines", by=["batch"])
    with LineRuns(spark) as runs:
        for i in range(len(bounds) + 1):
            runs.add(lines.where(F.col("batch") == i).select("doc_id", *KEY))
        often = common.saved(runs.totals().where(F.col("n") >= least_documents), "lines-often")
    lost = common.salted_join(lines.drop("batch"), often, KEY, "doc_id", "n").where(~F.col("doc_id").eqNullSafe(F.col("keeper")))
    return lost.select("doc_id", "t", *KEY)


def _without(text: pd.Series, low: pd.Series, high: pd.Series, least: pd.Series) -> pd.DataFrame:
    """A text without the lines whose keys are given."""
    rows = []
    for t, a, b, n in zip(text, low, high, least):
        if a is None:
            rows.append((t, (t or "").count("\n") + 1, 0))
            continue
        gone = {x.tobytes() for x in np.stack([a, b], 1).astype("<i8")}
        lines = t.encode("utf-8", "surrogatepass").split(b"\n")
        kept = [line for line in lines if line_key(line, n) not in gone]
        rows.append((b"\n".join(kept).decode("utf-8", "surrogatepass"), len(lines), len(lines) - len(kept)))
    return pd.DataFrame(rows, columns=["text", "n_lines", "n_dropped"])


def deduplicated_lines(docs: DataFrame, least_length: int = LEAST_LENGTH, least_documents: int = LEAST_DOCUMENTS, batches: int = BATCHES) -> DataFrame:
    """(doc, text, n_lines, n_dropped) for every row: its other columns in one struct, and what stays of its text."""
    common.small_batches(docs.sparkSession)
    with common.scratch(docs.sparkSession):
        lost = common.saved(repeated_lines(docs, least_length, least_documents, batches), "lines-lost")
        gone = lost.groupBy("doc_id", "t").agg(F.collect_set(F.struct(*KEY)).alias("keys"))
        gone = gone.select(F.col("doc_id").alias("id"), "t", F.col("keys.h0").alias("low"), F.col("keys.h1").alias("high"))
        gone = common.saved(gone, "lines-gone", lasting=True)
        narrow = lost.count() <= common.BROADCAST_ROWS  # keys, not documents, are what a broadcast would hold
    own = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("doc")
    rows = docs.select(own, F.col("doc_id").cast("long").alias("own_id"), F.col("text").alias("text"))
    same = F.col("own_id").eqNullSafe(F.col("id")) & (named(F.col("text"), F.col("own_id")) == F.col("t"))
    rows = rows.join(F.broadcast(gone) if narrow else gone, same, "left")
    without = F.pandas_udf(_without, "text string, n_lines long, n_dropped long")
    return rows.select("doc", without("text", "low", "high", F.lit(least_length)).alias("made")).select("doc", "made.*")


def op12_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = deduplicated_lines(common.documents(spark, sf_dir))
    return made.select("doc.doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


ORACLE = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents),
lines AS (SELECT r, doc_id, unnest(parts) AS line, generate_subscripts(parts, 1) AS i FROM d),
keyed AS MATERIALIZED (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{common.UPPER}', '{common.LOWER}') AS key FROM lines),
often AS (SELECT key, max(doc_id) AS keeper FROM keyed WHERE length(key) >= {LEAST_LENGTH} GROUP BY key HAVING count(DISTINCT coalesce(doc_id::VARCHAR, '')) >= {LEAST_DOCUMENTS}),
marked AS (SELECT r, line, i, often.key IS NOT NULL AND doc_id IS DISTINCT FROM keeper AS gone FROM keyed LEFT JOIN often ON keyed.key = often.key)
SELECT any_value(doc_id) AS doc_id, count(*)::BIGINT AS n_lines, count_if(gone)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM marked JOIN d USING (r) GROUP BY r
"""
