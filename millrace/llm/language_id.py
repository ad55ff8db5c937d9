"""Language identification: averaged hashed subword embeddings under a linear softmax, trained in numpy.

Byte n-grams of the lower-cased letters of a text are hashed into BUCKETS rows of an embedding; their average goes
through a linear softmax. Training is stochastic gradient descent on a sample of at most 2 * SAMPLE labelled rows
(with very many languages 2 * LEAST for each of them), spread evenly over the languages; a part of it stays aside to set the softmax temperature and the score below which a
prediction is marked as rejected. Prediction sees whole texts and nothing but texts; the model is a table of BUCKETS
rows, so its size does not depend on the data.

Texts that are null or without a letter are `und` with score 0; so is everything if there is nothing to learn from.
Rows without doc_id are predicted but never learned from. Rows repeat as they come; an empty table gives an empty
result; other columns of the input are not carried.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import common, pieces

BUCKETS, DIMENSIONS, ORDERS = 1 << 14, 16, (2, 3, 4)
#: Bound of the training sample: rows aimed at over all languages; twice as many are taken at most.
SAMPLE = 2000
#: Rows of a language that are aimed at in any case, if it has as many.
LEAST = 8
#: Passes over the sample, more of them where it is so small that they would make fewer than STEPS steps.
EPOCHS, STEPS, BATCH, RATE = 12, 500, 32, 8.0
#: Share of wrong ones among the accepted predictions that the rejection threshold aims at.
ACCEPTED_ERROR = 0.005
UND = "und"
#: ASCII bytes other than letters become blanks; letters stay, upper case is lowered before.
LETTERS = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256))


def features(text: str) -> np.ndarray:
    """Counts of hashed byte n-grams of the whole text."""
    total = np.zeros(BUCKETS, np.int64)
    for start in range(0, max(1, len(text)), pieces.SLICE):
        part = text[max(0, start - max(ORDERS)) : start + pieces.SLICE]
        data = b" " + b" ".join(part.lower().encode("utf-8", "replace").translate(LETTERS).split()) + b" "
        a = np.frombuffer(data, np.uint8).astype(np.uint32)
        rolled = a
        for order in range(2, max(ORDERS) + 1):
            rolled = rolled[:-1] * np.uint32(0x01000193) + a[order - 1 :] if len(rolled) > 1 else rolled[:0]
            if order in ORDERS and len(rolled):
                mixed = (rolled ^ (rolled >> np.uint32(15))) * np.uint32(0x9E3779B1 + 2 * order)
                total += np.bincount(mixed >> np.uint32(18), minlength=BUCKETS)
    return total


@dataclass
class Model:
    languages: list[str]
    #: Embedding times softmax weights, folded: what one n-gram adds to each language.
    table: np.ndarray
    bias: np.ndarray
    temperature: float
    threshold: float

    def logits(self, counts: np.ndarray) -> np.ndarray:
        return (counts / max(1, counts.sum())).astype(np.float32) @ self.table + self.bias

    def predict(self, text: str) -> tuple[str, float]:
        p = softmax(self.logits(features(text))[None] / self.temperature)[0]
        best = int(p.argmax())
        return self.languages[best], float(p[best])


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def train(rows: list[tuple[str, np.ndarray, np.ndarray]], seed: int = 7) -> Model | None:
    """Fits (language, buckets, counts) rows; a fifth of them calibrates."""
    languages = sorted({lang for lang, _, _ in rows})
    if not languages:
        return None
    rng = np.random.default_rng(seed)
    embedding = rng.uniform(-1, 1, (BUCKETS, DIMENSIONS)).astype(np.float32) / DIMENSIONS
    weights, bias = np.zeros((DIMENSIONS, len(languages)), np.float32), np.zeros(len(languages), np.float32)
    target = np.array([languages.index(lang) for lang, _, _ in rows])
    aside = np.zeros(len(rows), bool)
    aside[rng.permutation(len(rows))[: len(rows) // 5]] = True

    def dense(which: np.ndarray) -> np.ndarray:
        x = np.zeros((len(which), BUCKETS), np.float32)
        for i, r in enumerate(which):
            x[i, rows[r][1]] = rows[r][2] / rows[r][2].sum()
        return x

    learned = np.flatnonzero(~aside)
    each = max(1, -(-len(learned) // BATCH))
    epochs = max(EPOCHS, -(-STEPS // each))
    steps, done = epochs * each, 0
    for _ in range(epochs):
        order = rng.permutation(learned)
        for i in range(0, len(order), BATCH):
            which = order[i : i + BATCH]
            x, rate = dense(which), RATE * (1 - done / steps)
            done += 1
            hidden = x @ embedding
            error = softmax(hidden @ weights + bias)
            error[np.arange(len(which)), target[which]] -= 1
            error /= len(which)
            back = error @ weights.T
            weights -= rate * hidden.T @ error
            bias -= rate / 8 * error.sum(axis=0)
            used = np.flatnonzero(x.any(axis=0))
            embedding[used] -= rate * BATCH * (x[:, used].T @ back)
    model = Model(languages, embedding @ weights, bias, 1.0, 0.0)
    check = np.flatnonzero(aside)
    if len(check):
        logits = np.concatenate([dense(check[i : i + BATCH]) @ model.table + bias for i in range(0, len(check), BATCH)])
        truth = target[check]
        loss = lambda t: -np.log(softmax(logits / t)[np.arange(len(check)), truth] + 1e-12).mean()
        model.temperature = float(min(np.geomspace(0.25, 20, 120), key=loss))
        p = softmax(logits / model.temperature)
        score, right = p.max(axis=1), p.argmax(axis=1) == truth
        order = np.argsort(-score)
        accepted = np.flatnonzero(np.cumsum(~right[order]) <= ACCEPTED_ERROR * np.arange(1, len(order) + 1))
        model.threshold = float(score[order[accepted[-1]]]) if len(accepted) else 1.0
    return model


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def training_rows(docs: DataFrame, sample: int = SAMPLE) -> list[tuple[str, np.ndarray, np.ndarray]]:
    """Features of a bounded sample of the rows that may be learned from, in a fixed order."""
    open_rows = docs.where(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & ~held_out(F.col("doc_id")))
    counts = common.saved(open_rows.groupBy("lang").agg(F.count("*").alias("_n")), "language-counts")
    languages = counts.count()
    if not languages:
        return []
    sample = max(sample, LEAST * languages)
    draw = F.shiftrightunsigned(F.xxhash64("doc_id"), 11) / float(1 << 53)
    rated = open_rows.select("doc_id", "lang", "text").join(common.maybe_broadcast(counts), "lang")
    drawn = rated.where((draw < F.lit(sample / languages) / F.col("_n")) & F.col("text").rlike(r"\p{L}"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [features(x.as_py()) for x in batch.column(2)]
            held = [np.flatnonzero(f) for f in found]
            columns = [pa.array([h.astype("<i4").tobytes() for h in held], pa.binary()), pa.array([f[h].astype("<f4").tobytes() for f, h in zip(found, held)], pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], ["doc_id", "lang", "buckets", "counts"])

    found = common.map_batches(drawn.select("doc_id", "lang", "text"), count, "doc_id long, lang string, buckets binary, counts binary")
    # repeated rows may exceed the bound; which of them stay is settled by a hash
    made = found.orderBy(F.xxhash64("doc_id", "lang", "buckets"), "doc_id").limit(2 * sample).toArrow()
    rows = sorted(zip(*(made.column(i).to_pylist() for i in range(4))), key=lambda r: (r[0], r[1], r[2]))
    return [(lang, np.frombuffer(b, "<i4"), np.frombuffer(c, "<f4")) for _, lang, b, c in rows]


def identify(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, held_out, lang_pred, score and rejected for every whole text."""

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [model.predict(text.as_py()) if letter.as_py() and model else (UND, 0.0) for text, letter in zip(batch.column(2), batch.column(3))]
            rejected = [score < model.threshold if model else True for _, score in found]
            columns = [pa.array([p for p, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64()), pa.array(rejected, pa.bool_())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], ["doc_id", "held_out", "lang_pred", "score", "rejected"])

    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), text.alias("text"), text.rlike(r"\p{L}").alias("letter"))
    return common.map_batches(rows, predict, "doc_id long, held_out boolean, lang_pred string, score double, rejected boolean")


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir)
    return identify(docs, train(training_rows(docs)))
