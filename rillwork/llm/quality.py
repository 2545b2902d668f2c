"""Quality classifier: supervised subword embeddings.

Every word and every run of characters of a word hashes to a row of a table of learned vectors. A
document is the mean of its vectors; a softmax over the labels sits on top. Table and softmax are
trained together by stochastic gradient descent in numpy, on a bounded sample of labelled rows that
the driver holds (``SAMPLE_ROWS``, ``SAMPLE_BYTES``). The trained table has a fixed size and is
broadcast; scoring reads every text whole, in Arrow batches without a shuffle.

* Null or empty text has no vector: its score is the one of the softmax's offset alone.
* Without labels of both kinds nothing can be learned; the score is then the share of label 1, or
  0.5 without labels.
* Labels that disagree for one doc_id, and repeated rows, are taken as they come. Rows with null
  doc_id are scored but not learned from, and are not held out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rillwork.llm.classify import SAMPLE_BYTES, SAMPLE_ROWS, code_points, learning_sample, ngram_buckets, softmax
from rillwork.llm.common import held_out, texts_of

# Table size, width, n-gram lengths, training schedule and the limit of acceptance.
BITS = 15
WIDTH = 8
CHARS = (2, 3)
EPOCHS = 6
RATE = 0.5
ACCEPT = 0.7


def buckets(text: bytes) -> np.ndarray:
    """Buckets of the words, of their character n-grams (which span the word ends) and of the
    pattern of each word pair."""
    points = code_points(text)
    if not len(points):
        return np.zeros(0, np.int32)
    blank = (points == 32) | ((points >= 9) & (points <= 13))
    points = np.where(blank, np.uint32(32), points)
    grams = ngram_buckets(points, CHARS, BITS - 1)
    # A word's hash is the sum of its mixed characters with their places, taken between blanks.
    edges = np.flatnonzero(np.diff(np.r_[True, blank, True]))
    starts, ends = edges[::2], edges[1::2]
    if len(starts):
        place = np.arange(len(points), dtype=np.uint64)
        place -= np.repeat(np.r_[0, starts].astype(np.uint64), np.diff(np.r_[0, starts, len(points)]))
        mixed = (points.astype(np.uint64) + np.uint64(7)) * (place * np.uint64(2) + np.uint64(0x9E3779B97F4A7C15))
        mixed ^= mixed >> np.uint64(31)
        total = np.r_[np.uint64(0), np.cumsum(mixed * np.uint64(0x94D049BB133111EB), dtype=np.uint64)]
        words = (total[ends] - total[starts]) * np.uint64(0xBF58476D1CE4E5B9)
        # Of word pairs only their pattern is kept: the same word again (1) or another (0).
        again = (words[1:] == words[:-1]).astype(np.int32)
        words = (words >> np.uint64(64 - BITS + 1)).astype(np.int32)
        return np.concatenate([grams, words + (1 << (BITS - 1)), again])
    return grams


@dataclass
class QualityModel:
    """Vectors and softmax folded into one number per bucket: a score is their mean plus an offset."""

    margins: np.ndarray
    offset: float

    def score(self, text: bytes | None) -> float:
        found = buckets(text or b"")
        margin = self.offset + (float(self.margins[found].mean()) if len(found) else 0.0)
        return float(1 / (1 + np.exp(-np.clip(margin, -50, 50))))


def fit(sample: list[tuple], seed: int = 7) -> QualityModel:
    """Train on (doc_id, text, label) rows."""
    labels = np.array([int(label) for _, _, label in sample], np.int64)
    if len(set(labels.tolist())) < 2:
        share = float(labels.mean()) if len(labels) else 0.5
        share = min(max(share, 1e-6), 1 - 1e-6)
        return QualityModel(np.zeros(1 << BITS), float(np.log(share / (1 - share))))
    documents = []
    for _, text, _ in sample:
        found, counts = np.unique(buckets(text), return_counts=True)
        # Counts are kept as narrow as they fit: the driver holds all documents of the sample.
        documents.append((found, counts.astype(np.min_scalar_type(counts.max(initial=0)))))
    random = np.random.default_rng(seed)
    table = random.normal(0, 0.1, (1 << BITS, WIDTH)).astype(np.float32)
    top, offset = np.zeros((WIDTH, 2), np.float32), np.zeros(2, np.float32)
    top += random.normal(0, 0.1, top.shape).astype(np.float32)
    steps, step = EPOCHS * len(documents), 0
    # AdaGrad keeps the step of rare buckets large: a mean over many n-grams moves each of them little.
    seen_table = np.full(1 << BITS, 1e-8, np.float32)
    for _ in range(EPOCHS):
        for i in random.permutation(len(documents)):
            found, counts = documents[i]
            share = (counts / max(1, counts.sum(dtype=np.int64))).astype(np.float32)
            rate = RATE * (1 - step / steps)
            step += 1
            mean = share @ table[found] if len(found) else np.zeros(WIDTH, np.float32)
            error = softmax(mean @ top + offset)
            error[labels[i]] -= 1
            pull = top @ error
            if len(found):
                push = np.outer(share, pull)
                seen_table[found] += (push * push).mean(axis=1)
                table[found] -= rate * 0.2 * push / np.sqrt(seen_table[found])[:, None]
            top -= rate * np.outer(mean, error)
            offset -= rate * 0.1 * error
    margins = table @ (top[:, 1] - top[:, 0])
    return QualityModel(margins.astype(np.float64), float(offset[1] - offset[0]))


def train(docs: DataFrame, labels: DataFrame, max_rows: int = SAMPLE_ROWS, max_bytes: int = SAMPLE_BYTES) -> QualityModel:
    """Fit on rows of ``docs`` whose doc_id has a quality label and is not held out."""
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("label"))
    marks = marks.where("label in (0, 1) and doc_id is not null")
    # The bound is applied to the labels, which are small rows, before any text is fetched; labels of absent documents do not count.
    present = docs.select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id is not null")
    marks = marks.join(present, "doc_id", "left_semi")
    key = F.md5(F.concat(F.lit("quality"), F.col("doc_id").cast("string")))
    marks = marks.where(~held_out(F.col("doc_id"))).orderBy(key).limit(max_rows)
    return fit(learning_sample(texts_of(docs).join(F.broadcast(marks), "doc_id"), "quality", max_rows, max_bytes))


def score_column(spark: SparkSession, model: QualityModel, text: Column) -> Column:
    """Score of a binary text column."""
    sent = spark.sparkContext.broadcast((model.margins, model.offset))

    @F.arrow_udf("double")
    def run(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = QualityModel(*sent.value)
        for batch in texts:
            yield pa.array([own.score(t.as_py()) for t in batch], pa.float64())

    return run(text)


def quality_report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    model = train(docs, labels)
    scored = texts_of(docs).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"),
        score_column(docs.sparkSession, model, F.col("text")).alias("score"),
    )
    return scored.withColumn("predicted", (F.col("score") >= ACCEPT).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows that the classifier accepts, with all their columns."""
    model = train(docs, labels)
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    text = F.col("row.text").cast("string").cast("binary")
    scored = packed.select("row", score_column(docs.sparkSession, model, text).alias("score"))
    return scored.where(F.col("score") >= ACCEPT).select("row.*")
