"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Document frequencies of the hashed n-grams are counted over every document that may be learned from,
as a Spark aggregation of per-batch counts. The regression is trained by follow-the-regularised-leader
with elastic-net penalties (weights that stay small are exactly zero) on a bounded sample, and its
softmax is calibrated by one temperature on excerpts of many lengths from a part of the sample that training does not see,
as whole texts leave it no error to learn from. Scoring reads every text whole, in Arrow batches without a shuffle; the model has a fixed size.

* A text that is null or has no letter is ``und`` with score 0. Without a labelled row every text is
  ``und``; with one language, that language is predicted for all texts with a letter.
* Rows whose lang or doc_id is null are not learned from. Repeated rows count as often as they come.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rillwork.llm.classify import SAMPLE_BYTES, SAMPLE_ROWS, learning_sample, ngram_buckets, softmax
from rillwork.llm.common import held_out, map_batches, texts_of

# Table size, n-gram lengths, optimiser settings, share of the sample that calibrates.
BITS = 15
CHARS = (1, 2, 3)
ALPHA, BETA, L1, L2 = 0.3, 1.0, 0.02, 0.5
EPOCHS = 3
CALIBRATION = 5
EXCERPTS = (4, 8, 16, 32, 64, 128)
TEMPERATURES = (0.01, 100.0)
UNKNOWN = "und"
# TF-IDF rows are relative counts times IDF, stretched so that one n-gram in a hundred counts 1.
SCALE = 100.0


def letter_table() -> np.ndarray:
    """For each code point whether it is a letter (by Python's tables)."""
    return np.fromiter((chr(p).isalpha() for p in range(0x110000)), bool, 0x110000)


def features(text: bytes | None, letters: np.ndarray) -> np.ndarray:
    """Buckets of the character n-grams of a lower-cased text; anything but letters is one blank."""
    string = (text or b"").decode("utf-8", "replace").lower()
    points = np.frombuffer(string.encode("utf-32-le"), np.uint32)
    is_letter = letters[points]
    if not is_letter.any():
        return np.zeros(0, np.int32)
    points = np.where(is_letter, points, np.uint32(32))[is_letter | np.r_[False, is_letter[:-1]]]
    return ngram_buckets(np.r_[np.uint32(32), points], CHARS, BITS)


def document_frequencies(docs: DataFrame) -> tuple[np.ndarray, int]:
    """How many of ``docs`` hold each bucket; a fixed number of counts reaches the driver."""

    table = docs.sparkSession.sparkContext.broadcast(letter_table())

    def count(batch: pa.RecordBatch) -> pa.RecordBatch:
        counts, n = np.zeros((1 << BITS) + 1, np.int64), 0
        for text in batch["text"]:
            found = np.unique(features(text.as_py(), table.value))
            counts[found] += 1
            n += 1
        counts[-1] = n
        held = np.flatnonzero(counts)
        return pa.RecordBatch.from_arrays([pa.array(held), pa.array(counts[held])], ["bucket", "n"])

    counts = np.zeros((1 << BITS) + 1, np.int64)
    totals = map_batches(docs.select("text"), count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    for row in totals.toLocalIterator():
        counts[row["bucket"]] = row["n"]
    return counts[:-1], int(counts[-1])


@dataclass
class LanguageModel:
    """``rows`` numbers the buckets with a weight from 1 (0: none); ``weights`` has the scores of each
    number, multiplied by its IDF already."""

    names: list[str]
    rows: np.ndarray
    weights: np.ndarray
    offset: np.ndarray
    temperature: float
    letters: np.ndarray

    def scores(self, found: np.ndarray) -> np.ndarray:
        counts = np.bincount(self.rows[found], minlength=len(self.weights))
        return counts @ self.weights / len(found) + self.offset

    def predict(self, text: bytes | None) -> tuple[str, float]:
        found = features(text, self.letters)
        if not len(found) or not self.names:
            return UNKNOWN, 0.0
        chances = softmax(self.scores(found) / self.temperature)
        best = int(chances.argmax())
        return self.names[best], float(chances[best])


def excerpts(text: bytes, random: np.random.Generator) -> list[bytes]:
    """A text and one piece of it for each length of ``EXCERPTS`` that is shorter than it."""
    string = text.decode("utf-8", "replace")
    places = [(int(random.integers(len(string) - size + 1)), size) for size in EXCERPTS if size < len(string)]
    return [text, *[string[at:at + size].encode("utf-8", "replace") for at, size in places]]


def log_loss(scores: np.ndarray, truth: np.ndarray, heat: float, smooth: float = 0.0) -> float:
    """Mean log loss at a temperature, with a share ``smooth`` of every label spread over all classes."""
    logs = scores / heat
    top = logs.max(axis=1, keepdims=True)
    logs = logs - top - np.log(np.exp(logs - top).sum(axis=1, keepdims=True))
    hit = logs[np.arange(len(truth)), truth]
    return float(-((1 - smooth) * hit + smooth * logs.mean(axis=1)).mean())


def temperature(scores: np.ndarray, truth: np.ndarray) -> float:
    """The temperature of least log loss. One more example of each class than there are keeps it finite without any error."""
    if not len(truth):
        return 1.0
    classes = scores.shape[1]
    grid = np.exp(np.linspace(*np.log(TEMPERATURES), 241))
    losses = [log_loss(scores, truth, t, classes / (len(truth) + classes)) for t in grid]
    return float(grid[int(np.argmin(losses))])


def fit(sample: list[tuple], frequencies: np.ndarray, n_docs: int, seed: int = 11) -> LanguageModel:
    """Train on (doc_id, text, lang) rows with the document frequencies of the whole corpus."""
    idf = np.log((1 + n_docs) / (1 + frequencies)) + 1
    letters, rows, texts = letter_table(), [], []
    for _, text, lang in sample:
        found, counts = np.unique(features(text, letters), return_counts=True)
        if len(found):
            rows.append((found, SCALE * counts / counts.sum() * idf[found], lang))
            texts.append(text)
    names = sorted({lang for _, _, lang in rows})
    if len(names) < 2:
        none = np.zeros(1 << BITS, np.int32)
        return LanguageModel(names, none, np.zeros((1, len(names))), np.zeros(len(names)), 1.0, letters)
    index = {name: i for i, name in enumerate(names)}
    training = [r for i, r in enumerate(rows) if i % CALIBRATION] or rows
    # Per-coordinate FTRL-proximal: z and n hold the sums of shifted and of squared gradients. The last
    # row is the offset, which is not penalised.
    z = np.zeros(((1 << BITS) + 1, len(names)))
    n = np.zeros_like(z)

    def weights(at: np.ndarray) -> np.ndarray:
        zi, ni = z[at], n[at]
        penalty = np.where(at[:, None] == 1 << BITS, 0.0, L1)
        shrunk = np.sign(zi) * np.maximum(np.abs(zi) - penalty, 0)
        return -shrunk / ((BETA + np.sqrt(ni)) / ALPHA + L2)

    random = np.random.default_rng(seed)
    for _ in range(EPOCHS):
        for i in random.permutation(len(training)):
            found, values, lang = training[i]
            at, x = np.r_[found, 1 << BITS], np.r_[values, 1.0]
            w = weights(at)
            error = softmax(x @ w)
            error[index[lang]] -= 1
            g = x[:, None] * error
            shift = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA
            z[at] += g - shift * w
            n[at] += g * g
    every = weights(np.arange((1 << BITS) + 1))
    used = np.flatnonzero(every[:-1].any(axis=1))
    numbers = np.zeros(1 << BITS, np.int32)
    numbers[used] = np.arange(1, len(used) + 1)
    learned = np.vstack([np.zeros((1, len(names))), every[used] * idf[used, None] * SCALE])
    model = LanguageModel(names, numbers, learned, every[-1], 1.0, letters)
    # One temperature for all languages, on rows that training has not seen.
    scores, truth = [], []
    for text, (_, _, lang) in zip(texts[::CALIBRATION], rows[::CALIBRATION], strict=True):
        for found in [features(part, letters) for part in excerpts(text, random)]:
            if len(found):
                scores.append(model.scores(found))
                truth.append(index[lang])
    model.temperature = temperature(np.array(scores), np.array(truth))
    return model


def train(docs: DataFrame, max_rows: int = SAMPLE_ROWS, max_bytes: int = SAMPLE_BYTES) -> LanguageModel:
    usable = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text"),
        F.col("lang").cast("string").alias("label"),
    ).where(~held_out(F.col("doc_id")) & F.col("label").isNotNull() & F.col("doc_id").isNotNull())
    frequencies, n_docs = document_frequencies(usable.where(F.col("text").isNotNull()))
    # The bound is applied to the ids, which are small rows, before any text is fetched.
    key = F.md5(F.concat(F.lit("language"), F.col("doc_id").cast("string")))
    ids = usable.select("doc_id").orderBy(key).limit(max_rows).distinct()
    return fit(learning_sample(usable.join(F.broadcast(ids), "doc_id"), "language", max_rows, max_bytes), frequencies, n_docs)


def language_column(spark: SparkSession, model: LanguageModel, text: Column) -> Column:
    """(lang_pred, score) of a binary text column."""
    sent = spark.sparkContext.broadcast(
        (model.names, model.rows, model.weights, model.offset, model.temperature, model.letters))

    @F.arrow_udf("struct<lang_pred string, score double>")
    def run(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = LanguageModel(*sent.value)
        for batch in texts:
            found = [own.predict(t.as_py()) for t in batch]
            yield pa.StructArray.from_arrays(
                [pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())],
                ["lang_pred", "score"])

    return run(text)


def language_report(docs: DataFrame) -> DataFrame:
    model = train(docs)
    found = language_column(docs.sparkSession, model, F.col("text"))
    return texts_of(docs).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), found.alias("f")).select(
        "doc_id", "held_out", "f.*")
