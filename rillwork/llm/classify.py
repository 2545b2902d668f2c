"""Pieces that the two text classifiers share: the learning sample, hashed n-grams, softmax."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillwork.llm.common import held_out

# Bounds of the learning sample (rows, and bytes of text that the driver takes in).
SAMPLE_ROWS = 6000
SAMPLE_BYTES = 24 << 20


def learning_sample(rows: DataFrame, seed: str, max_rows: int = SAMPLE_ROWS, max_bytes: int = SAMPLE_BYTES) -> list:
    """At most ``max_rows`` rows (doc_id, text binary, label) that may be learned from, in the order
    of a hash of their doc_id; a text that does not fit into what is left of ``max_bytes`` is passed over.

    The bound is the documented one of a classifier's fit; everything else reads all rows.
    """
    usable = rows.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull() & F.col("label").isNotNull())
    # A text that can never fit does not use up the bound on rows.
    usable = usable.where(~held_out(F.col("doc_id")) & (F.octet_length("text") <= max_bytes))
    key = F.md5(F.concat(F.lit(seed), F.col("doc_id").cast("string")))
    taken, size = [], 0
    for row in usable.withColumn("__key", key).orderBy("__key").limit(max_rows).drop("__key").toLocalIterator():
        if size + len(row["text"]) <= max_bytes:
            size += len(row["text"])
            taken.append((row["doc_id"], bytes(row["text"]), row["label"]))
    return taken


def code_points(text: bytes) -> np.ndarray:
    """UTF-8 bytes as an array of code points; broken sequences become U+FFFD."""
    return np.frombuffer(text.decode("utf-8", "replace").encode("utf-32-le"), np.uint32)


def ngram_buckets(points: np.ndarray, sizes: tuple[int, ...], bits: int, salt: int = 0) -> np.ndarray:
    """Hashed buckets of all runs of ``sizes`` code points, one after another."""
    out, state = [], np.zeros(len(points), np.uint64)
    for size in range(1, max(sizes) + 1):
        if len(points) < size:
            break
        state = state[: len(points) - size + 1] if size > 1 else state
        tail = points[size - 1:].astype(np.uint64) + np.uint64(salt + 1)
        state = (state ^ tail) * np.uint64(0x9E3779B97F4A7C15)
        state ^= state >> np.uint64(29)
        if size in sizes:
            mixed = state * np.uint64(0xBF58476D1CE4E5B9)
            out.append((mixed >> np.uint64(64 - bits)).astype(np.int32))
    return np.concatenate(out) if out else np.zeros(0, np.int32)


def softmax(scores: np.ndarray) -> np.ndarray:
    e = np.exp(scores - scores.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)
