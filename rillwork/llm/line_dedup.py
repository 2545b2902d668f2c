"""Line dedup: drop lines that other documents hold too.

Lines are exploded to (hash of the normalised line, document); one aggregation with partial sums
finds the hashes that at least ``min_docs`` documents hold and the smallest document of each. The
lines are then joined to those hashes and the surviving lines put together again by position.

* A document is a doc_id; rows with the same doc_id are one document when documents are counted,
  and each row is cleaned on its own.
* Null or empty text is one empty line and stays empty. A row whose doc_id is null is kept
  unchanged and counts for no line.
* Extra columns are carried along, whatever they are called.
"""

from __future__ import annotations

import hashlib

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillwork.llm.common import map_batches, stored, texts_of

# White space that is stripped from a key, and the shortest key.
BLANK = b" \t\n\x0b\x0c\r"
MIN_CHARS = 10


def line_hash(line: bytes, min_chars: int = MIN_CHARS) -> bytes | None:
    """128-bit hash of a normalised line; None if its key is too short to be judged."""
    key = line.strip(BLANK).lower()  # bytes.lower changes A-Z only
    if len(key) < min_chars or (len(key) < 4 * min_chars and len(key.decode("utf-8", "replace")) < min_chars):
        return None
    return hashlib.md5(key, usedforsecurity=False).digest()


def line_hashes(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(h, doc_id): each distinct key of each row."""

    def explode(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids, hashes = [], []
        for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"]):
            found = {line_hash(line, min_chars) for line in (text.as_py() or b"").split(b"\n")} - {None}
            hashes.extend(found)
            ids.extend([doc_id] * len(found))
        return pa.RecordBatch.from_arrays([pa.array(hashes, pa.binary()), pa.array(ids, pa.int64())], ["h", "doc_id"])

    return map_batches(docs.where("doc_id is not null"), explode, "h binary, doc_id long")


def repeated_lines(docs: DataFrame, min_docs: int = 2, min_chars: int = MIN_CHARS) -> DataFrame:
    """(doc_id, drops): for each document the hashes of the lines it loses."""
    lines = line_hashes(texts_of(docs), min_chars)
    if min_docs <= 2:
        common = lines.groupBy("h").agg(F.min("doc_id").alias("keeper"), F.max("doc_id").alias("last"))
        common = common.where(F.col("keeper") < F.col("last"))
    else:
        common = lines.distinct().groupBy("h").agg(F.min("doc_id").alias("keeper"), F.count(F.lit(1)).alias("n"))
        common = common.where(F.col("n") >= min_docs)
    # Stored, so that the join has a plain shuffle on both sides and hot lines can be split.
    common = stored(common.select("h", "keeper"), "lines")
    lost = lines.join(common.hint("merge"), "h").where(F.col("doc_id") != F.col("keeper"))
    return lost.groupBy("doc_id").agg(F.collect_set("h").alias("drops"))


def drop_lines(docs: DataFrame, min_docs: int = 2, min_chars: int = MIN_CHARS) -> DataFrame:
    """Every row of ``docs`` as ``row`` (a struct of its columns) with ``kept`` (text), ``n_lines``
    and ``n_dropped``."""
    drops = repeated_lines(docs, min_docs, min_chars).select(F.col("doc_id").alias("__id"), "drops")
    packed = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
        F.col("doc_id").cast("long").alias("__id"),
    )

    @F.pandas_udf("kept string, n_lines long, n_dropped long")
    def rebuild(text: pd.Series, drops: pd.Series) -> pd.DataFrame:
        kept, counts, dropped = [], [], []
        for value, lost in zip(text, drops):
            value = value or b""
            if lost is None or len(lost) == 0:
                kept.append(value.decode("utf-8", "replace"))
                counts.append(value.count(b"\n") + 1)
                dropped.append(0)
                continue
            lines, lost = value.split(b"\n"), set(map(bytes, lost))
            stay = [line for line in lines if line_hash(line, min_chars) not in lost]
            kept.append(b"\n".join(stay).decode("utf-8", "replace"))
            counts.append(len(lines))
            dropped.append(len(lines) - len(stay))
        return pd.DataFrame({"kept": kept, "n_lines": counts, "n_dropped": dropped})

    joined = packed.join(drops, "__id", "left")
    out = rebuild(F.col("row.text").cast("string").cast("binary"), F.col("drops"))
    return joined.select("row", out.alias("__out")).select("row", "__out.*")


def line_dedup_report(docs: DataFrame) -> DataFrame:
    return drop_lines(docs).select(
        F.col("row.doc_id").alias("doc_id"), "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"),
    )
