"""Benchmark decontamination with one Aho-Corasick automaton over word windows of the items.

Items and documents are normalised to words (A-Z lower-cased, everything in ASCII that is not a
letter or digit separates). The automaton holds every window of ``window`` consecutive item words,
as a sequence of word numbers; a shorter item is one window. It reads each text once; every word
knows its place in the original, so hits can be given as byte offsets of the text as it came.

The automaton is built once in each Python worker, which keeps it beside the broadcast items for its further tasks. Items are taken in
shards of bounded size (``SHARD_BYTES`` of text; an item of more than ``SLICE_BYTES`` in overlapping slices), one pass over the documents for each shard,
so neither the broadcast nor the automaton grows with the benchmark. A worker lets go of a shard when it takes up another.

* Null text, or text without a word, has no words and is not contaminated; a null item has no
  window. Items with equal words all count. A row with null doc_id is judged like any other.
* A row is judged by its text alone: hits of several shards are put together by a hash of the text, never by doc_id.
* Repeated rows give repeated results; extra columns do not matter.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rillwork.llm.common import texts_of

# Words of a window, the share of hit words (1 of 20) and how words are found.
WINDOW = 13
HIT_SHARE = 20
SHARD_BYTES = 1 << 20
SLICE_BYTES = SHARD_BYTES
_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
_TO_WORDS = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256)
)


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_TO_WORDS).split()


def word_offsets(text: bytes) -> list[tuple[int, int]]:
    """Byte range of every word in the original text, in the order of ``words_of``."""
    return [m.span() for m in _WORD.finditer(text)]


class WindowAutomaton:
    """All windows of some items, found in one scan of a word list."""

    def __init__(self, items: list[tuple[object, list[bytes]]], window: int = WINDOW):
        self.numbers: dict[bytes, int] = {}
        owners: dict[tuple, set] = {}
        for item, words in items:
            codes = [self.numbers.setdefault(w, len(self.numbers) + 1) for w in words]
            for at in range(max(1, len(codes) - window + 1) if codes else 0):
                owners.setdefault(tuple(codes[at:at + window]), set()).add(item)
        self.machine = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for codes, own in owners.items():
            self.machine.add_word(codes, (len(codes), frozenset(own)))
        self.machine.make_automaton()
        self.shortest = min(map(len, owners), default=0)

    def find(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set]:
        """Word ranges of all occurrences, and the items that own them."""
        spans, items = [], set()
        if not self.shortest or len(words) < self.shortest:
            return spans, items
        codes = [self.numbers.get(w, 0) for w in words]
        # Between words that no item has, only runs long enough for a window are scanned.
        start = 0
        for known, run in itertools.groupby(codes, bool):
            size = sum(1 for _ in run)
            if known and size >= self.shortest:
                for end, (length, own) in self.machine.iter(tuple(codes[start:start + size])):
                    spans.append((start + end + 1 - length, start + end + 1))
                    items |= own
            start += size
        return spans, items


def _covered(spans: list[tuple[int, int]], n: int) -> np.ndarray:
    edges = np.zeros(n + 1, np.int32)
    for start, end in spans:
        edges[start] += 1
        edges[end] -= 1
    return np.cumsum(edges[:-1]) > 0


def slices(text: bytes, window: int = WINDOW) -> Iterator[bytes]:
    """A text that is longer than ``SLICE_BYTES`` in pieces that overlap, so that every window lies whole in one of them."""
    if len(text) <= SLICE_BYTES:
        yield text
        return
    words = words_of(text)
    start, end, size = 0, 0, 0
    while end < len(words):
        # A slice has a window at least and goes on until it is full.
        while end < len(words) and (size < SLICE_BYTES or end - start < window):
            size += len(words[end]) + 1
            end += 1
        yield b" ".join(words[start:end])
        start = max(end - window + 1, start + 1)
        size = sum(len(w) + 1 for w in words[start:end])


def item_shards(benchmark: DataFrame, window: int = WINDOW) -> Iterator[list[tuple[str, bytes]]]:
    """The items in slices of bounded size; the driver holds one shard and one item at a time."""
    rows = benchmark.select(
        F.col("item_id").cast("string").alias("item"), F.col("text").cast("string").cast("binary").alias("text"),
    ).where("text is not null")
    shard, size = [], 0
    for row in rows.toLocalIterator():
        for text in slices(bytes(row["text"]), window):
            if shard and size + len(text) > SHARD_BYTES:
                yield shard
                shard, size = [], 0
            shard.append((row["item"], text))
            size += len(text)
    yield shard


FOUND = ("struct<n_words long, starts array<long>, ends array<long>, byte_starts array<long>, "
         "byte_ends array<long>, items array<string>>")


def found_in(spark: SparkSession, items: list[tuple[str, bytes]], text: Column, window: int = WINDOW) -> Column:
    """What one shard of items has in a binary text: word and byte ranges, and the items."""
    sent = spark.sparkContext.broadcast({"items": items})
    names = ["n_words", "starts", "ends", "byte_starts", "byte_ends", "items"]
    kinds = [pa.int64(), *[pa.list_(pa.int64())] * 4, pa.list_(pa.string())]

    @F.arrow_udf(FOUND)
    def run(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        # A worker keeps the value of a broadcast as long as its tasks use it.
        held = sent.value
        if "automaton" not in held:
            held["automaton"] = WindowAutomaton([(i, words_of(t)) for i, t in held["items"]], window)
        automaton = held["automaton"]
        for batch in texts:
            columns: list[list] = [[], [], [], [], [], []]
            for value in batch:
                original = value.as_py() or b""
                words = words_of(original)
                spans, own = automaton.find(words)
                covered = np.flatnonzero(np.diff(np.r_[False, _covered(spans, len(words)), False])) if spans else []
                starts, ends = list(map(int, covered[::2])), list(map(int, covered[1::2]))
                places = word_offsets(original) if spans else []
                row = (len(words), starts, ends, [places[s][0] for s in starts], [places[e - 1][1] for e in ends],
                       sorted(x for x in own if x is not None))
                for column, cell in zip(columns, row):
                    column.append(cell)
            yield pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

    return run(text)


def n_hit(found: str) -> Column:
    lengths = F.zip_with(f"{found}starts", f"{found}ends", lambda s, e: e - s)
    return F.aggregate(lengths, F.lit(0).cast("long"), lambda a, x: a + x)


def text_key(text: Column) -> Column:
    """What tells texts apart across shards; rows with one key have the same hits. Null text has none."""
    return F.sha2(text.cast("string").cast("binary"), 256)


def scan(docs: DataFrame, items: list[tuple[str, bytes]], window: int = WINDOW) -> DataFrame:
    texts = texts_of(docs)
    found = found_in(docs.sparkSession, items, F.col("text"), window)
    return texts.select("doc_id", text_key(F.col("text")).alias("key"), found.alias("f")).select("doc_id", "key", "f.*")


def _judged(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Every row with its key and its ranges and items of all shards."""
    shards = (scan(docs, shard, window) for shard in item_shards(benchmark, window))
    found, more = next(shards), None
    for at, shard in enumerate(shards):
        # The first pass gives every row; of further passes only texts with a hit matter.
        hits = shard.where(F.size("starts") > 0).withColumn("shard", F.lit(at))
        more = hits if more is None else more.unionByName(hits)
    found = found if more is None else _merge(found, more)
    return found.withColumn("n_hit", n_hit("")).withColumn("contaminated", is_contaminated())


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, n_words, n_hit, items, contaminated) with the merged word and byte ranges."""
    return _judged(docs, benchmark, window).drop("key")


def is_contaminated(found: str = "") -> Column:
    return (n_hit(found) > 0) & (n_hit(found) * HIT_SHARE >= F.col(f"{found}n_words"))


def _merge(first: DataFrame, more: DataFrame) -> DataFrame:
    """Ranges of further shards added to the first; a text is known by its key and counts once for each shard."""
    columns = ("starts", "ends", "byte_starts", "byte_ends", "items")
    once = more.groupBy("key", "shard").agg(F.first(F.struct(*columns)).alias("f")).select("key", "f.*")
    packed = once.groupBy("key").agg(*[
        F.flatten(F.collect_list(c)).alias(f"m_{c}")
        for c in columns
    ])

    @F.pandas_udf("starts array<long>, ends array<long>, byte_starts array<long>, byte_ends array<long>")
    def unite(starts: pd.Series, ends: pd.Series, byte_starts: pd.Series, byte_ends: pd.Series) -> pd.DataFrame:
        rows = []
        for cells in zip(starts, ends, byte_starts, byte_ends):
            merged: list[list[int]] = []
            for s, e, bs, be in sorted(zip(*[list(map(int, c)) for c in cells])):
                if merged and s <= merged[-1][1]:
                    if e > merged[-1][1]:
                        merged[-1][1], merged[-1][3] = e, be
                else:
                    merged.append([s, e, bs, be])
            rows.append([list(c) for c in zip(*merged)] or [[], [], [], []])
        return pd.DataFrame(rows, columns=["starts", "ends", "byte_starts", "byte_ends"])

    both = first.join(packed, "key", "left")
    joined = {c: F.concat(c, F.coalesce(f"m_{c}", F.array().cast("array<long>")))
              for c in ("starts", "ends", "byte_starts", "byte_ends")}
    items = F.array_sort(F.array_distinct(F.concat("items", F.coalesce("m_items", F.array().cast("array<string>")))))
    return both.select("doc_id", "key", "n_words", unite(*joined.values()).alias("u"), items.alias("items")).select(
        "doc_id", "key", "n_words", "u.*", "items")


def decontamination_report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    ordered = F.array_sort("items")
    return contamination(docs, benchmark).select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", ordered), 256).alias("items_sha256"), "contaminated",
    )


def clean_documents(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose text is not contaminated, with all their columns."""
    shards = item_shards(benchmark)
    first = next(shards)
    if next(shards, None) is None:
        # One shard: judged row by row, nothing is shuffled.
        packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
        text = F.col("row.text").cast("string").cast("binary")
        judged = packed.select("row", found_in(docs.sparkSession, first, text).alias("f"))
        return judged.where(~is_contaminated("f.")).select("row.*")
    bad = _judged(docs, benchmark).where("contaminated").select(F.col("key").alias("__bad")).distinct()
    return docs.join(bad, text_key(docs["text"]) == bad["__bad"], "left_anti")
