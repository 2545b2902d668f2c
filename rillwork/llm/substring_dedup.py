"""Substring dedup: remove words inside passages that occur earlier in the corpus.

A window is ``WINDOW`` consecutive words. It belongs to the anchor that has the smallest hash among its
runs of ``GRAM`` words, so equal windows share an anchor wherever they stand. Consecutive windows with the same
anchor make a segment. Anchors that occur once end there. Of the others, a segment that occurred before
word by word is covered whole. The first occurrences of different segments of an anchor are the
reference text of that anchor: a task builds a suffix automaton of them in corpus order and streams
each segment through it before adding it; where the matching statistic reaches the window length, the
words were there earlier. The automata are not broadcast: the reference is the corpus itself, so it is
cut into anchors, and an automaton and all segments it must judge meet in one task. An anchor
with more than ``HOT`` different segments is cut further, into single windows.

* Null or empty text has no words. A row with null doc_id keeps all its words and counts for nothing.
* doc_id is the key: rows that repeat one are the same document, neither earlier than the other.
* Order is (doc_id, position of the first word). A very long text is worked on in slices that
  overlap by a window, and no window is lost between them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillwork.llm.common import map_batches, stored, texts_of

# Words of a window and of an anchor, words of a slice, segments of a hot anchor.
WINDOW = 20
GRAM = 6
SLICE = 1 << 18
HOT = 4096
_MIX = np.uint64(0xBF58476D1CE4E5B9)
_BASE = 0x9E3779B97F4A7C15


class SuffixAutomaton:
    """Online suffix automaton of several word sequences."""

    def __init__(self) -> None:
        self.edges: list[dict] = [{}]
        self.link = [-1]
        self.length = [0]

    def _state(self, length: int, edges: dict, link: int) -> int:
        self.edges.append(edges)
        self.length.append(length)
        self.link.append(link)
        return len(self.edges) - 1

    def _split(self, at: int, word: object) -> int:
        """The state of the longest suffix at ``at`` followed by ``word``, split off if it must be."""
        target = self.edges[at][word]
        if self.length[target] == self.length[at] + 1:
            return target
        clone = self._state(self.length[at] + 1, dict(self.edges[target]), self.link[target])
        self.link[target] = clone
        while at >= 0 and self.edges[at].get(word) == target:
            self.edges[at][word] = clone
            at = self.link[at]
        return clone

    def add(self, words: list) -> None:
        last = 0
        for word in words:
            if word in self.edges[last]:
                last = self._split(last, word)
                continue
            new = self._state(self.length[last] + 1, {}, 0)
            at = last
            while at >= 0 and word not in self.edges[at]:
                self.edges[at][word] = new
                at = self.link[at]
            if at >= 0:
                self.link[new] = self._split(at, word)
            last = new

    def matching(self, words: list) -> list[int]:
        """For each word the longest run that ends with it and occurs in the automaton."""
        edges, link, length = self.edges, self.link, self.length
        at, run, out = 0, 0, []
        for word in words:
            while at and word not in edges[at]:
                at = link[at]
                run = length[at]
            if word in edges[at]:
                at = edges[at][word]
                run += 1
            else:
                run = 0
            out.append(run)
        return out


class Segmenter:
    """Anchors and segments of a text; holds powers that all texts of a task share."""

    def __init__(self, window: int = WINDOW, gram: int = GRAM):
        self.window, self.gram = window, gram
        base, inverse = np.uint64(_BASE), np.uint64(pow(_BASE, -1, 1 << 64))
        size = SLICE + window + 1
        self.up = np.multiply.accumulate(np.r_[np.uint64(1), np.full(size, base, np.uint64)])
        self.down = np.multiply.accumulate(np.r_[np.uint64(1), np.full(size, inverse, np.uint64)])

    def segments(self, words: list[bytes]) -> tuple[np.ndarray, ...]:
        """(anchor, segment hash, first window, number of windows)."""
        parts = [self._slice(words[at:at + SLICE + self.window - 1], at)
                 for at in range(0, max(1, len(words) - self.window + 1), SLICE)]
        return tuple(np.concatenate(p) for p in zip(*parts))

    def _slice(self, words: list[bytes], offset: int) -> tuple[np.ndarray, ...]:
        count = len(words) - self.window + 1
        if count <= 0:
            return (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32))
        hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
        grams = hashes[: len(words) - self.gram + 1].copy()
        for at in range(1, self.gram):
            grams = grams * np.uint64(_BASE) + hashes[at:at + len(grams)]
        grams = (grams ^ (grams >> np.uint64(31))) * _MIX
        # Smallest gram of each window, the leftmost of equals: upper bits order, lower bits place.
        place = np.uint64((1 << 20) - 1)
        low = (grams & ~place) | np.arange(len(grams), dtype=np.uint64)
        width, span = self.window - self.gram + 1, 1
        while 2 * span <= width:
            low, span = np.minimum(low[:-span], low[span:]), 2 * span
        if span < width:
            low = np.minimum(low[: len(low) - (width - span)], low[width - span:])
        at = (low[:count] & place).astype(np.int64)
        first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
        size = np.diff(np.r_[first, count])
        total = np.r_[np.uint64(0), np.cumsum(hashes * self.down[: len(hashes)], dtype=np.uint64)]
        segment = (total[first + size + self.window - 1] - total[first]) * self.up[first]
        segment = (segment ^ (segment >> np.uint64(33))) * _MIX + size.astype(np.uint64)
        return grams[at[first]].view(np.int64), segment.view(np.int64), first + offset, size.astype(np.int32)


def _anchor_counts(texts: DataFrame) -> DataFrame:
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        cut = Segmenter()
        found = [cut.segments((t.as_py() or b"").split())[0] for t in batch["text"]]
        anchors, counts = np.unique(np.concatenate(found), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(anchors), pa.array(counts)], ["anchor", "n"])

    return map_batches(texts, run, "anchor long, n long").groupBy("anchor").agg(F.sum("n").alias("n"))


def _segments(texts: DataFrame) -> DataFrame:
    """(anchor, segment, doc_id, start, size) of every text."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        cut = Segmenter()
        found = [cut.segments((t.as_py() or b"").split()) for t in batch["text"]]
        ids = np.repeat(batch["doc_id"].to_numpy(), [len(f[0]) for f in found])
        anchor, segment, start, size = (np.concatenate(p) for p in zip(*found))
        columns = [anchor, segment, ids, start, size]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["anchor", "segment", "doc_id", "start", "size"])

    return map_batches(texts, run, "anchor long, segment long, doc_id long, start long, size int")


def _passages(texts: DataFrame, places: DataFrame) -> DataFrame:
    """(anchor, hot, doc_id, start, passage) with the words of (anchor, hot, doc_id, start, size);
    those of a hot anchor come as single windows."""
    wanted = places.groupBy("doc_id").agg(F.collect_list(F.struct("anchor", "hot", "start", "size")).alias("places"))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows: list[list] = [[], [], [], [], []]
        for doc_id, text, places in zip(batch["doc_id"].to_pylist(), batch["text"], batch["places"].to_pylist()):
            words = (text.as_py() or b"").split()
            for p in places:
                step, size = (1, 1) if p["hot"] else (p["size"], p["size"])
                for at in range(p["start"], p["start"] + p["size"], step):
                    passage = b" ".join(words[at:at + size + WINDOW - 1])
                    for column, cell in zip(rows, (p["anchor"], p["hot"], doc_id, at, passage)):
                        column.append(cell)
        kinds = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.binary()]
        return pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(rows, kinds)], ["anchor", "hot", "doc_id", "start", "passage"])

    joined = texts.join(wanted, "doc_id").select("doc_id", "text", "places")
    return map_batches(joined, run, "anchor long, hot boolean, doc_id long, start long, passage binary")


def _matched(passages: DataFrame) -> DataFrame:
    """(doc_id, start, size): windows of a passage that an earlier passage of its anchor holds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchor, automaton, waiting = None, None, None
        for batch in batches:
            rows: list[list] = [[], [], []]
            for own, doc_id, start, passage in zip(*[batch[c].to_pylist() for c in ("anchor", "doc_id", "start", "passage")]):
                words = passage.split()
                if own != anchor:
                    anchor, automaton = own, SuffixAutomaton()
                else:
                    automaton.add(waiting)
                    runs = automaton.matching(words)
                    ends = [e for e, run in enumerate(runs) if run >= WINDOW]
                    first = None
                    for at, end in enumerate(ends):
                        first = end if first is None else first
                        if at + 1 == len(ends) or ends[at + 1] != end + 1:
                            for column, cell in zip(rows, (doc_id, start + first - WINDOW + 1, end - first + 1)):
                                column.append(cell)
                            first = None
                waiting = words  # added when a later passage of the same anchor comes
            yield pa.RecordBatch.from_arrays(
                [pa.array(rows[0], pa.int64()), pa.array(rows[1], pa.int64()), pa.array(rows[2], pa.int32())],
                ["doc_id", "start", "size"])

    met = passages.repartition(F.col("anchor")).sortWithinPartitions("anchor", "doc_id", "start")
    return met.select("anchor", "doc_id", "start", "passage").mapInArrow(run, "doc_id long, start long, size int")


def covered_spans(texts: DataFrame) -> DataFrame:
    """(doc_id, start, size): runs of windows whose words occur earlier in the corpus."""
    texts = texts.where("doc_id is not null")
    repeated = stored(_anchor_counts(texts).where("n > 1").select("anchor"), "anchors")
    segments = stored(_segments(texts).join(repeated.hint("merge"), "anchor"), "segments")
    place = F.min(F.struct("doc_id", "start", "size")).alias("first")
    firsts = segments.groupBy("anchor", "segment").agg(place, F.count(F.lit(1)).alias("n"))
    firsts = stored(firsts.select("anchor", "segment", "n", "first.*"), "firsts")

    # A segment that was there before.
    first = firsts.where("n > 1").select(
        "anchor", "segment", F.col("doc_id").alias("first_doc"), F.col("start").alias("first_start"))
    later = segments.join(first.hint("merge"), ["anchor", "segment"])
    later = later.where("doc_id <> first_doc or start <> first_start").select("doc_id", "start", "size")

    # Different segments of one anchor.
    several = firsts.groupBy("anchor").agg(F.count(F.lit(1)).alias("kinds")).where("kinds > 1")
    several = stored(several.select("anchor", (F.col("kinds") > HOT).alias("hot")), "several")
    places = firsts.join(several.hint("merge"), "anchor").select("anchor", "hot", "doc_id", "start", "size")
    passages = stored(_passages(texts, places), "passages")
    matched = _matched(passages.where("not hot"))

    windows = passages.where("hot")
    earliest = windows.groupBy("passage").agg(
        F.min(F.struct("doc_id", "start")).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    earliest = stored(earliest.select("passage", "first"), "earliest")
    again = windows.join(earliest.hint("merge"), "passage").where(F.struct("doc_id", "start") != F.col("first"))
    again = again.select("doc_id", "start", F.lit(1).alias("size"))
    return later.unionByName(matched).unionByName(again)


def remove_repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_removed, kept) of every row; ``kept`` is the remaining words, joined by a blank."""
    texts = texts_of(docs)
    spans = covered_spans(texts).groupBy("doc_id").agg(F.collect_list(F.struct("start", "size")).alias("spans"))

    @F.pandas_udf("n_words long, n_removed long, kept string")
    def rebuild(text: pd.Series, spans: pd.Series) -> pd.DataFrame:
        rows = []
        for value, covered in zip(text, spans):
            words = (value or b"").split()
            edges = np.zeros(len(words) + 1, np.int64)
            for span in covered if covered is not None else ():
                edges[min(span["start"], len(words))] += 1
                edges[min(span["start"] + span["size"] + WINDOW - 1, len(words))] -= 1
            stay = np.cumsum(edges[:-1]) == 0
            kept = words if stay.all() else [w for w, s in zip(words, stay) if s]
            rows.append((len(words), len(words) - len(kept), b" ".join(kept).decode("utf-8", "replace")))
        return pd.DataFrame(rows, columns=["n_words", "n_removed", "kept"])

    joined = texts.join(spans, "doc_id", "left")
    return joined.select("doc_id", rebuild("text", "spans").alias("r")).select("doc_id", "r.*")


def substring_dedup_report(docs: DataFrame) -> DataFrame:
    return remove_repeats(docs).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
