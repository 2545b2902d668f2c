"""Phrase collocations from a weighted de Bruijn graph of words.

Texts are split into pieces and words. Every word occurrence starts one gram: the next ``LONGEST`` words, or
fewer where the piece ends. Full grams are the edges of the graph, from the node of their first words to the
node of their last; shorter grams are the ends of pieces. Equal grams are added up, in the tasks first.

A shorter phrase occurs as often as grams start with it: its count is the flow out of its node, plus the
pieces that end within it. In the order of their words all grams that start with a phrase follow each
other, so one pass over sorted ranges of grams gives the counts of all lengths. A phrase that a stretch of a
range holds whole is dropped there if it is rare; one that may go on in the next stretch leaves as a partial
sum, at most ``LONGEST`` at either end. So a frequent phrase is split over ranges like any other. Grams travel
sorted and compressed, which takes a third of the space of rows. Bounds of ranges come from a bounded sample;
there are at most ``SAMPLE`` of them.

A node whose whole flow runs through one edge is an inner place of a unary path, and compacting the path
leaves the longer phrase only. As counts never grow with length, a phrase lies in a longer one of at least
equal count just if one of its extensions by one word on either side has the same count.

Words that are rare in their language can be in no candidate. Their places end a piece: a bitmap of fixed
size over the frequent words tells them. Where two words share a bit a rare word stays, which costs work
but changes nothing.

* Null text is empty; a null language counts as ``und``. Rows are counted as often as they are there, whatever
  their doc_id; extra columns are not read. Empty tables and texts without words give no rows.
* Words are bytes of UTF-8, only A-Z are lower-cased. Very long texts and pieces are worked on as they stream.
* Scores are exact (38 digits). Ties of a score go to the larger count, then to the smaller phrase.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rillwork.llm.common import stored
from rillwork.session import broadcast_if_small

# Language of rows without one, ends of pieces, bits of the bitmap, words that a task gathers
# before it adds up, and bytes of a text that are cut into words at once.
NONE = "und"
ENDS = b".,;:!?\n\x0b\x0c\r"
BITS = 26
GATHERED = 1 << 20
SLICE = 1 << 22
# Words for each range of grams (its grams are put in order in one task's memory), the sample that the ranges come from
# (words, and rows that the driver takes in), and grams that are added up at once.
RANGE = 1 << 21
SAMPLE = 1 << 18
STEP = 1 << 17
#: Words of the longest phrase, least count of a candidate, phrases given per language.
LONGEST, LEAST, FIRST = 5, 100, 2000

#: Exact up to 38 digits; integer division rounds down.
SCORE = "(1000 * CAST(a AS DECIMAL(17, 0)) * CAST(n AS DECIMAL(17, 0))) DIV (CAST(l AS DECIMAL(19, 0)) * CAST(r AS DECIMAL(19, 0)))"

# A-Z in lower case, tabs as spaces, ends of pieces as line feeds.
_FOLD = bytes(10 if c in ENDS else 32 if c == 9 else c + 32 if 65 <= c <= 90 else c for c in range(256))
# Words of a gram are joined by a byte below all others; the two lowest bytes are written as pairs.
_JOINT = b"\0"


def tokens(text: bytes) -> Iterator[list[bytes]]:
    """Slices of a text as words, line feeds for ends of pieces and empty tokens."""
    at = 0
    while at < len(text):
        end = text.find(b" ", at + SLICE) if at + SLICE < len(text) else -1
        part = (text[at:end] if end >= 0 else text[at:]).translate(_FOLD)
        if b"\0" in part or b"\1" in part:
            part = part.replace(b"\1", b"\1\2").replace(b"\0", b"\1\1")
        yield part.replace(b"\n", b" \n ").split(b" ")
        at = end + 1 if end >= 0 else len(text)


def word_counts(texts: DataFrame) -> DataFrame:
    """(lang, word, n) over all occurrences."""

    def rows(sums: dict[str, Counter]) -> Iterator[pa.RecordBatch]:
        while sums:
            lang, own = sums.popitem()
            own.pop(b"", None)
            own.pop(b"\n", None)
            columns = [pa.array([lang] * len(own), pa.string()), pa.array(list(own), pa.binary()), pa.array(list(own.values()), pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["lang", "word", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, Counter] = {}
        gathered = 0
        for batch in batches:
            for lang, text in zip(batch["lang"].to_pylist(), batch["text"]):
                own = sums.setdefault(lang, Counter())
                before = len(own)
                for part in tokens(text.as_py()):
                    own.update(part)
                gathered += len(own) - before
                if gathered > GATHERED // 4:
                    yield from rows(sums)
                    gathered = 0
        yield from rows(sums)

    return texts.mapInArrow(run, "lang string, word binary, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def frequent_bits(frequent: DataFrame) -> np.ndarray:
    """Bitmap of 2 ** ``BITS`` bits over (lang, word); of that size however many words there are."""
    place = F.crc32(F.concat(F.col("lang").cast("binary"), F.lit(b"\0"), "word")).bitwiseAND(F.lit((1 << BITS) - 1))
    held = frequent.select(place.alias("place")).groupBy(F.shiftright("place", 3).alias("at")).agg(
        F.expr("bit_or(shiftleft(1, CAST(place & 7 AS INT)))").alias("bits"))
    rows = held.select(F.col("at").cast("int").alias("at"), F.col("bits").cast("int").alias("bits")).toArrow()
    bits = np.zeros(1 << (BITS - 3), np.uint8)
    bits[rows["at"].to_numpy()] = rows["bits"].to_numpy()
    return bits


class Vocabulary(dict):
    """Numbers of the words of one language: 0 ends a run (an end of a piece, a rare word), -1 is no word. Rare words,
    most of all different ones, are told anew each time and take no memory."""

    def __init__(self, lang: str, bits: bytes):
        super().__init__({b"": -1, b"\n": 0})
        self.start, self.bits, self.words = zlib.crc32(lang.encode() + b"\0"), bits, [b""]

    def __missing__(self, word: bytes) -> int:
        place = zlib.crc32(word, self.start) & ((1 << BITS) - 1)
        if not self.bits[place >> 3] >> (place & 7) & 1:
            return 0
        self[word] = number = len(self.words)
        self.words.append(word)
        return number


def _edges(numbers: np.ndarray, words: list[bytes], longest: int) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """The grams of a run of word numbers and their counts, in the order of their words, ``STEP`` at a time: numbers take
    far less memory than the grams they stand for."""
    numbers = numbers[numbers >= 0]
    for at in range(0, len(numbers), GATHERED):
        part = numbers[at:at + GATHERED + longest - 1]
        here = np.unique(part[part > 0])
        names = [words[i] for i in here]
        order = sorted(range(len(names)), key=names.__getitem__)
        rank = np.zeros(len(words), np.int32)
        rank[here[order]] = np.arange(1, len(here) + 1)
        part = rank[part]
        begins = np.flatnonzero(part[:GATHERED]).astype(np.int32)
        if not len(begins):
            continue
        # Three ranks of 21 bits to a key: a part has no more words than that.
        keys = [np.zeros(len(begins), np.int64) for _ in range(0, longest, 3)]
        whole = np.ones(len(begins), bool)
        for shift in range(longest):
            after = np.zeros(len(begins), np.int64)
            inside = begins < len(part) - shift
            after[inside] = part[begins[inside] + shift]
            whole &= after > 0
            after[~whole] = 0
            keys[shift // 3] |= after << 42 - 21 * (shift % 3)
        sort = np.lexsort(keys[::-1])
        keys = [key[sort] for key in keys]
        first = np.flatnonzero(np.r_[True, np.logical_or.reduce([key[1:] != key[:-1] for key in keys])])
        counts = np.diff(np.r_[first, len(sort)])
        keys = [key[first] for key in keys]
        named = pa.array([names[i] for i in order], pa.binary())
        for low in range(0, len(first), STEP):
            ranks = [keys[shift // 3][low:low + STEP] >> 42 - 21 * (shift % 3) & (1 << 21) - 1 for shift in range(longest)]
            yield pc.binary_join_element_wise(
                *[named.take(pa.array(c - 1, mask=c == 0)) for c in ranks], pa.scalar(_JOINT, pa.binary()),
                null_handling="skip"), counts[low:low + STEP]


def _grams(texts: DataFrame, bits: Broadcast, longest: int, emit: Callable, schema: str) -> DataFrame:
    """Rows that ``emit(lang, grams, counts)`` makes of the longest gram from each place of the texts, cut at ends of
    pieces and at rare words. A task gathers a bounded number of words before it adds up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, Vocabulary] = {}
        waiting: dict[str, list[np.ndarray]] = {}
        gathered = 0

        def flush() -> Iterator[pa.RecordBatch]:
            while waiting:
                lang, parts = waiting.popitem()
                for grams, counts in _edges(np.concatenate(parts), known[lang].words, longest):
                    yield emit(lang, grams, counts)
            if sum(map(len, known.values())) > GATHERED // 2:
                known.clear()

        for batch in batches:
            for lang, text in zip(batch["lang"].to_pylist(), batch["text"]):
                own = known.get(lang) or known.setdefault(lang, Vocabulary(lang, bits.value))
                parts = waiting.setdefault(lang, [])
                for part in tokens(text.as_py()):
                    parts.append(np.fromiter(map(own.__getitem__, part), np.int32, len(part)))
                    gathered += len(part)
                parts.append(np.zeros(1, np.int32))
                if gathered > GATHERED:
                    yield from flush()
                    gathered = 0
        yield from flush()

    return texts.mapInArrow(run, schema)


def ranges(texts: DataFrame, bits: Broadcast, longest: int, words: int) -> list[tuple[str, bytes]]:
    """Bounds (lang, gram) between ranges of grams, about one for ``RANGE`` words, from a bounded sample of the texts.

    They decide which task adds up a gram, nothing else.
    """

    def emit(lang: str, grams: pa.Array, counts: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(lang), len(grams)), grams], ["lang", "gram"])

    sample = texts.sample(min(1.0, SAMPLE / max(1, words)), 5)
    rows = sorted((r["lang"], bytes(r["gram"])) for r in _grams(sample, bits, longest, emit, "lang string, gram binary").limit(SAMPLE).toLocalIterator())
    count = min(len(rows), words // RANGE)
    return sorted({rows[len(rows) * at // (count + 1)] for at in range(1, count + 1)})


def packed(texts: DataFrame, bits: Broadcast, longest: int, bounds: Broadcast) -> DataFrame:
    """(part, lang, length, size, grams): sorted grams of one range with their counts, compressed."""

    def emit(lang: str, grams: pa.Array, counts: np.ndarray) -> pa.RecordBatch:
        held = bounds.value
        low, high = bisect_left(held, (lang, b"")), bisect_left(held, (lang + "\0", b""))
        cuts = [bisect_left(range(len(grams)), gram, key=lambda i: grams[i].as_py()) for _, gram in held[low:high]]
        ends = np.array([0, *cuts, len(grams)], np.int32)
        joined = pc.binary_join(pa.ListArray.from_arrays(ends, grams), pa.scalar(b"\n", pa.binary()))
        out: tuple[list, ...] = ([], [], [], [])
        for at in np.flatnonzero(np.diff(ends)).tolist():
            raw = counts[ends[at]:ends[at + 1]].astype(np.int64).tobytes() + joined[at].as_py()
            for column, value in zip(out, (low + at, int(ends[at + 1] - ends[at]), len(raw), pa.compress(raw, "zstd", asbytes=True))):
                column.append(value)
        parts, lengths, sizes, blobs = out
        return pa.RecordBatch.from_arrays(
            [pa.array(parts, pa.int32()), pa.repeat(pa.scalar(lang), len(parts)), pa.array(lengths, pa.int32()), pa.array(sizes, pa.int64()),
             pa.array(blobs, pa.binary())], ["part", "lang", "length", "size", "grams"])

    return _grams(texts, bits, longest, emit, "part int, lang string, length int, size long, grams binary")


def _flow(lang: str, grams: pa.Array, n: np.ndarray, least: int, longest: int) -> pa.RecordBatch:
    """Phrases that sorted grams start with, and how often. A phrase that they hold whole is dropped if it is rare;
    the first and the last one may go on outside and leave as partial sums."""
    size = len(grams)
    words = pc.list_slice(pc.split_pattern(grams, _JOINT), 0, longest, return_fixed_size_list=True).flatten()
    columns = [words.take(pa.array(np.arange(size) * longest + at)) for at in range(longest)]
    differs, out = np.zeros(size - 1, bool), []
    for at, column in enumerate(columns):
        filled = pc.fill_null(column, _JOINT)
        differs = differs | pc.not_equal(filled.slice(1), filled.slice(0, size - 1)).to_numpy(zero_copy_only=False)
        starts = np.flatnonzero(np.r_[True, differs])
        sums = np.add.reduceat(n, starts)
        kept = sums >= least
        kept[[0, -1]] = True
        kept &= column.is_valid().to_numpy(zero_copy_only=False)[starts]
        place = pa.array(starts[kept])
        phrase = pc.binary_join_element_wise(*[c.take(place) for c in columns[:at + 1]], pa.scalar(b" ", pa.binary()))
        phrase = pc.replace_substring(pc.replace_substring(phrase, b"\1\1", b"\0"), b"\1\2", b"\1")
        out.append(pa.RecordBatch.from_arrays(
            [pa.repeat(pa.scalar(lang), len(place)), phrase, pa.repeat(pa.scalar(at + 1, pa.int32()), len(place)), pa.array(sums[kept])],
            ["lang", "phrase", "size", "n"]))
    return pa.Table.from_batches(out).combine_chunks().to_batches()[0]


def phrase_counts(parts: DataFrame, least: int = LEAST, longest: int = LONGEST) -> DataFrame:
    """(lang, phrase, size, n) of all phrases that the grams of ``packed`` start with at least ``least`` times."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A range arrives row after row; it is unpacked, put in order and added up."""
        own, counts, grams = None, [], []

        def flush() -> Iterator[pa.RecordBatch]:
            if grams:
                every, n = pa.concat_arrays(grams), np.concatenate(counts)
                grams.clear()
                counts.clear()
                order = pc.sort_indices(every)
                for at in range(0, len(n), STEP):
                    here = order.slice(at, STEP)
                    yield _flow(own[1], every.take(here), n[here.to_numpy()], least, longest)

        for batch in batches:
            fixed = [batch[name].to_pylist() for name in ("part", "lang", "length", "size")]
            for part, lang, length, size, blob in zip(*fixed, batch["grams"]):
                if (part, lang) != own:
                    yield from flush()
                    own = (part, lang)
                raw = pa.decompress(blob.as_buffer(), size, "zstd", asbytes=True)
                counts.append(np.frombuffer(raw, np.int64, length).copy())
                grams.append(pc.split_pattern(pa.array([raw[8 * length:]], pa.binary()), b"\n").flatten())
        yield from flush()

    dealt = parts.repartition("part", "lang").sortWithinPartitions("part", "lang")
    found = dealt.mapInArrow(run, "lang string, phrase binary, size int, n long")
    return found.groupBy("lang", "phrase", "size").agg(F.sum("n").alias("n")).where(F.col("n") >= least).select(
        "lang", F.col("phrase").cast("string").alias("phrase"), "size", "n")


def compacted(phrases: DataFrame) -> DataFrame:
    """The phrases of two words or more without those whose whole flow runs through a longer one."""
    words = F.split("phrase", " ")
    inner = F.array(F.array_join(F.slice(words, 1, F.col("size") - 1), " "), F.array_join(F.slice(words, 2, F.col("size") - 1), " "))
    longer = phrases.where("size > 2").select("lang", F.explode(inner).alias("phrase"), "n")
    most = longer.groupBy("lang", "phrase").agg(F.max("n").alias("longer"))
    met = phrases.where("size > 1").join(most, ["lang", "phrase"], "left")
    return met.where(F.col("longer").isNull() | (F.col("longer") < F.col("n"))).drop("longer")


def collocations(docs: DataFrame, longest: int = LONGEST, least: int = LEAST, first: int = FIRST) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the ``first`` collocations of each language."""
    texts = docs.select(
        F.coalesce(F.col("lang").cast("string"), F.lit(NONE)).alias("lang"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text"))
    counts = stored(word_counts(texts), "words")
    total = counts.groupBy("lang").agg(F.sum("n").alias("total"))
    send = docs.sparkSession.sparkContext.broadcast
    bits = send(frequent_bits(counts.where(F.col("n") >= least)).tobytes())
    bounds = send(ranges(texts, bits, longest, counts.agg(F.sum("n")).first()[0] or 0))
    phrases = stored(phrase_counts(packed(texts, bits, longest, bounds), least, longest), "phrases")

    words = F.split("phrase", " ")
    cuts = compacted(phrases).select("lang", "phrase", F.col("n").alias("a"), "size", words.alias("words"),
                                     F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("cut"))
    cuts = cuts.select("lang", "phrase", "a", "cut", F.array_join(F.slice("words", F.lit(1), F.col("cut")), " ").alias("head"),
                       F.array_join(F.slice("words", F.col("cut") + 1, F.col("size") - F.col("cut")), " ").alias("tail"))
    part = broadcast_if_small(phrases, stored=True)
    heads = part.select("lang", F.col("phrase").alias("head"), F.col("n").alias("l"))
    tails = part.select("lang", F.col("phrase").alias("tail"), F.col("n").alias("r"))
    sides = cuts.join(heads, ["lang", "head"]).join(tails, ["lang", "tail"]).join(broadcast_if_small(total.withColumnRenamed("total", "n")), "lang")
    lowest = sides.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct(F.expr(SCORE).alias("score"), "cut", "l", "r")).alias("low"))
    found = lowest.select("lang", "phrase", "a", "low.l", "low.r", "n", "low.score")
    rank = F.row_number().over(W.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    ranked = found.withColumn("rank", rank).where(F.col("rank") <= first)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
