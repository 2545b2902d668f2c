"""Near-duplicate groups: min-max hashing, banding and exact links.

Each document becomes its set of distinct word shingles (64-bit hashes). One hash function gives two
signature values, its minimum and its maximum over the set, so a signature costs half the evaluations.
Bands of ``ROWS`` values are buckets; their number follows from the threshold, so that a pair at the
threshold shares a bucket with a chance of all but ``MISS``. Documents with equal sets stand in for
each other. Then:

1. every member of a bucket is checked against the bucket's smallest document (a star, not all pairs);
   a byte of each signature value rules out pairs far below the threshold, full sets decide;
2. components are formed. In buckets that still hold several components, pairs between components
   are judged on full sets, in blocks of bounded size, which hand back spanning links only.

No pair is left out of a bucket and nothing is capped. All pairs inside one component are implied.

* Null or empty text and text without words has an empty set: linked with nothing, kept.
* Rows with the same doc_id are one node; each row comes back with its own set size. A row with
  null doc_id is linked with nothing, has null component_id and is kept.
* Ties: the component and the kept document carry the smallest doc_id.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillwork.llm.common import map_batches, stored, texts_of
from rillwork.llm.components import components

# Rows of a band, accepted chance to miss a pair at the threshold, members and shingles of
# a block (of many short or of few long documents).
ROWS = 5
MISS = 1e-6
BLOCK = 2048
BLOCK_SHINGLES = 1 << 21
_SLICE = 4096
_MIX = np.uint64(0xBF58476D1CE4E5B9)


def shingle_set(text: bytes | None, size: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of ``size`` words (A-Z lower-cased)."""
    words = (text or b"").lower().split()  # bytes: A-Z and ASCII white space only
    if not words:
        return np.zeros(0, np.uint64)
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    span = min(size, len(words))
    state = np.full(len(words) - span + 1, span, np.uint64)
    for at in range(span):
        state = state * np.uint64(0x9E3779B97F4A7C15) + hashes[at:at + len(state)]
        state ^= state >> np.uint64(32)
    return np.unique(state * _MIX)


def bands_for(threshold: float, rows: int = ROWS) -> int:
    """Bands, so that a pair at the threshold is missed with a chance of ``MISS`` at most."""
    bands = math.ceil(math.log(MISS) / math.log(1 - threshold**rows))
    return bands + bands % 2  # an even number of values: minimum and maximum of each hash


def agreement_needed(threshold: float, values: int) -> int:
    """Equal signature bytes below which a pair lies 4.7 deviations under the threshold."""
    return math.floor(values * (threshold - 4.7 * math.sqrt(threshold * (1 - threshold) / values)))


def hash_family(values: int, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    draws = np.random.default_rng(seed).integers(1, 1 << 63, (2, values // 2), dtype=np.uint64)
    return draws[0] | np.uint64(1), draws[1]


def minmax_signature(shingles: np.ndarray, family: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """[min, max] of each hash function over a set, one after another."""
    factor, shift = family
    low = np.full(len(factor), np.iinfo(np.uint64).max, np.uint64)
    high = np.zeros(len(factor), np.uint64)
    for at in range(0, len(shingles), _SLICE):
        values = (shingles[None, at:at + _SLICE] ^ shift[:, None]) * factor[:, None]
        low, high = np.minimum(low, values.min(axis=1)), np.maximum(high, values.max(axis=1))
    return np.stack([low, high], axis=1).ravel()


def sign(texts: DataFrame, size: int, threshold: float) -> DataFrame:
    """(doc_id, n, mark, bands, sig) of (doc_id, text): set size, 128-bit mark of the set, bucket
    keys and one byte of every signature value."""
    count = bands_for(threshold)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        family = hash_family(count * ROWS)
        sizes, marks, bands, sigs = [], [], [], []
        for text in batch["text"]:
            shingles = shingle_set(text.as_py(), size)
            sizes.append(len(shingles))
            if not len(shingles):
                marks.append(b"")
                bands.append([])
                sigs.append(b"")
                continue
            marks.append(xxhash.xxh3_128_digest(shingles.tobytes()))
            values = minmax_signature(shingles, family)
            keys = np.arange(1, count + 1, dtype=np.uint64)
            for row in values.reshape(count, ROWS).T:
                keys = (keys ^ row) * np.uint64(0x9E3779B97F4A7C15)
                keys ^= keys >> np.uint64(29)
            bands.append((keys * _MIX).view(np.int64))
            sigs.append(((values * _MIX) >> np.uint64(56)).astype(np.uint8).tobytes())
        columns = [batch["doc_id"], pa.array(sizes, pa.int64()), pa.array(marks, pa.binary()),
                   pa.array(bands, pa.list_(pa.int64())), pa.array(sigs, pa.binary())]
        return pa.RecordBatch.from_arrays(columns, ["doc_id", "n", "mark", "bands", "sig"])

    return map_batches(texts, run, "doc_id long, n long, mark binary, bands array<long>, sig binary")


def _bytes(column: pa.Array, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), width)


def _alike(pairs: DataFrame, signed: DataFrame, need: int, width: int) -> DataFrame:
    """Of (a, b) pairs those whose signatures do not rule them out."""
    left = signed.select(F.col("doc_id").alias("a"), F.col("sig").alias("sig_a"))
    right = signed.select(F.col("doc_id").alias("b"), F.col("sig").alias("sig_b"))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        equal = (_bytes(batch["sig_a"], width) == _bytes(batch["sig_b"], width)).sum(axis=1)
        return batch.filter(pa.array(equal >= need)).select(["a", "b"])

    return map_batches(pairs.join(left, "a").join(right, "b"), run, "a long, b long")


def is_linked(common: int, union: int, threshold: float) -> bool:
    """Compared in whole hundredths, as thresholds are given."""
    return 100 * common >= round(100 * threshold) * union


def _confirm(pairs: DataFrame, texts: DataFrame, size: int, threshold: float) -> DataFrame:
    """Of (a, b) pairs those whose full sets reach the threshold."""
    left = texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, center = None, None
        for batch in batches:
            linked = []
            for text_a, text_b in zip(batch["text_a"], batch["text_b"]):
                text_b = text_b.as_py()
                if last is None or text_b != last:  # rows come in the order of b
                    last, center = text_b, shingle_set(text_b, size)
                own = shingle_set(text_a.as_py(), size)
                common = len(np.intersect1d(own, center, assume_unique=True))
                linked.append(is_linked(common, len(own) + len(center) - common, threshold))
            yield batch.filter(pa.array(linked, pa.bool_())).select(["a", "b"])

    joined = pairs.join(left, "a").join(right.hint("merge"), "b")
    return joined.select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long")


def _blocks(members: DataFrame) -> DataFrame:
    """Members of a bucket dealt to pairs (i, j) of blocks of bounded size; a small bucket is (0, 0)."""
    n = F.greatest(F.ceil(F.col("size") / BLOCK), F.ceil(F.col("shingles") / BLOCK_SHINGLES)).cast("int")
    own = F.pmod(F.xxhash64("doc_id"), n).cast("int")
    pairs = F.transform(
        F.sequence(F.lit(0), n - 1), lambda j: F.struct(F.least(own, j).alias("i"), F.greatest(own, j).alias("j")))
    return members.withColumn("own", own).withColumn("p", F.explode(pairs)).select(
        "band", "p.i", "p.j", "own", *[c for c in members.columns if c not in ("band", "size", "shingles")])


def _meetings(members: DataFrame, need: int, width: int) -> DataFrame:
    """(band, i, j, own, doc_id, component) of members that have a pair in another component which
    signatures do not rule out; each pair is left to the first band that both share."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        band, i, j = key
        sig = np.frombuffer(b"".join(rows["sig"]), np.uint8).reshape(len(rows), width)
        bands = np.stack(rows["bands"].to_numpy())
        own, component = rows["own"].to_numpy(), rows["component"].to_numpy()
        hit = np.zeros(len(rows), bool)
        for x in range(len(rows) - 1):
            other = np.flatnonzero((component[x + 1:] != component[x]) & ((i == j) | (own[x + 1:] != own[x]))) + x + 1
            other = other[(sig[other] == sig[x]).sum(axis=1) >= need]
            if len(other):
                first = (bands[other] == bands[x]).argmax(axis=1)
                other = other[bands[x][first] == band]
                hit[other] = True
                hit[x] |= len(other) > 0
        return rows.loc[hit, ["band", "i", "j", "own", "doc_id", "component"]]

    return members.groupBy("band", "i", "j").applyInPandas(
        run, "band long, i int, j int, own int, doc_id long, component long")


def _bridges(met: DataFrame, size: int, threshold: float) -> DataFrame:
    """Links between components inside one block pair, judged on full sets; spanning links only."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        _, i, j = key
        rows = rows.sort_values("doc_id", kind="stable")
        sets = [shingle_set(t, size) for t in rows["text"]]
        sizes = np.array([len(s) for s in sets], np.int64)
        _, codes = np.unique(np.concatenate(sets), return_inverse=True)
        starts = np.r_[0, np.cumsum(sizes)[:-1]]
        component, own, ids = rows["component"].to_numpy().copy(), rows["own"].to_numpy(), rows["doc_id"].to_numpy()
        present = np.zeros(int(codes.max()) + 1, np.int32)
        found = []
        for x in range(len(rows) - 1):
            other = (component[x + 1:] != component[x]) & ((i == j) | (own[x + 1:] != own[x]))
            if not other.any():
                continue
            mine = codes[starts[x]:starts[x] + sizes[x]]
            present[mine] = 1
            tail = starts[x + 1]
            common = np.add.reduceat(present[codes[tail:]], starts[x + 1:] - tail)
            present[mine] = 0
            union = sizes[x] + sizes[x + 1:] - common
            for y in np.flatnonzero(other & (100 * common >= round(100 * threshold) * union)) + x + 1:
                if component[y] != component[x]:
                    found.append((ids[x], ids[y]))
                    component[component == component[y]] = component[x]
        return pd.DataFrame(found, columns=["a", "b"])

    return met.groupBy("band", "i", "j").applyInPandas(run, "a long, b long")


def near_groups(docs: DataFrame, size: int = 5, threshold: float = 0.8) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of ``docs``."""
    width = bands_for(threshold) * ROWS
    need = agreement_needed(threshold, width)
    texts = texts_of(docs)
    signed = stored(sign(texts, size, threshold), "signed")
    usable = signed.where("n > 0 and doc_id is not null")

    # Equal sets: only the smallest doc_id goes on.
    same = usable.groupBy("mark").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))
    same = stored(same.where("first < last").select("mark", "first"), "same")
    copies = usable.select("doc_id", "mark").join(same.hint("merge"), "mark").where("doc_id <> first").distinct()
    copies = stored(copies.select("doc_id", "mark", "first"), "copies")
    single = stored(usable.join(copies.select("doc_id", "mark"), ["doc_id", "mark"], "left_anti").select(
        "doc_id", "n", "bands", "sig"), "single")

    # Buckets with more than one document, and a star in each.
    dealt = single.select("doc_id", "n", F.explode("bands").alias("band"))
    buckets = dealt.groupBy("band").agg(
        F.min("doc_id").alias("center"), F.max("doc_id").alias("last"), F.count(F.lit(1)).alias("size"),
        F.sum("n").alias("shingles"))
    buckets = stored(buckets.where("center < last").select("band", "center", "size", "shingles"), "buckets")
    members = stored(dealt.drop("n").join(buckets.hint("merge"), "band"), "members")
    stars = members.where("doc_id <> center").select(F.col("doc_id").alias("a"), F.col("center").alias("b")).distinct()
    alike = stored(_alike(stars, single, need, width), "alike")
    wanted = members.select("doc_id").distinct()
    candidates = stored(texts.join(wanted, "doc_id", "left_semi"), "candidates")
    links = stored(_confirm(alike, candidates, size, threshold), "links")
    labels = components(links)

    # What the stars left open: members of one bucket in different components, its centre aside.
    open_ = members.where("doc_id <> center and size > 2").join(
        labels.withColumnRenamed("id", "doc_id"), "doc_id", "left")
    open_ = open_.select("band", "doc_id", "size", "shingles", F.coalesce("component", "doc_id").alias("component"))
    several = open_.groupBy("band").agg(F.min("component").alias("x"), F.max("component").alias("y"))
    several = stored(several.where("x < y").select("band"), "several")
    open_ = open_.join(several.hint("merge"), "band").join(single.drop("n"), "doc_id")
    met = stored(_meetings(_blocks(open_), need, width), "met")
    bridges = stored(_bridges(met.join(candidates, "doc_id"), size, threshold), "bridges")
    if bridges.limit(1).count():
        labels = components(links.unionByName(bridges))

    rows = signed.select("doc_id", "mark", F.col("n").alias("n_shingles"))
    rows = rows.join(copies, ["doc_id", "mark"], "left").withColumn("node", F.coalesce("first", "doc_id"))
    rows = rows.join(labels.hint("merge"), rows["node"] == labels["id"], "left")
    return rows.select(
        "doc_id", "n_shingles", F.coalesce("component", "node").alias("component_id"),
    ).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def keep_one(docs: DataFrame, size: int = 5, threshold: float = 0.8) -> DataFrame:
    """The rows of ``docs`` whose document is the smallest of its group, with all their columns.

    Rows that repeat a kept doc_id all stay.
    """
    gone = near_groups(docs, size, threshold).where("not kept").select(F.col("doc_id").alias("__gone")).distinct()
    return docs.join(gone, docs["doc_id"].cast("long") == gone["__gone"], "left_anti")


def near_dedup_report(docs: DataFrame) -> DataFrame:
    return near_groups(docs, size=3, threshold=0.85)
