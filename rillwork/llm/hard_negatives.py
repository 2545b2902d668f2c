"""Hard negatives by exact integer products in a residue number system.

Components become floor(``SCALE`` * x). The scores of a block of anchors against a strip of rows are one matrix
product of integers, which float32 would round. So both matrices are taken modulo several small primes:
residues lie around zero, and the products of a slice of the inner dimension add up to less than 2 ** 24,
where float32 is exact. The residues of a score give its digits in balanced mixed radix (Chinese remaindering
by Garner), whose weighted sum is the signed score. As many primes are used as the largest norms ask for.

Rows lie in strips of bounded size by a hash, so that each strip is a fair sample. Anchors come in blocks of
bounded size, and every block meets every strip; a strip answers with its first k rows for each question
only. One strip in ``SAMPLED`` is asked first. A k-th row found there is a bound, and the other strips send
only what comes before it: on the whole about k * ``SAMPLED`` rows a question, not k a strip.

* Rows whose label or vector is null, or whose vector holds a null or non-finite component, take no part;
  neither do rows without vec_id. Only vectors of equal length are compared; empty ones score 0.
* Rows that repeat id, label and vector count once; a row never meets a row of its own id. Rows that share an
  id with another label or vector are rows of their own, anchors too: their results stand side by side.
* Ties of a score go to the smaller vec_id. A vector that many rows hold takes no more than k rows of a strip.
* Scores beyond 64 bits are an error, never a wrong number. Empty tables give no rows; extra columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rillwork.llm.common import map_batches, stored

# Scale of a component, rows of a strip, questions of a block, blocks that a task holds, anchors
# multiplied at once, and the strips of which one is asked first.
SCALE = 256
STRIP = 8192
BLOCK = 1024
BLOCKS = 4
ANCHORS = 128
SAMPLED = 16
# Residues of these primes lie within +-510: 64 products stay below 2 ** 24. Seven cover 64 bits.
PRIMES = (1021, 1019, 1013, 1009, 997, 991, 983)
SLICE = 64
LOWEST, HIGHEST = -(1 << 63), (1 << 63) - 1
#: Columns that tell a question; ``key`` tells rows of one id apart.
QUESTION = ("anchor", "key", "label", "positive", "positive_score")


def residues(vectors: np.ndarray, prime: int) -> np.ndarray:
    """Balanced residues as float32."""
    half = prime // 2
    return ((vectors + half) % prime - half).astype(np.float32)


def primes_for(bound: int) -> tuple[int, ...]:
    """The first primes whose product tells all scores of at most this size apart."""
    product, used = 1, []
    for prime in PRIMES:
        used.append(prime)
        product *= prime
        if product > 2 * bound:
            return tuple(used)
    raise OverflowError(f"scores may reach {bound}, which 64 bits do not hold")


def products(left: np.ndarray, right: np.ndarray, primes: tuple[int, ...]) -> np.ndarray:
    """Exact left @ right.T of int64 matrices whose scores the primes tell apart."""
    digits: list[np.ndarray] = []
    score = np.zeros((len(left), len(right)), np.int64)
    weight = 1
    for at, prime in enumerate(primes):
        a, b = residues(left, prime), residues(right, prime).T
        total = np.zeros(score.shape, np.int32)
        for k in range(0, left.shape[1], SLICE):
            total += (a[:, k:k + SLICE] @ b[k:k + SLICE]).astype(np.int32) % prime
        # The digit that is left after the earlier ones, balanced; unsigned wrap-around keeps the sum exact.
        for earlier, known in zip(primes[:at], digits):
            total = (total - known) % prime * pow(earlier, -1, prime)
        digit = (total + prime // 2) % prime - prime // 2
        digits.append(digit)
        score += digit.astype(np.int64) * np.int64(weight if weight <= HIGHEST else weight - (1 << 64))
        weight = weight * prime % (1 << 64)
    return score


def quantised(rows: DataFrame, label: Column) -> DataFrame:
    """(vec_id, label, vector binary, norm2): rows that take part, each once; vectors as 64-bit integers."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        given = batch["embedding"]
        flat = given.values.cast(pa.float64()).to_numpy(zero_copy_only=False)
        wrong = np.r_[0, np.cumsum(~np.isfinite(flat))]  # nulls have become NaN
        ends, valid = given.offsets.to_numpy(), given.is_valid().to_numpy(zero_copy_only=False)
        vectors, kept, norms = [], [], []
        for at in np.flatnonzero(valid & (wrong[ends[1:]] == wrong[ends[:-1]])).tolist():
            values = np.floor(SCALE * flat[ends[at]:ends[at + 1]])
            norm = float(values @ values)
            if not norm < 2.0**63:
                raise OverflowError("a vector is too long for scores of 64 bits")
            vectors.append(values.astype(np.int64).tobytes())
            norms.append(norm)
            kept.append(at)
        picked = batch.take(pa.array(kept, pa.int64()))
        return pa.RecordBatch.from_arrays(
            [picked["vec_id"], picked["label"], pa.array(vectors, pa.binary()), pa.array(norms, pa.float64())],
            ["vec_id", "label", "vector", "norm2"])

    usable = rows.select(F.col("vec_id").cast("long").alias("vec_id"), label.cast("long").alias("label"), "embedding")
    usable = usable.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull())
    return map_batches(usable, run, "vec_id long, label long, vector binary, norm2 double").distinct()


def _pack(rows: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """One row for each group of rows: its 64-bit columns and its vectors as binary."""
    schema = ", ".join(f"{key} long" for key in keys) + ", length int, vectors binary, columns binary"

    def run(key: tuple, table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        numbers = np.stack([table[c].to_numpy() for c in columns])
        vectors = b"".join(table["vector"].to_pylist())
        values = [*([k.as_py()] for k in key), [table.num_rows], [vectors], [numbers.tobytes()]]
        kinds = [*(pa.int64() for _ in keys), pa.int32(), pa.binary(), pa.binary()]
        return pa.table([pa.array(v, kind) for v, kind in zip(values, kinds)], names=[*keys, "length", "vectors", "columns"])

    return rows.select(*keys, "vector", *columns).groupBy(*keys).applyInArrow(run, schema)


def strips_of(rows: DataFrame, count: int) -> DataFrame:
    """Rows packed into ``count`` strips for each length of vectors."""
    number = F.pmod(F.xxhash64("vec_id", "label", "vector"), F.lit(count))
    placed = rows.withColumns({"size": F.length("vector").cast("long"), "strip": number})
    return _pack(placed, ["size", "strip"], ["vec_id", "label"])


def _answers(asked: tuple, strip: tuple, k: int, same: bool, primes: tuple[int, ...]) -> Iterator[tuple[np.ndarray, ...]]:
    """(question, row of the strip, score) of the first k rows of a strip for each question."""
    (vectors, numbers), (rows, (ids, labels)) = asked, strip
    anchors, keys, own, _, _, low, high, floor, floor_id = numbers
    # Questions of an anchor lie together: its scores are computed once.
    starts = np.flatnonzero(np.r_[True, (np.diff(anchors) != 0) | (np.diff(keys) != 0)])
    ends = np.r_[starts[1:], len(anchors)]
    for at in range(0, len(starts), ANCHORS):
        part = starts[at:at + ANCHORS]
        scores = products(vectors[part], rows, primes)
        for start, end, row in zip(part, ends[at:at + ANCHORS], scores):
            fits = np.flatnonzero(((labels == own[start]) == same) & (ids != anchors[start]))
            for q in range(start, end):
                score = row[fits]
                inside = (score >= low[q]) & (score <= high[q])
                inside &= (score > floor[q]) | (score == floor[q]) & (ids[fits] <= floor_id[q])
                found = fits[inside]
                if len(found):
                    found = found[np.lexsort((ids[found], -row[found]))[:k]]
                    yield np.full(len(found), q), found, row[found]


def search(strips: DataFrame, questions: DataFrame, k: int, same: bool, primes: tuple[int, ...]) -> DataFrame:
    """(``QUESTION`` columns, vec_id, score): the first k rows of each strip for each question.

    A question is an anchor with the label that rows must (``same``) or must not have, a window of scores, and a bound:
    rows that come after it are of no use. A task reads some strips and holds some blocks, so the pairs are neither
    shuffled nor broadcast: their size is the product of both sides.
    """
    names = [*QUESTION, "low", "high", "floor", "floor_id"]
    count = max(1, -(-questions.count() // BLOCK))
    placed = questions.withColumns({
        "size": F.length("vector").cast("long"), "block": F.pmod(F.xxhash64("anchor", "key"), F.lit(count))})
    packed = stored(_pack(placed, ["size", "block"], names), "blocks")
    asked = packed.select(F.col("size").alias("asked_size"), F.struct("length", "vectors", "columns").alias("asked"))
    asked = asked.repartition(-(-count // BLOCKS)).hint("shuffle_replicate_nl")
    met = strips.select("size", F.struct("length", "vectors", "columns").alias("rows")).join(asked, F.col("size") == F.col("asked_size"))

    def unpack(packed: dict, wide: int) -> tuple[np.ndarray, np.ndarray]:
        n = packed["length"]
        return np.frombuffer(packed["vectors"], np.int64).reshape(n, -1 if packed["vectors"] else 0), \
            np.frombuffer(packed["columns"], np.int64).reshape(wide, n)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for asked, rows in zip(batch["asked"], batch["rows"]):
                left, right = unpack(asked.as_py(), len(names)), unpack(rows.as_py(), 2)
                order = np.lexsort((left[1][1], left[1][0]))
                left = left[0][order], left[1][:, order]
                found = list(_answers(left, right, k, same, primes))
                if found:
                    q, r, scores = (np.concatenate(part) for part in zip(*found))
                    columns = [*left[1][:len(QUESTION), q], right[1][0][r], scores]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], [*QUESTION, "vec_id", "score"])

    schema = ", ".join(f"{name} long" for name in (*QUESTION, "vec_id", "score"))
    return met.select("asked", "rows").mapInArrow(run, schema)


def _first(found: DataFrame, k: int) -> DataFrame:
    """The first k rows of each question, numbered from 1."""
    order = W.partitionBy(*QUESTION).orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _best(strips: DataFrame, questions: DataFrame, k: int, same: bool, primes: tuple[int, ...]) -> DataFrame:
    """The first k rows of each question over all strips: a sample of strips first, whose k-th row bounds the others."""
    sampled = F.col("strip") % SAMPLED == 0
    early = stored(_first(search(strips.where(sampled), questions, k, same, primes), k), "early")
    bound = early.where(F.col("rank") == k).select(*QUESTION, F.col("score").alias("at"), F.col("vec_id").alias("at_id"))
    bounded = questions.join(bound, list(QUESTION), "left").withColumns({
        "floor": F.coalesce("at", "floor"), "floor_id": F.coalesce("at_id", "floor_id")}).drop("at", "at_id")
    late = search(strips.where(~sampled), stored(bounded, "questions"), k, same, primes)
    return stored(_first(early.drop("rank").unionByName(late), k), "best")


def hard_negatives(
    rows: DataFrame, is_anchor: Column, label: Column, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    Positives are an anchor's first rows of its label, negatives the first rows of other labels whose score lies
    between ``low`` and ``high`` hundredths of the positive's.
    """
    given = stored(quantised(rows, label), "vectors")
    size = given.agg(F.count(F.lit(1)).alias("n"), F.max("norm2").alias("norm2")).first()
    primes = primes_for(math.ceil((size["norm2"] or 0.0) * (1 + 1e-9)) + 1)
    count = max(1, -(-size["n"] // STRIP))
    strips = stored(strips_of(given, count), "strips")

    anchors = stored(given.where(is_anchor).select(
        F.col("vec_id").alias("anchor"), F.xxhash64("label", "vector").alias("key"), "label", "vector", F.lit(0).cast("long").alias("positive"), F.lit(0).cast("long").alias("positive_score"),
        F.lit(LOWEST).alias("low"), F.lit(HIGHEST).alias("high"), F.lit(LOWEST).alias("floor"), F.lit(HIGHEST).alias("floor_id")), "anchors")
    near = _best(strips, anchors, positives, True, primes)
    window = {"low": F.expr(f"CAST(ceil(CAST({low} AS DECIMAL(3, 0)) * score / 100) AS LONG)"),
              "high": F.expr(f"CAST(floor(CAST({high} AS DECIMAL(3, 0)) * score / 100) AS LONG)")}
    questions = near.withColumns(window).select(
        "anchor", "key", "label", F.col("vec_id").alias("positive"), F.col("score").alias("positive_score"), "low", "high")
    questions = questions.where("low <= high").join(anchors.select("anchor", "key", "vector", "floor", "floor_id"), ["anchor", "key"])
    hard = _best(strips, stored(questions, "questions"), negatives, False, primes)
    return hard.select(
        F.col("anchor").alias("anchor_id"), F.col("positive").alias("positive_id"), "rank", F.col("vec_id").alias("negative_id"),
        "positive_score", F.col("score").alias("negative_score"))


def hard_negatives_report(embeddings: DataFrame) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(embeddings, F.col("vec_id") % 100 == 0, label).withColumn("rank", F.col("rank").cast("int"))
