"""Coverage, descriptive statistics, correlation, distributions, samples and guards."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rillwork.functions import values as V
from rillwork.operators.quantiles import long_values, quantile_table
from rillwork.session import broadcast_if_small


# Rows of a sample's last slot that are ordered at once; chooses a plan, not rows.
SLOT_ROWS = 100_000


def _rows(df: DataFrame, cells: list[Column]) -> DataFrame:
    """One output row per struct: turns a single wide aggregate row into a long table."""
    return df.select(F.explode(F.array(*cells)).alias("_c")).select("_c.*")


def coverage(df: DataFrame, columns: list[str]) -> DataFrame:
    """Number of numeric values per column, in one pass over the table."""
    counts = df.agg(*[F.count(V.numeric(df, c)).alias(f"n{i}") for i, c in enumerate(columns)])
    cells = [
        F.struct(F.lit(c).alias("analyte"), F.col(f"n{i}").alias("non_null_numeric"))
        for i, c in enumerate(columns)
    ]
    return _rows(counts, cells).orderBy(F.desc("non_null_numeric"), "analyte")


def pick_best(df: DataFrame, candidates: list[str], min_nonnull: int = 1) -> str | None:
    """The candidate with most numeric values, at least ``min_nonnull``; the first on a tie."""
    present = [c for c in candidates if c in df.columns]
    if not present:
        return None
    counts = df.agg(*[F.count(V.numeric(df, c)).alias(f"n{i}") for i, c in enumerate(present)]).first()
    best = max(range(len(present)), key=lambda i: counts[i])
    return present[best] if counts[best] >= min_nonnull else None


def top_columns(df: DataFrame, candidates: list[str], n: int, more_than: int = 0) -> list[str]:
    """The n best covered columns that have more than the given number of values."""
    counts = {r["analyte"]: r["non_null_numeric"] for r in coverage(df, candidates).collect()}
    ranked = sorted((c for c in candidates if counts[c] > more_than), key=lambda c: -counts[c])
    return ranked[:n]


def describe_exact(df: DataFrame, columns: list[str]) -> DataFrame:
    """count, mean, std, min, quartiles and max per column; absent columns are skipped."""
    present = [c for c in columns if c in df.columns]
    quartile = [F.get("quantiles", F.lit(i)).alias(n) for i, n in enumerate(["p25", "p50", "p75"])]
    return quantile_table(df, present, [0.25, 0.5, 0.75]).select(
        "column", F.col("n").alias("count"), "mean", "std", F.col("lo").alias("min"), *quartile, F.col("hi").alias("max"))


def histogram(df: DataFrame, column: str, bins: int = 10) -> DataFrame:
    """Equal-width bins over the column's range with their counts; the last bin is closed."""
    value = V.finite(V.numeric(df, column))
    span = df.agg(F.struct(F.min(value).alias("lo"), F.max(value).alias("hi"))).scalar()
    lo, hi = span["lo"], span["hi"]
    place = F.coalesce(F.floor(F.try_divide((value - lo) * bins, hi - lo)), F.lit(0))
    counts = (
        df.where(value.isNotNull())
        .groupBy(F.least(place, F.lit(bins - 1)).alias("bin"))
        .agg(F.count(F.lit(1)).alias("count"))
    )
    edges = df.sparkSession.range(bins).select(
        F.col("id").alias("bin"),
        (lo + (hi - lo) * F.col("id") / bins).alias("bin_from"),
        (lo + (hi - lo) * (F.col("id") + 1) / bins).alias("bin_to"),
    )
    # At most one row per bin on either side.
    return edges.join(F.broadcast(counts), "bin", "left").select(
        "bin", "bin_from", "bin_to", F.coalesce("count", F.lit(0)).alias("count")
    )


def box_stats(df: DataFrame, columns: list[str]) -> DataFrame:
    """Quartiles, whiskers (last values within 1.5 times the quartile range) and outliers."""
    quartiles = quantile_table(df, columns, [0.25, 0.5, 0.75]).select(
        "column", *[F.get("quantiles", F.lit(i)).alias(n) for i, n in enumerate(["q1", "median", "q3"])])
    value, reach = F.col("value"), 1.5 * (F.col("q3") - F.col("q1"))
    inside = (value >= F.col("q1") - reach) & (value <= F.col("q3") + reach)
    # One row of quartiles per listed column.
    return (
        long_values(df, columns)
        .join(F.broadcast(quartiles), "column")
        .groupBy("column", "q1", "median", "q3")
        .agg(
            F.min(F.when(inside, value)).alias("whisker_low"),
            F.max(F.when(inside, value)).alias("whisker_high"),
            F.count_if(~inside).alias("n_outliers"),
        )
    )


def corr_matrix(df: DataFrame, columns: list[str]) -> DataFrame:
    """Pearson correlation of every column pair over rows where both are present."""
    pairs = list(combinations(columns, 2))
    values = df.select(*[V.numeric(df, c).alias(c) for c in columns])
    both = []
    for i, (a, b) in enumerate(pairs):
        # ``corr`` fails on a column without spread, so it is put together from its parts.
        x, y = F.when(V.ref(b).isNotNull(), V.ref(a)), F.when(V.ref(a).isNotNull(), V.ref(b))
        # Rounding can leave a constant column a deviation, so its range is asked.
        varies = (F.min(x) < F.max(x)) & (F.min(y) < F.max(y))
        spread = F.stddev_pop(x) * F.stddev_pop(y)
        both.append(F.when(varies, F.try_divide(F.covar_pop(x, y), spread)).alias(f"r{i}"))
    cells = [
        F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"r{i}").alias("r"))
        for i, (a, b) in enumerate(pairs)
    ]
    return _rows(values.agg(*both), cells)


def corr_wide(df: DataFrame, columns: list[str]) -> DataFrame:
    """``corr_matrix`` for many columns: (a, b, r) of all pairs from products of whole blocks of rows.

    A block of rows gives sums of all pairs as products of its values and of the mask of what is present, so the plan has
    the same size for any number of columns. Tasks pass on one row of sums per column.
    """
    values = df.select(*[V.numeric(df, c).alias(c) for c in columns])
    centre = values.agg(*[F.coalesce(F.avg(V.ref(c)), F.lit(0.0)).alias(str(i)) for i, c in enumerate(columns)]).first()
    means, width = [float(m) for m in centre], len(columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, 6, width))
        for batch in batches:
            rows = np.column_stack([np.asarray(c.to_numpy(zero_copy_only=False), np.float64) for c in batch.columns])
            there = ~np.isnan(rows)
            rows, mask = np.where(there, rows - means, 0.0), there.astype(np.float64)
            squares = rows * rows
            for at, (left, right) in enumerate(((mask, mask), (rows, mask), (mask, rows), (squares, mask), (mask, squares), (rows, rows))):
                total[:, at, :] += left.T @ right
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(width), pa.int32()), pa.array(total.reshape(width, -1).tolist(), pa.list_(pa.float64()))], ["i", "sums"])

    parts = values.mapInArrow(run, "i int, sums array<double>")
    sums = parts.groupBy("i").agg(vector_to_array(Summarizer.sum(array_to_vector("sums"))).alias("sums"))
    pairs = sums.where(F.col("i") < width - 1).select("i", "sums", F.explode(F.sequence(F.col("i") + 1, F.lit(width - 1))).alias("j"))
    n, x, y, xx, yy, xy = (F.get("sums", F.col("j") + at * width) for at in range(6))
    name = lambda at: F.get(F.array(*[F.lit(c) for c in columns]), at)
    mean = lambda at: F.get(F.array(*[F.lit(m) for m in means]), at)

    def spread(squares: Column, total: Column, at: Column) -> Column:
        left = squares - F.try_divide(total * total, n)
        # What rounding leaves of a constant column is no spread.
        return F.when(left > 1e-20 * n * mean(at) * mean(at), left)

    r = (xy - F.try_divide(x * y, n)) / F.sqrt(spread(xx, x, F.col("i")) * spread(yy, y, F.col("j")))
    return pairs.select(name(F.col("i")).alias("a"), name(F.col("j")).alias("b"), r.alias("r"))


def group_counts(df: DataFrame, keys: list[str], limit: int | None = None, fill: str | None = None) -> DataFrame:
    """Rows per key combination, largest first. NULL keys are left out, or named by ``fill``."""
    columns = [V.ref(k) if fill is None else F.coalesce(V.ref(k), F.lit(fill)).alias(k) for k in keys]
    picked = df.select(*columns)
    if fill is None:
        for k in keys:
            picked = picked.where(V.ref(k).isNotNull())
    counted = picked.groupBy(*[V.ref(k) for k in keys]).agg(F.count(F.lit(1)).alias("count"))
    ordered = counted.orderBy(F.desc("count"), *[V.ref(k) for k in keys])
    return ordered.limit(limit) if limit else ordered


def rule_counts(df: DataFrame, rules: dict[str, Column], by: str | None = None) -> DataFrame:
    """How many rows meet each rule (missing geometry, bad coordinate, ...), per group or overall."""
    counts = [F.count(F.lit(1)).alias("n_rows")]
    counts += [F.count_if(V.flag(rule)).alias(name) for name, rule in rules.items()]
    return (df.groupBy(by) if by else df).agg(*counts)


def input_report(df: DataFrame, required: list[str], numeric: list[str] = ()) -> DataFrame:
    """Per required column the present values, and for number columns the unreadable ones.

    A missing column is an error.
    """
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    aggregates, cells = [], []
    for i, c in enumerate(required):
        bad = V.ref(c).isNotNull() & V.numeric(df, c).isNull() if c in numeric else F.lit(False)
        aggregates += [F.count(V.ref(c)).alias(f"n{i}"), F.count_if(bad).alias(f"b{i}")]
        cells.append(F.struct(
            F.lit(c).alias("column"), F.col(f"n{i}").alias("non_null"), F.col(f"b{i}").alias("unparsable")
        ))
    return _rows(df.agg(*aggregates), cells)


def retained(df: DataFrame, kept: Column, site: str) -> DataFrame:
    """Rows and sites before and after a filter, and the retained share in percent."""
    # Partial sums per site; a site is never counted through copies of its rows.
    sites = df.groupBy(V.ref(site).alias("_site")).agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(V.flag(kept)).alias("kept"))
    named = F.col("_site").isNotNull()
    counts = sites.agg(
        F.coalesce(F.sum("rows"), F.lit(0)).alias("n_rows"),
        F.coalesce(F.sum("kept"), F.lit(0)).alias("n_kept"),
        F.count_if(named).alias("n_sites"),
        F.count_if(named & (F.col("kept") > 0)).alias("n_sites_kept"),
    )
    return counts.withColumn("kept_percent", F.try_divide(100.0 * F.col("n_kept"), F.col("n_rows")))


def extent(df: DataFrame, x: str, y: str) -> DataFrame:
    """Bounding box and its middle."""
    box = df.agg(
        F.min(x).alias("min_x"), F.min(y).alias("min_y"), F.max(x).alias("max_x"), F.max(y).alias("max_y")
    )
    middle = {
        "center_x": (F.col("min_x") + F.col("max_x")) / 2, "center_y": (F.col("min_y") + F.col("max_y")) / 2
    }
    return box.withColumns(middle)


def score_range(df: DataFrame, score: str) -> DataFrame:
    """Smallest and largest present value of a score."""
    return df.agg(F.min(V.ref(score)).alias("vmin"), F.max(V.ref(score)).alias("vmax"))


def sample_n(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """Exactly n rows, the same ones on every run, chosen by a hash of the key.

    A histogram over the first hash digits finds the slot in which n rows are reached; a slot of many rows
    is divided by the next digits. Only the rows of the last slot are ordered, others pass a filter.
    """
    digest = F.md5(F.concat_ws(":", V.ref(key).cast("string"), F.lit(str(seed))))
    hashed = df.withColumn("_digest", digest)
    rest, before, size, prefix = hashed, 0, None, ""
    # Four digits a round: a slot of 10^12 rows holds 15 million after one and a few hundred after two.
    while (size is None or size > SLOT_ROWS) and len(prefix) < 32:
        slots = rest.groupBy(F.substring("_digest", 1, len(prefix) + 4).alias("_slot")).agg(F.count(F.lit(1)).alias("_n"))
        # At most 16**4 slots, so one ordered window over them is small.
        earlier = F.sum("_n").over(W.orderBy("_slot").rowsBetween(W.unboundedPreceding, -1))
        wanted = slots.withColumn("_before", F.coalesce(earlier, F.lit(0)) + before).where(F.col("_before") < n)
        edge = wanted.agg(F.max(F.struct("_slot", "_before", "_n")).alias("e")).first()["e"]
        if edge is None:
            return df.limit(0)
        prefix, before, size = edge["_slot"], edge["_before"], edge["_n"]
        rest = hashed.where(F.col("_digest").startswith(prefix))
        if n - before >= size:
            break
    columns = [V.ref(c) for c in df.columns]
    sure = hashed.where(F.substring("_digest", 1, len(prefix)) < prefix).select(*columns)
    if n - before < size:
        rest = rest.orderBy("_digest", V.ref(key)).limit(n - before)
    return sure.unionByName(rest.select(*columns))


def size_guard(df: DataFrame, group: str, out: str = "group_rows") -> DataFrame:
    """Every row with the number of rows of its group, so that a caller can leave out large groups.

    Rows without a group are a group of their own.
    """
    sizes = df.groupBy(V.ref(group).alias("_g")).agg(F.count(F.lit(1)).alias(out))
    joined = df.join(broadcast_if_small(sizes), V.ref(group).eqNullSafe(F.col("_g")), "left")
    return joined.drop("_g")
