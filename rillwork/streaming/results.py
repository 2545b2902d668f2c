"""Incremental versions of cleaning and duplicate removal."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from rillwork import schema as S
from rillwork.operators.clean import clean_results, keep_values


def stream_clean(source: DataFrame, out: str, state: str) -> StreamingQuery:
    """Clean arriving results into ``out/clean`` and the analytes of interest into ``out/subset``.

    Rows that were seen before are left out, in whatever batch they came: the stream keeps each row as a key in its
    state, which is dealt over the shuffle partitions and only grows by new rows (keep it in RocksDB for long
    streams). So both folders hold what cleaning all files at once gives. Each micro-batch overwrites a
    folder of its own, so a batch that runs again after a failure replaces its earlier output.
    """

    def write(batch: DataFrame, number: int) -> None:
        part = f"{out}/clean/batch={number}"
        batch.write.mode("overwrite").parquet(part)
        stored = batch.sparkSession.read.parquet(part)
        keep_values(stored, S.ANALYTE, S.ANALYTES).write.mode("overwrite").parquet(
            f"{out}/subset/batch={number}"
        )

    return (
        clean_results(source).writeStream.foreachBatch(write)
        .option("checkpointLocation", state).trigger(availableNow=True).start()
    )


def settled(stored: DataFrame) -> DataFrame:
    """All batches as one table without copies, for folders that several streams have written."""
    return stored.drop("batch").dropDuplicates()


def stream_dedup(source: DataFrame, keys: list[str], time: str, delay: str) -> DataFrame:
    """First row per key while copies arrive within ``delay``; later rows count as late."""
    return source.withWatermark(time, delay).dropDuplicatesWithinWatermark(keys)


def stream_dedup_kept(source: DataFrame, keys: list[str], time: str, delay: str, out: str, state: str) -> StreamingQuery:
    """First row per key while copies arrive within ``delay`` (an interval), and no row lost: each row is written with its fate.

    ``out/rows`` is partitioned by batch and fate: kept, copy or late. A row is late if its time is no later than the
    latest time of all batches before, less the delay, or missing. A key is remembered until that bound has passed its
    row by the delay; only batches that still hold such keys are read. ``out/counts`` has one row per batch with counts of the
    batch and of the whole stream. A batch that runs again replaces its own folders and reads earlier ones only.
    """
    spark = source.sparkSession
    span = spark.range(1).select(F.expr(f"unix_micros(timestamp_micros(0) + INTERVAL '{delay}')")).first()[0]
    fates = ("kept", "copy", "late")
    known = T.StructType([T.StructField("batch", T.LongType()), T.StructField("latest", T.LongType())])
    counts = T.StructType([
        T.StructField("live", T.ArrayType(known)), T.StructField("latest", T.LongType()),
        *[T.StructField(f"{when}{fate}", T.LongType()) for when in ("", "total_") for fate in fates]])
    micros = F.unix_micros(F.col(f"`{time}`").cast("timestamp"))
    same = [f"_k{at}" for at in range(len(keys))]

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        last = spark.read.schema(counts).parquet(f"{out}/counts/batch={number - 1}").first() if number else None
        bound = None if last is None or last["latest"] is None else last["latest"] - span
        live = [(r["batch"], r["latest"]) for r in last["live"] if r["latest"] + span > bound] if bound is not None else []
        late = micros.isNull() if bound is None else micros.isNull() | (micros <= bound)
        keyed = batch.withColumns({k: F.col(f"`{name}`") for k, name in zip(same, keys)}).withColumn("_late", late)
        order = ("_late", micros, F.xxhash64(*[F.col(f"`{c}`") for c in batch.columns]))
        keyed = keyed.withColumn("_copy", F.row_number().over(W.partitionBy(*same).orderBy(*order)) > 1)
        if live:
            held = spark.read.schema(batch.schema).parquet(*[f"{out}/rows/batch={at}/fate=kept" for at, _ in live]).where(micros + span > bound)
            held = held.select(*[F.col(f"`{name}`").alias(f"_o{n}") for n, name in enumerate(keys)]).distinct().withColumn("_seen", F.lit(True))
            match = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"_o{n}")) for n, k in enumerate(same)])
            keyed = keyed.join(held, match, "left").withColumn("_copy", F.col("_copy") | F.coalesce("_seen", F.lit(False)))
        fate = F.when(F.col("_late"), "late").when(F.col("_copy"), "copy").otherwise("kept")
        folder = f"{out}/rows/batch={number}"
        keyed.select(*[F.col(f"`{c}`") for c in batch.columns], fate.alias("fate")).write.mode("overwrite").partitionBy("fate").parquet(folder)
        wrote = spark.read.schema(T.StructType([*batch.schema.fields, T.StructField("fate", T.StringType())])).parquet(folder).agg(
            *[F.count_if(F.col("fate") == fate).alias(fate) for fate in fates], F.max(micros).alias("latest"),
            F.max(F.when(F.col("fate") == "kept", micros)).alias("kept_latest")).first()
        if wrote["kept"]:
            live.append((number, wrote["kept_latest"]))
        latest = max((t for t in (wrote["latest"], last and last["latest"]) if t is not None), default=None)
        sums = [wrote[fate] + (last[f"total_{fate}"] if last else 0) for fate in fates]
        row = (live, latest, *[wrote[fate] for fate in fates], *sums)
        spark.createDataFrame([row], counts).coalesce(1).write.mode("overwrite").parquet(f"{out}/counts/batch={number}")

    return (
        source.writeStream.foreachBatch(write)
        .option("checkpointLocation", state).trigger(availableNow=True).start()
    )


def append_stream(stream: DataFrame, out: str, state: str) -> StreamingQuery:
    """Append a stream to Parquet, processing what is there and then stopping."""
    return (
        stream.writeStream.format("parquet").outputMode("append")
        .option("path", out).option("checkpointLocation", state)
        .trigger(availableNow=True).start()
    )


def dropped_late(query: StreamingQuery) -> int:
    """Rows ignored because they were older than the watermark, over all batches of the run.

    The count comes from the progress that the session keeps; if some of it may be gone
    (``spark.sql.streaming.numRecentProgressUpdates``) that is an error, not a smaller number.
    """
    recent = query.recentProgress
    limit = int(SparkSession.active().conf.get("spark.sql.streaming.numRecentProgressUpdates", "100"))
    if len(recent) >= limit:
        raise RuntimeError(f"only the last {limit} batches are known; keep more progress updates")
    return sum(
        operator["numRowsDroppedByWatermark"] for progress in recent for operator in progress["stateOperators"]
    )
