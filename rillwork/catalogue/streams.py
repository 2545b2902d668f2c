"""Queries that run a stream to its end and return what it wrote."""

from pyspark.sql import functions as F

from rillwork import schema as S
from rillwork.catalogue import sql as Q
from rillwork.catalogue.cleaning import short
from rillwork.catalogue.registry import query
from rillwork.plans import domain as D
from rillwork.session import scratch_path
from rillwork.sources import tables as R
from rillwork.streaming import results as X


@query("stream_clean", f"""
WITH {Q.RAW} SELECT DISTINCT trim(site) AS site, analyte, day_text AS day, {Q.number("value_text")} AS value,
  trim(unit) AS unit FROM raw""")
def stream_clean(spark, folder):
    """Result files cleaned as they arrive, here in several micro-batches; copies across batches are left out."""
    base = scratch_path(spark, "stream_clean")
    raw = D.raw_results(spark, folder)
    # Years stand for files that arrive one after the other.
    raw.withColumn("year", F.substring(S.DATE, 1, 4)).write.partitionBy("year").option("header", True).option(
        "ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(f"{base}/in")
    source = R.read_results(spark, f"{base}/in/*", stream=True, files_per_batch=4)
    X.stream_clean(source, f"{base}/out", f"{base}/state").awaitTermination()
    return short(spark.read.parquet(f"{base}/out/subset").drop("batch"))


@query("stream_dedup", """
SELECT DISTINCT user_id, event_type, strftime(ts, '%Y-%m-%d') AS day FROM events""")
def stream_dedup(spark, folder):
    """One row per user, kind and day from a stream of samples."""
    base = scratch_path(spark, "stream_dedup")
    schema = D.events(spark, folder).schema
    source = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(folder)
    samples = source.select(
        "user_id", "event_type", F.date_format("ts", "yyyy-MM-dd").alias("day"), F.col("ts").cast("timestamp").alias("at"))
    keys = ["user_id", "event_type", "day"]
    unique = X.stream_dedup(samples, keys, "at", "60 days")
    X.append_stream(unique, f"{base}/out", f"{base}/state").awaitTermination()
    return spark.read.parquet(f"{base}/out").select(*keys)


@query("stream_late", """
WITH ordered AS (SELECT event_id, event_id % 6 AS batch, CAST(ts AS TIMESTAMP) AS t FROM events),
latest AS (SELECT batch, max(t) AS t FROM ordered GROUP BY batch),
bounds AS (SELECT batch, max(t) OVER (ORDER BY batch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - INTERVAL 3 DAY AS bound FROM latest)
SELECT event_id, CASE WHEN t <= bound THEN 'late' ELSE 'kept' END AS fate FROM ordered JOIN bounds USING (batch)""")
def stream_late(spark, folder):
    """Every row of a stream with its fate: rows that come too late are kept apart, not lost."""
    base = scratch_path(spark, "stream_late")
    events = D.events(spark, folder).select("event_id", F.col("ts").cast("timestamp").alias("at"))
    for number in range(6):  # files that arrive one after the other
        events.where(F.col("event_id") % 6 == number).coalesce(1).write.mode("append").parquet(f"{base}/in")
    source = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(f"{base}/in")
    X.stream_dedup_kept(source, ["event_id"], "at", "3 days", f"{base}/out", f"{base}/state").awaitTermination()
    return spark.read.parquet(f"{base}/out/rows").select("event_id", "fate")


@query("stream_resume", "SELECT event_id, user_id, value FROM events")
def stream_resume(spark, folder):
    """A stream stopped after the first files goes on from its checkpoint when more arrive."""
    base = scratch_path(spark, "stream_resume")
    events = D.events(spark, folder).select("event_id", "user_id", "value", "event_type")
    schema = events.drop("event_type").schema
    for kind in (F.col("event_type") <= "error", F.col("event_type") > "error"):
        events.where(kind).drop("event_type").write.mode("append").parquet(f"{base}/in")
        source = spark.readStream.schema(schema).parquet(f"{base}/in")
        X.append_stream(source, f"{base}/out", f"{base}/state").awaitTermination()
    return spark.read.parquet(f"{base}/out")
