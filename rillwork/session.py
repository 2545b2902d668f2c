"""Session settings and the shared folder that all executors can reach."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def get_session(app: str = "rillwork", master: str | None = None, **conf: str) -> SparkSession:
    """Session with UTC dates, adaptive execution and skew handling switched on."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """Folder for checkpoints and intermediate tables.

    The cluster names it in ``spark.checkpoint.dir``. Only a local session without that
    setting (tests) gets a temporary folder; elsewhere a missing setting is an error,
    because a machine-local folder would vanish with its executor.
    """
    context = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None)
    current = context.getCheckpointDir()
    if current:
        return configured or os.path.dirname(current)
    if not configured:
        if not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder shared by all executors")
        configured = tempfile.mkdtemp(prefix="rillwork-")
    context.setCheckpointDir(configured)
    return configured


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path below the shared folder that no other run uses."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def checkpoint(df: DataFrame) -> DataFrame:
    """Materialise once in the shared folder and cut the lineage."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a wide intermediate table to the shared folder and read it back; cuts the lineage, too."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


# A side is hinted for broadcast only below both bounds. They choose a plan, not rows.
BROADCAST_ROWS = 1_000_000
BROADCAST_BYTES = 64 << 20


def _row_bytes(df: DataFrame) -> Column:
    """Bytes of a row: the schema tells the width of fixed columns, only texts and nested values are measured."""
    total = F.lit(8)
    for field in df.schema.fields:
        column = F.col(f"`{field.name}`")
        if isinstance(field.dataType, (T.StringType, T.BinaryType)):
            total = total + 16 + F.coalesce(F.octet_length(column), F.lit(0))
        elif isinstance(field.dataType, (T.ArrayType, T.MapType, T.StructType)):
            total = total + 16 + F.coalesce(F.octet_length(F.to_json(F.struct(column))), F.lit(0))
        else:
            total = total + 8
    return total


def broadcast_if_small(df: DataFrame, stored: bool = False) -> DataFrame:
    """Hint a broadcast only after measuring the side; otherwise Spark shuffles both sides and
    splits skewed keys.

    The side is stored once (unless it already is), so measuring does not compute it twice.
    """
    stored = df if stored else checkpoint(df)
    size = stored.agg(F.count(F.lit(1)).alias("n"), F.sum(_row_bytes(stored)).alias("bytes")).first()
    fits = size["n"] <= BROADCAST_ROWS and (size["bytes"] or 0) <= BROADCAST_BYTES
    return F.broadcast(stored) if fits else stored
