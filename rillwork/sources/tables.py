"""Reading result tables: CSV, tolerant CSV, Parquet, per-analyte files and derived tables."""

from __future__ import annotations

import csv
import warnings
from collections.abc import Callable
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rillwork import schema as S
from rillwork.functions import values as V
from rillwork.sources import records as L

SURPLUS = "_surplus"


def list_paths(spark: SparkSession, pattern: str) -> list[str]:
    """Paths that a glob names, from the file system; no data is read."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    found = hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(hadoop)
    return sorted(status.getPath().toString() for status in found or [])


def path_exists(spark: SparkSession, path: str) -> bool:
    return bool(list_paths(spark, path))


def is_complete(spark: SparkSession, path: str) -> bool:
    """Whether a write to the path has ended; a folder that holds unfinished work only does not count."""
    return path_exists(spark, f"{path.rstrip('/')}/_SUCCESS")


def first_path(spark: SparkSession, paths: str | list[str]) -> str:
    """The first path of the list that exists."""
    candidates = [paths] if isinstance(paths, str) else paths
    for path in candidates:
        if path_exists(spark, path):
            return path
    raise FileNotFoundError(f"none of these exists: {candidates}")


def _csv(reader):
    return reader.option("header", True).option("escape", '"')


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """CSV as text columns named by its header."""
    return _csv(spark.read).csv(path)


def read_results(
    spark: SparkSession, path: str, stream: bool = False, files_per_batch: int | None = None,
    multi_line: bool = False,
) -> DataFrame:
    """Result files with a header, all text first; numbers and dates are coerced by cleaning.

    Columns go by the header, whatever their order; a file with another header is an error, and so
    is a line with more or fewer fields than the header (a line break inside quotes among them).
    ``multi_line`` reads such breaks; many tasks share a file then too (``records``). With ``stream``
    the same table arrives file by file, and with both a file is read by one task.
    """
    header = read_csv(spark, path).schema
    if multi_line and not stream:
        return L.parsed(L.records(spark, path), header.names, strict=True).select("row.*")
    reader = _csv(spark.readStream if stream else spark.read).schema(header)
    reader = reader.option("enforceSchema", False).option("mode", "FAILFAST").option("multiLine", multi_line)
    if stream and files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.csv(path)


def read_csv_tolerant(
    spark: SparkSession, paths: str | list[str], columns: list[str] | None = None, max_lines: int = L.MAX_LINES
) -> DataFrame:
    """CSV whose broken records are skipped: too many fields drop a record, missing ones are NULL.

    A record may hold line breaks inside quotes; many tasks share a file all the same (``records``). A line whose
    quotes never close is broken, and so is a record of more than ``max_lines`` lines. Only the given columns are kept,
    those that exist. One text column more than the header catches what is over.
    """
    found, names = _with_surplus(spark, first_path(spark, paths), max_lines)
    kept = found.where(_complete()).select("row.*")
    return kept.select(*[V.ref(c) for c in names if columns is None or c in columns])


def _complete() -> Column:
    return ~F.col("broken") & F.col("row")[SURPLUS].isNull()


def _with_surplus(spark: SparkSession, path: str, max_lines: int) -> tuple[DataFrame, list[str]]:
    names = read_csv(spark, path).columns
    return L.parsed(L.records(spark, path, max_lines), [*names, SURPLUS]), names


def tolerant_counts(spark: SparkSession, paths: str | list[str], max_lines: int = L.MAX_LINES) -> DataFrame:
    """One row (kept, skipped): the records that tolerant reading gives and those that it leaves out."""
    found, _ = _with_surplus(spark, first_path(spark, paths), max_lines)
    return found.agg(F.count_if(_complete()).alias("kept"), F.count_if(~_complete()).alias("skipped"))


def read_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def csv_to_parquet(
    spark: SparkSession, path: str, out: str, doubles: list[str] = ()
) -> DataFrame:
    """Write a CSV as Parquet and read it back. Columns are text unless listed as doubles."""
    table = read_csv(spark, path)
    table = table.withColumns({c: V.num(V.ref(c)) for c in doubles})
    table.write.mode("overwrite").option("compression", "snappy").parquet(out)
    return spark.read.parquet(out)


def cached_table(
    spark: SparkSession,
    path: str,
    build: Callable[[], DataFrame],
    valid: Callable[[DataFrame], bool] | None = None,
) -> DataFrame:
    """Read a stored table, or build, store and read it. ``valid`` may refuse a stored one."""
    if is_complete(spark, path):
        stored = spark.read.parquet(path)
        if valid is None or valid(stored):
            return stored
    build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def read_dimension(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Small CSV table; an absent file gives an empty table of the same schema."""
    if not path_exists(spark, path):
        warnings.warn(f"no table at {path}, using an empty one", stacklevel=2)
        return spark.createDataFrame([], schema)
    text = read_csv(spark, path)
    return text.select(*[V.ref(f.name).try_cast(f.dataType).alias(f.name) for f in schema.fields])


LATEST_COLUMNS = [S.SITE, S.VALUE, S.LAT, S.LON, "HUCEightDigitCode", "HUCTwelveDigitCode"]


def analyte_of_path(path: Column) -> Column:
    """``.../temperature_water_latest.csv[/part]`` to ``Temperature_Water``."""
    return V.title_parts(F.regexp_extract(path, r"([^/=]+)_latest\.csv", 1))


def files_by_header(spark: SparkSession, paths: list[str]) -> dict[str, list[str]]:
    """The first line of every file and the files that begin with it, from one scan of all of them.

    A file without text has no entry. One row per file passes the driver, as the list of paths does.
    """
    lines = spark.read.text(paths).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("at"), F.regexp_replace("value", "^\ufeff", "").alias("line"))
    first = lines.where((F.col("block") == 0) & (F.trim("line") != "")).groupBy("file").agg(F.min_by("line", "at").alias("header"))
    found: dict[str, list[str]] = {}
    for row in first.groupBy("header").agg(F.sort_array(F.collect_list("file")).alias("files")).orderBy("header").collect():
        found[row["header"]] = [unquote(file) for file in row["files"]]
    return found


def read_latest(
    spark: SparkSession, folder: str, columns: list[str] = LATEST_COLUMNS, huc: str = "HUC12"
) -> DataFrame:
    """All ``<analyte>_latest.csv`` files as one table, the analyte taken from the file name.

    Columns go by each file's header; files of one header are read together, so there are as many scans as headers,
    however many files. A file without site or value is skipped. Watershed codes stay text, so leading zeros survive.
    """
    paths = list_paths(spark, f"{folder.rstrip('/')}/*_latest.csv")
    if not paths:
        raise FileNotFoundError(f"no *_latest.csv in {folder}")
    tables = []
    for header, files in files_by_header(spark, paths).items():
        names = next(csv.reader([header]), [])
        if S.SITE not in names or S.VALUE not in names:
            warnings.warn(f"{', '.join(files[:10])} have no site or value column and are skipped ({len(files)} files)", stacklevel=2)
            continue
        # By place, so that names that repeat in a header do no harm.
        places = T.StructType([T.StructField(f"_c{at}", T.StringType()) for at in range(len(names))])
        table = _csv(spark.read).schema(places).csv(files)
        picked = [F.col(f"_c{names.index(c)}").alias(c) if c in names else F.lit(None).cast("string").alias(c) for c in columns]
        path = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
        tables.append(table.select(*picked, analyte_of_path(path).alias(S.ANALYTE)))
    if not tables:
        raise ValueError(f"no usable *_latest.csv in {folder}")
    table = union_by_name(tables)
    number = table.withColumn(S.VALUE, V.num(V.ref(S.VALUE))).where(V.ref(S.VALUE).isNotNull())
    return number.withColumnsRenamed({S.SITE: "SiteID", "HUCTwelveDigitCode": huc})


def canonicalise(
    df: DataFrame, names: dict[str, list[str]], required: list[str] = (), keep_rest: bool = False
) -> DataFrame:
    """Rename the first present candidate of each list to its canonical name."""
    found, missing = {}, []
    for canonical, candidates in names.items():
        hit = next((c for c in candidates if c in df.columns), None)
        if hit:
            found[canonical] = hit
        elif canonical in required:
            missing.append(canonical)
    if missing:
        raise ValueError(f"no column for {missing} among {df.columns}")
    rest = [V.ref(c) for c in df.columns if c not in found.values()] if keep_rest else []
    return df.select(*[V.ref(hit).alias(canonical) for canonical, hit in found.items()], *rest)


def find_column(columns: list[str], preferred: list[str] = (), tokens: list[str] = ()) -> str | None:
    """A preferred name if present, else the first column that holds a token (any case)."""
    hit = next((c for c in preferred if c in columns), None)
    return hit or next((c for c in columns if any(t in c.lower() for t in tokens)), None)


def union_by_name(tables: list[DataFrame]) -> DataFrame:
    """Rows of all tables; columns missing in one are NULL there."""
    out = tables[0]
    for table in tables[1:]:
        out = out.unionByName(table, allowMissingColumns=True)
    return out


def to_points(df: DataFrame, lat: str = S.LAT, lon: str = S.LON) -> DataFrame:
    """Number columns ``lat`` and ``lon``; rows with a bad or missing coordinate are dropped."""
    from rillwork.functions.geometry import valid_lonlat

    typed = df.withColumns({"lat": V.numeric(df, lat), "lon": V.numeric(df, lon)})
    return typed.where(valid_lonlat(F.col("lon"), F.col("lat")))
