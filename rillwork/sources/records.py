"""CSV records that span lines, read by many tasks.

A file is read as lines, wherever Spark splits it. A line leads from one of two states (outside or inside
quotes) to another, so it is a function of two values, and so is a run of lines: functions are composed like sums. A
block of a file (what one task reads of it, cut into runs of bounded length) folds its lines into one function, the blocks of a file are
chained in their order, and then every line knows the state it begins in. Lines that begin outside begin a record.

Files without a line that ends inside quotes are scanned twice, and their lines are records as they stand. The lines of the
other files are stored and shuffled by block, so that their order is fixed, and only records of several lines by record.

A quote counts as one only where a field begins with it. A record that the file does not end, or that runs on for more than
``max_lines`` lines, is not one: its first line is broken, and its other lines are read each for itself. So no
stray quote can gather a file in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rillwork.session import broadcast_if_small, checkpoint, stored

#: Lines of the longest record.
MAX_LINES = 1000
# Fixed value: what a task reads of a file is cut again, into blocks of at most 2**CHUNK lines to put in order.
CHUNK = 15

# What a quoted field holds, a whole field, and whether a line ends inside quotes when it begins outside or inside.
_QUOTED = r'[^"]*+(?:""[^"]*+)*+'
_FIELDS = rf'(?:(?:"{_QUOTED}"[^,]*+|[^",][^,]*+|),)*+"{_QUOTED}$'
_OPENS = rf"(?s)^{_FIELDS}"
_STAYS = rf'(?s)^{_QUOTED}(?:$|"[^,]*+,{_FIELDS})'


def _lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, block, at, line, opens, stays): lines with their place, and the states they lead to from outside and from inside."""
    lines = spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("at"), F.col("value").alias("line"))
    line, quoted = F.col("line"), F.contains("line", F.lit('"'))
    return lines.withColumns({
        "opens": quoted & line.rlike(_OPENS), "stays": ~quoted | line.rlike(_STAYS),
    })


def _after(state: Column, opens: Column, stays: Column) -> Column:
    return F.when(state, stays).otherwise(opens)


def _states(df: DataFrame, by: list[str], order: str, entry: Column) -> DataFrame:
    """Adds ``inside``: the state before each row, from the last row before it that fixes a state and the swaps since."""
    before = W.partitionBy(*by).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    swaps, fixes = F.col("opens") & ~F.col("stays"), F.col("opens") == F.col("stays")
    counted = df.withColumn("_swaps", F.coalesce(F.count_if(swaps).over(before), F.lit(0)))
    fixed = F.last(F.when(fixes, F.struct("opens", F.col("_swaps").alias("swaps"))), ignorenulls=True).over(before)
    counted = counted.withColumn("_fixed", fixed)
    odd = lambda n: n % 2 == 1
    inside = F.when(F.col("_fixed").isNull(), entry != odd(F.col("_swaps"))).otherwise(
        F.col("_fixed.opens") != odd(F.col("_swaps") - F.col("_fixed.swaps")))
    return counted.withColumn("inside", inside).drop("_swaps", "_fixed")


def _folded(lines: DataFrame) -> DataFrame:
    """(file, block, opens, stays): the function of each block's lines, from its last line that fixes a state and the
    swaps since. Both are sums and maxima, so no list of lines is held."""
    swaps, fixes = F.col("opens") & ~F.col("stays"), F.col("opens") == F.col("stays")
    last = checkpoint(lines.groupBy("file", "block").agg(F.max(F.when(fixes, F.struct("at", "opens"))).alias("fixed")))
    since = F.count_if(swaps & (F.col("fixed").isNull() | (F.col("at") > F.col("fixed.at"))))
    counted = lines.select("file", "block", "at", "opens", "stays").join(broadcast_if_small(last, stored=True), ["file", "block"])
    odd = since % 2 == 1
    ends = counted.groupBy("file", "block").agg(F.max("fixed.opens").alias("_fixed"), odd.alias("_odd"))
    leaves = lambda entry: F.coalesce("_fixed", F.lit(entry)) != F.col("_odd")
    return ends.select("file", "block", leaves(False).alias("opens"), leaves(True).alias("stays"))


def _blocks(lines: DataFrame) -> DataFrame:
    """(file, block, entry): the state in which each block begins."""
    chained = _states(checkpoint(_folded(lines)), ["file"], "block", F.lit(False))
    leaves = _after(F.col("inside"), F.col("opens"), F.col("stays"))
    return checkpoint(chained.select("file", "block", F.col("inside").alias("entry"), leaves.alias("leaves")))


def _clean(text: Column) -> Column:
    """A record without the carriage return and the byte order mark at its ends."""
    return F.regexp_replace(text, "\r$|^\ufeff", "")


def records(spark: SparkSession, path: str | list[str], max_lines: int = MAX_LINES) -> DataFrame:
    """(file, header, record, broken): the records below the header of each file, blank lines left out.

    ``broken`` marks a line whose quotes never close. A line that repeats its file's header counts as a header.
    """
    lines = _lines(spark, path)
    first = F.min(F.when(F.trim("line") != "", F.struct("block", "at", "line", "opens")))
    files = checkpoint(lines.groupBy("file").agg(first.alias("first"), F.max("opens").alias("spans")))
    heads = files.select("file", _clean(F.col("first.line")).alias("header"), "spans")
    if files.where("first.opens").limit(1).count():
        raise ValueError(f"a header with a line break inside quotes in {path}")
    if heads.where(F.col("header").isNotNull()).select("header").distinct().limit(2).count() > 1:
        raise ValueError(f"files with different headers in {path}")
    side = broadcast_if_small(heads, stored=True)
    met = lines.select("file", F.col("line").alias("record"), F.lit(False).alias("broken")).join(side, "file")
    found = met.where(~F.col("spans")).drop("spans")
    if files.where("spans").limit(1).count():
        # Stored once: another scan may cut the files into other blocks.
        apart = lines.join(broadcast_if_small(heads.where("spans").select("file")), "file", "left_semi")
        apart = stored(apart.withColumn("block", F.struct("block", F.shiftright("at", CHUNK).alias("chunk"))), "lines")
        found = found.unionByName(_joined(apart, max_lines).join(side.drop("spans"), "file"))
    found = found.withColumn("record", _clean(F.col("record")))
    return found.where((F.trim("record") != "") & ~F.col("record").eqNullSafe(F.col("header"))).select("file", "header", "record", "broken")


def _joined(lines: DataFrame, max_lines: int) -> DataFrame:
    """(file, record, broken) of stored lines, put together."""
    blocks = _blocks(lines)
    entries = broadcast_if_small(blocks.select("file", "block", "entry"))
    placed = _states(lines.join(entries, ["file", "block"]), ["file", "block"], "at", F.col("entry"))
    placed = stored(placed.select("file", "block", "at", "line", "opens", "inside"), "states")
    begins = F.when(~F.col("inside"), F.struct("block", "at"))
    # The record that a block continues began in the last block before it that begins one.
    last = placed.groupBy("file", "block").agg(F.max(begins).alias("last"))
    earlier = W.partitionBy("file").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    carried = last.withColumn("carried", F.last("last", ignorenulls=True).over(earlier)).select("file", "block", "carried")
    here = W.partitionBy("file", "block").orderBy("at").rowsBetween(W.unboundedPreceding, W.currentRow)
    own = placed.withColumn("own", F.last(begins, ignorenulls=True).over(here)).join(broadcast_if_small(carried), ["file", "block"])
    known = own.withColumn("start", F.coalesce("own", "carried"))

    # A file whose last block ends inside quotes has not ended its last record.
    ends = blocks.groupBy("file").agg(F.max(F.struct("block", "leaves")).alias("end")).select(
        "file", F.col("end.leaves").alias("unended"), F.col("end.block").alias("end"))
    final = last.groupBy("file").agg(F.max("last").alias("start"), F.max("block").alias("end")).join(ends.where("unended"), ["file", "end"])
    long = known.groupBy("file", "start").count().where(F.col("count") > max_lines).select("file", "start")
    undone = broadcast_if_small(long.unionByName(final.select("file", "start")).distinct().withColumn("undone", F.lit(True)))
    known = known.join(undone, ["file", "start"], "left").withColumn("undone", F.coalesce("undone", F.lit(False)))

    alone = known.where(F.col("undone") | ~F.col("inside") & ~F.col("opens"))
    loose = alone.select("file", F.col("line").alias("record"), (F.col("undone") & F.col("opens")).alias("broken"))
    bound = known.where(~F.col("undone") & (F.col("inside") | F.col("opens"))).groupBy("file", "start").agg(
        F.array_sort(F.collect_list(F.struct("block", "at", "line"))).alias("lines"))
    return loose.unionByName(bound.select("file", F.array_join(F.col("lines.line"), "\n").alias("record"), F.lit(False).alias("broken")))


def parsed(found: DataFrame, names: list[str], strict: bool = False) -> DataFrame:
    """(broken, row): the fields of each record as a struct of texts. ``strict`` makes broken records, and those with
    too few or too many fields, an error."""
    schema = ", ".join(f"`{name.replace('`', '``')}` string" for name in names)
    row = F.from_csv("record", schema, {"escape": '"', "mode": "FAILFAST" if strict else "PERMISSIVE"})
    if strict:
        row = F.when(F.col("broken"), F.raise_error(F.concat(F.lit("quotes never close in "), "record"))).otherwise(row)
    return found.select("broken", row.alias("row"))
