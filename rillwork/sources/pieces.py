"""GeoJSON collections of any form, also a whole one on one line, read by many tasks.

A file is cut at every ``}``, wherever Spark splits it. What a piece means depends on two things that lie before it: whether it
begins inside a string, and how many objects are open. The first is a parity of quotes; the second is a sum that each piece
knows for both answers. A block of a file (what one task reads of it) gives one row of sums, the blocks of a file are chained in
their order, and then every piece knows its depth. A feature is an object at depth two below the key ``features``. Its pieces
are put together within their block; only features cut by the end of a block are shuffled to meet the rest of themselves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rillwork.session import broadcast_if_small, checkpoint, stored

# Text up to the first brace outside strings; a key or another string.
_LEAD = r'[^{"]*+(?:"[^"\\]*+(?:\\.[^"\\]*+)*+"[^{"]*+)*+'
_TOKEN = r'(?s)"[^"\\]*+(?:\\.[^"\\]*+)*+"(?:\s*:)?'
#: What stands at depth one before an object, from depth zero and from depth one, and the object from its brace on.
_LEADS = (rf"(?s)^{_LEAD}\{{({_LEAD})", rf"(?s)^({_LEAD})")
_OBJECTS = (rf"(?s)^{_LEAD}\{{{_LEAD}(\{{.*)$", rf"(?s)^{_LEAD}(\{{.*)$")

PLACE = ["file", "block"]


def _braces(text: Column) -> Column:
    """Opening braces outside strings of a text that begins outside of one; escapes are gone already."""
    bare = F.regexp_replace(text, r'"[^"]*+(?:"|$)', "")
    return F.length(bare) - F.length(F.replace(bare, F.lit("{")))


def _pieces(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, block, at, piece, flips, outside, inside): pieces in place, whether they hold an odd number of quotes, and what
    they add to the depth with the brace behind them if they begin outside or inside a string."""
    read = spark.read.option("lineSep", "}").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("at"), F.col("value").alias("piece"))
    plain = F.regexp_replace("piece", r"(?s)\\.", "")
    flips = (F.length(plain) - F.length(F.replace(plain, F.lit('"')))) % 2 == 1
    found = read.withColumns({"flips": flips, "_plain": plain})
    # A brace inside a string closes nothing.
    return found.select(
        *PLACE, "at", "piece", "flips",
        (_braces(F.col("_plain")) - (~F.col("flips")).cast("int")).alias("outside"),
        (_braces(F.regexp_replace("_plain", '^[^"]*+(?:"|$)', "")) - F.col("flips").cast("int")).alias("inside"))


def _before(*by: str) -> W:
    return W.partitionBy(*by[:-1]).orderBy(by[-1]).rowsBetween(W.unboundedPreceding, -1)


def _odd(flips: Column, window: W) -> Column:
    return F.coalesce(F.count_if(flips).over(window), F.lit(0)) % 2 == 1


def _entries(pieces: DataFrame) -> DataFrame:
    """(file, block, quoted, depth, ended): the state in which each block begins; ``ended`` is false in the last block of a file
    that does not close what it opens."""
    odd = pieces.select(*PLACE, "flips", "outside", "inside", _odd(F.col("flips"), _before(*PLACE, "at")).alias("odd"))
    net = lambda quoted: F.sum(F.when(quoted, F.col("inside")).otherwise(F.col("outside")))
    sums = checkpoint(odd.groupBy(*PLACE).agg(
        (F.count_if("flips") % 2 == 1).alias("flips"), net(F.col("odd")).alias("outside"), net(~F.col("odd")).alias("inside")))
    chain = sums.withColumn("quoted", _odd(F.col("flips"), _before(*PLACE)))
    chain = chain.withColumn("net", F.when(F.col("quoted"), F.col("inside")).otherwise(F.col("outside")))
    chain = chain.withColumn("depth", F.coalesce(F.sum("net").over(_before(*PLACE)), F.lit(0)))
    last = F.lead("block").over(W.partitionBy("file").orderBy("block")).isNull()
    # Text behind the last brace of a file has no brace after it, though it is counted with one.
    ended = ~last | (F.col("quoted") == F.col("flips")) & (F.col("depth") + F.col("net")).isin(0, -1)
    return checkpoint(chain.select(*PLACE, "quoted", "depth", ended.alias("ended")))


def _placed(pieces: DataFrame, entries: DataFrame) -> DataFrame:
    """(file, block, at, piece, depth, after, quoted): depth before and after a piece, and whether it begins inside a string."""
    known = pieces.join(broadcast_if_small(entries, stored=True).withColumnsRenamed({"quoted": "_quoted", "depth": "_depth"}), PLACE)
    before = _before(*PLACE, "at")
    known = known.withColumn("quoted", F.col("_quoted") != _odd(F.col("flips"), before))
    known = known.withColumn("_net", F.when(F.col("quoted"), F.col("inside")).otherwise(F.col("outside")))
    depth = F.col("_depth") + F.coalesce(F.sum("_net").over(before), F.lit(0))
    # A piece that begins at depth -1 stands behind a brace that nothing opened.
    depth = F.when(depth < 0, F.raise_error(F.concat(F.lit("a brace too many in "), "file")).cast("long")).otherwise(depth)
    known = known.withColumn("depth", depth)
    # A piece that ends inside a string adds only its opening braces, and the brace behind it belongs to the string.
    return known.select(*PLACE, "at", "piece", "depth", (F.col("depth") + F.col("_net")).alias("after"), "quoted",
                        (F.col("quoted") != F.col("flips")).alias("open"))


def feature_texts(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, text): the text of every feature of the collections in ``path``.

    A file may hold several collections, in any layout. Objects below other keys than ``features`` are left out. A file that does not close
    its strings and objects is an error, and so is a feature that stands in no collection. An empty file has no features.
    """
    # Stored once: another scan may cut the files into other blocks.
    pieces = stored(_pieces(spark, path), "pieces")
    entries = _entries(pieces)
    torn = entries.where(~F.col("ended")).select("file").first()
    if torn:
        raise ValueError(f"strings or objects are not closed in {torn['file']}")
    placed = _placed(pieces, entries)

    # A string that began before counts as one that is no key of interest.
    fresh = F.when(F.col("quoted"), F.concat(F.lit('"?'), "piece")).otherwise(F.col("piece"))
    low = F.col("depth") <= 1
    by_depth = lambda patterns: F.when(
        F.col("depth") == 0, F.regexp_extract(fresh, patterns[0], 1)).when(low, F.regexp_extract(fresh, patterns[1], 1))
    # The depth that a piece reaches before the brace behind it.
    reached = F.col("after") + (~F.col("open")).cast("int")
    keys = F.filter(F.regexp_extract_all(by_depth(_LEADS), F.lit(_TOKEN), F.lit(0)), lambda t: F.endswith(t, F.lit(":")))
    marked = placed.withColumns({
        "begins": F.when(low & (reached >= 2), F.struct("block", "at")),
        "key": F.regexp_extract(F.try_element_at(keys, F.lit(-1)), r'(?s)^"(.*)"\s*:$', 1),
        "part": F.concat(F.when(low, by_depth(_OBJECTS)).otherwise(F.col("piece")), F.lit("}")),
        "closes": ~F.col("open") & (reached == 2),
    })
    here = W.partitionBy(*PLACE).orderBy("at").rowsBetween(W.unboundedPreceding, W.currentRow)
    held = marked.withColumns({"start": F.last("begins", ignorenulls=True).over(here), "key": F.last("key", ignorenulls=True).over(here)})
    held = held.where(~low | F.col("begins").isNotNull())
    # A block puts its own pieces together, without a shuffle beyond that by block.
    local = stored(held.groupBy(*PLACE, "start").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "part"))), lambda p: p["part"]), "").alias("text"),
        F.max("closes").alias("closes"), F.max_by("key", "at").alias("key"),
    ), "objects")
    # What a block hands on: the object and the key that were last begun before it.
    tails = marked.groupBy(*PLACE).agg(F.max("begins").alias("start"), F.max_by("key", F.when(F.col("key").isNotNull(), F.col("at"))).alias("key"))
    earlier = _before(*PLACE)
    carried = tails.select(
        *PLACE, F.last("start", ignorenulls=True).over(earlier).alias("_start"), F.last("key", ignorenulls=True).over(earlier).alias("_key"))
    local = local.join(broadcast_if_small(carried), PLACE).withColumn("key", F.coalesce("key", "_key"))
    whole = local.where(F.col("start").isNotNull() & F.col("closes"))
    # At most two objects of each block: the one that it continues and the one that it leaves open.
    cut = local.where(F.col("start").isNull() | ~F.col("closes")).withColumn("start", F.coalesce("start", "_start"))
    joined = cut.groupBy("file", "start").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "text"))), lambda p: p["text"]), "").alias("text"),
        F.min_by("key", "block").alias("key"))
    found = whole.select("file", "text", "key").unionByName(joined.select("file", "text", "key"))
    alone = F.raise_error(F.concat(F.lit("a feature outside of a collection in "), "file")).cast("boolean")
    return found.where(F.when(F.col("key") == "geometry", alone).otherwise(F.col("key") == "features")).select("file", "text")
