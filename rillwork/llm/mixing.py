"""Mixing sources to target weights: iterative proportional fitting and calibrated sampling.

Tokens are summed by (source, language, topic). The cell sums are raked: one margin after the other
is scaled to its target shares, round after round, until all margins hold together to ``TOLERANCE``. With ``rate`` the
tokens wanted for each token there is, a document is wanted rate * raked / original tokens of its cell
times. It is sampled with that probability, at most 1, and carries the rest as its weight (how often to
use it), so that the expected weighted tokens have exactly the raked sums. Only DataFrame functions are
used. Cells are counted by categories, not by documents.

* A null source, language or topic is a category of its own, ``(none)``. Tokens are the words of the
  whole text; null or empty text has none, and a cell without tokens is sampled with probability 0.
* Repeated rows with the same doc_id share one draw. A row with null doc_id draws by its text.
* An empty table gives an empty result. Given targets are rescaled to the categories that occur; one
  that they do not name gets weight 0. Extra columns are carried along.
* Targets that cannot all be met together (as when each source has one language, and the targets of both
  disagree) are approached until no cell gains any more; a warning then gives the remaining error of each margin.
"""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rillwork.llm.common import stored

# Patterns whose matches name a text's topic (the most matches win, the first of equals),
# least and most rounds of raking, relative error of a margin that is allowed, gain of a cell between stored cells that is
# none, cells that one task rakes without a shuffle, tokens wanted per token, rounds between stored cells, and the power that
# flattens margins without a given target.
TOPICS = {
    "legal": "[Ll]icen[cs]|[Cc]opyright|[Ww]arranty|[Pp]ermission",
    "contact": "@|https?://|[+][0-9]",
    "table": "[|]",
    "record": "[0-9]{4,}",
}
OTHER = "prose"
NONE = "(none)"
MARGINS = ("source", "lang", "topic")
ROUNDS = 10
MOST_ROUNDS = 1000
TOLERANCE = 1e-6
NO_GAIN = 1e-9
FEW = 20_000
RATE = 0.5
STORE_EVERY = 5
FLATTEN = 0.7
WORD = "[^\\x20\\x09-\\x0D]+"


def topic_column(text: Column) -> Column:
    counts = [F.coalesce(F.regexp_count(text, F.lit(p)), F.lit(0)) for p in TOPICS.values()]
    most = F.greatest(*counts)
    topic = F.when(most == 0, OTHER)
    for name, count in zip(TOPICS, counts):
        topic = topic.when(count == most, name)
    return topic


def token_column(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def category(column: Column) -> Column:
    return F.coalesce(column.cast("string"), F.lit(NONE))


def describe(docs: DataFrame, topic: Column | None = None) -> DataFrame:
    """Every row as ``row``, with its cell, its tokens and its draw in [0, 1)."""
    text = F.col("row.text").cast("string")
    draw = F.md5(F.concat(F.lit("mix:"), F.coalesce(F.col("row.doc_id").cast("string"), text, F.lit(""))).cast("binary"))
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")).select(
        "row", category(F.col("row.source")).alias("source"), category(F.col("row.lang")).alias("lang"),
        category(topic if topic is not None else topic_column(text)).alias("topic"),
        token_column(text).alias("tokens"),
        (F.conv(F.substring(draw, 1, 13), 16, 10).cast("double") / float(16**13)).alias("draw"),
    )


def flattened(cells: DataFrame, margin: str, power: float = FLATTEN) -> DataFrame:
    """Target of a margin: its token sums to a power below 1, so that small categories gain."""
    return cells.groupBy(margin).agg(F.pow(F.sum("tokens").cast("double"), power).alias("share"))


def margin_errors(cells: DataFrame) -> tuple[dict[str, float], float]:
    """Largest relative error of each margin, and the largest gain of a cell since ``before``."""
    goals = [F.struct(F.lit(m).alias("margin"), F.col(m).alias("category"), (F.col("all") * F.col(f"share_{m}")).alias("goal"))
             for m in MARGINS]
    sums = cells.select(F.explode(F.array(*goals)).alias("g"), "raked", "all", F.try_divide("raked", "before").alias("gain")).groupBy(
        "g.margin", "g.category").agg(
        F.sum("raked").alias("now"), F.coalesce(F.max("g.goal"), F.lit(0.0)).alias("goal"), F.max("all").alias("all"), F.max("gain").alias("gain"))
    # A category that is to have no weight is held against all tokens.
    off = F.try_divide(F.abs(F.col("now") - F.col("goal")), F.when(F.col("goal") > 0, F.col("goal")).otherwise(F.col("all")))
    rows = sums.groupBy("margin").agg(F.coalesce(F.max(off), F.lit(0.0)).alias("error"), F.max("gain").alias("gain")).collect()
    return {r["margin"]: r["error"] for r in rows}, max((r["gain"] or 1.0 for r in rows), default=1.0) - 1.0


def rake(cells: DataFrame, targets: dict[str, DataFrame], rounds: int = ROUNDS, most: int = MOST_ROUNDS) -> DataFrame:
    """(source, lang, topic, tokens, raked): cell sums scaled to the target shares of each margin.

    ``targets`` has a table (category, share) for each margin. The raked sums add up to the tokens. After ``rounds``
    rounds it goes on until the margins hold; if they cannot, or not in ``most`` rounds, it warns of what remains.
    """
    cells = cells.withColumn("all", F.sum("tokens").over(W.partitionBy()).cast("double"))
    for margin in MARGINS:
        cells = cells.join(targets[margin].select(
            category(F.col(margin)).alias(margin), F.col("share").alias(f"share_{margin}")), margin, "left")
    cells = cells.fillna(0.0, [f"share_{m}" for m in MARGINS]).withColumn("raked", F.col("tokens").cast("double"))
    cells = stored(cells, "cells")
    for margin in MARGINS:
        # A share counts once for each category that occurs.
        once = cells.select(margin, f"share_{margin}").distinct().agg(F.sum(f"share_{margin}").alias("s"))
        cells = cells.withColumn(f"share_{margin}", F.try_divide(F.col(f"share_{margin}"), once.scalar()))
    few = cells.count() <= FEW
    cells = (cells.coalesce(1) if few else cells).withColumn("before", F.col("raked"))
    at = 0
    while True:
        at += 1
        for margin in MARGINS:
            now = F.sum("raked").over(W.partitionBy(margin))
            goal = F.col("all") * F.col(f"share_{margin}")
            cells = cells.withColumn("raked", F.coalesce(F.try_divide(F.col("raked") * goal, now), F.lit(0.0)))
        if at % STORE_EVERY and at != rounds:
            continue
        cells = stored(cells, "cells")
        if at >= rounds:
            errors, gain = margin_errors(cells)
            worst = max(errors.values(), default=0.0)
            # Small cells that still gain can close a margin yet, however little it moves meanwhile.
            if worst <= TOLERANCE or gain <= NO_GAIN or at >= most:
                break
        cells = (cells.coalesce(1) if few else cells).withColumn("before", F.col("raked"))
    if worst > TOLERANCE:
        left = ", ".join(f"{m} {errors[m]:.2g}" for m in MARGINS)
        warnings.warn(f"mixing targets are not met after {at} rounds; largest relative error of a margin: {left}", stacklevel=2)
    return cells.select(*MARGINS, "tokens", "raked")


def mix(
    docs: DataFrame, targets: dict[str, DataFrame] | None = None, topic: Column | None = None, rate: float = RATE,
    carried: list[str] | None = None,
) -> DataFrame:
    """Every row as ``row`` with (source, lang, topic, tokens, probability, weight, sampled).

    With ``carried``, ``row`` has these columns only, and what is told of a text is stored: texts are read once, not twice.
    """
    described = describe(docs, topic)
    if carried is not None:
        described = stored(described.withColumn("row", F.struct(*[F.col(f"row.`{c}`") for c in carried])), "described")
    cells = stored(described.groupBy(*MARGINS).agg(F.sum("tokens").alias("tokens")), "cells")
    given = targets or {}
    raked = rake(cells, {m: given[m] if m in given else flattened(cells, m) for m in MARGINS})
    times = F.coalesce(rate * F.try_divide("raked", F.col("tokens").cast("double")), F.lit(0.0))
    # Small by its stored size, the table of cells is broadcast by the planner; else hot cells are split.
    wanted = stored(raked.select(*MARGINS, times.alias("times")), "times")
    return described.join(wanted, list(MARGINS), "left").select(
        "row", *MARGINS, "tokens", F.least(F.lit(1.0), "times").alias("probability"),
        F.greatest(F.lit(1.0), "times").alias("weight"), (F.col("draw") < F.col("times")).alias("sampled"),
    )


def mixing_report(docs: DataFrame) -> DataFrame:
    return mix(docs, carried=["doc_id"]).select(
        F.col("row.doc_id").alias("doc_id"), *MARGINS, "tokens", F.round("probability", 6).alias("probability"),
        F.round("weight", 6).alias("weight"), "sampled")


def sample_mixture(docs: DataFrame) -> DataFrame:
    """The sampled rows with all their columns and how often to use each, as ``mix_weight``."""
    return mix(docs).where("sampled").select("row.*", F.col("weight").alias("mix_weight"))
