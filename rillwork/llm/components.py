"""Connected components of a link table by repeated minimum and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillwork.llm.common import stored


def components(links: DataFrame) -> DataFrame:
    """(id, component): the smallest id that each linked id reaches over (a, b) links.

    Every round takes the smallest label among neighbours and then the label of that label, so the
    number of rounds grows with the logarithm of a chain's length. Labels are written to the shared
    folder after each round; a hot id only adds rows to sums that are combined before the shuffle.
    """
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    edges = stored(both.where("a <> b").distinct(), "edges")
    labels = stored(edges.groupBy("a").agg(F.min("b").alias("m")).select(
        F.col("a").alias("id"), F.least("a", "m").alias("component")), "labels")
    while True:
        near = edges.join(labels.hint("merge"), edges["b"] == labels["id"]).groupBy("a").agg(F.min("component").alias("m"))
        lower = labels.join(near, labels["id"] == near["a"]).select(
            "id", F.col("component").alias("old"), F.least("component", "m").alias("component"))
        lower = stored(lower, "labels")
        target = lower.select(F.col("id").alias("t"), F.col("component").alias("next"))
        jumped = lower.join(target.hint("merge"), lower["component"] == F.col("t")).select(
            "id", "old", F.least("component", "next").alias("component"))
        jumped = stored(jumped, "labels")
        labels = jumped.select("id", "component")
        if not jumped.where("old <> component").limit(1).count():
            return labels
