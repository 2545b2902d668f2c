"""Pipeline over the documents table: filter, clean, deduplicate, decontaminate, mix.

Each stage is (name, function) with ``function(spark, docs, sf_dir)``; its result is written as Parquet and
read again as the next one's ``docs``. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillwork.llm.common import read_table, stored
from rillwork.llm.decontaminate import clean_documents
from rillwork.llm.line_dedup import drop_lines
from rillwork.llm.mixing import sample_mixture
from rillwork.llm.near_dedup import keep_one
from rillwork.llm.quality import keep_good


def quality(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    return keep_good(docs, read_table(spark, folder, "labels"))


def lines(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Every document without the lines that an earlier document holds; n_chars follows the text."""
    row = F.col("row").withField("text", F.when(F.col("row.text").isNotNull(), F.col("kept")))
    row = row.withField("n_chars", F.when(F.col("n_dropped") > 0, F.char_length("kept").cast("long")).otherwise(F.col("row.n_chars")))
    return drop_lines(docs).select(row.alias("row")).select("row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """One document of each group of near duplicates (shingles of five words, similarity from 0.8)."""
    return keep_one(docs, size=5, threshold=0.8)


def decontamination(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents that hold no benchmark passage to speak of."""
    return clean_documents(docs, read_table(spark, folder, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """A sample with the target shares of sources, languages and topics, and each row's probability."""
    return sample_mixture(docs)


STAGES = [
    ("quality classifier", quality),
    ("line dedup", lines),
    ("MinHash near-dedup", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("mixing sources to target weights", mixing),
]

#: The quality classifier is trained, which SQL cannot express; the tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages applied to ``documents``."""
    docs = read_table(spark, sf_dir, "documents")
    for at, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if at + 1 < len(STAGES):
            docs = stored(docs, "stage")
    return docs
