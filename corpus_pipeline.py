"""A corpus pipeline of the training-data operators; each stage works on what the one before it kept.

Texts of rows that stay change in two stages: repeated runs of lines are cut out (a text may become empty), and benchmark spans that only items
of fewer than ten words have. Null texts stay null; to the near-dedup all texts without words, null ones too, are copies of one another, and one row of
them stays. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lattica.llm import decontaminate, linededup, neardup, packing, quality
from lattica.llm.common import stored, table


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't reject."""
    return quality.filtered(docs, table(spark, sf_dir, "labels"))


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated runs of two lines or more, and repeated lines of 50 words or more, go, but for their first occurrence."""
    return linededup.dedup(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (SimHash candidates, five-word shingles at Jaccard 0.8 or more) stays, the one of the smallest doc_id."""
    return neardup.dedup(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a whole benchmark window go; shorter items' words are cut."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' tokens and their places in sequences."""
    return packing.pack(docs)


STAGES = [("quality", keep_quality), ("line_dedup", drop_lines), ("near_dedup", drop_near_copies), ("decontaminate", drop_benchmark), ("pack", pack)]

#: The classifier, the hashes and the packing aren't expressible in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs, f"pipeline-{name}")
    return docs
