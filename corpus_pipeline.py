"""A corpus pipeline: quality classifier, near-duplicate groups, repeated passages, benchmark passages, and the mixture.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and read again before the next
stage, so a lost executor costs one stage's tasks at most. All stages but the last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from plausia.llm import decontamination, mixing, near_dedup, quality_classifier, substring_dedup
from plausia.llm.common import Scratch, made, ready, sweep, table

#: Shares of the tokens after mixing. The classifier has taken out low quality before.
TARGETS = {"q1_t0": 0.97, "q1_t1": 0.03}


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't reject."""
    return quality_classifier.accepted(spark, docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, and all that are in none."""
    return near_dedup.one_of_each(spark, docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the words of passages that an earlier document has."""
    return substring_dedup.without_repeats(spark, docs)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontamination.clean(spark, docs, table(spark, sf_dir, "benchmark"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with the rate and the number of copies that the target weights ask for."""
    return mixing.drawn(spark, docs, table(spark, sf_dir, "labels"), TARGETS)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("benchmark_passages", benchmark_passages),
    ("mixture", mixture),
]

#: The stages hold models fitted in numpy and iterations that SQL can't express; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other over documents, each written and read again. A stage's own tables go once its result is written."""
    ready(spark)
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        before = made()
        docs = scratch.save(stage(spark, docs, sf_dir), name)
        sweep(before)
        if i:
            scratch.drop(STAGES[i - 1][0])
    return docs
