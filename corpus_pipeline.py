"""From raw documents to a mixed training set: five operators, each on all that its predecessor kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tabveil.llm import classifier, decontaminate, jaccard, lines, mixing
from tabveil.llm.blobs import Steps


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the classifier, trained on the labels that aren't held out, scores 0.3 or more."""
    return classifier.score(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), keep_columns=True)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows; lines of 40 characters or more in 5 documents or more stay in the one of largest doc_id only."""
    return lines.dedup_lines(docs, keep_columns=True)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group linked by a Jaccard similarity of 0.8 or more on five-word shingles."""
    return jaccard.one_of_each(docs, n=5, percent=80)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold no benchmark item."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows of which the mix takes words, with size, source_size, target, taken, position and positions, sorted by range of position."""
    return mixing.mix(docs).where("taken > 0")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_classifier", keep_quality),
    ("line_dedup", drop_repeated_lines),
    ("ngram_jaccard_join", drop_near_copies),
    ("benchmark_decontamination", drop_benchmark),
    ("source_mixing", mix_sources),
]

#: The classifier is trained and the components are iterated: SQL can't express those stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in their order over documents, each written as Parquet and read again; a stage's input goes when it is done."""
    steps = Steps(spark)
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for _, stage in STAGES:
        docs = steps.keep(stage(spark, docs, sf_dir))
        if last is not None:
            steps.drop(last)
        last = docs
    return docs
