"""Documents to token ids: five stages, each a corpus operator over all that the stage before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from driftframe.llm.mixing import mixed_documents
from driftframe.llm.pieces import encoded
from driftframe.llm.shared import read, result
from driftframe.llm.simhash import without_near_duplicates
from driftframe.llm.substrings import without_repeats
from driftframe.llm.toxicity import without_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score as toxic go."""
    return without_toxic(docs, read(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates, the document of the smallest doc_id stays."""
    return without_near_duplicates(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of passages that occur earlier go from the text; every document stays."""
    return without_repeats(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's target takes them: never, once or up to thrice."""
    return mixed_documents(docs)


def tokenising(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sampled piece ids of each row."""
    return encoded(docs)


STAGES = [
    ("toxicity", toxicity),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("mixing", mixing),
    ("tokenising", tokenising),
]

#: Trained models, draws and fingerprints are not SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other; what a stage wrote on its way goes once its result is written."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = result(spark, lambda: stage(spark, docs, sf_dir), name)  # noqa: B023 - called at once
    return STAGES[-1][1](spark, docs, sf_dir)
