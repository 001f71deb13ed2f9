"""From raw documents to a training mix: five stages, each over all its predecessor kept.

Every stage takes nulls in any column, empty and very long texts, ties, repeated rows, empty tables and further
columns of any name, as its operator states; it returns the columns it was given, and an empty table for an empty one. Toxicity
scores null and empty texts like others, line dedup drops only what it has emptied itself, a text without words is no one's
copy and holds no benchmark passage, and its size in the mix is 0. Rows that repeat are judged one by one, but near-dedup keeps one of them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from runledger.llm.common import named, stage_scratch, stored, table
from runledger.llm.decontaminate import contamination
from runledger.llm.line_dedup import dedup_lines
from runledger.llm.mixing import mix
from runledger.llm.near_duplicates import near_duplicates
from runledger.llm.toxicity import toxicity
from runledger.session import ship_package, use_utc

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose calibrated score says toxic."""
    with stage_scratch(docs):
        judged = toxicity(docs, table(spark, sf_dir, "labels"))
    return judged.where("predicted = 0").select(named(docs.columns))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Deletes later copies of line runs of 50 words or more, and documents left without a word."""
    ship_package(spark)
    with stage_scratch(docs):
        left = dedup_lines(docs, min_words=50)
    return left.where("NOT emptied").select(named(docs.columns))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near-duplicates: five words, similarity 0.8."""
    ship_package(spark)
    with stage_scratch(docs):
        grouped = near_duplicates(docs, n=5, percent=80)
    return grouped.where("keeper").select(named(docs.columns))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold ten consecutive words of a benchmark item, or a whole shorter one."""
    with stage_scratch(docs):
        judged = contamination(docs, table(spark, sf_dir, "benchmark"))
    return judged.where("NOT contaminated").select(named(docs.columns))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How many words of each document the training mix takes, repeats counted."""
    ship_package(spark)
    with stage_scratch(docs):
        mixed = mix(docs)
    return mixed.select("doc_id", "source", "size", "source_size", "target", "taken")


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mix", mix_sources),
]

# A learned classifier has no SQL form. The tests say which documents line dedup, near-dedup and decontamination keep
# of planted copies, and judge toxicity by held-out labels.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other; a stage's own folders go when the next one begins."""
    docs = table(use_utc(spark), sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
