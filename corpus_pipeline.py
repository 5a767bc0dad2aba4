"""The corpus pipeline: five stages, each over all that its predecessor kept.

Every stage takes nulls in any column, empty and very long texts, repeated rows and ids, ties, and extra columns whatever their names; an
empty table goes through all of them as one. What a stage does with such rows is said by the operator that it calls.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ledgerloom.llm import mixing, near_dedup, sentencepiece_fst, suffix_dedup, toxicity
from ledgerloom.llm.common import discard, materialize, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Fit on the labelled documents of docs; the rows that the classifier rejects go. Texts that are null or without words stay; without both classes of labels all do."""
    return toxicity.drop_toxic(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, the one with the least id. Rows without an id, a text or words stay."""
    return near_dedup.keep_one(docs)


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that recur are cut from all documents but their first; a text of which nothing is left goes. Rows without an id or a text stay as they are."""
    return suffix_dedup.cut_repeats(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample by probabilities raked to source, language and topic, a null being the value ''. Rows that repeat an id go or stay by one number."""
    return mixing.keep_sampled(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, row by row; a null text has null ids, an empty one none. All are decoded again; decodes says whether they give the normalised text."""
    return sentencepiece_fst.encode(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_duplicates),
    ("suffix_dedup", cut_repeated_passages),
    ("mixing", mix_sources),
    ("sentencepiece", encode),
]
#: SQL can't train a classifier or walk a transducer; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over the table documents."""
    docs, before = table(spark, sf_dir, "documents"), None
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialize(docs)
            if before is not None:
                discard(before)  # the stage that read it is written
            before = docs
    return docs
