"""A corpus pipeline of the operators for training data.

Toxic documents go, then exact copies, then all but one document of each group of near
duplicates, by fingerprints and by exact similarity; the rest is mixed to target weights
in curriculum order, and packed into training windows. Each stage is written and read again as the next one's documents.
All but the last return the columns of `documents`, extra ones too, whatever their names. Null
texts count as empty, null ids are ids among themselves, rows repeated whole are copies,
and an empty table goes through all stages; each stage says what ties it breaks how.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from corpusloom.llm import exact_dedup, mixing, packing, queries, similar, toxicity
from corpusloom.session import tune, written

NEAR_WORDS = 5  # of a shingle

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _tuned(stage: Stage) -> Stage:
    """The stage under the session settings the operators rely on."""

    @functools.wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        return stage(tune(spark), docs, sf_dir)

    return run


@_tuned
def toxic_removal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents below the toxicity threshold of their language. The classifier learns from
    the labelled documents of this stage's input."""
    return toxicity.clean(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


@_tuned
def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts that are equal without white space."""
    return exact_dedup.survivors(docs, exact_dedup.one_of_each(docs))


@_tuned
def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group linked by SimHash fingerprints or by a
    Jaccard measure of 0.8 or more. Fingerprints of such texts may differ in far more bits than
    are linked, so the measure is taken exactly."""
    return exact_dedup.survivors(docs, similar.one_of_each(docs, NEAR_WORDS))


@_tuned
def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as often as the mix takes them, in curriculum order."""
    return mixing.curriculum(docs)


@_tuned
def windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in training windows, with their token ids."""
    return packing.packed(docs, queries.tokenizer_path())


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", toxic_removal),
    ("exact_dedup", exact_copies),
    ("simhash_near_dedup", near_copies),
    ("mixing", source_mix),
    ("packing", windows),
]

#: SQL has neither a trained classifier nor a tokenizer; tests compare with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; the rows of the last."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


QUERIES = {"pipeline": run}
SQL: dict[str, str] = {}
