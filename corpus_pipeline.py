"""The corpus pipeline: five stages over ``documents``, each one of the training-data operators.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and read
again as the next stage's ``docs``.  All but the last return the columns of ``docs``.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from factloom.llm import linededup, mixing, packing, quality, simhash
from factloom.llm.common import new_path, remove, scope, short_batches

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
_earlier: list[str] = []


def _stage(work: Stage) -> Stage:
    """A stage that first removes what earlier stages wrote for themselves: their results, which it is
    given, have been written by then."""

    @functools.wraps(work)
    def staged(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        short_batches(spark)
        remove(spark, _earlier)
        _earlier.clear()
        with scope() as made:
            out = work(spark, docs, sf_dir)
        _earlier.extend(made)
        return out

    return staged


@_stage
def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


@_stage
def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Long lines found in five documents or more stay in one of them."""
    return linededup.deduplicate(docs)


@_stage
def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays.

    Fingerprints are those of op10; those within 11 bits and with sizes within 0.8 of each other are
    candidates, and texts whose five-word shingles are similar by 0.8 or more are copies.  No candidate is
    left out that would link two groups.
    """
    return simhash.deduplicate(docs, max_bits=11, ratio=0.8, similar=0.8, crowd=32)


@_stage
def mixed_to_targets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Languages are raised to their token shares to the power 0.7; no document is dropped for it."""
    return mixing.mixed(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), grow=True)


@_stage
def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans of packed training sequences."""
    return packing.pack(docs)


STAGES = [
    ("quality classifier", good_documents),
    ("line dedup", without_repeated_lines),
    ("SimHash near-dedup", without_near_copies),
    ("mixing to target weights", mixed_to_targets),
    ("best-fit packing", packed),
]

#: Trained models, hashes and tokenizers are not expressible in SQL; the tests compare the stages
#: with brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole of ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = new_path(spark, "stage-" + name.split()[0].lower())
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
