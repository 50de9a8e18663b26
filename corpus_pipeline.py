"""From raw documents to packed training sequences, in five stages.

Toxic documents go, one document of each near-duplicate group stays, repeated passages are cut, the
sources are mixed to their target weights, and the rest is packed into bins.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lumenfold.llm.minhash import drop_near_duplicates
from lumenfold.llm.mixing import mix_sources
from lumenfold.llm.packing import packed_bins
from lumenfold.llm.scratch import Scratch
from lumenfold.llm.suffix import drop_repeated_passages
from lumenfold.llm.toxicity import LEXICON, drop_toxic, learned_terms

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the lexicon doesn't reject; terms are added to it from the labelled ones among them.

    Null and empty texts stay, as do repeated rows (each is judged by itself), null ids and all columns; an empty table stays empty.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return drop_toxic(docs, lexicon=learned_terms(docs, labels) | LEXICON)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least id of each group of near duplicates, and all that are in none.

    Rows without an id, a text or a word are in no group and stay; rows with the same id are one document and stay or go together.
    """
    return drop_near_duplicates(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without passages of 50 words and more that occurred before; of equal ones the least (id, place) stays.

    No row goes: a text may become empty. Rows without an id or a text stay as they are; those that share an id are cut alike.
    """
    return drop_repeated_passages(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """As many copies of each document (one at least) as bring sources and languages to tempered shares.

    Null sources and languages are groups of their own; texts without words get their groups' rate; an empty table stays empty.
    """
    return mix_sources(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bins of up to 2048 words: the pieces of documents that each holds, in order.

    Every word of every row is in one bin; longer texts are cut, rows without words are in none. An empty table gives no bins.
    """
    return packed_bins(docs)


STAGES: list[tuple[str, Stage]] = [("toxicity", toxicity), ("near_duplicates", near_duplicates), ("repeated_passages", repeated_passages), ("mixing", mixing), ("packing", packing)]

#: A genetic algorithm decides the bins, which SQL can't express; the tests compare each stage with a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scratch = Scratch(spark)
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = scratch.save(docs, name)
            if k:
                scratch.drop(STAGES[k - 1][0])
    return docs
