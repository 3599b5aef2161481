"""From raw documents to packed training sequences, in five stages.

Each stage takes all that the one before kept.  All but the last return rows with
the columns of documents.

A null text counts as empty; empty texts are never toxic by their words, are copies
of each other, near copies of nothing, add nothing to a mix, and pack as their end
mark.  A null id, language or source is a value like others, except that near copies
are told by id: rows without one stay.  Texts are taken whole, however long.  Rows that
repeat are copies, of which one stays.  Ties: a score at the threshold is toxic, of
equal texts the largest id stays, of near copies the smallest.  Columns beside those of
documents, whatever their names, are handed on up to the last stage.  An empty table
gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from parapet.llm import exact_dedup, mixing, near_dedup, packing, toxicity
from parapet.llm.shared import shared_folder, unused


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorization machine scores below the threshold.

    A score at the threshold is toxic.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    machine = toxicity.fit(docs, labels)
    score = unused("_score", docs)
    scored = toxicity.with_score(docs, machine, score_col=score)
    return scored.where(F.col(score) < toxicity.THRESHOLD).select(*[f"`{c}`" for c in docs.columns])


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row for each text, A-Z in lower case: the one with the largest id."""
    return exact_dedup.drop_duplicates(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, similarity 0.8.

    The one with the smallest id stays; a text without words is no near copy.
    """
    return near_dedup.drop_near_duplicates(docs, near_dedup.Rule(words=5, percent=80))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights: parts of documents, some of them twice.

    A null source is one of its own; a text without words adds nothing.
    """
    return mixing.mixed_documents(docs, mixing.mix(docs))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the training sequences.  An empty text is its end mark."""
    return packing.pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: Trained scores and sketches have no SQL; tests compare stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents.  What a stage keeps is written to the shared folder
    and read by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = shared_folder(spark, "pipeline")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            path = f"{folder}/{i}-{name}"
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
