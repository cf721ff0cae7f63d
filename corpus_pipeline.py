"""From raw documents to packed training sequences: five stages, each on all rows that its predecessor kept.

Labels are read from ``sf_dir``; between stages the rows are written as Parquet to the shared folder and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from causeway.llm.common import documents, labels, persist_shared
from causeway.llm.exact_dedup import exact_dedup
from causeway.llm.jaccard_join import near_dedup
from causeway.llm.mixing import mixed_documents
from causeway.llm.packing import pack
from causeway.llm.toxicity import drop_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that aren't predicted toxic.

    Null, empty and very long texts, null ids and repeated rows are judged row by row; an empty table stays empty; columns
    of any name pass through. The labels of ``sf_dir`` are learned from outside the held-out fold.
    """
    return drop_toxic(docs, labels(spark, sf_dir))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents of equal text the one with the largest id; null and empty texts are one group.

    Of rows that repeat id and text the one whose columns hash lowest stays; an empty table stays empty; columns of any
    name pass through; very long texts are compared whole.
    """
    return exact_dedup(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies, the first by id; texts without words stay.

    A null id stands last in its class; of rows that repeat id and text the one whose columns hash lowest stays; an empty
    table stays empty; columns of any name pass through; very long texts are shingled whole.
    """
    return near_dedup(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the mix, each as often as it is taken; those without words are never taken.

    Null sources are one source, null ids ids like others; rows that repeat id, source and text are one document, taken
    as often as all of them; an empty table stays empty; columns of any name pass through.
    """
    return mixed_documents(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the packed sequences. One document of each class of near copies is left by now, so clusters, texts
    that must not share a bin, are the copies that the mix took: equal texts.

    Empty texts are empty pieces, long ones are cut; null sources are one source; an empty table stays empty.
    """
    return pack(docs)


STAGES = [("toxicity", toxicity), ("exact dedup", exact_copies), ("n-gram Jaccard join", near_copies), ("mixing", mixing), ("best-fit packing", packing)]

#: The network and the random rounding can't be said in SQL; tests hold the rows against the stages' own references.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = persist_shared(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
