"""Small helpers shared by the corpus operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import persist_shared, shared_dir  # noqa: F401  (the operators take them from here)

#: A word is a run of anything but space and the ASCII control blanks (fixed by the contracts).
WORD = r"[^\x20\x09-\x0D]+"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and hand it to ``body``.

    Catalyst inlines a projected column into the lambdas that use it, where it would be evaluated once per
    element; a lambda variable is evaluated once per row.
    """
    return F.transform(F.array(value), body).getItem(0)


def text_of(docs: DataFrame, text_col: str = "text") -> Column:
    """The text as a string, null counted as empty."""
    return F.coalesce(docs[text_col].cast("string"), F.lit(""))


def count_words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")
