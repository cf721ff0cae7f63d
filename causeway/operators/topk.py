"""Top-k, per-group top-k and retention."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def threshold_top_k(df: DataFrame, score: str, least: float, k: int, tie: str) -> DataFrame:
    """The k best rows of at least the threshold; ties by id."""
    return df.where(F.col(score) >= least).orderBy(F.col(score).desc(), tie).limit(k)


def top_k_per(df: DataFrame, keys: Sequence[str], order: Sequence, k: int, name: str) -> DataFrame:
    """The first k rows of each group with their place; Spark limits groups before the shuffle."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(name) <= k)


def ranked(df: DataFrame, order: Sequence, k: int, name: str) -> DataFrame:
    """The first k rows with their place from 1: only those k rows meet in one task."""
    return df.orderBy(*order).limit(k).withColumn(name, F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order)))


def retention_set(df: DataFrame, group: str, run: str, metric: str, k: int, always: Sequence[Any]) -> DataFrame:
    """group, run, kept: the k best runs of each group and those always kept."""
    place = F.row_number().over(Window.partitionBy(group).orderBy(F.col(metric).desc(), run))
    return df.select(group, run, ((place <= k) | F.col(run).isin(list(always))).alias("kept"))


def last_per(folds: DataFrame, fold: str, step: int) -> DataFrame:
    """Every step-th fold from the first in order; folds are few (one row for each)."""
    nth = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(fold)) - 1
    return folds.withColumn("_nth", nth).where(F.col("_nth") % step == 0).drop("_nth")
