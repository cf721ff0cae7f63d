"""Join patterns over the built-in equi joins."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def co_occurrence(df: DataFrame, entity: str, attributes: Sequence[str], anchor: Any, least: int) -> DataFrame:
    """entity, shared: other entities that share at least ``least`` attribute values with the anchor.

    Only the anchor's own values are joined to the table, not all pairs of entities.
    """
    pairs = df.select(entity, *attributes).dropna().distinct()
    own = pairs.where(F.col(entity) == anchor).select(*attributes)
    met = pairs.where(F.col(entity) != anchor).join(own, list(attributes))
    return met.groupBy(entity).agg(F.count(F.lit(1)).alias("shared")).where(F.col("shared") >= least)


def attach_marker(left: DataFrame, right: DataFrame, keys: Sequence[str], marker: str) -> DataFrame:
    """Left join with a column that says whether a row was found."""
    return left.join(right.withColumn(marker, F.lit(True)), list(keys), "left").withColumn(marker, F.coalesce(marker, F.lit(False)))


def left_with_domain(df: DataFrame, key: str, start: int, end: int, fill: Mapping[str, Any]) -> DataFrame:
    """Every integer of [start, end) with the row that has it, or the fill values."""
    return df.sparkSession.range(start, end).withColumnRenamed("id", key).join(df, key, "left").na.fill(dict(fill))


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row: n_rows, n_keys, n_surplus."""
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct(F.struct(*keys)).alias("n_keys")).withColumn("n_surplus", F.col("n_rows") - F.col("n_keys"))


def require_unique(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The table, or ValueError if a key occurs twice; the check is one aggregation."""
    surplus = duplicate_keys(df, keys).first()["n_surplus"]
    if surplus:
        raise ValueError(f"{surplus} rows repeat a key of {list(keys)}")
    return df
